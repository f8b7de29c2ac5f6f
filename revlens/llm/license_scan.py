"""License scans with a positional rare-token index.

Each template is a word sequence with postings `word -> positions`. The words'
document frequencies over the whole corpus give their IDF. A file's licence words
vote, highest IDF first, for each pair of posting and place, for the relative
position (place of the template's first word), with their IDF. A template's vote
ends when the file's words left for it weigh less than `Config.min_score` of it,
so every position that can score as much has votes; a position is a candidate if
its votes and the words left reach that score. It counts as a hit if all mandatory
key phrases of the template stand near their aligned places. The score of a hit is
the IDF-weighted share of template words found at their relative places.

Beside the templates, fixed base phrases are located in every text.

Defined results: null and empty texts have no words, no places, empty label
strings and score 0. Repeated rows are scanned row by row; extra columns are
ignored; an empty table gives no rows. A phrase found at several places counts
once for each; of positions with equal scores the first is the hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import alnum_words, record_batch

#: Base phrases and their labels (fixed values).
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as they stand in files, with the phrases that must be present (fixed values).
TEMPLATES = {
    "mit": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction",
        ["permission is hereby granted", "without restriction"],
    ),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license", "version 2"]),
    "apache-notice": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        ["compliance with the license", "apache org licenses"],
    ),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    "lgpl": ("licensed under the gnu lesser general public license", ["lesser general public license"]),
    "agpl": ("licensed under the gnu affero general public license", ["affero general public license"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["redistribution and use", "conditions are met"],
    ),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "is hereby granted"],
    ),
    "proprietary": ("all rights reserved", ["all rights reserved"]),
}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, n_hits long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_hits", pa.int64())]
)


@dataclass(frozen=True)
class Config:
    slack: int = 2  # words by which a key phrase may be off its aligned place
    min_score: float = 0.6  # IDF-weighted share of words at their places


@dataclass(frozen=True)
class Index:
    words: list[list[bytes]]  # by template
    labels: list[str]
    weights: list[np.ndarray]  # IDF by template position
    places: dict[bytes, list[tuple[int, int]]]  # licence word, highest IDF first -> (template, position)
    totals: list[float]  # weight by template
    phrases: list[list[tuple[int, list[bytes]]]]  # by template: (position, words)


def vocabulary(templates: dict[str, tuple[str, list[str]]]) -> frozenset[bytes]:
    return frozenset(w for text, _ in templates.values() for w in alnum_words(text))


def document_frequencies(documents: DataFrame, templates: dict[str, tuple[str, list[str]]]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and for each licence word that of documents with it.
    Counts are summed in each task before the shuffle; the result has one row a
    licence word, so its size is that of the templates."""
    vocab = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                found.update(vocab.intersection(alnum_words(text)))
        found[b""] = n
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})

    rows = documents.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def build_index(n_docs: int, df: dict[bytes, int], templates: dict[str, tuple[str, list[str]]]) -> Index:
    idf = {w: float(np.log((n_docs + 1) / (df.get(w, 0) + 0.5))) for w in vocabulary(templates)}
    words, labels, weights, phrases = [], [], [], []
    places: dict[bytes, list[tuple[int, int]]] = {w: [] for w in sorted(idf, key=lambda w: (-idf[w], w))}
    for label, (text, keys) in templates.items():
        t = alnum_words(text)
        for i, w in enumerate(t):
            places[w].append((len(words), i))
        at = []
        for key in keys:
            k = alnum_words(key)
            at.append((next(i for i in range(len(t)) if t[i : i + len(k)] == k), k))
        words.append(t)
        labels.append(label)
        weights.append(np.maximum([idf[w] for w in t], 1e-6))
        phrases.append(at)
    return Index(words, labels, weights, places, [float(w.sum()) for w in weights], phrases)


def starts(tokens: list[bytes], joined: bytes, phrase: list[bytes]) -> list[int]:
    """Word places where the phrase's words stand consecutively."""
    needle = b" " + b" ".join(phrase) + b" "
    found, at, seen, words = [], joined.find(needle), 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        found.append(words)
        at = joined.find(needle, at + 1)
    return found


def hits(tokens: list[bytes], index: Index, cfg: Config) -> list[tuple[int, int, float]]:
    """(template, place of its first word, score) of every verified candidate."""
    present = index.places.keys() & set(tokens)
    if not present:
        return []
    left = [0.0] * len(index.words)  # weight of the template's words that are in the file and have not voted
    for w in present:
        for template, position in index.places[w]:
            left[template] += index.weights[template][position]
    least = [cfg.min_score * total - 1e-9 * total for total in index.totals]
    if not any(x >= y for x, y in zip(left, least)):
        return []
    voting: dict[bytes, list[tuple[int, int, float]]] = {}
    for w in index.places:
        if w in present and (of := [(t, i, float(index.weights[t][i])) for t, i in index.places[w] if left[t] >= least[t]]):
            voting[w] = of
            for template, _, weight in of:
                left[template] -= weight
    votes: dict[tuple[int, int], float] = {}
    for place, w in enumerate(tokens):
        for template, position, weight in voting.get(w, ()):
            at = (template, place - position)
            votes[at] = votes.get(at, 0.0) + weight
    found = []
    for (template, start), n in votes.items():
        if n + left[template] < least[template]:
            continue
        for position, phrase in index.phrases[template]:
            near = range(max(0, start + position - cfg.slack), start + position + cfg.slack + 1)
            if not any(tokens[p : p + len(phrase)] == phrase for p in near):
                break
        else:
            t, w = index.words[template], index.weights[template]
            same = [0 <= start + i < len(tokens) and tokens[start + i] == x for i, x in enumerate(t)]
            score = float(w[same].sum() / w.sum())
            if score >= cfg.min_score:
                found.append((template, start, min(1.0, score)))
    return found


def scan_text(text: str | None, index: Index, cfg: Config) -> tuple:
    tokens = alnum_words(text)
    places, labels = [], set()
    if b"license" in tokens:
        joined = b" " + b" ".join(tokens) + b" "
        for phrase, label in BASE_PHRASES.items():
            if at := starts(tokens, joined, phrase.encode().split()):
                places += at
                labels.add(label)
    found = hits(tokens, index, cfg)
    score = max([1.0 if labels else 0.0, *(s for _, _, s in found)])
    both = labels | {index.labels[t] for t, _, _ in found}
    return (
        len(tokens), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(both)), score, len(found),
    )


def license_scan(documents: DataFrame, templates: dict[str, tuple[str, list[str]]] = TEMPLATES, cfg: Config = Config()) -> DataFrame:
    """Base places and labels, template labels and score of every document."""
    index = build_index(*document_frequencies(documents, templates), templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(scan_text(t, index, cfg) for t in batch.column("text").to_pylist()))) or [()] * 8
            yield record_batch(dict(zip(_ARROW.names, [batch.column("doc_id"), *map(list, columns)])), _ARROW)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
