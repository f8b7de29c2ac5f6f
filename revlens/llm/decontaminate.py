"""Benchmark decontamination with BM25 and block-max WAND.

Test items are cut into chunks of at most `Config.chunk` words, which are the
documents of an inverted index; BM25 statistics are computed by Spark over all
items. Every training passage (a window of `2 * chunk` words, every `chunk`
words, so that each run of `chunk` words lies whole in one window) is a query.
A chunk's impacts are divided by its own score, so a passage that holds all of
the chunk's words scores 1; every chunk at or above `Config.min_score` is
retrieved. Postings are cut into blocks of chunks with the maximal impact of
each word. A passage is dropped if its words' maxima over each run
of blocks cannot reach the threshold (for all windows of a text at once), visits
a block only if the block's maxima can, and inside it a WAND pivot skips the
chunks that cannot.

Every retrieved passage of an item is verified against the text around it, the
best-scoring first, until one passes: at least `Config.min_overlap` of the word
3-grams of its question (all but the last quarter of its words) and of its
answer (the last quarter, with the two words before it) must occur there. Words
are alphanumeric runs in lower case.

The index lies in the shared folder, in groups of about `Config.group_chunks`
chunks. The documents are read once; a worker holds one group's index at a time
and takes a batch of texts through all groups, so memory does not grow with the
benchmark (an item's own words stay together for the verification). A word's
maxima are stored for the blocks it occurs in only.

Defined results: null or empty texts and items give no pair; items that repeat
give a pair each; a repeated document row gives one pair per (doc_id, item_id),
and rows without doc_id together likewise; extra columns are ignored; an empty
benchmark gives an empty result. `clean` judges every row by itself.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import alnum_words
from revlens.session import materialize, scratch_path

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"


@dataclass(frozen=True)
class Config:
    chunk: int = 32  # words of an indexed chunk at most
    k1: float = 1.2
    b: float = 0.75
    min_score: float = 0.7  # BM25 score, as a share of the chunk's own
    min_overlap: float = 0.5
    gram: int = 3
    block: int = 16  # chunks of a posting block
    group_chunks: int = 8192  # chunks of one broadcast index


@dataclass(frozen=True)
class Index:
    terms: dict[bytes, int]
    starts: np.ndarray  # of each term's run in the next two arrays
    blocks: np.ndarray
    maxima: np.ndarray  # the term's maximal impact in that block
    coarse_max: np.ndarray  # terms + 1 x runs of blocks, 16 runs at most; the last row, for unknown words, is 0
    block_max: list[dict[int, float]]  # the maxima by block and term
    postings: list[dict[int, tuple[list[int], list[float]]]]  # by block and term: chunk numbers, impacts
    items: list[str]  # item key by chunk
    texts: dict[str, list[bytes]]  # words by item key
    item_ids: dict[str, int | None]  # by item key

    def reach(self, query: np.ndarray) -> np.ndarray:
        """For every block the sum of the terms' maxima."""
        at = np.concatenate([np.arange(self.starts[t], self.starts[t + 1]) for t in query])
        return np.bincount(self.blocks[at], self.maxima[at], len(self.block_max))


def item_words(text: str | None) -> list[bytes]:
    return alnum_words((text or "").lower())


def cut(tokens: list[bytes], most: int) -> list[list[bytes]]:
    """Near-equal runs of at most `most` words."""
    n = -(-len(tokens) // most)
    return [tokens[len(tokens) * k // n : len(tokens) * (k + 1) // n] for k in range(n)]


def chunk_postings(benchmark: DataFrame, cfg: Config) -> DataFrame:
    """item row, chunk, word, tf, chunk length, BM25 impact as a share of the chunk's own score."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for k, part in enumerate(cut(item_words(text), cfg.chunk)):
                    rows += [(key, k, w, part.count(w), len(part)) for w in sorted(set(part))]
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "chunk", "word", "tf", "len"])

    posts = benchmark.select("key", "text").mapInArrow(split, "key string, chunk int, word binary, tf int, len int")
    size = posts.select("key", "chunk", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("mean")).first()
    df = posts.groupBy("word").agg(F.count("*").alias("df"))
    n, mean = size["n"], size["mean"] or 1.0
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("len") / mean))
    impact = posts.join(df, "word").withColumn("impact", idf * tf)
    own = impact.groupBy("key", "chunk").agg(F.sum("impact").alias("own"))
    return impact.join(own, ["key", "chunk"]).select("key", "chunk", "word", "len", (F.col("impact") / F.col("own")).alias("impact"))


def build_index(rows: list[tuple], items: dict[str, tuple[int | None, list[bytes]]], cfg: Config) -> Index:
    """rows: (key, chunk, word, length, impact). Chunks are numbered by rising
    length, so that a block's chunks have impacts of a like size."""
    numbers = {c: i for i, c in enumerate(sorted({(r[3], r[0], r[1]) for r in rows}))}
    terms: dict[bytes, int] = {}
    n_blocks = -(-len(numbers) // cfg.block)
    grouped: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(n_blocks)]
    for key, chunk, word, length, impact in rows:
        t, c = terms.setdefault(word, len(terms)), numbers[length, key, chunk]
        grouped[c // cfg.block].setdefault(t, []).append((c, impact))
    runs = np.unique(np.linspace(0, n_blocks - 1, 16).astype(int))
    coarse = np.zeros((len(terms) + 1, len(runs)), np.float32)
    postings, block_max, own = [], [], []
    for b, by_term in enumerate(grouped):
        held, top = {}, {}
        run = int(np.searchsorted(runs, b, side="right")) - 1
        for t, posts in by_term.items():
            posts.sort()
            held[t] = ([c for c, _ in posts], [x for _, x in posts])
            top[t] = float(np.nextafter(np.float32(max(held[t][1])), np.float32(2)))
            coarse[t, run] = max(coarse[t, run], top[t])
            own.append((t, b, top[t]))
        postings.append(held)
        block_max.append(top)
    own.sort()
    starts = np.searchsorted([t for t, _, _ in own], np.arange(len(terms) + 2))
    keys = [key for _, key, _ in numbers]
    blocks, maxima = np.array([b for _, b, _ in own], np.int64), np.array([x for _, _, x in own], np.float32)
    return Index(terms, starts, blocks, maxima, coarse, block_max, postings, keys, {k: items[k][1] for k in set(keys)}, {k: items[k][0] for k in set(keys)})


def wand(terms: list[int], postings: dict, maxima: Mapping[int, float] | np.ndarray, least: float) -> list[tuple[int, float]]:
    """Chunks of one block whose impacts over the query's distinct terms sum to
    `least` or more. Lists are kept by current chunk; the pivot is the first
    list at which the maxima so far can reach the threshold."""
    lists = [[postings[t][0][0], 0, postings[t][0], postings[t][1], float(maxima[t])] for t in terms if t in postings]
    found = []
    while lists:
        lists.sort(key=lambda x: x[0])
        bound, pivot = 0.0, -1
        for k, x in enumerate(lists):
            bound += x[4]
            if bound >= least:
                pivot = k
                break
        if pivot < 0:
            break
        chunk = lists[pivot][0]
        if lists[0][0] == chunk:
            score = 0.0
            for x in lists:
                if x[0] != chunk:
                    break
                score += x[3][x[1]]
                x[1] += 1
            if score >= least:
                found.append((chunk, score))
        else:
            for x in lists[:pivot]:
                while x[1] < len(x[2]) and x[2][x[1]] < chunk:
                    x[1] += 1
        for x in lists:
            x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
        lists = [x for x in lists if x[0] >= 0]
    return found


def grams(tokens: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = max(1, min(n, len(tokens)))
    return set(zip(*(tokens[k:] for k in range(n))))


def overlaps(item: list[bytes], near: list[bytes], n: int) -> tuple[float, float]:
    """Shares of the question's and the answer's word n-grams found in `near`."""
    split = len(item) - max(1, len(item) // 4)
    shares = []
    for part in (item[:split] or item, item[max(0, split - n + 1) :]):
        want = grams(part, n)
        size = len(next(iter(want)))
        shares.append(len(want & set(zip(*(near[k:] for k in range(size))))) / len(want))
    return shares[0], shares[1]


def passages(steps: np.ndarray, terms: np.ndarray, n_terms: int, index: Index, cfg: Config) -> Iterator[tuple[int, np.ndarray]]:
    """(window, distinct terms) of the windows whose terms' maxima reach the
    threshold in some group of blocks. Window w is made of steps w and w + 1."""
    for low in range(0, len(terms), 1 << 16):  # keeps the arrays small on very long texts
        high = low + (1 << 16)
        if low:  # a window that is cut here is taken up whole by the next part
            low = int(np.searchsorted(steps, steps[low] - 1))
        s, t = steps[low:high], terms[low:high]
        keys = np.sort(np.concatenate([s * n_terms + t, s[s > 0] * n_terms - n_terms + t[s > 0]]))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        windows, query = keys // n_terms, keys % n_terms
        first = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
        reach = np.add.reduceat(index.coarse_max[query], first, axis=0).max(axis=1)
        ends = np.append(first[1:], len(keys))
        for k in np.flatnonzero(reach >= cfg.min_score):
            yield int(windows[first[k]]), query[first[k] : ends[k]]


def match_text(text: str | None, index: Index, cfg: Config) -> dict[str, tuple[float, float, float, int]]:
    """Verified items (by key) of one text: score, overlaps, start of the best
    passage that passes; all retrieved ones are verified until one does."""
    tokens = item_words(text)
    if not tokens:
        return {}
    unknown = len(index.terms)
    get = index.terms.get
    ids = np.array([get(w, unknown) for w in tokens], np.int64)
    places = np.flatnonzero(ids != unknown)
    retrieved: dict[str, dict[int, float]] = {}  # score by item key and start
    for window, query in passages(places // cfg.chunk, ids[places], unknown, index, cfg):
        start = window * cfg.chunk
        for b in np.flatnonzero(index.reach(query) >= cfg.min_score):
            for chunk, score in wand(query.tolist(), index.postings[b], index.block_max[b], cfg.min_score - 1e-9):
                at = retrieved.setdefault(index.items[chunk], {})
                at[start] = max(score, at.get(start, 0.0))
    found = {}
    for key, at in retrieved.items():
        item = index.texts[key]
        for start, score in sorted(at.items(), key=lambda x: (-x[1], x[0])):
            q, a = overlaps(item, tokens[max(0, start - len(item)) : start + 2 * cfg.chunk + len(item)], cfg.gram)
            if q >= cfg.min_overlap and a >= cfg.min_overlap:
                found[key] = (score, q, a, start)
                break
    return found


def indexes(benchmark: DataFrame, cfg: Config) -> Iterator[Index]:
    """Bounded indexes that cover the whole benchmark, one at a time. Items are
    dealt to groups by hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0)
    items = items.withColumn("key", F.md5(F.concat_ws("\x1f", F.col("item_id").cast("string"), "text")))
    items = items.groupBy("key").agg(F.min("item_id").alias("item_id"), F.min("text").alias("text"))
    chunks = items.agg(F.sum(F.ceil(F.regexp_count("text", F.lit(r"\S+")) * 2 / cfg.chunk) + 1).alias("n")).first()["n"] or 0
    groups = -(-int(chunks) // cfg.group_chunks)
    posts = chunk_postings(items, cfg) if groups else None
    if groups > 1:  # each group reads them
        items, posts = materialize(items, "items"), materialize(posts, "postings")
    for g in range(groups):
        mine = F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(groups)) == g
        held = {r["key"]: (r["item_id"], item_words(r["text"])) for r in items.where(mine).collect()}
        rows = [(r["key"], r["chunk"], bytes(r["word"]), r["len"], r["impact"]) for r in posts.where(mine).collect()]
        if rows:
            yield build_index(rows, held, cfg)


@dataclass(frozen=True)
class Stored:
    """The indexes of a benchmark in the shared folder."""

    folder: str
    groups: int

    def __iter__(self) -> Iterator[Index]:
        return (_load(self.folder, g) for g in range(self.groups))


def store(benchmark: DataFrame, cfg: Config) -> Stored:
    """Writes the indexes one after the other; the driver holds one of them."""
    from pyarrow.fs import FileSystem

    folder, n = scratch_path(benchmark.sparkSession, "benchmark-index"), 0
    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base)
    for n, index in enumerate(indexes(benchmark, cfg), 1):
        with fs.open_output_stream(f"{base}/{n - 1}") as out:
            pickle.dump(index, out, pickle.HIGHEST_PROTOCOL)
    return Stored(folder, n)


@lru_cache(1)
def _load(folder: str, group: int) -> Index:
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{base}/{group}") as f:
        return pickle.loads(f.read())


def leaks(documents: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each document and test item that it holds."""
    stored = store(benchmark, cfg)
    if not stored.groups:
        return documents.sparkSession.createDataFrame([], SCHEMA)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = [
                (doc_id, index.item_ids[key], *hit)
                for index in stored
                for doc_id, text in zip(ids, texts)
                for key, hit in match_text(text, index, cfg).items()
            ]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap", "passage_start"), F.struct("score", -F.col("passage_start"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(documents: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The documents without a verified test item, with all their columns. Each
    row is judged by its own text, in the pass that reads it; no shuffle."""
    stored = store(benchmark, cfg)
    if not stored.groups:
        return documents

    @F.pandas_udf("boolean")
    def holds_none(texts: pd.Series) -> pd.Series:
        none = pd.Series(True, index=texts.index)
        for index in stored:
            none &= texts.map(lambda t: not match_text(t, index, cfg))  # noqa: B023 - used at once
        return none

    return documents.where(holds_none(F.coalesce(F.col("text"), F.lit(""))))
