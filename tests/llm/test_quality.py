"""Quality rules, quality classifier and license scans against plain Python."""

import re
import zlib
from collections import Counter

import pytest

from revlens.llm import license_scan, quality_ranker, quality_rules
from revlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_op1_base_and_verdict(spark, sf_dir, corpus):
    got = QUERIES["op1_quality_rules"](spark, sf_dir).collect()
    want = Counter((r[0], *plain_base(r[1])) for r in corpus)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) for g in got) == want
    assert all(0 <= g.probability <= 1 and not (g.base_failed and g.kept) for g in got)
    assert all(g.kept for g in got if g.doc_id and g.doc_id < 60)


def test_base_counts_of_odd_texts():
    for text in ["a b c a b c", "a\n\na\r\na\n \n", "é|é 𝒳 $", "x " * 7, "\x1c\x85 a", "a b c"]:
        tokens = text.encode().split()
        ids, distinct = quality_rules.word_ids(tokens)
        got = quality_rules.base_counts(text, tokens, ids, len(distinct), quality_rules.code_points(text))
        assert got == plain_base(text)[:5], text


def test_op1_without_rows_or_labels(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.train(documents, none) is None
    got = quality_rules.quality_rules(documents, None).collect()
    assert len(got) == documents.count() and all(g.kept != g.base_failed for g in got)
    assert quality_rules.quality_rules(no_documents, None).count() == 0


def test_calibration_keeps_order_and_range():
    import numpy as np

    logits = np.linspace(-3, 3, 200)
    slope, offset = quality_rules.fit_platt(logits, (logits > -1).astype(float))
    assert slope > 0 and 0.3 < 1 / (1 + np.exp(-(slope * -1 + offset))) < 0.7


def test_ranker_learns_and_holds_out(spark):
    from llm_data import labelled

    docs, labels = labelled(spark)
    ranker = quality_ranker.train(docs, labels)
    got = {r.doc_id: r for r in quality_ranker.classify(docs, ranker).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out == (i in held) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    model = quality_rules.train(docs, labels)
    kept = {r.doc_id: r.probability >= 0.5 for r in quality_rules.quality_rules(docs, model).collect()}
    assert sum(kept[i] == bool(truth[i]) for i in held) >= 0.95 * len(held)


def test_classifier_edges(spark, sf_dir, corpus, documents, no_documents):
    got = QUERIES["op3_quality_classifier"](spark, sf_dir).collect()
    assert len(got) == len(corpus) and all(g.predicted == int(g.score >= 0.3) for g in got)
    assert quality_ranker.train(documents, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert {r.score for r in quality_ranker.classify(documents, None).collect()} == {1.0}
    assert quality_ranker.classify(no_documents, None).count() == 0
    assert quality_ranker.accepted(documents, None).columns == documents.columns


LICENSED = [
    "Released under the MIT License.",
    "x (Apache-License) and MIT LICENSE mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "licensed under cc by-nc 4.0 all rights reserved",
    "mit licenses general public apache",
    "plain words only",
    "mit\x00license mit-license é" + " w" * 3000 + " apache license",
    "",
    None,
]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(LICENSED)], "doc_id long, text string, labels string").repartition(2)
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(LICENSED):
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == plain_scan(t)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    assert got[2].labels == "gpl,gpl-3.0" and got[3].labels == "cc-by-nc-4.0,proprietary"
    assert got[4].labels == "" and got[5].score == 0 and got[8].labels == ""


def test_license_hits_equal_plain_search():
    """Every exact occurrence of a template is found, by whatever anchors."""
    index = license_scan.build_index(10, {}, license_scan.TEMPLATES)
    for k, (text, _) in enumerate(license_scan.TEMPLATES.values()):
        tokens = license_scan.alnum_words("intro words " + text + " then " + text)
        found = {(t, s) for t, s, score in license_scan.hits(tokens, index, license_scan.Config()) if score > 0.999}
        assert {(k, 2), (k, 3 + len(license_scan.alnum_words(text)))} <= found


def test_sample_of_the_rules_is_whole(spark):
    """The documented bounds are reached, and 32-bit rows fit as 64-bit copies do."""
    import numpy as np

    rows = [(i, f"w{i} words of a text {i % 7}", i % 2) for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    sample = quality_rules.labelled_sample(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), quality_rules.Config()).collect()
    assert Counter((r.for_fit, r.label if r.for_fit else None) for r in sample) == {(True, 0): 1500, (True, 1): 1500, (False, None): 1500}
    made = [quality_rules.features(r.text, 12) for r in sample[:300]]
    y = np.array([r.label for r in sample[:300]], float)
    cfg = quality_rules.Config(bits=12, epochs=2)
    small = [(i.astype(np.int32), v.astype(np.float32)) for i, v in made]
    large = [(i.astype(np.int64), v.astype(float)) for i, v in small]
    a, b = quality_rules.fit_logistic(small, y, cfg), quality_rules.fit_logistic(large, y, cfg)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1] and a[0].any()


def plain_hits(tokens, index, cfg):
    found = {}
    for k, (t, w) in enumerate(zip(index.words, index.weights)):
        for start in range(-len(t), len(tokens)):
            near = lambda p: range(max(0, start + p - cfg.slack), start + p + cfg.slack + 1)  # noqa: E731, B023
            if all(any(tokens[a : a + len(x)] == x for a in near(p)) for p, x in index.phrases[k]):
                score = sum(w[i] for i, x in enumerate(t) if 0 <= start + i < len(tokens) and tokens[start + i] == x) / w.sum()
                if score >= cfg.min_score:
                    found[k, start] = score
    return found


def test_reworded_notices_are_found(spark):
    """Hits equal a full search whichever words were changed, rare ones too."""
    import random

    rng, cfg = random.Random(3), license_scan.Config()
    df = {w: rng.choice((1, 5, 40, 95)) for w in sorted(license_scan.vocabulary(license_scan.TEMPLATES))}
    index = license_scan.build_index(100, df, license_scan.TEMPLATES)
    n_hits = 0
    for text, keys in license_scan.TEMPLATES.values():
        t = license_scan.alnum_words(text)
        for share in (0.0, 0.15, 0.3, 0.45):
            tokens = [b"and", *(b"other" if rng.random() < share else w for w in t), b"of", *rng.sample(t, len(t)), *(b"other" if rng.random() < share else w for w in t)]
            got = license_scan.hits(tokens, index, cfg)
            want = plain_hits(tokens, index, cfg)
            assert {(k, s) for k, s, _ in got} == want.keys() and len(got) == len(want) and all(abs(want[k, s] - x) < 1e-9 for k, s, x in got)
            n_hits += len(want)
    assert n_hits > 50
    notice = license_scan.TEMPLATES["mit-text"][0]
    for old, new in ((" a ", " one "), (" any ", " each "), (" associated ", " related ")):  # three of the four words first by IDF and name
        notice = notice.replace(old, new)
    assert [index.labels[k] for k, *_ in license_scan.hits(license_scan.alnum_words(notice), license_scan.build_index(10, {}, license_scan.TEMPLATES), cfg)] == ["mit-text"]
    (r,) = license_scan.license_scan(spark.createDataFrame([(1, "x " + notice)], "doc_id long, text string")).collect()
    assert r.labels == "mit-text" and r.n_hits == 1


@pytest.mark.parametrize("name", ["op2_license_scan"])
def test_scan_whole_table(spark, sf_dir, corpus, no_documents, name):
    got = QUERIES[name](spark, sf_dir).collect()
    assert Counter((g.doc_id, g.n_words) for g in got) == Counter((r[0], plain_scan(r[1])[0]) for r in corpus)
    assert license_scan.license_scan(no_documents).count() == 0
