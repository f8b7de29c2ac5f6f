"""Decontamination, archives and URL lists on cases with known answers."""

import datetime as dt
import hashlib

import pytest
from llm_data import prose
from pyspark.sql import functions as F

from revlens.llm import decontaminate, url_lists, warc
from revlens.llm.queries import QUERIES


# --- decontamination ---------------------------------------------------------
def leak_case(spark):
    items = [(k, prose(500 + k, n)) for k, n in enumerate((12, 30, 45, 70, 200))] + [(9, None), (10, ""), (2, prose(502, 45))]
    docs, truth = [], set()
    for i in range(60):
        body = prose(2000 + i, 150).split()
        if i % 3 == 0:
            k = i // 3 % 5
            body[37 + i : 37 + i] = (items[k][1] or "").upper().split() if i % 2 else (items[k][1] or "").split()
            truth.add((i, items[k][0]))
        docs.append((i, " ".join(body), i))
    half = items[4][1].split()
    docs += [(100, " ".join(prose(2100, 100).split() + half[:60]), 0), (101, None, 0), (102, "", 0), (103, items[1][1] + " x " + items[3][1], 0), (103, docs[0][1], 0)]
    truth |= {(103, 1), (103, 3), (103, 0)}
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id long").repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string"), truth


def test_leaks(spark):
    docs, items, truth = leak_case(spark)
    got = decontaminate.leaks(docs, items).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == truth and len(got) == len(pairs)
    assert all(r.score >= 0.7 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in got)
    small = decontaminate.leaks(docs, items, decontaminate.Config(group_chunks=4, block=2))
    assert {(r.doc_id, r.item_id) for r in small.collect()} == truth
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {i for i, _ in truth}


def test_copy_after_a_better_scoring_quote(spark):
    item = prose(800, 64).split()
    quote = item[:32]  # one whole chunk: score 1, nothing of the answer
    edited = [f"edited{i}" if i % 12 == 5 else w for i, w in enumerate(item)]
    texts = [quote, [*quote, *prose(801, 400).split(), *item], [*quote, *prose(802, 400).split(), *edited], edited, [*edited, *prose(803, 400).split(), *quote]]
    docs = spark.createDataFrame([(i, " ".join([*prose(810 + i, 100).split(), *t, *prose(820 + i, 100).split()])) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, prose(830, 40))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, items).collect()}
    assert got.keys() == {1, 2, 3, 4} and {r.item_id for r in got.values()} == {1}
    assert got[1].score > 0.99 and got[1].passage_start >= 400 and 0.7 <= got[2].score < 0.99 and got[2].passage_start >= 400 and got[4].passage_start < 200
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [0]


def test_wand_equals_full_scoring():
    import numpy as np

    rng = np.random.default_rng(1)
    postings = {t: sorted((int(c), float(x)) for c, x in zip(rng.choice(40, 12, replace=False), rng.random(12))) for t in range(30)}
    lists = {t: ([c for c, _ in p], [x for _, x in p]) for t, p in postings.items()}
    maxima = np.array([max(lists[t][1]) for t in range(30)])
    for _ in range(50):
        query = rng.choice(35, 8, replace=False).tolist()
        full = {}
        for t in query:
            for c, x in postings.get(t, ()):
                full[c] = full.get(c, 0) + x
        got = dict(decontaminate.wand(query, lists, maxima, 1.5))
        assert got.keys() == {c for c, x in full.items() if x >= 1.5} and all(abs(got[c] - full[c]) < 1e-9 for c in got)


def plain_leaks(docs, items, cfg):
    """Every window of every text scored against every chunk by BM25, then verified."""
    import math
    from collections import defaultdict

    chunks = [(i, c) for i, t in items for c in decontaminate.cut(decontaminate.item_words(t), cfg.chunk) if c]
    mean = sum(len(c) for _, c in chunks) / len(chunks)
    holders = defaultdict(int)
    for _, c in chunks:
        for w in set(c):
            holders[w] += 1

    def impact(w, c):
        tf = c.count(w)
        return math.log(1 + (len(chunks) - holders[w] + 0.5) / (holders[w] + 0.5)) * tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * len(c) / mean))

    weights = [(i, {w: impact(w, c) for w in set(c)}) for i, c in chunks]
    own = [sum(w.values()) for _, w in weights]
    words = {i: decontaminate.item_words(t) for i, t in items}
    out = {}
    for d, text in docs:
        tokens = decontaminate.item_words(text)
        for start in range(0, len(tokens), cfg.chunk):
            here = set(tokens[start : start + 2 * cfg.chunk])
            for (i, w), total in zip(weights, own, strict=True):
                score = sum(x for k, x in w.items() if k in here) / total
                if score >= cfg.min_score - 1e-9:
                    item = words[i]
                    q, a = decontaminate.overlaps(item, tokens[max(0, start - len(item)) : start + 2 * cfg.chunk + len(item)], cfg.gram)
                    if q >= cfg.min_overlap and a >= cfg.min_overlap and score > out.get((d, i), (0,))[0] + 1e-9:
                        out[d, i] = (score, q, a, start)
    return out


@pytest.mark.parametrize("cfg", [decontaminate.Config(), decontaminate.Config(chunk=8, min_score=0.5, block=3, group_chunks=20)])
def test_leaks_equal_plain_bm25(spark, cfg):
    import random

    r = random.Random(4)
    items = [(k, prose(600 + k, r.randint(3, 90))) for k in range(25)]
    docs = []
    for i in range(80):
        body = prose(2500 + i, r.randint(5, 300)).split()
        for _ in range(r.randint(0, 3)):
            w = items[r.randrange(25)][1].split()
            a = r.randrange(len(w))
            part = [x if r.random() > 0.07 else "edit" for x in w[a // 4 :]]
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, " ".join(body)))
    want = plain_leaks(docs, items, cfg)
    assert len(want) > 20
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), cfg)
    got = {(x.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap, x.passage_start) for x in found.collect()}
    assert got.keys() == want.keys(), ([(k, want[k]) for k in want.keys() - got.keys()][:4], [(k, got[k]) for k in got.keys() - want.keys()][:4], len(want), len(got))
    for k, v in got.items():
        assert abs(v[0] - want[k][0]) < 1e-6 and min(v[1:3]) >= cfg.min_overlap, k  # passages of equal score may differ


def test_long_text_and_empty_benchmark(spark, documents, no_documents):
    items = spark.createDataFrame([(1, prose(700, 40))], "item_id long, text string")
    text = " ".join([prose(701, 80_000), prose(700, 40), prose(702, 80_000), prose(700, 40)])
    long_doc = spark.createDataFrame([(5, text)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(long_doc, items).collect()] == [(5, 1)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(documents, none).count() == 0 and decontaminate.clean(documents, none).count() == documents.count()
    assert decontaminate.leaks(no_documents, items).count() == 0


def test_leak_query(spark, sf_dir):
    assert {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, sf_dir).collect()} == {(2, 4)}


# --- archives -----------------------------------------------------------------
def test_archives_hold_standard_records(spark, tmp_path):
    import gzip

    html = "<p>" + "y" * 1500
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, html), (3, "http://b/\r\nX: y", "é"), (3, "http://b/", None)], "page_id long, url string, html string")
    index = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w", warc.Config(archive_bytes=400))
    assert index.select("archive").distinct().count() > 1
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w/archives").iterdir())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == 4 and raw.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To: <urn:x-page:2>" in raw and raw.count(html.encode()) == 1 and b"b/%0D%0AX: y\r\n" in raw
    got = warc.read_records(index, f"file://{tmp_path}/w").collect()
    assert {(r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in got} == {(1, "revisit", 1503, 2), (2, "response", 1503, None), (3, "response", 2, None), (3, "response", 0, None)}
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    one = warc.read_records(index.where("page_id = 3"), f"file://{tmp_path}/w", warc.Config(gap_bytes=0, range_bytes=1)).collect()
    assert sorted(r.payload_bytes for r in one) == [0, 2]


def test_damaged_record_is_noticed():
    raw = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, warc.Config())
    assert warc.parse_record(raw)[:3] == (1, "u", 3)
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_and_read(none).count() == 0


# --- URL lists ------------------------------------------------------------------
DAY = dt.date(2024, 1, 1)


def test_entries_active_at_fetch_time(spark):
    on = lambda n: DAY + dt.timedelta(n)
    entries = [
        ("block", "Bad.com", on(10), "add"), ("block", "bad.com", on(20), "remove"), ("block", "bad.com", on(30), "add"),
        ("block", "bad.com", on(32), "add"), ("allow", "ok.bad.com", on(12), "add"), ("allow", "bad.com", on(31), "add"),
        ("block", "tie.org", on(5), "add"), ("block", "tie.org", on(5), "remove"), ("block", None, on(1), "add"),
        ("block", "x.net", None, "add"), ("block", "x.net", on(1), "enable"), ("block", "late.org", on(400), "remove"),
    ]
    e = spark.createDataFrame([(*x, 1) for x in entries], "list string, pattern string, day date, action string, page_id long")
    cases = [
        (1, "http://bad.com/", 9, False, None, 0), (2, "http://BAD.com:8/", 10, True, "bad.com", 1), (3, "http://a.bad.com", 19, True, "bad.com", 1),
        (4, "http://bad.com/", 20, False, None, 0), (5, "https://u:p@bad.com./", 30, True, "bad.com", 1), (6, "http://bad.com/", 31, False, "bad.com", 2),
        (7, "http://q.ok.bad.com/", 13, False, "ok.bad.com", 2), (8, "http://notbad.com/", 15, False, None, 0), (9, "http://tie.org/", 5, False, None, 0),
        (10, "http://x.net/", 8, False, None, 0), (11, None, 15, False, None, 0), (12, "bad.com", 15, False, None, 0), (13, "http://bad.com/", None, False, None, 0),
        (2, "http://BAD.com:8/", 10, True, "bad.com", 1),
    ]
    captures = spark.createDataFrame([(i, u, None if n is None else on(n), "z") for i, u, n, *_ in cases], "page_id long, url string, day date, list string")
    got = sorted((r.page_id, r.blocked, r.pattern or "", r.n_active) for r in url_lists.judge(captures, e).collect())
    assert got == sorted((i, b, p or "", n) for i, _, _, b, p, n in cases)
    spans = {(r.list, r.pattern, r.valid_from, r.valid_to) for r in url_lists.validity(e).collect()}
    assert spans == {("block", "bad.com", on(10), on(20)), ("block", "bad.com", on(30), None), ("allow", "ok.bad.com", on(12), None), ("allow", "bad.com", on(31), None)}


def test_no_entries_or_captures(spark):
    e = spark.createDataFrame([], "list string, pattern string, day date, action string")
    c = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string").withColumn("day", F.lit(DAY))
    assert [r.blocked for r in url_lists.judge(c, e).collect()] == [False]
    assert url_lists.judge(c.limit(0), e).count() == 0


def test_captures_of_large_page_ids(spark):
    ids = [0, 1, 366, 2**62, 2**63 - 1, -(2**63), None]
    got = {r.page_id: r.day for r in url_lists.dated_captures(spark.createDataFrame([(i, "http://a.b/") for i in ids], "page_id long, url string")).collect()}
    assert got == {i: None if i is None else dt.date(2024, 1, 1) + dt.timedelta(days=i * 37 % 366) for i in ids}
