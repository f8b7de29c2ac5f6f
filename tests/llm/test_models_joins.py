"""Language model, source mixing, near duplicates and the pipeline against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_data import labelled, prose
from pyspark.sql import functions as F

from revlens.llm import mixing, ngram_join, ppm
from revlens.llm.queries import QUERIES


def plain_ppm(texts, train, order):
    table = defaultdict(Counter)
    symbols = lambda t: [ppm.PAD] * order + list(t) + [ppm.END]
    for t in train:
        b = symbols(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                table[tuple(b[i - k : i])][b[i]] += 1
    for t in texts:
        b, total = symbols(t), 0.0
        for i in range(order, len(b)):
            excluded = set()
            for k in range(order, -1, -1):
                seen = table.get(tuple(b[i - k : i]))
                if seen is None:
                    continue
                left = {s: n for s, n in seen.items() if s not in excluded}
                size = sum(left.values()) + len(left)
                if b[i] in left:
                    total += math.log10(left[b[i]] / size)
                    break
                if left:
                    total += math.log10(len(left) / size)
                excluded = set(seen)
            else:
                total -= math.log10(ppm.SYMBOLS - len(excluded))
        yield total


@pytest.mark.parametrize("cfg", [ppm.Config(run_bytes=999), ppm.Config(order=2, slice_edges=60, frequent=40, held_words=50, held_bytes=5000), ppm.Config(order=5)])
def test_scores_equal_plain_model(spark, documents, corpus, cfg):
    low = lambda t: ppm.lowered(t)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    rows = [r for r in corpus if r[0] != 65]
    train = [low(r[1]) for r in rows if not held(r[0])]
    c = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(c.values()), len(c)
    want = []
    for r, s in zip(rows, plain_ppm([low(r[1]) for r in rows], train, cfg.order)):
        tokens = [*low(r[1]).split(), b""]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want.append((r[0] or -1, held(r[0]), len(tokens), sum(c[w] > 0 for w in tokens), n, base, s))
    got = ppm.score(documents.where("doc_id is null or doc_id != 65"), cfg).collect()
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and abs(g[6] - w[6]) < 1e-6


@pytest.mark.parametrize("order", [3, 5])
def test_slices_are_bounded_and_exact(spark, order):
    """A frequent context is cut between slices; bytes that the training texts
    lack, alone and after cut contexts, are scored as in the whole model."""
    import pyarrow.parquet as pq

    cfg = ppm.Config(order=order, slice_edges=150, held_bytes=3000)
    rows = [(i, prose(950 + i, 60) + (" Z~é\x01 a\x02b th\x03e" if zlib.crc32(str(i).encode()) % 10 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder, slices = ppm.train(docs, cfg)
    stored = [(i, pq.read_table(f"{folder.removeprefix('file:')}/slice={i}", partitioning=None)) for i in range(slices.n)]
    assert slices.n > 5 and 2 in slices.units and 1 in slices.whole
    assert all(t.num_rows <= 256 for _, t in stored)
    keys = [k for _, t in stored for k in t["key"].to_pylist()]
    train = [ppm.lowered(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len(keys) == len(set(keys)) and sum(sum(t["n"].to_pylist()) for _, t in stored) == sum(len(t) + 1 for t in train)
    want = dict(zip([i for i, _ in rows], plain_ppm([ppm.lowered(t) for _, t in rows], train, order)))
    got = {r.doc_id: r.score for r in ppm.score(docs, cfg).collect()}
    assert any("Z~" in t for _, t in rows) and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_lm_edges(spark, sf_dir, corpus, no_documents):
    got = QUERIES["op7_lm_scoring"](spark, sf_dir).collect()
    assert len(got) == len(corpus) and all(r.score < 0 and r.n_known <= r.n_tokens for r in got)
    assert ppm.score(no_documents).count() == 0
    alone = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    (r,) = ppm.score(alone).collect()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and abs(r.score + 4 * math.log10(255)) < 1e-9


# --- mixing ---------------------------------------------------------------------
def test_targets_are_level(spark):
    rows = [("a", 100), ("b", 1000), ("c", 10), ("d", 0), (None, 500), ("é", 40)]
    sizes = spark.createDataFrame([(s, n, 0) for s, n in rows], "source string, size long, target int")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    order = sorted((s for s, _ in rows if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    most = {s: 2 * n for s, n in rows}
    left, open_ = 1.5 * sum(n for _, n in rows), dict(weight)
    want = {}
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] >= most[s]]
        if not full:
            want |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = most[s]
            left -= most[s]
            del open_[s]
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_is_near_targets_and_repeats(spark, documents, corpus, no_documents):
    got = mixing.mix(documents, mixing.Config(slots=4, moments=64)).collect()
    assert len(got) == len(corpus) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source] = [by[r.source][0] + r.taken, r.target, max(by[r.source][2], r.size)]
    assert all(abs(t - want) <= 2 * most + 1 for t, want, most in by.values())
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    again = mixing.mix(documents.repartition(5), mixing.Config()).collect()
    key = lambda rows: sorted((r.doc_id or -1, r.source or "", r.size, r.taken) for r in rows)
    assert key(again) == key(got)
    out = mixing.mixed(documents)
    assert out.columns == documents.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +Counter({k: sum(r.taken // r.size for r in got if (r.doc_id, r.source) == k and r.size) for k in {(r.doc_id, r.source) for r in got}})
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0


# --- near duplicates ----------------------------------------------------------------
def near_case():
    rows, base = [], prose(300, 120).split()
    for i in range(90):  # one large group of near copies
        w = list(base)
        for k in range(i % 5):
            w[(i * 7 + k * 31) % 120] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(400 + i, 100)) for i in range(60)]
    rows += [(200 + i, prose(400 + i, 100).replace("an", "AN", i % 3)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "a b"), (303, "a b"), (304, "a c"), (5, rows[5][1]), (None, prose(402, 100)), (None, None), (305, prose(800, 12_000)), (306, prose(800, 12_000) + " end")]
    return rows


def plain_links(rows):
    def grams(t):
        w = (t or "").split()
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    links = [{j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b)} for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        for i, linked in enumerate(links):
            for j in linked:
                group[i] = group[j] = min(group[i], group[j])
    return links, group


@pytest.mark.parametrize("cfg", [ngram_join.Config(), ngram_join.Config(block=16)])
def test_links_and_classes_equal_plain_join(spark, cfg):
    rows = near_case()
    links, group = plain_links(rows)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, digest string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join_documents(docs, cfg).collect())
    ids = lambda g: [rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None]
    want = Counter((rows[i][0], min(ids(group[i]), default=None), len(links[i])) for i in range(len(rows)))
    missed = want - got
    assert sum(k[2] * n for k, n in got.items()) >= 0.99 * sum(k[2] * n for k, n in want.items())
    assert sum(missed.values()) <= 0.02 * len(rows)
    assert Counter(k[:2] for k in got.elements()) == Counter(k[:2] for k in want.elements())
    kept = ngram_join.deduplicated(docs, cfg)
    assert kept.columns == docs.columns and kept.count() == len({g if rows[g][1] else (rows[g][0], "") for g in group})


def test_blocks_are_bounded_by_bytes(spark):
    """A hot node of long texts is cut by its shingles' bytes, and still compared whole."""
    base = prose(970, 3000).split()
    rows = [(i, " ".join([*base[: 40 * i], f"edit{i}", *base[40 * i :]])) for i in range(60)] + [(100 + i, prose(980 + i, 50)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cfg = ngram_join.Config(block_bytes=200_000, count_bytes=30_000)
    signed = ngram_join.signatures(docs, cfg).cache()
    total = signed.agg(F.sum("n_bytes")).first()[0]
    assert total > 5 * cfg.block_bytes
    groups = ngram_join.trie_members(ngram_join.settled(signed, cfg), cfg).join(signed.select("digest", "n_bytes"), "digest").groupBy("g").agg(F.sum("n_bytes").alias("n_bytes"))
    assert groups.agg(F.max("n_bytes")).first()[0] < 4 * cfg.block_bytes  # two blocks, dealt by hash
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join_documents(docs, cfg).collect()}
    assert got == {**{i: (0, 59) for i in range(60)}, **{100 + i: (100 + i, 0) for i in range(20)}}


def test_shingles_are_counted_in_bounded_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, 40_000, np.uint64, endpoint=False)
    sets = [np.unique(rng.choice(pool, 20_000)) for _ in range(100)]
    i, j = (x[::25] for x in np.triu_indices(100, 1))
    tracemalloc.start()
    got = ngram_join.common_shingles(sets, i, j, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert peak < 2 * sum(s.nbytes for s in sets)


def test_prefixes_shorten_to_the_recall():
    cfg = ngram_join.Config()
    d = ngram_join.deepest(0.8, cfg)
    assert 1 - (1 - 0.8**d) ** cfg.trees >= cfg.target_recall > 1 - (1 - 0.8 ** (d + 1)) ** cfg.trees
    assert ngram_join.deepest(0.8, ngram_join.Config(target_recall=0.9)) > d
    assert ngram_join.least_similarity(3, 0.8) == 1 and ngram_join.least_similarity(4, 0.8) == 0.8 and abs(ngram_join.least_similarity(6, 0.8) - 5 / 6) < 1e-9
    assert ngram_join.deepest(1.0, cfg) == cfg.max_depth


def test_classes_settle_in_nodes_by_size_and_bound(spark):
    """By hand: a small node stays short, a large one is lengthened up to the
    bound of its least need, nodes of one go."""
    cfg = ngram_join.Config(trees=2, max_depth=6, min_depth=2, small=3, target_recall=0.5)
    bound = ngram_join.deepest(0.8, cfg)
    assert cfg.min_depth < bound < cfg.max_depth
    rng = __import__("random").Random(1)
    hashes = lambda head, n: [*head, *(rng.randrange(1 << 31) for _ in range(n - len(head)))]
    firsts = [hashes([1, 2], 6) for _ in range(3)] + [hashes([5, 6, 7, 8, 9][:bound], 6) for _ in range(5)] + [hashes([5, 6], 6) for _ in range(2)] + [hashes([], 6)]
    sigs = [b"".join(x.to_bytes(4, "little") for x in (*first, *hashes([], 6))) for first in firsts]
    rows = [(bytes([i]), s, 8 * 1000) for i, s in enumerate(sigs)]
    got = ngram_join.settled(spark.createDataFrame(rows, "digest binary, sig binary, n_bytes long"), cfg).collect()
    nodes = {}
    for r in got:
        nodes.setdefault((r.tree, r.node), set()).add(bytes(r.digest)[0])
    assert sorted(map(sorted, nodes.values())) == [[0, 1, 2], [3, 4, 5, 6, 7]]


def test_helper_names_do_not_clash(spark):
    rows = [(i, prose(400 + i % 3, 60), "en", f"s{i % 2}", i, 7 + i, "b", True, i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __n long, __k long, __bits string, __may boolean, __Words long")
    kept = sorted(map(tuple, ngram_join.deduplicated(docs).collect()))
    assert kept == sorted(rows[:3])
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and set(map(tuple, taken.collect())) <= set(rows)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_no_documents(spark, no_documents, sf_dir, corpus):
    assert ngram_join.join_documents(no_documents).count() == 0 and ngram_join.deduplicated(no_documents).count() == 0
    got = QUERIES["op9_ngram_join"](spark, sf_dir).collect()
    assert len(got) == len(corpus) and {r.class_id for r in got if r.doc_id in (1, 60, 61)} == {1}


# --- pipeline --------------------------------------------------------------------------
def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 240)
    item = prose(9000, 40)
    extra = [(1000, docs.where("doc_id = 1").first().text), (1001, prose(1, 60) + " " + item), (1002, None), (1003, "")]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 3).alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("size"))
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    now, sizes = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/stage{k}")
        now = spark.read.parquet(f"{d}/stage{k}")
        sizes.append({r.doc_id for r in now.collect()})
    assert len(sizes[0] & {i for i, q in truth.items() if q}) >= 0.98 * sum(truth.values())
    assert len(sizes[0] & {i for i, q in truth.items() if not q}) <= 0.05 * len(truth)
    assert sizes[0] - sizes[1] == {1000} and sizes[1] - sizes[2] == {1001}
    assert len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, d, f"{d}/corpus").collect()
    assert {x for r in rows for x in r.doc_ids} == sizes[3]
    assert spark.read.parquet(f"{d}/corpus").agg(F.sum("n_seqs")).first()[0] == len(rows)  # the id matrices
