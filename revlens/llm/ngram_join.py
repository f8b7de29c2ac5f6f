"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of `Config.words`-word shingles (64-bit hashes; a text with fewer
words is one shingle of all its words). Documents with equal sets form a class,
and classes are joined. A signature holds `max_depth` min-hashes for each of
`Config.trees` prefix tries. In every trie a class ends in one node (`settled`):
its prefix of `max_depth` hashes is shortened, level by level, until the recall
bound holds for the node, and further while the shorter prefix's node has `small`
members at most. The bound: two sets of the node's sizes whose similarity reaches
the threshold meet in some trie with the target recall (`needed_depth`; sets of
few shingles cannot lie just above the threshold, so longer prefixes do for them).
The counts decide, so the levels are worked out from the short end: classes that
are alone at the shortest prefix have no partner in that trie and go at once.

Classes that end in one node are compared in blocks: a node with more than
`Config.block` members, or `Config.block_bytes` of their shingles, is cut into
blocks by hash, and every pair of blocks is a task's group, so a node of any size
is compared whole, without a row for each pair; shingles are counted in ranges of
at most about `Config.count_bytes`. A pair is compared in the first trie where it meets only. Whole signatures
drop pairs far below the threshold (`margin` standard errors), the remaining
ones are verified exactly on their shingle sets. A group yields link counts and
a star of its linked classes; the stars' connected components are the groups of
the result.

Result: one row a document with class_id (the least doc_id of its connected
component), n_links (other documents with similarity at or above the threshold,
its own copies included) and n_copies (documents with its shingle set).

Defined results: a text without words links to nothing and is its own class;
null doc_ids are ordered last (a component of only null ids has a null
class_id); repeated rows are copies of each other; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import key_bitmap, unused, utf8, with_hint
from revlens.session import materialize


@dataclass(frozen=True)
class Config:
    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    max_depth: int = 8
    min_depth: int = 3
    small: int = 32  # members of a node that may be kept at a shorter prefix than the bound asks for
    target_recall: float = 0.995
    margin: float = 5.0  # standard errors of the signature estimate
    block: int = 1024  # members of a trie node compared against as many in a group
    block_bytes: int = 1 << 26  # shingles of a block, on average; a text stays whole
    count_bytes: int = 1 << 24  # shingles sorted at once


def deepest(similarity: float, cfg: Config) -> int:
    """The longest prefix, shortened until pairs of that similarity are found with
    the target recall."""
    depth = cfg.max_depth
    while depth > cfg.min_depth and 1 - (1 - similarity**depth) ** cfg.trees < cfg.target_recall:
        depth -= 1
    return depth


def least_similarity(n: int, threshold: float) -> float:
    """The least similarity at or above the threshold that a set of n shingles
    can have with a different one (1: none)."""
    other = [c / (n + b - c) for b in range(1, int(n / threshold) + 2) for c in range(1, min(n, b) + 1) if (n, n) != (b, c)]
    return min((s for s in other if s >= threshold), default=1.0)


FEW = 64  # shingles; with more the least similarity is taken for the threshold


def needed_depth(n: Column, cfg: Config) -> Column:
    """The longest prefix that meets the recall bound for a set of n shingles and
    all sets that can be similar to it."""
    few = F.array(*[F.lit(deepest(least_similarity(k, cfg.threshold), cfg)) for k in range(1, FEW + 1)])
    return F.when(n <= FEW, F.try_element_at(few, F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.lit(deepest(cfg.threshold, cfg)))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    tokens = utf8(text).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    one = xxhash.xxh3_64_intdigest
    h = np.array([known[w] if w in known else known.setdefault(w, one(w)) for w in tokens], np.uint64)
    n = min(words, len(h))
    mix = np.uint64(0x9E3779B97F4A7C15)
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : k + len(s)]) * mix
        s ^= s >> np.uint64(29)
    return np.unique(s)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers for the upper and the lower half of a shingle's hash."""
    rng = np.random.default_rng(7)
    a, c = (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
    return a, c


def signature(s: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least 32-bit hash of the set under each function of the family, worked
    out for some shingles and all functions at once."""
    a, c = family
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    upper, lower = (s >> np.uint64(32)).astype(np.uint32), s.astype(np.uint32)
    for low in range(0, len(s), 256):
        v = upper[low : low + 256, None] * a
        v ^= lower[low : low + 256, None] * c
        np.minimum(least, v.min(0), out=least)
    return least


def signatures(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, text_md5, digest (of the shingle set; null without words), sig, n_bytes (of the set)."""
    n = cfg.trees * cfg.max_depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = _hash_family(n)
        for batch in batches:
            digests, sigs, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, cfg.words)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, family).tobytes() if len(s) else None)
                sizes.append(s.nbytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_md5"), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "text_md5", "digest", "sig", "n_bytes"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text")
    return rows.mapInArrow(sign, "doc_id long, text_md5 string, digest binary, sig binary, n_bytes long")


# --- groups of rows inside a task -------------------------------------------


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, as tables; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(bounds, bounds[1:]):
            if held and keys[low] != at:
                yield pa.Table.from_batches(held)
                held = []
            at = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(sig: np.ndarray, ends: np.ndarray, tree: int, left: np.ndarray, right: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of the `left`, one of the `right` block, or both of one block)
    that first meet in this trie and whose signatures do not rule them out.
    `ends`: each class's node in every trie, 0 for none."""
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    least = sig.shape[1] * cfg.threshold - cfg.margin * np.sqrt(sig.shape[1] * cfg.threshold * (1 - cfg.threshold))
    found = []
    for low in range(0, len(rows), 256):
        r = rows[low : low + 256]
        ok = ends[r, tree][:, None] == ends[cols, tree][None, :]
        for t in range(tree):
            ok &= (ends[r, t][:, None] != ends[cols, t][None, :]) | (ends[r, t][:, None] == 0)
        same = np.zeros(ok.shape, np.int16)
        for k in range(sig.shape[1]):
            same += sig[r, k][:, None] == sig[cols, k][None, :]
        ok &= same >= least
        i, j = np.nonzero(ok)
        i, j = r[i], cols[j]
        keep = i < j if np.array_equal(rows, cols) else i != j
        found.append((i[keep], j[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def common_shingles(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, most_bytes: int = Config.count_bytes) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sorted sets. They are
    summed over ranges of hashes with about `most_bytes` of the sets each."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    parts = max(1, -(-sum(sets[u].nbytes for u in used) // most_bytes))
    inner = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(sets[u], inner).tolist(), len(sets[u])] for u in used]
    both = np.zeros((len(used), len(used)), np.float32)
    width = 4096
    for p in range(parts):
        own = [sets[u][c[p] : c[p + 1]] for u, c in zip(used, cuts)]
        owner = np.repeat(np.arange(len(used), dtype=np.int32), [len(s) for s in own])
        _, inverse, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = times[inverse] > 1
        _, column = np.unique(inverse[shared], return_inverse=True)
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [low, low + width])
            x = np.zeros((len(used), width), np.float32)
            x[owner[a:b], column[a:b] - low] = 1
            both += x @ x.T
    return both[np.searchsorted(used, i), np.searchsorted(used, j)].astype(np.int64)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component under the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


# --- the join ----------------------------------------------------------------

_MEMBER = "g long, tree int, side_a boolean, side_b boolean, digest binary, sig binary, ends array<long>"


def _sorted_groups(rows: DataFrame) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g")


def settled(classes: DataFrame, cfg: Config) -> DataFrame:
    """node, tree, digest, n_bytes: the node in which each class ends in each
    trie, without nodes of one class."""

    def key(depth: int) -> Column:
        start = F.col("tree") * (4 * cfg.max_depth) + 1
        return F.xxhash64("tree", F.lit(depth), F.substring(F.col("sig"), start, F.lit(4 * depth)))

    tree = F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree")
    rows = classes.select("digest", "sig", "n_bytes", tree)
    first = rows.select("digest", "n_bytes", "tree", key(cfg.min_depth).alias("node"))
    shared = first.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    own = F.substring(F.col("sig"), F.col("tree") * (4 * cfg.max_depth) + 1, F.lit(4 * cfg.max_depth))
    rest = rows.withColumn("node", key(cfg.min_depth)).withColumn("sig", own).join(shared, "node")
    rest = materialize(rest.select("digest", "sig", "n_bytes", "tree", "n", "node", needed_depth(F.col("n_bytes") / 8, cfg).alias("need")), "join-prefixes")
    done = None
    for depth in range(cfg.min_depth, cfg.max_depth + 1):
        if depth > cfg.min_depth:
            rest = rest.withColumn("node", F.xxhash64("tree", F.lit(depth), F.substring("sig", 1, 4 * depth)))
        nodes = materialize(rest.groupBy("node").agg(F.count("*").alias("size"), F.min("need").alias("bound")), "join-nodes")
        here = (F.col("size") <= cfg.small) | (F.col("bound") <= depth) | F.lit(depth == cfg.max_depth)
        at = rest.join(nodes, "node")
        ends = at.where(here & (F.col("size") > 1)).select("node", "tree", "digest", "n_bytes")
        done = ends if done is None else done.unionByName(ends)
        rest = materialize(at.where(~here).select("digest", "sig", "n_bytes", "tree", "need"), "join-prefixes")
        if rest.isEmpty():
            break
    return materialize(done, "join-ends")


def trie_members(ends: DataFrame, cfg: Config) -> DataFrame:
    """The members of each node, once for each pair of blocks they take part in.
    Equal group numbers of different nodes would only add pairs that then fail
    the test of their nodes."""
    full = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("node_bytes"))
    blocks = F.least("n", F.greatest(F.ceil(F.col("n") / cfg.block), F.ceil(F.col("node_bytes") / cfg.block_bytes)))
    own = F.pmod(F.xxhash64("digest", F.lit(1)), blocks)
    members = ends.join(full, "node").select("node", "tree", "digest", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return members.select(
        F.xxhash64("node", low, high).alias("g"), "tree", (F.col("own") == low).alias("side_a"), (F.col("own") == high).alias("side_b"), "digest"
    )


def class_ends(ends: DataFrame, classes: DataFrame, cfg: Config) -> DataFrame:
    """digest, sig, ends: each class's node in every trie (0 for none)."""
    per = ends.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("at"))  # an entry a trie
    at = F.transform(F.sequence(F.lit(0), F.lit(cfg.trees - 1)), lambda t: F.coalesce(F.try_element_at("at", t), F.lit(0).cast("long")))
    return classes.select("digest", "sig").join(per.select("digest", at.alias("ends")), "digest")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _ends(group: pa.Table, cfg: Config) -> np.ndarray:
    return group["ends"].combine_chunks().flatten().to_numpy().reshape(-1, cfg.trees)


def possible_members(members: DataFrame, cfg: Config) -> DataFrame:
    """The members that have a pair to verify in their group."""
    width = cfg.trees * cfg.max_depth

    def filter_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "g"):
            if group.num_rows < 2:
                continue
            trees = group["tree"].to_numpy()
            i, j = _group_pairs(group, trees, _matrix(group["sig"], width), cfg)
            if len(i):
                yield from group.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return _sorted_groups(members).mapInArrow(filter_, _MEMBER)


def _group_pairs(group: pa.Table, trees: np.ndarray, sig: np.ndarray, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    a, b = group["side_a"].to_numpy(), group["side_b"].to_numpy()
    ends = _ends(group, cfg)
    found = [candidate_pairs(sig, ends, int(t), a & (trees == t), b & (trees == t), cfg) for t in np.unique(trees)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def verified(members: DataFrame, cfg: Config) -> DataFrame:
    """digest, root, links: for each member of a group the least member it is
    connected to there, and its verified links weighted by the partners' copies."""
    width = cfg.trees * cfg.max_depth

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "g"):
            if group.num_rows < 2:
                continue
            trees = group["tree"].to_numpy()
            i, j = _group_pairs(group, trees, _matrix(group["sig"], width), cfg)
            if not len(i):
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"]]
            size = np.array([len(s) for s in sets])
            both = common_shingles(sets, i, j, cfg.count_bytes)
            linked = both >= cfg.threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            copies = group["copies"].to_numpy().astype(float)
            links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
            digest = group["digest"].to_pylist()
            root = _roots(len(sets), i, j)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest[k] for k in at], pa.binary()), pa.array([digest[root[k]] for k in at], pa.binary()), pa.array(links[at].astype(np.int64))],
                names=["digest", "root", "links"],
            )

    return _sorted_groups(members).mapInArrow(verify, "digest binary, root binary, links long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of an undirected graph's nodes with an
    edge, by alternating large and small stars; every round is a stored table."""
    edges = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "cc")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that both sides of the join are plain exchanges and a hub's edges can be split.
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "cc-large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u != v").distinct(), "cc")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _first(*columns: str) -> Column:
    """Order of documents: by doc_id, null last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *columns)


def _row_key(doc_id: Column, text_md5: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("")), text_md5).cast("binary"))


def _text_md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def join_documents(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, text_md5, class_id, n_links, n_copies and keep (the component's
    first document and text) of every document row."""
    signed = materialize(signatures(documents, cfg), "join-signatures")
    with_words = signed.where("digest is not null")
    classes = materialize(
        with_words.groupBy("digest").agg(F.min(_first("text_md5")).alias("first"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("n_bytes").alias("n_bytes")), "join-classes"
    )
    ends = settled(classes, cfg)
    members = trie_members(ends, cfg).join(class_ends(ends, classes, cfg), "digest").select(*(c.split()[0] for c in _MEMBER.split(", ")))
    possible = materialize(possible_members(members, cfg), "join-members")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, cfg.words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), pa.array(sets, pa.binary())], names=["digest", "copies", "shingles"])

    # Only texts that may be wanted are shuffled to the wanted classes.
    first = _row_key(F.col("first.doc_id"), F.col("first.text_md5"))
    wanted = materialize(possible.select("digest").distinct().join(classes, "digest").select("digest", "copies", first.alias("k")), "join-wanted")
    texts = documents.select(_row_key(F.col("doc_id").cast("long"), _text_md5()).alias("k"), "text")
    texts = with_hint(texts, key_bitmap(wanted, "k"), "k", "may").where("may").select("k", "text")
    sets = texts.join(wanted, "k").select("digest", "copies", "text")
    sets = sets.mapInArrow(attach, "digest binary, copies long, shingles binary").dropDuplicates(["digest"])
    links = materialize(verified(possible.join(sets, "digest"), cfg), "join-links")
    labels = components(links, "digest", "root")
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"))
    placed = classes.drop("sig", "n_bytes").join(labels.withColumnRenamed("node", "digest"), "digest", "left").join(counts, "digest", "left")
    placed = placed.withColumn("component", F.coalesce("component", "digest"))
    firsts = placed.groupBy("component").agg(F.min("first").alias("keeper"))
    placed = placed.join(firsts, "component").select("digest", "keeper", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    linked = with_words.drop("sig", "n_bytes").join(placed, "digest").select(
        "doc_id", "text_md5", F.col("keeper.doc_id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
        (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_md5") == F.col("keeper.text_md5"))).alias("keep"),
    )
    empty = signed.where("digest is null").select(
        "doc_id", "text_md5", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("keep")
    )
    return linked.unionByName(empty)


def deduplicated(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One document of each component, with all its columns. Documents that
    cannot be among the dropped or repeated rows pass where they are read; only
    the others are shuffled."""
    k, may, n = unused(documents, "k", "may", "n")
    rows = join_documents(documents, cfg).select(_row_key(F.col("doc_id"), F.col("text_md5")).alias(k), "keep")
    keys = rows.groupBy(k).agg(F.bool_or("keep").alias("keep"), F.count("*").alias("n"))
    checked = materialize(keys.where("not keep or n > 1").select(k, "keep"), "join-checked")
    key = _row_key(F.col("doc_id").cast("long"), _text_md5())
    docs = with_hint(documents.withColumn(k, key), key_bitmap(checked, k), k, may)
    doubtful = docs.where(F.col(may))
    others = [F.col(c).cast("string") for c in documents.columns if c not in ("doc_id", "text")]
    nth = F.row_number().over(Window.partitionBy(k).orderBy(*others, F.lit(1)))
    kept = doubtful.join(checked.where("keep").select(k), k).withColumn(n, nth).where(F.col(n) == 1)
    parts = (docs.where(~F.col(may)), doubtful.join(checked.select(k), k, "left_anti"), kept)
    a, b, c = (x.select(*documents.columns) for x in parts)
    return a.unionByName(b).unionByName(c)
