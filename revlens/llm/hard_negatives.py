"""Hard negatives by best-first search in an STR-packed R-tree.

Points are integer vectors with a label. `build` packs them by sort-tile-recursive:
Spark cuts the points into slabs by label and each slab by the first component
(quantiles over all points), so a tile has about `Config.part` points; a tile
with more (equal vectors cannot be cut) is split by a hash. Inside a tile the same
recursion over label and all components makes leaves of `Config.leaf` points, and
runs of `Config.fan` nodes make the next level. Every node has its minimum
bounding box and label range.

A box gives each component an interval, so the inner product with a query lies in
the sum of the component-wise extremes. `search` keeps, for a group of queries, a
queue of boxes by their highest bound. A box is pruned for a query if its bounds
miss the query's score window, if its highest bound is strictly below the query's
k-th score (ties may still win by id), or by its label range.

`mine` searches twice: for every anchor its first `k` rows of the same label, in the
tiles of its label's slab; then for every anchor and positive the first `k` rows of
another label inside the window that the positive's score sets. Queries go in
blocks of `Config.block`; every block meets every tile as one row of work, so tasks
are small and alike, and only k rows per query and tile leave a task.

All arithmetic is exact: 64-bit floats while every product sum stays below 2^53,
else 64-bit integers.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part, nor do those with a component beyond 65,536 in size, whose
inner products need not fit a long; missing components of shorter vectors count
as 0; a null vec_id is no anchor and comes last among ties; repeated rows are rows
of their own (each is an anchor, and a positive of the other); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import materialize


@dataclass(frozen=True)
class Config:
    k: int = 5
    part: int = 4096  # points of a tile, about
    leaf: int = 64
    fan: int = 8
    block: int = 4096  # queries of a block, about
    group: int = 64  # queries that share a queue
    anchor_every: int = 100
    low: tuple[int, int] = (4, 5)  # least negative score as a share of the positive one


LARGEST = 65536.0  # component size; times 256 is 2^24
NONE, EVER = -(1 << 62), 1 << 62


# --- the tree ------------------------------------------------------------------------
def tiles(keys: np.ndarray, size: int) -> list[np.ndarray]:
    """Sort-tile-recursive: row numbers in runs of at most `size`, cut by one
    column of `keys` after the other."""
    runs, m = [np.arange(len(keys))], keys.shape[1]
    for j in range(m):
        if all(len(r) <= size for r in runs):
            break
        cut = []
        for r in runs:
            pages = -(-len(r) // size)
            if pages > 1:
                step = size * -(-pages // max(2, int(np.ceil(pages ** (1 / (m - j))))))
                r = r[np.argsort(keys[r, j], kind="stable")]
                cut += [r[i : i + step] for i in range(0, len(r), step)]
            else:
                cut.append(r)
        runs = cut
    return [r[i : i + size] for r in runs for i in range(0, len(r), size)]


class Tree:
    """Points in leaf order and the boxes of all nodes, leaves first."""

    def __init__(self, vectors: np.ndarray, **arrays: np.ndarray) -> None:
        self.vectors = vectors
        self.__dict__.update(arrays)

    @classmethod
    def pack(cls, ids, nulls, rows, labels, vectors, cfg: Config) -> Tree:
        runs = tiles(np.concatenate([labels[:, None], vectors], 1), cfg.leaf)
        order = np.concatenate(runs)
        ids, nulls, rows, labels, vectors = ids[order], nulls[order], rows[order], labels[order], vectors[order]
        last = np.cumsum([len(r) for r in runs])
        first = last - [len(r) for r in runs]
        box = lambda f, a, at: f.reduceat(a, at, axis=0)
        low, high = box(np.minimum, vectors, first), box(np.maximum, vectors, first)
        llow, lhigh = box(np.minimum, labels, first), box(np.maximum, labels, first)
        lows, highs, llows, lhighs, firsts, lasts = [low], [high], [llow], [lhigh], [first], [last]
        base = 0
        while len(low) > cfg.fan:
            at = np.arange(0, len(low), cfg.fan)
            firsts.append(base + at)
            lasts.append(base + np.minimum(at + cfg.fan, len(low)))
            base += len(low)
            low, high, llow, lhigh = box(np.minimum, low, at), box(np.maximum, high, at), box(np.minimum, llow, at), box(np.maximum, lhigh, at)
            for all_, level in ((lows, low), (highs, high), (llows, llow), (lhighs, lhigh)):
                all_.append(level)
        tree = cls(vectors, ids=ids, rows=rows, nulls=nulls, labels=labels)
        tree.low, tree.high, tree.first, tree.last = map(np.concatenate, (lows, highs, firsts, lasts))
        tree.llow, tree.lhigh, tree.leaves, tree.top = np.concatenate(llows), np.concatenate(lhighs), len(runs), base
        return tree

    def bounds(self, q: Queries, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.low[nodes].astype(q.kind).T, self.high[nodes].astype(q.kind).T
        return q.up @ low + q.down @ high, q.up @ high + q.down @ low


class Queries:
    """A group of queries: vectors, labels, own rows and score windows."""

    def __init__(self, vectors, labels, rows, least, most, exact: bool) -> None:
        self.kind = np.float64 if exact else np.int64
        self.vectors, self.labels, self.rows = vectors.astype(self.kind), labels, rows
        self.up, self.down = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        self.least, self.most = least.astype(self.kind), most.astype(self.kind)


def search(tree: Tree, q: Queries, k: int, same_label: bool) -> list[list[tuple[int, int, int, int]]]:
    """For each query its first k points as (-score, id, row, position): of the
    query's label (but not its own row), or of other labels."""
    best: list[list[tuple]] = [[] for _ in q.rows]
    kth = np.full(len(q.rows), NONE, q.kind)
    queue: list[tuple] = []

    def offer(nodes: np.ndarray, live: np.ndarray) -> None:
        lowest, highest = tree.bounds(q, nodes)
        within = tree.llow[nodes] <= q.labels[:, None], tree.lhigh[nodes] >= q.labels[:, None]
        only = (tree.llow[nodes] == q.labels[:, None]) & (tree.lhigh[nodes] == q.labels[:, None])
        ok = live[:, None] & (highest >= q.least[:, None]) & (lowest <= q.most[:, None]) & (highest >= kth[:, None])
        ok &= within[0] & within[1] if same_label else ~only
        top = np.where(ok, highest, NONE).max(0)
        for i in np.flatnonzero(ok.any(0)).tolist():
            heapq.heappush(queue, (-top[i], int(nodes[i]), ok[:, i], highest[:, i]))

    offer(np.arange(tree.top, len(tree.first)), np.ones(len(q.rows), bool))
    while queue:
        _, node, ok, highest = heapq.heappop(queue)
        live = ok & (highest >= kth)
        if not live.any():
            continue
        if node >= tree.leaves:
            offer(np.arange(tree.first[node], tree.last[node]), live)
            continue
        at, who = slice(tree.first[node], tree.last[node]), np.flatnonzero(live)
        scores = q.vectors[who] @ tree.vectors[at].T.astype(q.kind)
        hit = (scores >= q.least[who, None]) & (scores <= q.most[who, None]) & (scores >= kth[who, None])
        label = tree.labels[at] == q.labels[who, None]
        hit &= label & (tree.rows[at] != q.rows[who, None]) if same_label else ~label
        for i in np.flatnonzero(hit.any(1)).tolist():
            n, points = int(who[i]), np.flatnonzero(hit[i])
            if len(points) > k:
                where = points + at.start
                points = points[np.lexsort((tree.rows[where], tree.ids[where], -scores[i, points]))[:k]]
            new = [(-int(scores[i, p]), int(tree.ids[at.start + p]), int(tree.rows[at.start + p]), at.start + int(p)) for p in points]
            best[n] = sorted(best[n] + new)[:k]
            if len(best[n]) == k:
                kth[n] = -best[n][-1][0]
    return best


# --- points, tiles and blocks on Spark -----------------------------------------------
def points(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (integer components) and a row number, stored."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) > LARGEST))
    label = F.col("label").cast("long")
    changed = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        changed.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("v"),
    )
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "negative-points")


@dataclass(frozen=True)
class Shape:
    rows: int
    dims: int
    exact: bool  # 64-bit floats are exact

    @classmethod
    def of(cls, pts: DataFrame) -> Shape:
        most = F.max(F.greatest(F.lit(0), F.array_max(F.transform("v", lambda x: F.abs(x)))))
        n, dims, largest = pts.agg(F.count("*"), F.max(F.size("v")), most).first()
        return cls(n, dims or 0, (dims or 0) * (largest or 0) ** 2 < 1 << 53)


def _fractions(pieces: int) -> list[float]:
    return [i / pieces for i in range(1, pieces)]


def slabs(pts: DataFrame, shape: Shape, cfg: Config) -> list[int]:
    """Label bounds of the first cut; at most the square root of the number of tiles."""
    pieces = int(np.ceil(np.sqrt(shape.rows / cfg.part)))
    return sorted(set(pts.agg(F.percentile_approx("label", _fractions(pieces))).first()[0])) if pieces > 1 else []


def with_slab(rows: DataFrame, bounds: list[int]) -> DataFrame:
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("label"))) if bounds else F.lit(0)
    return rows.withColumn("slab", at)


_TREE = "part long, slab int, count int, dims int, narrow boolean, points binary, nodes binary, vectors binary"
_TREE_ARROW = pa.schema(
    [("part", pa.int64()), ("slab", pa.int32()), ("count", pa.int32()), ("dims", pa.int32()), ("narrow", pa.bool_()), ("points", pa.binary()), ("nodes", pa.binary()), ("vectors", pa.binary())]
)


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Lists as the rows of a matrix, filled with 0 at the end."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def build(pts: DataFrame, shape: Shape, bounds: list[int], cfg: Config = Config()) -> DataFrame:
    """The tiles as stored trees, a row each."""
    pieces = max(1, int(np.ceil(shape.rows / cfg.part / (len(bounds) + 1))))
    first = F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(0))
    rows = with_slab(pts, bounds).withColumn("first", first)
    if pieces > 1:
        cuts = rows.groupBy("slab").agg(F.percentile_approx("first", _fractions(pieces)).alias("cuts"))
        rows = rows.join(cuts, "slab").withColumn("tile", F.size(F.filter("cuts", lambda x: x < F.col("first")))).drop("cuts")
    else:
        rows = rows.withColumn("tile", F.lit(0))
    size = rows.groupBy("slab", "tile").agg(F.ceil(F.count("*") / cfg.part).alias("chunks"))
    numbered = size.withColumn("base", F.sum("chunks").over(Window.orderBy("slab", "tile").rowsBetween(Window.unboundedPreceding, -1)))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks"))
    rows = rows.join(numbered, ["slab", "tile"]).select("vec_id", "label", "v", "row", "slab", (F.coalesce("base", F.lit(0)) + chunk).alias("part"))
    dims = shape.dims

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        col = lambda c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        ids = col("vec_id")
        nulls = ids.is_null().to_numpy(zero_copy_only=False)
        tree = Tree.pack(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), nulls, col("row").to_numpy(), col("label").to_numpy(), _matrix(col("v"), dims), cfg)
        narrow = bool(dims == 0 or np.abs(tree.vectors).max() < 1 << 15)
        wide = np.int16 if narrow else np.int32
        nodes = [np.array([len(tree.first), tree.leaves, tree.top]), tree.first, tree.last, tree.llow, tree.lhigh, tree.low.ravel(), tree.high.ravel()]
        row = {
            "part": [t.column("part")[0].as_py()], "slab": [t.column("slab")[0].as_py()], "count": [t.num_rows], "dims": [dims], "narrow": [narrow],
            "points": [np.concatenate([tree.ids, tree.rows, tree.labels, tree.nulls]).astype(np.int64).tobytes()],
            "nodes": [np.concatenate(nodes).astype(np.int64).tobytes()],
            "vectors": [tree.vectors.astype(wide).tobytes()],
        }
        return pa.table(row, schema=_TREE_ARROW)

    return materialize(rows.groupBy("part").applyInArrow(pack, _TREE), "negative-tiles")


def _load(r: dict) -> Tree:
    n, d = r["count"], r["dims"]
    p, nodes = np.frombuffer(r["points"], np.int64).reshape(4, n), np.frombuffer(r["nodes"], np.int64)
    m, leaves, top = nodes[:3].tolist()
    first, last, llow, lhigh = nodes[3 : 3 + 4 * m].reshape(4, m)
    boxes = nodes[3 + 4 * m :].reshape(2, m, d)
    tree = Tree(np.frombuffer(r["vectors"], np.int16 if r["narrow"] else np.int32).reshape(n, d), ids=p[0], rows=p[1], labels=p[2], nulls=p[3].astype(bool))
    tree.first, tree.last, tree.llow, tree.lhigh, tree.low, tree.high, tree.leaves, tree.top = first, last, llow, lhigh, boxes[0], boxes[1], leaves, top
    return tree


_BLOCK = "block long, queries long, ids binary, vectors binary"


def blocks(queries: DataFrame, shape: Shape, cfg: Config) -> DataFrame:
    """Queries (number, row, label, least, most, v, block) as stored blocks."""
    dims = shape.dims
    schema = pa.schema([("block", pa.int64()), ("queries", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        v = _matrix(t.column("v").combine_chunks(), dims)
        ids = np.stack([t.column(c).to_numpy() for c in ("number", "row", "label", "least", "most")])
        order = np.lexsort((*v[:, :1].T, ids[2]))  # neighbours share a queue
        row = {"block": [t.column("block")[0].as_py()], "queries": [t.num_rows], "ids": [ids[:, order].astype(np.int64).tobytes()], "vectors": [v[order].astype(np.int32).tobytes()]}
        return pa.table(row, schema=schema)

    return materialize(queries.groupBy("block").applyInArrow(pack, _BLOCK), "negative-queries")


_FOUND = "number long, id long, row long, score long"


def found(trees: DataFrame, queries: DataFrame, pairs: DataFrame, shape: Shape, same_label: bool, cfg: Config) -> DataFrame:
    """number, id, row, score and rank of each query's first k points. `pairs`:
    the tiles (part) and query blocks that meet."""
    schema = pa.schema([("number", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                tree, n = _load(r), r["queries"]
                ids, v = np.frombuffer(r["ids"], np.int64).reshape(5, n), np.frombuffer(r["q"], np.int32).reshape(n, r["dims"])
                out: list[tuple] = []
                for start in range(0, n, cfg.group):
                    at = slice(start, start + cfg.group)
                    number, row, label, least, most = ids[:, at]
                    q = Queries(v[at], label, row, least, most, shape.exact)
                    for m, hits in zip(number.tolist(), search(tree, q, cfg.k, same_label), strict=True):
                        out += [(m, None if tree.nulls[p] else x, w, -s) for s, x, w, p in hits]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], f.type) for j, f in enumerate(schema)], schema=schema)

    rows = pairs.join(queries.withColumnRenamed("vectors", "q"), "block").join(trees.drop("slab"), "part").repartition("part", "block")
    hits = rows.mapInArrow(work, _FOUND)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k)


def _block(rows: DataFrame, n: int, cfg: Config) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(1, -(-n // cfg.block)))))


def mine(pts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    over `points`."""
    shape = Shape.of(pts)
    bounds = slabs(pts, shape, cfg)
    trees = build(pts, shape, bounds, cfg)
    anchors = pts.where(F.col("vec_id") % cfg.anchor_every == 0)
    ever = [F.lit(NONE).cast("long").alias("least"), F.lit(EVER).cast("long").alias("most")]
    asked = with_slab(anchors, bounds).select(F.col("row").alias("number"), "row", "label", *ever, "v", "slab")
    per = _block(asked, anchors.count(), cfg).withColumn("block", F.col("slab").cast("long") * (1 << 40) + F.col("block"))
    asked = blocks(per.drop("slab"), shape, cfg)
    at = trees.select("part", "slab")
    pairs = at.join(asked.select("block", F.floor(F.col("block") / (1 << 40)).cast("int").alias("slab")), "slab").drop("slab")
    positives = materialize(found(trees, asked, pairs, shape, True, cfg), "negative-positives")
    # every anchor and positive is a query of its own: (number of the anchor, rank)
    num, den = cfg.low
    # rounded up; below 0 it lies above the positive's score, as the window is empty then
    least = F.expr(f"({num} * score + {den - 1}) div {den}")
    own = anchors.select("row", "label", "v", F.col("vec_id").alias("anchor_id"))
    pos = positives.select(F.col("number").alias("row"), "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), least.alias("least"))
    pos = materialize(pos.withColumn("number", F.col("row") * cfg.k + F.col("rank") - 1), "negative-windows")
    windows = pos.select("number", "row", "least", F.col("positive_score").alias("most")).join(own.select("row", "label", "v"), "row")
    n = pos.count()
    searched = blocks(_block(windows.select("number", "row", "label", "least", "most", "v"), n, cfg), shape, cfg)
    many = max(1, -(-n // cfg.block))
    pairs = trees.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("block"))
    hits = found(trees, searched, pairs, shape, False, cfg).select("number", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pos.drop("rank").join(own.select("row", "anchor_id"), "row").join(hits, "number")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, cfg: Config = Config()) -> DataFrame:
    return mine(points(embeddings), cfg)


#: The same in DuckDB's SQL.
NEGATIVES_SQL = r"""
WITH pts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS r,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM pts a JOIN pts b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id, br) <= 5
), pairs AS (
  SELECT p.ar, p.br, p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id, n.br) AS rank
  FROM positives p JOIN scored n ON p.ar = n.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 5
"""
