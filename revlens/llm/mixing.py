"""Mixing sources to target weights by weighted fair queueing.

Sources in code-point order, null last, weigh 5, 2, 1, repeating. They share
`Config.share` (150 %) of all words by weight; a source's target stops at
`Config.repeats` times its size and the excess is shared again by weight until
no target is above (the water level is found with one pass over the sources
in the order of capacity by weight).

Every source's documents are shuffled by a hash of doc_id and served
`Config.repeats` times in that order. A service's virtual finish time is its
source's cumulative words divided by the source's target. The services are
range-sorted by finish time over all sources, and the mix takes them while
their cumulative words stay within the total budget. Documents are taken whole.

A source's running sums are cut into `Config.slots` slots of its shuffle order,
so that a source with a third of all rows spreads over many tasks; slot totals
are summed first. The finish times are cut into `Config.moments` ranges: their
totals show the one range in which the budget ends, ranges before it are taken
whole, and only that range is sorted row by row.

Only DataFrame functions. Defined results: a null or empty text has size 0 and
is taken 0 times 0 words; a source without words has target 0; repeated rows
are separate documents (equal rows are interchangeable); a null doc_id shuffles
as an empty id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import unused, word_count
from revlens.session import materialize

#: Weights of the sources in order, repeating (fixed values).
WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Config:
    share: float = 1.5  # total budget, as a share of all words
    repeats: int = 2  # times a document may be served
    slots: int = 4096  # pieces of a source's running sum
    moments: int = 1 << 16  # ranges of finish times; half of them up to time 1


def source_targets(sizes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """source, source_size, target; one row a source. The windows run over that
    table, whose rows are sources."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    t = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * cfg.repeats)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole) * cfg.share
    # the water level if all sources before this one are full and the others are not
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level"))
    t = t.withColumn("level", F.max(fits).over(whole))  # null: every source is full
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")), F.col("most").cast("double"))
    return t.select("source", "source_size", target.alias("target"))


def slot_totals(rows: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """For each key and slot its words and those of the key's earlier slots."""
    totals = rows.groupBy(*keys, slot).agg(F.sum("size").alias("slot_sum"))
    before = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("slot_start", F.coalesce(F.sum("slot_sum").over(before), F.lit(0)))


def services(sizes: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every document row `repeats` times, with its virtual finish time (null in
    a source without words). (source, slot, nth) names the row."""
    slot = (F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * cfg.slots / (1 << 32)).cast("int")
    docs = sizes.withColumn("slot", slot)
    starts = slot_totals(docs, ["source"], "slot").drop("slot_sum").withColumnsRenamed({"source": "s", "slot": "k"})
    targets = source_targets(sizes, cfg)
    starts = starts.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    docs = docs.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("k"))).drop("s", "k")
    inside = Window.partitionBy("source", "slot").orderBy("at", "doc_id", "size")
    docs = docs.withColumn("nth", F.row_number().over(inside)).withColumn(
        "upto", F.col("slot_start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    docs = docs.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(cfg.repeats - 1))))
    finish = F.when(F.col("target") > 0, (F.col("turn") * F.col("source_size") + F.col("upto")) / F.col("target"))
    return docs.withColumn("finish", finish).drop("slot_start", "upto")


def moment(cfg: Config) -> Column:
    """The range of a finish time; even steps up to 1, then ever wider ones."""
    half, t = cfg.moments // 2, F.col("finish")
    return F.when(t < 1, F.floor(t * half)).when(t >= 1, half + F.floor((1 - 1 / t) * half)).otherwise(cfg.moments).cast("int")


def mix(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document row."""
    sizes = materialize(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            word_count("text").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("at"),
        ),
        "mix-sizes",
    )
    served = materialize(services(sizes, cfg).withColumn("moment", moment(cfg)), "mix-services")
    ranges = slot_totals(served, [], "moment")
    budget = F.sum("slot_sum").over(Window.partitionBy()) / cfg.repeats * cfg.share
    over = F.col("slot_start") + F.col("slot_sum") > F.col("budget")
    end = ranges.withColumn("budget", budget).where(over).orderBy("moment").limit(1).first()
    if end is None:  # an empty corpus, or every service fits
        taken = served.withColumn("words", F.when(F.col("finish").isNotNull(), F.col("size")).otherwise(0))
    else:
        queue = Window.orderBy("finish", "at", "doc_id", "size", F.col("source").cast("binary"), "nth", "turn")
        upto = F.lit(end["slot_start"]) + F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        last = served.where(F.col("moment") == end["moment"]).withColumn("upto", upto)
        words = F.when(F.col("upto") <= end["budget"], F.col("size")).otherwise(0)
        rest = served.where(F.col("moment") != end["moment"])
        taken = last.withColumn("words", words).drop("upto").unionByName(
            rest.withColumn("words", F.when(F.col("moment") < end["moment"], F.col("size")).otherwise(0))
        )
    row = ["source", "slot", "nth", "doc_id", "size", "source_size", "target"]
    return taken.groupBy(*row).agg(F.sum("words").alias("taken")).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(documents: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Every document row as often as the mix takes it, with all its columns.
    Rows of one doc_id, source and size are told apart by rank only: the counts
    of those taken once, twice, ... say how often each rank comes."""

    def key(size: str) -> Column:  # one column, so that join and ranks share one shuffle of the texts
        parts = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("."), "source"), F.lit(""))
        return F.md5(F.concat_ws("\x1f", *parts, F.col(size).cast("string")).cast("binary"))

    k, words, nth, n, copy = unused(documents, "k", "words", "rank", "n", "copy")
    often_names = unused(documents, *[f"often{t}" for t in range(1, cfg.repeats + 1)])
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)
    often = [F.sum((times >= t).cast("long")).alias(name) for t, name in enumerate(often_names, 1)]
    taken = materialize(mix(documents, cfg).groupBy(key("size").alias(k)).agg(*often).where(F.col(often_names[0]) > 0), "mix-taken")
    docs = documents.withColumn(words, word_count("text")).withColumn(k, key(words))
    rank = F.row_number().over(Window.partitionBy(k).orderBy(F.md5(F.col("text").cast("binary"))))
    docs = docs.join(taken, k).withColumn(nth, rank)
    served = sum(((F.col(nth) <= F.col(name)).cast("int") for name in often_names), F.lit(0))
    copies = docs.withColumn(n, served).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    return copies.select(*documents.columns)


#: The mix in DuckDB's SQL.
MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT source, source_size, weight,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
      - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0e0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM totals
), targets AS (
  SELECT source, source_size, least(coalesce(level * weight, 2e0 * source_size), 2e0 * source_size) AS target
  FROM (SELECT *, max(CASE WHEN lv * weight < 2 * source_size THEN lv END) OVER () AS level FROM levels)
), docs AS (
  SELECT s.*, t.source_size, t.target, row_number() OVER () AS id,
         sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT id, size, sum(size) OVER (ORDER BY finish, place, doc_id, size, source, turn ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT *, CAST(turn * source_size + upto AS DOUBLE) / target AS finish FROM docs, (VALUES (0), (1)) v(turn) WHERE target > 0)
), taken AS (
  SELECT id, sum(CASE WHEN upto <= (SELECT sum(size) FROM sizes) * 1.5e0 THEN size ELSE 0 END) AS taken FROM served GROUP BY id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM docs LEFT JOIN taken USING (id)
"""
