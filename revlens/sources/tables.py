"""Table sources and sinks.

Tables are plain files (parquet by default) with fixed schemas. JDBC or any
other stock Spark source is reached with the same call by passing `fmt` and
`options`. There is no MERGE on parquet. A whole-row replace is a DataFrame
(`replace_rows`), from one shuffle join on the key that never goes through the
driver, to be written as a new snapshot. A keyed table (`store_keyed`) lies in
folders by a fixed hash of its key, and `update_touched` reads and rewrites only
the folders of the changed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S

TABLE_SCHEMAS = {
    "analyses": S.ANALYSES,
    "notifications": S.NOTIFICATIONS,
    "jobs": S.JOBS,
}


def read_table(
    spark: SparkSession, path: str, name: str = "analyses", fmt: str = "parquet", allow_missing: bool = False, **options
) -> DataFrame:
    """S3: full scan with the fixed schema of `name` (no inference). A stored
    table without one of the columns raises, unless `allow_missing` reads it as
    null."""
    schema: T.StructType = TABLE_SCHEMAS[name]
    reader = spark.read.format(fmt).options(**options)
    load = (lambda r: r.load()) if fmt == "jdbc" else (lambda r: r.load(path))
    if fmt in ("json", "csv"):
        return load(reader.schema(schema))
    stored = set(load(reader).columns)
    missing = [f.name for f in schema.fields if f.name not in stored]
    if missing and not allow_missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return conform(load(reader), schema) if fmt == "jdbc" else load(spark.read.format(fmt).options(**options).schema(schema))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the fixed schema; missing columns become null."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def insert_rows(rows: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Append new rows."""
    w = rows.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def replace_rows(state: DataFrame, changes: DataFrame, key: str | list[str] = "id", now: Column | None = None) -> DataFrame:
    """Whole-row update by key: a row of `changes` (one per key) replaces the
    stored row, other rows stay, and changes without a stored row are left out,
    as an update touches existing rows only. `now` stamps the replaced rows'
    `updated_at` (F26). One join; both sides are read once."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in state.columns if c not in keys]
    new = changes.select(*keys, F.struct(*others).alias("_new"))

    def value(c: str) -> Column:
        changed = now if c == "updated_at" and now is not None else F.col(f"_new.{c}")
        return F.when(F.col("_new").isNotNull(), changed).otherwise(F.col(c)).alias(c)

    return state.join(new, keys, "left").select(*[F.col(c) if c in keys else value(c) for c in state.columns])


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new snapshot of a table (the replace half of S5)."""
    df.write.mode("overwrite").format(fmt).save(path)


# --- keyed tables: S5 in place ------------------------------------------------------
BUCKETS = 16  # by default; a large table needs as many as it has gigabytes


def key_bucket(keys: str | list[str], buckets: int = BUCKETS) -> Column:
    """The folder of a key; does not depend on the session or the cluster."""
    return F.pmod(F.hash(*([keys] if isinstance(keys, str) else keys)), F.lit(buckets))


def store_keyed(rows: DataFrame, path: str, key: str | list[str] = "id", buckets: int = BUCKETS) -> None:
    """Write a table in folders by a fixed hash of its key. `buckets` is a
    property of the table: choose it so that a folder's rows are some files."""
    keyed = rows.withColumn("bucket", key_bucket(key, buckets)).hint("rebalance", F.col("bucket"))
    keyed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, touched: list[int] | None = None) -> DataFrame:
    """A keyed table, or the rows of some folders (the others are not read), with
    its bucket. Rows without an id only keep an emptied folder in place."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
    rows = rows if touched is None else rows.where(F.col("bucket").isin(touched))
    return rows.where(F.col(schema.fieldNames()[0]).isNotNull())


def touched_buckets(changes: DataFrame, key: str | list[str] = "id", buckets: int = BUCKETS) -> list[int]:
    """The folders of the changed keys: `buckets` numbers at most."""
    return sorted(r[0] for r in changes.select(key_bucket(key, buckets).alias("b")).distinct().collect())


def update_touched(
    spark: SparkSession, path: str, schema: T.StructType, changes: DataFrame, key: str | list[str] = "id", buckets: int = BUCKETS
) -> None:
    """S5 on a keyed table. `changes` has the key (one row each) and any of the
    table's columns; a null value leaves the stored one, and keys without a
    stored row are left out. Only the folders of the changed keys are read and
    written, by dynamic partition overwrite: rows are staged first and folders
    are exchanged when all tasks have ended, so a failed write leaves the old
    rows, and the same changes again give the same table. `changes` is read
    twice, so it should be a stored table."""
    keys = [key] if isinstance(key, str) else list(key)
    touched = touched_buckets(changes, keys, buckets)
    if not touched:
        return
    set_columns = [c for c in changes.columns if c not in keys]
    stored = read_keyed(spark, path, schema, touched)
    new = changes.select(*keys, F.struct(*set_columns).alias("_new"))
    values = [F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) if c in set_columns else F.col(c) for c in stored.columns]
    updated = stored.join(new, keys, "left").select(*values).hint("rebalance", F.col("bucket"))
    updated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_keys(
    spark: SparkSession, path: str, schema: T.StructType, keys: DataFrame, rows: DataFrame, key: str | list[str] = "id", buckets: int = BUCKETS
) -> None:
    """On a keyed table, put `rows` in the place of whatever it holds for `keys`
    (a key without rows is deleted). Only the folders of the keys are read and
    written, as in `update_touched`; both inputs should be stored tables. An
    emptied folder keeps one row of nulls, for a folder without rows would not
    be exchanged."""
    columns = [key] if isinstance(key, str) else list(key)
    touched = touched_buckets(keys, columns, buckets)
    if not touched:
        return
    kept = read_keyed(spark, path, schema, touched).join(keys.select(*columns).distinct(), columns, "left_anti")
    names = [*schema.fieldNames(), "bucket"]
    new = rows.withColumn("bucket", key_bucket(columns, buckets)).select(*names)
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], "bucket")
    whole = kept.select(*names).unionByName(new).unionByName(marks).hint("rebalance", F.col("bucket"))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


# --- clustered tables: what the declared indexes are for ------------------------------
def store_clustered(
    rows: DataFrame, path: str, by: tuple[str, ...] = ("repo_name", "processed_at"), key: str = "id", distinct: int | None = None, group_bytes: int | None = None
) -> None:
    """Write a table range-sorted by `by`, with Bloom filters on the key. Filters
    on the sorted columns skip files and row groups by their least and greatest
    values, lookups by key skip those whose filter rules it out. `distinct`: keys
    expected in a row group; `group_bytes`: its size."""
    options = {f"parquet.bloom.filter.enabled#{key}": "true"}
    if distinct:
        options[f"parquet.bloom.filter.expected.ndv#{key}"] = str(distinct)
    if group_bytes:
        options |= {"parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": "1000", "parquet.block.size.row.check.min": "100"}
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").options(**options).parquet(path)
