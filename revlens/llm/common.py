"""Helpers shared by the training-data operators.

Words are maximal runs without ASCII white space, `[^\\x20\\x09-\\x0D]+`;
`bytes.split()` cuts UTF-8 at exactly those bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_ALNUM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def unused(rows: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the rows do not have in any case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    return utf8(text).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z."""
    return utf8(text).translate(_ALNUM).split()


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def word_count(column: str) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


#: Bits of a key bitmap: 2048 rows of 4 KB, 8 MB in all, whatever the number of keys.
BITMAP_BITS = 1 << 26
_ROW_BITS = 1 << 15


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """The hashes of a key column as a bitmap of fixed size."""
    bits = keys.select(F.floor(_bit(key) / _ROW_BITS).alias("__row"), (_bit(key) % _ROW_BITS).alias("__at"))
    return bits.groupBy("__row").agg(F.bitmap_construct_agg("__at").alias("__bits"))


def with_hint(rows: DataFrame, bitmap: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether the row's key may be among the bitmap's keys (false: it is
    not). The bitmap has a fixed bound, so it is broadcast: rows that cannot
    match need no shuffle. With very many keys it only excludes less."""
    columns = rows.columns
    row, bits = unused(rows, "row", "bits")
    bitmap = bitmap.withColumnsRenamed({"__row": row, "__bits": bits})
    at = _bit(key) % _ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    joined = rows.join(F.broadcast(bitmap), F.floor(_bit(key) / _ROW_BITS) == F.col(row), "left")
    return joined.select(*columns, F.coalesce(held, F.lit(False)).alias(name))


def record_batch(fields: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema's types from arrays or lists."""
    arrays = []
    for f in schema:
        v = fields[f.name]
        arrays.append(v.cast(f.type) if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21):
    """Cuts a batch into runs of rows of about `most_bytes` text each (a row
    stays whole), so that the arrays made for a run stay small."""
    sizes = batch.column(column).cast(pa.binary()).to_pylist()
    start = held = 0
    for i, v in enumerate(sizes):
        n = len(v) if v is not None else 0
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
