"""Diff tables: PR diff -> changed files -> added lines.

All of it is row-local work on the partitions that hold the diffs, without an
exchange; `raw_diff` is never carried past the file split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import diff as D


def attach_diffs(rows: DataFrame, diffs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Add `diff` by (repo_name, pr_number); a missing diff is '' (never an
    error) and flagged with `diff_missing`."""
    key = key or ["repo_name", "pr_number"]
    d = diffs.select(*key, F.col("diff").alias("_diff"))
    j = rows.join(d, key, "left")
    return j.withColumn("diff_missing", F.col("_diff").isNull()).withColumn(
        "diff", F.coalesce(F.col("_diff"), F.lit(""))
    ).drop("_diff")


def changed_files(diffs: DataFrame, id_col: str = "analysis_id", parity: bool = False) -> DataFrame:
    """F1 + F2 + F3: one row per file block with at least one added line.

    Columns: id_col, file_idx (0-based block order), file_path, content
    (added lines, newline-terminated), added_count.
    """
    # Parse every block inside one projection and drop non-file blocks / files
    # without added lines with a higher-order `filter`: a Filter operator here
    # would be pushed down to the scan and re-evaluate the whole parse there.
    arr = diffs.select(id_col, D.file_blocks("diff").alias("_blocks"))
    pre = F.when(F.element_at("_blocks", 1).startswith(D.FILE_HEADER), F.lit(0)).otherwise(F.lit(1))
    parsed = F.transform(
        "_blocks",
        lambda blk, i: F.struct(
            (i - pre).alias("file_idx"),
            blk.startswith(D.FILE_HEADER).alias("is_file"),
            D.block_path(blk, parity).alias("file_path"),
            D.added_lines(blk).alias("added"),
        ),
    )
    kept = F.filter(parsed, lambda x: x["is_file"] & x["file_path"].isNotNull() & (F.size(x["added"]) > 0))
    out = arr.select(id_col, F.explode(kept).alias("_f")).select(
        id_col,
        F.col("_f.file_idx").cast("int").alias("file_idx"),
        F.col("_f.file_path").alias("file_path"),
        F.concat(F.array_join("_f.added", "\n"), F.lit("\n")).alias("content"),
        F.size("_f.added").alias("added_count"),
    )
    return out


def tracked_lines(diffs: DataFrame, id_col: str = "analysis_id") -> DataFrame:
    """F3, W5 with hunk tracking: one row per added line of every file block, with
    its position among the file's added lines (`line_number`, as in W5) and its
    line number in the real file (`file_line`). Lines that begin with '++' are
    kept, which F3's prefix test loses (T10). Blocks without a hunk header (a
    rename, a binary file) have no line. No exchange."""
    arr = diffs.select(id_col, D.file_blocks("diff").alias("_blocks"))
    pre = F.when(F.element_at("_blocks", 1).startswith(D.FILE_HEADER), F.lit(0)).otherwise(F.lit(1))
    parsed = F.transform(
        "_blocks",
        lambda blk, i: F.struct((i - pre).alias("file_idx"), blk.startswith(D.FILE_HEADER).alias("is_file"), D.block_path(blk).alias("file_path"), D.hunk_lines(blk).alias("lines")),
    )
    kept = F.filter(parsed, lambda x: x["is_file"] & x["file_path"].isNotNull() & (F.size(x["lines"]) > 0))
    files = arr.select(id_col, F.explode(kept).alias("_f"))
    lines = files.select(id_col, F.col("_f.file_idx").cast("int").alias("file_idx"), "_f.file_path", F.posexplode("_f.lines").alias("_i", "_l"))
    return lines.select(id_col, "file_idx", "file_path", (F.col("_i") + 1).cast("int").alias("line_number"), F.col("_l.line_number").alias("file_line"), "_l.text")


def csharp_files(files: DataFrame, ext: str = ".cs") -> DataFrame:
    """Keep files whose path ends with the extension (case-insensitive)."""
    return files.filter(D.is_extension("file_path", ext))


def file_lines(files: DataFrame, id_col: str = "analysis_id") -> DataFrame:
    """One row per added line; line_number is the 1-based position in the
    concatenated added text (not the line number of the real file)."""
    lines = F.split("content", "\n")
    return files.select(
        id_col,
        "file_idx",
        "file_path",
        F.posexplode(F.slice(lines, 1, F.size(lines) - 1)).alias("_i", "text"),
    ).select(id_col, "file_idx", "file_path", (F.col("_i") + 1).cast("int").alias("line_number"), "text")
