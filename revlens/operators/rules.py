"""Code rules over the added text of files.

One pass over each file's added text (`functions.csharp.scan`, a small lexical
helper in a UDF that takes a few files at a time) gives the hits of R1-R3 as an array, where the
file is read: no shuffle, whatever the number of rules. Only files that can hold a
hit of the asked rules reach it (`may_hit`, a JVM expression). A file that the
helper cannot read never fails the others (R5): its one finding says so, whatever
the asked rules, and `unread_files` lists it. Exempt values, the optional limit (W1) and the texts of findings are
column expressions on that array. The registry (X3) maps a kind of hit to the column that turns it into a
finding; rules of other kinds are functions of the files, and all findings are
united as a bag (U1).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens import schemas as S
from revlens.functions import csharp
from revlens.functions import diff as D
from revlens.functions import labels as L

# --- fixed values: rule ids, texts and limits ------------------------------------
ASYNC_VOID_ID = "CV0001"
ASYNC_VOID_TITLE = "Async void usage"
ASYNC_VOID_MESSAGE = "Use async Task instead of async void methods"
ASYNC_VOID_CATEGORY = "AsyncPatterns"
MAGIC_ID = "CV0002"
MAGIC_TITLE = "Magic number"
MAGIC_CATEGORY = "CodeQuality"
MAGIC_EXEMPT = ("0", "1", "-1", "2", "10", "100")
MAGIC_LIMIT_PER_FILE = 10
LONG_ID = "CV0003"
LONG_TITLE = "Çok uzun metot"
LONG_CATEGORY = "Maintainability"
LONG_MAX_STATEMENTS = 50
UNREAD_ID = "CV0004"
UNREAD_TITLE = "File not analysed"
UNREAD_CATEGORY = "Analysis"
MAGIC_MESSAGE = "Use a named constant instead of magic number '%s'"
MAGIC_FIX = "const int MEANINGFUL_NAME = %s;"
ASYNC_VOID_FIX = "async Task %s(...)"
UNREAD_MESSAGE = "The code rules could not read this file (%s)"
LONG_MESSAGE = "Metot çok uzun (%s satır). Daha küçük parçalara bölün."
# ------------------------------------------------------------------------------------

LINE_KEYS = ["analysis_id", "file_idx"]
HITS = "array<struct<rule:string,line:int,col:int,text:string>>"
UNREAD = "unread"  # kind of the one hit of a file that cannot be read


def may_hit(content: Column, kind: str, max_statements: int = LONG_MAX_STATEMENTS) -> Column:
    """Whether the text can hold a hit of that kind; false means that it cannot."""
    if kind == "async_void":
        return content.contains("async") & content.contains("void")
    if kind == "literal":  # a digit that does not go on with a name
        return content.rlike("(?<![A-Za-z0-9_])[0-9]")
    if kind == "long_method":  # every statement ends in one of the two
        return F.length(content) - F.length(F.translate(content, ";}", "")) > max_statements
    return F.lit(True)


def positions(text: str | None, max_statements: int) -> list[tuple]:
    """Kind, 1-based line and column, and text of each hit; one of the kind
    `UNREAD` if the text cannot be read."""
    out, line, start = [], 1, 0
    try:
        for f in csharp.scan(text or "", max_statements):
            line += text.count("\n", start, f.at)
            start = f.at
            out.append((f.rule, line, f.at - text.rfind("\n", 0, f.at), f.text))
    except Exception as e:  # noqa: BLE001 - whatever a text provokes concerns its file only
        return [(UNREAD, 1, 1, type(e).__name__)]
    return out


def hits(content: Column, max_statements: int = LONG_MAX_STATEMENTS) -> Column:
    """Hits of R1-R3 in one file's text, in text order. A null text has none. The
    texts go to Python in Spark's batches of some rows, not in Arrow batches of
    64 MB, so a worker's memory does not grow with the input."""
    return F.udf(lambda t: positions(t, max_statements), HITS, useArrow=False)(content)


def _finding(
    rule_id: str, title: str, message: Column, severity: int, category: str, suggested_fix: Column | None = None
) -> Column:
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        F.lit(title).alias("title"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        (suggested_fix if suggested_fix is not None else F.lit(None).cast("string")).alias("suggested_fix"),
    )


def _async_void(h: Column) -> Column:
    return _finding(ASYNC_VOID_ID, ASYNC_VOID_TITLE, F.lit(ASYNC_VOID_MESSAGE), S.SEV_WARNING, ASYNC_VOID_CATEGORY, F.format_string(ASYNC_VOID_FIX, h["text"]))


def _magic_number(h: Column) -> Column:
    message, fix = (F.format_string(text, h["text"]) for text in (MAGIC_MESSAGE, MAGIC_FIX))
    return _finding(MAGIC_ID, MAGIC_TITLE, message, S.SEV_INFO, MAGIC_CATEGORY, fix)


def _long_method(h: Column) -> Column:
    return _finding(LONG_ID, LONG_TITLE, F.format_string(LONG_MESSAGE, h["text"]), S.SEV_WARNING, LONG_CATEGORY)


def _unread(h: Column) -> Column:
    return _finding(UNREAD_ID, UNREAD_TITLE, F.format_string(UNREAD_MESSAGE, h["text"]), S.SEV_ERROR, UNREAD_CATEGORY)


#: Kind of hit -> finding.
RULES: dict[str, Callable[[Column], Column]] = {
    "async_void": _async_void,
    "literal": _magic_number,
    "long_method": _long_method,
}


def run_rules(
    files: DataFrame,
    rules: Mapping[str, Callable[[Column], Column]] | None = None,
    literal_limit: int | None = None,
    max_statements: int = LONG_MAX_STATEMENTS,
    more: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """X3 + U1: findings of all rules over `files` (analysis_id, file_idx,
    file_path, content), as a bag. `literal_limit` keeps each file's first
    literals only (W1); by default all count. `more` are rules of other kinds,
    functions from the files to findings. A file that cannot be read has one
    finding, an Error with the id `UNREAD_ID`: without it the file would look
    like one that was read and has no findings."""
    rules = RULES if rules is None else rules
    makers = {**rules, UNREAD: _unread}
    wanted = F.filter(
        "_hits", lambda h: h["rule"].isin(*makers) & ~((h["rule"] == "literal") & h["text"].isin(*MAGIC_EXEMPT))
    )
    content, can = F.col("content"), F.lit(False)
    for kind in rules:
        can = can | may_hit(content, kind, max_statements)
    scanned = files.select(*LINE_KEYS, "file_path", hits(F.when(can, content), max_statements).alias("_hits"))
    scanned = scanned.select(*LINE_KEYS, "file_path", wanted.alias("_hits"))
    if literal_limit is not None:
        others = F.filter("_hits", lambda h: h["rule"] != "literal")
        first = F.slice(F.filter("_hits", lambda h: h["rule"] == "literal"), 1, literal_limit)
        scanned = scanned.withColumn("_hits", F.concat(others, first))
    h = F.col("_hit")
    made = None
    for kind, make in makers.items():
        made = F.when(h["rule"] == kind, make(h)) if made is None else made.when(h["rule"] == kind, make(h))
    # An inner explode lets Spark infer a filter on the hits, and so scan every text twice.
    found = scanned.select(*LINE_KEYS, "file_path", F.explode_outer("_hits").alias("_hit")).where(h.isNotNull()).withColumn("_f", made)
    out = found.select(
        *LINE_KEYS,
        "_f.rule_id",
        "_f.title",
        "_f.message",
        "_f.severity",
        "file_path",
        h["line"].alias("line_number"),
        h["col"].alias("column_number"),
        F.lit("").alias("code_snippet"),
        "_f.category",
        F.lit(None).cast("string").alias("description"),
        "_f.suggested_fix",
    )
    for rule in (more or {}).values():
        out = out.unionByName(rule(files))
    return out


def unread_files(files: DataFrame) -> DataFrame:
    """Files whose text the rules could not read, with the kind of error."""
    hit = F.col("_hits")[0]
    read = files.select(*LINE_KEYS, "file_path", hits(F.col("content")).alias("_hits")).where(F.size("_hits") == 1)
    return read.where(hit["rule"] == UNREAD).select(*LINE_KEYS, "file_path", hit["text"].alias("error"))


def unread_message(findings: DataFrame, key: str = "analysis_id") -> DataFrame:
    """R5 per analysis: which of its files the rules could not read, and why, as
    `unread`; analyses whose files were all read have no row."""
    mine = findings.where((F.col("rule_id") == UNREAD_ID) & (F.col("category") == UNREAD_CATEGORY))
    named = F.array_sort(F.collect_list(F.concat("file_path", F.lit(": "), "message")))
    return mine.groupBy(key).agg(F.array_join(named, "; ").alias("unread"))


def async_void(files: DataFrame) -> DataFrame:
    """Methods (not local functions) that are async and return void; Warning."""
    return run_rules(files, {"async_void": _async_void})


def magic_numbers(files: DataFrame, limit: int | None = None) -> DataFrame:
    """R2: numeric literals other than the exempt values; Info. W1: with `limit`
    the first ones of each file, in source order."""
    return run_rules(files, {"literal": _magic_number}, literal_limit=limit)


def long_methods(files: DataFrame, max_statements: int = LONG_MAX_STATEMENTS) -> DataFrame:
    """Methods whose block body has more statements of its own; Warning."""
    return run_rules(files, {"long_method": _long_method}, max_statements=max_statements)


def diagnostics(diags: DataFrame, files: DataFrame) -> DataFrame:
    """Diagnostics produced elsewhere -> findings.

    `diags`: analysis_id, file_idx, rule_id, title, message, severity (name),
    line0, col0 (0-based), category. Severity names map by F13, positions
    become 1-based and the snippet is the trimmed source line (F4), taken by
    an equi-join on the file; a diagnostic without its file or line keeps an
    empty snippet.
    """
    f = files.select(*LINE_KEYS, "file_path", "content")
    j = diags.join(f, LINE_KEYS, "left")
    return j.select(
        "analysis_id",
        "file_idx",
        "rule_id",
        "title",
        "message",
        L.severity_from_diagnostic(F.col("severity")).alias("severity"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        (F.col("line0") + 1).cast("int").alias("line_number"),
        (F.col("col0") + 1).cast("int").alias("column_number"),
        D.line_snippet(F.coalesce("content", F.lit("")), F.col("line0")).alias("code_snippet"),
        "category",
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("suggested_fix"),
    )


def analyze_diffs(
    diffs: DataFrame,
    diags: DataFrame | None = None,
    literal_limit: int | None = None,
    more: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Diffs (analysis_id, diff) -> findings of every rule over the C# files,
    plus ingested diagnostics. Non-C# files are skipped; a diff that yields no
    file simply yields no finding."""
    from revlens.operators import diffs as DF

    files = DF.csharp_files(DF.changed_files(diffs))
    return analyze_files(files, diags, literal_limit, more)


def analyze_files(
    files: DataFrame,
    diags: DataFrame | None = None,
    literal_limit: int | None = None,
    more: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """R5 over C# files (analysis_id, file_idx, file_path, content). The rules and
    the diagnostics read `files` once each, so it should be a stored table where
    the diffs are large."""
    found = run_rules(files, literal_limit=literal_limit, more=more)
    if diags is not None:
        found = found.unionByName(diagnostics(diags, files))
    return found


def finding_ids(findings: DataFrame) -> DataFrame:
    """Deterministic finding ids (T15): hash of analysis, file, rule, line, column."""
    return findings.withColumn(
        "id",
        F.sha2(
            F.concat_ws(
                "#",
                "analysis_id",
                F.col("file_idx").cast("string"),
                "rule_id",
                F.col("line_number").cast("string"),
                F.col("column_number").cast("string"),
                "message",
            ),
            256,
        ),
    )
