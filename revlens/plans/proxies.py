"""Driver-table proxies: the review domain derived from the given tables.

orders ⋈ customer -> analyses, lineitem -> findings / suggestions,
events -> webhooks / job events / notifications. Every view is a lazy
DataFrame over the parquet scan, so filters and column pruning reach the scan.
`SQL_VIEWS` holds the same derivations as DuckDB CTE bodies for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPOS = 20  # analyses are spread over org/repo-0 .. org/repo-19
NOTIFIED = 500  # notifications go to the analyses 0 .. 499
PR_SLOTS = 20  # webhook PR numbers are props.k % 20 + 1; job slots props.k % 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(c: str):
    return F.col(c).cast("timestamp")


def analyses(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit(2))
        .when(F.col("o_orderstatus") == "O", F.lit(1))
        .when(F.col("o_orderstatus") == "P", F.lit(0))
    )
    # Titles: some longer than the display limit, some empty.
    title = (
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(""))
        .when(F.col("o_orderkey") % 7 == 0, F.repeat(F.concat(F.col("o_orderpriority"), F.lit(" ")), 9))
        .otherwise(F.col("o_orderpriority"))
    )
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("org/repo-"), (F.col("o_custkey") % REPOS).cast("string")).alias("repo_name"),
        F.col("o_orderkey").cast("int").alias("pr_number"),
        title.alias("pr_title"),
        F.col("c_name").alias("pr_author"),
        F.concat(
            F.lit("1. Status: "), F.col("o_orderstatus"), F.lit("\n2. Priority: "), F.col("o_orderpriority")
        ).alias("summary"),
        F.lit(0).alias("quality_score"),
        F.lit("[]").alias("findings_json"),
        F.lit("[]").alias("suggestions_json"),
        F.lit(0).alias("risk_level"),
        _ts("o_orderdate").alias("processed_at"),
        F.lit("").alias("raw_diff"),
        status.alias("status"),
        _ts("o_orderdate").alias("created_at"),
        _ts("o_orderdate").alias("updated_at"),
    )


def findings(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    sev = (
        F.when(F.col("l_returnflag") == "R", F.lit(2))
        .when(F.col("l_returnflag") == "A", F.lit(1))
        .when(F.col("l_returnflag") == "N", F.lit(0))
    )
    rule = F.concat(F.lit("CV"), F.lpad((F.col("l_suppkey") % 4).cast("string"), 4, "0"))
    return li.select(
        F.col("l_orderkey").alias("analysis_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        rule.alias("rule_id"),
        F.concat(F.lit("Rule "), rule).alias("title"),
        F.concat(F.lit("quantity "), F.col("l_quantity").cast("int").cast("string")).alias("message"),
        sev.alias("severity"),
        (F.col("l_suppkey") % 3).cast("int").alias("file_idx"),
        F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".cs")).alias("file_path"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.lit(1).alias("column_number"),
        F.lit("").alias("code_snippet"),
        F.concat(F.lit("Status"), F.col("l_linestatus")).alias("category"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("suggested_fix"),
    )


def suggestions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("int") % 5
    return li.select(
        F.col("l_orderkey").alias("analysis_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.lit(0).alias("type"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("title"),
        F.lit("No description").alias("description"),
        F.lit("mixed").alias("file_path"),
        F.when(q != 4, q).cast("int").alias("priority"),
        F.lit("code_quality").alias("category"),
        (F.col("l_quantity").cast("int") % 10 + 1).cast("int").alias("impact_score"),
    )


def webhook_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flat webhook facts per event (before JSON encoding)."""
    ev = table(spark, d, "events")
    action = (
        F.when(F.col("event_type") == "signup", F.lit("opened"))
        .when(F.col("event_type") == "click", F.lit("synchronize"))
        .when(F.col("event_type") == "view", F.lit("reopened"))
        .when(F.col("event_type") == "error", F.lit("closed"))
        .when(F.col("event_type") == "purchase", F.lit("edited"))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("seq"),
        _ts("ts").alias("ts"),
        action.alias("action"),
        F.concat(F.lit("org/r"), F.col("user_id").cast("string")).alias("repo_name"),
        (k % PR_SLOTS + 1).cast("int").alias("pr_number"),
        F.concat(F.lit("PR "), F.col("event_id").cast("string")).alias("pr_title"),
        F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("pr_author"),
    )


def job_events(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    kind = (
        F.when(F.col("event_type") == "signup", F.lit("enqueue"))
        .when(F.col("event_type") == "click", F.lit("dequeue"))
        .when(F.col("event_type") == "view", F.lit("complete"))
        .when(F.col("event_type") == "error", F.lit("fail"))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % PR_SLOTS).cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        _ts("ts").alias("ts"),
        kind.alias("kind"),
        F.when(kind == "fail", F.concat(F.lit("diff not readable, event "), F.col("event_id").cast("string"))).alias("message"),
    ).filter(F.col("kind").isNotNull())


def notifications(spark: SparkSession, d: str) -> DataFrame:
    """Notifications, many to one analysis: event_id modulo NOTIFIED (some dangle)."""
    ev = table(spark, d, "events")
    ntype = (
        F.when(F.col("event_type") == "signup", F.lit(0))
        .when(F.col("event_type") == "view", F.lit(1))
        .when(F.col("event_type") == "error", F.lit(2))
        .otherwise(F.lit(3))
    )
    return ev.select(
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("id"),
        (F.col("event_id") % NOTIFIED).alias("analysis_id"),
        F.concat(F.lit("event "), F.col("event_type")).alias("message"),
        ntype.alias("type"),
        (F.col("value") > 100).alias("is_read"),
        _ts("ts").alias("created_at"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins of the views above (CTE bodies).
SQL_VIEWS: dict[str, str] = {
    "v_analyses": """
        SELECT o.o_orderkey AS id,
               'org/repo-' || CAST(o.o_custkey % 20 AS VARCHAR) AS repo_name,
               CAST(o.o_orderkey AS INTEGER) AS pr_number,
               CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 7 = 0 THEN repeat(o.o_orderpriority || ' ', 9)
                    ELSE o.o_orderpriority END AS pr_title,
               c.c_name AS pr_author,
               '1. Status: ' || o.o_orderstatus || chr(10) || '2. Priority: ' || o.o_orderpriority AS summary,
               CASE o.o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 WHEN 'P' THEN 0 END AS status,
               CAST(o.o_orderdate AS TIMESTAMP) AS processed_at,
               CAST(o.o_orderdate AS TIMESTAMP) AS created_at
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v_findings": """
        SELECT l_orderkey AS analysis_id,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
               'CV' || lpad(CAST(l_suppkey % 4 AS VARCHAR), 4, '0') AS rule_id,
               'Rule CV' || lpad(CAST(l_suppkey % 4 AS VARCHAR), 4, '0') AS title,
               'quantity ' || CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS message,
               CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS severity,
               CAST(l_suppkey % 3 AS INTEGER) AS file_idx,
               'src/' || CAST(l_partkey AS VARCHAR) || '.cs' AS file_path,
               CAST(l_linenumber AS INTEGER) AS line_number,
               'Status' || l_linestatus AS category
        FROM lineitem""",
    "v_suggestions": """
        SELECT l_orderkey AS analysis_id,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id,
               'Part ' || CAST(l_partkey AS VARCHAR) AS title,
               CAST(nullif(CAST(trunc(l_quantity) AS INTEGER) % 5, 4) AS INTEGER) AS priority,
               CAST(CAST(trunc(l_quantity) AS INTEGER) % 10 + 1 AS INTEGER) AS impact_score
        FROM lineitem""",
    "v_webhooks": """
        SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'signup' THEN 'opened' WHEN 'click' THEN 'synchronize'
                    WHEN 'view' THEN 'reopened' WHEN 'error' THEN 'closed'
                    WHEN 'purchase' THEN 'edited' END AS action,
               'org/r' || CAST(user_id AS VARCHAR) AS repo_name,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 + 1 AS INTEGER) AS pr_number,
               'PR ' || CAST(event_id AS VARCHAR) AS pr_title,
               'user' || CAST(user_id % 7 AS VARCHAR) AS pr_author
        FROM events""",
    "v_job_events": """
        SELECT * FROM (
          SELECT CAST(user_id AS VARCHAR) || '-' ||
                   CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS VARCHAR) AS job_id,
                 event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
                 CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'dequeue'
                      WHEN 'view' THEN 'complete' WHEN 'error' THEN 'fail' END AS kind,
                 CASE event_type WHEN 'error' THEN 'diff not readable, event ' || CAST(event_id AS VARCHAR) END AS message
          FROM events) WHERE kind IS NOT NULL""",
    "v_notifications": """
        SELECT 'n' || CAST(event_id AS VARCHAR) AS id,
               event_id % 500 AS analysis_id,
               'event ' || event_type AS message,
               CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS type,
               value > 100 AS is_read,
               CAST(ts AS TIMESTAMP) AS created_at
        FROM events""",
}


def sql_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause defining the named proxy views (and extra CTEs, in order)."""
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v})")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------------------
# documents -> unified diffs: the text as comment lines, then C# lines by
# doc_id % 6 ({id} is the doc id).
CODE_LINES = {
    0: ["public async void Handle{id}() {", "    await Task.Delay(250);", "    async void Local() { }", "}"],
    1: ["var a = {id};", "var b = 1e-5 + 6.02e+23 + .5 + 1.50;", "var c = arr[3..7];", 'var s = $"{n + 42} 43 {{44}}";'],
    2: [
        "const int Limit = 1024;", "/* block 5", "   still 6 */ int x = 7;", 'var v = @"a', '  8 "" 9";',
        "var ok = 0 + 1 + 2 + 10 + 100 + 1.0 + 100L + 0x0A;",
    ],
    3: ["// retry 7 times", 'var s = "code 55";', "var c = '9';", "Log(12, 12);"],
    4: ["class C{id} {", "    void Long(", "        int a = 5)", "    {"]
    + ["        step(); step();"] * 24
    + ["        if (a > 3) { step(); }", "        else { step(); }", "        await Foo(6)", "            .Bar();"]
    + ["        void L() { step(); }", "    }", "}"],
    5: ["void Even() {"] + ["    if (a)", "    {", "        x();", "    }", "    else", "    {", "        y();", "    }"] * 26 + ["}"],
}
#: What the rules have to find in them, by hand: doc_id % 6, line, column, rule, value.
EXPECTED = [
    (0, 1, 1, "async", "Handle{id}"), (0, 2, 22, "magic", "250"),
    (1, 1, 9, "magic", "{id}"), (1, 2, 9, "magic", "1E-05"), (1, 2, 16, "magic", "6.02E+23"), (1, 2, 27, "magic", "0.5"),
    (1, 2, 32, "magic", "1.5"), (1, 3, 13, "magic", "3"), (1, 3, 16, "magic", "7"), (1, 4, 16, "magic", "42"),
    (2, 1, 19, "magic", "1024"), (2, 3, 23, "magic", "7"),
    (3, 4, 5, "magic", "12"), (3, 4, 9, "magic", "12"),
    (4, 2, 5, "long", "51"), (4, 3, 17, "magic", "5"), (4, 29, 17, "magic", "3"), (4, 31, 19, "magic", "6"),
]


def _code_lines(doc_id):
    sid = doc_id.cast("string")
    m = doc_id % 6
    expr = None
    for k, lines in CODE_LINES.items():
        arr = F.array(*[F.replace(F.lit(ln), F.lit("{id}"), sid) for ln in lines])
        expr = F.when(m == k, arr) if expr is None else expr.when(m == k, arr)
    return expr


def diffs(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    sid = F.col("doc_id").cast("string")
    lines = F.split(F.col("text"), "\n")
    body = F.array_join(
        F.transform(lines, lambda ln, i: F.concat(F.when(i % 4 == 3, F.lit(" ")).otherwise(F.lit("+// ")), ln)), "\n"
    )
    code = F.array_join(F.transform(_code_lines(F.col("doc_id")), lambda c: F.concat(F.lit("+"), c)), "\n")
    cs_path = F.concat(F.lit("src/Doc"), sid, F.lit(".cs"))
    cs = F.concat_ws(
        "\n",
        F.concat(F.lit("diff --git a/"), cs_path, F.lit(" b/"), cs_path),
        F.lit("index 0000000..1111111 100644"),
        F.concat(F.lit("--- a/"), cs_path),
        F.concat(F.lit("+++ b/"), cs_path),
        F.lit("@@ -0,0 +1 @@"),
        body,
        code,
    )
    md_path = F.concat(F.lit("docs/Doc"), sid, F.lit(".md"))
    md = F.when(
        F.col("doc_id") % 3 == 0,
        F.concat_ws(
            "\n",
            F.concat(F.lit("diff --git a/"), md_path, F.lit(" b/"), md_path),
            F.concat(F.lit("+++ b/"), md_path),
            F.concat(F.lit("+# Doc "), sid),
            F.concat(F.lit("+"), F.col("lang")),
        ),
    )
    keyed = doc.select(
        sid.alias("analysis_id"),
        F.lit("org/docs").alias("repo_name"),
        F.col("doc_id").cast("int").alias("pr_number"),
        "doc_id",
        "text",
        "lang",
    )
    return keyed.select(
        "analysis_id",
        "repo_name",
        "pr_number",
        F.concat_ws("\n", F.lit("From: review-bot"), cs, md).alias("diff"),
    )


def hunk_diffs(spark: SparkSession, d: str) -> DataFrame:
    """documents -> diffs of one file with two hunks: the text's lines as context
    (i % 4 = 3), removed (2) or added lines, added lines that begin with '++' or
    '--', and a mail signature behind the last hunk."""
    sid = F.col("doc_id").cast("string")
    lines = F.split("text", "\n")
    removed = F.floor((F.size(lines) + 1) / 4)
    both = F.size(F.filter(lines, lambda _, i: i % 4 == 3))
    mark = lambda i: F.when(i % 4 == 3, " ").when(i % 4 == 2, "-").otherwise("+")
    body = F.array_join(F.transform(lines, lambda ln, i: F.concat(mark(i), ln)), "\n")
    first = F.concat(F.lit("@@ -10,"), (removed + both).cast("string"), F.lit(" +20,"), (F.size(lines) - removed + 2).cast("string"), F.lit(" @@ class X"))
    path = F.concat(F.lit("src/H"), sid, F.lit(".cs"))
    header = [F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path)]
    rest = ["+++i;", "+--j;", "@@ -500 +600,2 @@", "-old", "+++k;", "\\ No newline at end of file", "+last", "-- ", "2.40.1", "+not content"]
    return table(spark, d, "documents").select(sid.alias("analysis_id"), F.concat_ws("\n", *header, first, body, *map(F.lit, rest)).alias("diff"))


def diagnostics_input(spark: SparkSession, d: str) -> DataFrame:
    """Compiler diagnostics produced elsewhere: one per document."""
    doc = table(spark, d, "documents")
    sev = F.element_at(F.array(*[F.lit(s) for s in ("Error", "Warning", "Info", "Hidden")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return doc.select(
        F.col("doc_id").cast("string").alias("analysis_id"),
        F.lit(0).alias("file_idx"),
        F.concat(F.lit("CS"), (F.col("doc_id") % 50 + 1000).cast("string")).alias("rule_id"),
        F.lit("Syntax").alias("title"),
        F.concat(F.lit("diagnostic "), F.col("doc_id").cast("string")).alias("message"),
        sev.alias("severity"),
        (F.col("doc_id") % 7).cast("int").alias("line0"),
        (F.col("doc_id") % 3).cast("int").alias("col0"),
        F.lit("Compiler").alias("category"),
    )


def _sql_code_case() -> str:
    parts = []
    for k, lines in CODE_LINES.items():
        items = ", ".join("replace(" + _sql_str(ln) + ", '{id}', CAST(doc_id AS VARCHAR))" for ln in lines)
        parts.append(f"WHEN {k} THEN [{items}]")
    return "CASE doc_id % 6 " + " ".join(parts) + " END"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_VIEWS.update(
    {
        "v_docs": "SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents",
        "v_text_lines": """
            SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
              SELECT doc_id, '// ' || unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM v_docs)
            WHERE i % 4 <> 3""",
        "v_code_only": f"""
            SELECT doc_id, unnest(cl) AS line, generate_subscripts(cl, 1) AS j
            FROM (SELECT doc_id, {_sql_code_case()} AS cl FROM v_docs)""",
        "v_lines": """
            SELECT CAST(doc_id AS VARCHAR) AS analysis_id, 0 AS file_idx,
                   'src/Doc' || CAST(doc_id AS VARCHAR) || '.cs' AS file_path,
                   CAST(n AS INTEGER) AS line_number, line AS text FROM v_text_lines
            UNION ALL
            SELECT CAST(c.doc_id AS VARCHAR), 0, 'src/Doc' || CAST(c.doc_id AS VARCHAR) || '.cs',
                   CAST(k.cnt + c.j AS INTEGER), c.line
            FROM v_code_only c JOIN (SELECT doc_id, count(*) AS cnt FROM v_text_lines GROUP BY doc_id) k
              ON k.doc_id = c.doc_id""",
    }
)


def _sql_diff_text() -> str:
    """The text of `diffs` in SQL, written out from its layout."""
    cs = "'src/Doc' || CAST(doc_id AS VARCHAR) || '.cs'"
    md = "'docs/Doc' || CAST(doc_id AS VARCHAR) || '.md'"
    nl = " || chr(10) || "
    code_file = nl.join(
        [
            "'From: review-bot'",
            f"'diff --git a/' || {cs} || ' b/' || {cs}",
            "'index 0000000..1111111 100644'",
            f"'--- a/' || {cs}",
            f"'+++ b/' || {cs}",
            "'@@ -0,0 +1 @@'",
            "array_to_string(list_transform(ls, lambda x, i: CASE WHEN i % 4 = 0 THEN ' ' || x ELSE '+// ' || x END), chr(10))",
            "array_to_string(list_transform(cl, lambda x: '+' || x), chr(10))",
        ]
    )
    text_file = nl.join(
        [f"'diff --git a/' || {md} || ' b/' || {md}", f"'+++ b/' || {md}", "'+# Doc ' || CAST(doc_id AS VARCHAR)", "'+' || lang"]
    )
    return f"""SELECT doc_id, {code_file} || CASE WHEN doc_id % 3 = 0 THEN chr(10) || {text_file} ELSE '' END AS diff
               FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls, {_sql_code_case()} AS cl FROM documents)"""


SQL_DIFF_TEXT = _sql_diff_text()
