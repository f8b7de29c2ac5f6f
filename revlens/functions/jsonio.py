"""Packed JSON columns of the analysis row.

The stored analysis keeps findings and suggestions as JSON text, with the
property names and order of the entity classes, enums as integer codes and
nulls written out. The working form everywhere else is the exploded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens import schemas as S

# --- fixed values: stored property names, in declaration order --------------------
FINDING_KEYS = [
    ("Id", "id"),
    ("RuleId", "rule_id"),
    ("Title", "title"),
    ("Message", "message"),
    ("Severity", "severity"),
    ("FilePath", "file_path"),
    ("LineNumber", "line_number"),
    ("ColumnNumber", "column_number"),
    ("CodeSnippet", "code_snippet"),
    ("Category", "category"),
    ("Description", "description"),
    ("SuggestedFix", "suggested_fix"),
]
SUGGESTION_KEYS = [
    ("Id", "id"),
    ("Type", "type"),
    ("Title", "title"),
    ("Description", "description"),
    ("FilePath", "file_path"),
    ("LineNumber", "line_number"),
    ("StartLine", "start_line"),
    ("EndLine", "end_line"),
    ("CodeSnippet", "code_snippet"),
    ("OriginalCode", "original_code"),
    ("SuggestedCode", "suggested_code"),
    ("Priority", "priority"),
    ("Category", "category"),
    ("ImpactScore", "impact_score"),
    ("Tags", "tags"),
]
WRITTEN = {"ignoreNullFields": "false"}  # nulls are written out
# ----------------------------------------------------------------------------------


def _stored_schema(keys, schema: T.StructType) -> T.ArrayType:
    types = {f.name: f.dataType for f in schema.fields}
    return T.ArrayType(T.StructType([T.StructField(k, types[c]) for k, c in keys]))


FINDINGS_JSON_SCHEMA = _stored_schema(FINDING_KEYS, S.FINDING)
SUGGESTIONS_JSON_SCHEMA = _stored_schema(SUGGESTION_KEYS, S.SUGGESTION)


def _pack(rows: DataFrame, keys, schema: T.StructType, order: list[str], key: str) -> DataFrame:
    types = {f.name: f.dataType for f in schema.fields}
    cols = [
        (F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(k) for k, c in keys
    ]
    item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*cols).alias("v"))
    per = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return per.select(
        key,
        F.to_json(F.transform("_items", lambda x: x["v"]), WRITTEN).alias("json"),
    )


def pack_findings(findings: DataFrame, key: str = "analysis_id", order: list[str] | None = None) -> DataFrame:
    """S6 + A13: findings of each analysis as JSON text, in file then position order.

    One row per analysis: this is the stored column format (one PR's findings);
    analytics read the exploded findings table instead.
    """
    order = order or [c for c in ("file_idx", "file_path", "line_number", "column_number", "rule_id", "id") if c in findings.columns]
    return _pack(findings, FINDING_KEYS, S.FINDING, order, key).withColumnRenamed("json", "findings_json")


def pack_suggestions(suggestions: DataFrame, key: str = "analysis_id", order: list[str] | None = None) -> DataFrame:
    """S6 for suggestions."""
    order = order or [c for c in ("idx", "id") if c in suggestions.columns]
    return _pack(suggestions, SUGGESTION_KEYS, S.SUGGESTION, order, key).withColumnRenamed("json", "suggestions_json")


def _exact_case(c: Column, names: list[str]) -> Column:
    """Property names in the stored casing. A quoted name with a colon behind it
    cannot stand inside a JSON string, whose quotes are escaped."""
    out, known = c, "|".join(names)
    for n in names:
        out = F.regexp_replace(out, rf'"(?!{n}")(?i:{n})"\s*:', f'"{n}":')
    other = c.rlike(rf'"(?!(?:{known})")(?i:{known})"\s*:')
    return F.when(other, out).otherwise(c)


def _read(js, keys, schema: T.ArrayType) -> Column:
    """Stored JSON list -> array of structs. Property names match in any case (of
    several the last one counts), quotes must be double; empty or malformed text,
    text behind the list and values of a wrong type give []. Our own writer's
    texts are parsed once: the list, written again, is the same text, so nothing
    else has to be checked. Others get their names in the stored casing first.

    Of those the list is parsed as a property of an object that ends in another one: only
    if that is there, the list was read to its end."""
    c = F.col(js) if isinstance(js, str) else js
    names, texts = [k for k, _ in keys], [f.name for f in schema.elementType.fields if isinstance(f.dataType, T.StringType)]
    root = T.StructType([T.StructField("list", schema), T.StructField("end", T.IntegerType()), T.StructField("bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"}
    no_text = rf'"(?:{"|".join(texts)})"\s*:\s*(?!"|null\b)[^\s]'
    empty = F.array().cast(schema)

    def checked(t: Column) -> Column:
        parsed = F.from_json(F.concat(F.lit('{"list":'), t, F.lit(',"end":1}')), root, options)
        alone = F.json_array_length(F.concat(F.lit("["), t, F.lit(",0]"))) == 2
        return F.transform(
            F.array(parsed),
            lambda r: F.when(
                r["bad"].isNull() & (r["end"] == 1) & r["list"].isNotNull() & alone & ~t.rlike(no_text), F.filter(r["list"], lambda x: x.isNotNull())
            ).otherwise(empty),
        )[0]

    def others(t: Column) -> Column:
        return F.transform(F.transform(F.array(t), lambda x: _exact_case(x, names)), checked)[0]

    def read(t: Column) -> Column:
        own = lambda r: F.to_json(r, WRITTEN) == t
        return F.transform(F.array(F.from_json(t, schema)), lambda r: F.when(own(r), F.filter(r, lambda x: x.isNotNull())).otherwise(others(t)))[0]

    return F.coalesce(F.transform(F.array(c), read)[0], empty)


def read_findings(js) -> Column:
    """F16: stored findings JSON."""
    return _read(js, FINDING_KEYS, FINDINGS_JSON_SCHEMA)


def read_suggestions(js) -> Column:
    """F16 for suggestions."""
    return _read(js, SUGGESTION_KEYS, SUGGESTIONS_JSON_SCHEMA)


def clean_tags(tags) -> Column:
    """non-array -> [], blank tags dropped."""
    c = F.col(tags) if isinstance(tags, str) else tags
    return F.coalesce(
        F.filter(c, lambda t: t.isNotNull() & (F.regexp_replace(t, r"^\s+|\s+$", "") != "")),
        F.array().cast("array<string>"),
    )
