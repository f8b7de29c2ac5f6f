"""Column builders for review prompts and replies.

Prompt wording is our own; only the size limits and fallback texts are fixed
values. A text beyond a prompt's limit is asked in numbered parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import schemas as S

# --- fixed values ---------------------------------------------------------------
SUMMARY_LIMIT = 12000
ISSUES_LIMIT = 10000
REFACTOR_LIMIT = 8000
SECURITY_LIMIT = 8000
FALLBACK_LIMIT = 500
SUMMARY_UNCONFIGURED = "OpenAI integration is not configured."
SUMMARY_ERROR = "An error occurred during automated analysis."
SUMMARY_EMPTY = "Summary could not be generated."
DEFAULT_TITLE = "GPT Suggestion"
DEFAULT_DESCRIPTION = "No description"
DEFAULT_CATEGORY = "code_quality"
TEXT_TITLE = "GPT Analysis"
ERROR_TITLE = "GPT Analysis (Parse Error)"
TEXT_TAGS = ["gpt-analysis"]
ERROR_TAGS = ["gpt-analysis", "parse-error"]
SUMMARY_HEAD = "Review this pull request. Give a short summary, then numbered risks and improvements.\n\nTitle: "
SUMMARY_MID = "\n\nChanges:\n"
ISSUES_HEAD = 'List likely bugs and quality problems as JSON {"suggestions": [...]}.\n\nChanges:\n'
REFACTOR_HEAD = 'Suggest refactorings as JSON {"suggestions": [...]}.\n\nFile: '
REFACTOR_MID = "\nCode:\n"
SECURITY_HEAD = 'Point out security and concurrency hazards as JSON {"suggestions": [...]}.\n\nCode:\n'
TYPE_NAMES = {
    "potential_issue": 0,
    "refactor": 1,
    "performance": 2,
    "security": 3,
    "code_quality": 4,
    "best_practice": 5,
}
# ----------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(text, n: int) -> Column:
    """first n characters (code points, T11)."""
    return F.substring(_c(text), 1, n)


def parts_count(text, n: int) -> Column:
    """How many parts `text_parts` cuts: one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(_c(text), F.lit(""))) / F.lit(n))).cast("int")


def text_parts(text, n: int) -> Column:
    """The whole text as parts of n characters, the last one shorter; an empty
    or null text is one empty part."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.transform(F.sequence(F.lit(0), parts_count(text, n) - 1), lambda i: F.substring(t, i * n + 1, F.lit(n)))


def summary_prompt(diff, title) -> Column:
    """summary prompt for a diff or a part of one (see `prompts`)."""
    return F.concat(F.lit(SUMMARY_HEAD), F.coalesce(_c(title), F.lit("")), F.lit(SUMMARY_MID), F.coalesce(_c(diff), F.lit("")))


def issues_prompt(diff) -> Column:
    """potential-issue prompt, JSON reply requested."""
    return F.concat(F.lit(ISSUES_HEAD), F.coalesce(_c(diff), F.lit("")))


def refactor_prompt(code, file_name) -> Column:
    """refactoring prompt for one file."""
    return F.concat(F.lit(REFACTOR_HEAD), F.coalesce(_c(file_name), F.lit("")), F.lit(REFACTOR_MID), F.coalesce(_c(code), F.lit("")))


def security_prompt(code) -> Column:
    """security / concurrency prompt."""
    return F.concat(F.lit(SECURITY_HEAD), F.coalesce(_c(code), F.lit("")))


def prompts(text, build, limit: int, first_only: bool = False) -> Column:
    """F5 + F6: numbered prompts that cover the whole text in parts of `limit`
    characters: array of (part, parts, truncated, prompt). With `first_only` the
    text is cut at the limit instead, and `truncated` tells so."""
    parts = text_parts(text, limit)
    n = parts_count(text, limit)  # not the size of the parts, which would be cut again for each of them
    used = F.slice(parts, 1, 1) if first_only else parts
    return F.transform(
        used,
        lambda p, i: F.struct(
            (i + 1).alias("part"), n.alias("parts"), ((n > 1) & F.lit(first_only)).alias("truncated"), build(p).alias("prompt")
        ),
    )


def summary_text(reply, title, configured=True, failed=None) -> Column:
    """summary with the three fallbacks (unconfigured, error, empty reply)."""
    head = F.concat(F.lit("PR Title: "), F.coalesce(_c(title), F.lit("")), F.lit("\nSummary: "))
    configured = F.lit(configured) if isinstance(configured, bool) else _c(configured)
    failed = F.lit(False) if failed is None else _c(failed)
    return (
        F.when(~configured, F.concat(head, F.lit(SUMMARY_UNCONFIGURED)))
        .when(failed, F.concat(head, F.lit(SUMMARY_ERROR)))
        .otherwise(F.coalesce(_c(reply), F.lit(SUMMARY_EMPTY)))
    )


def extract_json(text) -> Column:
    """F8: first '{' to last '}' inclusive; null when absent or reversed."""
    t = _c(text)
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1  # 1-based index of the last '}'
    ok = (start > 0) & (F.instr(F.reverse(t), "}") > 0) & (end > start)
    return F.when(ok, F.substring(t, start, end - start + 1))


def parse_priority(p) -> Column:
    """case-insensitive priority name -> code; unknown or null -> Medium."""
    s = F.lower(_c(p))
    return (
        F.when(s == "critical", F.lit(S.PRI_CRITICAL))
        .when(s == "high", F.lit(S.PRI_HIGH))
        .when(s == "medium", F.lit(S.PRI_MEDIUM))
        .when(s == "low", F.lit(S.PRI_LOW))
        .otherwise(F.lit(S.PRI_MEDIUM))
    )


def parse_impact(v) -> Column:
    """integer text (surrounding whitespace and sign allowed) clamped to 1..10;
    null / empty / non-integer / out of int range -> 5."""
    n = F.regexp_replace(_c(v).cast("string"), r"^\s+|\s+$", "")
    n = F.when(n.rlike(r"^[+-]?\d+$"), n.try_cast("int"))
    return F.when(n.isNull(), F.lit(5)).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), n)))


def parse_type(t, default) -> Column:
    """snake_case suggestion type, case-insensitive; unknown / empty -> default."""
    s = F.lower(_c(t))
    expr = None
    for name, code in TYPE_NAMES.items():
        expr = F.when(s == name, F.lit(code)) if expr is None else expr.when(s == name, F.lit(code))
    default = F.lit(default) if isinstance(default, int) else _c(default)
    return expr.otherwise(default)
