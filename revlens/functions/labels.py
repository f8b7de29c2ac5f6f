"""Column builders for enum labels and display captions (list/detail views).

All are plain Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import schemas as S


# --- fixed values: captions and limits --------------------------------------------
TITLE_LIMIT = 60
NO_TITLE = "Untitled Pull Request"
NO_REPO = "Unknown Repository"
QUALITY_BANDS = [(80, "excellent", "Excellent code quality"), (60, "good", "Good code quality"), (40, "fair", "Fair code quality")]
LOWEST_BAND = ("poor", "Needs improvement")
RISK_CLASSES = {"high": "high-risk", "medium": "medium-risk", "low": "low-risk"}
UNKNOWN_RISK = "unknown-risk"
STATUS_CLASSES = {
    "completed": "completed", "pending": "pending", "processing": "processing", "inprogress": "processing", "failed": "failed",
}
UNKNOWN_STATUS = "unknown"
QUEUE_EMPTY, QUEUE_ONE, QUEUE_MANY = "Queue is empty", "1 analysis waiting", " analyses waiting"
AGES = [(604_800, " week(s) ago"), (86_400, " day(s) ago"), (3_600, " hour(s) ago"), (60, " minute(s) ago")]  # seconds
AGE_NOW = "Just now"
DETAILS_STATUS = "completed"
DETAILS_READY, DETAILS_LATER = "View details", "Details available after completion"
# ----------------------------------------------------------------------------------


def _first_match(pairs, otherwise: str) -> Column:
    """The value of the first condition that holds."""
    expr = None
    for condition, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr.otherwise(F.lit(otherwise))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def enum_label(code, enum: str | dict) -> Column:
    """integer code -> label string (null for unknown codes)."""
    mapping = S.ENUMS[enum] if isinstance(enum, str) else enum
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.try_element_at(m, _c(code).cast("int"))


def enum_code(label, enum: str | dict) -> Column:
    """F14 inverse: label -> code, case-insensitive; null when unknown."""
    mapping = S.ENUMS[enum] if isinstance(enum, str) else enum
    m = F.create_map(*chain.from_iterable((F.lit(v.lower()), F.lit(k)) for k, v in mapping.items()))
    return F.try_element_at(m, F.lower(_c(label)))


def severity_from_diagnostic(sev) -> Column:
    """compiler severity name -> finding severity code (Hidden/other -> Info)."""
    s = F.lower(_c(sev))
    return (
        F.when(s == "error", F.lit(S.SEV_ERROR))
        .when(s == "warning", F.lit(S.SEV_WARNING))
        .otherwise(F.lit(S.SEV_INFO))
    )


def display_title(title) -> Column:
    """empty -> placeholder; longer than the limit -> its first characters + '...'."""
    t = _c(title)
    return (
        F.when(t.isNull() | (t == ""), F.lit(NO_TITLE))
        .when(F.length(t) > TITLE_LIMIT, F.concat(F.substring(t, 1, TITLE_LIMIT), F.lit("...")))
        .otherwise(t)
    )


def repo_short_name(repo) -> Column:
    """last '/' segment of the repository name; empty -> placeholder."""
    r = _c(repo)
    last = F.element_at(F.split(r, "/"), -1)
    return F.when(r.isNull() | (r == ""), F.lit(NO_REPO)).otherwise(last)


def quality_band(score) -> Column:
    """UI quality band."""
    return _first_match([(_c(score) >= least, band) for least, band, _ in QUALITY_BANDS], LOWEST_BAND[0])


def quality_description(score) -> Column:
    """caption text for the quality band."""
    return _first_match([(_c(score) >= least, text) for least, _, text in QUALITY_BANDS], LOWEST_BAND[1])


def risk_class(risk_label) -> Column:
    """CSS-like class of a risk label, case-insensitive, unknown fallback."""
    return _first_match([(F.lower(_c(risk_label)) == k, v) for k, v in RISK_CLASSES.items()], UNKNOWN_RISK)


def status_class(status_label) -> Column:
    """status class; 'inprogress' shows as processing."""
    return _first_match([(F.lower(_c(status_label)) == k, v) for k, v in STATUS_CLASSES.items()], UNKNOWN_STATUS)


def queue_caption(pending) -> Column:
    """queue caption for 0 / 1 / n waiting analyses."""
    p = _c(pending)
    many = F.concat(p.cast("string"), F.lit(QUEUE_MANY))
    return F.when(p == 0, F.lit(QUEUE_EMPTY)).when(p == 1, F.lit(QUEUE_ONE)).otherwise(many)


def relative_age(ts, as_of) -> Column:
    """truncating 'n unit(s) ago' caption of `ts` relative to `as_of`.

    Works in whole microseconds so the day/hour/minute cut-offs are exact.
    """
    us = F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))
    units = [(seconds * 1_000_000, caption) for seconds, caption in AGES]
    return _first_match([(us >= n, F.concat(F.floor(us / n).cast("string"), F.lit(caption))) for n, caption in units], AGE_NOW)


def details_available(status_label) -> Column:
    """Details are offered only for completed analyses (case-insensitive)."""
    return F.coalesce(F.lower(_c(status_label)) == DETAILS_STATUS, F.lit(False))


def details_caption(status_label) -> Column:
    """Caption next to the details button."""
    return F.when(details_available(status_label), F.lit(DETAILS_READY)).otherwise(F.lit(DETAILS_LATER))
