"""Column builders over unified diff text.

All are higher-order / regex expressions evaluated inside one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
FILE_HEADER = "diff --git"
ADDED_MARK = "+"
NEW_FILE_MARK = "+++"
HUNK_HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# ----------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_blocks(diff) -> Column:
    """the diff cut before every line that starts with the file header.

    Text before the first header is returned as its own first element; callers
    drop elements that do not start with the header.
    """
    # Cut at the newline before each header (lines are '\n'-separated, as in
    # the reference); the regex engine only tests the lookahead at newlines.
    # Only a header with at least 4 space-separated tokens starts a file: a
    # shorter one is content-free and its lines stay with the current file,
    # which is then emitted once.
    return F.split(F.coalesce(_c(diff), F.lit("")), r"\n(?=diff --git(?:[^ \n]* ){2})")


def block_path(block, parity: bool = False) -> Column:
    """4th space-separated token of the header line with one `b/` prefix
    and a trailing CR removed. `parity=True` strips every leading b and /
    character instead (the reference's behaviour)."""
    header = F.split(_c(block), "\n")[0]
    tok = F.get(F.split(header, " "), 3)
    tok = F.regexp_replace(tok, r"\r$", "")
    return F.regexp_replace(tok, r"^[b/]+", "") if parity else F.regexp_replace(tok, r"^b/", "")


def added_lines(block) -> Column:
    """lines starting with '+' but not '+++', marker removed (array<string>)."""
    lines = F.split(_c(block), "\n")
    kept = F.filter(lines, lambda l: l.startswith(ADDED_MARK) & ~l.startswith(NEW_FILE_MARK))
    return F.transform(kept, lambda l: F.substring(l, 2, 1 << 30))


def added_text(block) -> Column:
    """the added lines joined, each followed by a newline (empty when none)."""
    a = added_lines(block)
    return F.when(F.size(a) > 0, F.concat(F.array_join(a, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def hunk_lines(block) -> Column:
    """F3 with hunk tracking: the added lines of a block with their line numbers in
    the real file, array<struct<line_number, text>>.

    Inside a hunk every line begins with ' ', '+', '-' or a backslash, so a line
    that begins with '@@ -' opens the next one, and the file's own '---' and '+++'
    lines stand before the first. The lines of the new file are those that are not
    removed (or a note); the header says where they start and how many they are,
    so text behind the last hunk is no content. An added `++i;` is kept.
    """
    hunks = F.filter(F.split(_c(block), r"\n(?=@@ -\d)"), lambda h: h.rlike(f"^{HUNK_HEADER}"))

    def added(hunk: Column) -> Column:
        lines = F.split(hunk, "\n")
        number = lambda n: F.nullif(F.regexp_extract(lines[0], HUNK_HEADER, n), F.lit("")).cast("int")
        own = F.filter(F.slice(lines, 2, F.size(lines)), lambda l: ~l.startswith("-") & ~l.startswith("\\"))
        own = F.slice(own, 1, F.coalesce(number(4), F.lit(1)))
        marked = F.transform(own, lambda l, i: F.struct((number(3) + i).alias("line_number"), F.substring(l, 2, 1 << 30).alias("text"), l.startswith(ADDED_MARK).alias("added")))
        return F.transform(F.filter(marked, lambda x: x["added"]), lambda x: F.struct(x["line_number"], x["text"]))

    return F.flatten(F.transform(hunks, added))


def trim_ws(c) -> Column:
    """Trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def line_snippet(content, n0) -> Column:
    """trimmed text of 0-based line n0 of `content`; '' when out of range."""
    lines = F.split(_c(content), "\n")
    return F.coalesce(trim_ws(F.get(lines, _c(n0).cast("int"))), F.lit(""))


def is_extension(path, ext: str = ".cs") -> Column:
    """Case-insensitive suffix test."""
    return F.lower(_c(path)).endswith(ext.lower())
