"""Column helpers that reproduce the shell tools' field and text rules with
built-in (JVM, codegen'd) expressions only."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def awk_field(col: str | Column, n: int, limit: int = 10) -> Column:
    """awk ``$n`` with the default separator: runs of blanks and tabs, leading and
    trailing ones ignored.

    Missing fields are NULL (awk prints an empty string; NULL keeps "absent"
    distinguishable from "empty").  The split stops after ``limit`` fields (the
    rest stays in the last one), so long tails are not cut up; the same ``limit``
    for every field of a line lets Catalyst share one split."""
    if n >= limit:
        limit = n + 1
    t = F.trim(_c(col), F.lit(" \t"))
    # no conditional around the split: Catalyst only shares subexpressions that are
    # always evaluated, and after trimming the only empty field is a blank line's
    return F.nullif(F.get(F.split(t, r"[ \t]+", limit), n - 1), F.lit(""))


def cut_field(col: str | Column, delim: str, n: int) -> Column:
    """``cut -f n -d delim``: a line without the delimiter comes back whole, a line
    with fewer than ``n`` fields gives an empty field.

    Implemented with ``substring_index`` (no array is built): the text before the
    n-th delimiter, then what follows the last delimiter in it."""
    c = _c(col)
    n_delims = (F.length(c) - F.length(F.replace(c, F.lit(delim), F.lit("")))) / len(delim)
    field = F.substring_index(F.substring_index(c, delim, n), delim, -1) if n > 1 else F.substring_index(c, delim, 1)
    return F.when(n_delims == 0, c).when(n_delims < n - 1, F.lit("")).otherwise(field)


def cut_from(col: str | Column, delim: str, n: int) -> Column:
    """``cut -f n- -d delim``: fields n..end, whole line when the delimiter is absent."""
    c = _c(col)
    pattern = "^" + ("[^" + re.escape(delim) + "]*" + re.escape(delim)) * (n - 1)
    return F.when(F.instr(c, delim) == 0, c).otherwise(F.regexp_replace(c, pattern, ""))


def replace_first(col: str | Column, pattern: str, replacement: str) -> Column:
    """``sed s/pattern/replacement/`` (no ``g``): only the first match changes.

    ``regexp_replace`` alone replaces every match, so the prefix before the first
    match is captured lazily and kept."""
    return F.regexp_replace(_c(col), "^(.*?)" + pattern, "$1" + replacement.replace("$", "\\$"))


def strip_request_id(col: str | Column) -> Column:
    """Remove the first `` request_id="..."`` from a log message."""
    return replace_first(col, r' request_id="[^"]*"', "")


def matches_any(col: str | Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """True when the text matches any of the (Java) regular expressions."""
    pats = list(patterns)
    if not pats:
        return F.lit(False)
    rx = "|".join(f"(?:{p})" for p in pats)
    if ignore_case:
        rx = "(?i)" + rx
    return F.coalesce(_c(col).rlike(rx), F.lit(False))


def contains_any(col: str | Column, literals: Iterable[str], ignore_case: bool = False) -> Column:
    """True when the text contains any of the literal strings (``fgrep -e``)."""
    return matches_any(col, [re.escape(s) for s in literals], ignore_case)


def flag_keywords(df, col: str, rules: dict[str, Iterable[str]], ignore_case: bool = True):
    """Add one boolean ``flag_<name>`` column per rule (a rule = list of regexes).

    Terminal highlighting in the reports becomes a predicate column."""
    out = df
    for name, pats in rules.items():
        out = out.withColumn(f"flag_{name}", matches_any(col, pats, ignore_case))
    return out


def substring_from(col: str | Column, pos: int) -> Column:
    """Everything from character ``pos`` (1-based) on, however long the text is."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, F.lit(pos), F.length(c))
