"""Amount parsing and amount arithmetic as column expressions (no UDFs).

Each parser is written as a chain of single-reference ``regexp_replace`` calls so
the expression tree stays small and the whole parse runs inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_GROUPED = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
PLAIN = rf"^-?{_GROUPED}$"
#: A plain number in parentheses, or behind a word, or in front of a minus sign.
MARKED = rf"^(?:\({_GROUPED}\)|(?:[A-Za-z]+ )?{_GROUPED}(?: -)?)\z"
#: Thousands marked by dots in front of a decimal comma, or by spaces in a whole number.
SWAPPED = r"^\d{1,3}(?:(?:\.\d{3})+,\d+|(?:[ \u00a0]\d{3})+)\z"
MAX_PARSE_LENGTH = 1000
MAX_ABS_AMOUNT = 1e15


def strict_double(c: Column) -> Column:
    """Cast only plain decimal notation; '12d', 'nan' and 'inf' become NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_simple(c: Column) -> Column:
    """Drop thousands commas, read parentheses as a minus sign; NULL when not a number."""
    s = F.translate(F.replace(c, F.lit("("), F.lit("-")), ",)", "")
    return strict_double(s)


def parse_amount(c: Column) -> Column:
    """Locale-tolerant amount parse; NULL for blanks, dashes and junk.

    Usual notations take a pattern test or two, text without digits is no amount; only the rest pays for the chain.
    """
    plain = F.replace(c, F.lit(","), F.lit("")).try_cast("double")
    size = F.replace(F.regexp_extract(c, _GROUPED, 0), F.lit(","), F.lit("")).try_cast("double")
    marked = F.when(c.startswith("(") | c.endswith("-"), -size).otherwise(size)
    swapped = F.translate(c, ",. \u00a0", ".").try_cast("double")
    return (
        F.when(c.rlike(PLAIN), plain).when(~c.rlike("[0-9]"), None).when(c.rlike(MARKED), marked).when(c.rlike(SWAPPED), swapped)
        .otherwise(_parse_messy(c))
    )


def _parse_messy(c: Column) -> Column:
    """The full parse as one chain, each step reading the text once.

    Where both separators occur, the last one is the decimal mark; it is parked as one of two
    private characters so that the later steps can tell both readings from plain thousands marks.
    """
    comma_mark, dot_mark, last_dot = "\ue001", "\ue002", "\ue003"
    s = F.translate(c, "\u00a0\u202f\u2009\u2212\u200b\u200c\u200d\ufeff", "   -")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    s = F.regexp_replace(s, r"^\(\s*(.*?)\s*\)$|^[-\u2013\u2014]+$", "-$1")
    s = F.trim(F.regexp_replace(s, "[A-Za-z\u00c0-\u024f'\u2019\"\u20ab$\u20ac]+", ""))
    s = F.regexp_replace(s, r"^([^-].*?)\s*-$", "-$1")
    s = F.regexp_replace(s, r"\s*%$", "")
    s = F.regexp_replace(s, r"^(?=[^,]*\.)(.*),([^.,]*)$", f"$1{comma_mark}$2")
    s = F.regexp_replace(s, r"^(?=[^.]*,)(.*)\.([^.,]*)$", f"$1{dot_mark}$2")
    # thousands marks in front of a parked decimal mark; spaces only where none is parked
    s = F.regexp_replace(s, rf"\.(?=.*{comma_mark})|,(?=.*{dot_mark})| (?!.*[{comma_mark}{dot_mark}])", "")
    s = F.regexp_replace(s, r"^([\d-]*\d[\d-]*),(\d{3})$", "$1$2")
    s = F.regexp_replace(s, r"^([^,.]*),([^,.]*)$", "$1.$2")
    # repeated marks of one kind are thousands marks; the last of several dots is parked to tell it from a single one
    s = F.regexp_replace(s, rf"^(?!.*[{comma_mark}{dot_mark}])(.*\..*)\.([^.]*)$", f"$1{last_dot}$2")
    s = F.regexp_replace(s, rf"\.(?=.*{last_dot})|{last_dot}|,(?!.*[{comma_mark}{dot_mark}])", "")
    return F.translate(s, f"{comma_mark}{dot_mark}()", "..").try_cast("double")


def parse_bounded(c: Column) -> Column:
    """Like :func:`parse_amount`, but 0 for NULL, over-long text and absurd magnitudes."""
    v = parse_amount(c)
    # the parsed value comes first so that codegen evaluates it once for both uses
    keep = (F.abs(v) <= MAX_ABS_AMOUNT) & (F.length(c) <= MAX_PARSE_LENGTH)
    return F.coalesce(F.when(keep, v), F.lit(0.0))


def parse_rule_amount(c: Column) -> Column:
    """The rules' parse: parentheses or a leading minus negate; anything unreadable is 0."""
    s = F.trim(c)
    negative = s.startswith("-") | (s.startswith("(") & s.endswith(")"))
    body = F.regexp_replace(s, r"^(?:\((.*)\)|-(.*))$", "$1$2")
    body = F.translate(body, ", ", "")
    v = strict_double(body)
    return F.coalesce(F.when(negative, -v).otherwise(v), F.lit(0.0))


def is_year_like(v: Column) -> Column:
    """A whole number between 1900 and 2100; NULL is not a year."""
    return F.coalesce(v.between(1900, 2100) & (F.floor(v) == v), F.lit(False))


def valid_percentage(v: Column, allow_over_100: bool = True) -> Column:
    ok = (v >= 0) if allow_over_100 else v.between(0, 100)
    return F.coalesce(ok, F.lit(False))


def valid_range(v: Column, low: float | None = None, high: float | None = None) -> Column:
    ok = v.isNotNull()
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.coalesce(ok, F.lit(False))


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(default))


def pct_change(current: Column, previous: Column) -> Column:
    """Percentage change; from a zero base it is +inf for growth and 0 otherwise."""
    return (
        F.when(previous == 0, F.when(current > 0, F.lit(float("inf"))).otherwise(0.0))
        .otherwise((current - previous) / F.abs(previous) * 100)
    )


def format_amount(v: Column, decimals: int = 0) -> Column:
    return F.format_number(v, decimals)


def round_amount(v: Column, precision: int = 2) -> Column:
    """Half-even rounding."""
    return F.bround(v, precision)


def rounds_to_zero(diff: Column) -> Column:
    """``abs(round(diff)) == 0`` under half-even rounding."""
    return F.abs(diff) <= 0.5
