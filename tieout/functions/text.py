"""Codes, labels, note references, periods and formulas as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.literals import literal_map

CODE_FORMAT = r"^[0-9]+[A-Z]?$"

# Raw table kinds and their canonical names.
TABLE_TYPES = {
    "fs_balance_sheet": "FS_BALANCE_SHEET",
    "fs_income_statement": "FS_INCOME_STATEMENT",
    "fs_cash_flow": "FS_CASH_FLOW",
    "fs_equity": "FS_EQUITY",
    "generic_note": "GENERIC_NOTE",
    "tax_note": "TAX_NOTE",
    "unknown": "UNKNOWN",
}

# Patterns that carry a note number in a heading, by priority.
NOTE_NUMBER_PATTERNS = [
    r"(?iu)note\s+(\d+)",
    r"(?iu)thuyết minh\s*số\s*(\d+)",
    r"(?iu)thuyet minh\s*so\s*(\d+)",
    r"(?iU)\btm\.?\s*(?:số|so)?\s*(\d+)\b",
]

# Unit wording.
THOUSANDS_PATTERN = (
    "vnd\\s*['’]?\\s*000|vnd\\s*\\(\\s*000\\s*\\)|tri[eệ]u\\s*đồng|"
    "unit\\s*:\\s*vnd\\s*['’]?000|đơn\\s*vị\\s*:\\s*vnd\\s*['’]?000"
)
UNIT_PATTERN = r"\bvnd\b|unit\s*:\s*vnd\b|đơn\s*vị\s*:\s*vnd\b|đồng\s*$"


def normalize_code(c: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))


def normalize_code_keep_parens(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^0-9A-Za-z()]", ""))


def pad_code(c: Column) -> Column:
    """Statement codes: drop a trailing ``.0`` and pad one digit to two."""
    s = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.regexp_replace(s, r"^(\d)$", "0$1")


def valid_code(c: Column) -> Column:
    return F.coalesce(c.rlike(CODE_FORMAT), F.lit(False))


def normalize_label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def _nfkc(c: Column) -> Column:
    # defined inside so that it ships by value and executors need no local copy of this package
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.pandas_udf(fold, T.StringType())(c)


def normalize_note_text(c: Column) -> Column:
    """Trim and lower, then compatibility-normalise.

    Only text with characters that normalisation can change leaves the JVM.
    """
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.rlike(r"[^\x00-ɏḀ-ỿ]"), _nfkc(t)).otherwise(t)


def normalize_note_ref(c: Column) -> Column:
    """The first number without leading zeros; text without digits is kept."""
    digits = F.regexp_extract(c, r"\d+", 0)
    return F.when(digits == "", F.trim(c)).otherwise(
        F.regexp_replace(digits, r"^0+(?=\d)", "")
    )


def note_number_from_heading(c: Column) -> Column:
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in NOTE_NUMBER_PATTERNS]
    return F.coalesce(normalize_note_ref(F.coalesce(*found)), F.lit(""))


def unit_hint(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.rlike(THOUSANDS_PATTERN), "VND_000").when(t.rlike(UNIT_PATTERN), "VND").otherwise("")
    )


def period_key(c: Column) -> Column:
    """dd/mm/yyyy when the header holds a date, else its first four-digit year."""
    pattern = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"
    d1, d2, y = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(F.lpad(y, 4, "0"))
    date = F.concat_ws("/", F.lpad(d1, 2, "0"), F.lpad(d2, 2, "0"), year)
    return F.when(y != "", date).otherwise(F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")))


def has_year_pattern(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\d{4}|\d{1,2}/\d{1,2}/\d{2,4}"), F.lit(False))


def year_of(c: Column) -> Column:
    return F.regexp_extract(c, r"\d{4}", 0).try_cast("int")


def canonical_table_type(c: Column) -> Column:
    raw = F.trim(c)
    pairs = literal_map(TABLE_TYPES.items())
    return F.when(F.coalesce(raw, F.lit("")) == "", "UNKNOWN").otherwise(
        F.coalesce(F.try_element_at(pairs, F.lower(raw)), F.upper(raw))
    )


def table_slug(position: Column, heading: Column) -> Column:
    """``tbl_007_Trade_receivables`` from a one-based position and a heading."""
    safe = F.regexp_replace(
        F.coalesce(F.nullif(heading, F.lit("")), F.lit("unknown")), "[^A-Za-z0-9]", "_"
    )
    slug = F.regexp_replace(F.substring(safe, 1, 50), "^_+|_+$", "")
    slug = F.when(slug == "", "unnamed").otherwise(slug)
    return F.format_string("tbl_%03d_%s", position, slug)


def spreadsheet_safe(c: Column) -> Column:
    """Quote text that a spreadsheet would run as a formula; numbers stay as they are."""
    t = F.trim(c)
    number = F.translate(F.replace(t, F.lit("("), F.lit("-")), ",)", "")
    is_number = number.rlike(r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$")
    return F.when(t.rlike(r"^[=+\-@]") & ~is_number, F.concat(F.lit("'"), c)).otherwise(c)


def formula_target(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(\d{2})\s*=\s*([0-9\s+\-()]+)", 1), F.lit(""))


def formula_terms(label: Column) -> Column:
    """Signed child codes of ``30 = 20 + (21 - 22) - 25``; parentheses carry their sign.

    The tokens are folded with an accumulator of (sign stack, pending sign, terms).
    """
    rhs = F.replace(F.regexp_extract(label, r"(\d{2})\s*=\s*([0-9\s+\-()]+)", 2), F.lit(" "), F.lit(""))
    tokens = F.regexp_extract_all(rhs, F.lit(r"(\d{2}|\+|-|\(|\))"), 1)
    start = F.struct(
        F.array(F.lit(1)).alias("stack"),
        F.lit(1).alias("sign"),
        F.array().cast("array<string>").alias("terms"),
    )

    def step(acc: Column, tok: Column) -> Column:
        top = F.element_at(acc["stack"], -1)
        eff = top * acc["sign"]
        popped = F.when(
            F.size(acc["stack"]) > 1, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)
        ).otherwise(acc["stack"])
        is_code = tok.rlike(r"^\d{2}$")
        return F.struct(
            F.when(tok == "(", F.concat(acc["stack"], F.array(eff)))
            .when(tok == ")", popped)
            .otherwise(acc["stack"])
            .alias("stack"),
            F.when(tok == "-", -1).when(tok == ")", acc["sign"]).otherwise(1).alias("sign"),
            F.when(
                is_code,
                F.concat(acc["terms"], F.array(F.when(eff == 1, tok).otherwise(F.concat(F.lit("-"), tok)))),
            )
            .otherwise(acc["terms"])
            .alias("terms"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["terms"])


def flat_formula_terms(label: Column) -> Column:
    """Signed child codes right of ``=`` where no parentheses occur; letter suffixes allowed."""
    rhs = F.regexp_extract(label, r"=\s*([0-9A-Za-z+\-\s]+)", 1)
    tokens = F.regexp_extract_all(rhs, F.lit(r"[+\-]?\s*[0-9]+[A-Za-z]?"), 0)
    return F.transform(
        tokens, lambda t: F.regexp_replace(F.regexp_replace(t, r"\s", ""), r"^\+", "")
    )


def overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def _area(a: dict[str, Column]) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    inter = overlap_area(a, b)
    union = _area(a) + _area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def containment(inner: dict[str, Column], outer: dict[str, Column]) -> Column:
    inter = overlap_area(inner, outer)
    return F.when((inter > 0) & (_area(inner) > 0), inter / _area(inner)).otherwise(0.0)


def centre_inside(inner: dict[str, Column], outer: dict[str, Column]) -> Column:
    cx, cy = (inner["x1"] + inner["x2"]) / 2, (inner["y1"] + inner["y2"]) / 2
    return cx.between(outer["x1"], outer["x2"]) & cy.between(outer["y1"], outer["y2"])


def box_score(token: dict[str, Column], cell: dict[str, Column]) -> Column:
    return F.greatest(iou(token, cell), containment(token, cell) * 0.8)
