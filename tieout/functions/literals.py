"""Long literal lists as single expressions.

A Column built from hundreds of small literals costs a round trip to the JVM per literal; one SQL
text costs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def literal_map(pairs) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs) + ")")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when the text contains any of the words, as one pattern of quoted alternatives."""
    return c.rlike("|".join(f"\\Q{w}\\E" for w in words))
