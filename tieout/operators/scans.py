"""Ordered scans (running sums, carry-forward, previous row) that survive a hot group.

A plain ``Window.partitionBy(table).orderBy(row)`` sends a whole table to one task.
Here each group is cut into chunks of consecutive rows; a window runs inside each
chunk, one summary row per chunk is scanned across chunks, and both are combined.
The widest single task then sees ``chunk_rows`` rows, or one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.session import checkpoint, deal, stored_by_group

CHUNK_ROWS = 65_536


class Scan:
    """One output column of :func:`scan`.

    kind: ``sum``, ``count``, ``max``, ``min``, ``last`` (last non-NULL) or ``lag``
    (the neighbouring row's value, NULLs kept). ``inclusive`` says whether the
    current row takes part; ``lag`` never includes it.
    """

    def __init__(self, name: str, kind: str, value: Column | str, inclusive: bool = True):
        self.name, self.kind, self.inclusive = name, kind, inclusive and kind != "lag"
        self.value = F.col(value) if isinstance(value, str) else value


def _local(kind: str, v: Column) -> Column:
    return {
        "sum": F.sum(v),
        "count": F.count(v),
        "max": F.max(v),
        "min": F.min(v),
        "last": F.last(v, ignorenulls=True),
        "lag": F.last(v, ignorenulls=False),
    }[kind]


def _combine(kind: str, before: Column, local: Column, has_local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull() & local.isNull(), None).otherwise(
            F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "max":
        return F.greatest(before, local)
    if kind == "min":
        return F.least(before, local)
    if kind == "last":
        return F.coalesce(local, before)
    return F.when(has_local, local).otherwise(before)


def one_chunk(df: DataFrame, order: str = "row_idx", chunk_rows: int = CHUNK_ROWS) -> bool:
    """Whether all positions lie in the first chunk, so that a group is no more work than a chunk.

    One job over the positions alone; on stored rows it reads little more than their bounds.
    """
    return df.where((F.col(order) >= chunk_rows) | (F.col(order) < 0)).isEmpty()


def table_first(keys: Sequence[str]) -> list[str]:
    """Keys for a sort, which compares the first one alone as long as it differs: a document has many tables."""
    keys = list(keys)
    return ["table_idx", "doc_id", *keys[2:]] if keys[:2] == ["doc_id", "table_idx"] else keys


def groups_fit(df: DataFrame, keys: Sequence[str], limit: int = CHUNK_ROWS // 8) -> bool:
    """Whether no group has more than ``limit`` rows. One job over the keys."""
    return df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()


def stored(df: DataFrame, keys: Sequence[str], order: str = "row_idx", chunk_rows: int = CHUNK_ROWS, dealt: int | None = None) -> DataFrame:
    """A checkpoint of rows that several steps read group by group: in buckets of ``keys`` where no group is larger than a chunk.

    One job asks that, unless ``dealt`` says so: the number of rows with which the caller has dealt them by ``keys``.
    """
    if dealt is not None:
        return stored_by_group(df, list(keys), order, dealt)
    at = df.agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    if at.n == 0 or at.low is None or at.low < 0 or at.high >= chunk_rows:
        return checkpoint(df)
    return stored_by_group(deal(df, list(keys), at.n), list(keys), order, at.n)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Sequence[Scan],
    chunk: Column | None = None,
    descending: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    small: bool | None = None,
) -> DataFrame:
    """Add the running columns ``outputs`` per ``keys`` along ``order``.

    Where no position lies behind the first chunk, one window per group does. Otherwise the input
    is read by two branches (rows, chunk summaries). Summaries shrink before they are
    shuffled, so this costs one row shuffle; but stacking scans doubles the reads per level, so
    callers that stack more than two cut the chain with ``session.checkpoint``.

    ``chunk`` must be non-decreasing along ``order`` within a group; by default it
    is ``order div chunk_rows`` for integer positions. ``small`` says that no group has more rows
    than a chunk, where the caller knows; otherwise one job asks.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    if chunk is None and (one_chunk(df, order, chunk_rows) if small is None else small):
        upto = Window.partitionBy(*table_first(keys)).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before_row = upto.rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*[F.col(f"`{c}`") for c in df.columns], *[_local(o.kind, o.value).over(upto if o.inclusive else before_row).alias(o.name) for o in outputs])
    chunk = F.floor(F.col(order) / chunk_rows) if chunk is None else chunk
    work = df.withColumn("_chunk", chunk)
    for i, o in enumerate(outputs):
        work = work.withColumn(f"_v{i}", o.value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(direction(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_row = inside.rowsBetween(Window.unboundedPreceding, -1)

    summaries = []
    for i, o in enumerate(outputs):
        v = F.col(f"_v{i}")
        if o.kind in ("last", "lag"):
            pick = F.min_by if descending else F.max_by
            ranked = F.when(v.isNotNull(), F.col(order)) if o.kind == "last" else F.col(order)
            summaries.append(pick(F.struct(v.alias("v")), ranked)["v"].alias(f"_s{i}"))
        else:
            summaries.append(_local(o.kind, v).alias(f"_s{i}"))
    per_chunk = work.groupBy(*keys, "_chunk").agg(*summaries)
    across = (
        Window.partitionBy(*keys)
        .orderBy(direction("_chunk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_chunk.select(
        *keys,
        "_chunk",
        *[
            _local("sum" if o.kind == "count" else o.kind, F.col(f"_s{i}")).over(across).alias(f"_b{i}")
            for i, o in enumerate(outputs)
        ],
    )
    local = work.withColumn("_has", F.count(F.lit(1)).over(before_row) > 0)
    for i, o in enumerate(outputs):
        frame = upto if o.inclusive else before_row
        local = local.withColumn(f"_l{i}", _local(o.kind, F.col(f"_v{i}")).over(frame))
    joined = local.join(
        carried.select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.col("_chunk").alias("_k_chunk"),
            *[f"_b{i}" for i in range(len(outputs))],
        ),
        _key_match(keys),
        "left",
    )
    out = joined.select(
        *df.columns,
        *[
            _combine(o.kind, F.col(f"_b{i}"), F.col(f"_l{i}"), F.col("_has")).alias(o.name)
            for i, o in enumerate(outputs)
        ],
    )
    return out


def _key_match(keys: Sequence[str]) -> Column:
    cond = F.col("_chunk") == F.col("_k_chunk")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return cond


def join_tables(rows: DataFrame, frame: DataFrame, keys: Sequence[str], how: str = "inner", chunk_rows: int = CHUNK_ROWS, small: bool | None = None) -> DataFrame:
    """``rows`` joined to one row per group, on the group and the row's chunk, so that no task sees a whole hot group.

    ``frame`` is copied to the chunks that its group has, which one aggregation of ``rows`` finds. Rows of one chunk are joined plainly.
    """
    keys = list(keys)
    if one_chunk(rows, "row_idx", chunk_rows) if small is None else small:
        return rows.join(frame, keys, how)
    cut = rows.withColumn("_chunk", F.expr(f"row_idx div {chunk_rows}"))
    chunks = cut.select(*keys, "_chunk").distinct()
    return cut.join(chunks.join(frame, keys), [*keys, "_chunk"], how).drop("_chunk")


def beside(rows: DataFrame, frame: DataFrame, keys: Sequence[str], condition: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined to the records of ``frame`` of the same group that meet ``condition``, tried record by record inside the group.

    Rows stored by group stay where they are, which a join on more columns than ``keys`` would not leave them. For groups with
    few records in ``frame``, whose share of a task is held in memory. Other columns of the two must differ in name.
    """
    held = frame.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(f"`{c}`") for c in frame.columns if c not in keys])
    for k in keys:
        condition = (F.col(k) == F.col(f"_k_{k}")) & condition
    return rows.join(held.hint("shuffle_hash"), condition, how).drop(*[f"_k_{k}" for k in keys])


def same(a: str, b: str) -> Column:
    """Equality that :func:`beside` tries inside a group: a join takes a plain one for a key of its own and moves both sides by it."""
    return F.col(a).between(F.col(b), F.col(b))


def dense_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Sequence[Column], name: str = "row_idx", counted: DataFrame | None = None
) -> DataFrame:
    """Number the rows of each group 0,1,2… along ``order`` without one task per group.

    ``chunk`` are coarse, order-preserving columns (a prefix or a bucket of
    ``order``) that bound how many rows are sorted together. They are left out where no group
    has more than CHUNK_ROWS rows; ``counted`` is a frame of the same groups, at least an eighth as large.
    """
    keys = list(keys)
    limit = CHUNK_ROWS if counted is None else CHUNK_ROWS // 8
    if (df if counted is None else counted).groupBy(*keys).count().where(F.col("count") > limit).isEmpty():
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.dropna(subset=keys).select(*df.columns, place.cast("int").alias(name))  # as the join below, which matches no missing key
    work = df
    names = []
    for i, c in enumerate(chunk):
        work = work.withColumn(f"_c{i}", c)
        names.append(f"_c{i}")
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    local = work.withColumn("_r", F.row_number().over(inside))
    sizes = work.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    across = (
        Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(n).alias(f"_o{n}") for n in names],
        F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"),
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    for n in names:
        cond = cond & (F.col(n) == F.col(f"_o{n}"))
    return local.join(offsets, cond).select(
        *df.columns, (F.col("_off") + F.col("_r") - 1).cast("int").alias(name)
    )
