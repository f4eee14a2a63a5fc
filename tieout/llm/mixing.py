"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source of weight w gets blocks of documents; its block j (from 0) may not start before slot
floor(j / w) and must be placed before slot ceil((j + 1) / w). Earliest deadline first over the
released blocks then keeps every source less than one block away from its target after every slot.
Weights are whole parts of a period, so releases and deadlines repeat: one period is scheduled by a
fold over its slots, and every block of any size of corpus finds its slot by arithmetic. The fold
costs period x sources steps, whatever the number of documents.

Every document is placed once. When a source has no blocks left, its slots close up; the others keep
their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import spread_rank, stored

PERIOD = 1024
BLOCK_ROWS = 8
SEED = "mix"


def smoothed_weights(docs: DataFrame) -> DataFrame:
    """(source, weight): each source's weight is the square root of its number of documents, in thousandths."""
    n = docs.groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", F.floor(F.sqrt("n") * 1000).cast("long").alias("weight"))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def schedule(counts: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row: the sources (sorted) with their counts, whole parts of the period and one period's slots.

    ``counts``: source, n, weight (whole, not negative). Parts follow the weights by largest
    remainder, one part at least. The period is widened to four slots for each source.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("source", "n", "weight"))).alias("a"))
    one = one.selectExpr(
        "a.source AS sources", "a.n AS ns", "a.weight AS weights", f"greatest({period}, 4 * size(a)) AS period",
        "greatest(aggregate(a.weight, 0L, (x, w) -> x + w), 1L) AS total",
    )
    one = one.selectExpr("*", "transform(weights, w -> (period - size(weights)) * w div total) AS whole", "transform(weights, w -> (period - size(weights)) * w % total) AS rest")
    one = one.selectExpr("*", "period - size(whole) - aggregate(whole, 0L, (x, w) -> x + w) AS open")
    one = stored(one).selectExpr(
        "sources", "ns", "period",
        "transform(whole, (w, i) -> 1 + w + IF(size(filter(rest, (r, k) -> r > rest[i] OR (r = rest[i] AND k < i))) < open, 1L, 0L)) AS parts",
    )
    released = "transform(parts, (p, i) -> IF(s.done[i] < p AND s.done[i] * period div p <= t, struct(((s.done[i] + 1) * period + p - 1) div p AS deadline, i AS i, s.done[i] * period div p AS release), NULL))"
    scheduled = stored(one).selectExpr(
        "*",
        f"""aggregate(sequence(0L, period - 1L),
              named_struct('done', transform(parts, p -> 0L), 'picks', cast(array() AS array<struct<i: int, j: bigint, release: bigint, deadline: bigint, done: array<bigint>>>)),
              (s, t) -> transform(array(array_min({released})), b -> named_struct(
                  'done', transform(s.done, (d, i) -> IF(i = b.i, d + 1L, d)),
                  'picks', concat(s.picks, array(named_struct('i', b.i, 'j', s.done[b.i], 'release', b.release, 'deadline', b.deadline, 'done', s.done)))))[0],
              s -> s.picks) AS picks""",
    )
    return stored(scheduled)  # one row; each step is written, so that no expression is evaluated inside another's lambda


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, seed: str = SEED, tie: Column | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with block, release, deadline, slot and position (0, 1, 2... over all documents), each name behind ``prefix``.

    ``weights``: source, weight (whole numbers; sources without one weigh nothing and get one part of
    the period); by default the smoothed weights. Documents of a source follow in seeded hash order
    of doc_id, then ``tie``. NULL and empty source are one source. Repeated rows are placed one
    behind the other; a NULL doc_id counts as empty. An empty table gives an empty result. Clashing
    columns are avoided with ``prefix``.
    """
    counts = docs.groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weights = smoothed_weights(docs) if weights is None else weights
    wanted = weights.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.greatest(F.col("weight").cast("long"), F.lit(0)).alias("weight")).groupBy("source").agg(F.sum("weight").alias("weight"))
    plan = schedule(counts.join(wanted, "source", "left").select("source", "n", F.coalesce("weight", F.lit(0).cast("long")).alias("weight")), period)

    per_source = plan.selectExpr("posexplode(arrays_zip(sources, ns, parts)) AS (__i, __s)", "period AS __period").selectExpr("__i", "__s.sources AS __source", "__s.ns AS __count", "__s.parts AS __parts", "__period")
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumn("__hash", hashed).withColumn("__source", _source()).join(F.broadcast(per_source), "__source")  # one row per source
    cells = F.ceil(F.sqrt("__count")).cast("long")
    cell = F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * cells / F.lit(2**32)).cast("long")
    order = [F.col("__hash")] + ([tie] if tie is not None else [])
    ranked = spread_rank(rows, ["__source"], order, cell, "__rank")

    slots = plan.selectExpr("posexplode(picks) AS (__slot, __pick)", "ns AS __ns", "parts AS __all_parts").selectExpr(
        "__slot", "__pick.i AS __i", "__pick.j AS __j", "__pick.release AS __release", "__pick.deadline AS __deadline", "__pick.done AS __done", "__ns", "__all_parts"
    )
    block = F.floor(F.col("__rank") / block_rows)
    placed = (
        ranked.withColumn("__block", block)
        .withColumn("__turn", F.expr("__block div __parts"))
        .withColumn("__j", F.expr("__block % __parts"))
        .join(F.broadcast(slots), ["__i", "__j"])  # one row per slot of the period
    )
    before = F.expr(f"aggregate(sequence(0, size(__ns) - 1), 0L, (x, k) -> x + least(__ns[k], {block_rows}L * (__turn * __all_parts[k] + __done[k])))")
    at = F.expr("__turn * __period")
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__block").alias(f"{prefix}block"),
        (at + F.col("__release")).alias(f"{prefix}release"),
        (at + F.col("__deadline")).alias(f"{prefix}deadline"),
        (at + F.col("__slot")).cast("long").alias(f"{prefix}slot"),
        (before + F.expr(f"__rank % {block_rows}")).cast("long").alias(f"{prefix}position"),
    )
