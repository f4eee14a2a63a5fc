"""Tie-outs between notes and statements: account facts, as-of reads, first use, form maps.

Facts are an append log (doc_id, account_key, seq, cy, py). A note reads the last fact
written before it; scans over (doc_id, account_key) keep that correct for a hot account.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout import catalogue as C
from tieout.functions.evidence import to_evidence
from tieout.functions.literals import literal_array
from tieout.functions.tolerance import Materiality, amounts_match
from tieout.operators.scans import CHUNK_ROWS, Scan, groups_fit, scan
from tieout.session import fixed_table

TABLE_KEY = ["doc_id", "table_idx"]
ACCOUNT = ["doc_id", "account_key"]


def as_of_facts(probes: DataFrame, facts: DataFrame, chunk_rows: int = CHUNK_ROWS, small: bool | None = None) -> DataFrame:
    """Add fact_cy, fact_py: the account's last fact with a smaller ``seq``; NULL when none.

    Facts and probes share one ordered scan; a fact at the same seq is not visible yet. ``small`` says whether no document has
    more facts and probes than a chunk, where the caller knows; otherwise one job asks.
    """
    cols = [c for c in probes.columns if c not in (*ACCOUNT, "seq")]
    log = facts.select(*ACCOUNT, "seq", F.struct("cy", "py").alias("_fact"), F.lit(1).alias("_side"))
    ask = probes.withColumn("_side", F.lit(0))
    both = ask.unionByName(log, allowMissingColumns=True).withColumn("_pos", F.col("seq") * 2 + F.col("_side"))
    # documents without many facts and probes have no large account either: one shuffle of the rows does
    small = groups_fit(both, ["doc_id"], chunk_rows) if small is None else small
    seen = scan(both, ACCOUNT, "_pos", [Scan("_seen", "last", F.col("_fact"), inclusive=False)],
                chunk=None if small else F.floor(F.col("_pos") / chunk_rows), small=small)
    return seen.where("_side = 0").select(
        *ACCOUNT, "seq", *cols, F.col("_seen.cy").alias("fact_cy"), F.col("_seen.py").alias("fact_py")
    )


def running_facts(facts: DataFrame, sign: Column) -> DataFrame:
    """Accumulating accounts: the fact after each write is the running signed sum."""
    return scan(facts, ACCOUNT, "seq", [Scan("running_cy", "sum", sign * F.col("cy")), Scan("running_py", "sum", sign * F.col("py"))])


def first_use(probes: DataFrame, keys: list[str] = ACCOUNT) -> DataFrame:
    """Only the first note of an account is checked; an aggregation, then a join back."""
    first = probes.groupBy(*keys).agg(F.min("seq").alias("seq"))
    return probes.join(first, [*keys, "seq"], "left_semi")


def resolve_key(candidates: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The best-ranked candidate account that has a fact; without any, the weakest candidate.

    ``candidates`` has ``keys`` (doc_id included), account_key and priority (1 = explicit, then
    combined, then specific keys); rows with priority NULL are pure fallbacks.
    """
    known = facts.select(*ACCOUNT).distinct().withColumn("_known", F.lit(True))
    j = candidates.join(known, ACCOUNT, "left")
    hit = F.col("_known") & F.col("priority").isNotNull()
    return j.groupBy(*keys).agg(
        F.min_by(F.when(hit, F.col("account_key")), F.when(hit, F.col("priority"))).alias("_hit"),
        F.max(F.when(F.col("priority").isNull(), F.col("account_key"))).alias("_fallback"),
        F.min_by("account_key", "priority").alias("_first"),
    ).select(*keys, F.coalesce("_hit", "_fallback", "_first").alias("account_key"))


def presence_key(short_known: Column, long_known: Column, short: str, long: str, combined: str) -> Column:
    """Combined account only when short and long both exist."""
    return F.when(short_known & long_known, combined).when(long_known & ~short_known, long).otherwise(short)


def cross_check(notes: DataFrame, facts: DataFrame, guards: bool = False, small: bool | None = None) -> DataFrame:
    """Note totals (cy, py) against account facts as of the note; missing keys give no row.

    Baseline form: difference = statement − note, ok when it rounds to 0. With ``guards`` the
    validator form: difference = note − statement, ok within 1, and pairs whose sizes differ
    more than tenfold (both above 1,000) or whose section wording clashes are not compared. ``small`` as in :func:`as_of_facts`.
    """
    j = as_of_facts(notes, facts, small=small).where("fact_cy is not null")
    if guards:
        def odd(a: str, b: str) -> Column:
            x, y = F.abs(F.col(a)), F.abs(F.col(b))
            return (x > 1000) & (y > 1000) & ((x > y * 10) | (y > x * 10))

        clash = F.lit(False)
        for account, token in C.SECTION_WHITELIST:
            clash = clash | (F.lower("account_key").contains(account) & ~F.lower("heading").contains(token))
        j = j.where(~odd("cy", "fact_cy") & ~odd("py", "fact_py") & ~clash)
        dcy, dpy, bound = F.col("cy") - F.col("fact_cy"), F.col("py") - F.col("fact_py"), 1.0
    else:
        dcy, dpy, bound = F.col("fact_cy") - F.col("cy"), F.col("fact_py") - F.col("py"), 0.5
    dcy, dpy = F.round(dcy, 4), F.round(dpy, 4)
    return j.withColumn("diff_cy", dcy).withColumn("diff_py", dpy).withColumn(
        "ok_cy", F.abs("diff_cy") <= bound
    ).withColumn("ok_py", F.abs("diff_py") <= bound)


def note_report(notes: DataFrame, facts: DataFrame, abs_tol: float = 1.0, rel_tol: float = 0.01) -> DataFrame:
    """MATCH / MISMATCH / UNMATCHED per note; one side missing is a mismatch."""
    known = facts.select(*ACCOUNT, F.col("cy").alias("fs_cy"), F.col("py").alias("fs_py"), F.lit(True).alias("_k"))
    j = notes.join(known, ACCOUNT, "left")

    def ok(a: str, b: str) -> Column:
        neither = F.col(a).isNull() & F.col(b).isNull()
        return neither | amounts_match(F.col(a), F.col(b), abs_tol, rel_tol)

    status = F.when(F.col("_k").isNull(), "UNMATCHED").when(ok("cy", "fs_cy") & ok("py", "fs_py"), "MATCH").otherwise("MISMATCH")
    return j.withColumn("status", status).withColumn("delta_cy", F.round(F.abs(F.col("cy") - F.col("fs_cy")), 4)).drop("_k")


def tie_out_forms(slots: DataFrame, facts: DataFrame, form_map: list | None = None) -> DataFrame:
    """Note slots matched to accounts by the form map, then cross-checked as of the note.

    ``slots``: doc_id, table_idx, heading, n_subtotals, slot, locator, cy, py. The map is a fixed
    broadcast table joined on (group, slot, locator), heading wording as a residual filter.
    """
    m = fixed_table(
        slots.sparkSession, C.FORM_MAP if form_map is None else form_map,
        "grp string, match string, pattern string, slot string, locator string, account string, sign int, once boolean",
    )
    s = slots.withColumn("grp", F.when(F.col("n_subtotals") > 1, "M").otherwise("S")).withColumn("heading", F.lower(F.trim("heading")))
    hit = F.when(F.col("match") == "exact", F.col("heading") == F.col("pattern")).otherwise(F.contains("heading", "pattern"))
    j = s.join(m, ["grp", "slot", "locator"]).where(hit)
    swap = F.col("locator").isin(C.SWAPPED_LOCATORS) & (F.contains("heading", F.lit("borrowings")) | F.contains("heading", F.lit("bonds")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * F.col("sign")
    probes = j.select(
        "doc_id", F.when(F.col("account") == "", F.col("heading")).otherwise(F.col("account")).alias("account_key"),
        F.col("table_idx").alias("seq"), "table_idx", "slot", "locator", "once",
        F.when(swap, z("py")).otherwise(z("cy")).alias("cy"), F.when(swap, z("cy")).otherwise(z("py")).alias("py"),
    )
    checked = cross_check(probes, facts)
    once = first_use(checked.where("once"))
    return once.unionByName(checked.where("not once")).drop("once", "seq")


def fixed_assets(rows: DataFrame) -> DataFrame:
    """Cost, depreciation and net book value bands of a fixed-asset note.

    ``rows``: doc_id, table_idx, row_idx, label, value. Cost and depreciation must roll from
    opening to closing, and net book value must equal cost minus depreciation at both ends.
    Band borders come from one aggregation; the sums from a second.
    """
    t = F.lower(F.coalesce("label", F.lit("")))
    # Wording of the bands.
    cost = t.contains("cost") | t.contains("giá vốn") | t.contains("nguyên giá")
    ad = t.rlike("accumulated depreciation|accumulated amorti[sz]ation|impairment losses|khấu hao lũy kế|hao mòn lũy kế")
    nbv = t.rlike("net book value|giá trị còn lại")
    at = lambda c: F.max(F.when(c, F.col("row_idx")))
    borders = rows.groupBy(*TABLE_KEY).agg(at(ad).alias("_ad"), at(nbv).alias("_nbv"), at(cost).alias("_cost")).where(
        "_ad is not null and _nbv is not null"
    )
    j = rows.join(borders, TABLE_KEY)
    band = F.when(F.col("row_idx") < F.col("_ad"), "cost").when(F.col("row_idx") < F.col("_nbv"), "ad").otherwise("nbv")
    is_ob, is_cb = t.contains("opening"), t.contains("closing")
    head = cost | ad | nbv
    b = j.withColumn("band", band).groupBy(*TABLE_KEY, "band").agg(
        F.max_by(F.when(is_ob, F.col("value")), F.when(is_ob, F.col("row_idx"))).alias("ob"),
        F.max_by(F.when(is_cb, F.col("value")), F.when(is_cb, F.col("row_idx"))).alias("cb"),
        F.coalesce(F.round(F.sum(F.when(~is_ob & ~is_cb & ~head, F.col("value"))), 4), F.lit(0.0)).alias("mv"),
    )
    pick = lambda band, c: F.max(F.when(F.col("band") == band, F.col(c)))
    w = b.groupBy(*TABLE_KEY).agg(*[pick(k, c).alias(f"{k}_{c}") for k in ("cost", "ad", "nbv") for c in ("ob", "cb", "mv")])
    checks = w.select(
        *TABLE_KEY,
        F.expr(
            "stack(4, 'cost roll', cost_ob + cost_mv, cost_cb, 'depreciation roll', ad_ob + ad_mv, ad_cb, "
            "'opening net', cost_ob - ad_ob, nbv_ob, 'closing net', cost_cb - ad_cb, nbv_cb) as (check, expected, actual)"
        ),
    ).where("expected is not null and actual is not null")
    return checks.withColumn("expected", F.round("expected", 4)).withColumn(
        "ok", F.abs(F.round(F.col("expected") - F.col("actual"), 4)) <= 0.5
    )


def signed_identity(rows: DataFrame, terms: list[tuple[str, int]], total: str) -> DataFrame:
    """Keyword-located rows combined with signs must equal another row (acquisitions, segments, BCC).

    Each keyword takes its first matching row per table.
    """
    t = F.lower(F.coalesce("label", F.lit("")))
    first = lambda w: F.min_by(F.when(t.contains(w), F.col("value")), F.when(t.contains(w), F.col("row_idx")))
    w = rows.groupBy(*TABLE_KEY).agg(*[first(k).alias(f"_t{i}") for i, (k, _) in enumerate(terms)], first(total).alias("actual"))
    expected = F.lit(0.0)
    for i, (_, sign) in enumerate(terms):
        expected = expected + F.lit(float(sign)) * F.coalesce(f"_t{i}", F.lit(0.0))
    return w.where("actual is not null").select(
        *TABLE_KEY, F.round(expected, 4).alias("expected"), "actual",
        (F.abs(F.round(expected - F.col("actual"), 4)) <= 0.5).alias("ok"),
    )


def listed_items(cells: DataFrame, spec: DataFrame, table_type: str = "GENERIC_NOTE", materiality: Materiality | None = None) -> DataFrame:
    """Cross-check rule: listed cells must equal the expected values of a specification."""
    m = materiality or Materiality()
    j = cells.join(spec, [*TABLE_KEY, "row_idx", "col_idx"]).where("value is not null and expected_value is not null")
    return to_evidence(
        j, "CROSS_CHECK", F.concat(F.lit("Cross-check "), F.col("reference_name")), F.col("expected_value"), F.col("value"),
        m.tolerance(F.greatest(F.abs("expected_value"), F.abs("value")), table_type),
    )


def anchor_index(items: DataFrame) -> DataFrame:
    """Statement lines as lookup anchors with normalised note reference and label."""
    from tieout.functions.text import normalize_code, normalize_label, normalize_note_ref

    return items.select(
        "doc_id", "statement_type", "table_idx", "row_idx", normalize_code(F.col("code")).alias("code"),
        normalize_label(F.col("label")).alias("label_norm"), normalize_note_ref(F.col("note_ref")).alias("note_ref_norm"),
        "period_ord", "value",
    )


def catalogue_match(headings: DataFrame, names: list[str], exact: bool = True) -> DataFrame:
    """Headings in a catalogue, by equality or by containment."""
    h = F.lower(F.trim("heading"))
    if exact:
        return headings.where(h.isin(names))
    return headings.where(F.exists(literal_array(names), lambda n: F.contains(h, n)))


def heading_forms(headings: DataFrame) -> DataFrame:
    """``headings`` with ``forms``, the tie-out forms whose catalogue holds the heading, in the order of the forms."""
    h = F.lower(F.trim(F.regexp_replace("heading", r"\s+", " ")))
    forms = F.array(*[F.when(h.isin(names), form) for form, names in C.FORMS])
    return headings.withColumn("forms", F.array_compact(forms))


def tax_rates(files: DataFrame, rates: DataFrame, default: float = 0.25) -> DataFrame:
    """Relative path, then base name, then the map's own default, then the global default.

    The map may be large, so it is joined without a hint and the optimizer sizes the join.
    """
    by_path = rates.select(F.col("name").alias("rel_path"), F.col("rate").alias("_r1"))
    by_name = rates.select(F.col("name").alias("base_name"), F.col("rate").alias("_r2"))
    fallback = F.broadcast(rates.where("name = 'default'").agg(F.max("rate").alias("_r3")).withColumn("_one", F.lit(1)))
    return (
        files.join(by_path, "rel_path", "left").join(by_name, "base_name", "left").withColumn("_one", F.lit(1))
        .join(fallback, "_one", "left")
        .select(*files.columns, F.coalesce("_r1", "_r2", "_r3", F.lit(default)).alias("rate"))
    )
