"""Statement-level operators: line items, duplicate-code policies, signed formulas.

Everything is aggregation with map-side partials plus broadcast joins against fixed
rule tables; nothing depends on how many rows one document holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout import catalogue as C
from tieout.functions.evidence import clean_sum, to_evidence
from tieout.functions.text import CODE_FORMAT
from tieout.functions.tolerance import Materiality
from tieout.session import fixed_table

ROLE_SCHEMA = "formula string, role_code string, sign int, is_parent boolean, wanted string"
TERM_SCHEMA = "formula string, parent string, child string, sign int, ord int"


def long_items(rows: DataFrame) -> DataFrame:
    """Wide statement rows (cy, py) -> one row per period: period_ord 0 and 1, value."""
    keep = [c for c in rows.columns if c not in ("cy", "py")]
    return rows.withColumn("period_ord", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *keep, "period_ord", F.when(F.col("period_ord") == 0, F.col("cy")).otherwise(F.col("py")).alias("value")
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    """One statement from its table parts, rescuing codes that slid into the note column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if "note" in out.columns:
        short = F.col("note").rlike(r"^\d{1,2}$")
        rescued = F.coalesce(F.nullif(F.trim("code"), F.lit("")), F.when(short, F.col("note")), F.lit(""))
        from tieout.functions.text import pad_code

        out = out.withColumn("code", pad_code(rescued))
    return out


def row_order(rank: Column | None = None) -> Column:
    """(rank, table_idx, row_idx) as one decimal number, which keeps aggregates hashable where a struct would sort.

    Holds any long row_idx, table_idx below 10^16 and rank 0 to 9.
    """
    order = F.expr("cast(cast(table_idx AS decimal(38, 0)) * 10000000000000000000BD + cast(row_idx AS decimal(38, 0)) AS decimal(38, 0))")
    return order if rank is None else (F.expr("1000000000000000000000000000000000000BD") * rank + order).cast("decimal(38, 0)")


# --- duplicate-code policies ------------------------------------------------------


def dedup_sum(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(clean_sum(F.col("value")).alias("value"))


def dedup_first(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.min_by("value", row_order()).alias("value"))


def dedup_last(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.max_by("value", row_order()).alias("value"))


def dedup_keep_nonzero(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row with a non-zero period wins; an all-zero row never replaces one."""
    nonzero = (F.abs("cy") + F.abs("py")) != 0
    order = row_order(F.coalesce(nonzero, F.lit(False)).cast("int"))
    return rows.groupBy(*keys).agg(F.max_by("cy", order).alias("cy"), F.max_by("py", order).alias("py"))


# --- formulas ---------------------------------------------------------------------


def role_rows(rules: list) -> list[tuple]:
    """A rule list as the roles codes play: (formula, code, sign, is_parent, all children)."""
    out = []
    for formula, parent, children in rules:
        plain = ",".join(c.lstrip("-") for c in children)
        out.append((formula, parent, 0, True, plain))
        out.extend((formula, c.lstrip("-"), -1 if c.startswith("-") else 1, False, plain) for c in children)
    return out


def roles_of(terms: DataFrame) -> DataFrame:
    """The same roles from a user's own formula table (formula, parent, child, sign)."""
    kids = terms.groupBy("formula").agg(F.array_join(F.sort_array(F.collect_set("child")), ",").alias("wanted"))
    both = terms.select("formula", F.col("child").alias("role_code"), "sign", F.lit(False).alias("is_parent")).unionByName(
        terms.select("formula", F.col("parent").alias("role_code"), F.lit(0).alias("sign"), F.lit(True).alias("is_parent")).distinct()
    )
    return both.join(kids, "formula")


def formula_sums(facts: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """Children's signed sum beside the parent's value, per ``keys`` and formula.

    ``facts`` has ``keys``, code, value (one row per key and code). Each fact meets every role it
    plays (child of some formulas, parent of others) once, so one join and one aggregation do the
    whole check. Fixed catalogues come broadcast; a user's table is joined as the optimizer sees fit.
    """
    hit = facts.join(roles, facts.code == roles.role_code)
    child = ~F.col("is_parent")
    return (
        hit.groupBy(*keys, "formula")
        .agg(
            F.round(F.sum(F.when(child, F.col("sign") * F.col("value"))), 4).alias("computed"),
            F.max(F.when(F.col("is_parent"), F.col("value"))).alias("reported"),
            F.sum(F.when(child, 1).otherwise(0)).alias("present"),
            F.collect_set(F.when(child, F.col("role_code"))).alias("found"),
            F.max(F.when(F.col("is_parent"), F.col("wanted"))).alias("wanted"),
        )
        .where(F.col("reported").isNotNull() & (F.col("present") > 0))
    )


def check_formulas(facts: DataFrame, rules: list | DataFrame, keys: list[str], exact: bool) -> DataFrame:
    """Skip absent parents and formulas without any child; list the missing children.

    ``rules`` is a rule list or a user's formula table.
    """
    if isinstance(rules, DataFrame):
        roles = roles_of(rules)
    else:
        roles = fixed_table(facts.sparkSession, role_rows(rules), ROLE_SCHEMA)
    gap = F.round(F.col("computed") - F.col("reported"), 4)
    return (
        formula_sums(facts, roles, keys)
        .withColumn("diff", gap)
        .withColumn("ok", (gap == 0) if exact else (F.abs(gap) <= 0.5))
        .withColumn("missing", F.array_join(F.array_except(F.split("wanted", ","), "found"), ","))
        .drop("wanted", "found", "present")
    )


def balance_check(rows: DataFrame, exact: bool = True) -> DataFrame:
    """Parents of the balance sheet equal the sum of their present children."""
    valid = rows.where(F.col("code").rlike(CODE_FORMAT))
    facts = long_facts(dedup_keep_nonzero(valid, ["doc_id", "code"]), ["doc_id", "code"])
    return check_formulas(facts, C.BALANCE_RULES, ["doc_id", "period_ord"], exact)


def long_facts(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.withColumn("period_ord", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *keys, "period_ord", F.when(F.col("period_ord") == 0, F.col("cy")).otherwise(F.col("py")).alias("value")
    )


def income_check_baseline(rows: DataFrame) -> DataFrame:
    """All eight signed formulas run, including both forms of code 20."""
    facts = long_facts(dedup_keep_nonzero(rows, ["doc_id", "code"]), ["doc_id", "code"])
    return check_formulas(facts, C.INCOME_RULES_BASELINE, ["doc_id", "period_ord"], exact=True)


def cash_flow_check_baseline(rows: DataFrame) -> DataFrame:
    """Duplicate codes add up; an uncoded numeric row right before the first 14–20 acts as 18."""
    valid = rows.where(F.col("code").rlike(CODE_FORMAT))
    summed = valid.groupBy("doc_id", "code").agg(
        clean_sum(F.col("cy")).alias("cy"), clean_sum(F.col("py")).alias("py")
    )
    inferred = uncoded_before_block(rows)
    merged = summed.join(
        inferred.select("doc_id", F.lit("18").alias("code")), ["doc_id", "code"], "left_anti"
    ).unionByName(inferred.select("doc_id", F.lit("18").alias("code"), "cy", "py"))
    facts = long_facts(merged, ["doc_id", "code"])
    return check_formulas(facts, C.CASH_FLOW_RULES_BASELINE, ["doc_id", "period_ord"], exact=True)


def uncoded_before_block(rows: DataFrame) -> DataFrame:
    """The row just above the first row coded 14–20, when it has no code but has amounts.

    Two aggregations replace a lag over the document: find the first block row, then
    the last row before it.
    """
    order = row_order()
    block = rows.where(F.col("code").isin([str(c) for c in range(14, 21)]))
    first = block.groupBy("doc_id").agg(F.min(order).alias("_first"))
    return (
        rows.join(first, "doc_id")
        .where(order < F.col("_first"))
        .groupBy("doc_id")
        .agg(F.max_by(F.coalesce("code", F.lit("")) == "", order).alias("uncoded"), F.max_by("cy", order).alias("cy"), F.max_by("py", order).alias("py"))
        .where(F.col("uncoded") & (F.abs("cy") + F.abs("py") != 0))
        .select("doc_id", "cy", "py")
    )


def balance_identities(items: DataFrame, materiality: Materiality | None = None) -> DataFrame:
    """270 = 100 + 200, 440 = 300 + 400, 270 = 440; the last row of a code counts."""
    m = materiality or Materiality()
    facts = dedup_last(items, ["doc_id", "table_idx", "code", "period_ord"])
    roles = fixed_table(items.sparkSession, role_rows(C.BALANCE_IDENTITIES), ROLE_SCHEMA)
    sums = formula_sums(facts, roles, ["doc_id", "table_idx", "period_ord"])
    return to_evidence(
        sums, "BS_FORMULA_CHECK", F.col("formula"), F.col("reported"), F.col("computed"),
        m.tolerance(F.greatest(F.abs("reported"), F.abs("computed")), "FS_BALANCE_SHEET"),
    )


def income_check_templates(rows: DataFrame) -> DataFrame:
    """Template formulas chosen per document by the codes it has; duplicates add up.

    Code 20 follows code 10 where present; code 30 takes the +24 form unless 23, 24
    and 27 are all absent. A formula written in a parent's own label overrides it.
    """
    from tieout.functions.text import formula_target, formula_terms

    facts = rows.groupBy("doc_id", "code").agg(clean_sum(F.col("cy")).alias("cy"), clean_sum(F.col("py")).alias("py"))
    flags = rows.where(F.col("code").isin("10", "23", "24", "27")).groupBy("doc_id").agg(
        F.max(F.col("code") == "10").alias("has10"),
        F.max(F.col("code") == "24").alias("has24"),
        F.max(F.col("code").isin("23", "27")).alias("has2327"),
    )
    templates = [
        ("10", "10", ["01", "-02"], "has10"),
        ("20", "20", ["10", "-11"], "has10"),
        ("20", "20", ["01", "-02", "-11"], "no10"),
        ("30", "30", ["20", "21", "-22", "24", "-25", "-26"], "with24"),
        ("30", "30", ["20", "21", "-22", "-25", "-26"], "without24"),
        ("40", "40", ["31", "-32"], "always"),
        ("50", "50", ["30", "40"], "always"),
        ("60", "60", ["50", "-51", "-52"], "always"),
        ("60 by owner", "60", ["61", "62"], "always"),
    ]
    term_rows = [
        (f, p, c.lstrip("-"), -1 if c.startswith("-") else 1, when) for f, p, kids, when in templates for c in kids
    ]
    terms = fixed_table(
        rows.sparkSession, term_rows, "formula string, parent string, child string, sign int, variant string"
    )
    docs = facts.select("doc_id").distinct().join(flags, "doc_id", "left").select(
        "doc_id",
        F.array(
            F.lit("always"),
            F.when(F.coalesce("has10", F.lit(False)), "has10").otherwise("no10"),
            F.when(F.coalesce("has24", F.lit(False)) | F.coalesce("has2327", F.lit(False)), "with24").otherwise("without24"),
        ).alias("variants"),
    )
    chosen = docs.join(terms, F.array_contains("variants", F.col("variant"))).select(
        "doc_id", "formula", "parent", "child", "sign"
    )
    labelled = rows.withColumn("parent", formula_target(F.col("label")))
    explicit = (
        labelled.where(F.col("parent").isNotNull())
        .groupBy("doc_id", "parent")
        .agg(F.max_by("label", row_order()).alias("label"))
        .withColumn("t", F.explode(formula_terms(F.col("label"))))
        .select(
            "doc_id", F.col("parent").alias("formula"), "parent",
            F.regexp_replace("t", "^-", "").alias("child"),
            F.when(F.col("t").startswith("-"), -1).otherwise(1).alias("sign"),
        )
    )
    overridden = explicit.select("doc_id", "parent").distinct()
    final = chosen.join(overridden, ["doc_id", "parent"], "left_anti").unionByName(
        explicit.select("doc_id", "parent", "formula", "child", "sign"), allowMissingColumns=True
    )
    long = long_facts(facts, ["doc_id", "code"])
    kids = (
        final.join(long, (final.doc_id == long.doc_id) & (final.child == long.code))
        .groupBy(final.doc_id, "formula", "parent", "period_ord")
        .agg(F.round(F.sum(F.col("sign") * F.col("value")), 4).alias("computed"))
    )
    parents = long.select("doc_id", F.col("code").alias("parent"), "period_ord", F.col("value").alias("reported"))
    gap = F.round(F.col("computed") - F.col("reported"), 4)
    return kids.join(parents, ["doc_id", "parent", "period_ord"]).select(
        "doc_id", "period_ord", "formula", "computed", "reported", gap.alias("diff"), (F.abs(gap) <= 0.5).alias("ok")
    )


def income_rules(items: DataFrame, materiality: Materiality | None = None) -> DataFrame:
    """Statement-level income rules: a missing child counts as 0, only the parent must exist.

    Sub-total codes are read from their first row, plain codes are summed; code 24 is
    narrowed to shares of associates where the labels allow it.
    """
    m = materiality or Materiality()
    label = F.lower("label")
    associate = label.contains("associate") | label.contains("share") | label.contains("liên doanh") | label.contains("liên kết")
    rank24 = (
        F.when((F.col("code") == "24") & associate, 0)
        .when(label.contains("share of"), 1)
        .when(label.contains("liên doanh"), 2)
        .when(F.col("code") == "24", 3)
    )
    keys = ["doc_id", "period_ord"]

    def total(*codes: str) -> Column:
        return F.coalesce(F.round(F.sum(F.when(F.col("code").isin(*codes), F.col("value"))), 4), F.lit(0.0))

    def first(code: str) -> Column:
        hit = F.col("code") == code
        return F.min_by(F.when(hit, F.col("value")), F.when(hit, row_order()))

    v = items.groupBy(*keys).agg(
        *[total(c).alias(f"s{c}") for c in "01 02 10 11 21 22 25 26 31 32 51 52".split()],
        *[first(c).alias(f"f{c}") for c in "20 30 40 50 60".split()],
        F.max(F.col("code") == "10").alias("has10"),
        F.min_by(F.when(rank24.isNotNull(), F.col("value")), F.when(rank24.isNotNull(), row_order(rank24))).alias("f24"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    computed = {
        "20": F.when(F.col("has10"), F.col("s10") - F.col("s11")).otherwise(F.col("s01") - F.col("s02") - F.col("s11")),
        "30": z("f20") + F.col("s21") - F.col("s22") + z("f24") - F.col("s25") - F.col("s26"),
        "40": F.col("s31") - F.col("s32"),
        "50": z("f30") + z("f40"),
        "60": z("f50") - F.col("s51") - F.col("s52"),
    }
    return _formula_evidence(v, keys, computed, "IS_FORMULA_CHECK", "FS_INCOME_STATEMENT", m)


def _formula_evidence(v: DataFrame, keys: list[str], computed: dict[str, Column], rule: str, kind: str, m: Materiality) -> DataFrame:
    """One evidence row per formula whose parent (column ``f<code>``) exists."""
    wide = v.select(
        *keys, *[F.col(f"f{c}").alias(f"r{c}") for c in computed], *[F.round(e, 4).alias(f"c{c}") for c, e in computed.items()]
    )
    pieces = ", ".join(f"'{c}', r{c}, c{c}" for c in computed)
    rows = wide.select(*keys, F.expr(f"stack({len(computed)}, {pieces}) as (code, reported, computed)")).where(
        F.col("reported").isNotNull()
    )
    return to_evidence(
        rows, rule, F.concat(F.lit("Formula code "), F.col("code")), F.col("reported"), F.col("computed"),
        m.tolerance(F.greatest(F.abs("reported"), F.abs("computed")), kind),
    )


def cash_flow_rules(items: DataFrame, materiality: Materiality | None = None) -> DataFrame:
    """Cash-flow rules per table; code 50 reads code 20 from the whole document.

    Code 13 is left out of 20 when it is a sub-total: by its label, or as the only 13
    standing between a 12 and a 14.
    """
    m = materiality or Materiality()
    label = F.lower("label")
    words = F.lit(False)
    for w in C.SUBTOTAL_WORDS_CASH_FLOW:
        words = words | label.contains(w)
    items = items.withColumn("code", F.when((F.col("code") == "13") & words, "").otherwise(F.col("code")))
    keys = ["doc_id", "table_idx", "period_ord"]

    def total(*codes: str) -> Column:
        return F.coalesce(F.round(F.sum(F.when(F.col("code").isin(*codes), F.col("value"))), 4), F.lit(0.0))

    def first(code: str) -> Column:
        hit = F.col("code") == code
        return F.min_by(F.when(hit, F.col("value")), F.when(hit, F.col("row_idx")))

    def pos(code: str, how) -> Column:
        return how(F.when(F.col("code") == code, F.col("row_idx")))

    v = items.groupBy(*keys).agg(
        total("08", "09", "10", "11", "12", "14", "15", "17").alias("ops"),
        total("08").alias("all08"),
        total("13").alias("s13"),
        total("21", "22", "23", "24", "25", "26", "27").alias("s30"),
        total("31", "32", "33", "34", "35", "36").alias("s40"),
        total("60", "61").alias("s6061"),
        total("20").alias("t20"),
        F.sum(F.when(F.col("code") == "13", 1).otherwise(0)).alias("n13"),
        pos("12", F.min).alias("p12"), pos("13", F.min).alias("p13"), pos("14", F.max).alias("p14"),
        *[first(c).alias(f"f{c}") for c in "08 20 30 40 50 70".split()],
    )
    lone = (F.col("n13") == 1) & (F.col("p12") < F.col("p13")) & (F.col("p14") > F.col("p13"))
    doc20 = v.groupBy("doc_id", "period_ord").agg(F.round(F.sum("t20"), 4).alias("doc20"))
    v = v.join(doc20, ["doc_id", "period_ord"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    computed = {
        # 08 counts once, from its first row, even where the code repeats
        "20": F.col("ops") - F.col("all08") + z("f08")
        + F.when(F.coalesce(lone, F.lit(False)), 0.0).otherwise(F.col("s13")),
        "30": F.col("s30"),
        "40": F.col("s40"),
        "50": F.col("doc20") + z("f30") + z("f40"),
        "70": z("f50") + F.col("s6061"),
    }
    return _formula_evidence(v, keys, computed, "CF_FORMULA_CHECK", "FS_CASH_FLOW", m)


def cash_flow_registry_check(rows: DataFrame) -> DataFrame:
    """Profile formulas over the codes summed across all cash-flow tables of a document.

    A formula written in the parent's label wins; otherwise the profile's codes that
    are present apply, and the coverage says whether that is a full section or a part.
    """
    from tieout.functions.text import flat_formula_terms

    registry = rows.groupBy("doc_id", "code").agg(clean_sum(F.col("cy")).alias("cy"), clean_sum(F.col("py")).alias("py"))
    long = long_facts(registry, ["doc_id", "code"])
    spark = rows.sparkSession
    terms = fixed_table(spark, C.signed_terms(C.CASH_FLOW_PROFILES), TERM_SCHEMA)
    parents = [p for _, p, _ in C.CASH_FLOW_PROFILES]
    explicit = (
        rows.where(F.col("code").isin(parents) & F.col("label").rlike(r"=\s*[0-9]"))
        .groupBy("doc_id", F.col("code").alias("parent"))
        .agg(F.max_by("label", row_order()).alias("label"))
        .withColumn("t", F.explode(flat_formula_terms(F.col("label"))))
        .select(
            "doc_id", "parent", F.regexp_replace("t", "^-", "").alias("child"),
            F.when(F.col("t").startswith("-"), -1).otherwise(1).alias("sign"), F.lit("explicit").alias("source"),
        )
    )
    overridden = explicit.select("doc_id", "parent").distinct()
    docs = registry.where(F.col("code").isin(parents)).select("doc_id", F.col("code").alias("parent"))
    profile = docs.join(overridden, ["doc_id", "parent"], "left_anti").join(
        terms.select("parent", "child", "sign"), "parent"
    ).withColumn("source", F.lit("profile"))
    chosen = profile.unionByName(explicit)
    kids = (
        chosen.join(long.withColumnRenamed("code", "child"), ["doc_id", "child"])
        .groupBy("doc_id", "parent", "source", "period_ord")
        .agg(F.round(F.sum(F.col("sign") * F.col("value")), 4).alias("computed"), F.count(F.lit(1)).alias("present"))
    )
    reported = long.select("doc_id", F.col("code").alias("parent"), "period_ord", F.col("value").alias("reported"))
    sizes = fixed_table(spark, [(p, len(k)) for _, p, k in C.CASH_FLOW_PROFILES], "parent string, size int")
    enough = F.col("present") >= F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.col("size") / 2)))
    gap = F.round(F.col("computed") - F.col("reported"), 4)
    return kids.join(reported, ["doc_id", "parent", "period_ord"]).join(sizes, "parent").select(
        "doc_id", "period_ord", F.col("parent").alias("formula"), "computed", "reported", gap.alias("diff"),
        F.when(F.col("source") == "explicit", "explicit_inline_formula").when(enough, "section_profile")
        .otherwise("legacy_profile_only").alias("source"),
        (F.abs(gap) <= 0.5).alias("ok"),
    )


# --- lookups and derived facts ------------------------------------------------------


def line_item(items: DataFrame, code: str, alias: str) -> DataFrame:
    """First row (table order) of a statement with the code, per document and period."""
    return dedup_first(items.where(F.col("code") == code), ["doc_id", "period_ord"]).withColumnRenamed("value", alias)


def find_by_label(items: DataFrame, text: str) -> DataFrame:
    return items.where(F.lower("label").contains(text.lower()))


def derived_facts(items: DataFrame) -> DataFrame:
    """Combined account facts such as current + deferred tax, as a signed aggregate."""
    spec = fixed_table(items.sparkSession, C.DERIVED_FACTS, "account_key string, code string, sign int")
    return (
        items.join(spec, "code")
        .groupBy("doc_id", "account_key", "period_ord")
        .agg(F.round(F.sum(F.col("sign") * F.col("value")), 4).alias("value"))
    )


def reconcile_statements(cash_flow: DataFrame, balance: DataFrame, income: DataFrame, equity: DataFrame,
                         note_cash: DataFrame, materiality: Materiality | None = None) -> DataFrame:
    """Tie-outs between statements: ending cash, net profit, and the cash note."""
    m = materiality or Materiality()
    keys = ["doc_id", "period_ord"]
    bs = line_item(balance, "110", "expected")
    pairs = [
        ("RECON_CF_VS_BS_CASH", line_item(cash_flow, "70", "actual").join(bs, keys)),
        (
            "RECON_IS_VS_EQUITY_PROFIT",
            line_item(income, "60", "expected").join(line_item(equity, "50", "actual"), keys),
        ),
        (
            "RECON_NOTE_4_CASH_VS_BS",
            note_cash.select("doc_id", F.lit(0).alias("period_ord"), F.col("value").alias("actual")).join(bs, keys),
        ),
    ]
    out = None
    for rule, df in pairs:
        part = to_evidence(
            df.withColumnRenamed("expected", "_e").withColumnRenamed("actual", "_a"), rule, F.lit(rule), F.col("_e"), F.col("_a"),
            m.tolerance(F.greatest(F.abs("_e"), F.abs("_a")), "RECONCILIATION"),
        ).drop("_e", "_a")
        out = part if out is None else out.unionByName(part)
    return out


def is_narrative(rows: DataFrame) -> DataFrame:
    """Statements whose codes are mostly single letters or small roman numerals."""
    code = F.lower(F.trim("code"))
    narrative = code.rlike(r"^[a-z]$") | code.isin("i", "ii", "iii", "iv", "v", "vi")
    return rows.groupBy("doc_id", "statement_type").agg(
        F.coalesce(F.avg(F.when(code != "", narrative.cast("double"))) >= 0.3, F.lit(False)).alias("is_narrative")
    )


def balance_form(rows: DataFrame) -> DataFrame:
    """New or old balance-sheet form, by which marker codes occur more."""
    hits = lambda codes: F.count_distinct(F.when(F.col("code").isin(codes), F.col("code")))
    return rows.groupBy("doc_id").agg(
        hits(C.NEW_FORM_MARKERS).alias("new_hits"), hits(C.OLD_FORM_MARKERS).alias("old_hits")
    ).withColumn("is_new_form", F.col("new_hits") > F.col("old_hits"))
