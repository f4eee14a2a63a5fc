"""The rule interface, the registry and whole-model evaluation.

A rule maps the audit's frames to evidence rows; a run is the union of its rules' frames,
which Spark plans and executes as one job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.evidence import EVIDENCE_COLUMNS
from tieout.functions.tolerance import Materiality
from tieout.operators import classify as C
from tieout.operators import notes as N
from tieout.operators import results as R
from tieout.operators import statements as S
from tieout.operators.scans import one_chunk


@dataclass(frozen=True)
class Flags:
    """Job options. Some behaviours are fixed off, whatever a caller passes."""

    values: dict = field(default_factory=dict)
    forced_off: tuple = ("nonbaseline_code_pattern_routing_fallback", "nonbaseline_present_code_composition")

    def on(self, name: str, default: bool = False) -> bool:
        return False if name in self.forced_off else bool(self.values.get(name, default))


@dataclass
class AuditFrames:
    """Inputs of a run. ``notes`` rows need kind, seg, label, value; ``items`` are long statement rows.

    With ``table_types`` (doc_id, table_idx, table_type) a rule's evidence is kept only for tables of its
    types; with ``modes`` (doc_id, table_idx, mode) note rules run only in the modes that allow them.
    """

    notes: DataFrame | None = None
    items: DataFrame | None = None
    table_types: DataFrame | None = None
    modes: DataFrame | None = None
    materiality: Materiality = field(default_factory=Materiality)
    flags: Flags = field(default_factory=Flags)


class Rule(Protocol):
    rule_id: str
    severity: str
    table_types: list[str]

    def apply(self, frames: AuditFrames) -> DataFrame | None: ...


@dataclass
class FrameRule:
    """A rule from a plain function over the frames."""

    rule_id: str
    fn: object
    table_types: list[str]
    severity: str = "MAJOR"

    def apply(self, frames: AuditFrames) -> DataFrame | None:
        return self.fn(frames)


class Registry:
    """Rules per table type; registration order is kept and duplicates are ignored."""

    def __init__(self) -> None:
        self._rules: dict[str, list[Rule]] = {}

    def register(self, rule: Rule) -> "Registry":
        for kind in rule.table_types:
            known = self._rules.setdefault(kind, [])
            if all(r.rule_id != rule.rule_id for r in known):
                known.append(rule)
        return self

    def resolve(self, table_type: str) -> list[Rule]:
        return list(self._rules.get(table_type, []))

    def all(self) -> list[Rule]:
        seen: dict[str, Rule] = {}
        for rules in self._rules.values():
            for r in rules:
                seen.setdefault(r.rule_id, r)
        return list(seen.values())


def _scoped(frames: AuditFrames) -> DataFrame | None:
    if frames.notes is None:
        return None
    segs = N.segments(frames.notes, one_chunk(frames.notes), totals=True)
    return N.scoped_sums(frames.notes, N.scopes(frames.notes, segs), materiality=frames.materiality)


def _rolling(frames: AuditFrames) -> DataFrame | None:
    if frames.notes is None:
        return None
    return N.roll_forward(frames.notes, materiality=frames.materiality, segs=N.segments(frames.notes, one_chunk(frames.notes)))


def _netting(frames: AuditFrames) -> DataFrame | None:
    if frames.notes is None or not frames.flags.on("netting_blocks", True):
        return None
    return N.netting_check(N.netting_plan(frames.notes), materiality=frames.materiality)


def _of(kind: str, check) -> object:
    def run(frames: AuditFrames) -> DataFrame | None:
        if frames.items is None:
            return None
        return check(frames.items.where(F.col("statement_type") == kind), frames.materiality)

    return run


def default_registry() -> Registry:
    reg = Registry()
    reg.register(FrameRule("IS_FORMULA_CHECK", _of("FS_INCOME_STATEMENT", S.income_rules), ["FS_INCOME_STATEMENT"]))
    reg.register(FrameRule("CF_FORMULA_CHECK", _of("FS_CASH_FLOW", S.cash_flow_rules), ["FS_CASH_FLOW"]))
    reg.register(FrameRule("BS_FORMULA_CHECK", _of("FS_BALANCE_SHEET", S.balance_identities), ["FS_BALANCE_SHEET"]))
    reg.register(FrameRule("VERTICAL_SUM_SCOPED", _scoped, ["GENERIC_NOTE", "TAX_NOTE"]))
    reg.register(FrameRule("MOVEMENT_ROLLFORWARD", _rolling, ["GENERIC_NOTE", "FS_EQUITY"]))
    reg.register(FrameRule("NETTING_BLOCKS", _netting, ["GENERIC_NOTE"]))
    return reg


def _aligned(df: DataFrame) -> DataFrame:
    for c in EVIDENCE_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("long" if c == "table_idx" else "string"))
    return df.select(
        "doc_id", F.col("table_idx").cast("long").alias("table_idx"), *[c for c in EVIDENCE_COLUMNS if c not in ("doc_id", "table_idx")]
    )


def audit(frames: AuditFrames, registry: Registry | None = None) -> DataFrame:
    """Evidence of all registered rules, one frame, gated by table type and note mode where these are given."""
    parts = []
    for rule in (registry or default_registry()).all():
        part = rule.apply(frames)
        if part is None:
            continue
        part = _aligned(part)
        if frames.table_types is not None:
            kinds = frames.table_types.where(F.col("table_type").isin(rule.table_types)).select("doc_id", F.col("table_idx").cast("long").alias("table_idx"))
            part = part.join(kinds, ["doc_id", "table_idx"], "left_semi")
        allowed = sorted(mode for mode, rule_id in C.MODE_RULES if rule_id == rule.rule_id)
        if frames.modes is not None and allowed:
            modes = frames.modes.where(F.col("mode").isin(allowed)).select("doc_id", F.col("table_idx").cast("long").alias("table_idx"))
            part = part.join(modes, ["doc_id", "table_idx"], "left_semi")
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def audit_scores(evidence: DataFrame) -> DataFrame:
    return R.score(evidence)
