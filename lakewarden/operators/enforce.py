"""Checking and repairing ordered action plans against rules, as folds over arrays.

Rules are data.  They become literal arrays that one aggregate() folds over with the plan
and its violations as state, so the expression grows with the number of rules, not with
their product, and a whole table of plans is one projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.text import contains_all, contains_any

VIOLATION = "struct<rule_id:string,severity:string,type:string,action:string,repair:string,missing_before:string>"
STATE = f"struct<plan:array<string>,violations:array<{VIOLATION}>>"


@dataclass(frozen=True)
class Rule:
    """A policy rule; ``scope`` holds lists of needles by name of predicate."""

    rule_id: str
    kind: str
    action: str
    severity: str = "hard"
    before: str | None = None
    scope: dict[str, list[str]] = field(default_factory=dict)


def check_rules(rules: list[Rule]) -> None:
    """Raises ValueError where an order rule depends on itself, directly or in a cycle."""
    needs: dict[str, set[str]] = {}
    for r in rules:
        if r.kind == "prohibit_before" and r.before:
            needs.setdefault(r.action, set()).add(r.before)
    done: set[str] = set()
    for first in needs:
        trail: list[tuple[str, list[str]]] = [(first, sorted(needs[first]))]
        active = {first}
        while trail:
            at, rest = trail[-1]
            if not rest:
                trail.pop()
                active.discard(at)
                done.add(at)
                continue
            then = rest.pop()
            if then in active:
                raise ValueError(f"order rules form a cycle at {then}")
            if then not in done:
                active.add(then)
                trail.append((then, sorted(needs.get(then, ()))))


def scope_predicate(scope: dict[str, list[str]]) -> Column:
    """Whether an event (event_type, category, command, severity, details_text) lies in a scope.

    All predicates that have needles must hold: any needle for each, but all of them for the
    command.  A scope without needles matches nothing.  Nulls count as empty texts.
    """
    parts = []
    for name, column, every in (
        ("event_type_contains", "event_type", False), ("category_contains", "category", False), ("command_contains", "command", True),
        ("details_text_contains", "details_text", False), ("severity_contains", "severity", False),
    ):
        if scope.get(name):
            text = F.lower(F.coalesce(F.col(column), F.lit("")))
            parts.append(contains_all(text, scope[name]) if every else contains_any(text, scope[name]))
    if not parts:
        return F.lit(False)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def scope_flags(events: DataFrame, rules: list[Rule], key: str = "incident_id") -> DataFrame:
    """key, matched: the ids of the mandatory rules for which the key has an event in scope.

    One aggregation with map-side combine over all rules at once.
    """
    mandatory = [r for r in rules if r.kind == "mandatory"]
    if not mandatory:
        return events.select(key).distinct().withColumn("matched", F.array().cast("array<string>"))
    flags = events.groupBy(key).agg(*[F.bool_or(scope_predicate(r.scope)).alias(f"_{i}") for i, r in enumerate(mandatory)])
    return flags.select(key, F.array_compact(F.array(*[F.when(F.col(f"_{i}"), r.rule_id) for i, r in enumerate(mandatory)])).alias("matched"))


def _violation(rule: Column, kind: str, repair: str, missing: Column | None = None) -> Column:
    return F.struct(
        rule["rule_id"].alias("rule_id"), rule["severity"].alias("severity"), F.lit(kind).alias("type"), rule["action"].alias("action"),
        F.lit(repair).alias("repair"), (missing if missing is not None else F.lit(None).cast("string")).alias("missing_before"),
    )


def _rules(rules: list[Rule], kind: str) -> Column | None:
    own = [r for r in rules if r.kind == kind and (kind != "prohibit_before" or r.before)]
    if not own:
        return None
    return F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action"), F.lit(r.before).cast("string").alias("before")) for r in own])


def _state(plan: Column, violations: Column) -> Column:
    return F.struct(plan.alias("plan"), violations.alias("violations")).cast(STATE)


def start(plan: Column) -> Column:
    return _state(F.coalesce(plan, F.array().cast("array<string>")), F.array().cast(f"array<{VIOLATION}>"))


def add_missing(state: Column, rules: list[Rule], matched: Column) -> Column:
    """Mandatory rules in order: an action that is due and absent is put in front."""
    own = _rules(rules, "mandatory")
    if own is None:
        return state

    def step(acc: Column, r: Column) -> Column:
        due = F.array_contains(matched, r["rule_id"]) & ~F.array_contains(acc["plan"], r["action"])
        return F.when(due, _state(F.array_prepend(acc["plan"], r["action"]), F.array_append(acc["violations"], _violation(r, "missing_mandatory", "insert")))).otherwise(acc)

    return F.aggregate(own, state, step)


def put_in_order(state: Column, rules: list[Rule], passes: int | None = None) -> Column:
    """Order rules to a fixed point: what has to come before is moved or put before the first use.

    Rules without a cycle settle within (number of rules + 1) passes.  Each rule is reported once.
    """
    own = _rules(rules, "prohibit_before")
    if own is None:
        return state
    count = len([r for r in rules if r.kind == "prohibit_before" and r.before])
    often = F.flatten(F.array_repeat(own, passes or count + 1))

    def step(acc: Column, r: Column) -> Column:
        plan = acc["plan"]
        at, need = F.array_position(plan, r["action"]), F.array_position(plan, r["before"])
        wrong = (at > 0) & ((need == 0) | (need > at))
        cleared = F.array_remove(plan, r["before"])
        mended = F.array_insert(cleared, F.array_position(cleared, r["action"]).cast("int"), r["before"])
        reported = F.exists(acc["violations"], lambda v: (v["rule_id"] == r["rule_id"]) & (v["action"] == r["action"]) & (v["missing_before"] == r["before"]))
        told = F.when(reported, acc["violations"]).otherwise(F.array_append(acc["violations"], _violation(r, "order_violation", "insert_before", r["before"])))
        return F.when(wrong, _state(mended, told)).otherwise(acc)

    return F.aggregate(often, state, step)


def gate(state: Column, rules: list[Rule], gated: Column, approved: Column, defer: Column) -> Column:
    """Gated actions without approval are reported, and all copies removed unless ``defer``."""
    own = _rules(rules, "require_approval")
    if own is None:
        return state

    def step(acc: Column, r: Column) -> Column:
        held = F.array_contains(acc["plan"], r["action"]) & F.array_contains(gated, r["action"]) & ~F.array_contains(approved, r["action"])
        removed = _state(F.array_remove(acc["plan"], r["action"]), F.array_append(acc["violations"], _violation(r, "approval_required", "remove")))
        kept = _state(acc["plan"], F.array_append(acc["violations"], _violation(r, "approval_deferred", "defer_to_human_approval")))
        return F.when(held & defer, kept).when(held, removed).otherwise(acc)

    return F.aggregate(own, state, step)


def in_catalog(plan: Column, known: Column) -> Column:
    """The actions of ``plan`` that the catalog knows, in order, with repeats."""
    return F.filter(plan, lambda a: F.array_contains(known, a))


def enforce(plans: DataFrame, rules: list[Rule], catalog: list[tuple[str, bool]], plan: str = "plan", matched: str = "matched", approved: str = "approved", defer: Column | bool = False) -> DataFrame:
    """Adds enforced (the repaired plan) and found (its violations) to a table of plans.

    ``plans`` has the array columns ``plan``, ``matched`` (rule ids from scope_flags) and
    ``approved``; nulls count as empty, null actions are dropped.  Steps: keep catalog actions,
    add missing ones, order, approvals, keep catalog actions, drop repeats.
    """
    check_rules(rules)
    empty = F.array().cast("array<string>")
    known = F.array(*[F.lit(a) for a, _ in catalog]).cast("array<string>")
    gated = F.array(*[F.lit(a) for a, needs in catalog if needs]).cast("array<string>")
    have, sure = F.coalesce(F.col(matched), empty), F.coalesce(F.col(approved), empty)
    state = add_missing(start(in_catalog(F.coalesce(F.col(plan), empty), known)), rules, have)
    state = gate(put_in_order(state, rules), rules, gated, sure, defer if isinstance(defer, Column) else F.lit(defer))
    done = plans.withColumn("_state", state)
    return done.withColumns({"enforced": F.array_distinct(in_catalog(F.col("_state.plan"), known)), "found": F.col("_state.violations")}).drop("_state")
