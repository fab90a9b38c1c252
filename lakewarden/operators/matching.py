"""Matching events to technique rules and texts to actions by needles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.text import contains_any


@dataclass(frozen=True)
class TechniqueRule:
    rule_id: str
    technique_id: str
    tactic_id: str
    event_type: list[str]
    command: list[str] = ()
    category: list[str] = ()
    source_type: list[str] = ()
    weights: tuple[float, float, float, float] = (0.4, 0.3, 0.2, 0.1)
    least: float = 0.5


def candidates(events: DataFrame, rules: list[TechniqueRule]) -> DataFrame:
    """One row per event and rule whose event-type needles hit: rule_id, technique_id, tactic_id, least, score, signals.

    The rules compile into one array of structs per event, exploded where not null: a theta join
    without a join, as rules are few and known when the plan is made.
    """
    def text(c: str) -> Column:
        return F.lower(F.coalesce(F.col(c), F.lit("")))

    made = []
    for r in rules:
        score, signals = F.lit(float(r.weights[0])), [F.array(F.lit("event_type"))]
        for name, needles, weight in (("command", r.command, r.weights[1]), ("category", r.category, r.weights[2]), ("source_type", r.source_type, r.weights[3])):
            if needles:
                score = score + F.when(contains_any(text(name), list(needles)), float(weight)).otherwise(0.0)
                signals.append(F.array_compact(F.array(*[F.when(F.contains(text(name), F.lit(n.lower())), f"{name}:{n}") for n in needles])))
        row = F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.technique_id).alias("technique_id"), F.lit(r.tactic_id).alias("tactic_id"), F.lit(float(r.least)).alias("least"),
            F.least(F.round(score, 3), F.lit(1.0)).alias("score"), F.concat(*signals).alias("signals"),
        )
        made.append(F.when(contains_any(text("event_type"), list(r.event_type)), row))
    return events.withColumn("_m", F.explode(F.array_compact(F.array(*made)))).select(*events.columns, "_m.*")


def matches(found: DataFrame) -> DataFrame:
    """Candidates whose score reaches the rule's threshold."""
    return found.where(F.col("score") >= F.col("least"))


def evidence(command: str = "command", event_type: str = "event_type") -> Column:
    """"signals | command" (its first 120 characters), or the event type without a command."""
    return F.concat_ws(" | ", F.array_join("signals", ", "), F.coalesce(F.nullif(F.substring(F.col(command), 1, 120), F.lit("")), F.col(event_type)))


@dataclass(frozen=True)
class TextRule:
    action_id: str
    keywords: list[str]
    every: bool = False
    priority: int = 0


def ranked_rules(texts: DataFrame, text: str, rules: list[TextRule]) -> DataFrame:
    """Adds ranked: the rules that hit, best first (score, priority, hits; then the greatest action id), and verdict.

    verdict: zero, ambiguous (the best two are equal in score and priority), single or multi
    (keywords hit).  ``text`` should be in matching form; null and empty texts are zero.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = []
    for r in rules:
        hits = sum((F.when(F.contains(value, F.lit(k)), 1).otherwise(0) for k in r.keywords), F.lit(0))
        score = F.when(hits == len(r.keywords), hits).otherwise(0) if r.every else hits
        rows.append(F.when(score > 0, F.struct(score.alias("score"), F.lit(r.priority).alias("priority"), hits.alias("hits"), F.lit(r.action_id).alias("action_id"))))
    best = F.reverse(F.array_sort(F.array_compact(F.array(*rows))))
    out = texts.withColumn("ranked", best)
    one, two = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    verdict = (
        F.when(F.size("ranked") == 0, "zero").when((one["score"] == two["score"]) & (one["priority"] == two["priority"]), "ambiguous").when(one["hits"] == 1, "single").otherwise("multi")
    )
    return out.withColumn("verdict", verdict).withColumn("action_id", F.when(F.col("verdict").isin("single", "multi"), one["action_id"]))


def first_match(text: str, rules: list[TextRule]) -> Column:
    """The action of the first rule any of whose keywords hits, in the order of the rules."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(contains_any(F.lower(F.coalesce(F.col(text), F.lit(""))), list(r.keywords)), r.action_id).otherwise(out)
    return out


def parse_response(text: Column | str, key: str, known: list[str], fence_allowed: bool = False) -> Column:
    """What a model's JSON answer recommends: STRUCT<error, actions, skipped>.

    error: fenced, broken, no_object, no_key or no_list; null where the object has the list ``key``.
    actions: the items that are ``known``, trimmed, each once in first order; skipped: the others, with
    repeats.  A null text is broken.
    """
    text = F.trim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(" \t\r\n"))
    fenced = F.startswith(text, F.lit("```"))
    if fence_allowed:
        text = F.when(fenced, F.regexp_replace(text, r"(?m)^\s*```.*$", "")).otherwise(text)
        fenced = F.lit(False)
    parsed = F.try_parse_json(text)
    there = F.array_contains(F.json_object_keys(text), key)
    value = F.try_variant_get(parsed, f"$.{key}", "variant")
    is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    error = (
        F.when(fenced, "fenced").when(parsed.isNull(), "broken").when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "no_object")
        .when(~F.coalesce(there, F.lit(False)), "no_key").when(~F.coalesce(is_list, F.lit(False)), "no_list")
    )
    items = F.transform(F.coalesce(F.when(error.isNull(), F.try_variant_get(value, "$", "array<string>")), F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("None"))))
    names = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    return F.struct(
        error.alias("error"), F.array_distinct(F.filter(items, lambda x: F.array_contains(names, x))).alias("actions"),
        F.filter(items, lambda x: ~F.array_contains(names, x)).alias("skipped"),
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; the engine keeps only the best rows of a group while it sorts."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def actions_from_texts(found: DataFrame, key: str, order: list[str], default: str) -> DataFrame:
    """key, action_id, place: the actions that a key's texts map to, each once, in the order of their first text.

    ``found`` comes from ranked_rules(); a key none of whose texts maps to an action gets
    ``default`` alone.  Texts with a null key are left out.  Each action of a key is one row before
    they are ordered, so a key with many texts is no burden.
    """
    own = found.where(F.col(key).isNotNull())
    first = own.groupBy(key, "action_id").agg(F.min(F.struct(*order)).alias("_at"))
    any_found = Window.partitionBy(key)
    named = first.withColumn("_n", F.count("action_id").over(any_found)).where(F.col("action_id").isNotNull() | (F.col("_n") == 0))
    named = named.withColumn("action_id", F.coalesce("action_id", F.lit(default)))
    return named.select(key, "action_id", F.row_number().over(Window.partitionBy(key).orderBy("_at", "action_id")).alias("place"))
