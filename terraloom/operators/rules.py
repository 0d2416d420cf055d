"""Rules over roles and flags: which material a surface gets, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import has_all, has_any

RULE = ["ordinal", "role", "mask_all", "mask_any", "mask_none", "semantic", "priority", "material"]


def role_matches(role: Column, pattern: Column) -> Column:
    """A dotted role lies at or below a pattern; '*' and '' match all."""
    return pattern.isin("*", "") | (role == pattern) | F.startswith(role, F.concat(pattern, F.lit(".")))


def specificity(rules: DataFrame) -> DataFrame:
    """rules with specificity: 2 for each required flag, 1 for each optional or forbidden one, 2 for a role, 1 for each dot in it."""
    named = ~F.col("role").isin("*", "")
    dots = F.length("role") - F.length(F.replace(F.col("role"), F.lit(".")))
    score = 2 * F.bit_count("mask_all") + F.bit_count("mask_any") + F.bit_count("mask_none") + F.when(named, 2 + dots).otherwise(0)
    return rules.withColumn("specificity", score.cast("int"))


def matches(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that fits each request (role, ctx, semantic). rules is a table of some dozens of rows
    by nature, and is broadcast as such; the join condition is not an equality."""
    r = specificity(rules).select(*[F.col(c).alias(f"r_{c}") for c in [*RULE, "specificity"]])
    fits = role_matches(F.col("role"), F.col("r_role")) & has_all(F.col("ctx"), F.col("r_mask_all")) & ((F.col("r_mask_any") == 0) | has_any(F.col("ctx"), F.col("r_mask_any"))) & ~has_any(F.col("ctx"), F.col("r_mask_none")) & (F.col("r_semantic").isNull() | (F.col("r_semantic") == F.col("semantic")))
    return requests.join(F.broadcast(r), fits)


def resolve(requests: DataFrame, rules: DataFrame, fallback: str) -> DataFrame:
    """requests with material and the rule's ordinal: highest priority, then specificity, then the first rule.

    Different requests are resolved once and joined back, since surfaces repeat few combinations.
    """
    keys = ["role", "ctx", "semantic"]
    kinds = requests.select(*keys).distinct()
    best = matches(kinds, rules).groupBy(*keys).agg(F.min(F.struct((-F.col("r_priority")).alias("p"), (-F.col("r_specificity")).alias("s"), F.col("r_ordinal").alias("o"), F.col("r_material").alias("m"))).alias("b"))
    found = best.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("b.m").alias("material"), F.col("b.o").alias("rule"))
    same = [requests[k].eqNullSafe(found[f"_{k}"]) for k in keys]
    return requests.join(found, same, "left").drop(*[f"_{k}" for k in keys]).withColumn("material", F.coalesce("material", F.lit(fallback)))


def runtime_table(rules: DataFrame, materials: DataFrame) -> DataFrame:
    """Rules in the order in which they apply, with the index of their material (id, index)."""
    order = Window.orderBy(F.desc("priority"), F.desc("specificity"), "ordinal")
    m = materials.select(F.col("id").alias("material"), F.col("index").alias("material_index"))
    return specificity(rules).join(F.broadcast(m), "material").withColumn("place", F.row_number().over(order) - 1)


def faults(rules: DataFrame, materials: DataFrame, fallback: str, flag_bits: int) -> DataFrame:
    """(ordinal, fault): materials that don't exist, flags beyond those known, a fallback that doesn't exist (ordinal -1)."""
    known = materials.select(F.col("id").alias("material"))
    unknown = rules.join(known, "material", "left_anti").select("ordinal", F.concat(F.lit("unknown material: "), "material").alias("fault"))
    beyond = (F.col("mask_all").bitwiseOR(F.col("mask_any")).bitwiseOR(F.col("mask_none"))).bitwiseAND(F.lit(~((1 << flag_bits) - 1))) != 0
    flags = rules.where(beyond).select("ordinal", F.lit("unknown flag").alias("fault"))
    there = known.where(F.col("material") == fallback).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(-1).alias("ordinal"), F.lit(f"unknown fallback: {fallback}").alias("fault"))
    return unknown.union(flags).union(there)


def first_by_prefix(role: Column, table: list[tuple[str, object]], default) -> Column:
    """The value of the first prefix in table that a role lies at or below."""
    out = None
    for prefix, value in table:
        hit = (role == prefix) | F.startswith(role, F.lit(prefix + "."))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def longest_prefix(rows: DataFrame, role: str, table: DataFrame, default: str) -> DataFrame:
    """rows with value: that of the longest prefix (prefix, value) of the role. Each role is cut into its
    prefixes, so the join is by equality."""
    parts = F.split(role, r"\.")
    kinds = rows.select(role).distinct()
    cut = kinds.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("prefix", F.array_join(F.slice(parts, F.lit(1), F.col("_n")), "."))
    best = cut.join(table, "prefix").groupBy(role).agg(F.max_by("value", "_n").alias("value"))
    return rows.join(best, role, "left").withColumn("value", F.coalesce("value", F.lit(default)))
