"""Records of what is known: repairs, gaps, programs, and how far a thing may be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weakest_proof(repairs: DataFrame, tiers: dict[str, int]) -> DataFrame:
    """(entity, tier, repair, evidence): the weakest step of each entity's repairs and all its evidence, sorted.

    repairs has entity, repair, tier, evidence (array). Higher rank is weaker; of equal ones the
    tier last by name.
    """
    rank = F.create_map(*[x for t, r in tiers.items() for x in (F.lit(t), F.lit(r))])
    found = repairs.withColumn("_k", F.coalesce(F.try_element_at(rank, F.col("tier")), F.lit(-1)))
    return found.groupBy("entity").agg(
        F.max(F.struct("_k", "tier", "repair")).alias("b"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"),
    ).select("entity", F.col("b.tier").alias("tier"), F.col("b.repair").alias("repair"), "evidence")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """(key, value, n): counts by each key apart and in all (key 'all'), in one pass of grouping sets."""
    sets = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    size = len(keys)
    name, value = F.lit("all"), F.lit("")
    for i, k in enumerate(keys):
        one = F.col("g") == ((1 << size) - 1 - (1 << (size - 1 - i)))
        name, value = F.when(one, k).otherwise(name), F.when(one, F.col(k).cast("string")).otherwise(value)
    return sets.select(name.alias("key"), value.alias("value"), "n")


def parameters_hash(params: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a map's JSON, its keys sorted."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 16)


def epistemic_state(cells: DataFrame, measured_bit: int, least: float = 0.35) -> DataFrame:
    """(node, measured, state) of lattice cells (node, ctx): derived if enough cells are measured, else inferred."""
    share = F.avg(F.when(F.col("ctx").bitwiseAND(measured_bit) != 0, 1.0).otherwise(0.0))
    return cells.groupBy("node").agg(share.alias("measured")).withColumn("state", F.when(F.col("measured") >= least, "derived").otherwise("inferred"))


def fold_confidence(nodes: DataFrame, rays: DataFrame, weight: float = 0.5, least: int = 8) -> DataFrame:
    """nodes (id, confidence) with the measured share of rays (id, rays, explained) folded in, within [0.05, 0.99]."""
    r = rays.where(F.col("rays") >= least).select("id", (F.col("explained") / F.col("rays")).alias("_m"))
    mixed = F.least(F.greatest((1 - weight) * F.col("confidence") + weight * F.col("_m"), F.lit(0.05)), F.lit(0.99))
    return nodes.join(r, "id", "left").withColumn("confidence", F.when(F.col("_m").isNull(), F.col("confidence")).otherwise(mixed)).drop("_m")


def admissible(layers: DataFrame, epoch: int, mode: str) -> DataFrame:
    """layers (id, role, epoch, independence) with admitted and reason: inputs and priors of the epoch or before it are
    read in 'reconstruction', everything in 'audit'; what validates is withheld."""
    later = F.col("epoch") > epoch
    reason = F.when(F.lit(mode) == "audit", None).when(F.col("role") == "truth", "withheld: truth").when(later, "withheld: later than the epoch").when(~F.col("role").isin("input", "prior"), F.concat(F.lit("withheld: role "), "role"))
    return layers.withColumns({"reason": reason, "admitted": reason.isNull()})


#: fixed values: gaps that no repair may fill, since nothing is missing there
NEVER_FILLED = ("true_void", "procedural_freedom")


def gap_summary(gaps: DataFrame) -> DataFrame:
    """(gap_type, gaps, fillable, refused, area) of gaps (gap_type, area), by type and in all (gap_type 'all'); unknown areas count as 0."""
    may = ~F.col("gap_type").isin(*NEVER_FILLED)
    counted = gaps.select("gap_type", F.coalesce("area", F.lit(0.0)).alias("area"), may.cast("int").alias("may"))
    out = counted.rollup("gap_type").agg(F.count(F.lit(1)).alias("gaps"), F.coalesce(F.sum("may"), F.lit(0)).alias("fillable"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.grouping("gap_type").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("gap_type")).alias("gap_type"), "gaps", "fillable", (F.col("gaps") - F.col("fillable")).alias("refused"), "area")


def program_summary(programs: DataFrame) -> DataFrame:
    """One row of programs (kind, parameters, residual): their cost in parameters, their kinds, and how much of what was
    measured (residual not null) they leave unexplained."""
    return programs.agg(
        F.count(F.lit(1)).alias("programs"), F.coalesce(F.sum("parameters"), F.lit(0)).alias("parameters"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count("residual").alias("measured"), F.avg("residual").alias("residual_mean"), F.max("residual").alias("residual_max"),
    )
