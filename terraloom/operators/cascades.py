"""First-match cascades: ordered predicates that each name a class and a confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = tuple[str, Column, float]


def first_match(rows: DataFrame, steps: Sequence[Step], name: str, default: tuple[str, float], factor: Column | None = None) -> DataFrame:
    """rows with name and name_confidence by the first step whose predicate holds; unknown counts as false."""
    label, sure = None, None
    for what, when, confidence in steps:
        hit = F.coalesce(when, F.lit(False))
        label = F.when(hit, what) if label is None else label.when(hit, what)
        sure = F.when(hit, confidence) if sure is None else sure.when(hit, confidence)
    sure = sure.otherwise(default[1])
    return rows.withColumns({name: label.otherwise(default[0]), f"{name}_confidence": sure * factor if factor is not None else sure})


def surface_classes() -> list[Step]:
    """Classes of points by height above ground (hag), shape, density and intensity; thresholds are fixed values."""
    c = F.col
    wall = (c("verticality") > 0.65) & (c("planarity") > 0.45) & (c("hag") > 1.5)
    roof = (c("verticality") < 0.35) & (c("planarity") > 0.5) & (c("hag") > 2.5)
    return [
        ("noise", (c("density") < 0.05) & (c("hag") > 8), 0.5),
        ("road", (c("hag") < 0.25) & (c("planarity") > 0.35) & (c("intensity") < 0.28), 0.55),
        ("ground", c("hag") < 0.25, 0.8),
        ("wire", (c("linearity") > 0.65) & (c("density") < 3) & (c("hag") > 4) & (c("verticality") < 0.35), 0.55),
        ("pole", (c("linearity") > 0.65) & (c("hag") > 1.5) & (c("verticality") > 0.7), 0.6),
        ("building", wall | roof, 0.7),
        ("vegetation", c("hag") > 0.5, 0.5),
    ]


def point_roles() -> list[Step]:
    """Roles of points by class and shape; thresholds are fixed values."""
    c = F.col
    built, planar = c("class") == "building", c("planarity") > 0.4
    return [
        ("structure.wall", built & planar & (c("verticality") > 0.62) & (c("hag") > 0.8), 0.75),
        ("structure.roof.pitched", built & planar & (c("slope") > 12) & (c("hag") > 2), 0.7),
        ("structure.roof.flat", built & planar & (c("hag") > 2), 0.7),
        ("structure.slab", built & planar, 0.5),
        ("structure.wall", built, 0.4),
        ("ground.road", c("class") == "road", 0.8),
        ("ground.terrain", c("class") == "ground", 0.8),
        ("vegetation.canopy", c("class") == "vegetation", 0.7),
        ("prop.pole", c("class") == "pole", 0.7),
        ("prop.wire", c("class") == "wire", 0.65),
    ]


def inferred_classes() -> list[Step]:
    """Classes of points by height above ground, shape, density, intensity and returns; thresholds are fixed values.

    Rows bring the facts of the whole cloud: several_returns (any pulse came back twice) and vehicles (dense enough
    near the ground to tell them).
    """
    c = F.col
    hag, up, flat = c("hag"), c("verticality"), c("planarity")
    thin = (c("linearity") > 0.65) & (c("density") < 3)
    scattered = c("sphericity") > 0.13
    canopy = scattered & c("several_returns") & (c("num_returns") > 1)
    clutter = scattered & c("several_returns")
    return [
        ("noise", (c("density") < 0.05) & (hag > 8), 0.5),
        ("road", (hag < 0.25) & (flat > 0.35) & (c("intensity") < 0.28), 0.55),
        ("ground", hag < 0.25, 0.8),
        ("water", (hag > -0.6) & (hag < 0.35) & (c("intensity") < 0.05) & (flat > 0.5), 0.5),
        ("wire", thin & (hag > 4) & (up < 0.35), 0.55),
        ("pole", thin & (hag > 1.5) & (up > 0.7), 0.6),
        ("building", ((up > 0.65) & (flat > 0.45) & (hag > 1.5)) | ((up < 0.35) & (flat > 0.5) & (hag > 2.5)), 0.7),
        ("vegetation_high", canopy & (hag > 2), 0.75),
        ("vegetation_low", canopy & (hag > 0.35), 0.65),
        ("building", clutter & (hag > 2.5), 0.45),
        ("vegetation_low", clutter & (hag > 0.35), 0.4),
        ("vegetation_high", scattered & (hag > 2), 0.65),
        ("vegetation_low", scattered & (hag > 0.35), 0.6),
        ("vehicle", c("vehicles") & (hag > 0.3) & (hag < 2.6) & (flat > 0.3) & ~scattered, 0.4),
        ("fence", (hag > 0.3) & (hag < 2.5) & (up > 0.6), 0.4),
        ("ground", hag < 1.5, 0.4),
    ]


def infer(rows: DataFrame, overwrite: bool = False, labelled: float = 0.02) -> DataFrame:
    """rows with semantic and semantic_confidence.

    rows have hag, linearity, planarity, sphericity, verticality, density, and may have intensity (0.3 where there
    is no such column), num_returns and semantic (null or 'unclassified': no label). Published labels are kept,
    at 0.95, where more than `labelled` of the rows have one; the rest is inferred at 0.8 of its confidence, unless
    fewer than 32 rows or 2 in 1000 have none: then they stay as they are, at 0.3, as does any confidence that rows bring.
    The facts of the whole cloud are one row.
    """
    has = set(rows.columns)
    published = F.coalesce(F.col("semantic") != "unclassified", F.lit(False)) if "semantic" in has else F.lit(False)
    low = (F.col("hag") > 0.3) & (F.col("hag") < 2.6)
    facts = rows.agg(
        # densities are counts over a constant, so the percentile's buffer holds few different values
        F.coalesce(F.percentile(F.when(low, F.col("density")), F.lit(0.9)) >= 1.0, F.lit(False)).alias("vehicles"),
        F.coalesce(F.max("num_returns") > 1, F.lit(False)).alias("several_returns") if "num_returns" in has else F.lit(False).alias("several_returns"),
        F.count_if(published).alias("_labelled"),
        F.count(F.lit(1)).alias("_rows"),
    )
    kept, hurt = "_kept", "_whole"
    facts = facts.withColumns({kept: F.lit(not overwrite) & (F.col("_labelled") > labelled * F.col("_rows")), hurt: F.col("_rows") - F.col("_labelled") < F.greatest(F.lit(32.0), 0.002 * F.col("_rows"))})
    met = rows.withColumn("_published", published).crossJoin(F.broadcast(facts))  # one row
    for name, value in (("intensity", F.lit(0.3)), ("num_returns", F.lit(None).cast("int")), ("semantic", F.lit("unclassified"))):
        if name not in has:
            met = met.withColumn(name, value)
    met = first_match(met, inferred_classes(), "_class", ("unclassified", 0.35))
    before = F.coalesce("semantic", F.lit("unclassified"))
    stays = F.col(kept) & (F.col("_published") | F.col(hurt))
    own = F.when(F.col("_published"), 0.95).otherwise(0.3)
    if "semantic_confidence" in has:
        own = F.when(F.col(hurt), F.col("semantic_confidence")).otherwise(own)
    sure = F.when(stays, own).when(F.col(kept), F.col("_class_confidence") * 0.8).otherwise(F.col("_class_confidence"))
    out = met.withColumns({"semantic": F.when(stays, before).otherwise(F.col("_class")), "semantic_confidence": sure})
    mine = {"vehicles", "several_returns", "_labelled", "_rows", kept, hurt, "_published", "_class", "_class_confidence"}
    return out.drop(*mine, *({"intensity", "num_returns"} - has))


#: fixed values
ROLE_THRESHOLDS = {"crease": 0.30, "corner": 0.28, "boundary": 0.55, "wall_verticality": 0.62, "roof_verticality": 0.40, "pitched_slope_deg": 12.0, "planar": 0.35}


def surface_roles(thresholds: dict[str, float] | None = None) -> list[Step]:
    """Roles of points by class, shape and how their surface runs: edges and corners before the surfaces they part.
    Names, order and confidences are fixed values; thresholds can be replaced one by one."""
    th = ROLE_THRESHOLDS | (thresholds or {})
    c = F.col
    built, up = c("semantic").isin("building", "bridge"), c("verticality")
    crease, rim, planar = built & (c("crease_score") > th["crease"]), built & (c("boundary") > th["boundary"]), built & (c("planarity") > th["planar"])
    level = planar & (up < th["roof_verticality"])
    whole = {
        "road": ("terrain.road", 0.8), "water": ("terrain.water", 0.7), "ground": ("terrain.ground", 0.8),
        "vegetation_high": ("volume.vegetation.high", 0.7), "vegetation_low": ("volume.vegetation.low", 0.65),
        "pole": ("linear.pole", 0.7), "wire": ("linear.wire", 0.65), "fence": ("linear.fence", 0.6),
        "vehicle": ("instance.vehicle", 0.6), "person": ("instance.prop", 0.5),
    }
    return [
        ("corner.trihedral", built & (c("corner_score") > th["corner"]), 0.6),
        ("edge.crease.convex", crease & (up > th["wall_verticality"]), 0.55),
        ("edge.ridge", crease, 0.5),
        ("edge.eave", rim & (up < th["roof_verticality"]), 0.5),
        ("edge.boundary.free", rim, 0.45),
        ("surface.wall.vertical", planar & (up > th["wall_verticality"]) & (c("hag") > 0.8), 0.75),
        ("surface.roof.pitched", level & (c("slope") > th["pitched_slope_deg"]) & (c("hag") > 2), 0.7),
        ("surface.roof.flat", level & (c("hag") > 2), 0.7),
        ("surface.slab", level, 0.5),
        ("surface.wall.vertical", built, 0.4),
        *[(role, c("semantic") == kind, sure) for kind, (role, sure) in whole.items()],
    ]


def classify(rows: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """rows (semantic, hag, nz, verticality, planarity, boundary, crease_score, corner_score) with role and
    role_confidence, which halves as semantic_confidence, if there is one, goes to 0."""
    sloped = rows.withColumn("slope", F.degrees(F.acos(F.least(F.lit(1.0), F.abs("nz")))))
    sure = 0.5 + 0.5 * F.col("semantic_confidence") if "semantic_confidence" in rows.columns else None
    return first_match(sloped, surface_roles(thresholds), "role", ("unknown", 0.4), sure)


def role_histogram(rows: DataFrame) -> DataFrame:
    """(role, n), for the roles that occur."""
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def density_gate(rows: DataFrame, low: float = 0.3, high: float = 2.6, p: float = 0.9, least: float = 1.0) -> DataFrame:
    """One row, `supported`: whether the density at vehicle height lets vehicles be told at all."""
    return rows.where((F.col("hag") > low) & (F.col("hag") < high)).agg((F.coalesce(F.percentile("density", F.lit(p)), F.lit(0.0)) >= least).alias("supported"))


def owners(rows: DataFrame, band: float = 0.5) -> DataFrame:
    """rows with owner: elevated roof, then parking, sidewalk, pavement, then the building's ground."""
    c = F.col
    on_ground = F.abs(c("hag")) <= band
    return rows.withColumn("owner", F.when(c("in_building") & ~on_ground, "roof").when(c("in_parking") & on_ground, "parking").when(c("in_sidewalk") & on_ground, "sidewalk").when(c("in_pavement") & on_ground, "pavement").when(c("in_building"), "building_ground"))


def remap(rows: DataFrame, code: str, table: DataFrame, default: str = "unclassified") -> DataFrame:
    """rows with class by a small code table (code, class)."""
    t = table.select(F.col("code").alias(code), F.col("class").alias("class"))
    return rows.join(F.broadcast(t), code, "left").withColumn("class", F.coalesce("class", F.lit(default)))


def vocabulary_coverage(codes: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """(vocabulary, coverage, top): the share of the different codes that each vocabulary (vocabulary, code) knows."""
    ids = codes.select("code").distinct()
    names = vocabularies.select("vocabulary").distinct()
    total = ids.agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("top"))
    hit = ids.join(vocabularies.select("vocabulary", "code").distinct(), "code").groupBy("vocabulary").agg(F.count(F.lit(1)).alias("k"))
    return names.join(hit, "vocabulary", "left").crossJoin(total).select("vocabulary", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("coverage"), "top")


def detect_vocabulary(codes: DataFrame, vocabularies: DataFrame, least: float = 0.9, ambiguous_top: int = 9) -> DataFrame:
    """One row, vocabulary: the best covering one, 'unknown' if none covers enough, or if several tie on low codes only."""
    c = vocabulary_coverage(codes, vocabularies).where(F.col("coverage") >= least)
    best = c.agg(F.max("coverage").alias("b"))
    tied = c.join(F.broadcast(best), F.col("coverage") == F.col("b")).agg(F.count(F.lit(1)).alias("n"), F.min("vocabulary").alias("v"), F.max("top").alias("top"))
    return tied.select(F.when((F.col("n") == 0) | ((F.col("n") > 1) & (F.col("top") <= ambiguous_top)), "unknown").otherwise(F.col("v")).alias("vocabulary"))
