"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, delete, text_or_empty, written

#: Rows that one sorted run of a source, or one bin of virtual time, holds on average.
RUN = 8192


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with rank, weight and target.

    The budget is share of all sizes. Targets are min(most * size, level * weight), with the level
    that spends the budget: sources sorted by how soon they are full, the full ones are a prefix; the
    level of what is left falls from the first source on that isn't full, so it is the highest that fits.
    """
    w = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "rank")
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(all_) * F.lit(float(share)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(all_))
    return w.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("full_at", "level", "cap")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["k"].eqNullSafe(b["_k"]) & a["src"].eqNullSafe(b["_source"]) & (a["c"] == b["_c"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken) for each of docs' rows, whatever its other columns are.

    Each source is a queue of its documents in an order shuffled by the MD5 of seed and key, run
    through up to `most` times. A document's virtual finish time is the source's tokens up to its
    end, over the source's target. All queues' documents are sorted by finish time and taken until
    the budget is spent, whatever their times.

    Nothing is sorted in one place: a source is cut into runs by the shuffle hash (their sums are
    added up first, then each run is summed within itself), and finish times into bins (equal
    ones up to time 2, then equal ones of its logarithm); only the bin in which the budget ends is sorted, to find the last document taken. All queues move
    at the same rate in virtual time, so the bins are even; a hot source has more runs.

    Null text has size 0, is in the mix, and takes nothing; a null source is a source of its own,
    ranked last. Documents of equal time go by source, MD5, key. Repeated rows are rows of their
    own. If all sizes are 0, every target and every taken is 0. An empty table gives an empty table.
    """
    out = _queue(docs, weights, share, most, seed, text, key, source)
    return out.select(F.col("_k").alias(key), "size", "source_size", "target", "taken")


def _queue(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: str, text: str, key: str, source: str) -> DataFrame:
    """(_k, _source, _c, size, source_size, target, taken): _c is a hash of the text."""
    size = F.size(F.regexp_extract_all(text_or_empty(text), F.lit(f"({WORDS})"), F.lit(1))).cast("long").alias("size")
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("_m")
    slim = written(docs.select(F.col(key).alias("_k"), F.col(source).alias("source"), size, digest, F.xxhash64(text_or_empty(text)).alias("_c")), "mix")
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = written(source_targets(stats, weights, share, most), "targets")
    spot = F.conv(F.substring("_m", 1, 8), 16, 10).cast("long")
    queued = slim.join(plan, slim["source"].eqNullSafe(plan["source"])).drop(slim["source"]).withColumn("run", F.floor(spot * F.ceil(F.col("rows") / RUN) / F.lit(float(1 << 32))).cast("long"))
    sums = queued.groupBy("rank", "run").agg(F.sum("size").alias("s"))
    ahead = sums.withColumn("ahead", F.sum("s").over(Window.partitionBy("rank").orderBy("run")) - F.col("s")).drop("s")
    within = Window.partitionBy("rank", "run").orderBy("_m", "_k", "size", "_c").rowsBetween(Window.unboundedPreceding, 0)
    timed = queued.withColumn("done", F.sum("size").over(within)).join(ahead, ["rank", "run"])
    timed = timed.withColumn("done", F.col("done") + F.col("ahead"))
    timed = written(timed.select("_k", "_m", "_c", "source", "size", "rank", "source_size", "target", "total", "done"), "queue")

    count, total = timed.agg(F.count(F.lit(1)), F.max("total")).first()
    budget = int(total or 0)
    bins = max(1, count * most // RUN)
    passes = [F.try_divide(F.col("done") + F.col("source_size") * i, "target") for i in range(most)]  # null where the target is 0
    entry = F.explode(F.array(*[F.struct(p.alias("time"), F.lit(i).alias("pass")) for i, p in enumerate(passes)]))
    items = timed.where("size > 0 AND target > 0").select("_k", "_m", "size", "rank", entry.alias("e")).select("_k", "_m", "size", "rank", "e.time", "e.pass")
    # equal bins up to time 2; later times, of sources whose target is less than their size, in as many bins for each doubling
    late = F.floor((F.log2(F.col("time") / 2) + 2) * bins) + 1
    items = items.withColumn("bin", F.when(F.col("time") <= 2, F.floor(F.col("time") * bins)).otherwise(late).cast("long"))
    by_bin = items.groupBy("bin").agg(F.sum("size").alias("s"))
    upto = by_bin.withColumn("upto", F.sum("s").over(Window.orderBy("bin")))
    last = upto.where(F.col("upto") >= budget).orderBy("bin").first() if budget else None
    if last:
        order = Window.orderBy("time", "rank", "_m", "_k", "pass", "size").rowsBetween(Window.unboundedPreceding, 0)
        edge = items.where(F.col("bin") == last["bin"]).withColumn("upto", F.sum("size").over(order) + F.lit(last["upto"] - last["s"]))
        cut = edge.where(F.col("upto") <= budget).orderBy(F.desc("upto"), F.desc("time"), F.desc("rank"), F.desc("_m"), F.desc("_k"), F.desc("pass")).first()
        if cut is None:
            cut = {"time": edge.agg(F.min("time")).first()[0], "rank": -1, "_m": "", "_k": None, "pass": -1}
    taken = F.lit(0).cast("long")
    if budget:
        for i, p in enumerate(passes):
            if last is None:
                inside = F.lit(True)
            else:
                same = (p == cut["time"])
                later_key = F.coalesce(F.col("_k") <= F.lit(cut["_k"]), F.lit(True)) if cut["_k"] is not None else F.col("_k").isNull()
                tie = (F.col("rank") < cut["rank"]) | ((F.col("rank") == cut["rank"]) & ((F.col("_m") < cut["_m"]) | ((F.col("_m") == cut["_m"]) & later_key)))
                inside = (p < cut["time"]) | (same & tie)
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & inside, F.col("size")).otherwise(F.lit(0))
    done = timed.select("_k", F.col("source").alias("_source"), "_c", "size", "source_size", "target", taken.alias("taken"))
    delete(slim)
    return done


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself, in docs' columns whatever their names: a document comes as often as it is taken.

    Rows with the same key, source and text come equally often: as often as the one taken most.
    """
    plan = _queue(docs, weights, share, most, seed, text, key, source).where("taken > 0")
    plan = plan.groupBy("_k", "_source", "_c").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = lambda c: F.col(names[docs.columns.index(c)])
    rows = docs.toDF(*names).withColumn("k", of(key)).withColumn("src", of(source)).withColumn("c", F.xxhash64(F.coalesce(of(text), F.lit(""))))
    met = rows.join(plan, _same(rows, plan))
    return met.select(*names, F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
