"""Embedding near-dedup: an exact metric range join over pivots.

For unit vectors cosine >= c is the same as distance <= r = sqrt(2 - 2c). Pivots partition each
label's vectors: a vector's own cell is its nearest pivot's. By the triangle inequality a partner
within r of a vector x of cell p is at most 2r farther from p than from its own pivot, so a vector
is replicated to cell p only if d(v, p) <= d(v, nearest) + 2r. In Euclidean space the boundary can
be drawn closer: only vectors within r of the hyperplane between the two pivots can have a partner
beyond it. Both bounds are applied, and a vector goes only to cells before its own, so that two
vectors of different cells meet once. Then each cell is joined apart, its own vectors against all,
in pairs of blocks; within a block, vectors are sorted by their distance to the pivot, and only
those whose distances differ by at most r are compared, by the triangle inequality again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import components, union

#: A label of n different vectors has the cube root of n, times this, pivots.
PIVOT_RATE = 0.5
#: Labels with pivots, pivots and numbers in their vectors at most, which bounds what is broadcast; other labels are one cell each, in blocks.
ALL_PIVOTS, ALL_NUMBERS = 16384, 1 << 22
#: Numbers in the vectors of a block, about; vectors of a block at most.
BLOCK_NUMBERS, BLOCK = 1 << 21, 8192
#: How far rounding may move a distance.
SLACK = 1e-6


def choose_pivots(groups: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """(label, vector's length) -> unit vectors of its pivots, drawn by hash from groups (l, g, v)."""
    counts = groups.groupBy("l", F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.ceil(F.cbrt(F.col("n").cast("double")) * PIVOT_RATE).cast("int"))
    most = counts.where("p > 1").orderBy(F.desc("n"), "l", "d").limit(ALL_PIVOTS).collect()
    plan, pivots, numbers = [], 0, 0
    for r in most:
        pivots, numbers = pivots + r["p"], numbers + r["p"] * r["d"]
        if pivots <= ALL_PIVOTS and numbers <= ALL_NUMBERS:
            plan.append((r["l"], r["d"], r["p"], min(1.0, 8 * r["p"] / r["n"])))
    if not plan:
        return {}
    spark = groups.sparkSession
    wanted = F.broadcast(spark.createDataFrame(plan, "l string, d int, p int, rate double"))  # at most ALL_PIVOTS rows
    scale = 1 << 30
    spot = F.pmod(F.xxhash64("g", F.lit(20011)), F.lit(scale))
    some = groups.select("l", "g", "v", F.size("v").alias("d")).join(wanted, ["l", "d"]).where(spot < F.col("rate") * scale)
    first = some.withColumn("at", F.row_number().over(Window.partitionBy("l", "d").orderBy(spot, "g"))).where(F.col("at") <= F.col("p"))
    out: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in first.select("l", "d", "v").orderBy("l", "d", "at").toLocalIterator():
        out.setdefault((r["l"], r["d"]), []).append(np.array(r["v"]) / np.linalg.norm(r["v"]))
    return {k: np.stack(v) for k, v in out.items()}


def cells(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own, distance): the cells of pivots p that unit vectors x go to, and how far they are from them."""
    d2 = np.maximum(0, 2 - 2 * x @ p.T)
    mine = d2.argmin(axis=1)
    near2 = d2[np.arange(len(x)), mine]
    apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 1e-18))
    by_triangle = np.sqrt(d2) <= np.sqrt(near2)[:, None] + 2 * radius + SLACK
    by_plane = (d2 - near2[:, None]) / (2 * apart[mine]) <= radius + SLACK
    go = by_triangle & by_plane & (np.arange(len(p)) < mine[:, None])
    go[np.arange(len(x)), mine] = True
    row, cell = np.nonzero(go)
    return row, cell, mine[row] == cell, np.sqrt(d2[row, cell])


def near_links(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row of vectors.

    Equal vectors of a label are one group for the join, and count as each other's partners. A
    label is cut into cells by pivots drawn by hash, at every size; a cell of many vectors is
    joined in pairs of blocks, so no task holds a cell whole. Each block returns counts of partners
    and a tree of links for each set, never all pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those whose
    label is null, link with nothing; vectors of different length don't link. Repeated rows are
    rows of their own and link with each other. Null keys take part as partners, and get
    component_id null if nothing they reach has a key. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    radius = float(np.sqrt(2 - 2 * least))
    item = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"  # what is sent
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(label).alias("l"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("l").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = written(rows.withColumn("g", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws("|", F.col("l").cast("string"), F.col("v").cast("string")), 256))), "vectors")
    groups = rows.where("g IS NOT NULL").groupBy("g").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("l").cast("string").alias("l"), F.first("v").alias("v"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "vector-groups")
    shared = spark.sparkContext.broadcast(choose_pivots(groups))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, labels, vecs, n = (batch.column(i) for i in range(4))
            keys: dict[tuple[str, int], list[int]] = {}
            for i in range(batch.num_rows):
                keys.setdefault((labels[i].as_py(), len(vecs[i].values)), []).append(i)
            for (name, size), at in keys.items():
                x = np.stack([vecs[i].values.to_numpy() for i in at])
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                p = shared.value.get((name, size))
                zero = np.zeros(len(at))
                row, cell, own, far = cells(unit, p, radius) if p is not None else (np.arange(len(at)), zero.astype(int), np.ones(len(at), bool), zero)
                take = pa.array(np.array(at)[row])
                sent = vecs.take(take).cast(pa.list_(pa.float32() if item == "float" else pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}/{size}"] * len(row)), pa.array(cell, pa.int32()), pa.array(own), pa.array(far), node.take(take), sent, n.take(take)], names=["l", "cell", "own", "far", "node", "v", "n"])

    sent = written(groups.select("node", "l", "v", "n").mapInArrow(send, f"l string, cell int, own boolean, far double, node long, v array<{item}>, n long"), "cells")
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.max(F.size("v")))))
    blocks = sent.groupBy("l", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("b"))
    dealt = sent.join(blocks, ["l", "cell"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("b")).cast("int"))
    # own vectors ask in row i of the cell's blocks, all are asked in column j; where that is one block, an own vector comes once
    span = F.sequence(F.lit(0), F.col("b") - 1)
    as_own = dealt.where("own").withColumn("i", F.col("mine")).withColumn("j", F.explode(span)).withColumn("asks", F.lit(True)).withColumn("asked", F.col("i") == F.col("j"))
    as_any = dealt.withColumn("j", F.col("mine")).withColumn("i", F.explode(span)).where("NOT own OR i <> j").withColumn("asks", F.lit(False)).withColumn("asked", F.lit(True))
    pairs = as_own.unionByName(as_any).select("l", "cell", "i", "j", "own", "asks", "asked", "far", "node", "v", "n")

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["far", "node"], kind="stable", ignore_index=True)
        own, node, n, far = rows["own"].to_numpy(), rows["node"].to_numpy(), rows["n"].to_numpy(), rows["far"].to_numpy()
        x = np.stack(rows["v"].to_numpy()).astype(float)
        length = np.linalg.norm(x, axis=1)
        unit = x / length[:, None]
        mine, theirs = np.flatnonzero(rows["asks"].to_numpy()), np.flatnonzero(rows["asked"].to_numpy())
        labels, count = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        reach = far[theirs]
        for at in range(0, len(mine), 256):
            a = mine[at : at + 256]
            b = theirs[np.searchsorted(reach, far[a[0]] - radius - SLACK) : np.searchsorted(reach, far[a[-1]] + radius + SLACK, "right")]
            cosine = unit[a] @ unit[b].T
            linked = (cosine >= least) & (node[a][:, None] != node[b][None, :])
            u, w = np.nonzero(np.abs(cosine - least) < 1e-9)  # so close that rounding counts
            linked[u, w] = (np.einsum("ij,ij->i", x[a[u]], x[b[w]]) / (length[a[u]] * length[b[w]]) >= least) & (node[a[u]] != node[b[w]])
            count[a] += linked @ n[b]
            count[b] += np.where(own[b], 0, n[a] @ linked)  # vectors of other cells meet here only
            u, w = np.nonzero(linked)
            union(labels, a[u], b[w])
        first = node[labels]
        keep = (count > 0) | (first != node)
        return pd.DataFrame({"a": node[keep], "b": first[keep], "n": count[keep]})

    found = written(pairs.groupBy("l", "cell", "i", "j").applyInPandas(join, "a long, b long, n long"), "links")
    linked = components(found.where("a <> b").distinct(), "a", "b")
    sums = found.groupBy("a").agg(F.sum("n").alias("others"))
    named = groups.select("g", "node", "n", "rep").join(linked, "node", "left").join(sums, groups["node"] == sums["a"], "left")
    lowest = named.where("rep IS NOT NULL").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("rep").alias("component_id"))
    named = named.withColumn("c", F.coalesce("component", "node")).join(lowest, "c", "left").select("g", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("k", "g").join(named, "g", "left")
    component = F.when(F.col("g").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").cast(kind).alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))
