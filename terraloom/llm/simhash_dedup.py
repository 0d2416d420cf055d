"""SimHash near-dedup: fingerprints of word shingles, linked through vantage-point trees.

Two fingerprints within DISTANCE = 3 bits agree to within 1 bit on their upper or on their lower
32 bits. So each half has a vantage-point tree of its own, with radius 1: a node has a vantage
point and a threshold; what is nearer goes left, the rest right, and by the triangle inequality
only fingerprints within the radius of the threshold go both ways. Leaves are shards; each holds
its own fingerprints and those over its boundary, and is searched apart for exact pairs on all 64
bits, along a smaller tree of the same kind in memory. (One tree over 64 bits at radius 3 is the same search, but more than half of all random
fingerprints lie within 3 of any threshold, against a quarter within 1 of 32 bits.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, share, text_or_empty, written
from .components import components, union

#: Fingerprints that a leaf has of its own, about, and at most leaves; rows of one block of a leaf.
LEAF, MOST_LEAVES, BLOCK = 1 << 14, 1 << 16, 1 << 16
#: The trees are built from a sample of this many fingerprints for each leaf; all are routed.
SAMPLE = 32
#: Fingerprints that a leaf of the tree within a shard has of its own, about.
WITHIN = 256


def fingerprint(text: bytes, words: int = 3) -> int:
    return int(_fingerprints([text], words)[0])


def _fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """A SimHash for each UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    ends = []
    for t in texts:
        w = t.lower().split()  # bytes: A-Z and ASCII white space only
        if len(w) > words:
            if words == 3:
                shingles = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:])]
            else:
                shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
            hashes += [xxh64_intdigest(s, 42) for s in shingles]
        elif w:
            hashes.append(xxh64_intdigest(b" ".join(w), 42))
        ends.append(len(hashes))
    out = np.zeros(len(texts), np.uint64)
    h, start = np.array(hashes, np.uint64), 0
    for i, end in enumerate(ends):
        if end > start:
            bits = np.zeros(64, np.int64)
            for at in range(start, end, 1 << 14):
                part = h[at : min(end, at + (1 << 14))]
                bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * bits > end - start, bitorder="little").view(np.uint64)[0]
        start = end
    return out


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out = batch.column(1), []
            for at in range(0, len(column), 64):
                out.append(_fingerprints(column.slice(at, 64).to_pylist(), words))
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text_or_empty(text).cast("binary").alias("t")).mapInArrow(run, f"`{key}` {kind}, fp long")


def halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fp >> np.uint64(32)).astype(np.uint32), (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def build_tree(sample: np.ndarray, leaf: int, radius: int, rng: np.random.Generator) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, threshold, left, right), the root first; a child below 0 is leaf -1 - child.

    Of a few candidate vantage points and thresholds, the one with the least copies for what it
    tells: the logarithm of one plus the boundary's share, over the entropy of the division. A part
    that none divides well is a leaf.
    """
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(part: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(part) > leaf:
            for vp in rng.choice(part, min(8, len(part)), replace=False):
                upto = np.cumsum(np.bincount(np.bitwise_count(part ^ vp), minlength=33)) / len(part)
                for t in range(32):
                    p = upto[t]
                    if 0.2 <= p <= 0.8:
                        both = upto[min(32, t + radius)] - (upto[t - radius] if t >= radius else 0)
                        cost = np.log2(1 + both) / -(p * np.log2(p) + (1 - p) * np.log2(1 - p))
                        if both < 0.8 and (best is None or cost < best[0]):
                            best = (cost, vp, t)
        if best is None:
            leaves += 1
            return -leaves
        _, vp, t = best
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = np.bitwise_count(part ^ vp) <= t
        nodes[at] = (int(vp), t, grow(part[near]), grow(part[~near]))
        return at

    root = grow(sample)
    return nodes if root >= 0 else []


def route(nodes: list[tuple[int, int, int, int]], x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaves that each of x falls in; home marks its own, the others have it over their boundary."""
    if not nodes:
        return np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    rows, leaves, homes = [], [], []
    stack = [(0, np.arange(len(x)), np.ones(len(x), bool))]
    while stack:
        node, row, home = stack.pop()
        if not len(row):
            continue
        if node < 0:
            rows.append(row), leaves.append(np.full(len(row), -1 - node)), homes.append(home)
            continue
        vp, t, left, right = nodes[node]
        d = np.bitwise_count(x[row] ^ np.uint32(vp)).astype(np.int16)
        go = d <= t + radius
        stack.append((left, row[go], home[go] & (d[go] <= t)))
        go = d > t - radius
        stack.append((right, row[go], home[go] & (d[go] > t)))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def link(own: np.ndarray, all_: np.ndarray, distance: int) -> np.ndarray:
    """labels over all_: the smallest index that is linked to each through pairs (one of own, any) within distance.
    own holds indices into all_."""
    labels = np.arange(len(all_))
    step = max(1, (1 << 21) // max(1, len(all_)))
    for at in range(0, len(own), step):
        part = own[at : at + step]
        a, b = np.nonzero(np.bitwise_count(all_[part][:, None] ^ all_[None, :]) <= distance)
        a = part[a]
        apart = a != b
        union(labels, a[apart], b[apart])
    return labels


def search(half: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int, distance: int) -> np.ndarray:
    """As link(), for a shard of any size: along a tree over the half that it is a shard of."""
    rate = min(1.0, (1 << 14) / max(len(own), 1))
    sample = half[own[:: max(1, round(1 / rate))]] if len(own) else half[:0]
    nodes = build_tree(np.sort(sample), max(1, int(WITHIN * rate)), radius, np.random.default_rng(len(fp)))
    row, leaf, home = route(nodes, half, radius)
    asks = np.zeros(len(fp), bool)
    asks[own] = True
    order = np.argsort(leaf, kind="stable")
    labels = np.arange(len(fp))
    for some in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
        members = row[some]
        found = link(np.flatnonzero(home[some] & asks[members]), fp[members], distance)
        off = np.flatnonzero(found != np.arange(len(found)))
        union(labels, members[off], members[found[off]])
    return labels


def simhash_links(groups: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): links among groups (fp, rep), as reps, that join all fingerprints within distance and no others.

    Each shard returns a tree of links for each set that it joins, never all pairs. A shard of many
    fingerprints is searched in blocks, so no task holds one whole.
    """
    radius = distance // 2
    spark = groups.sparkSession
    count = groups.count()
    leaves = min(MOST_LEAVES, max(1, count // LEAF))
    sample = groups.where(share(F.col("fp"), min(0.5, SAMPLE * leaves / max(count, 1)))).select("fp").toArrow().column("fp").to_numpy()  # at most SAMPLE * MOST_LEAVES, about
    sample = np.sort(sample.view(np.uint64))
    rate = max(len(sample), 1) / max(count, 1)
    rng = np.random.default_rng(5)
    trees = []
    for half in halves(sample):
        nodes = build_tree(half, max(1, int(LEAF * rate)), radius, rng)
        _, leaf, _ = route(nodes, half, radius)
        blocks = np.maximum(1, np.ceil(np.bincount(leaf, minlength=1 if not nodes else len(nodes) + 1) / rate / BLOCK)).astype(np.int64)
        trees.append((nodes, blocks))
    shared = spark.sparkContext.broadcast(trees)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rep = batch.column(1).to_numpy(zero_copy_only=False)
            spread = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for which, (half, (nodes, blocks)) in enumerate(zip(halves(fp), shared.value, strict=True)):
                row, leaf, home = route(nodes, half, radius)
                n = blocks[np.minimum(leaf, len(blocks) - 1)]
                mine = (spread[row] % n.astype(np.uint64)).astype(np.int64)
                # block pairs (i, j): own fingerprints of block i against all of block j
                for i in range(int(n.max(initial=1))):
                    for role in (0, 1):
                        some = (n > i) & (home if role == 0 else True)
                        r = row[some]
                        x, y = (mine[some], np.full(len(r), i)) if role == 0 else (np.full(len(r), i), mine[some])
                        if role == 1 and (same := (n[some] == 1)).any():
                            keep = ~(same & home[some])  # these are there in role 0 already
                            r, x, y, some = r[keep], x[keep], y[keep], np.flatnonzero(some)[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(((leaf[some] * 2 + which) << 24) | (x << 12) | y), pa.array(fp[r].view(np.int64)), pa.array(rep[r]), pa.array(np.full(len(r), role, np.int8))], names=["cell", "fp", "rep", "role"])

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable", ignore_index=True)
        fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        which = int(rows["cell"].iloc[0]) >> 24 & 1
        labels = search(halves(fp)[which], fp, np.flatnonzero(rows["role"].to_numpy() == 0), radius, distance)
        off = np.flatnonzero(rep[labels] != rep)
        return pd.DataFrame({"a": rep[off], "b": rep[labels[off]]})

    sent = groups.select("fp", "rep").mapInArrow(send, "cell long, fp long, rep long, role tinyint")
    return sent.groupBy("cell").applyInPandas(pairs, "a long, b long").distinct()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) for each of docs' rows.

    Equal fingerprints are one group, however many rows have them; groups are linked, and
    component_id is the smallest key reachable. Null and empty texts and texts without a word have
    fingerprint zero and are linked like any other. Repeated rows and keys are rows of their own;
    rows whose key is null get a component by their fingerprint's other keys, or null. key must be
    an integer column. An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, words, text, key), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min(key).cast("long").alias("rep")).where("rep IS NOT NULL"), "fp-groups")
    linked = components(simhash_links(groups, distance), "a", "b")
    named = groups.join(linked, groups["rep"] == linked["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(named, "fp", "left").select(key, hex_, "component_id")


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' rows that are the smallest key of their component (all of them, if that key is repeated)."""
    kept = simhash_components(docs, words, distance, text, key).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, docs[key] == kept["_kept"], "left_semi")
