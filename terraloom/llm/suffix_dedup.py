"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts anywhere else, too, go.

No shard of a corpus can hold all suffixes, so equal strings are first brought together. Each window
of LENGTH bytes has an anchor: the K bytes in it with the least hash, the leftmost of equal ones.
Equal windows have equal anchors at the same place in them, and an anchor serves a run of windows,
whose bytes are its fragment. Anchors seen once have no equal window and are dropped by a count;
fragments seen more than once (by a hash of 128 bits) are repeated as a whole. What is left, different fragments with an
equal anchor, is what borders on shared passages: those fragments are sorted by suffixes in shards
of bounded size (suffix_sort), and adjacent suffixes with a common prefix of LENGTH bytes mark the
windows that repeat. An anchor with very many different fragments is dealt to several shards. Equal
windows in two of them share the bytes left and right of the anchor, so how far each fragment can
agree with any other on either side, by its neighbours in two sorted orders, leaves few windows
open; of those each shard tells the hashes, which are counted across shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, text_or_empty, written
from .suffix_sort import repeated_windows

LENGTH, K = 200, 64
#: Fragments of one anchor in one shard; bytes sorted at once, about; bits of the filter of documents at most.
SHARD, CHUNK, MOST_BITS = 512, 1 << 18, 1 << 27
#: Starts of windows of a document that are looked at at once: a longer document comes in pieces that overlap by a window.
PIECE = 1 << 20

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(raw: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): each anchor's hash and place, and the starts of the windows it serves."""
    n = len(raw)
    t = np.frombuffer(raw, np.uint8)
    up, down = _powers(n + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (prefix[k:] - prefix[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = length - k + 1
    rows = -(-len(v) // w)
    v = np.concatenate([v, np.full(rows * w - len(v), np.iinfo(np.uint64).max, np.uint64)]).reshape(rows, w)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    place = (np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows]) & low).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(new[1:] - 1, windows - 1)
    return h[place[new]].view(np.int64), place[new], new, last


def _anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, f, g, k, t, lo, size, c, at): fragments by anchor hash h and content hash (f, g), with the anchor
    at `at` in them; with h null, spans of a document that repeat within itself."""
    from xxhash import xxh3_128_digest  # noqa: F401  fails here rather than in a task

    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def table(batch: pa.RecordBatch, rows: list[list[np.ndarray]]) -> pa.RecordBatch:
            i, h, f, g, lo, size, count, at, local = (np.concatenate(x) for x in zip(*rows, strict=True))
            i = pa.array(i)
            return pa.RecordBatch.from_arrays([pa.array(h, mask=local), pa.array(f), pa.array(g), batch.column(0).take(i), batch.column(1).take(i), pa.array(lo, pa.int32()), pa.array(size, pa.int32()), pa.array(count, pa.int32()), pa.array(at, pa.int32())], names=["h", "f", "g", "k", "t", "lo", "size", "c", "at"])

        for batch in batches:
            out: list[list[np.ndarray]] = []
            held = 0
            for i, raw in enumerate(batch.column(2)):
                raw = raw.as_py()
                for begin in range(0, len(raw) - length + 1, PIECE):
                    piece = raw[begin : begin + PIECE + length - 1]
                    h, place, lo, hi = anchors(piece, length, k)
                    size = hi - lo + length
                    digests = b"".join([xxh3_128_digest(piece[a:b], s) for a, b, s in zip(lo.tolist(), (lo + size).tolist(), (place - lo).tolist(), strict=True)])
                    f, g = np.frombuffer(digests, np.int64).reshape(-1, 2).T
                    order = np.lexsort((lo, g, f, h))
                    first = np.append(True, (np.diff(h[order]) != 0) | (np.diff(f[order]) != 0) | (np.diff(g[order]) != 0))
                    starts = np.flatnonzero(first)
                    count = np.diff(np.append(starts, len(order)))
                    one = order[starts]
                    out.append([np.full(len(one), i), h[one], f[one], g[one], lo[one] + begin, size[one], count, (place - lo)[one], np.zeros(len(one), bool)])
                    if len(one) < len(order):
                        rest = np.setdiff1d(order, one)
                        s, e = merge(lo[rest], lo[rest] + size[rest])
                        zero = np.zeros(len(s), np.int64)
                        out.append([np.full(len(s), i), zero, zero, zero, s + begin, e - s, zero, zero, np.ones(len(s), bool)])
                    held += len(piece)
                    if held > 4 * PIECE:
                        yield table(batch, out)
                        out, held = [], 0
            if out:
                yield table(batch, out)

    return docs.select("k", "t", "b").mapInArrow(run, f"h long, f long, g long, k {kind}, t long, lo int, size int, c int, at int")


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])[: len(start)]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:] - 1, len(end) - 1)] if len(at) else end[:0]


def _matching(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs' rows (k, t, b) whose (k, t) may be among keys: by a bitmap of bounded size, so that the
    texts of other documents need not be shuffled. False hits are left to the join that follows."""
    n = keys.count()
    bits = min(MOST_BITS, 1 << max(12, (16 * n).bit_length()))
    spot = F.pmod(F.xxhash64("k", "t", F.lit(3)), F.lit(bits))
    words = np.zeros(bits // 64, np.uint64)
    found = keys.select(spot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("m")).toArrow()
    words[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(3).to_numpy()
            hit = (shared.value[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["k", "t", "b"])

    return docs.select("k", "t", "b", spot.alias("s")).mapInArrow(run, docs.select("k", "t", "b").schema)


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["k"].eqNullSafe(b["k"]) & (a["t"] == b["t"])


def _reaches(fragments: DataFrame) -> DataFrame:
    """(h, f, g, left, right): how many bytes before its anchor, and from it on, a fragment (h, f, g, part, at) can share with
    any other one of its anchor at most. Fragments are sorted by either side, in ranges that split equal ones as
    well; the longest common prefix is with a neighbour. At the ends of a range it isn't known, and unbounded."""
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unknown = 1 << 30

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, f, g, part, at = (batch.column(i) for i in range(5))
            pairs = [(p[:a][::-1], p[a:]) for p, a in zip(part.to_pylist(), at.to_pylist(), strict=True)]
            for side in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(h), pa.int8()), h, f, g, pa.array([x[side] for x in pairs], pa.binary())], names=["side", "h", "f", "g", "b"])

    def shared(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        if a[:n] == b[:n]:
            return n
        differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (differ.bit_length() + 7) // 8

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, far = None, unknown  # the last row seen, and what it shares with the one before it

        def row(group: tuple, f: tuple, reach: int) -> tuple:
            return (*group, *f, reach)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["side", "h", "f", "g", "reach"])

        for batch in batches:
            rows = []
            for side, h, f, g, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                near = 0
                if before:
                    if before[0] == (side, h):
                        near = shared(before[2], b)
                    rows.append(row(before[0], before[1], max(far, near)))
                    far = near
                before = ((side, h), (f, g), b)
            yield table(rows)
        if before:
            yield table([row(before[0], before[1], unknown)])

    order = ["side", "h", "b", "f", "g"]
    keys = fragments.select("h", "f", "g", "part", "at").dropDuplicates(["h", "f", "g"]).mapInArrow(sides, "side tinyint, h long, f long, g long, b binary")
    found = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(neighbours, "side tinyint, h long, f long, g long, reach int")
    return found.groupBy("h", "f", "g").agg(F.max(F.when(F.col("side") == 0, F.col("reach"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("reach"))).alias("right"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(k, t, s, e): spans of repeated bytes, by document; they may overlap. docs: k, t (hash of the text), b (its bytes)."""
    rows = written(_anchor_rows(docs, length, k), "anchors")
    local = rows.where("h IS NULL").select("k", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("size")).alias("e"))
    fragments = rows.where("h IS NOT NULL")
    often = fragments.groupBy("h").agg(F.sum("c").alias("n")).where("n > 1").select("h")
    found = written(fragments.join(often, "h"), "candidates")
    kinds = written(found.groupBy("h", "f", "g").agg(F.sum("c").alias("c"), F.min(F.struct("k", "t", "lo", "size", "at")).alias("r")), "fragments")
    whole = kinds.where("c > 1").select("h", "f", "g")
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("nf")).where("nf > 1")
    asked = kinds.join(several, "h").select("h", "f", "g", (F.col("c") > 1).alias("known"), "nf", F.col("r.k").alias("k"), F.col("r.t").alias("t"), F.col("r.lo").alias("lo"), F.col("r.size").alias("size"), F.col("r.at").alias("at"))
    asked = written(asked.groupBy("k", "t").agg(F.collect_list(F.struct("h", "f", "g", "known", "nf", "lo", "size", "at")).alias("items")), "asked")
    texts = _matching(docs, asked.select("k", "t"))
    met = texts.join(asked, _same_document(texts, asked)).select(texts["b"], F.explode(asked["items"]).alias("x"))
    cut = written(met.select("x.h", "x.f", "x.g", "x.known", "x.nf", "x.at", F.expr("substring(b, x.lo + 1, x.size)").alias("part")), "fragment-bytes")
    crowded = F.col("nf") > SHARD
    shards = F.ceil(F.col("nf") / SHARD)
    spread = cut.where(crowded).join(_reaches(cut.where(crowded)), ["h", "f", "g"]).withColumn("shard", F.pmod(F.xxhash64("f"), shards).cast("int"))
    cut = cut.where(~crowded).withColumns({"left": F.lit(-1), "right": F.lit(-1), "shard": F.lit(0)}).unionByName(spread)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "f", "g", "a", "z", "w1", "w2", "open"]
        group: dict[tuple[int, int, int], tuple[bytes, bool, int, int, int]] = {}
        held, last = 0, None

        def flush() -> pa.RecordBatch:
            from xxhash import xxh3_128_intdigest

            keys, items = list(group), list(group.values())
            repeated, leader = repeated_windows([x[0] for x in items], length)
            out: list[tuple] = []
            at = 0
            for (h, f, g), (part, known, anchor, left, right) in zip(keys, items, strict=True):
                windows = len(part) - length + 1
                mine = np.zeros(windows + 2, np.int8)
                mine[1:-1] = repeated[at : at + windows]
                edge = np.diff(mine)
                if not known:
                    out += [(h, f, g, a, z - 1, None, None, False) for a, z in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                if left >= 0:  # other shards may hold equal windows: one of each kind here is told, if it can be
                    low, high = max(0, anchor - left), min(windows - 1, anchor + right - length)
                    for a in (low + np.flatnonzero(leader[at + low : at + max(low, high + 1)])).tolist():
                        w = xxh3_128_intdigest(part[a : a + length])
                        w1, w2 = (w >> 64) - (1 << 63), (w & (1 << 64) - 1) - (1 << 63)
                        out.append((h, f, g, a, a, w1, w2, not (known or mine[a + 1])))
                at += len(part) + 1
            group.clear()
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for h, f, g, known, part, anchor, left, right, shard in zip(*columns, strict=True):
                if (h, shard) != last and held > CHUNK:
                    yield flush()
                    held = 0
                last = (h, shard)
                if (h, f, g) not in group:
                    group[h, f, g] = (part, known, anchor, left, right)
                    held += len(part) + 1
        if group:
            yield flush()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.select("h", "f", "g", "known", "part", "at", "left", "right", "shard").repartition(parts, "h", "shard").sortWithinPartitions("h", "shard", "f", "g")
    sorted_ = written(dealt.mapInArrow(sort, "h long, f long, g long, a int, z int, w1 long, w2 long, open boolean"), "windows")
    across = sorted_.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    more = sorted_.where("open").join(across, ["w1", "w2"]).select("h", "f", "g", "a", "z")
    runs = sorted_.where("w1 IS NULL").select("h", "f", "g", "a", "z").union(more)
    partly = found.join(runs, ["h", "f", "g"]).select("k", "t", (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("z") + length).alias("e"))
    fully = found.join(whole, ["h", "f", "g"]).select("k", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("size")).alias("e"))
    return local.union(partly).union(fully)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", give: str = "digest") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, and kept_sha256 or, with give='bytes', kept) for each row.

    Every byte covered by a string of length bytes that also starts at another place, in any row
    or the same one, goes; all copies go, judged on the input. Whole fragments are taken as equal by
    hashes of 192 bits in all; everything else is compared byte by byte. Texts are taken as UTF-8 bytes, so
    what is kept need not be valid UTF-8. Long texts are read in pieces that overlap. Null texts are empty; texts shorter than length keep all.
    Rows that repeat are rows of their own (each is the other's copy), with null keys as well. An
    empty table gives an empty table. length must be over K.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k"), text_or_empty(text).cast("binary").alias("b")).withColumn("t", F.xxhash64("b"))
    spans = repeated_spans(base, length)
    runs = written(spans.groupBy("k", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    texts = _matching(base, runs.select("k", "t"))
    met = texts.join(runs, _same_document(texts, runs)).select(texts["k"], texts["t"], texts["b"], runs["spans"])
    out = "kept binary" if give == "bytes" else "kept_sha256 string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n, kept = [], [], []
            for raw, found in zip(batch.column(2), batch.column(3), strict=True):
                raw, pairs = raw.as_py(), found.values.flatten()
                s, e = merge(pairs[0].to_numpy().astype(np.int64), pairs[1].to_numpy().astype(np.int64))
                removed.append(int((e - s).sum())), n.append(len(s))
                left = b"".join(raw[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
                kept.append(left if give == "bytes" else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary() if give == "bytes" else pa.string())], names=["k", "t", "n_removed", "n_spans", out.split()[0]])

    changed = met.mapInArrow(cut, f"k {kind}, t long, n_removed long, n_spans long, {out}").dropDuplicates(["k", "t"])
    name = out.split()[0]
    same = F.col("b") if give == "bytes" else F.sha2("b", 256)
    rows = base.select("k", "t", F.octet_length("b").cast("long").alias("n_bytes"), same.alias("_same"))
    joined = rows.join(changed, _same_document(rows, changed), "left")
    zero = F.lit(0).cast("long")
    return joined.select(rows["k"].alias(key), rows["n_bytes"], F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce(name, "_same").alias(name))
