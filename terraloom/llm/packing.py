"""Best-fit packing of tokenised documents into sequences, bettered by swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, text_or_empty, written
from .tokens import encoder

#: Pieces that are packed together, on average. Groups are by hash; a group wastes about half a sequence.
GROUP = 8192


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and end_id, cut into capacity where longer.

    All pieces of a longer document but the first are full, so at most one needs company.
    """
    kind = docs.schema[key].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, n, start, length, crc, row = batch.column(0), [], [], [], [], []
            for i, ids in enumerate(enc.batch(x.as_py() for x in batch.column(1))):
                ids += end
                total = len(ids) // 4
                at, size, k = 0, (total % capacity or capacity) if total > capacity else total, 0
                while at < total:
                    row.append(i), n.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text_or_empty(text).alias("t")).mapInArrow(cut, f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices. Items longest first, each to the fullest bin that holds it."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free_set = 0  # bit f: some bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = free_set >> size
        if above:
            free = size + ((above & -above).bit_length() - 1)
            b = open_at[free].pop()
            if not open_at[free]:
                free_set &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        left = free - size
        if left:
            open_at[left].append(b)
            free_set |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins while the sum of squared fill grows; bins that empty go.

    From the fullest underfull bin on: move a document in from a bin after it, or exchange one of
    its documents, or two, for a longer one that fits; of all such steps the one that fills it most,
    until it is full or none is left. Rounds over the bins go on until one changes nothing, or the
    documents need all bins that are left. Every step makes the squared fill grow, so it ends.
    """
    size = lengths.tolist()
    done, work = [], []
    for b in bins:
        (done if sum(size[i] for i in b) == capacity else work).append(list(b))
    changed = True
    while changed and sum(size[i] for b in work for i in b) <= (len(work) - 1) * capacity:
        changed = False
        work.sort(key=lambda b: -sum(size[i] for i in b))
        fill = [sum(size[i] for i in b) for b in work]
        where: dict[int, dict[int, int]] = {}  # length -> item -> bin, of the bins to come
        mask = 0  # bit n: where[n] has items

        def put(b: int, i: int, where=where) -> None:
            nonlocal mask
            where.setdefault(size[i], {})[i] = b
            mask |= 1 << size[i]

        def take(i: int, where=where) -> None:
            nonlocal mask
            del where[size[i]][i]
            if not where[size[i]]:
                mask &= ~(1 << size[i])

        for b, items in enumerate(work):
            for i in items:
                put(b, i)

        for b, mine in enumerate(work):
            for i in mine:
                take(i)
            while mine and fill[b] < capacity:
                gap = capacity - fill[b]
                best: tuple[int, int, int, tuple[int, ...]] | None = None  # gain, -documents out, document in, documents out
                for out in exchanges(mine, size):
                    low = sum(size[i] for i in out)
                    some = mask & ((1 << (low + gap + 1)) - 1)
                    while (length := some.bit_length() - 1) > low + (best[0] if best else 0):
                        gain = length - low
                        found = next((i for i, other in where[length].items() if fill[b] + gain > fill[other]), None)
                        if found is not None:
                            best = (gain, -len(out), found, out)
                            break
                        some &= ~(1 << length)
                    if best and best[0] == gap:
                        break
                if best is None:
                    break
                gain, _, found, out = best
                other = where[size[found]][found]
                take(found), work[other].remove(found), mine.append(found)
                for i in out:
                    mine.remove(i), work[other].append(i), put(other, i)
                fill[b], fill[other] = fill[b] + gain, fill[other] - gain
                changed = True
        done += [b for b, f in zip(work, fill, strict=True) if f == capacity]
        work = [b for b, f in zip(work, fill, strict=True) if 0 < f < capacity]
    return done + work


def exchanges(items: list[int], size: list[int]) -> Iterator[tuple[int, ...]]:
    """What a bin may give for one document: nothing, each one of its documents, each two; of equally long ones, one."""
    yield ()
    by: dict[int, list[int]] = {}
    for i in items:
        by.setdefault(size[i], []).append(i)
    lengths = sorted(by)
    for n in lengths:
        yield (by[n][0],)
    seen = set(lengths)
    for at, n in enumerate(lengths):
        for m in lengths[at:]:
            if n + m not in seen and (n != m or len(by[n]) > 1):
                seen.add(n + m)
                yield (by[n][0], by[m][0 if n != m else 1])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece's place.

    Documents are cut first (pieces()); the table of pieces is written, then dealt by hash into
    groups of about GROUP pieces, which are packed apart: best fit, then local search. So memory
    is bounded whatever the input, and no source or length can make a group large. Within a group
    the result depends only on the pieces.

    Null and empty texts are one piece that holds the end id alone. Rows with the same key are
    packed each for itself. Null keys pass through. Columns other than key and text are not read.
    """
    cut = written(pieces(docs, tokenizer, capacity, end_id, text, key), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    spread = F.pmod(F.xxhash64(key, "piece", "ids_crc32", "length"), F.lit(groups)).alias("_g")
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        group = int(rows["_g"].iloc[0])
        rows = rows.sort_values(["length", key, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        partial = np.flatnonzero(lengths < capacity)
        bins = local_search(best_fit(lengths[partial], capacity), lengths[partial], capacity)
        at, offset = np.arange(len(rows), dtype=np.int64), np.zeros(len(rows), np.int64)
        for b, items in enumerate(bins):
            items = partial[np.array(items)]
            at[items] = len(rows) + b
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return rows.drop(columns="_g").assign(sequence_id=(group << 32) + at, offset=offset)

    return cut.select("*", spread).groupBy("_g").applyInPandas(place, schema)
