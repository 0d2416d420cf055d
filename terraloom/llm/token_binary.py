"""Token-id files in Simple-8b: words of 64 bits whose selector says how many ids they hold.

File: b"TLS8" | version u32 | documents u32 | blocks u32 | words u64
      | document lengths u32[documents] | word offset of each block u32[blocks] | words u64[words],
all little-endian. Blocks hold BLOCK ids (the last one fewer). A word's low 4 bits are its selector:
SELECTORS[s] ids of WIDTHS[s] bits follow from bit 4 upwards. Selector 15 is the escape: its id, of
any 64-bit value, is the whole next word. Blocks start at a word, so all are decoded side by side.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, text_or_empty, written
from .tokens import encoder

MAGIC, VERSION, BLOCK = b"TLS8", 1, 128
#: Blocks that are coded or decoded at once: working memory is a few MB, whatever a file's size.
AT_ONCE = 1024
#: Ids in a word and their bits, by selector.
SELECTORS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64])
ESCAPE = 15
#: Ids in one file, about; a file is held in memory when it is written and when it is read.
FILE_IDS = 2_000_000


def _bits(ids: np.ndarray) -> np.ndarray:
    """How many bits each id has: the exponent of a float, exact below 2^53, and counted above."""
    out = np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    for i in np.flatnonzero(ids >= np.uint64(1 << 53)).tolist():
        out[i] = int(ids[i]).bit_length()
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block). All blocks advance together, one word a step."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    width = np.full(blocks * BLOCK, 0, np.int8)
    width[: len(ids)] = _bits(ids)
    width = width.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = len(ids) - BLOCK * (blocks - 1)
    return _encode(np.concatenate([ids, np.zeros(blocks * BLOCK - len(ids), np.uint64)]).reshape(blocks, BLOCK), width, size)


def _encode(ids: np.ndarray, width: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blocks = len(ids)
    # the widest of the next n ids, for each selector's n (ids past the end are zeros)
    best = np.full((blocks, BLOCK), ESCAPE, np.int8)
    padded = np.concatenate([width, np.zeros((blocks, 60), np.int8)], axis=1)
    widest = {1: padded}
    n = 1
    while n < 32:
        wide = widest[n]
        widest[2 * n] = np.maximum(wide, np.concatenate([wide[:, n:], np.zeros((blocks, n), np.int8)], axis=1))
        n *= 2
    for s in range(13, -1, -1):
        n = int(SELECTORS[s])
        p = 1 << (n.bit_length() - 1)
        wide = widest[p]
        over = np.maximum(wide[:, :BLOCK], wide[:, n - p : n - p + BLOCK])
        np.copyto(best, np.int8(s), where=over <= WIDTHS[s])
    # all blocks advance together, a word a step; words are filled in afterwards, a selector at a time
    at, row, filled = np.zeros(blocks, np.int64), np.arange(blocks), np.zeros(blocks, np.int64)
    steps: list[tuple[np.ndarray, ...]] = []
    while len(row):
        here = at[row]
        s = best[row, here]
        steps.append((row, here, s, filled[row]))
        filled[row] += 1 + (s == ESCAPE)
        at[row] = here = here + SELECTORS[s]
        row = row[here < size[row]]
    first = np.cumsum(filled) - filled
    row, here, s, place = (np.concatenate(x) for x in zip(*steps, strict=True))
    place += first[row]
    flat = np.concatenate([ids, np.zeros((blocks, 60), np.uint64)], axis=1).ravel()
    here += row * (BLOCK + 60)
    words = np.empty(int(filled.sum()), np.uint64)
    for k in np.unique(s).tolist():
        mine = np.flatnonzero(s == k)
        if k == ESCAPE:
            words[place[mine]], words[place[mine] + 1] = np.uint64(ESCAPE), flat[here[mine]]
            continue
        word, w = np.full(len(mine), k, np.uint64), int(WIDTHS[k])
        for n in range(int(SELECTORS[k])):
            word |= flat[here[mine] + n] << np.uint64(4 + n * w)
        words[place[mine]] = word
    return words, first.astype(np.uint32)


def decode(words: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """The ids. All words of one selector are unpacked at once; escaped values are found by the blocks' chains."""
    if not total:
        return np.zeros(0, np.uint64)
    words = np.asarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int8)
    data = np.zeros(len(words), bool)  # words that are escaped values
    if (selector == ESCAPE).any():
        at = first.astype(np.int64)
        ends = np.append(at[1:], len(words))
        while len(at):
            esc = selector[at] == ESCAPE
            data[at[esc] + 1] = True
            at = at + 1 + esc
            live = at < ends
            at, ends = at[live], ends[live]
    heads = np.flatnonzero(~data)
    s = selector[heads]
    count = SELECTORS[s]
    # ids of a block end at BLOCK: its last word may be padded
    block = np.searchsorted(first, heads, side="right") - 1
    start = np.cumsum(count) - count
    origin = start[np.searchsorted(heads, first)]
    place = start - origin[block]
    size = np.full(len(first), BLOCK)
    size[-1] = total - BLOCK * (len(first) - 1)
    out = np.zeros(total, np.uint64)
    for k in np.unique(s).tolist():
        mine = np.flatnonzero(s == k)
        n, w = int(SELECTORS[k]), int(WIDTHS[k])
        word = words[heads[mine]]
        if k == ESCAPE:
            values = words[heads[mine] + 1][:, None]
        else:
            values = (word[:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(w) + np.uint64(4))) & np.uint64((1 << w) - 1)
        spot = place[mine][:, None] + np.arange(n)
        valid = spot < size[block[mine]][:, None]
        out[(BLOCK * block[mine][:, None] + spot)[valid]] = values[valid]
    return out


class FileBuilder:
    """A token file in the making: ids are coded as they come, some blocks at a time."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.held, self.pending, self.waiting, self.words = 0, [], 0, 0
        self.parts: list[bytes] = []
        self.firsts: list[np.ndarray] = []

    def add(self, ids: bytes) -> None:
        """One document's ids, as little-endian uint32."""
        self.lengths.append(len(ids) // 4)
        self.held += len(ids) // 4
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= AT_ONCE * BLOCK:
            self._code(AT_ONCE * BLOCK)

    def _code(self, step: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            words, first = encode(ids[at : at + step])
            self.firsts.append((first + self.words).astype("<u4"))
            self.parts.append(words.astype("<u8").tobytes())
            self.words += len(words)
        self.pending, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def to_bytes(self) -> bytes:
        if self.waiting:
            self._code(AT_ONCE * BLOCK)
        if self.waiting:
            self._code(self.waiting)
        first = np.concatenate([np.zeros(0, "<u4"), *self.firsts]).astype("<u4")
        head = MAGIC + np.array([VERSION, len(self.lengths), len(first)], "<u4").tobytes() + np.array([self.words], "<u8").tobytes()
        return b"".join([head, np.array(self.lengths, "<u4").tobytes(), first.tobytes(), *self.parts])


def from_file(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids): ids are uint32 where all fit, else uint64."""
    if bytes(blob[:4]) != MAGIC:
        raise ValueError("not a token file")
    version, documents, blocks = np.frombuffer(blob, "<u4", 3, 4)
    if version != VERSION:
        raise ValueError(f"version {version}")
    (words,) = np.frombuffer(blob, "<u8", 1, 16)
    lengths = np.frombuffer(blob, "<u4", int(documents), 24)
    first = np.frombuffer(blob, "<u4", int(blocks), 24 + 4 * int(documents)).astype(np.int64)
    body = np.frombuffer(blob[24 + 4 * (int(documents) + int(blocks)) :], "<u8", int(words))
    total = int(lengths.sum(dtype=np.int64))
    out = np.zeros(total, np.uint32)
    ends = np.append(first, len(body))
    for at in range(0, len(first), AT_ONCE):
        upto = min(at + AT_ONCE, len(first))
        part = decode(body[ends[at] : ends[upto]], first[at:upto] - first[at], min(total, upto * BLOCK) - at * BLOCK)
        if out.dtype == np.uint32 and len(part) and part.max() > 0xFFFFFFFF:
            out = out.astype(np.uint64)
        out[at * BLOCK : at * BLOCK + len(part)] = part
    return lengths, out


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def settle(store, own: str, name: str) -> None:
    """Rename own to name; where that is there already, by another attempt at the same task, own goes. Not all stores rename over a file."""
    there = lambda: bool(store.get_file_info(name).type)
    if not there():
        try:
            return store.move(own, name)
        except OSError:
            if not there():
                raise
    store.delete_file(own)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", key: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Write docs' ids under path, a new folder all executors share, in ascending key order (nulls first).

    Returns (part, file, row, key): what each file holds. Texts are dealt by ranges of key; each
    task writes its range as one or more files named by range and number, each under another name
    first and then renamed, so a file is there whole or not at all; a task that runs again writes
    the same bytes and leaves the files that are there.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).repartitionByRange(parts, "k").sortWithinPartitions("k", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, end = TaskContext.get(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, number = task.partitionId(), 0
        store, root = _filesystem(path)
        store.create_dir(root, recursive=True)
        keys, file = [], FileBuilder()

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, file
            name = f"{root}/part-{part:06d}-{number:05d}.tls8"
            own = f"{root}/_{part:06d}-{number:05d}-{task.taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(file.to_bytes())
            settle(store, own, name)
            n = len(file.lengths)
            out = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.concat_arrays(keys).slice(0, n)], names=["part", "file", "row", "k"])
            number, keys, file = number + 1, [], FileBuilder()
            return out

        for batch in batches:
            for i, ids in enumerate(enc.batch(x.as_py() for x in batch.column(1))):
                file.add(ids + end)
                keys.append(batch.column(0).slice(i, 1))
                if file.held >= file_ids:
                    yield flush()
        if file.lengths:
            yield flush()

    return ranged.mapInArrow(write, f"part int, file int, row int, k {kind}")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, file, row, start, n_tokens, ids_crc32, ids_before): each document of the files under path, decoded."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tls8").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                part, number = os.path.basename(name.as_py())[5:-5].split("-")
                lengths, ids = from_file(memoryview(blob.as_buffer()))
                raw, n = memoryview(ids.astype("<u4", copy=False).tobytes()), len(lengths)
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([int(part)] * n, pa.int32()), pa.array([int(number)] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "file", "row", "within", "n_tokens", "ids_crc32"])

    return blobs.mapInArrow(read, "part int, file int, row int, within long, n_tokens long, ids_crc32 long")


def binary_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from files written under path and read back.

    start counts the ids of all documents before this one in ascending key order (null keys first;
    rows with the same key go by text). Null texts count as empty: the end id alone. A file's ids
    are added up first, then the files' sums, one row each. An empty table writes no file.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    held = written(write_files(docs, path, tokenizer, end_id, text, key), "token-index")
    if held.isEmpty():
        return spark.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
    back = written(read_files(spark, path), "token-rows")
    sums = back.groupBy("part", "file").agg(F.sum("n_tokens").alias("s"))
    ahead = sums.withColumn("ahead", F.sum("s").over(Window.orderBy("part", "file")) - F.col("s")).drop("s")
    met = held.join(back, ["part", "file", "row"]).join(ahead, ["part", "file"])
    return met.select(F.col("k").alias(key), (F.col("within") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
