"""The training-data operators against brute force, round trips and held-out rows, edge cases included."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from terraloom.llm import components as cc
from terraloom.llm import embedding_dedup, exact_dedup, language_id, license_scan, linear, mixing, packing, simhash_dedup, suffix_dedup, suffix_sort, token_binary, tokens, toxicity
from terraloom.llm.queries import byte_bpe

SCHEMA = "doc_id long, text string, lang string, source string, size long, kept boolean, h string"


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    common = [text(60) for _ in range(3)]
    out: list[tuple] = []
    for i in range(n):
        t = text(r.randint(0, 60))
        if r.random() < 0.5:
            t += " " + r.choice(common) + "\n" + text(r.randint(0, 40))
        if out and r.random() < 0.2:
            t = r.choice(out)[1] or ""
        if out and r.random() < 0.2:
            q = r.choice(out)[1] or ""
            k = r.randint(0, len(q))
            t = q[:k] + word() + q[k + 3 :]
        out.append((i, t))
    out += [(500, None), (501, ""), (502, " \t\n"), (503, "a" * 900), (504, "ab" * 300), (505, "one"), (505, "one"), (506, "One  two"), (507, "one\ttwo"), (508, "x\x00y" * 100), (None, out[3][1]), (509, "é" * 260), (510, "Ünï cödé 漢字 " * 40)]
    return [(d, t, "en", r.choice(["s0", "s1", "s2", None]), 7, None, "clash") for d, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def keyed(docs):
    return docs.where("doc_id IS NOT NULL")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def count(xs):
    return collections.Counter(map(tuple, xs))


# --- exact dedup


def test_exact_groups(docs):
    import re

    data = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    by = collections.defaultdict(list)
    for d, t in data:
        by[t].append(d)
    expected = []
    for d, t in data:
        ids = [x for x in by[t] if x is not None]
        keep = min(ids) if ids else None
        expected.append((d, keep, len(by[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert count(got) == count(expected)
    left = exact_dedup.exact_dedup(docs)
    assert left.columns == docs.columns and left.count() == sum(e[3] for e in expected)


def test_exact_groups_with_clashing_columns(spark):
    names = ["h", "doc_id", "s", "n", "k", "keep_id", "text", "group_size", "kept", "text_sha256", "c0", "v", "least", "c"]
    data = [tuple({"doc_id": i, "text": t, "kept": False}.get(n, f"{n}{i}") for n in names) for i, t in enumerate(["a  b", "a b", None, "", "c", "a\tb", "c" * 50_000])]
    df = spark.createDataFrame(data, ", ".join(f"{n} {'long' if n == 'doc_id' else 'boolean' if n == 'kept' else 'string'}" for n in names))
    found = exact_dedup.exact_groups(df)
    assert sorted(found.columns) == sorted(names) and [(r.doc_id, r.keep_id, r.group_size, r.kept, r.h, r.c0) for r in found.orderBy("doc_id").collect()] == [
        (i, k, n, i == k, f"h{i}", f"c0{i}") for i, (k, n) in enumerate([(0, 3), (0, 3), (2, 2), (2, 2), (4, 1), (0, 3), (6, 1)])
    ]
    left = exact_dedup.exact_dedup(df)
    assert left.columns == names and sorted(map(tuple, left.collect()), key=str) == sorted((data[i] for i in (0, 2, 4, 6)), key=str)


def test_exact_groups_hot_and_cold(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i // 6}") for i in range(400)], "doc_id long, text string")
    for parts in (1, 7, 1024):
        monkeypatch.setattr(exact_dedup, "HOT", parts)
        test_exact_groups(df)


def test_exact_groups_of_nothing(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


# --- mixing


def brute_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(docs):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    target = brute_targets(sizes)
    by_target = {round(v, 6) for v in target.values()}
    taken = collections.Counter()
    longest = max(r.size for r in got)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and round(r.target, 6) in by_target
        taken[round(r.target, 6)] += r.taken
    for s, t in target.items():
        assert abs(taken[round(t, 6)] - t) <= 2 * longest, s
    assert sum(r.taken for r in got) <= 1.5 * sum(sizes.values())
    assert count(got) == count(mixing.mix(docs).collect())


@pytest.mark.parametrize("long", [[1000], [100, 900], [10, 20, 970]])
def test_mix_takes_late_finish_times_into_account(spark, long):
    sizes = {"s00": [1] * 800, "s01": [1] * 400, "s02": long, "s03": [1] * 800, "s04": [1] * 200}
    docs = [(i, s, n) for i, (s, n) in enumerate((s, n) for s in sizes for n in sizes[s])]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in docs], "doc_id long, text string, source string")
    target, items, done = brute_targets({s: sum(x) for s, x in sizes.items()}), [], collections.Counter()
    digest = lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()
    for i, s, n in sorted(docs, key=lambda d: (digest(d[0]), d[0])):
        done[s] += n
        items += [((done[s] + sum(sizes[s]) * p) / target[s], s, digest(i), i, p, n) for p in (0, 1)]
    want, spent = collections.Counter(), 0
    for _, _, _, i, _, n in sorted(items):
        spent += n
        if spent > 4800:
            break
        want[i] += n
    got = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    assert sum(got.values()) <= 4800 and got == {i: want[i] for i, _, _ in docs}


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, None, "s"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0, 0]


def test_mixed_takes_documents_as_often(docs):
    """Repeated keys, null keys, null sources and columns with any names included."""
    odd = docs.withColumn("_times", F.lit("x")).withColumn("c", F.lit(1)).withColumn("k", F.lit("k"))
    plan = mixing.mix(odd).collect()
    by_row = {}
    for r in docs.collect():
        by_row.setdefault((r.doc_id, len((r.text or "").encode().split())), set()).add((r.text, r.source))
    clear = {(r.doc_id, r.size): r.taken // r.size for r in plan if r.size and len(by_row[r.doc_id, r.size]) == 1}
    got = mixing.mixed(odd)
    assert got.columns == odd.columns
    times = collections.Counter((r.doc_id, len((r.text or "").encode().split())) for r in got.collect())
    alike = collections.Counter((r.doc_id, r.size) for r in plan)
    for k, v in clear.items():
        assert times[k] == v * alike[k] or alike[k] > 1, k
    assert set(times) <= {(r.doc_id, r.size) for r in plan if r.taken}


def brute_queue(docs):
    """{row: taken} of (id, source, size) rows by one queue of all finish times."""
    sizes = collections.defaultdict(list)
    for _, s, n in docs:
        sizes[s].append(n)
    target, items, done = brute_targets({s: sum(x) for s, x in sizes.items()}), [], collections.Counter()
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    digest = lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()
    for i, s, n in sorted(docs, key=lambda d: (digest(d[0]), d[0])):
        done[s] += n
        if n:
            items += [((done[s] + sum(sizes[s]) * p) / target[s], order.index(s), digest(i), i, p, n) for p in (0, 1)]
    want, spent = collections.Counter(), 0
    for _, _, _, i, _, n in sorted(items):
        spent += n
        if spent > int(1.5 * sum(n for _, _, n in docs)):
            break
        want[i] += n
    return {i: want[i] for i, _, _ in docs}


@pytest.mark.parametrize("seed", range(6))
def test_mix_is_one_queue(spark, seed, monkeypatch):
    """Random corpora: few or many sources, sizes even or very uneven, one source with a large share."""
    monkeypatch.setattr(mixing, "RUN", random.Random(seed).choice([4, 64, 8192]))
    r = random.Random(seed)
    names = [f"s{i}" for i in range(r.choice([1, 2, 4, 9]))] + [None] * r.randint(0, 1)
    docs = [(i, r.choice(names) if r.random() < 0.7 else names[0], r.choice([0, 1, r.randint(1, 9), r.randint(1, 400) if r.random() < 0.05 else 2])) for i in range(r.randint(5, 300))]
    df = spark.createDataFrame([(i, "w " * n, s) for i, s, n in docs], "doc_id long, text string, source string")
    assert {x.doc_id: x.taken for x in mixing.mix(df).collect()} == brute_queue(docs)


# --- tokens, packing, token files


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    r = random.Random(1)
    parts = [" ", "  ", "\n", "a", "Bc", "é", "1", "!", "'s", "　", "\x85", "\x1f", "\t", "<|endoftext|>", "²", "中", "×", "ª", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for small in (tokens.Encoder(byte_bpe(), cache_size=5), tokens.Encoder(byte_bpe())):
        for x, got in zip(texts, small.batch(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def ids_of(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts]


def test_pack(docs):
    data = docs.collect()
    want = collections.Counter()
    for r, ids in zip(data, ids_of([r.text for r in data], 0), strict=True):
        n = len(ids)
        cuts = [0, n] if n <= 64 else [0, *range(n % 64 or 64, n + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack(docs, byte_bpe(), capacity=64).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in got) // 64) + 2


def test_pack_nothing(spark):
    assert packing.pack(empty(spark), byte_bpe()).count() == 0


def test_local_search_betters_best_fit():
    lengths = np.random.default_rng(0).integers(500, 1100, 600)
    bins = packing.best_fit(lengths, 2048)
    better = packing.local_search([list(b) for b in bins], lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(600)) and all(lengths[b].sum() <= 2048 for b in better)
    assert len(better) < len(bins)


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 127, 128, 129, 3000):
        for high in (0, 1, 2, 100, 50256, 2**31, 2**60, 2**64 - 1):
            x = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
            assert np.array_equal(token_binary.decode(*token_binary.encode(x), n), x)


def test_token_files(keyed):
    data = sorted(keyed.collect(), key=lambda r: (r.doc_id, r.text or ""))
    at, want = 0, []
    for r, ids in zip(data, ids_of([r.text for r in data], 2), strict=True):
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_binary.binary_round_trip(keyed, byte_bpe()).collect()
    assert count(got) == count(want)


def test_token_files_with_null_keys_and_rows_again(spark):
    data = [(None, "b"), (None, "a"), (None, None), (3, "x y"), (3, "a " * 70_000), (3, "x y"), (1, "")]
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in data], "doc_id long, text string, part int, file string")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (d, _), ids in zip(order, ids_of([t for _, t in order], 2), strict=True):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert count(token_binary.binary_round_trip(df, byte_bpe()).collect()) == count(want)


def test_a_task_that_runs_again_leaves_whole_files(tmp_path):
    from pyarrow import fs

    store = fs.LocalFileSystem()
    for attempt in (1, 2):
        (tmp_path / f"_own{attempt}").write_bytes(b"same")
        token_binary.settle(store, f"{tmp_path}/_own{attempt}", f"{tmp_path}/part")
    assert [p.name for p in tmp_path.iterdir()] == ["part"]


def test_token_files_of_nothing(spark):
    assert token_binary.binary_round_trip(empty(spark), byte_bpe()).count() == 0


# --- near-dedup


def brute_components(n, linked):
    labels = np.arange(n)
    a, b = map(np.array, zip(*linked, strict=True)) if linked else (np.zeros(0, int), np.zeros(0, int))
    cc.union(labels, a, b)
    return labels


def test_simhash(keyed, monkeypatch):
    from xxhash import xxh64_intdigest

    data = sorted(keyed.collect(), key=lambda r: r.doc_id)
    fps = []
    for r in data:
        w = (r.text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxh64_intdigest(x, 42) for x in s]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    labels = brute_components(len(fps), pairs)
    want = count((r.doc_id, f"{f:016x}", data[k].doc_id) for r, f, k in zip(data, fps, labels, strict=True))
    assert count(simhash_dedup.simhash_components(keyed).collect()) == want
    for leaf, block, within in ((4, 2048, 256), (4, 3, 2), (50, 2048, 3)):
        monkeypatch.setattr(simhash_dedup, "LEAF", leaf)
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        monkeypatch.setattr(simhash_dedup, "WITHIN", within)
        assert count(simhash_dedup.simhash_components(keyed).collect()) == want


def test_vantage_point_trees_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**32, 3000, dtype=np.uint64).astype(np.uint32)
    x = np.concatenate([base, base[:500] ^ (np.uint32(1) << rng.integers(0, 32, 500).astype(np.uint32))])
    nodes = simhash_dedup.build_tree(np.sort(x[::3]), 40, 1, rng)
    row, leaf, home = simhash_dedup.route(nodes, x, 1)
    assert home.sum() == len(x)
    own = dict(zip(row[home], leaf[home], strict=True))
    there = set(zip(row.tolist(), leaf.tolist(), strict=True))
    for i in range(500):
        assert (i, own[3000 + i]) in there and (3000 + i, own[i]) in there


def test_search_within_a_shard_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    near = base[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fp = np.concatenate([base, near])
    pairs = set()
    for which, half in enumerate(simhash_dedup.halves(fp)):
        labels = simhash_dedup.search(half, fp, np.arange(len(fp)), 1, 3)
        pairs |= {(which, i) for i in range(1500) if labels[i] == labels[4000 + i]}
        close = [i for i in range(1500) if int(half[i] ^ half[4000 + i]).bit_count() <= 1]
        assert {(which, i) for i in close} <= pairs
    assert {i for _, i in pairs} == set(range(1500))


def test_simhash_of_nothing(spark):
    assert simhash_dedup.simhash_components(empty(spark)).count() == 0


def vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(140):
        v = rng.normal(size=8)
        out.append((k, v.tolist(), int(rng.integers(2))))
        for c in range(int(rng.integers(0, 4))):
            out.append((1000 + 10 * k + c, (v * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.08).tolist(), out[-1][2]))
    out += [(9000 + i, out[0][1], out[0][2]) for i in range(30)]
    hot = rng.normal(size=8)
    out += [(9500 + i, (hot + rng.normal(size=8) * 0.01).tolist(), 1) for i in range(60)]
    out += [(9900, None, 1), (9901, [0.0] * 8, 1), (9902, [float("nan")] * 8, 1), (9903, out[0][1], None), (9904, [None] * 8, 1), (9905, [1.0, 2.0], 1), (9906, [2.0, 4.0], 1), (9907, [], 1), (9907, [], 1), (9908, [-0.0] + [1.0] * 7, 0), (9909, [0.0] + [1.0] * 7, 0), (9910, out[1][1], out[1][2]), (9910, out[1][1], out[1][2]), (9911, out[3][1], out[3][2]), (9911, out[40][1], out[40][2])]
    return out, spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")


def brute_links(data):
    ok = [i for i, (_, v, lab) in enumerate(data) if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, pairs = [0] * len(data), []
    for a, i in enumerate(ok):
        for j in ok[:a]:
            x, y = np.array(data[i][1]), np.array(data[j][1])
            if data[i][2] == data[j][2] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                pairs.append((i, j))
                n[i] += 1
                n[j] += 1
    labels = brute_components(len(data), pairs)
    low = {k: min(data[i][0] for i in np.flatnonzero(labels == k)) for k in set(labels.tolist())}
    return count((d[0], n[i], low[labels[i]], d[0] == low[labels[i]]) for i, d in enumerate(data))


def test_embedding_links(spark, monkeypatch):
    data, df = vectors(spark)
    want = brute_links(data)
    assert count(embedding_dedup.near_links(df).collect()) == want
    clash = df.withColumn("n_links", F.lit("clash")).withColumn("own", F.lit(1))
    for rate, block, most in ((3.0, 10, 16384), (0.5, 7, 16384), (3.0, 50, 1)):  # many cells and blocks; few cells; no pivots
        monkeypatch.setattr(embedding_dedup, "PIVOT_RATE", rate)
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        monkeypatch.setattr(embedding_dedup, "ALL_PIVOTS", most)
        assert count(embedding_dedup.near_links(clash).collect()) == want


def test_pivots_at_every_size():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.03])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (2, 5, 20):
        row, cell, own, far = embedding_dedup.cells(x, x[:n], 0.2)
        assert own.sum() == len(x) and len(set(cell[own].tolist())) == n
        assert np.allclose(far, np.linalg.norm(x[row] - x[cell], axis=1), atol=1e-6)
        home = dict(zip(row[own].tolist(), cell[own].tolist(), strict=True))
        there = set(zip(row.tolist(), cell.tolist(), strict=True))
        for i, j in zip(*np.nonzero(np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.2), strict=True):
            low = min(home[i], home[j])
            assert (i, low) in there and (j, low) in there


def test_embedding_links_of_nothing(spark):
    assert embedding_dedup.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- suffix arrays


def test_suffix_array_sorts():
    r = random.Random(3)
    for _ in range(200):
        s = bytes(r.choice(b"ab\0c") for _ in range(r.randint(0, 60)))
        assert suffix_sort.suffix_array(s, 100).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows():
    r = random.Random(4)
    for length in (8, 9, 16):
        for _ in range(60):
            parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))]
            c = collections.Counter(f[i : i + length] for f in parts for i in range(len(f) - length + 1))
            repeated, leader = suffix_sort.repeated_windows(parts, length)
            at = 0
            for f in parts:
                assert [bool(repeated[at + i]) for i in range(len(f) - length + 1)] == [c[f[i : i + length]] > 1 for i in range(len(f) - length + 1)]
                at += len(f) + 1
            assert leader.sum() == len(c)


def brute_removal(data, length=200):
    texts = [(d, (t or "").encode()) for d, t in data]
    c = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        m = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                m[i] += 1
                m[i + length] -= 1
        m = np.cumsum(m)[:-1] > 0
        left = bytes(x for x, gone in zip(b, m, strict=True) if not gone)
        out.append((d, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return count(out)


@pytest.mark.parametrize(("shard", "piece"), [(3, 1 << 20), (512, 1 << 20), (512, 37), (3, 250)])
def test_remove_repeats(docs, monkeypatch, shard, piece):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    want = brute_removal([(r.doc_id, r.text) for r in docs.collect()])
    assert count(suffix_dedup.remove_repeats(docs).collect()) == want


def test_remove_repeats_gives_bytes(docs):
    got = suffix_dedup.remove_repeats(docs, give="bytes").collect()
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_remove_repeats_of_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    long = rng.choice(list("abcdefgh "), 12_000_000)
    long[9_000_000:9_000_400] = long[100:500]
    whole = "".join(long)
    df = spark.createDataFrame([(1, whole), (2, whole[5_000_000:5_000_300] + "."), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: (12_000_000, 1100, 3), 2: (301, 300, 1), 3: (5, 0, 0)}


def test_remove_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# --- classifiers


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = language_id.train(docs)
    got = language_id.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the of and to in is that with for"), (4, "the of and to in is that with for"), (None, "x")], "doc_id long, text string")
    pred = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd, m).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= pred
    assert language_id.identify(empty(spark), m).count() == 0
    assert language_id.train(empty(spark)).predict("abc") == ("und", 0.0)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, m).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    assert np.mean(toxic) > 0.8 and np.mean([r.predicted for r in got if not r.toxic]) < 0.02
    for plain, disguised in (("idiot", "1d10t"), ("moron", "m o r o n"), ("stupid", "stuuupid"), ("trash", "tr@sh"), ("loser", "l.o.s.e.r")):
        assert plain in m.decoder.words(f"the {disguised} and"), disguised
    odd = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "a" * 100_000, 7)], "doc_id long, text string, score int")
    assert [0 <= r.score <= 1 for r in toxicity.toxicity(odd, m).collect()] == [True] * 4
    kept = toxicity.without_toxic(odd, m)
    assert kept.columns == odd.columns and kept.count() == 4
    assert toxicity.toxicity(empty(spark), m).count() == 0


def test_ftrl_is_the_scalar_rule():
    """Against the published per-coordinate rule in plain Python, over one pass in the same order."""
    rng = np.random.default_rng(3)
    examples = [(np.sort(rng.choice(12, 4, replace=False)), rng.normal(size=4), int(rng.integers(3))) for _ in range(60)]
    m = linear.Ftrl(12, 3, alpha=0.3, beta=1.0, l1=0.8, l2=0.1).fit(examples, epochs=1, seed=9)
    z, n = collections.Counter(), collections.Counter()
    weight = lambda k: 0.0 if abs(z[k]) <= 0.8 else -(z[k] - math.copysign(0.8, z[k])) / ((1.0 + math.sqrt(n[k])) / 0.3 + 0.1)
    for e in np.random.default_rng(9).permutation(60).tolist():
        x = [*zip(examples[e][0].tolist(), examples[e][1].tolist(), strict=True), (12, 1.0)]
        w = {(i, c): weight((i, c)) for i, _ in x for c in range(3)}
        score = [math.exp(sum(v * w[i, c] for i, v in x)) for c in range(3)]
        for i, v in x:
            for c in range(3):
                g = v * (score[c] / sum(score) - (c == examples[e][2]))
                z[i, c] += g - (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / 0.3 * w[i, c]
                n[i, c] += g * g
    assert np.allclose(m.weights(), [[weight((i, c)) for c in range(3)] for i in range(13)])
    assert 0 < np.mean(m.weights() == 0) < 1


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, 400)
    logits = 4 * (rng.normal(size=(400, 3)) + 1.2 * np.eye(3)[labels])
    loss = lambda t: -np.log(linear.softmax(logits / t)[np.arange(400), labels]).mean()
    assert loss(linear.temperature(logits, labels)) <= min(map(loss, np.geomspace(0.1, 10, 500))) + 1e-6


def test_language_scores_by_hand(spark):
    rows = [(i, t, lang, "x", "y") for i, (t, lang) in enumerate([("the old house of the lake", "en"), ("das alte haus an dem see", "de")] * 40)]
    rows += [(900, "the", None, "x", "y"), (901, None, "en", "x", "y"), (902, "le " * 60_000, "fr", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, score string")
    m = language_id.train(df)
    got = {r.doc_id: r for r in language_id.identify(df, m).collect()}
    for i, t, *_ in rows:
        if t is None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        c = collections.Counter(language_id.grams(t).tolist())
        z = [sum(n * float(m.weights[h, k]) for h, n in c.items()) / sum(c.values()) + m.bias[k] for k in range(len(m.languages))]
        p = [math.exp(x / m.t) for x in z]
        assert got[i].lang_pred == m.languages[int(np.argmax(p))] and abs(got[i].score - max(p) / sum(p)) < 1e-5
    assert language_id.LanguageModel(["a", "b"], np.zeros((language_id.SIZE, 2)), np.zeros(2), 1.0).predict("xyz") == ("a", 0.5)  # a tie: the first by name


def decoder():
    """A decoder whose character model has read a few words in all orders of two."""
    said = "you are a stupid worthless idiot and a moron or clown who said that the house by the lake is old".split()
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for a in said:
        for b in said:
            s = toxicity.symbols(f"{a} {b}")
            np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.Decoder(counts)


def brute_decode(d, span):
    """[(score, text)]: every reading of every sign of a span."""
    span = span.lower()
    end = next((i for i in range(len(span) - 1, -1, -1) if span[i].isalpha()), 0)
    found = []

    def go(i, a, b, last, score, text):
        if i == len(span):
            found.append((score + d.lm[a][b][0], text))
            return
        c = span[i]
        letters = [(c, 0.0)] if c.isalpha() else [(x, toxicity.SIGN) for x in toxicity.LEET.get(c, "")]
        for x, cost in letters:
            s = toxicity.symbol(x)
            go(i + 1, b, s, x, score + cost + d.lm[a][b][s], text + x)
            if x == last:
                go(i + 1, a, b, last, score + cost + toxicity.REPEAT, text)
        if c in toxicity.GAPS or c.isspace():
            if text:
                go(i + 1, a, b, "", score + toxicity.GAP, text)
            go(i + 1, b, 0, "", score + toxicity.REAL + d.lm[a][b][0], text + " ")
        elif not letters or (i > end and not c.isalpha()):
            go(i + 1, b, 0, "", score + (toxicity.LITERAL if letters else 0.0) + d.lm[a][b][0], text + c)

    go(0, 0, 0, "", 0.0, "")
    return found


def test_viterbi_finds_the_likeliest_reading():
    d, r = decoder(), random.Random(8)
    spans = ["1d10t", "i d i o t", "m0r0n!", "stuupid", "l1k3", "0ld-h0use", "|d|0t"] + ["".join(r.choice("aeiodt10|3 .-!") for _ in range(r.randint(1, 9))) for _ in range(150)]
    for span in spans:
        found = brute_decode(d, span)
        best = max(s for s, _ in found)
        assert max(s for s, t in found if t == d.decode(span)) > best - 1e-9, span


def test_toxicity_scores_by_hand(spark):
    m = toxicity.ToxicityModel(decoder(), {"idiot": 3.0, "idio^": 0.5, "idiot^": 7.0, "lake": -1.0, "stupid": 2.0, "stup^": 0.25}, -1.5, 2.0)
    sigmoid = lambda x: 1 / (1 + math.exp(-x / 2.0))
    cases = {"you idiot": -1.5 + 3.5, "the lake": -2.5, "": -1.5, None: -1.5, "IDIOT idiot": -1.5 + 3.5, "1d10t lake": -1.5 + 3.5 - 1, "the house": -1.5}
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(cases)], "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, m).collect()}
    for i, z in enumerate(cases.values()):
        assert abs(got[i].score - sigmoid(z)) < 1e-9 and got[i].predicted == (z >= 0) and got[i].held_out == held(i)
    left = toxicity.without_toxic(df, m)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [i for i, z in enumerate(cases.values()) if z < 0]


def test_toxicity_takes_any_text_in_linear_time():
    import time

    d = decoder()
    for x in ("a__", "a b__", "1_", "$$ ", "a. ", "_ a", "a\n\t", "aaa", "(", "é "):
        began = time.time()
        d.words(x * 10_000)
        assert time.time() - began < 5, x


def test_toxicity_decodes_spans_of_any_length():
    d = decoder()
    for words in ("you worthless idiot", "you are a stupid worthless idiot", "the old house by the lake and you are a stupid worthless idiot"):
        got = d.words(" ".join(words.replace(" ", "")))
        assert {"worthless", "idiot"} <= got, got
    assert "stupid" in d.words("stu" + "p" * 45 + "id")
    for gap in "/-":
        assert "idiot" in d.words(gap.join("the old house by the lake and the house 1d10t by the lake is old".split()))
    assert "idiot" in d.words("old " + " ".join("house" * 200) + " " + " ".join("idiot")) and len(d.decode("a1" * 20_000)) > 0


def test_toxicity_decodes_disguises_together_and_at_a_words_end():
    d = decoder()
    for x in (
        "i d 1 o t", "1 d 1 0 t", "i.d.1.o.t", "idi07", "idi0+", "1d107", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i   d   i   o   t", "i   d   1   o   7",
        "idiot!", "(idiot)", "idiot2024", "1d10t2024", "i d i o t 5", "idiot$$$", "IDI0T!!", "1diiiot",
    ):
        assert "idiot" in d.words(f"the {x} and"), (x, d.words(f"the {x} and"))
    for x, plain in (("house!", "house"), ("(lake)", "lake"), ("old", "old"), ("1 2 3 4 5", None), ("2024", None)):
        assert d.words(x) >= ({plain} if plain else set()), x
    assert not d.words("1 2 3 4 5 2024 $$$")
    assert "worthless" in d.words("w0r7h|3$$") and "stupid" in d.words("5 7 u p 1 d") | d.words("57up1d")


# --- licences


def brute_licence(path, text, least=license_scan.LEAST):
    """The best (licence, cosine) of a file, every unit against every template, without the filter by terms."""
    import re

    lines = re.split("\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]", text)
    bare = [re.sub(license_scan.COMMENT_END, "", re.sub(license_scan.COMMENT, "", x), count=1) for x in lines]
    blocks = [list(g) for full, g in itertools.groupby(bare, key=bool) if full]
    units = {"\n".join(b) for b in blocks} | {x for b in blocks for x in b} | {x for b in blocks for x in re.sub("([.!?;:]) +", "\\1\x01", " ".join(b)).split("\x01")}
    units.add(" ".join(itertools.takewhile(lambda x: x is not None, [b if re.match(license_scan.COMMENT, x) or not x.strip(" \t") else None for x, b in zip(lines, bare, strict=True)])))
    if re.search(license_scan.FILE_NAME, path):
        units.add(" ".join(bare))
    rows, idf, other = license_scan.vectors()
    found = []
    for u in units:
        c = {t: (1 + math.log(n)) * idf.get(t, other) for t, n in collections.Counter(re.findall(license_scan.TERM, u.lower())).items()}
        length = math.sqrt(sum(x * x for x in c.values()))
        dots = collections.Counter()
        for i, licence, t, w, norm in rows:
            if t in c:
                dots[i, licence] += c[t] * w / norm
        found += [(-round(d / length, 6), licence) for (_, licence), d in dots.items() if d / length >= least - 1e-6]
    found = [x for x in found if -x[0] >= least]
    return (min(found)[1], -min(found)[0]) if found else (None, None)


def test_license_statements(spark):
    t = dict(reversed(license_scan.TEMPLATES))
    wrap = lambda x, mark: "\n".join(mark + y for y in textwrap.wrap(x, 60))
    mit, gpl, apache = license_scan.TEMPLATES[4][1], license_scan.TEMPLATES[13][1], license_scan.TEMPLATES[10][1]
    cases = {
        "spdx.c": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), "gpl.py": ("#!/usr/bin/python\n# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0"),
        "wrapped.py": (wrap(gpl, "# ") + "\n\nimport os\n", "GPL-3.0"), "wrapped.c": ("/*\n" + wrap(apache, " * ") + "\n */\nint x;", "Apache-2.0"),
        "title": ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007", "GPL-3.0"), "mpl.txt": ("Mozilla Public License Version 2.0\n====", "MPL-2.0"),
        "a/LICENSE": ("MIT License\n\nCopyright (c) 2020 A. N. Other\n\n" + wrap(mit, ""), "MIT"), "bsd.md": ("## BSD 3-Clause License\n", "BSD-3-Clause"),
        "prose.txt": ("It was late. The code is here. Licensed under the Apache License, Version 2.0. And so on for ever and ever, as we said before; the end.", "Apache-2.0"),
        "cc.html": ("<!-- This work is licensed under the Creative Commons Attribution 4.0 International License. -->\n<p>x</p>", "CC-BY-4.0"),
        "none.txt": ("The license of the software is not known; the public domain is wide and the version is 2.0.\nVersion 2.0\nUnder the lake.", None),
        "empty": ("", None), "long.txt": ("word and the lake " * 40_000 + "\nReleased under the MIT License.\n" + "old house\n" * 20_000, "MIT"),
        "b/COPYING": (wrap(t["Unlicense"] + " Anyone is free to copy.", ""), "Unlicense"), "tie.txt": ("Released under the MIT License.\nLicensed under CC BY 4.0.", "CC-BY-4.0"),
    }
    df = spark.createDataFrame([(p, x) for p, (x, _) in cases.items()] + [("null", None)], "path string, text string")
    got = {r.path: (r.licence, r.cosine) for r in license_scan.statements(df).collect()}
    for p, (x, licence) in cases.items():
        want = brute_licence(p, x)
        assert want[0] == licence, (p, want)
        assert got.get(p, (None, None))[0] == licence and (licence is None or abs(got[p][1] - want[1]) < 2e-6), (p, got.get(p), want)


def test_license_scan(spark):
    mit = "Released under the MIT License."
    files = [
        ("a/LICENSE", mit), ("a/b/x.py", "code"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("d/z.py", "nothing"), ("d/w.py", mit),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (None, mit), ("e.txt", None), ("a/q", ""), ("a/q", ""), ("f/n.txt", "license " * 50),
    ]
    df = spark.createDataFrame([(p, t, "clash", f"d{i}", "c") for i, (p, t) in enumerate(files)], "path string, text string, licence string, dir string, c0 string")
    found = license_scan.scan(df)
    assert sorted(found.columns) == sorted(["path", "text", "licence", "dir", "c0", "cosine", "origin", "from_path"])
    rows = found.collect()
    got = collections.Counter((r.path, r.licence, r.origin, r.from_path) for r in rows)
    assert got[("a/b/x.py", "GPL-3.0", "inherited", "a/b/COPYING")] == 1
    assert got[("a/b/c/y.py", "Apache-2.0", "own", "a/b/c/y.py")] == 1
    assert got[("a/q", "MIT", "inherited", "a/LICENSE")] == 2
    assert got[("d/w.py", "MIT", "own", "d/w.py")] == 1
    assert got[("d/z.py", None, "none", None)] == got[("e.txt", None, "none", None)] == got[(None, None, "none", None)] == 1
    assert sorted((r.path or "", r.text or "", r.dir) for r in rows) == sorted((p or "", t or "", f"d{i}") for i, (p, t) in enumerate(files))
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, f in p.STAGES[:-1]:
        kept = f(spark, kept, sf)
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
    tables = {name: [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()] for name, _ in p.STAGES[:-1]}
    m = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    clean = {r.doc_id for r in docs.collect() if m.score(r.text) < 0.5}
    assert {d for d, _ in tables["toxicity"]} == clean
    norm = lambda t: b" ".join([b"" if (t or "")[:1].isspace() else None, *t.encode().split()][1:])
    by = {}
    for d, t in sorted(tables["toxicity"]):
        by.setdefault(norm(t), d)
    assert len(tables["exact dedup"]) >= len(by) and {d for d, _ in tables["exact dedup"]} >= set(by.values())
    data = sorted(tables["exact dedup"])
    fps = [simhash_dedup.fingerprint((t or "").encode()) for _, t in data]
    labels = brute_components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert {d for d, _ in tables["SimHash near-dedup"]} == {data[k][0] for k in labels}
    times = collections.Counter(d for d, _ in tables["source mixing"])
    assert set(times.values()) <= {1, 2} and set(times) <= {d for d, _ in tables["SimHash near-dedup"]}
    pieces = p.STAGES[-1][1](spark, kept, sf).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == times
