"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share
from .linear import Example, Ftrl, softmax, temperature

#: Hashed n-grams, their lengths, the factor on tf * idf, and labelled texts used for each language and in all at most, about.
SIZE, LENGTHS, SCALE, PER_LANGUAGE, IN_ALL = 1 << 15, (1, 2, 3), 30.0, 1200, 60_000


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


def grams(text: str) -> np.ndarray:
    """The hashed character n-grams of the whole lower-cased text, edges marked by a space."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in LENGTHS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
            out.append(h >> np.uint32(17))
    return np.concatenate(out)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each hashed n-gram), over all of docs: partial sums, at most SIZE + 1 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                flag = np.zeros(SIZE, bool)
                flag[grams(t.as_py())] = True
                total += flag
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, SIZE), pa.int32()), pa.array(np.append(total[some], n))], names=["h", "n"])

    df, documents = np.zeros(SIZE), 0
    for r in docs.select(text).mapInArrow(count, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).collect():
        if r["h"] == SIZE:
            documents = r["n"]
        else:
            df[r["h"]] = r["n"]
    return documents, df


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, t: float):
        self.languages, self.weights, self.bias, self.t = languages, weights.astype(np.float32), bias, t

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); `und` where the text is null or has no letter, or nothing was learnt."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        g = grams(text)
        z = np.zeros(len(self.languages))
        for at in range(0, len(g), 1 << 16):
            z += self.weights[g[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        p = softmax((z / len(g) + self.bias) / self.t)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from text and non-null lang of the rows that aren't held out.

    Document frequencies cover all those rows; the regression takes about per_language whole texts
    of each language, fewer where they would be over IN_ALL, by a repeatable hash, a fifth of which
    set the temperature.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    documents, df = document_frequencies(rows, "t")
    idf = np.log((1 + documents) / (1 + df)) + 1
    per_language = min(per_language, max(1, IN_ALL // len(languages)))
    pick = F.lit(False)
    for name, n in counts.items():
        pick = pick | ((F.col("l") == name) & share(F.col("k"), per_language / n))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, label, fold = [], [], [], []
            for k, t, name in zip(*(batch.column(i) for i in range(3)), strict=True):
                g = grams(t.as_py())
                h, n = np.unique(g, return_counts=True)
                index.append(h.astype(np.int32)), value.append((n / len(g)).astype(np.float32)), label.append(name.as_py()), fold.append(k.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(label, pa.string()), pa.array(fold, pa.int64())], names=["index", "value", "label", "fold"])

    fold = F.pmod(F.xxhash64("k", F.lit(77)), F.lit(5)).alias("fold")
    sample = rows.where(pick).select(fold, "t", "l").mapInArrow(features, "index array<int>, value array<float>, label string, fold long").toArrow()
    examples: list[tuple[Example, int]] = []
    number = {name: i for i, name in enumerate(languages)}
    for h, v, name, f in zip(*(sample.column(c) for c in ("index", "value", "label", "fold")), strict=True):
        h = h.values.to_numpy()
        examples.append(((h, v.values.to_numpy() * idf[h] * SCALE, number[name.as_py()]), f.as_py()))
    examples.sort(key=lambda e: (e[1], e[0][2], len(e[0][0]), float(e[0][1].sum())))
    fit, rest = [e for e, f in examples if f], [e for e, f in examples if not f]
    model = Ftrl(SIZE, len(languages), l1=0.02, l2=0.02).fit(fit or rest)
    w = model.weights()
    t = temperature(np.array([model.logits(h, v, w) for h, v, _ in rest]), np.array([y for _, _, y in rest], int))
    return LanguageModel(languages, w[:-1] * idf[:, None] * SCALE, w[-1], t)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by the whole text alone.

    Null texts and texts without a letter are `und` with score 0. Rows that repeat are rows of
    their own; null keys are not held out. An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return docs.select(key, held_out(F.col(key)).alias("held_out"), text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
