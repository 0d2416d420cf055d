"""Toxicity: a noisy-channel decoder restores disguised words, then a linear model scores the text."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share, text_or_empty
from .language_id import held_out
from .linear import Ftrl, temperature

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "§": "s", "¡": "i",
}
#: Signs that may be put between the letters of a word.
GAPS = " .-_*~/\\'"
#: Symbols of the character model: 0 is any gap, 1 to 26 letters, 27 any other letter.
SYMBOLS = 28
#: Logarithms of the channel: a sign for a letter, an added gap, an added repeat, a gap that is real, a sign after the last letter that is real.
SIGN, GAP, REPEAT, REAL, LITERAL = -1.0, -0.3, -0.7, -2.0, -4.0
#: Labelled texts used of each class.
PER_CLASS = {1: 2500, 0: 5000}

_SIGNS = re.escape("".join(LEET))
_GAP = f"[{re.escape(GAPS)}\\s]"
#: A letter, or a sign for one.
_UNIT = rf"(?:[^\W\d_]|[{_SIGNS}])"
#: l e t t e r s or signs for them apart
_SPACED = re.compile(rf"(?<![^\W_]){_UNIT}(?:{_GAP}++{_UNIT}(?![^\W_])){{2,}}+")
_LETTER, _SIGN = re.compile(r"[^\W\d_]"), re.compile(f"[{_SIGNS}]")
#: Gaps between single letters, and repeats, in a word.
_DISGUISED = re.compile(rf"[^\W\d_]{_GAP}++[^\W\d_]{_GAP}++[^\W\d_]|([^\W\d_])\1\1", re.IGNORECASE)
_CORE = re.compile(rf"[\w{_SIGNS}](?:.*[\w{_SIGNS}])?", re.DOTALL)
_ENDS = "".join(LEET) + GAPS + string.whitespace
_WORD = re.compile(r"[^\W\d_]+")


def _disguised(span: str) -> bool:
    """Whether letters and signs for letters mix in span, or its letters are set apart or repeated."""
    return bool(_LETTER.search(span) and (_SIGN.search(span) or _DISGUISED.search(span)))


def _table() -> np.ndarray:
    t = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        low = chr(c).lower()
        t[c] = ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else 27 if chr(c).isalpha() else 0
    return t


_SYMBOL = _table()


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 0x250, _SYMBOL[np.minimum(c, 0x24F)], 27).astype(np.int32)


@lru_cache(maxsize=4096)
def symbol(letter: str) -> int:
    return int(symbols(letter)[1])


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each three symbols follow each other, over the whole texts of all rows."""
    size = SYMBOLS**3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column(0):
                s = symbols(t.as_py())
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["h", "n"])

    out = np.zeros(size)
    for r in docs.select(text_or_empty(text).alias("t")).mapInArrow(count, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).collect():
        out[r["h"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Restores spans by Viterbi search: the likeliest letters under a trigram model and the channel."""

    def __init__(self, counts: np.ndarray):
        one = counts.sum(axis=(0, 1)) + 1.0
        two = counts.sum(axis=0) + 0.0
        p1 = one / one.sum()
        p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
        p3 = (counts + 20 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 20)
        self.lm = np.log(p3).tolist()
        self.cache: dict[str, tuple[str, ...]] = {}

    def decode(self, span: str) -> str:
        """span restored; the same as span where nothing in it is likelier than what it says.

        The states are bounded by the symbols, and each has its text as a chain shared with others, so
        time and memory grow with the span's length."""
        lm = self.lm
        # a state is (symbol before last, last symbol, last letter as written); its value is (score, (text before, last piece))
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        lower = span.lower()
        end = next((i for i in range(len(lower) - 1, -1, -1) if lower[i].isalpha()), 0)
        for i, c in enumerate(lower):
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def reach(state: tuple[int, int, str], score: float, text: tuple | None, after=after) -> None:
                if state not in after or after[state][0] < score:
                    after[state] = (score, text)

            letters = [(c, symbol(c), 0.0)] if c.isalpha() else [(x, symbol(x), SIGN) for x in LEET.get(c, "")]
            for (a, b, last), (score, text) in states.items():
                for x, s, cost in letters:
                    reach((b, s, x), score + cost + lm[a][b][s], (text, x))
                    if x == last:
                        reach((a, b, last), score + cost + REPEAT, text)
                if c in GAPS or c.isspace():
                    if text:
                        reach((a, b, ""), score + GAP, text)
                    reach((b, 0, ""), score + REAL + lm[a][b][0], (text, " "))
                elif not letters or (i > end and not c.isalpha()):
                    reach((b, 0, ""), score + (LITERAL if letters else 0.0) + lm[a][b][0], (text, c))
            states = after
        text = max(((score + lm[a][b][0], k, text) for k, ((a, b, _), (score, text)) in enumerate(states.items())), default=(0.0, 0, None))[2]
        pieces = []
        while text:
            text, piece = text
            pieces.append(piece)
        return "".join(reversed(pieces))

    def readings(self, span: str) -> list[str]:
        """span restored, and what it is without signs at its ends if that is another reading ('idiot!' is no 'idioti')."""
        bare = span.strip(_ENDS)
        return [self.decode(span), *([self.decode(bare) if _disguised(bare) else bare] if len(bare) < len(span) else [])]

    def word(self, token: str) -> list[str]:
        """The readings of a word without white space; the word itself where nothing looks disguised."""
        core = _CORE.search(token)
        if core and _disguised(core[0]):
            return [token[: core.start()] + x + token[core.end() :] for x in self.readings(core[0])]
        return [token]

    def restore(self, text: str) -> str:
        """The whole text with its disguised words decoded."""
        return re.sub(r"\S+", lambda m: self.word(m[0])[0], _SPACED.sub(lambda m: self.decode(m[0]) if _LETTER.search(m[0]) else m[0], text))

    def joined(self, text: str) -> str:
        """Letters, and signs among them, set apart brought together, in all readings; white space stays where the model finds it likelier."""
        return _SPACED.sub(lambda m: " ".join(self.readings(m[0])) if _LETTER.search(m[0]) else m[0], text)

    def words(self, text: str) -> set[str]:
        """The different words of the restored text, in lower case."""
        out: set[str] = set()
        cache = self.cache
        if len(cache) > 400_000:
            cache.clear()
        for t in set(self.joined(text).split()):
            if (found := cache.get(t)) is None:
                found = cache[t] = tuple({w for x in self.word(t) for w in _WORD.findall(x.lower())})
            out.update(found)
        return out


def parts(token: str) -> list[str]:
    """A token's features: itself, and how it begins."""
    return [token, *(f"{token[:n]}^" for n in (4, 5) if len(token) > n)]


class ToxicityModel:
    def __init__(self, decoder: Decoder, weights: dict[str, float], bias: float, t: float):
        self.decoder, self.weights, self.bias, self.t = decoder, weights, bias, t
        self.known: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        known, total = self.known, self.bias
        if len(known) > 400_000:
            known.clear()
        for w in self.decoder.words(text or ""):
            if (x := known.get(w)) is None:
                x = known[w] = sum(self.weights.get(p, 0.0) for p in parts(w))
            total += x
        return float(1 / (1 + np.exp(-np.clip(total / self.t, -50, 50))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: dict[int, int] | None = None) -> ToxicityModel:
    """Learn from labelled rows that aren't held out: about per_class whole texts of each class, by a
    repeatable hash. The character model counts all rows of docs. Labels that are neither 0 nor 1 are
    passed over; a key with several labels is toxic if one says so."""
    per_class = per_class or PER_CLASS
    decoder = Decoder(character_counts(docs, text))
    said = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in said.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return ToxicityModel(decoder, {}, 30.0 if counts.get(1) else -30.0, 1.0)
    pick = reduce(lambda a, b: a | b, [(F.col("y") == y) & share(F.col("k"), per_class[y] / n) for y, n in counts.items()])
    chosen = F.broadcast(said.where(pick))  # about sum(per_class) rows of two numbers at most, whatever the input
    texts = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).join(chosen, "k")
    shared = docs.sparkSession.sparkContext.broadcast(decoder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(shared.value.words(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), batch.column(2)], names=["k", "w", "y"])

    rows = sorted(texts.select("k", "t", "y").mapInArrow(read, "k long, w string, y int").toArrow().to_pylist(), key=lambda r: (r["k"], r["w"]))
    often = Counter(p for r in rows for p in {p for w in r["w"].split() for p in parts(w)})
    index = {p: i for i, p in enumerate(sorted(p for p, n in often.items() if n >= 3))}
    del often
    examples, fold = [], []
    for i, r in enumerate(rows):
        n = Counter(index[p] for w in r["w"].split() for p in parts(w) if p in index)
        examples.append((np.array(list(n), np.int64), np.array(list(n.values()), float), r["y"]))
        fold.append(i % 6)
    fit = [e for e, f in zip(examples, fold, strict=True) if f]
    rest = [e for e, f in zip(examples, fold, strict=True) if not f]
    fewest = min(sum(r["y"] == y for r in rows) for y in (0, 1))
    model = Ftrl(len(index), 2, alpha=0.3, l1=min(6.0, max(0.5, 0.02 * fewest)), l2=0.05).fit(fit, epochs=4)
    w = model.weights()
    t = temperature(np.array([model.logits(h, v, w) for h, v, _ in rest]), np.array([y for _, _, y in rest], int)) if rest else 1.0
    d = w[:, 1] - w[:, 0]
    sampled = {y: sum(r["y"] == y for r in rows) for y in counts}
    prior = np.log(counts[1] / counts[0]) - np.log(max(sampled[1], 1) / max(sampled[0], 1))
    return ToxicityModel(decoder, {p: float(d[i]) for p, i in index.items() if d[i]}, float(d[-1]) + float(prior) * t, t)


def toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row, by the whole text alone.

    Null texts are scored as empty ones. Rows that repeat are rows of their own; null keys are not
    held out. An empty table gives an empty table.
    """
    return _scored(docs.select(key, held_out(F.col(key)).alias("held_out"), F.col(text).alias("t")), model, key)


def _scored(rows: DataFrame, model: ToxicityModel, key: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([shared.value.score(t.as_py()) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs' rows that score below 0.5, in docs' columns and order of columns: one pass, no join."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
