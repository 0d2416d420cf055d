"""Token ids of whole texts with the tokenizers library, word by word with a cache."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Places where every byte-level pre-tokenizer of this kind starts a new word: a space before a
#: non-space belongs to what follows it, other white space stands alone, letters end at punctuation.
_CHUNK = re.compile(f" ?[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+(?=[!-/:-@\\[-`{{-~{_WHITE}]|$)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes that byte-level vocabularies are written in: visible Latin-1
    characters for themselves, the other bytes, in order, from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class Encoder:
    """ids(text) as little-endian uint32 bytes, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    A byte-level BPE merges within pre-tokens only, and those never cross the chunks of _CHUNK, so
    the library encodes each distinct chunk once (in batches) and a text is the chunks' ids joined.
    The cache is emptied when it holds cache_size chunks. Tokenizers that are not byte-level with
    the usual pattern, or that normalise, get whole texts instead.
    """

    def __init__(self, path: str, cache_size: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        )

        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if self.by_chunk:
            # the same model without a cache of its own, which costs more than it saves on new words
            model = spec["model"]
            options = {k: model[k] for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)}
            self.model = BPE(vocab=model["vocab"], merges=[tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], cache_capacity=0, **options)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        """Chunks of letters are one pre-token each and go to the model at once; others are split by the library."""
        out, rest, model = {}, [], self.model
        for c in chunks:
            if (c[1:] if c[0] == " " else c).isalpha():
                out[c] = array("I", [t.id for t in model.tokenize(c.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
            else:
                rest.append(c)
        for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            out[c] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        cache = self.cache
        for t in texts:
            if not self.by_chunk or any(x in t for x in self.special):
                yield self.whole(t)
                continue
            chunks = _CHUNK.findall(t)
            try:
                yield b"".join(map(cache.__getitem__, chunks))
            except KeyError:
                if len(cache) > self.cache_size:
                    cache.clear()
                new = self._encode([c for c in dict.fromkeys(chunks) if c not in cache])
                if len(new) > self.cache_size:
                    new |= {c: cache[c] for c in chunks if c in cache}
                    yield b"".join(map(new.__getitem__, chunks))
                else:
                    cache.update(new)
                    yield b"".join(map(cache.__getitem__, chunks))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each path and process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
