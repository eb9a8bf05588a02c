"""Exact, memoised encoding with public tokenizer files.

A text is cut into the same pre-tokens as the library cuts it, and each distinct pre-token is encoded
by the library once per worker. Merges never cross a pre-token, so the joined ids are the library's.
Texts with characters outside a safe class (white space beyond ASCII, letters beyond Latin, strings
of special tokens) go to the library whole."""

from __future__ import annotations

import functools
import gc
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters whose classes the Python re module and the tokenizers library see alike: ASCII but for
#: odd controls, and Latin letters but for superscripts, fractions and the dotted capital I.
_SAFE = re.compile("[\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
_LETTERS, _OTHER = r"[^\W\d_]+", r"(?:[^\w\s]|_)+"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: By kind of file: how a chunk between spaces is cut into pre-tokens.
_CUTS = {
    "word": re.compile(rf"{_ENDINGS}|{_LETTERS}|\d|{_OTHER}").findall,
    "byte": re.compile(rf"{_ENDINGS}| ?{_LETTERS}| ?\d+| ?{_OTHER}|\s+(?!\S)|\s+").findall,
}


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTES = _byte_letters()
_SPACE = chr(_BYTES[32])


class Memory:
    """A bounded map in two generations: when the young one is full it becomes the old one, whose entries
    return as they are asked for. What is common stays, what came once goes."""

    def __init__(self, limit: int, compute: Callable[[list], list]):
        self.limit, self.compute, self.young, self.old = limit, compute, {}, {}

    def __call__(self, keys: list) -> list:
        """The values of keys; those not remembered are computed at once, each once."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        absent = dict.fromkeys([k for k, v in zip(keys, found, strict=True) if v is None])
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
            absent = dict.fromkeys(keys)
        young, old = self.young, self.old
        new = []
        for k in absent:
            v = old.get(k)
            if v is None:
                new.append(k)
            else:
                young[k] = v
        young.update(zip(new, self.compute(new), strict=True))
        return list(map(young.__getitem__, keys))


class Encoder:
    """Encodes lists of texts to little-endian unsigned 32-bit ids.

    Arrow splits the texts into chunks at white space and makes a dictionary of them; only distinct chunks are
    cut and looked up, and the ids of all chunks are gathered at once. About `limit` pre-tokens are remembered."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.pieces = Memory(limit, self._encode)
        self.kind = "word" if self.lib.normalizer is not None else "byte"
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        """Whether the text splits at spaces. Runs of spaces are one pre-token for byte-level files, so they don't."""
        return _SAFE.fullmatch(text) is not None and not any(s in text for s in self.special) and (self.kind == "word" or "  " not in text)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Pre-tokens by the library's merges alone: they are normalised and cut already."""
        merge, out = self.model.tokenize, []
        for p in pieces:
            word = p[1:] if p[0] == " " else p
            if word.isalnum() and word.isascii():
                spelt = p if word is p else _SPACE + word
            else:
                spelt = p.encode().decode("latin-1").translate(_BYTES)
            out.append(array("I", [t.id for t in merge(spelt)]).tobytes())
        return out

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Chunks of letters are pre-tokens themselves; others are cut."""
        cut, lower = _CUTS[self.kind], self.kind == "word"
        flat, sizes = [], []
        for c in chunks:
            if (c[1:] if c[:1] == " " else c).isalpha():
                flat.append(c.lower() if lower else c)
                sizes.append(1)
            else:
                parts = cut(c.lower() if lower else c)
                flat += parts
                sizes.append(len(parts))
        ids = self.pieces(flat)
        out, at = [], 0
        for n in sizes:
            out.append(ids[at] if n == 1 else b"".join(ids[at : at + n]))
            at += n
        return out

    def _split(self, texts: list[str]) -> list[bytes]:
        strings = pa.array(texts, pa.large_string())
        lists = pc.utf8_split_whitespace(strings) if self.kind == "word" else pc.split_pattern(strings, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        distinct = coded.dictionary.to_pylist()
        if self.kind == "byte":
            # a chunk has its space before it, but for the first of each text
            firsts = offsets[:-1]
            opening = [distinct[k] for k in index[firsts].tolist()]
            index = index.copy()
            index[firsts] = np.arange(len(distinct), len(distinct) + len(opening))
            distinct = [" " + c for c in distinct] + opening
        found = self._ids_of(distinct)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        before = np.concatenate([[0], np.cumsum(each)])
        at = np.arange(before[-1]) + np.repeat(starts[index] - before[:-1], each)
        ids, ends = pool[at], before[offsets]
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list = [None] * len(texts)
        plain = []
        for k, text in enumerate(texts):
            if not text:
                out[k] = b""
            elif self._plain(text):
                plain.append(k)
            else:
                out[k] = self._whole(text)
        if plain:
            collecting = gc.isenabled()
            gc.disable()  # many short lists, no cycles
            try:
                for k, ids in zip(plain, self._split([texts[k] for k in plain]), strict=True):
                    out[k] = ids
            finally:
                if collecting:
                    gc.enable()
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, limit: int = 250_000) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, limit)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
