"""Exact encoding by pieces: texts are cut where the tokenizer provably cuts as well, and equal pieces are encoded once.

Both vocabularies cut a text by a pattern before they merge, and no match goes on past the end of a run of
non-space characters. So a text's ids are those of its pieces (`white space, then other characters`), one after the other.
A text with a character of UNSURE, on which engines differ about white space, is encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

#: Characters that some engines take as white space and others don't, or that aren't ASCII.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Characters from the first combining one on; below it, text is composed and lower-cases one character at a time.
HIGH = re.compile("[\u0300-\U0010ffff]")
#: ASCII punctuation without the apostrophe, which may begin a contraction, and without what special tokens have.
PUNCTUATION = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Words that are handed to the library as one text: more cost it more for each, and fewer, too.
JOINED_WORDS = 200
#: Pieces that a worker keeps; further ones are encoded for each slice anew.
CACHE_PIECES = 600_000


class PieceCache(dict):
    """piece -> value(ids). look_up() finds all that is missing in one call of the library, after one look at each piece."""

    def __init__(self, encode_many: Callable, value: Callable, most: int = CACHE_PIECES):
        super().__init__()
        self.encode_many, self.value, self.most, self.missed = encode_many, value, most, []

    def __missing__(self, piece):
        self.missed.append(piece)

    def look_up(self, cut: list[list[str]]) -> list[list]:
        """The values of each list's pieces."""
        self.missed = []
        rows = [list(map(self.__getitem__, c)) for c in cut]
        missed, self.missed = self.missed, []
        if missed:
            new = list(set(missed))
            found = dict(zip(new, map(self.value, self.encode_many(new)), strict=True))
            values = map(found.__getitem__, missed)  # in the order of the gaps
            for row in rows:
                at = -1
                for _ in range(row.count(None)):
                    at = row.index(None, at + 1)
                    row[at] = next(values)
            if len(self) + len(found) <= self.most:
                self.update(found)
        return rows


def bytes_to_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token: what merging by lower ranks alone leaves of it."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank) if ranks.get(parts[i] + parts[i + 1], rank) < rank else rank)
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteLevel:
    """Byte-level BPE of a ranks file on the tokenizers library."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)
        shown = bytes_to_characters()
        spell = lambda token: "".join(shown[b] for b in token)
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in self.ranks.items()}, merges=[(spell(a), spell(b)) for a, b in merges_of(self.ranks)]))
        # the library's ByteLevel pattern is public_tokenizers.PATTERN
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.tokenizer.encode_special_tokens = True
        self.cut = re.compile(r"\s*\S+|\s+").findall
        self.cache = PieceCache(self.encode_many, lambda ids: ids.astype("<u4").tobytes(), CACHE_PIECES // 3)  # pieces with capitals and white space repeat less

    def encode_many(self, pieces: list[str]) -> list[np.ndarray]:
        """Pieces that begin with white space are encoded as one text and cut apart by their lengths in bytes; merges never cross them."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if p[0] in " \n" and not p.isspace()]
        for first in range(0, len(joined), 2000):
            part = joined[first : first + 2000]
            ids = np.array(self.tokenizer.encode("".join(pieces[i] for i in part), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.cumsum([len(pieces[i].encode()) for i in part])
            stops = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
            for i, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype=np.int64)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [[] if UNSURE.search(x) else self.cut(x) for x in texts]
        return [b"".join(c) if c or not x else np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x, c in zip(texts, self.cache.look_up(cut), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


class WordEnd:
    """A .json vocabulary whose matches never hold white space; by_count keeps numbers of ids in place of ids."""

    def __init__(self, path: str, by_count: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        # For words of small letters below U+0300, which its normaliser and pattern leave as they are: only white space to cut at, and merges.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.by_count, self.cut = by_count, str.split
        self.cache = PieceCache(self.encode_many, lambda ids: ids)

    def values(self, encoded: list) -> list:
        return [len(e.ids) if self.by_count else array("I", e.ids).tobytes() for e in encoded]

    def encode_words(self, words: list[str]) -> dict:
        """Values of words of small letters, encoded as one text and cut apart where words end."""
        texts = [" ".join(words[first : first + JOINED_WORDS]) for first in range(0, len(words), JOINED_WORDS)]
        data = b"".join(array("I", e.ids).tobytes() for e in self.plain.encode_batch_fast(texts, add_special_tokens=False))
        stops = (np.flatnonzero(self.ends[np.frombuffer(data, "<u4")]) + 1) * (1 if self.by_count else 4)
        if self.by_count:
            return dict(zip(words, np.diff(stops, prepend=0).tolist(), strict=True))
        stops = stops.tolist()
        return dict(zip(words, (data[i:j] for i, j in zip([0, *stops][: len(stops)], stops, strict=True)), strict=True))

    def encode_many(self, pieces: list[str]) -> list:
        """Values of pieces. One of small letters with punctuation behind it is cut before that, as the pattern does: a run of such characters is a match."""
        bases = [p.rstrip(PUNCTUATION) for p in pieces]
        plain = [b.isalpha() and b.islower() and (b.isascii() or not HIGH.search(b)) for b in bases]
        words = list(set(compress(bases, plain)))
        known = dict(zip(words, map(self.cache.get, words), strict=True))
        known |= self.encode_words([b for b, x in known.items() if x is None])
        tails = {p[len(b) :] for p, b in compress(zip(pieces, bases, strict=True), plain)} - {""}
        after = dict(zip(tails, self.values(self.tokenizer.encode_batch_fast(list(tails), add_special_tokens=False)), strict=True)) | {"": 0 if self.by_count else b""}
        rest = [p for p, x in zip(pieces, plain, strict=True) if not x]
        others = iter(self.values(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)))
        return [(known[b] if p is b else known[b] + after[p[len(b) :]]) if x else next(others) for p, b, x in zip(pieces, bases, plain, strict=True)]

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def take_apart(self, texts: list[str]) -> list[list[str] | None]:
        """Pieces of each text, None for one that is encoded whole. The vocabulary lower-cases, and composes characters from U+0300 on; in a
        text without those, lower-casing before makes fewer pieces and changes nothing."""
        out = []
        for x in texts:
            if not x.isascii() and HIGH.search(x):
                out.append(None if UNSURE.search(x) else self.cut(x))
            else:
                out.append(None if UNSURE.search(x) else self.cut(x if "<|" in x else x.lower()))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = self.take_apart(texts)
        found = iter(self.cache.look_up([c for c in cut if c is not None]))
        return [np.array(self.encode_whole(x), dtype="<u4").tobytes() if c is None else b"".join(next(found)) for x, c in zip(texts, cut, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        cut = self.take_apart(texts)
        found = iter(self.cache.look_up([c for c in cut if c is not None]))
        return [len(self.encode_whole(x)) if c is None else sum(next(found)) for x, c in zip(texts, cut, strict=True)]


def default_path(name: str) -> str:
    return public_tokenizers.path(name)
