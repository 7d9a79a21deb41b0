"""Byte-level BPE encoding and decoding by a contiguous rank array.

A word is held as its parts' ids and the merge ranks of adjacent parts. While a rank is left, the smallest
(leftmost of equals) is found by a scan, the boundary is deleted and the two neighbouring ranks are looked
up again. Words are short, so scanning beats a heap; all new words of a batch with equal length are rows of
one matrix and take these steps together. Longer words than ``SHORT`` merge every place of the smallest
rank in one pass, which is the same order if no merge makes a pair of smaller rank than its own. That is looked up
when a file is read; with one that fails it, words of any length are worked off boundary by boundary.

The vocabulary comes from a tokenizer file (its path is a parameter) with byte-level pieces, merges and one
or more special tokens; the driver reads it and broadcasts it (tens of thousands of entries, a fixed size).

Cases: null and empty texts have no ids and decode to the empty text. Special tokens spelled out in a text
become their ids, as the library does by default. Every input row gives one row, repeated ones too.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import map_rows, read_table, texts

SHORT = 48
CACHE_WORDS = 400_000
NONE = np.int64(1) << 40

# Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte: itself where Latin-1 prints it, else the next code point from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, raw: str):
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        ids = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        self.byte_id = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        sides = [[bytes(alphabet[c] for c in side) for side in pair] for pair in pairs]
        self.base = max(ids.values()) + 1
        keys = np.array([ids[a] * self.base + ids[b] for a, b in sides], dtype=np.int64)
        order = np.argsort(keys)
        merged = [ids[a + b] for a, b in sides]
        last = np.full(self.base, -1, dtype=np.int64)
        np.maximum.at(last, merged, np.arange(len(sides)))
        #: Each side of a merge is made by merges of smaller ranks only.
        self.ordered = bool((np.maximum(last[keys // self.base], last[keys % self.base]) < np.arange(len(keys))).all())
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array(merged, dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: piece for piece, i in ids.items()} | {i: s.encode() for s, i in self.specials.items()}
        longest_first = sorted(self.specials, key=len, reverse=True)
        self.special_pattern = regex.compile(f"({'|'.join(map(regex.escape, longest_first))})") if longest_first else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def encode_equal(self, words: list[bytes]) -> list[bytes]:
        """Words of one length, each to its ids as little-endian unsigned 32-bit integers."""
        n, width = len(words), len(words[0])
        parts = np.full((n, width + 1), -1, dtype=np.int64)
        parts[:, :width] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(n, width)]
        ranks = np.full((n, width + 1), NONE, dtype=np.int64)
        if width > 1:
            ranks[:, :width - 1] = self.rank_of(parts[:, :width - 1], parts[:, 1:width])
        size = np.full(n, width)
        live = np.arange(n)
        columns = np.arange(width + 1)
        while len(live):
            at = ranks[live].argmin(axis=1)
            best = ranks[live, at]
            live, at, best = live[best < NONE], at[best < NONE], best[best < NONE]
            if not len(live):
                break
            # delete the boundary: what stands right of it moves one place to the left
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width)
            p, r = np.take_along_axis(parts[live], source, 1), np.take_along_axis(ranks[live], source, 1)
            row = np.arange(len(live))
            p[:, width], r[:, width] = -1, NONE
            p[row, at] = self.merged[best]
            r[row, at] = self.rank_of(p[row, at], p[row, at + 1])
            before = np.maximum(at - 1, 0)
            r[row, before] = np.where(at > 0, self.rank_of(p[row, before], p[row, at]), r[row, before])
            parts[live], ranks[live] = p, r
            size[live] -= 1
        flat = parts.astype("<u4")
        return [flat[i, :size[i]].tobytes() for i in range(n)]

    def encode_long(self, word: bytes) -> bytes:
        parts = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.rank_of(parts[:-1], parts[1:])
        while len(ranks) and (best := ranks.min()) < NONE:
            places = np.flatnonzero(ranks == best)
            if (np.diff(places) == 1).any():  # overlapping places: every other one of a run, from the left
                begin = np.r_[True, np.diff(places) != 1]
                run = np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            parts[places] = self.merged[best]
            keep = np.ones(len(parts), dtype=bool)
            keep[places + 1] = False
            moved = np.cumsum(keep) - 1
            parts, ranks = parts[keep], ranks[keep[1:]]
            new = moved[places]
            # a boundary left or right of a new part has a new rank
            for b in (new - 1, new):
                b = b[(b >= 0) & (b < len(parts) - 1)]
                ranks[b] = self.rank_of(parts[b], parts[b + 1])
        return parts.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def vocabulary(raw: str) -> Vocabulary:
    return Vocabulary(raw)


class Codec:
    """Encoder and decoder of one task, with a cache of ``cache_words`` words of up to ``SHORT`` bytes."""

    def __init__(self, vocab: Vocabulary, cache_words: int = CACHE_WORDS):
        self.vocab, self.limit = vocab, cache_words
        self.cache: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall

    def _learn(self, words: set[str]) -> list[str]:
        """Words to the cache; those that must not stay there."""
        long: list[str] = []
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            by_length.setdefault(len(raw), []).append((word, raw))
        for length, group in by_length.items():
            if length > SHORT:
                one = self.vocab.encode_long if self.vocab.ordered else lambda raw: self.vocab.encode_equal([raw])[0]
                self.cache.update((w, one(raw)) for w, raw in group)
                long += [w for w, _ in group]
            else:
                self.cache.update(zip([w for w, _ in group], self.vocab.encode_equal([raw for _, raw in group])))
        return long

    def encode_batch(self, bodies: list[str], group_chars: int = 2_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = 0
        while start < len(bodies):
            stop, chars = start, 0
            while stop < len(bodies) and (stop == start or chars + len(bodies[stop]) <= group_chars):
                chars += len(bodies[stop])
                stop += 1
            out += self._encode(bodies[start:stop])
            start = stop
        return out

    def _encode(self, bodies: list[str]) -> list[bytes]:
        special = self.vocab.special_pattern
        split = []
        for body in bodies:
            if special and special.search(body):
                split.append([(s if k % 2 else self.split(s)) for k, s in enumerate(special.split(body))])
            else:
                split.append([self.split(body)])
        unknown: set[str] = set()
        for sections in split:
            for words in sections[::2]:
                unknown.update(words)
        if len(self.cache) + len(unknown) > self.limit:
            self.cache.clear()
        long = self._learn(unknown.difference(self.cache))
        known, specials = self.cache, self.vocab.specials
        out = [b"".join([b"".join([known[w] for w in section]) if k % 2 == 0
                         else specials[section].to_bytes(4, "little") for k, section in enumerate(sections)])
               for sections in split]
        for word in long:
            del known[word]
        return out

    def decode(self, ids: bytes) -> str:
        pieces = self.vocab.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def make():
        codec = Codec(vocabulary(raw.value))

        def step(columns: list) -> dict:
            found = codec.encode_batch(columns[1])
            return {"doc_id": columns[0], "n_tokens": [len(x) // 4 for x in found], "ids": found}

        return step

    return map_rows(texts(docs, id_col, text_col), make, "doc_id bigint, n_tokens bigint, ids binary")


def decode_ids(rows: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text. Null ids decode to the empty text; an id outside the vocabulary is an error."""
    raw = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def make():
        codec = Codec(vocabulary(raw.value))
        return lambda columns: {"doc_id": columns[0], "text": [codec.decode(x or b"") for x in columns[1]]}

    return map_rows(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), make,
                    "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256. Nothing is kept or shuffled."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def make():
        codec = Codec(vocabulary(raw.value))

        def step(columns: list) -> dict:
            found = codec.encode_batch(columns[1])
            return {"doc_id": columns[0], "n_tokens": [len(x) // 4 for x in found],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in found],
                    "decoded_sha256": [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found]}

        return step

    return map_rows(texts(docs, id_col, text_col), make,
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
