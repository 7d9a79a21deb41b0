"""SentencePiece (BPE) encoding and decoding through tables of distinct chunks.

A text gets the leading marker, its spaces become markers (U+2581), and it is cut into chunks: a run of
markers with what follows up to the next marker, and, as chunks of their own, runs of ASCII control
characters that no piece of the vocabulary holds. The vocabulary is checked when it is loaded: if no piece
has a marker behind another character, no merge can cross a chunk's border, so a chunk's pieces do not depend
on the text around it (else the whole text is one chunk). The distinct chunks of a group of texts form a
table, each is segmented once, and the ids are joined back by position. A task keeps its table for the
groups that follow, up to a number of bytes (and the one before it); chunks longer than ``KEEP_CHARS`` leave it with their group.
The table stays in the task: a table of the whole corpus would have to be joined with every word's position
in a shuffle several times the size of the texts.

Within a chunk the adjacent pair that makes the piece of the highest score is merged first, the leftmost of
equals: short chunks by scanning, longer ones with a heap over a linked list. Characters without a piece
become their UTF-8 bytes' pieces, or the unknown id where the vocabulary has no byte pieces.

The vocabulary is a SentencePiece model file of BPE kind without text normalisation; its path is a parameter.
The driver reads it and broadcasts it (tens of thousands of pieces, a fixed size).

Cases: null and empty texts have no ids but the end id and decode to the empty text. Markers in a text are
read as spaces, control pieces spelled out in it are plain characters. Every input row gives one row,
repeated ones too; very long chunks (a text without spaces) take n log n steps; no rows give no rows; extra
columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import ARROW, read_table, texts

MARK = "▁"
SHORT = 24
KEEP_CHARS = 64
TABLE_BYTES = 80 << 20
GROUP_CHARS = 2_000_000
# Fixed values of the model file format: kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def _fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """(field number, value) of one message of the model file."""
    out, at = [], 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            out.append((key >> 3, number()))
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        out.append((key >> 3, raw[at:at + size]))
        at += size
    return out


class PieceModel:
    """Pieces, scores and settings of a model file."""

    def __init__(self, raw: bytes):
        model = _fields(raw)
        trainer = dict(_fields(dict(model)[2]))
        normalizer = dict(_fields(dict(model)[3]))
        if trainer.get(3, 1) != BPE_MODEL:
            raise ValueError("the model is not of BPE kind")
        if normalizer.get(2):
            raise ValueError("the model normalises texts")
        if normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("the model changes white space")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(dict(_fields(v)) for f, v in model if f == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            self.pieces.append(text)
            self.kinds.append(kind)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            if kind == NORMAL:
                self.ids[text] = i
                self.scores[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.end = self._control(trainer.get(47, b"</s>").decode())
        named = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes = [named[b] for b in range(256)] if len(named) == 256 else None
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        inner = set("".join(self.ids))
        alone = "".join(c for c in map(chr, [*range(32), 127]) if c not in inner)
        chunk = f"[{re.escape(alone)}]+|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.chunks = re.compile("(?s:.+)" if crossing else chunk).findall
        # decoding: bytes of each id; control pieces are silent but end a run of bytes (0xFF is never valid)
        self.surface = [b"\xff" if k == CONTROL else self.unknown_surface.encode() if k == UNKNOWN
                        else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode()
                        for p, k in zip(self.pieces, self.kinds)]
        self.decimal = [str(i) for i in range(len(self.pieces))]

    def _control(self, text: str) -> int | None:
        found = [i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if p == text and k == CONTROL]
        return found[0] if found else None

    # ---------------------------------------------------------- encoding --
    def marked(self, text: str) -> str:
        out = text.replace(" ", MARK)
        return MARK + out if out and self.dummy_prefix else out

    def segment(self, chunk: str) -> bytes:
        """A chunk's ids as little-endian unsigned 32-bit integers."""
        parts = self._scanned(chunk) if len(chunk) <= SHORT else self._heaped(chunk)
        out: list[int] = []
        for part in parts:
            known = self.ids.get(part)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in part.encode()]
            else:
                out.append(self.unknown)
        return np.array(out, dtype="<u4").tobytes()

    def _scanned(self, chunk: str) -> list[str]:
        score, parts = self.scores.get, list(chunk)
        pairs = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])

    def _heaped(self, chunk: str) -> list[str]:
        score, parts = self.scores.get, list(chunk)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, len(a) + len(b)) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                if (s := score(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            # a pair that has changed since is one of another length: each merge makes its parts longer
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (s := score(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (-s, left, len(parts[left]) + len(parts[right])))
        return [p for p in parts if p]

    # ---------------------------------------------------------- decoding --
    def decode(self, ids: list[int]) -> str:
        """The text of ids; one leading space goes where encoding adds one. Bytes that are no UTF-8 become
        replacement characters, one for each."""
        kinds, stop = self.kinds, len(ids)
        while stop and kinds[ids[stop - 1]] == CONTROL:
            stop -= 1
        ids = ids[:stop]
        first = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), None)
        if first is None:
            return ""
        lead = self.dummy_prefix and kinds[ids[first]] == NORMAL and self.pieces[ids[first]].startswith(MARK)
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        try:
            return out.decode()[lead:]
        except UnicodeDecodeError:
            return "".join(self._runs(ids))[lead:]

    def _runs(self, ids: list[int]) -> Iterator[str]:
        run = b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            yield from self._characters(run)
            run = b""
            if i is not None and self.kinds[i] != CONTROL:
                yield self.surface[i].decode()

    @staticmethod
    def _characters(run: bytes) -> Iterator[str]:
        while run:
            for size in (1, 2, 3, 4):
                try:
                    yield run[:size].decode()
                    run = run[size:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                yield "�"
                run = run[1:]


@lru_cache(maxsize=2)
def piece_model(raw: bytes) -> PieceModel:
    return PieceModel(raw)


class DistinctChunks:
    """One task's table: chunk -> ids. A table of ``limit`` bytes becomes the old one, from which the next takes
    over what it meets again."""

    def __init__(self, model: PieceModel, limit: int = TABLE_BYTES):
        self.model, self.limit, self.held = model, limit, 0
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, bodies: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without the end id."""
        chunks, marked = self.model.chunks, self.model.marked
        placed = [chunks(marked(body)) for body in bodies]
        distinct = set().union(*placed)
        if self.held > self.limit:
            self.old, self.table, self.held = self.table, {}, 0
        known, old, segment = self.table, self.old.get, self.model.segment
        for chunk in distinct.difference(known):
            known[chunk] = ids = old(chunk) or segment(chunk)
            self.held += 200 + 4 * len(chunk) + len(ids)
        out = [b"".join([known[c] for c in places]) for places in placed]
        for chunk in distinct:
            if len(chunk) > KEEP_CHARS:
                self.held -= 200 + 4 * len(chunk) + len(known.pop(chunk))
        return out


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches: at most ``GROUP_CHARS`` bytes of the column, but one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > GROUP_CHARS:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def _mapped(rows: DataFrame, column: int, make, schema: str) -> DataFrame:
    """``make()`` once for each task; its result turns each group's columns into the output's."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [ARROW[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        step = make()
        for group in _groups(batches, column):
            out = step([c.to_pylist() for c in group.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, schema)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _end(model: PieceModel, add_end: bool) -> bytes:
    if add_end and model.end is None:
        raise ValueError("the model has no end piece")
    return model.end.to_bytes(4, "little") if add_end else b""


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  add_end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        chunks = DistinctChunks(piece_model(raw.value))
        end = _end(chunks.model, add_end)

        def step(columns: list) -> list:
            found = [ids + end for ids in chunks.encode(columns[1])]
            return [columns[0], [len(x) // 4 for x in found], found]

        return step

    return _mapped(texts(docs, id_col, text_col), 1, make, "doc_id bigint, n_tokens bigint, ids binary")


def decode_pieces(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text. Null ids decode to the empty text; an id outside the vocabulary is an error."""
    raw = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        decode = piece_model(raw.value).decode
        return lambda columns: [columns[0], [decode(np.frombuffer(x, dtype="<u4").tolist()) for x in columns[1]]]

    given = rows.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _mapped(given, 1, make, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256. Nothing is kept or shuffled."""
    raw = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def make():
        chunks = DistinctChunks(piece_model(raw.value))
        model, end = chunks.model, _end(chunks.model, True)
        decimal = model.decimal

        def step(columns: list) -> list:
            sizes, digests, decoded = [], [], []
            for found in chunks.encode(columns[1]):
                ids = np.frombuffer(found + end, dtype="<u4").tolist()
                sizes.append(len(ids))
                digests.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            return [columns[0], sizes, digests, decoded]

        return step

    return _mapped(texts(docs, id_col, text_col), 1, make,
                   "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
