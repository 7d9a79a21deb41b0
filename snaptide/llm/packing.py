"""Best-fit packing of token sequences under several capacities.

A document's ids get a closing id; longer ones than the capacity are cut (only those), the first piece
taking the remainder. A piece is a vector (tokens, 1 document, tokens squared as attention cost); a sequence
has a capacity in each of the three. Pieces are placed by falling length; of the open sequences in which a
piece fits in every dimension, best fit takes the one with the smallest weighted norm of what would be left
(``norm``) or with the largest weighted dot product of the piece and what is left (``dot``).

Pieces of one length are equal vectors, so the choice is made for all of them at once: the plan is computed
from the number of pieces of each length (at most ``capacity`` numbers, whatever the input), and says for
ranges of a length's ranks which sequences and offsets they get. Ranks come from counts by task and length,
not from a sort of all pieces of a length, so a length that a third of all pieces share is no bottleneck.

Cases: null and empty texts are the closing id alone. Rows that repeat an id are packed like any other.
No rows: no pieces. A piece that exceeds a capacity on its own (attention cost below its own square) is an
error, named before anything is packed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaptide.llm.bpe import PATTERN, Codec, byte_alphabet, read_vocabulary, vocabulary
from snaptide.llm.common import parts, read_table, texts, written

CAPACITY = 2048
CLOSING_ID = 0


@lru_cache(maxsize=2)
def fast_encoding(raw: str):
    """The tokenizer file's vocabulary in the encoder library that is fastest for whole texts. It merges by the order of
    ids, which gives the same ids where the file's merges are in the order of their ids; else None."""
    import tiktoken

    spec = json.loads(raw)
    alphabet = byte_alphabet()
    ids = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
    last = -1
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        new = spec["model"]["vocab"][a + b]
        if new <= last:
            return None
        last = new
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ids,
                             special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})


@lru_cache(maxsize=2)
def rank_codec(raw: str) -> Codec:
    return Codec(vocabulary(raw), 10_000)


def encode(raw: str, text: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit integers."""
    fast = fast_encoding(raw)
    if fast:
        try:
            return np.asarray(fast.encode(text, allowed_special="all"), dtype="<u4")
        except ValueError:  # its pattern engine gives up on white space of some hundred thousand characters
            pass
    return np.frombuffer(rank_codec(raw).encode_batch([text])[0], dtype="<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else whole capacities after the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
           id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (rank among the task's pieces of that length) and,
    if asked for, ids (little-endian unsigned 32-bit integers)."""
    raw = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.binary())] if keep_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, closing = TaskContext.get().partitionId(), np.array([closing_id], dtype="<u4")
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in parts(batch):
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.concatenate([encode(raw.value, text), closing])
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start:start + length].tobytes()
                        out.append((doc_id, k, start, length, zlib.crc32(own), task, seen[length], own))
                        seen[length] += 1
                columns = list(zip(*out)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, fields)],
                                                 names=[n for n, _ in fields])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return texts(docs, id_col, text_col).mapInArrow(run, kind + (", ids binary" if keep_ids else ""))


@dataclass
class Plan:
    """Placement rows: ranks lo..hi of a length go to sequences base, base+1, ..., ``each`` of them into one
    sequence, from ``offset`` on."""
    length: list[int] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0

    def add(self, length: int, lo: int, base: int, each: int, offset: int) -> None:
        for column, x in zip((self.length, self.lo, self.base, self.each, self.offset), (length, lo, base, each, offset)):
            column.append(x)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, max_documents: int | None = None,
                 max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
                 choose: str = "norm") -> Plan:
    """Vector best fit, by falling length, of ``counts[length]`` pieces of each length.

    Open sequences in the same state form a group; a group is what the choice is made among. ``norm`` prefers
    the fullest, so one sequence takes pieces until no more fit; ``dot`` prefers the emptiest, so each
    sequence of a group takes one before any takes a second.
    """
    if choose not in ("norm", "dot"):
        raise ValueError("choose: norm or dot")
    caps = np.array([capacity, max_documents or capacity, max_attention or capacity ** 2], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    plan = Plan()
    left = np.zeros((0, 3))
    size = np.zeros(0, dtype=np.int64)
    base = np.zeros(0, dtype=np.int64)
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1.0, float(length) ** 2])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} ids exceeds a capacity")
        todo, rank = counts[length], 0
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1)) if len(left) else []
            if not len(fits):
                per = int((caps // need).min()) if choose == "norm" else 1
                fresh = -(-todo // per)
                left = np.vstack([left, caps])
                size, base = np.r_[size, fresh], np.r_[base, plan.sequences]
                plan.sequences += fresh
                at = len(size) - 1
            else:
                rest = left[fits] / caps
                if choose == "norm":
                    score = -((w * (rest - need / caps)) ** 2).sum(axis=1)
                else:
                    score = (w * rest * (need / caps)).sum(axis=1)
                at = fits[int(score.argmax())]
            per = int((left[at] // need).min()) if choose == "norm" else 1
            offset = int(capacity - left[at, 0])
            whole = min(int(size[at]), todo // per)
            rest_of = todo - whole * per if whole < size[at] else 0
            if whole:
                plan.add(length, rank, int(base[at]), per, offset)
            last = min(rest_of, per - 1) if whole < size[at] else 0
            if last:
                plan.add(length, rank + whole * per, int(base[at]) + whole, last, offset)
            rank += whole * per + last
            todo -= whole * per + last
            # the group falls apart: filled sequences, the one filled in part, untouched ones
            parts = [(left[at] - per * need, whole, int(base[at]))]
            if last:
                parts.append((left[at] - last * need, 1, int(base[at]) + whole))
            used = whole + (1 if last else 0)
            parts.append((left[at], int(size[at]) - used, int(base[at]) + used))
            parts = [p for p in parts if p[1] and p[0][0] >= 1 and p[0][1] >= 1 and p[0][2] >= 1]
            keep = np.arange(len(size)) != at
            left = np.vstack([left[keep], *[p[0] for p in parts]])
            size = np.r_[size[keep], [p[1] for p in parts]].astype(np.int64)
            base = np.r_[base[keep], [p[2] for p in parts]].astype(np.int64)
    return plan


def place(found: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_attention: int | None = None,
          weights: tuple[float, float, float] = (1.0, 1.0, 1.0), choose: str = "norm") -> DataFrame:
    """``found`` (written pieces, with task, nth and length) with sequence_id and offset.

    Only the number of pieces of each length reaches the driver (at most ``capacity`` rows).
    """
    by_task = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(by_task.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    counts = {r.length: r.n for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, capacity, max_documents, max_attention, weights, choose)
    order = np.lexsort((plan.lo, plan.length)) if plan.length else np.zeros(0, dtype=np.int64)
    table = np.array([plan.length, plan.lo, plan.base, plan.each, plan.offset], dtype=np.int64)[:, order]
    held = found.sparkSession.sparkContext.broadcast(table)
    names = [c for c in found.columns if c not in ("task", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, base, each, offset = held.value
        key = length * (1 << 44) + lo
        for batch in batches:
            own = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, own * (1 << 44) + rank, side="right") - 1
            t = rank - lo[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(base[at] + t // each[at]), pa.array(offset[at] + t % each[at] * own)],
                names=[*names, "sequence_id", "offset"])

    ranked = (found.join(starts.select("task", "length", "first_rank"), ["task", "length"])
              .select(*names, (F.col("nth") + F.col("first_rank")).alias("rank")))
    kind = ", ".join(f"{c} {t}" for c, t in found.dtypes if c in names)
    return ranked.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID,
         max_documents: int | None = None, max_attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 1.0, 1.0), choose: str = "norm", id_col: str = "doc_id",
         text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    found = written(pieces(docs, vocabulary_path, capacity, closing_id, id_col, text_col, keep_ids), "pieces")
    return place(found, capacity, max_documents, max_attention, weights, choose)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and starts (one for each piece, by offset), ids (all pieces' bytes in order).

    ``packed`` holds ids; a sequence is at most one capacity long, so a group is small.
    """
    group = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), group.alias("parts"))
            .select("sequence_id", "n_tokens", F.col("parts.doc_id").alias("doc_ids"),
                    F.col("parts.offset").alias("starts"),
                    F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids")))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_stage(spark, read_table(spark, sf_dir, "documents"), sf_dir)
