"""Quality rules: gradient-boosted trees over document statistics, with monotone constraints.

Statistics come from each whole text (``document_statistics``). The trees are fitted on the driver from at
most ``max_rows`` labelled documents (those with the smallest hash of their id), a bound that does not grow
with the input; everything else covers all documents. A fitted model is flat numpy arrays (feature,
threshold, left child, value), so a batch is scored by ``depth`` array lookups for each tree. Features with
a constraint of -1 can only lower, with +1 only raise the score as they grow.

Cases: a null or empty text has no words, all counts 0, and fails the base rule. Without labels, or with
labels of one class, the trees have no say: the verdict is the base rule's. Labels with null are left out;
several labels of one document count as their minimum. Every input row gives one row, repeated ones too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import drop_rows, map_rows, read_table, text_digest, texts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_TRAINING_ROWS = 20_000
KEEP_FROM = 0.5

# Fixed value: symbols that the base statistics count.
SYMBOLS = b"#*$%&|<>"

#: feature name -> direction of its constraint (0: none)
FEATURES = {
    "log_words": 0, "mean_word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "marks_per_word": -1, "distinct_share": 0, "mean_line_words": 0,
    "max_word_bytes": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    window = ids[:n]
    for k in range(1, WINDOW):
        # dense numbers of the windows so far, times the words: exact, without hashing
        window = window * len(codes) + ids[k:k + n]
        if k < WINDOW - 1:
            window = np.unique(window, return_inverse=True)[1]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(BASE counts, FEATURES values) of a whole UTF-8 text."""
    words = WORD.findall(text)
    n = len(words)
    byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    space = int(byte[0x20] + byte[0x09:0x0E].sum())
    chars = len(text) - int(byte[0x80:0xC0].sum()) - space
    symbols = int(byte[list(SYMBOLS)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    w, c = max(n, 1), max(chars, 1)
    features = [np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeat / w,
                byte[0x41:0x5B].sum() / c, byte[0x30:0x3A].sum() / c, byte[0x21] / w, len(set(words)) / w,
                n / max(len(lines), 1), max(map(len, words), default=0)]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the BASE counts, features (array, in the order of FEATURES)."""
    def make():
        def step(columns: list) -> dict:
            found = [statistics(t) for t in columns[1]]
            return ({"doc_id": columns[0], "features": [f for _, f in found]}
                    | {name: [base[k] for base, _ in found] for k, name in enumerate(BASE)})
        return step

    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id bigint, " + ", ".join(f"{b} bigint" for b in BASE) + ", features array<double>")


@dataclass(frozen=True)
class Trees:
    """All trees in one set of node arrays. A leaf is its own left child, so that lookups may go on past it;
    a right child follows its left sibling."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[node]] > self.threshold[node]
                node = self.left[node] + right
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, constraints: list[int], n_trees: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> Trees:
    """Logistic boosting over quantile bins. A constrained split must order its children's values, and the
    middle of the two bounds all values further down on either side."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    margin = np.full(n, bias)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        for column, default in ((feature, 0), (threshold, np.inf), (left, len(left)), (value, 0.0)):
            column.append(default)
        return len(left) - 1

    def best(g, h, low, high) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + l2) * v * v)

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            total_g, total_h = grad[rows].sum(), hess[rows].sum()
            own = best(total_g, total_h, low, high)
            value[at] = rate * own
            choice = (1e-6, None)
            if level < depth and len(rows) >= 2 * min_rows:
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    size = len(cuts[j]) + 1
                    code = binned[rows, j]
                    g = np.cumsum(np.bincount(code, grad[rows], size))[:-1]
                    h = np.cumsum(np.bincount(code, hess[rows], size))[:-1]
                    c = np.cumsum(np.bincount(code, minlength=size))[:-1]
                    lv = np.clip(-g / (h + l2), low, high)
                    rv = np.clip(-(total_g - g) / (total_h - h + l2), low, high)
                    gains = gain(g, h, lv) + gain(total_g - g, total_h - h, rv) - gain(total_g, total_h, own)
                    ok = (c >= min_rows) & (len(rows) - c >= min_rows) & (constraints[j] * (rv - lv) >= 0)
                    gains = np.where(ok, gains, -np.inf)
                    k = int(gains.argmax())
                    if gains[k] > choice[0]:
                        choice = (gains[k], (j, k, lv[k], rv[k]))
            if choice[1] is None:
                margin[rows] += value[at]
                continue
            j, k, lv, rv = choice[1]
            feature[at], threshold[at] = j, float(cuts[j][k])
            a, b = node(), node()
            left[at] = a
            goes = binned[rows, j] <= k
            middle = (lv + rv) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)),
                      -1: ((middle, high), (low, middle))}[constraints[j]]
            todo += [(a, rows[goes], level + 1, *bounds[0]), (b, rows[~goes], level + 1, *bounds[1])]
    return Trees(np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Trees | None:
    """Trees from at most ``max_rows`` labelled documents; None without two classes."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows rows of two numbers: a proven bound for the broadcast
    own = texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text")
    seen = (document_statistics(own).join(F.broadcast(known), "doc_id")
            .groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))
            .orderBy("doc_id").select("features", "quality").collect())
    y = np.array([float(r.quality > 0) for r in seen])
    if not len(y) or y.min() == y.max():
        return None
    return fit_trees(np.array([r.features for r in seen]), y, list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees | None, keep_from: float = KEEP_FROM, id_col: str = "doc_id",
          text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, the BASE counts, base_failed, score, kept and (``digest``) the digest of the text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = held.value

        def step(columns: list) -> dict:
            found = [statistics(t) for t in columns[1]]
            base = {name: [b[k] for b, _ in found] for k, name in enumerate(BASE)}
            failed = [b[0] < MIN_WORDS or 100 * b[4] > MAX_REPEAT_PERCENT * b[0] for b, _ in found]
            score = trees.probability(np.array([f for _, f in found])) if trees and found else np.ones(len(found))
            return base | {"doc_id": columns[0], "digest": columns[-1], "base_failed": failed, "score": score.tolist(),
                           "kept": [bool(not bad and s >= keep_from) for bad, s in zip(failed, score)]}

        return step

    rows = texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"),
                                                *[text_digest()] * digest)
    return map_rows(rows, make, "doc_id bigint, " + ", ".join(f"{b} bigint" for b in BASE)
                    + ", base_failed boolean, score double, kept boolean" + ", digest binary" * digest)


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    found = judge(docs, model, digest=True)
    return drop_rows(docs, found.where(~F.col("kept")).select("doc_id", "digest"), text_digest())


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))
