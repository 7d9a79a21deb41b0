"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

1. Evidence of a document: log odds of good against bad from its whole text, by a naive Bayes model of
   hashed words and punctuation shapes. Word counts come from at most ``max_rows`` labelled documents (those
   with the smallest hash of their id); the model has ``DIMENSIONS`` weights, a fixed size for the broadcast.
   The mean log odds of a word is scaled to a log likelihood ratio by logistic regression on a held-back half.
2. Sites: every document, labelled or not, counts as ``p`` good and ``1 - p`` bad of its path and host,
   ``p`` from its own evidence. Sums by path are grouped first, hosts are sums of paths, the global rate is
   the sum of hosts, so a host with a third of all rows is pre-aggregated before it is shuffled.
3. Shrinkage: a host's rate is drawn to the global rate, a path's to its host's, each with the strength (in
   documents) that the spread of the rates between groups asks for by the method of moments.
4. Posterior of a document: the odds of its path without its own contribution to path and host, times its
   own evidence, which so counts once.

Cases: null and empty texts have evidence 0; null hosts and paths are groups of their own. Without labels of
two classes all evidence is 0 and every document is kept. A document alone on its site has the global rate as
its prior. Every input row gives one row, repeated ones too; no rows give no rows. Ties need no order: only
sums enter. Very long texts are read whole. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import map_rows, read_table, texts, written

DIMENSIONS = 1 << 15
MAX_TRAINING_ROWS = 20_000
KEEP_FROM = 0.2
TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[a-z\x80-\xff]+")
CAPITALS = re.compile(rb"[A-Z]+")


CACHE_WORDS, LONG_WORD = 300_000, 512
REPEATED = zlib.crc32(b"repeated") % DIMENSIONS


class Terms:
    """Words, word shapes (letters folded to a, capitals to A) and words equal to the one before, of a whole
    text, as counts by bucket. Buckets of words are remembered up to a number of words and their length."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int]] = {}

    def _buckets(self, word: bytes) -> tuple[int, int]:
        shape = CAPITALS.sub(b"A", LETTERS.sub(b"a", word))
        return zlib.crc32(b"w" + word.lower()) % DIMENSIONS, zlib.crc32(b"s" + shape) % DIMENSIONS

    def __call__(self, text: bytes) -> Counter:
        words = TOKEN.findall(text)
        counts: Counter = Counter()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        for word, n in Counter(words).items():
            pair = self.known.get(word)
            if pair is None:
                pair = self._buckets(word)
                if len(word) <= LONG_WORD:
                    self.known[word] = pair
            counts[pair[0]] += n
            counts[pair[1]] += n
        if same := sum(map(bytes.__eq__, words, words[1:])):
            counts[REPEATED] += same
        return counts


def fit_evidence(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float, float]:
    """(weights by bucket, scale, offset) of the log likelihood ratio ``offset + scale * mean weight``."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    own = (texts(docs).join(F.broadcast(known), "doc_id")
           .select("doc_id", F.col("text").cast("binary").alias("text"), F.col("quality").cast("long").alias("quality")))

    def make():
        terms_of = Terms()

        def step(columns: list) -> dict:
            rows = [(terms_of(t), int(q > 0), (d or 0) % 2) for d, t, q in zip(*columns)]
            sums: dict[tuple[int, int], Counter] = {}
            for terms, good, half in rows:
                sums.setdefault((good, half), Counter()).update(terms)
            flat = [(good, half, b, n) for (good, half), c in sums.items() for b, n in c.items()]
            return {k: [x[i] for x in flat] for i, k in enumerate(("good", "half", "bucket", "n"))}
        return step

    counted = (map_rows(own, make, "good bigint, half bigint, bucket bigint, n bigint")
               .groupBy("good", "half", "bucket").agg(F.sum("n").alias("n")).collect())  # at most 4 x DIMENSIONS rows
    table = np.zeros((2, 2, DIMENSIONS))
    for r in counted:
        table[r.good, r.half, r.bucket] = r.n
    sizes = table.sum(axis=2)
    if (sizes.sum(axis=1) == 0).any():
        return np.zeros(DIMENSIONS), 0.0, 0.0

    def weights(counts: np.ndarray) -> np.ndarray:
        rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * DIMENSIONS)
        return np.log(rate[1]) - np.log(rate[0])

    halves = [weights(table[:, h]) if (sizes[:, h] > 0).all() else weights(table.sum(axis=1)) for h in (0, 1)]
    held = docs.sparkSession.sparkContext.broadcast(halves)

    def make_scores():
        both, terms_of = held.value, Terms()

        def step(columns: list) -> dict:
            # each half is scored with the other half's weights
            return {"doc_id": columns[0], "good": [int(q > 0) for q in columns[2]],
                    "x": [_mean(terms_of(t), both[1 - (d or 0) % 2]) for d, t in zip(columns[0], columns[1])]}
        return step

    # rows of one id count once, so at most max_rows rows come back
    scored = (map_rows(own, make_scores, "doc_id bigint, x double, good bigint")
              .groupBy("doc_id").agg(F.avg("x").alias("x"), F.min("good").alias("good")).collect())
    x, y = np.array([r.x for r in scored]), np.array([float(r.good) for r in scored])
    scale, offset = _logistic(x, y)
    prior = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    return weights(table.sum(axis=1)), scale, offset - prior


def _mean(terms: Counter, weight: np.ndarray) -> float:
    total = sum(terms.values())
    return sum(weight[b] * n for b, n in terms.items()) / total if total else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float]:
    a = b = 0.0
    for _ in range(50):  # Newton steps for two numbers
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + l2 * a, (p - y).sum()])
        h = np.array([[(w * x * x).sum() + l2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def evidence(docs: DataFrame, model: tuple, host: Column, path: Column, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, host, path, llr: the log likelihood ratio of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        (weight, scale, offset), terms_of = held.value, Terms()

        def step(columns: list) -> dict:
            found = [terms_of(t) for t in columns[3]]
            return {"doc_id": columns[0], "host": columns[1], "path": columns[2],
                    "llr": [float(np.clip(offset + scale * _mean(c, weight), -12, 12)) if c else 0.0 for c in found]}
        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), host.cast("string").alias("host"),
                       path.cast("string").alias("path"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return map_rows(rows, make, "doc_id bigint, host string, path string, llr double")


def _strength(groups: DataFrame, rate: Column) -> float:
    """Prior strength in documents, from the spread of group rates beyond sampling (method of moments)."""
    own, within = F.col("good") / F.col("n"), rate * (1 - rate)
    one = groups.agg(F.sum(F.col("n") * (own - rate) ** 2).alias("between"), F.sum(within).alias("expected"),
                     F.sum("n").alias("n"), F.sum(F.col("n") * within).alias("variance")).first()
    if not one.n:
        return 1.0
    spread = max((one.between - one.expected) / one.n, one.variance / one.n * 1e-4, 1e-12)
    return max(one.variance / one.n / spread, 1e-6)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n, good, strength, path_rate of each path and of_n, of_good, of_strength, host_rate of its host, with
    the global rate: every group shrunk toward its parent. Three numbers (the rate and the two strengths) pass through
    the driver."""
    own = 1 / (1 + F.exp(-F.col("llr")))
    paths = written(scored.groupBy("host", "path").agg(F.sum(own).alias("good"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg((F.sum("good") / F.sum("n")).alias("rate")).first().rate or 0.5
    strength = _strength(hosts, F.lit(total))
    host_rates = hosts.select(F.col("host").alias("of_host"), F.col("good").alias("of_good"), F.col("n").alias("of_n"),
                              F.lit(strength).alias("of_strength"), F.lit(total).alias("global_rate"),
                              ((F.col("good") + strength * total) / (F.col("n") + strength)).alias("host_rate"))
    joined = paths.join(host_rates, paths["host"].eqNullSafe(host_rates["of_host"])).drop("of_host")
    strength = _strength(joined, F.col("host_rate"))
    return written(joined.withColumn("strength", F.lit(strength))
                   .withColumn("path_rate", (F.col("good") + strength * F.col("host_rate")) / (F.col("n") + strength)),
                   "sites")


def posteriors(scored: DataFrame) -> DataFrame:
    """doc_id, host, path, doc_probability, host_rate, path_rate, probability for each row of doc_id, host, path, llr."""
    sites = site_posteriors(scored).withColumnsRenamed({"host": "site_host", "path": "site_path"})
    own = 1 / (1 + F.exp(-F.col("llr")))
    others = ((F.col("of_good") - own + F.col("of_strength") * F.col("global_rate"))
              / (F.col("of_n") - 1 + F.col("of_strength")))
    rate = (F.col("good") - own + F.col("strength") * others) / (F.col("n") - 1 + F.col("strength"))
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    logit = F.col("llr") + F.log(rate / (1 - rate))
    return (scored.join(sites, scored["host"].eqNullSafe(sites["site_host"]) & scored["path"].eqNullSafe(sites["site_path"]))
            .select("doc_id", "host", "path", own.alias("doc_probability"), "host_rate", "path_rate",
                    (1 / (1 + F.exp(-logit))).alias("probability")))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, keep_from: float = KEEP_FROM,
             max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, host, path, doc_probability, host_rate, path_rate, probability, kept."""
    model = fit_evidence(docs, labels, max_rows)
    scored = written(evidence(docs, model, host, path), "evidence")
    return posteriors(scored).withColumn("kept", F.col("probability") >= keep_from)


def query(spark, sf_dir: str) -> DataFrame:
    """``documents``: the source is the host, source and language together the path."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                    F.col("source"), F.concat_ws("/", "source", "lang"))
