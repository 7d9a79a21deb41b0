"""URL filter: listed rules first, then rules mined from labels by FP-growth.

A url becomes a set of tokens (host suffixes, leading path segments, words of every path segment,
query keys). FP-growth mines the token sets that occur often among labelled urls together with their label;
rules ``tokens -> block`` or ``tokens -> allow`` stay if they have ``MIN_COUNT`` urls, the confidence, and a
lift over the label's own share. A rule has to be labelled on ``MIN_LABELLED`` of all urls that it fits, so that
labels of a small part of a domain do not decide all of it. The rules are kept in an inverted index under their
rarest token; a url's tokens are joined with that index, and a rule fires if all of its tokens are there. Of
the rules that fire the most confident decides (then the better supported; ``allow`` of equals). Urls without a
firing rule are allowed.

Labels of the registered query: ``pages`` carry none of their own, so a page is labelled by the listed rule
that covers it; pages that none covers are not labelled and take no part in the training. Any (id, label) table
can be given instead.

Cases: a null url or one without ``://`` has an empty host and path, no tokens and no rule: it is allowed.
Repeated ids: each row keeps its own verdict. Without labels there are no mined rules; no rows give no rows. Ties
are settled as above. Very long urls are read whole. Only id and url are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import ascii_lower, read_table, written

# The listed rules (verdict, host, path).
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_COUNT = 20
MIN_CONFIDENCE = 0.95
MIN_LIFT = 1.2
MIN_LABELLED = 0.3
LABELS = ("allow", "block")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> Column:
    """The longest listed rule that fits, as a struct (rule, verdict); null if none fits."""
    hit = F.lit(None)
    for verdict, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        hit = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(hit)
    return hit


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host suffixes, the leading one and two path segments, words of all segments, query keys.
    Digits become 0, so that numbered pages share tokens."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    parts = F.filter(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "0"), "/"), lambda p: p != "")
    heads = F.filter(F.array(F.array_join(F.slice(parts, 1, 1), "/"), F.array_join(F.slice(parts, 1, 2), "/")),
                     lambda p: p != "")
    # a first segment of one word is a path token already
    several = F.filter(parts, lambda p, k: (k > 0) | p.rlike("[a-z0-9][^a-z0-9]+[a-z0-9]"))
    words = F.filter(F.flatten(F.transform(several, lambda p: F.split(p, "[^a-z0-9]+"))), lambda w: ~w.isin("", "0"))
    query = F.regexp_extract(ascii_lower(F.coalesce(url, F.lit(""))), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.substring_index(q, "=", 1))
    some = F.array_distinct(F.concat(
        suffixes, F.transform(heads, lambda p: F.concat(F.lit("path:"), p)),
        F.transform(words, lambda w: F.concat(F.lit("word:"), w)), F.transform(keys, lambda k: F.concat(F.lit("key:"), k))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(some)


def mine_rules(labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """labelled: tokens, label. -> rule_id, tokens, label, confidence, support (urls), n_tokens, token (index key),
    written to the shared folder."""
    spark = labelled.sparkSession
    baskets = labelled.where(F.size("tokens") > 0).select(
        F.array_append("tokens", F.concat(F.lit("label:"), F.col("label"))).alias("items"))
    kind = "tokens array<string>, label string, confidence double, support bigint, n_tokens int, token string, rule_id bigint"
    total = baskets.count()
    if total < min_count:
        return written(spark.createDataFrame([], kind), "url-rules")
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / total, minConfidence=min_confidence).fit(baskets)
    is_label = F.col("consequent")[0].startswith("label:")
    clean = ~F.exists("antecedent", lambda t: t.startswith("label:"))
    # a rule that a shorter one makes needless stays out by the order of firing
    rules = model.associationRules.where(is_label & clean & (F.col("lift") >= min_lift)).select(
        F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 2**30).alias("label"),
        "confidence", F.round(F.col("support") * total).cast("long").alias("support"), F.size("antecedent").alias("n_tokens"))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = (rules.withColumn("token", F.explode("tokens")).join(single, "token")
              .groupBy("tokens", "label", "confidence", "support", "n_tokens")
              .agg(F.min_by("token", F.struct("freq", "token")).alias("token"))
              .withColumn("rule_id", F.xxhash64("tokens", "label")))
    return written(rarest, "url-rules")


def _fits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (tokens and others) with each rule of the inverted index that fits: the index gives the rules whose
    rarest token is there, the rest is checked."""
    probes = rows.withColumnRenamed("tokens", "own").withColumn("token", F.explode("own"))
    return probes.join(rules, "token").where(F.size(F.array_except("tokens", "own")) == 0)


def labelled_rules(sets: DataFrame, rules: DataFrame, min_labelled: float = MIN_LABELLED) -> DataFrame:
    """Rules labelled on at least ``min_labelled`` of the urls they fit. sets: tokens, n (urls), n_labelled. Counted by
    partial sums, one number pair for each rule."""
    share = (_fits(sets.select("tokens", "n", "n_labelled"), rules).groupBy("rule_id")
             .agg((F.sum("n_labelled") / F.sum("n")).alias("share")).where(F.col("share") >= min_labelled))
    return written(rules.join(share.select("rule_id"), "rule_id", "left_semi").select(rules.columns), "labelled-rules")


def match_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows: key, tokens -> key, mined (verdict, confidence, support, tokens) of rows for which a rule fires."""
    return _fits(rows.select("key", "tokens"), rules).groupBy("key").agg(F.max(F.struct(
        "confidence", "support", (F.col("label") == "allow").alias("allows"), "tokens", "label")).alias("mined"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url",
               min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT,
               min_labelled: float = MIN_LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_tokens, confidence for each row of ``pages``.

    ``labels`` (page_id, label of LABELS) gives the training verdicts; without it the listed rules do.
    """
    host, path = split_url(F.col("url"))
    base = (pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .withColumn("host", host).withColumn("path", path))
    base = base.select("page_id", "url", "host", "path", listed_rule(F.col("host"), F.col("path")).alias("listed"))
    split = base.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    if labels is None:
        split = split.withColumn("label", F.col("listed.verdict"))
    else:  # rows of one id count as one label, the stricter of two
        known = (labels.select(F.col(id_col).cast("long").alias("page_id"), "label").where(F.col("label").isin(*LABELS))
                 .groupBy("page_id").agg(F.max("label").alias("label")))
        split = split.join(known, "page_id", "left")
    # each distinct token set once
    split = split.withColumn("key", F.xxhash64("tokens"))
    sets = written(split.where(F.size("tokens") > 0).groupBy("key", "tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("n_labelled"),
        F.max(F.col("listed").isNull()).alias("open")), "token-sets")
    rules = labelled_rules(sets, mine_rules(split.where("label is not null").select("tokens", "label"), min_count,
                                            min_confidence, min_lift), min_labelled)
    # only urls without a listed rule need the mined ones
    unlisted = F.col("listed").isNull() & (F.size("tokens") > 0)
    open_rows = split.where(unlisted)
    fired = match_rules(sets.where("open"), rules)
    judged = (open_rows.join(fired, "key", "left")
              .select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                      F.coalesce("mined.label", F.lit("allow")).alias("verdict"),
                      F.col("mined.tokens").alias("mined_tokens"), F.col("mined.confidence").alias("confidence")))
    settled = split.where(~unlisted).select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.lit("allow")).alias("verdict"),
        F.lit(None).cast("array<string>").alias("mined_tokens"), F.lit(None).cast("double").alias("confidence"))
    return settled.unionByName(judged)


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))
