"""Node completion: live nodes plus quorum members that are not live, with
controller and quorum flags. Set-wise: the quorum arrives as (snapshot key,
node id) rows of voters and observers, so it never has to sit in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.functions.scalars import quorum_flag
from snaptide.operators.joins import lookup


def missing_nodes(quorum_ids: DataFrame, live: DataFrame, keys) -> DataFrame:
    """J12 + P12: quorum member ids with no live node, as placeholder rows
    (host NULL, port -1, rack NULL)."""
    keys = list(keys)
    ids = quorum_ids.select(*keys, "k_node_id").distinct()
    gone = lookup(ids, live.select(*keys, "k_node_id"), keys + ["k_node_id"], "left_anti")
    return gone.select(*keys, "k_node_id", F.lit(None).cast("string").alias("host"),
                       F.lit(-1).alias("port"), F.lit(None).cast("string").alias("rack"))


def all_nodes(live: DataFrame, meta: DataFrame, voters: DataFrame, observers: DataFrame, keys) -> DataFrame:
    """U1 + P1 + P2.

    ``live``: keys, k_node_id, host, port, rack. ``meta``: one row per
    snapshot key with ``controller_id`` and ``leader_id`` (NULL = the cluster
    reports no quorum; then all quorum flags are NULL). ``voters`` /
    ``observers``: keys, k_node_id.
    """
    keys = list(keys)
    quorum_ids = voters.select(*keys, "k_node_id").unionByName(observers.select(*keys, "k_node_id"))
    nodes = live.select(*keys, "k_node_id", "host", "port", "rack").unionByName(
        missing_nodes(quorum_ids, live, keys))
    nk = keys + ["k_node_id"]
    v = voters.select(*nk).distinct().withColumn("_v", F.lit(True))
    o = observers.select(*nk).distinct().withColumn("_o", F.lit(True))
    m = meta.select(*keys, "controller_id", "leader_id")
    # meta is one row per capture; the nodes of one capture are few, and AQE
    # splits a capture that holds too many of them
    n = lookup(lookup(lookup(nodes, m, keys), v, nk, "left"), o, nk, "left")
    quorum, node = F.col("leader_id"), F.col("k_node_id")
    return n.select(*keys, "k_node_id", "host", "port", "rack",
                    (node == F.col("controller_id")).alias("controller"),
                    quorum_flag(quorum, node == quorum).alias("leader"),
                    quorum_flag(quorum, F.coalesce(F.col("_v"), F.lit(False))).alias("voter"),
                    quorum_flag(quorum, F.coalesce(F.col("_o"), F.lit(False))).alias("observer"))
