import random
from datetime import datetime, timedelta

import pytest

from snaptide.operators.asof import first_at_or_after
from snaptide.operators.offsets import offset_types, partition_bounds, within_bounds


def brute(targets, log):
    out = {}
    for (t, p, o) in targets:
        cands = [(lo, ts) for (lt, lp, lo, ts) in log if lt == t and lp == p and lo >= o]
        out[(t, p, o)] = min(cands)[1] if cands else None
    return out


@pytest.mark.parametrize("bucket", [1, 7, 64, 1 << 18])
def test_first_at_or_after_matches_brute_force(spark, bucket):
    rnd = random.Random(bucket)
    base = datetime(2024, 1, 1)
    log, targets = [], set()
    for t in ("a", "b"):
        for p in range(3):
            offs = sorted(rnd.sample(range(0, 400), 60 if p else 5))  # sparse, one nearly empty partition
            log += [(t, p, o, base + timedelta(seconds=o * 3 + rnd.random())) for o in offs]
            targets |= {(t, p, rnd.randrange(-5, 420)) for _ in range(40)}
            targets |= {(t, p, o) for o in offs[::7]}                # exact hits
    targets.add(("zz", 0, 3))                                         # partition without log
    ldf = spark.createDataFrame(log, "topic string, partition int, offset long, timestamp timestamp_ntz")
    tdf = spark.createDataFrame(sorted(targets), "topic string, partition int, offset long")
    got = {(r.topic, r.partition, r.offset): r.offset_timestamp
           for r in first_at_or_after(tdf, ldf, ["topic", "partition"], bucket=bucket).collect()}
    assert got == brute(targets, log)


def test_offset_types_and_bounds(spark):
    base = datetime(2024, 1, 1)
    log = spark.createDataFrame([("a", 0, 3, base + timedelta(seconds=9)), ("a", 0, 5, base + timedelta(seconds=9)),
                                 ("a", 0, 8, base + timedelta(seconds=1))],
                                "topic string, partition int, offset long, timestamp timestamp_ntz")
    got = {r.offset_type: (r.offset, r.timestamp) for r in offset_types(log).collect()}
    # MAX_TIMESTAMP: greatest timestamp, smallest offset among ties
    assert got == {"EARLIEST": (3, None), "LATEST": (9, None), "MAX_TIMESTAMP": (3, base + timedelta(seconds=9))}
    commits = spark.createDataFrame([("a", 0, 2), ("a", 0, 3), ("a", 0, 8), ("a", 0, 9)],
                                    "topic string, partition int, offset long")
    kept = sorted(r.offset for r in within_bounds(commits, partition_bounds(log)).collect())
    assert kept == [3, 8]
