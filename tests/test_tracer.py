"""The trace as a stream, over several batches with rows out of order, against the plain order of events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from codeloom.streaming import trace, tracer

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(6)
    rows = []
    for i in range(900):
        kind = rnd.choice(["CALL", "RETURN", "LOCK", "UNLOCK", "READ", "READ", "WRITE", "WRITE", "READ"])
        rows.append((f"t{rnd.randrange(3)}", START + datetime.timedelta(minutes=i), i, kind, rnd.choice("fgh"), rnd.choice(["0x1", "0x2", "0x3"])))
    return rows


@pytest.fixture(scope="module")
def folder(spark, log, tmp_path_factory):
    """Nine files; rows come up to 20 minutes out of order, and one row a day late."""
    path = tmp_path_factory.mktemp("log") / "rows"
    rnd = random.Random(7)
    mixed = sorted(log, key=lambda r: r[2] + rnd.randrange(20))
    late = ("t0", START, -5, "LOCK", "f", "0x9")
    for k in range(9):
        part = mixed[k * 100 : k * 100 + 100] + ([late] if k == 8 else [])
        spark.createDataFrame(part, "part string, ts timestamp, seq long, kind string, name string, item string").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def passed(log, minutes=30):
    end = max(r[1] for r in log) - datetime.timedelta(minutes=minutes)
    return [r for r in log if r[1] <= end]


def test_accesses(spark, log, folder):
    got = trace.settled(tracer.accesses(trace.source(spark, folder, 1), "part", "ts", "30 minutes"), "append", tracer.STORE)
    want = {}
    for part in ("t0", "t1", "t2"):
        stack, locks, calls = [], set(), {}
        for _, _, seq, kind, name, item in (r for r in passed(log) if r[0] == part):
            if kind == "CALL":
                calls[name] = calls.get(name, 0) + 1
                stack.append((name, calls[name]))
            elif kind == "RETURN":
                del stack[-1:]
            elif kind == "LOCK":
                locks.add(item)
            elif kind == "UNLOCK":
                locks.discard(item)
            else:
                want[seq] = (*(stack[-1] if stack else (None, None)), len(stack), sorted(locks))
    rows = got.collect()
    assert {r.seq: (r.func, r.invno, r.depth, r.held) for r in rows} == want and len(rows) == len(want) > 300


def test_compacted(spark, log, folder):
    got = trace.settled(tracer.compacted(trace.source(spark, folder, 1).withColumn("part", F.lit("run")), "part", "ts", "30 minutes"), "append", tracer.STORE)
    want, seg, context, sums = [], 0, None, {}
    for _, _, seq, kind, name, item in passed(log):
        if kind not in ("READ", "WRITE"):
            want += [("run", seg, context, k, *v) for k, v in sums.items()]
            seg, sums = seg + 1, {}
            continue
        context = name if not sums else context
        if name == context:
            s = sums.setdefault(item, [0, 0, None, None])
            k = int(kind == "WRITE")
            s[k] += 1
            s[2 + k] = seq if s[2 + k] is None else s[2 + k]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 100
