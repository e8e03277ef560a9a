"""Plans and steps that must not grow with the tables beyond what one process holds."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codeloom import shared
from codeloom.functions.stems import with_stems
from codeloom.operators import attribution, blocks, relevance
from codeloom.plans import binding, dispatch
from codeloom.sources import runs, syntax
from codeloom.streaming import trace


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stems_of_exploded_texts_are_not_broadcast(spark, tmp_path):
    # the planner takes exploded words for as little as the texts that they come from
    spark.range(50).select("id", F.lit("hopping and hoped").alias("text")).write.parquet(str(tmp_path / "t"))
    words = spark.read.parquet(str(tmp_path / "t")).select("id", F.explode(F.split("text", " ")).alias("w"))
    got = with_stems(words, "w")
    assert "BroadcastHashJoin" not in _plan(got)
    assert {(r.w, r.stem) for r in got.collect()} == {("hopping", "hop"), ("and", "and"), ("hoped", "hope")}


def test_term_weights_count_once(spark, monkeypatch):
    rows = [(f, w) for f in range(40) for w in ["a", "a", f"r{f}", f"s{f % 3}", *(["b"] if f % 2 else [])]] + [(None, "a"), (7, None)]
    tokens = spark.createDataFrame(rows, "file long, token string")
    kinds = {f: len({w for g, w in rows if g == f}) for f in range(40)}
    df = {w: len({f for f, v in rows if v == w}) for _, w in rows}
    files = len({f for f, _ in rows})
    want = {(w, f): rows.count((f, w)) / kinds[f] * (files / df[w]) for f, w in rows if f is not None and w is not None}
    for common in (1, 10, 100_000):
        monkeypatch.setattr(relevance, "COMMON", common)
        weights = relevance.term_weights(tokens)
        assert {(r.token, r.file): round(r.score, 9) for r in weights.collect()} == {k: round(v, 9) for k, v in want.items()}
        # tokens are counted and stored once: no plan goes back to them
        assert "Scan ExistingRDD" not in _plan(weights)


def test_blocks_are_cut_with_few_shuffles(spark):
    place = "struct<line:int,col:int>"
    of = spark.createDataFrame([(1, 7, "ENTRY", (0, 0), (40, 0), []), (1, 8, "EXIT", None, None, []), (2, 9, "ENTRY", (0, 0), (9, 0), [])], f"func long, id long, kind string, begin {place}, end {place}, succ array<long>")
    calls = spark.createDataFrame([(1, 4, 2, (33, 1), (33, 9)), (1, 3, 2, (2, 4), (2, 5)), (1, 5, 2, (2, 1), (2, 5))], f"func long, call long, callee long, first {place}, last {place}")
    got = blocks.split_at_calls(of, calls)
    want = [(1, 7, 0, (0, 0), (2, 5), 2), (1, 7, 1, (2, 5), (2, 5), 2), (1, 7, 2, (2, 5), (33, 9), 2), (1, 7, 3, (33, 9), (40, 0), None), (1, 8, 0, None, None, None), (2, 9, 0, (0, 0), (9, 0), None)]
    assert sorted((r.func, r.id, r.piece, r.begin and tuple(r.begin), r.end and tuple(r.end), r.callee) for r in got.collect()) == want
    plan = _plan(got)
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 3


def test_pairs_of_a_large_group_are_dealt_out(spark, monkeypatch):
    rows = spark.range(60).select("id", F.when(F.col("id") < 40, 0).otherwise(F.col("id") % 7).alias("g"))
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append(r.id)
    want = sorted((a, b) for g in groups.values() for a in g for b in g if a != b)
    for most in (50, 5_000_000):
        monkeypatch.setattr(attribution, "PAIRS", most)
        got = attribution.pairs(rows, ["g"], "id")
        assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(attribution, "PAIRS", 50)
    assert attribution.pairs(rows, ["g"], "id").rdd.getNumPartitions() > 30


def test_words_of_symbols_without_distinct_counts(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "a")], "c long, word string")
    scopes = spark.createDataFrame([(1, 9), (1, 9), (2, 9), (2, 8), (None, 9)], "c long, s long")
    got = attribution.propagated(tokens, scopes, "c", "s")
    assert sorted(map(tuple, got.collect())) == [(8, "a", 1), (8, "b", 1), (9, "a", 2), (9, "b", 1)]
    assert "BroadcastHashJoin" not in _plan(got)


def test_replayed_tables_come_in_batches_by_time(spark, monkeypatch):
    table = spark.range(4000).select(F.col("id").alias("seq"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * 7919 % 4000) * 60_000_000).alias("ts"))
    stream = trace.replayed(table, "ts", 500)
    kept = []

    def keep(batch, n):
        if r := batch.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first():
            kept.extend([r] if r.n else [])

    stream.writeStream.option("checkpointLocation", shared.path(spark, "test")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    assert len(kept) >= 6 and sum(r.n for r in kept) == 4000 and max(r.n for r in kept) < 1000
    assert all(x.b < y.a for x, y in zip(kept, kept[1:]))


def test_vectors_are_not_made_objects(spark):
    rows = pa.table({"id": pa.array([1, 2]), "e": pa.array([[3.0, 4.0], [0.0, 0.0]], pa.list_(pa.float32()))})
    ids, e = relevance._unit(rows)
    assert list(ids) == [1, 2] and np.allclose(e[0], [0.6, 0.8]) and np.isnan(e[1]).all()
    assert relevance._unit(rows.slice(1, 1))[1].shape == (1, 2)
    many = pa.table({"id": pa.array(range(20_000)), "e": pa.array(list(np.random.default_rng(1).random((20_000, 64), np.float32)), pa.list_(pa.float32()))})
    tracemalloc.start()
    relevance._unit(many)
    assert tracemalloc.get_traced_memory()[1] < 45_000_000
    tracemalloc.stop()


def test_records_parse_texts_once(spark):
    text = '<DYNAMICTRACE RUNID="r"><IO THREADID="1"><X TS="r_4"><POSIXLOCK ADDRESS="1" TYPE="M"/></X></IO><CALL TS="r_5"/></DYNAMICTRACE>'
    nodes = syntax.flatten(spark.createDataFrame([("u", bytearray(text.encode()))], "path string, content binary"))
    got = runs.records(nodes)
    assert sorted((r.seq or 0, r.run, r.rectype, r.within, r.thread, len(r.locks)) for r in got.collect()) == [(0, "r", "IO", None, "1", 0), (4, "r", "X", 1, "1", 1), (5, "r", "CALL", None, None, 0)]
    assert "MapInArrow" not in _plan(got)


def _asked(spark, sizes):
    """Classes of questions by their numbers of questions and answers: who asked, what was found, and the product."""
    asked = [(f"c{k}", k * 100_000 + i) for k, (q, _) in enumerate(sizes) for i in range(q)]
    found = [(f"c{k}", "t", f"s{i}", f"a{i % 3}") for k, (_, a) in enumerate(sizes) for i in range(a)]
    want = sorted((i, *f[1:]) for c, i in asked for f in found if f[0] == c)
    return spark.createDataFrame(found, "said string, template string, s string, answer string"), spark.createDataFrame(asked, "said string, id long"), want


def test_answers_are_dealt_out_by_their_pairs(spark, monkeypatch):
    found, asked, want = _asked(spark, [(1, 1), (40, 1), (1, 50), (23, 17), (5, 0), (0, 5)])
    for together, held, pairs in ((256, 100_000, 10_000_000), (3, 100_000, 10), (4, 6, 1000), (1, 1, 1)):
        for name, n in (("TOGETHER", together), ("HELD", held), ("PAIRS", pairs)):
            monkeypatch.setattr(dispatch, name, n)
        got = dispatch._dealt(found, asked, ["id"])
        assert sorted(map(tuple, got.collect())) == want
    two = dispatch._dealt(found, asked.withColumn("turn", F.col("id") % 7), ["id", "turn"])
    assert two.columns == ["id", "turn", "template", "s", "answer"] and sorted((r[0], *r[2:]) for r in two.collect() if r[1] == r[0] % 7) == want
    monkeypatch.setattr(dispatch, "PAIRS", 4)
    assert dispatch._dealt(found, asked, ["id"]).rdd.getNumPartitions() > 90


def test_answers_to_many_are_small_as_files(spark, tmp_path):
    # a list of keys that is longer than what a file's codec looks back over would be written out for each answer
    asked = spark.range(20_000).select(F.lit("c").alias("said"), "id")
    found = spark.range(120).select(F.lit("c").alias("said"), F.lit("t").alias("template"), F.concat(F.lit("s"), "id").alias("s"), F.lit("x").alias("answer"))
    dispatch._dealt(found, asked, ["id"]).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 2_400_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2_400_000 * 0.4


def test_symbols_are_not_broadcast_to_nations(spark, tmp_path):
    # nations with their regions were taken for more than customers, whose files are small
    import shutil

    from codeloom import answers, registry

    for t in ("region", "nation", "supplier", "documents", "events"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    spark.range(20_000).select(F.col("id").alias("c_custkey"), F.lit("c").alias("c_name"), F.lit(1).alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    k = answers._knowledge(registry.Tables(spark, str(tmp_path)))
    joins = [x for x in _plan(k.symbols.select("s", "parent")).splitlines() if "BroadcastHashJoin" in x and "_nationkey" in x]
    assert joins and not [x for x in joins if re.search(r"\[c_nationkey.*BuildLeft", x)]


def test_dictionaries_are_not_broadcast(spark, tmp_path):
    spark.range(50).select("id", F.concat(F.lit("Name#"), "id").alias("text")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    bound = binding.bind(t, t.select(F.lower("text").alias("phrase"), F.lit("symbol").alias("kind")), ["id"])
    assert "BroadcastHashJoin" not in _plan(bound) and bound.count() == 50


def test_accesses_and_comments_are_not_broadcast_to_answers(spark, monkeypatch):
    from codeloom import answers, registry

    plans = []
    deal = dispatch._dealt
    monkeypatch.setattr(dispatch, "_dealt", lambda found, *a: plans.append(_plan(found)) or deal(found, *a))
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    asked = spark.createDataFrame([(1, 1, 2, "customer#000000003", "symbol"), (1, 2, 3, "accessed", "dynamic_attribute"), (1, 3, 4, "building", "common_word")], "id long, start int, end int, phrase string, kind string")
    dispatch.answers(answers._knowledge(t), asked, ["id"])
    sides = [x for x in plans[0].split("BroadcastExchange")[1:]]
    below = [re.findall(r"Generate|Scan parquet \S* *\[[^\]]*\]", x.split("BroadcastHashJoin")[0].split("SortMergeJoin")[0])[:1] for x in sides]
    assert not [x for x in below if x and re.search("event_id|doc_id", x[0])], below
