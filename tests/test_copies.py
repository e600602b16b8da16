"""Registered queries on tables with many copies: what they leave out changes no result."""

import math
import random

import pytest
from pyspark.sql import functions as F

from concord import queries
from concord.operators import labels, resolve
from concord.operators.graph import connected_components
from concord.plans.model import DataModel
from concord.storage import keeper

ODD = [900.0, 900.0, 900.1, 950.0, 1050.0, 1300.0, 1300.0, 1500.0, math.nan, math.inf, math.inf, -math.inf, 900.000001, 900.000002, None]


def parts(spark, folder, rows):
    """A part table of (brand, type, price) with keys in random order, one null key and one repeated."""
    rng = random.Random(3)
    keys = rng.sample(range(1000), len(rows))
    rows = [(k, rng.choice(["red bolt", "old ring"]), *r, rng.randrange(3)) for k, r in zip(keys, rows, strict=True)]
    rows += [(None, "red bolt", *rows[0][2:]), rows[1]]
    df = spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double, p_size int")
    df.write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(4)
    groups = [("a", "x"), ("a", "y"), ("b", "x"), (None, "x")]
    rows = [(*g, p) for g in groups for p in ODD if not (g == ("a", "x") and p is not None and math.isnan(p)) and not (g == ("b", "x") and rng.random() < 0.4)]
    # without NaN and infinity
    rows += [("c", "x", 900 + rng.randrange(40) * 12.5) for _ in range(60)] + [("d", "x", 5.0), ("d", "x", 5.0)]
    return parts(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    rng = random.Random(5)
    return parts(spark, tmp_path_factory.mktemp("copies"), [("a", "x", 900.0 + rng.randrange(10)) for _ in range(500)])


def rows_of(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_linking_edges_connect_what_all_edges_connect(spark, odd, copies):
    keep = keeper(spark)
    for folder in (odd, copies):
        some, every = queries._linking_edges(spark, folder, 0.5), queries._edges(spark, folder).filter("score > 0.5")
        assert not some.exceptAll(every.distinct()).distinct().join(every, ["id_a", "id_b"], "left_anti").count()
        assert rows_of(connected_components(some, keep, "id_a", "id_b")) == rows_of(connected_components(every, keep, "id_a", "id_b"))
    assert queries._linking_edges(spark, copies, 0.5).count() < 4 * 502 < queries._edges(spark, copies).count()


@pytest.mark.parametrize("name", ["canonical_records", "partition_with_singletons", "connected_components"])
def test_components_take_few_edges(spark, copies, monkeypatch, name):
    monkeypatch.setattr(queries, "_edges", None)  # all pairs are not needed
    assert queries.QUERIES[name](spark, copies).count()


@pytest.mark.parametrize("n", [1, 3])
def test_best_edges_give_the_best_of_all(spark, odd, copies, n):
    for folder in (odd, copies):
        some = queries._best_edges(spark, folder, 0.3, n)
        assert rows_of(resolve.top_n(some, 0.3, n)) == rows_of(resolve.top_n(queries._edges(spark, folder), 0.3, n))
    assert some.count() < 4 * n * 502


def test_greedy_edges_hold_the_greedy_matching(spark, odd, copies):
    keep = keeper(spark)
    for folder in (odd, copies):
        some = queries._greedy_edges(spark, folder, 0.3)
        assert rows_of(resolve.one_to_one(some, keep, 0.3)) == rows_of(resolve.one_to_one(queries._edges(spark, folder).distinct(), keep, 0.3))
    assert some.count() < 2 * 502


def test_random_pairs_look_up_their_own_keys_only(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"k{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, key string")
    matches, _ = labels.training_pairs(df, "key", "id", size=200)
    every = labels.common_key_matches(df, "key", "id")
    # stands in for more matches than can be made
    monkeypatch.setattr(labels, "common_key_matches", lambda left, *_: left.select(F.col("id").alias("id_a"), F.raise_error(F.lit("all matches")).cast("bigint").alias("id_b")))
    distinct = labels.training_pairs(df, "key", "id", size=200)[1]
    drawn = {(r["id_a"], r["id_b"]) for r in distinct.collect()}
    equal = {(r["id_a"], r["id_b"]) for r in every.collect()}
    assert drawn and not drawn & equal and any(a % 7 == b % 7 == 0 for a, b in drawn)
    assert {(r["id_a"], r["id_b"]) for r in matches.collect()} <= equal


def test_clusters_of_copies_equal_those_of_all_pairs(spark, tmp_path):
    rng = random.Random(6)
    prices = [(g, 900 * rng.random()) for g in "abcdef" for _ in range(9)] + [("g", 5.0), ("h", 5.0), ("h", 700.0), ("i", 1.0), ("i", 3.0)]
    folder = parts(spark, tmp_path, [(g, "x", p) for g, p in prices for _ in range(1 if g == "i" else rng.randrange(1, 5) + (g in "gh"))])
    want = resolve.cluster(queries._edges(spark, folder), keeper(spark), 0.5).collect()
    scored = []
    edges_of = queries._edges_of
    try:
        queries._edges_of = lambda part: scored.append(part.count()) or edges_of(part)
        got = queries.QUERIES["cluster_partition"](spark, folder).collect()
    finally:
        queries._edges_of = edges_of
    assert {(r["cluster_id"], r["id"]): round(r["confidence"], 4) for r in got} == pytest.approx({(r["cluster_id"], r["id"]): r["confidence"] for r in want}, abs=1e-3)
    assert len(got) == len(want) and scored == [len(prices)]


@pytest.mark.parametrize("members", [1000, 4])
def test_distance_rows_are_computed_once_for_copies(spark, tmp_path, monkeypatch, members):
    rng = random.Random(8)
    prices = [(f"Brand#{rng.randrange(11, 14)}", "x", p) for p in [None, 5.0, 7.0, 9.0, math.nan] * 50]
    folder = parts(spark, tmp_path, prices)
    records = queries._model_records(spark, folder).distinct()
    want = queries._model().rows(queries._part_pairs(spark, folder)[1], records, records, "id")
    want = want.select("id_a", "id_b", F.transform("d", lambda x: F.round(x.cast("double"), 4)).alias("d"))
    computed = []
    rows = DataModel.rows
    monkeypatch.setattr(queries, "_MEMBERS", members)
    monkeypatch.setattr(DataModel, "rows", lambda self, pairs, *more: computed.append(pairs.count()) or rows(self, pairs, *more))
    got = queries.QUERIES["dist_row"](spark, folder)
    assert got.schema.simpleString() == want.schema.simpleString() and rows_of(got) == rows_of(want)
    assert computed[0] < len(rows_of(want))


def shuffled(spark):
    """Bytes that all stages so far wrote for others."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_distance_rows_send_copies_once(spark, tmp_path):
    rng = random.Random(10)
    rows = [(1000 * rng.randrange(10**6) + i, "red bolt", "Brand#11", "x", 900.0 + i % 20, 7) for i in range(20 * 200)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    before = shuffled(spark)
    got = queries.QUERIES["dist_row"](spark, str(tmp_path)).agg(F.count("*"), F.sum("id_a"), F.sum("id_b"), F.min(F.col("id_b") - F.col("id_a"))).first()
    ids = sorted(r[0] for r in rows)
    assert got[0] == math.comb(4000, 2) and got[1] == sum(x * (3999 - i) for i, x in enumerate(ids)) and got[2] == sum(x * i for i, x in enumerate(ids)) and got[3] > 0
    # 368 kB where records were sent four times and ids of copies for each way round
    assert shuffled(spark) - before < 300_000


def test_entities_of_many_copies(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    prices = [("Brand#11", rng.choice("xy"), p) for p in [None, 5.0, 900.0, 901.0, 2000.0] * 60]
    folder = parts(spark, tmp_path, prices)
    computed = []
    rows = DataModel.rows
    monkeypatch.setattr(DataModel, "rows", lambda self, pairs, *more: computed.append(pairs.count()) or rows(self, pairs, *more))
    got = queries.QUERIES["entity_partition"](spark, folder)
    part = spark.read.parquet(f"{folder}/part.parquet").filter("p_partkey is not null")
    keyed = part.join(got, part["p_partkey"] == got["id"]).select("id", "cluster_id", "p_name", "p_type", "p_retailprice").distinct()
    assert keyed.count() == keyed.select("id").distinct().count() == part.select("p_partkey").distinct().count()
    # copies are in one cluster, whose number is its smallest id; names share none
    repeated = part.groupBy("p_partkey").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("p_partkey").alias("id"))
    assert keyed.join(repeated, "id", "left_anti").groupBy("p_name", "p_type", "p_retailprice").agg(F.countDistinct("cluster_id").alias("n")).filter("n > 1").isEmpty()
    assert keyed.groupBy("cluster_id").agg(F.countDistinct("p_name").alias("n"), F.min("id").alias("least")).filter("n > 1 or least <> cluster_id").isEmpty()
    assert computed[0] < 2 * math.comb(12, 2)


@pytest.mark.parametrize("members", [1000, 3])
def test_many_to_many_scores_points_and_gives_all_pairs(spark, odd, copies, monkeypatch, members):
    scored = []
    many_to_many = resolve.many_to_many
    monkeypatch.setattr(queries, "_MEMBERS", members)
    for folder in (odd, copies):
        want = queries._shown(many_to_many(queries._edges(spark, folder), 0.5))
        monkeypatch.setattr(resolve, "many_to_many", lambda scores, threshold: scored.append(scores.count()) or many_to_many(scores, threshold))
        got = queries.QUERIES["match_many_to_many"](spark, folder)
        assert got.schema.simpleString() == want.schema.simpleString() and rows_of(got) == rows_of(want)
    assert members < 1000 or scored[-1] == math.comb(10 + 1, 2) < want.count()


def test_entities_block_only_parts_that_differ(spark, tmp_path, monkeypatch):
    rows = [(7 * i, name, "Brand#11", "xy"[i % 2], 900.0 + 300 * (i % 5), 1) for i, name in enumerate(["red bolt", "old ring", "", None] * 60)]
    rows += [(None, "red bolt", "Brand#11", "x", 900.0, 1), rows[5]]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    block_keys = queries.block_keys
    monkeypatch.setattr(queries, "block_keys", lambda records, *more: seen.append(records.count()) or block_keys(records, *more))
    got = {r["id"]: (r["cluster_id"], r["confidence"]) for r in queries.QUERIES["entity_partition"](spark, str(tmp_path)).collect()}
    assert seen == [len({r[1:] for r in rows})]
    assert got.keys() == {r[0] for r in rows} and got[None] == (None, 1.0)
    # a part without a name has no key, so its copies are no copies either
    assert all(got[r[0]] == (r[0], 1.0) for r in rows if not r[1])
    alike = {}
    for r in rows:
        if r[0] is not None and r[1]:
            alike.setdefault(r[1:], set()).add(got[r[0]])
    assert all(len(x) == 1 for x in alike.values())
