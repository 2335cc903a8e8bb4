"""Splits, metrics, fusion, features, graphs and neighbours on small tables with known answers."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.config import Columns, Execution, model_settings, resolve_models
from tidewise.functions.expressions import dot, lorentz_exp, lorentz_log, sigmoid, unit
from tidewise.hpo import ParzenSearch
from tidewise.operators import features, fusion, graph, history, itemcf, metrics, splits, validate
from tidewise.operators.nearest import top_by_dot

DAY = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(u, i, DAY + timedelta(hours=h)) for u, i, h in rows], "user string, item string, ts timestamp")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_leave_last_out_needs_two_rows_and_breaks_ties_by_key(spark):
    df = events(spark, [("a", "x", 1), ("a", "y", 2), ("a", "z", 2), ("b", "x", 1)])
    train, test = splits.split(df, "temporal", user="user", timestamp="ts", keys=["item"])
    assert pairs(test, "user", "item") == [("a", "z")] and train.count() == 3


def test_three_way_gives_no_validation_row_to_users_with_two(spark):
    df = events(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("b", "z", 3)])
    train, validation, test = splits.three_way(df, "temporal", user="user", timestamp="ts", keys=["item"])
    assert pairs(validation, "user", "item") == [("b", "y")] and pairs(test, "user", "item") == [("a", "y"), ("b", "z")]


def test_global_cut_keeps_ties_together(spark):
    df = events(spark, [("u", str(k), 0) for k in range(8)] + [("v", str(k), 24) for k in range(2)])
    train, test = splits.split(df, "global_temporal", user="user", timestamp="ts", keys=["item"])
    assert (train.count(), test.count()) == (8, 2)
    hourly = events(spark, [("u", str(k), k) for k in range(20)])
    assert splits.split(hourly, "global_temporal", user="user", timestamp="ts", keys=["item"])[1].count() == 4
    with pytest.raises(ValueError):
        splits.global_cut(events(spark, [("u", "a", 1), ("u", "b", 1)]), "ts")


def test_cold_start_holds_whole_users(spark):
    df = events(spark, [(f"u{k}", str(j), j) for k in range(10) for j in range(3)])
    train, test = splits.split(df, "cold_start", user="user", timestamp="ts", keys=["item"])
    assert test.select("user").distinct().count() == 2 and test.count() == 6
    assert splits.overlap(train, test, ["user"]).isEmpty()
    assert splits.cold_users(df.where("user = 'u1'"), "user").count() == 0


def test_random_split_is_stable(spark):
    df = events(spark, [(f"u{k}", str(j), j) for k in range(5) for j in range(4)])
    a, b = (pairs(splits.split(x, "random", user="user", timestamp="ts", keys=["item"])[1], "user", "item") for x in (df, df.repartition(3)))
    assert a == b and len(a) == 5


def test_metrics_golden(spark):
    recs = spark.createDataFrame([("u", "a", 1, "M"), ("u", "c", 2, "M"), ("u", "d", 3, "M")], "user string, item string, rank int, model string")
    truth = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b")], "user string, item string")
    row = metrics.user_metrics(recs, truth, 10).first()
    assert row["recall"] == 0.5 and math.isclose(row["precision"], 1 / 3) and row["hit_rate"] == 1 and row["mrr"] == 1 and row["map"] == 0.5 and row["auc"] == 1
    assert math.isclose(row["ndcg"], 1 / (1 + 1 / math.log2(3)))
    two = truth.unionByName(spark.createDataFrame([("v", "a")], "user string, item string"))
    board = metrics.evaluate(recs, two, ["Recall@2", "hit@1"], 4).first()
    assert board["recall@2"] == 0.25 and board["hit_rate@1"] == 0.5 and board["coverage"] == 0.75
    with pytest.raises(ValueError):
        metrics.metric("ndcg")


def test_auc_counts_misses_above(spark):
    recs = spark.createDataFrame([("u", x, k, "M") for k, x in enumerate("qaxb", 1)], "user string, item string, rank int, model string")
    truth = spark.createDataFrame([("u", "a"), ("u", "b")], "user string, item string")
    assert math.isclose(metrics.user_metrics(recs, truth, 4).first()["auc"], (2 * 2 - 3) / 4)


def test_fusion(spark):
    recs = spark.createDataFrame([("u", "a", 1, "A"), ("u", "b", 2, "A"), ("u", "b", 1, "B")], "user string, item string, rank int, model string")
    got = {r["item"]: (r["rank"], r["score"]) for r in fusion.reciprocal_rank_fusion(recs, 5, {"B": 0.5}).collect()}
    assert got["b"][0] == 1 and math.isclose(got["b"][1], 1 / 62 + 0.5 / 61) and math.isclose(got["a"][1], 1 / 61)
    truth = spark.createDataFrame([("u", "b")], "user string, item string")
    w = fusion.fit_weights(recs, truth, ["A", "B"])
    assert math.isclose(sum(w.values()), 1) and w["B"] > w["A"]
    assert fusion.fit_weights(recs, truth.limit(0), ["A", "B"]) == {"A": 1.0, "B": 1.0}


@pytest.mark.parametrize("patterns", [None, 3])
def test_fusion_weights_learn_from_all_users(spark, monkeypatch, patterns):
    """6,000 users, more than the former sample held; with few patterns allowed the tasks fit them."""
    if patterns:
        monkeypatch.setattr(fusion, "PATTERNS", patterns)
    users = spark.range(6000).select(F.col("id").cast("string").alias("user"), (F.pmod(F.xxhash64(F.lit(42), F.col("id").cast("string")), F.lit(4)) + 1).cast("int").alias("r"))
    recs = users.select("user", F.lit("a").alias("item"), F.lit(1).alias("rank"), F.lit("A").alias("model")).unionByName(users.select("user", F.lit("b").alias("item"), "r", F.lit("B").alias("model")).withColumnRenamed("r", "rank"))
    truth = users.where("r > 1").select("user", F.lit("a").alias("item")).unionByName(users.where("r < 4").select("user", F.lit("b").alias("item")))
    found = fusion.fit_weights(recs, truth, ["A", "B"])
    rows = fusion.stacking_features(recs, truth, ["A", "B"]).toPandas()
    assert len(rows) == 12000
    w = np.maximum(fusion.logistic_weights(rows[["A", "B"]].to_numpy(), rows["label"].to_numpy())[:2], 0)
    want = w / w.sum()
    assert min(want) > 0.01
    assert [found["A"], found["B"]] == pytest.approx(list(want), abs=1e-9)


def test_popular_unseen_is_what_a_cross_join_gives(spark):
    rng = random.Random(1)
    df = events(spark, [(f"u{rng.randrange(12)}", f"i{rng.randrange(15)}", k) for k in range(150)])
    counts, seen = history.popularity(df), history.seen_pairs(df)
    got = pairs(history.popular_unseen(df, counts, seen, 3), "user", "rank", "item")
    every = df.select("user").distinct().crossJoin(counts).join(seen, ["user", "item"], "left_anti")
    assert got == pairs(history.top_k(every, 3), "user", "rank", "item")


def test_itemcf(spark):
    df = events(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("b", "z", 3), ("b", "x", 9)])
    h = itemcf.capped_history(df)
    near = itemcf.neighbours(h)
    sims = {(r["i"], r["j"]): r["sim"] for r in near.collect()}
    assert math.isclose(sims["x", "y"], 1.0) and math.isclose(sims["x", "z"], 1 / math.sqrt(2)) and sims["x", "z"] == sims["z", "x"]
    recs = {(r["user"], r["item"]): r for r in itemcf.recommend(df, history.seen_pairs(df), near, itemcf.history_popularity(h), 2).collect()}
    assert math.isclose(recs["a", "z"]["score"], 2 / math.sqrt(2)) and ("b", "z") not in recs
    assert pairs(itemcf.capped_history(df, 1), "user", "item") == [("a", "y"), ("b", "z")]


def test_validation(spark):
    c = Columns("user", "item", "ts", "label")
    df = events(spark, [("a", "x", 1), ("b", "y", 2)])
    assert validate.interactions(df.withColumn("label", F.lit("1")), c).count() == 2
    for bad in (df.withColumn("label", F.lit("many")), df.withColumn("label", F.lit(0)), df.limit(0).withColumn("label", F.lit(1)), df.withColumn("item", F.lit(None).cast("string")).withColumn("label", F.lit(1)), df):
        with pytest.raises(ValueError):
            validate.interactions(bad, c)
    with pytest.raises(ValueError):
        validate.entities(df.unionByName(df), "user", "users")
    with pytest.raises(ValueError):
        validate.modalities({"item": {"smell": "x"}}, None, df)
    assert pairs(validate.first_seen_index(df, "item", "ts"), "item", "item_idx") == [("x", 0), ("y", 1)]


def test_features(spark):
    items = spark.createDataFrame([(1, "r", 1.0, "A b b", [3.0, 4.0]), (2, None, None, None, None), (3, "q", 3.0, "B", [0.0, 0.0])], "id long, cat string, num double, txt string, vec array<double>")
    vec = lambda df: {r["id"]: r["vec"] for r in df.collect()}
    assert vec(features.categorical(items, "id", ["cat"])) == {1: [0, 0, 1], 2: [1, 0, 0], 3: [0, 1, 0]}
    assert vec(features.numerical(items, "id", ["num"])) == {1: [-1], 2: [0], 3: [1]}
    e = vec(features.embedding(items, "id", "vec"))
    assert np.allclose(e[1], [0.6, 0.8]) and e[2] == [0, 0]
    t = vec(features.text(items, "id", ["txt"]))
    assert len(t[1]) == 128 and math.isclose(sum(x * x for x in t[1]), 1) and sum(t[2]) == 0
    with pytest.raises(ValueError):
        features.embedding(items.where("id = 2"), "id", "vec")
    fused = features.early_fusion(features.blocks(items, "id", {"categorical": ["cat"], "numerical": ["num"]}))
    assert np.allclose(vec(fused)[1], np.array([0, 0, 1, -1]) / math.sqrt(2))
    seen = spark.createDataFrame([("u", 1), ("u", 3)], "user string, item long")
    assert np.allclose(features.profiles(seen, features.embedding(items, "id", "vec")).first()["vec"], [0.6, 0.8])


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 6)).round(1)
    q = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(x[:20])], "user string, vec array<double>")
    i = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "item long, vec array<double>")
    spare = spark.createDataFrame([(f"q{k}", j) for k in range(20) for j in range(k)], "user string, item long")
    got = {(r["user"], r["rank"]): (r["item"], r["score"]) for r in top_by_dot(q, i, 5, spare=spare, block=16).collect()}
    for k in range(20):
        order = sorted(range(k, 90), key=lambda j: (-round(float(x[k] @ x[j]), 6), str(j)))[:5]
        assert [got[f"q{k}", n + 1][0] for n in range(5)] == order


def test_graph(spark):
    edges = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 20)], "user long, item long")
    w = sorted(round(r["w"], 6) for r in graph.symmetric_weights(edges).collect())
    assert w == sorted(round(x, 6) for x in (1 / math.sqrt(6), 1 / math.sqrt(6), 1 / math.sqrt(6), 1 / math.sqrt(2)))
    start = spark.createDataFrame([("u1", 0, 1.0), ("i10", 0, 2.0)], "node string, pos int, x double")
    hop = {r["node"]: r["x"] for r in graph.propagate(graph.bipartite(graph.symmetric_weights(edges)), start).collect()}
    assert math.isclose(hop["u1"], 4 / math.sqrt(6)) and math.isclose(hop["i10"], 2 / math.sqrt(6))
    lr = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, 8), (2, 8)], "left long, right long")
    top = {(r["src"], r["dst"]): r["w"] for r in graph.co_occurrence_top(lr, 2).collect()}
    assert math.isclose(top[1, 2], 1 / 9 + 1 / 4) and math.isclose(top[1, 3], 1 / 9) and (1, 1) not in top
    assert pairs(graph.budgeted_right_nodes(lr, 500, 2), "right") == [(8,)]
    assert pairs(graph.budgeted_right_nodes(lr, 500, 1), "right") == [(8,)]
    values = spark.createDataFrame([(k,) for k in (1, 1, 2, 9)], "d long")
    assert graph.nearest_rank(values, "d", 0.5) == 2 and graph.nearest_rank(values.limit(0), "d", 0.5) is None


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(unit(F.col("a")).alias("u"), unit(F.col("z")).alias("z"), dot(F.col("a"), F.col("a")).alias("d"), sigmoid(F.lit(-1e9)).alias("s"), lorentz_log(lorentz_exp(F.col("a"))).alias("l")).first()
    assert np.allclose(r["u"], [0.6, 0.8]) and r["z"] == [0, 0] and r["d"] == 25 and r["s"] > 0 and np.allclose(r["l"], [3, 4], atol=1e-6)


def test_configuration():
    assert resolve_models("auto", "fast_training") == ["Popularity", "ItemCF"] and resolve_models(["A", "A"], "x") == ["A"]
    assert model_settings("fast_training", {"BPRMF": {"epochs": 9}})["BPRMF"] == {"epochs": 9}  # a cap on pairs is set by the caller alone
    assert model_settings("fast_training", {"BPRMF": {"max_training_pairs": 5}})["BPRMF"] == {"epochs": 2, "max_training_pairs": 5}
    for bad in (lambda: resolve_models([], "x"), lambda: resolve_models(None, "x"), lambda: Execution(history_partitions=0)):
        with pytest.raises(ValueError):
            bad()


def test_parzen_search_visits_all_and_prefers_the_good():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    search, tried = ParzenSearch(space, 1), []
    for _ in range(6):
        s = search.suggest()
        tried.append(tuple(s.values()))
        search.observe(s, -abs(s["a"] - 2))
    assert len(set(tried)) == 6
    assert np.mean([search.suggest()["a"] == 2 for _ in range(50)]) > 0.5
    with pytest.raises(ValueError):
        ParzenSearch({"a": []})


def test_scores_that_are_no_numbers_are_dropped(spark):
    from tidewise.operators import history

    rows = [("u", "a", float("nan")), ("u", "b", 1.0), ("u", "c", float("-inf")), ("u", "d", 2.0)]
    found = history.top_k(spark.createDataFrame(rows, "user string, item string, score double"), 3)
    assert [(r["item"], r["rank"]) for r in found.orderBy("rank").collect()] == [("d", 1), ("b", 2)]


def test_mean_and_deviation_over_seeds(spark):
    from tidewise.operators.metrics import over_seeds

    runs = spark.createDataFrame([("A", 1, 0.2), ("A", 2, 0.4), ("B", 1, 0.5)], "model string, seed int, recall double")
    found = {r["model"]: (r["seeds"], r["recall_mean"], r["recall_deviation"]) for r in over_seeds(runs, ["recall"]).collect()}
    assert found["A"] == pytest.approx((2, 0.3, 0.1)) and found["B"] == (1, 0.5, 0.0)


def test_stacking_weights_by_plain_descent(spark):
    """The weights of the query's own rows, by a loop over single rows."""
    import math

    from tidewise.operators import fusion
    from tidewise.plans.model_queries import both_recs

    recs, truth = both_recs(spark, "/root/testdata/sf0.001")
    names = ["Popularity", "ItemCF"]
    found = fusion.fit_weights(recs, truth, names)
    rows = [(r["Popularity"], r["ItemCF"], 1.0, r["label"]) for r in fusion.stacking_features(recs, truth, names).collect()]
    w = [0.0, 0.0, 0.0]
    for _ in range(200):
        g = [1e-3 * x for x in w]
        for *x, y in rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w))))
            g = [a + (p - y) * b / len(rows) for a, b in zip(g, x)]
        w = [a - 0.1 * b for a, b in zip(w, g)]
    positive = [max(x, 0) for x in w[:2]]
    want = [x / sum(positive) for x in positive] if sum(positive) else [0.5, 0.5]
    assert [found[n] for n in names] == pytest.approx(want, abs=1e-9)


def test_popular_unseen_for_long_histories_and_short_ones(spark, monkeypatch):
    from tidewise.operators import history

    monkeypatch.setattr(history, "HEAD", 4)
    counts = spark.createDataFrame([(f"i{k}", 10 - k // 2, (10 - k // 2) / 10) for k in range(12)], "item string, n long, score double")
    seen = {"none": [], "one": ["i0"], "many": [f"i{k}" for k in range(1, 9)], "all": [f"i{k}" for k in range(12)]}
    pairs = spark.createDataFrame([(u, i) for u, own in seen.items() for i in own], "user string, item string")
    users = spark.createDataFrame([(u,) for u in seen], "user string")
    got = {}
    for r in history.popular_unseen(users, counts, pairs, 3).orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append(r["item"])
    order = sorted((f"i{k}" for k in range(12)), key=lambda i: (-(10 - int(i[1:]) // 2), i))
    assert got == {u: [i for i in order if i not in own][:3] for u, own in seen.items() if len(own) < 12}


def test_places_of_one_hot_columns(spark):
    from tidewise.operators import features

    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id long, c string")
    assert {r["id"]: r["place"] for r in features.one_hot_places(df, "id", "c").collect()} == {2: 0, 3: 1, 1: 2, 4: 2}
    assert features.categorical(df.limit(0), "id", ["c"]).count() == 0


def _pairs_by_hand(rows, most):
    from collections import Counter
    from itertools import permutations

    of_user, sims = {}, {}
    for u, i in set(rows):
        of_user.setdefault(u, set()).add(i)
    users = Counter(i for s in of_user.values() for i in s)
    met = Counter(p for s in of_user.values() for p in permutations(s, 2))
    for (i, j), n in met.items():
        sims.setdefault(i, []).append((-round(n / (users[i] * users[j]) ** 0.5, 6), str(j)))
    return met, {(str(i), j, -s, r) for i, found in sims.items() for r, (s, j) in enumerate(sorted(found)[:most], 1)}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_neighbours_send_a_row_for_each_item_of_a_user_not_for_each_pair(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 500), rng.choice([-12, -1, 0, 2, 10, 100, 20, 3, 2**40, 9, 11], 500) + 1000 * (rng.integers(0, 40, 500) % 7))]
    df = spark.createDataFrame([(u, i, 0) for u, i in rows], "user long, item long, ts long").withColumn("item", F.col("item").cast(kind))
    h = itemcf.capped_history(df)
    met, expected = _pairs_by_hand(rows, 5)
    near = itemcf.neighbours(h, 5, 6)
    if kind == "bigint":
        assert near._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the items' counts; users' items don't meet in a join
    assert {(str(r["i"]), str(r["j"]), r["sim"], r["rank"]) for r in near.collect()} == expected
    found = {(str(r["i"]), str(r["j"])): r["n"] for r in itemcf.co_occurrence(h).collect()}
    assert {frozenset(p): n for p, n in found.items()} == {frozenset(map(str, p)): n for p, n in met.items()} and len(found) * 2 == len(met)
    sums = {}
    for u, i in set(rows):
        for a, b, s, _ in expected:
            if a == str(i):
                sums[u, b] = sums.get((u, b), 0) + s
    scores = {(r["user"], str(r["item"])): r["score"] for r in itemcf.candidate_scores(history.seen_pairs(df), near, 6).collect()}
    assert scores.keys() == sums.keys() and all(abs(scores[p] - sums[p]) < 2e-6 for p in sums)


def test_lists_keep_any_keys_and_groups_over_several_batches_add_up(spark):
    from tidewise.operators.baskets import packed_lists, unpacked_lists

    rng = np.random.default_rng(0)
    lists = [np.sort(rng.integers(-(2**62), 2**62, n)) >> s for n, s in ((1, 0), (5, 40), (200, 60), (3, 0))] + [np.array([-(2**63), 2**63 - 1])]
    values = [rng.integers(0, 2**b, len(x)).astype(np.uint64) for x, b in zip(lists, (3, 60, 12, 1, 40))]
    packed = packed_lists(np.array([len(x) for x in lists]), np.concatenate(lists), np.concatenate(values))
    row, key, value = unpacked_lists(packed.slice(1, 3))
    assert row.tolist() == np.repeat([0, 1, 2], [5, 200, 3]).tolist() and (key == np.concatenate(lists[1:4])).all() and (value == np.concatenate(values[1:4])).all()
    assert (unpacked_lists(packed)[1] == np.concatenate(lists)).all()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        h = spark.createDataFrame([(u, i, 0) for u in range(60) for i in (1, 2 + u % 2)], "user long, item long, first_ts long")
        assert pairs(itemcf.co_occurrence(h), "i", "j", "n") == [(1, 2, 30), (1, 3, 30)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_searches_send_no_pairs_and_build_their_graphs_once(spark):
    import re

    from tidewise.models import ann

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    v = spark.createDataFrame([(i, (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(x)], "user long, vec array<double>").repartition(3)
    items = v.withColumnRenamed("user", "item")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"RepartitionByExpression[^\n]*\n[^\n]*Join", plan(top_by_dot(v, items, 3, block=100)))
    exact = {(r["user"], r["item"]) for r in top_by_dot(v, items, 3, block=100).collect()}
    for found in (ann.ivf(v, items, 3), ann.lsh(v, items, 3)):
        assert not re.search(r"Join Inner, \(", plan(found))  # no pair is a row
        assert len(exact & {(r["user"], r["item"]) for r in found.collect()}) >= 0.9 * len(exact)
    assert "FlatMapGroupsInArrow" not in plan(ann.graph_search(v, items, 3, part_rows=100))
    assert len(exact & {(r["user"], r["item"]) for r in ann.ivfpq(v, items, 3, bits=4).collect()}) >= 0.9 * len(exact)


def test_splits_sort_a_users_rows_once(spark):
    df = events(spark, [("a", "x", 1), ("a", "y", 2), ("b", "x", 1)])
    for marked in (splits.leave_last_out(df, "user", ["ts", "item"]), splits.leave_random_out(df, "user", ["ts", "item"])):
        plan = marked._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1 and "unboundedfollowing" not in plan
        assert pairs(marked.where("held"), "user") == [("a",)]
    parts = splits.three_way(df.unionByName(events(spark, [("a", "z", 3)])), "temporal", user="user", timestamp="ts", keys=["item"])
    assert [pairs(p, "user", "item") for p in parts] == [[("a", "x"), ("b", "x")], [("a", "y")], [("a", "z")]]


def test_profiles_send_a_row_for_each_item_of_a_user(spark):
    rng = np.random.default_rng(2)
    x, seen = rng.normal(size=(9, 5)), sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, 30, 200), rng.integers(0, 12, 200))})
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        made = features.profiles(spark.createDataFrame(seen, "user long, item long"), vectors)
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for each position
        found = {r["user"]: np.array(r["vec"]) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    means = {u: x[[i for v, i in seen if v == u and i < 9]].mean(0) for u in {u for u, i in seen if i < 9}}
    assert found.keys() == means.keys() and all(np.allclose(found[u], m / np.linalg.norm(m)) for u, m in means.items())


def test_sparse_places_equal_the_dense_vectors_without_them(spark):
    rows = spark.createDataFrame([(1, "a", None, 2.0), (2, "b", "x", 4.0), (3, None, "y", None), (4, "b", "y", 9.0)], "k long, c string, e string, n double")
    dense = lambda v: {(r["id"], p, round(x, 9)) for r in v.collect() for p, x in enumerate(r["vec"]) if x}
    sparse = lambda v: {(r["id"], r["pos"], round(r["value"], 9)) for r in v.collect()}
    assert sparse(features.sparse_categorical(rows, "k", ["c", "e"])) == dense(features.categorical(rows, "k", ["c", "e"]))
    parts = features.blocks(rows, "k", {"categorical": ["c", "e"], "numerical": ["n"]})
    assert sparse(features.sparse_early_fusion(rows, "k", ["c", "e"], ["n"])) == dense(features.early_fusion(parts))


def test_recommendations_read_the_split_of_interactions_once(spark):
    """Lists and held-out rows come from one table of training pairs, whose counts are those of the plain split."""
    from tidewise.plans.interaction_queries import training, training_pairs
    from tidewise.plans.model_queries import both_recs

    at = "/root/testdata/sf0.001"
    recs, test = both_recs(spark, at)
    assert not any("lineitem" in f or "orders" in f for f in recs.inputFiles() + test.inputFiles())
    for plain, pairs in zip(training(spark, at), training_pairs(spark, at)):
        want = plain.groupBy("user", "item").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
        assert sorted(map(tuple, pairs.select("user", "item", "ts", "n").collect())) == sorted(map(tuple, want.collect()))


def test_profile_counts_pairs_with_nulls_and_lists_only_pairs(spark):
    from tidewise.operators import validate

    rows = spark.createDataFrame([(1, 7, 5), (1, 7, 3), (1, None, 9), (None, 7, 4), (2, 7, 6)], "u long, i long, t long")
    found = validate.profile(rows, "u", "i", "t")
    assert found.columns == ["n_rows", "n_users", "n_items", "n_pairs", "first_ts", "last_ts"]
    assert tuple(found.first()) == (5, 2, 1, 4, 3, 9)
    assert tuple(validate.profile(rows.limit(0), "u", "i", "t").first()) == (0, 0, 0, 0, None, None)


def test_hubs_leave_by_degrees_of_all_edges_that_are_read_from_kept_tables(spark, tmp_path):
    from tidewise.operators import graph

    edges = [(u, i) for u in range(20) for i in range(20) if i == 0 or u == 0 or (u + i) % 7 == 0] + [(3, 4), (3, 4)]
    du, di = ({n: sum(e[side] == n for e in edges) for n in {e[side] for e in edges}} for side in (0, 1))
    cut_u, cut_i = (sorted(d.values())[round(0.9 * (len(d) - 1))] for d in (du, di))
    made = []

    def keep(df):
        made.append(f"{tmp_path}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    left = graph.without_hubs(spark.createDataFrame(edges, "user int, item int"), 0.9, keep)
    assert sorted(map(tuple, left.collect())) == sorted(e for e in edges if du[e[0]] <= cut_u and di[e[1]] <= cut_i)
    assert len(made) == 3


def test_edge_weights_read_a_graph_of_neighbours_that_was_searched_once(spark):
    from tidewise.plans.content_queries import src_degree_edge_weight

    assert not any("embeddings" in f for f in src_degree_edge_weight(spark, "/root/testdata/sf0.001").inputFiles())


def test_mean_of_sides_is_the_mean_of_layers_over_weighted_edges(spark):
    from tidewise.operators import graph

    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(6), rng.randrange(5)) for _ in range(25)], "user int, item int")
    pairs = edges.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n"))
    users, items = (edges.select(side).distinct().select(side, (F.col(side) * 0.3 + 1).alias("x0"), F.sin(side).alias("x1")) for side in ("user", "item"))
    listed = lambda u, i: u.select(F.concat(F.lit("u"), "user").alias("node"), F.posexplode(F.array("x0", "x1")).alias("pos", "x")).unionByName(i.select(F.concat(F.lit("i"), "item").alias("node"), F.posexplode(F.array("x0", "x1")).alias("pos", "x")))
    of = lambda rows: {(r["node"], r["pos"]): r["x"] for r in rows.collect()}
    want = of(graph.layer_mean(graph.bipartite(graph.symmetric_weights(edges)), listed(users, items), 2))
    assert of(listed(*graph.mean_of_sides(pairs, users, items, 2))) == pytest.approx(want, abs=1e-12)


def test_propagation_query_reads_the_interactions_once(spark):
    from tidewise.plans.content_queries import lightgcn_two_layer_mean

    assert not any("lineitem" in f for f in lightgcn_two_layer_mean(spark, "/root/testdata/sf0.001").inputFiles())


def test_nearest_leaves_out_cells_and_what_is_seen_inside_a_task(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 700).round(2)  # many equal vectors, so many ties
    x = np.stack([np.cos(angle), np.sin(angle)], 1)
    for name in (lambda j: j * 7, lambda j: f"é{j}"):
        ids = [name(j) for j in range(len(x))]
        kind = "long" if isinstance(ids[0], int) else "string"
        q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:25])], "user long, vec array<double>")
        i = spark.createDataFrame([(n, v.tolist()) for n, v in zip(ids, x)], f"item {kind}, vec array<double>")
        near = np.argsort(-(x[:25] @ x.T), axis=1, kind="stable")[:, :30]
        seen = {(k, int(j)) for k in range(25) for j in near[k] if (k + j) % 3 == 0}
        spare = spark.createDataFrame([(k, ids[j]) for k, j in seen], f"user long, item {kind}")
        for block in (None, 300):
            found = top_by_dot(q, i, 5, spare=spare, block=block)
            assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()  # lists as long as histories were shuffled for it
            got = {(r["user"], r["rank"]): r["item"] for r in found.collect()}
            for k in range(25):
                order = sorted((j for j in range(len(x)) if (k, j) not in seen), key=lambda j: (-round(float(x[k] @ x[j]), 6), str(ids[j]).encode()))[:5]
                assert [got[k, n + 1] for n in range(5)] == [ids[j] for j in order]


#: Queries over the split of interactions, which is made once for each.
ONE_SPLIT = [
    "late_fusion_topk",
    "metric_coverage",
    "metric_hit_rate",
    "metric_map",
    "metric_mrr",
    "metric_ndcg",
    "metric_precision",
    "metric_recall",
    "predict_fused_candidate_set",
    "rrf_fusion_uniform",
    "rrf_fusion_weighted",
]


@pytest.mark.parametrize("name", ONE_SPLIT)
def test_query_reads_interactions_once(spark, name):
    from tidewise.plans import catalogue

    files = catalogue.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("lineitem" in f or "orders" in f for f in files)


def _shuffle_bytes(spark):
    """Bytes of shuffle files on disk, after Spark has had the time to remove those that it was told to."""
    import time

    disk, last = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), None
    for _ in range(20):
        files = disk.getAllFiles()
        now = sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))
        if now == last:
            break
        last = now
        time.sleep(0.5)
    return now


#: Queries whose shared step takes its shuffle files from the disk.
LEFT_CLEAN = [
    "metric_coverage",
    "metric_hit_rate",
    "metric_map",
    "metric_mrr",
    "metric_ndcg",
    "metric_precision",
    "metric_recall",
    "predict_fused_candidate_set",
    "rrf_fusion_uniform",
    "rrf_fusion_weighted",
]


@pytest.mark.parametrize("name", LEFT_CLEAN)
def test_query_leaves_no_shuffle_files_of_its_shared_step(spark, name):
    from tidewise.plans import catalogue

    before = _shuffle_bytes(spark)
    catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert _shuffle_bytes(spark) - before < 20_000  # those of counting rows


@pytest.mark.parametrize("name", ["metric_coverage", "predict_fused_candidate_set"])
def test_query_in_parts_gives_the_rows_of_one_part(spark, name, monkeypatch):
    from tidewise.operators import baskets
    from tidewise.plans import catalogue
    from tidewise.sources.shared import Folder

    at, query, saves, save = "/root/testdata/sf0.001", catalogue.queries()[name], [], Folder.save
    monkeypatch.setattr(Folder, "save", lambda self, df, n: saves.append(n) or save(self, df, n))
    plain, whole = sorted(map(tuple, query(spark, at).collect())), len(saves)
    monkeypatch.setattr(baskets, "PART_BYTES", 250_000)
    assert sorted(map(tuple, query(spark, at).collect())) == plain and len(saves) > 2 * whole + 2


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_lists_in_parts_give_the_rows_of_lists_at_once(spark, tmp_path, monkeypatch, kind):
    from tidewise.operators import baskets

    monkeypatch.setattr(baskets, "PART_BYTES", 4000)
    made = []

    def keep(df):
        made.append(f"{tmp_path}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.parquet(made[-1])

    rng = random.Random(11)
    df = spark.createDataFrame([(rng.randrange(30), rng.randrange(40), k) for k in range(300)], "user long, item long, ts long").withColumn("item", F.col("item").cast(kind))
    h, seen = itemcf.capped_history(df), history.seen_pairs(df)
    near, popular = itemcf.neighbours(h, 5, 6), itemcf.history_popularity(h)
    near_in_parts = itemcf.neighbours(h, 5, 6, keep)
    assert len(made) > 4 and sorted(map(tuple, near_in_parts.collect())) == sorted(map(tuple, near.collect()))
    ten = lambda users, near, **more: sorted(map(tuple, itemcf.recommend(users, seen, near, popular, 3, 6, **more).collect()))
    some = df.where("user % 3 = 0")
    assert ten(seen, keep(near), keep=keep) == ten(seen, near) and ten(some, keep(near), keep=keep) == ten(some, near)
    wanted = seen.where("user % 2 = 0")
    scores = lambda *more: [(u, i, round(s, 9)) for u, i, s in sorted(map(tuple, itemcf.score_pairs(wanted, seen, near, popular, *more).collect()))]
    assert scores(keep) == scores()


#: Queries whose shared step is read as whole tables and broadcasts no table that grows.
LIGHT_DRIVER = ["leaderboard_join", "itemcf_recommend_backfill", "metric_auc", *[n for n in LEFT_CLEAN if n != "predict_fused_candidate_set"]]


@pytest.mark.parametrize("name", LIGHT_DRIVER)
def test_plan_neither_grows_with_parts_nor_broadcasts_users(spark, name, monkeypatch):
    import re

    from tidewise.operators import baskets
    from tidewise.plans import catalogue
    from tidewise.sources.shared import Folder

    plans, save = [], Folder.save
    monkeypatch.setattr(Folder, "save", lambda self, df, n: plans.append(df) or save(self, df, n))
    monkeypatch.setattr(baskets, "PART_BYTES", 150_000)
    found = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    whole = [df._jdf.queryExecution().optimizedPlan().toString() for df in [*plans, found]]
    assert len(plans) > 8 and max(len(re.findall("Relation ", p)) for p in whole) <= 16  # each of the parts was a scan
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[user", text)


def test_neighbours_of_equal_vectors_are_those_of_all_pairs(spark, monkeypatch):
    """Zeros, one-hot vectors and a few others: the lists are top_by_dot's, but a search meets no more than k + 1 of each."""
    from tidewise.operators import nearest

    rng, rows = np.random.default_rng(5), []
    for node in rng.permutation(300):
        vec = [np.zeros(4), np.eye(4)[rng.integers(4)], (x := rng.normal(size=4)) / np.linalg.norm(x)][rng.integers(3)]
        rows.append((int(node), vec.tolist()))
    v = spark.createDataFrame(rows, "node long, vec array<double>")
    want = top_by_dot(v.withColumnRenamed("node", "user"), v.withColumnRenamed("node", "item"), 5, exclude_self=True)
    met, search = [], nearest.top_by_dot
    monkeypatch.setattr(nearest, "top_by_dot", lambda q, i, k, **more: met.append((q.count(), i.count())) or search(q, i, k, **more))
    got = nearest.neighbours_of_copies(v, 5)
    columns = ("user", "item", "score", "rank")
    assert pairs(got, *columns) == pairs(want, *columns)
    different = len({tuple(vec) for _, vec in rows})
    assert met == [(different, different - 5 + 5 * 6)]
