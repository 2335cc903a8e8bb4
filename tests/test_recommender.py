"""The front, sources, saved generations, trained models, streams and the driver contract."""

import json
import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewise.automl import AutoRecommender, SavedRecommender
from tidewise.models.factors import FactorModel, negatives
from tidewise.models.graph_models import FREEDOM, LightGCN
from tidewise.operators import history
from tidewise.sources import history_index, tables
from tidewise.streaming import incremental


@pytest.fixture(scope="module")
def clustered(spark):
    """Users who mostly take items of one of three groups."""
    rng = random.Random(6)
    rows = []
    for u in range(36):
        own = [i for i in range(30) if i % 3 == u % 3]
        for n, i in enumerate(rng.sample(own, 7) + rng.sample(range(30), 1)):
            rows.append((f"u{u}", f"i{i}", datetime(2024, 1, 1) + timedelta(hours=n)))
    return pd.DataFrame(rows, columns=["user_id", "item_id", "timestamp"])


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(1)
    return pd.DataFrame({"item_id": [f"i{k}" for k in range(31)], "category": [f"c{k % 3}" for k in range(31)], "price": [float(k) for k in range(31)], "emb": [(np.eye(3)[k % 3] + rng.normal(0, 0.05, 3)).tolist() for k in range(31)]})


@pytest.fixture(scope="module")
def fitted(spark, clustered, items):
    r = AutoRecommender(spark, eval_metrics=["recall@5", "ndcg@5"])
    models = ["Popularity", "ItemCF", "BPRMF", "MultiModalItemKNN", "MultiModalLateFusionKNN", "VBPR"]
    return r.fit(clustered, items=items, modalities={"item": {"categorical": "category", "embedding": ["emb"]}}, models=models, model_configs={"BPRMF": {"epochs": 3, "factors": 8}, "VBPR": {"epochs": 2, "id_factors": 8}}, refit_full="all")


def test_leaderboard(fitted):
    board = fitted.leaderboard()
    assert {"Popularity", "ItemCF", "BPRMF", "RankFusion"} <= set(board["model"]) and board["is_best"].sum() == 1
    assert (board.loc[board["model"] != "RankFusion", "status"] == "ok").all(), fitted.stats
    best = board[board["is_best"]].iloc[0]
    assert best["score_val"] == board["score_val"].max()
    ran = board[board["model"] != "RankFusion"]
    assert (ran["training_scope"] == "full").all() and (ran["num_params"] > 0).all() and (ran["size_bytes"] == 8 * ran["num_params"]).all() and not ran["early_stopped"].any()


def test_recommendations_are_unseen_and_ranked(fitted, clustered):
    recs = fitted.recommend(["u1", "u2", "stranger"], 4, "all").toPandas()
    seen = set(zip(clustered["user_id"], clustered["item_id"]))
    assert not seen & set(zip(recs["user_id"], recs["item_id"]))
    for (_, _), g in recs.groupby(["model", "user_id"]):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (g["score"].diff().dropna() <= 1e-12).all() and len(g) <= 4
    assert "RankFusion" in set(recs["model"]) and "stranger" in set(recs.loc[recs["model"] == "BPRMF", "user_id"])
    content = recs[(recs["model"] == "MultiModalItemKNN") & (recs["user_id"] == "u1")]
    assert (content["item_id"].str[1:].astype(int) % 3 == 1).mean() >= 0.5
    with_seen = fitted.recommend(["u1"], 4, "Popularity", exclude_seen=False).toPandas()
    assert len(with_seen) == 4


def test_predict_and_evaluate(fitted, clustered):
    pairs = pd.DataFrame({"user_id": ["u1", "u1", "u1"], "item_id": ["i1", "i1", "unknown"]})
    got = fitted.predict(pairs, "all").toPandas()
    assert len(got) == 3 * (len(fitted.models) + 1)
    assert (got[(got["item_id"] == "unknown") & (got["model"] == "BPRMF")]["score"] == 0).all()
    report = fitted.evaluate(clustered.groupby("user_id").tail(1), ["Popularity"])
    assert report.leaderboard["model"].tolist() == ["Popularity"]


def test_save_and_load(spark, clustered, tmp_path):
    fitted = AutoRecommender(spark, eval_metrics=["recall@5"]).fit(clustered, models=["Popularity"], refit_full=False)
    for _ in range(2):
        last = fitted.save(tmp_path / "a", k=5, max_generations=2)
    saved = SavedRecommender(spark, tmp_path / "a")
    assert saved.folder == last and saved.manifest["best"] == fitted.model_best
    assert saved.recommend(["u1"], 3).count() == 3
    users = spark.createDataFrame([("u1",)], "user string")
    assert saved.history(users).count() == fitted.seen.where("user = 'u1'").count()
    manifest = Path(last) / "manifest.json"
    whole = json.loads(manifest.read_text())
    whole["manifest"]["k"] = 99
    manifest.write_text(json.dumps(whole))
    (Path(last) / ".manifest.json.crc").unlink(missing_ok=True)
    assert SavedRecommender(spark, tmp_path / "a").folder != last
    with pytest.raises(ValueError):
        SavedRecommender(spark, tmp_path / "none")


def test_arguments(spark, clustered):
    r = AutoRecommender(spark)
    with pytest.raises(RuntimeError):
        r.recommend()
    for bad in ({"split": "x"}, {"refit_full": "x"}, {"n_trials": 0}, {"time_limit": 0}, {"models": "nothing"}, {"test_data": clustered.head(3)}):
        with pytest.raises(ValueError):
            r.fit(clustered, **{"models": ["Popularity"], **bad})


def test_a_failing_model_is_a_row(spark, clustered):
    class Broken:
        def fit(self, data):
            raise OSError("disk")

    r = AutoRecommender(spark)
    r.register_model("Broken", Broken)
    r.fit(clustered, models=["Broken", "Popularity"], refit_full=False)
    board = r.leaderboard().set_index("model")
    assert board.loc["Broken", "status"] == "failed" and r.model_best == "Popularity"
    with pytest.raises(ValueError):
        r.register_model("Broken", Broken)


def test_tuning_picks_settings_of_the_space(spark, clustered):
    r = AutoRecommender(spark, eval_metrics=["recall@5"]).fit(clustered, models=["BPRMF"], presets="fast_training", hyperparameter_tune=True, n_trials=2, refit_full=False)
    assert r.settings["BPRMF"]["factors"] in (16, 32, 64)


def _inner(spark, clustered):
    return spark.createDataFrame(clustered).select(F.col("user_id").alias("user"), F.col("item_id").alias("item"), F.col("timestamp").alias("ts"))


def test_factor_loss_falls(spark, clustered):
    df = _inner(spark, clustered)
    model = FactorModel(factors=8, epochs=8, learning_rate=0.1, batch_size=64).fit(df, df.select("item").distinct())
    assert model.losses[-1] < model.losses[0] - 0.02 and model.users.count() == 36


@pytest.mark.parametrize("content", [False, True])
def test_factors_in_blocks_learn_every_pair_and_pass_no_table_to_the_driver(spark, monkeypatch, content):
    """Three groups and blocks: each epoch learns from every pair once, and the driver gets one short row from each task."""
    from pyspark.sql.classic.dataframe import DataFrame

    from tidewise.models import factors

    monkeypatch.setattr(factors, "PAIRS_PER_TASK", 90)
    monkeypatch.setattr(factors, "BLOCK", 8)
    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(collect(self)) or got[-1])
    monkeypatch.setattr(spark, "createDataFrame", None)
    df = spark.range(3200).select((F.col("id") % 40).alias("user"), (F.col("id") % 40 % 2 * 16 + F.pmod(F.xxhash64("id"), F.lit(16))).alias("item")).distinct()
    n, catalog = df.count(), spark.range(33).select(F.col("id").alias("item"))
    vec = catalog.select("item", F.array(*[F.cos(F.col("item") * k) for k in range(3)]).alias("vec")).where("item < 32") if content else None
    model = factors.FactorModel(factors=4, epochs=3, learning_rate=0.1, batch_size=32, content_factors=2 if content else 0).fit(df, catalog, vec)
    told = [rows for rows in got if rows and "seen" in rows[0].asDict()]
    rounds = len(told) // 3
    sums = [sum(r["seen"] for rows in told[k * rounds : (k + 1) * rounds] for r in rows) for k in range(3)]
    assert rounds == 3 and all(0.95 * n < x <= n for x in sums)  # a user who has all items of a block has no negative there
    assert max(map(len, got)) <= 3 and model.losses[-1] < model.losses[0]
    items, users = (sorted((r[0], len(r[1])) for r in collect(t)) for t in (model.items, model.users))
    width = 7 if content else 5
    assert items == [(k, width) for k in range(33)] and users == [(k, width) for k in range(40)]


def test_graph_loss_falls(spark, clustered, items):
    df = _inner(spark, clustered)
    model = LightGCN(factors=4, epochs=5, learning_rate=0.1).fit(df, df.select("item").distinct())
    assert model.losses[-1] < model.losses[0] - 0.02
    content = spark.createDataFrame(items).select(F.col("item_id").alias("id"), F.col("emb").alias("vec"))
    free = FREEDOM(factors=4, epochs=2, learning_rate=0.1, knn_k=3).fit(df, content.select(F.col("id").alias("item")), {"embedding": content})
    assert free.losses[-1] < free.losses[0] and free.items.count() == 31


def test_graph_gradient_by_finite_differences(spark):
    """The way back through an item graph is the transpose: <g, A x> = <Aᵀ g, x>."""
    from tidewise.operators import graph

    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 2.0), ("c", "b", 1.5)], "src string, dst string, w double")
    x = spark.createDataFrame([("a", 0, 1.0), ("b", 0, -2.0), ("c", 0, 3.0)], "node string, pos int, x double")
    g = spark.createDataFrame([("b", 0, 0.7), ("c", 0, -0.2)], "node string, pos int, x double")
    inner = lambda p, q: p.join(q.withColumnRenamed("x", "y"), ["node", "pos"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    assert abs(inner(graph.propagate(edges, x), g) - inner(graph.propagate(back, g), x)) < 1e-12


@pytest.mark.parametrize("with_content", [False, True])
def test_a_ranking_step_is_the_loss_s_gradient(with_content):
    """One pair, one step: every change is the rate times minus the derivative of log(1 + exp(-x))."""
    from tidewise.models.factors import _steps

    rng, d, c, dims, rate = np.random.default_rng(4), 3, 2 if with_content else 0, 5, 1e-3
    width = max(d + 1, c)
    start, content = rng.normal(0, 0.5, (2 + (dims if with_content else 0), width)), rng.normal(size=(2, dims)) if with_content else None
    user = rng.normal(0, 0.5, d + c)

    def loss(u, table):
        x = u[:d] @ (table[0, :d] - table[1, :d]) + table[0, d] - table[1, d]
        if with_content:
            x += u[d:] @ ((content[0] - content[1]) @ table[2:, :c])
        return np.logaddexp(0, -x)

    pairs = pd.DataFrame({"user": ["u"], "idx": [0], "taught": [True]})
    _, u, delta, _, told, seen = _steps(pairs, {"u": user}, start, content, factors=d, content_factors=c, rate=rate, reg=0.0, batch=8, seed=1)
    assert seen == 1 and told == pytest.approx(loss(user, start))
    eps = 1e-6
    for k in range(d + c):
        step = np.eye(d + c)[k] * eps
        assert (u[0] - user)[k] / rate == pytest.approx(-(loss(user + step, start) - loss(user - step, start)) / (2 * eps), abs=1e-5)
    for at in np.ndindex(start.shape):
        step = np.zeros_like(start)
        step[at] = eps
        # the content map moves after the user's content factors did, so to first order in the rate
        assert delta[at] / rate == pytest.approx(-(loss(user, start + step) - loss(user, start - step)) / (2 * eps), abs=5e-3)


def test_negatives_are_legal():
    rng = np.random.default_rng(0)
    have = {0: {0, 1}, 1: {0, 1, 2}}
    assert set(negatives(rng, np.zeros(50, int), have, 3)) == {2} and set(negatives(rng, np.ones(5, int), have, 3)) == {-1}


def test_sources(spark, tmp_path):
    df = pd.DataFrame({"user_id": ["a", "b"], "item_id": [1, 2], "timestamp": ["2024-01-01", "2024-01-02"]})
    df.to_csv(tmp_path / "x.csv", index=False)
    df.to_csv(tmp_path / "x.tsv", index=False, sep="\t")
    df.to_csv(tmp_path / "y.txt", index=False, sep="|")
    df.to_json(tmp_path / "z.jsonl", orient="records", lines=True)
    frames = [tables.load(spark, tmp_path / n) for n in ("x.csv", "x.tsv", "y.txt", "z.jsonl")]
    assert all(f.count() == 2 and set(f.columns) == set(df.columns) for f in frames)
    out = tables.convert(spark, tmp_path / "x.csv")
    assert out.endswith("x.parquet") and tables.convert(spark, tmp_path / "x.csv") == out and spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError):
        tables.convert(spark, tmp_path / "x.doc")
    a = spark.createDataFrame(df)
    assert tables.frame_fingerprint(a) == tables.frame_fingerprint(a.repartition(3)) != tables.frame_fingerprint(a.limit(1))
    cache = tables.Cache(spark, tmp_path / "cache")
    assert cache.table(df, "t").count() == 2 and len(list((tmp_path / "cache").iterdir())) == 1 and cache.table(df, "t").count() == 2 and len(list((tmp_path / "cache").iterdir())) == 1
    assert tables.file_fingerprint(spark, str(tmp_path / "x.csv")) != tables.file_fingerprint(spark, str(tmp_path / "x.tsv"))
    with pytest.raises(ValueError):
        tables.write_recommendations(a.limit(0), tmp_path / "none.parquet")


def test_discovery(spark, tmp_path):
    pd.DataFrame({"User_ID": ["a"], "movie_id": [1], "timestamp": ["2024-01-01"], "rating": [5]}).to_csv(tmp_path / "interactions.csv", index=False)
    pd.DataFrame({"movie_id": [1], "genre": ["drama"], "year": [1999], "title": ["A rather long title of a film"]}).to_csv(tmp_path / "movies.csv", index=False)
    d = tables.discover(spark, tmp_path)
    assert (d.user, d.item, d.timestamp, d.label) == ("User_ID", "movie_id", "timestamp", "rating")
    assert d.modalities == {"item": {"categorical": ["genre"], "numerical": ["year"], "text": ["title"]}}
    with pytest.raises(FileNotFoundError):
        tables.discover(spark, tmp_path / "none")


def test_history_index_reads_only_the_users_buckets(spark, clustered, tmp_path):
    df = _inner(spark, clustered)
    path = history_index.build(df, str(tmp_path), 8)
    assert history_index.build(df, str(tmp_path), 8) == path
    some = spark.createDataFrame([("u3",), ("u5",)], "user string")
    got = history_index.lookup(spark, path, some)
    plan = got._jdf.queryExecution().executedPlan().toString()
    mine = {r[0] for r in some.select(history.bucket(F.col("user"), 8)).collect()}
    (filters,) = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert len(mine) < 8 and "bucket#" in filters and all(str(b) in filters for b in mine)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, history.seen_pairs(df).where("user in ('u3', 'u5')").collect()))


def test_streams_follow_the_batch_results(spark, clustered, tmp_path):
    df = _inner(spark, clustered)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.popularity_stream(stream, str(tmp_path / "p"), str(tmp_path / "c1")).awaitTermination()
    last = incremental.popularity_table(spark, str(tmp_path / "p")).select("item", "n")
    assert sorted(map(tuple, last.collect())) == sorted((r["item"], r["n"]) for r in history.popularity(df).collect())
    incremental.history_stream(stream, str(tmp_path / "h"), str(tmp_path / "c2"), 4).awaitTermination()
    assert sorted(map(tuple, incremental.history_table(spark, str(tmp_path / "h")).collect())) == sorted(map(tuple, history.seen_pairs(df).collect()))


def test_driver_contract(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() == 2


def test_a_capped_factor_model_still_has_all_users_and_their_histories(spark, clustered):
    df = _inner(spark, clustered)
    model = FactorModel(factors=4, epochs=1, max_training_pairs=20).fit(df, df.select("item").distinct())
    assert model.users.count() == df.select("user").distinct().count()


def test_a_failing_refit_keeps_the_compared_model(spark, clustered, monkeypatch):
    r = AutoRecommender(spark)
    calls, own = [], AutoRecommender._fitted

    def fitted(self, name, train, **override):
        calls.append(name)
        if len(calls) > 1:
            raise RuntimeError("no memory")
        return own(self, name, train, **override)

    monkeypatch.setattr(AutoRecommender, "_fitted", fitted)
    r.fit(clustered, models=["Popularity"])
    assert len(calls) == 2 and r.leaderboard()["refit_status"].tolist() == ["kept: RuntimeError: no memory"]
    assert r.recommend(None, k=3).count() > 0


def test_approximate_lists_hold_most_exact_neighbours(spark):
    from tidewise.plans.trained_queries import QUERIES

    found = {r["backend"]: (r["queries"], r["recall"]) for r in QUERIES["ann_recall_vs_exact"](spark, "/root/testdata/sf0.01").collect()}
    assert set(found) == {"graph", "ivf", "ivfpq", "lsh"} and all(n == 500 and share >= 0.9 for n, share in found.values())
