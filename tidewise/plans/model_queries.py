"""Item co-occurrence, rank fusion and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, history, itemcf, metrics
from .inputs import ITEMCF, RECS
from .interaction_queries import kept, training, training_pairs

QUERIES, SQL = {}, {}
NEAR = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _renamed(df):
    return df.withColumnsRenamed({"user": "uid", "item": "iid"})


def _history(spark, d):
    return itemcf.capped_history(training(spark, d)[0])


@query(f"WITH {ITEMCF} SELECT uid, iid, first_ts FROM h")
def itemcf_deduped_history(spark, d):
    return _renamed(_history(spark, d))


@query(f"WITH {ITEMCF} SELECT i, j, n FROM co")
def itemcf_cooccurrence(spark, d):
    return itemcf.co_occurrence(_history(spark, d))


@query(f"WITH {ITEMCF} SELECT i, j, sim, rank FROM near")
def itemcf_neighbors_topn(spark, d):
    return itemcf.neighbours(_history(spark, d), NEAR, 6).withColumn("rank", F.col("rank").cast("long"))


def _near(train):
    return itemcf.neighbours(itemcf.capped_history(train), NEAR, 6)


@query(f"WITH {ITEMCF} SELECT uid, iid, score FROM cand")
def itemcf_candidate_scores(spark, d):
    train = training(spark, d)[0]
    return _renamed(itemcf.candidate_scores(history.seen_pairs(train), _near(train), 6))


def _near_and_popular(train):
    """Neighbours and popularity over the capped histories of training pairs, as tables that are kept."""
    capped = train.where(F.col("place") <= itemcf.HISTORY).select("user", "item", F.col("ts").alias("first_ts"))
    return itemcf.neighbours(capped, NEAR, 6, kept), kept(itemcf.history_popularity(capped))


def itemcf_recs(train, k=10):
    """train: training pairs."""
    seen = train.select("user", "item")
    return kept(itemcf.recommend(seen, seen, *_near_and_popular(train), k, 6, keep=kept))


@query(f"WITH {ITEMCF} SELECT uid, iid, rank, round(score, 9) AS score FROM cf_recs")
def itemcf_recommend_backfill(spark, d):
    return _renamed(itemcf_recs(training_pairs(spark, d)[0])).select("uid", "iid", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"""WITH {ITEMCF}, s AS (SELECT t.uid, t.iid, sum(n.sim) AS s FROM (SELECT DISTINCT uid, iid FROM test) t JOIN seen h ON t.uid = h.uid JOIN near n ON n.i = h.iid AND n.j = t.iid GROUP BY 1, 2)
SELECT t.uid, t.iid, round(coalesce(s.s, 0) + 1e-6 * coalesce(p.score, 0), 9) AS score FROM test t LEFT JOIN s ON t.uid = s.uid AND t.iid = s.iid LEFT JOIN hpop p ON t.iid = p.iid""")
def itemcf_score_pairs(spark, d):
    train, test = training(spark, d)
    popular = itemcf.history_popularity(itemcf.capped_history(train))
    return _renamed(itemcf.score_pairs(test, history.seen_pairs(train), _near(train), popular)).withColumn("score", F.round("score", 9))


def both_recs(spark, d):
    """Popularity's and ItemCF's ten for each training user, and the held-out rows."""
    train, test = training_pairs(spark, d)
    seen, columns = train.select("user", "item"), ("user", "item", "rank", "score")
    popular = kept(history.popular_unseen(seen, kept(history.popularity(train, "n")), seen, 10))
    near = itemcf_recs(train)
    return popular.select(*columns, F.lit("Popularity").alias("model")).unionByName(near.select(*columns, F.lit("ItemCF").alias("model"))), test


PER_USER = f"""{RECS},
 r AS (SELECT uid, count(*) AS r FROM truth GROUP BY uid), models AS (SELECT DISTINCT model FROM recs),
 l AS (SELECT c.model, c.uid, c.rank, CASE WHEN t.iid IS NULL THEN 0 ELSE 1 END AS hit FROM recs c LEFT JOIN truth t ON c.uid = t.uid AND c.iid = t.iid),
 w AS (SELECT *, sum(hit) OVER o AS hits, sum(1 - hit) OVER o AS misses FROM l WINDOW o AS (PARTITION BY model, uid ORDER BY rank ROWS UNBOUNDED PRECEDING)),
 per AS (SELECT model, uid, count(*) AS p, sum(hit) AS h, min(rank) FILTER (hit = 1) AS first, sum(hit / log2(rank + 1.0)) AS dcg, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS pr, sum(CASE WHEN hit = 1 THEN misses ELSE 0 END) AS above FROM w GROUP BY 1, 2),
 x AS (SELECT m.model, r.uid, r.r, coalesce(p.p, 0) AS p, coalesce(p.h, 0) AS h, p.first, coalesce(p.dcg, 0) AS dcg, coalesce(p.pr, 0) AS pr, coalesce(p.above, 0) AS above FROM r CROSS JOIN models m LEFT JOIN per p ON p.model = m.model AND p.uid = r.uid),
 met AS (SELECT model, uid, h / r AS recall, CASE WHEN p > 0 THEN h / p ELSE 0 END AS precision, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(1.0 / first, 0) AS mrr,
         CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, least(r, p)::BIGINT + 1), lambda k: 1 / log2(k + 1.0))) ELSE 0 END AS ndcg, pr / r AS map,
         CASE WHEN h = 0 THEN 0.0 WHEN p = h THEN 1.0 ELSE (h * (p - h) - above) / (h * (p - h)) END AS auc FROM x)"""


def _metric(kind):
    @query(f"WITH {PER_USER} SELECT model, round(avg({kind}), 6) AS value, count(*) AS n_users FROM met GROUP BY model")
    def run(spark, d):
        recs, test = both_recs(spark, d)
        return metrics.user_metrics(recs, test, 10, ["Popularity", "ItemCF"]).groupBy("model").agg(F.round(F.avg(kind), 6).alias("value"), F.count(F.lit(1)).alias("n_users"))

    QUERIES[f"metric_{kind}"], SQL[f"metric_{kind}"] = QUERIES.pop("run"), SQL.pop("run")


for _kind in metrics.NAMES:
    _metric(_kind)


@query(f"WITH {RECS} SELECT model, round(count(DISTINCT iid) / (SELECT count(*)::DOUBLE FROM part), 6) AS coverage FROM recs GROUP BY model")
def metric_coverage(spark, d):
    recs, _ = both_recs(spark, d)
    return metrics.coverage(recs, spark.read.parquet(f"{d}/part.parquet").count()).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {PER_USER}, cov AS (SELECT model, count(DISTINCT iid) / (SELECT count(*)::DOUBLE FROM part) AS coverage FROM recs GROUP BY model)
SELECT model, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(any_value(coverage), 6) AS coverage, row_number() OVER (ORDER BY avg(recall) DESC, model) AS place FROM met JOIN cov USING (model) GROUP BY model""")
def leaderboard_join(spark, d):
    from pyspark.sql import Window

    recs, test = both_recs(spark, d)
    board = metrics.evaluate(recs, test, ["recall@10", "ndcg@10", "mrr@10"], spark.read.parquet(f"{d}/part.parquet").count())
    place = F.row_number().over(Window.orderBy(F.desc("`recall@10`"), "model")).cast("long")  # one row for each model
    return board.select("model", *[F.round(f"`{m}@10`", 6).alias(m) for m in ("recall", "ndcg", "mrr")], F.round("coverage", 6).alias("coverage"), place.alias("place"))


def _fused_sql(weight: str) -> str:
    return f"""WITH {RECS}, f AS (SELECT uid, iid, round(sum({weight} / (60 + rank)), 9) AS score FROM recs GROUP BY 1, 2)
SELECT uid, iid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, iid::VARCHAR) AS rank FROM f) WHERE rank <= 10"""


@query(_fused_sql("1.0::DOUBLE"))
def rrf_fusion_uniform(spark, d):
    fused = fusion.reciprocal_rank_fusion(both_recs(spark, d)[0], 10, digits=9)
    return _renamed(fused).select("uid", "iid", "score", F.col("rank").cast("long").alias("rank"))


@query(_fused_sql("CASE WHEN model = 'ItemCF' THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END"))
def rrf_fusion_weighted(spark, d):
    fused = fusion.reciprocal_rank_fusion(both_recs(spark, d)[0], 10, {"ItemCF": 0.75}, digits=9)
    return _renamed(fused).select("uid", "iid", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RECS} SELECT r.uid, r.iid, round(coalesce(max(1.0 / (60 + rank)) FILTER (model = 'Popularity'), 0), 9) AS popularity, round(coalesce(max(1.0 / (60 + rank)) FILTER (model = 'ItemCF'), 0), 9) AS itemcf,
 max(CASE WHEN t.iid IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS label FROM recs r SEMI JOIN test u ON r.uid = u.uid LEFT JOIN truth t ON r.uid = t.uid AND r.iid = t.iid GROUP BY 1, 2""")
def stacking_feature_pivot(spark, d):
    recs, test = both_recs(spark, d)
    rows = fusion.stacking_features(recs, test, ["Popularity", "ItemCF"])
    return _renamed(rows).select("uid", "iid", F.round("Popularity", 9).alias("popularity"), F.round("ItemCF", 9).alias("itemcf"), "label")


@query()
def stacking_weights(spark, d):
    recs, test = both_recs(spark, d)
    found = fusion.fit_weights(recs, test, ["Popularity", "ItemCF"])
    return spark.createDataFrame(list(found.items()), "model string, weight double")


@query(f"""WITH {ITEMCF}, t AS (SELECT DISTINCT uid, iid FROM test), s AS (SELECT t.uid, t.iid, sum(n.sim) AS s FROM t JOIN seen h ON t.uid = h.uid JOIN near n ON n.i = h.iid AND n.j = t.iid GROUP BY 1, 2),
 sc AS (SELECT t.uid, t.iid, 'ItemCF' AS model, round(coalesce(s.s, 0) + 1e-6 * coalesce(p.score, 0), 9) AS score FROM t LEFT JOIN s ON t.uid = s.uid AND t.iid = s.iid LEFT JOIN hpop p ON t.iid = p.iid
        UNION ALL SELECT t.uid, t.iid, 'Popularity', round(coalesce(p.score, 0), 9) FROM t LEFT JOIN pop p ON t.iid = p.iid),
 k AS (SELECT *, row_number() OVER (PARTITION BY model, uid ORDER BY score DESC, iid::VARCHAR) AS rank FROM sc), f AS (SELECT uid, iid, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM k GROUP BY 1, 2)
SELECT test.uid, test.iid, f.score FROM test LEFT JOIN f ON test.uid = f.uid AND test.iid = f.iid""")
def predict_fused_candidate_set(spark, d):
    train, test = training_pairs(spark, d)
    pairs = test.select("user", "item")
    cf = itemcf.score_pairs(pairs, train.select("user", "item"), *_near_and_popular(train), kept).withColumn("model", F.lit("ItemCF"))
    pop = pairs.join(history.popularity(train, "n").select("item", "score"), "item", "left").fillna(0.0, ["score"]).withColumn("model", F.lit("Popularity"))
    scored = cf.unionByName(pop.select("user", "item", "score", "model")).withColumn("score", F.round("score", 9))
    ranks = history.top_k(scored, 2**31 - 1, ("model", "user"))
    fused = fusion.reciprocal_rank_fusion(ranks, 2**31 - 1, digits=9).select("user", "item", "score")
    return _renamed(test.select("user", "item").join(fused, ["user", "item"], "left"))
