"""The driver's tables in the recommender's roles, for Spark and as SQL.

Interactions A: customers and parts of order lines, by order date (ties within days, repeated pairs). Interactions B:
events, with the number k in props as the item. Columns: user, item, ts; in SQL uid, iid, ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tells rows of A apart, but for repeats of all of them.
KEYS_A = ["l_orderkey", "l_linenumber", "item", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_linenumber", "l_suppkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("user", "item", "ts", "l_orderkey", "l_linenumber", "l_suppkey")


def interactions_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").try_cast("int").alias("item"), "ts", "event_id", "event_type", "value")


A = "a AS (SELECT o_custkey AS uid, l_partkey AS iid, o_orderdate AS ts, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
B = "b AS (SELECT user_id AS uid, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS iid, ts, event_id, event_type, value FROM events)"
#: Leave-last-out of A: train and test.
SPLIT = f"""{A},
 m AS (SELECT *, count(*) OVER (PARTITION BY uid) >= 2 AND row_number() OVER (PARTITION BY uid ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, iid DESC, l_suppkey DESC) = 1 AS held FROM a),
 train AS (SELECT uid, iid, ts FROM m WHERE NOT held), test AS (SELECT uid, iid, ts FROM m WHERE held), seen AS (SELECT DISTINCT uid, iid FROM train)"""
#: Popularity of the training rows and the ten most popular unseen parts of each user.
POPULAR = f"""{SPLIT},
 pop AS (SELECT iid, count(*) AS n, count(*) / max(count(*)) OVER () AS score FROM train GROUP BY iid),
 users AS (SELECT DISTINCT uid FROM train),
 pop_recs AS (SELECT * FROM (SELECT u.uid, p.iid, p.score, row_number() OVER (PARTITION BY u.uid ORDER BY p.score DESC, p.iid::VARCHAR) AS rank
              FROM users u CROSS JOIN pop p ANTI JOIN seen s ON u.uid = s.uid AND p.iid = s.iid) WHERE rank <= 10)"""
#: Co-occurrence neighbours over capped histories, and the ten best unseen candidates of each user, filled up by popularity.
ITEMCF = f"""{POPULAR},
 h AS (SELECT uid, iid, first_ts FROM (SELECT uid, iid, min(ts) AS first_ts, row_number() OVER (PARTITION BY uid ORDER BY min(ts) DESC, iid::VARCHAR) AS r FROM train GROUP BY uid, iid) WHERE r <= 200),
 c AS (SELECT iid, count(*) AS n FROM h GROUP BY iid),
 co AS (SELECT a.iid AS i, b.iid AS j, count(*) AS n FROM h a JOIN h b ON a.uid = b.uid AND a.iid < b.iid GROUP BY 1, 2),
 half AS (SELECT i, j, round(co.n / sqrt(ci.n * cj.n), 6) AS sim FROM co JOIN c ci ON ci.iid = i JOIN c cj ON cj.iid = j),
 sims AS (SELECT i, j, sim FROM half UNION ALL SELECT j, i, sim FROM half),
 near AS (SELECT * FROM (SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j::VARCHAR) AS rank FROM sims) WHERE rank <= 20),
 cand AS (SELECT s.uid, n.j AS iid, round(sum(n.sim), 6) AS score FROM seen s JOIN near n ON s.iid = n.i GROUP BY 1, 2),
 hpop AS (SELECT iid, n, n / max(n) OVER () AS score FROM c),
 best AS (SELECT * FROM (SELECT c.uid, c.iid, c.score, row_number() OVER (PARTITION BY c.uid ORDER BY c.score DESC, c.iid::VARCHAR) AS rank FROM cand c ANTI JOIN seen s ON c.uid = s.uid AND c.iid = s.iid) WHERE rank <= 10),
 fill AS (SELECT u.uid, p.iid, 1e-6 * p.score AS score FROM users u CROSS JOIN hpop p ANTI JOIN seen s ON u.uid = s.uid AND p.iid = s.iid ANTI JOIN best b ON u.uid = b.uid AND p.iid = b.iid),
 cf_recs AS (SELECT * FROM (SELECT uid, iid, score, row_number() OVER (PARTITION BY uid ORDER BY f, score DESC, iid::VARCHAR) AS rank
             FROM (SELECT uid, iid, score, 0 AS f FROM best UNION ALL SELECT uid, iid, score, 1 AS f FROM fill)) WHERE rank <= 10)"""
#: Both lists in one table.
RECS = f"""{ITEMCF},
 recs AS (SELECT uid, iid, rank, score, 'Popularity' AS model FROM pop_recs UNION ALL SELECT uid, iid, rank, score, 'ItemCF' AS model FROM cf_recs),
 truth AS (SELECT DISTINCT uid, iid FROM test)"""
