"""Ingestion, validation, splits, popularity and histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Columns
from ..functions.expressions import md5_number
from ..operators import baskets, history, itemcf, splits, validate
from ..sources.shared import Kept, removed
from .inputs import KEYS_A, POPULAR, SPLIT, A, B, interactions_a, interactions_b, table

SEED = 42
#: Bytes of a shuffled line.
LINE = 64
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {A} SELECT uid, iid, ts FROM a")
def ingest_interactions_projection(spark, d):
    return validate.projected(interactions_a(spark, d), Columns("user", "item", "ts")).select(F.col("user").alias("uid"), F.col("item").alias("iid"), "ts")


@query(f"WITH {B} SELECT event_id, uid, iid FROM b WHERE TRY_CAST(value AS DOUBLE) > 0")
def positive_feedback_filter(spark, d):
    return validate.positive(interactions_b(spark, d), "value").select("event_id", F.col("user").alias("uid"), F.col("item").alias("iid"))


@query(f"WITH {B} SELECT count(*) AS n_rows, count(*) FILTER (uid IS NULL) AS null_users, count(*) FILTER (iid IS NULL) AS null_items, count(*) FILTER (uid IS NULL OR iid IS NULL) AS null_ids FROM b")
def null_id_audit(spark, d):
    return validate.null_id_audit(interactions_b(spark, d), Columns("user", "item"))


@query(f"WITH {B} SELECT count(*) AS n_rows, count(*) FILTER (TRY_CAST(event_type AS DOUBLE) IS NULL) AS not_numeric, count(*) FILTER (TRY_CAST(event_type AS DOUBLE) > 0) AS positive FROM b")
def label_coercion_audit(spark, d):
    return validate.label_audit(interactions_b(spark, d), "event_type")


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def entity_uniqueness_audit(spark, d):
    return validate.repeated_ids(table(spark, d, "orders"), "o_custkey")


@query(f"WITH {B} SELECT event_id, epoch_us(ts) AS micros, year(ts) AS y, hour(ts) AS h FROM b")
def timestamp_utc_normalise(spark, d):
    rows = validate.in_utc(interactions_b(spark, d), "ts")
    return rows.select("event_id", F.unix_micros("ts").alias("micros"), F.year("ts").cast("long").alias("y"), F.hour("ts").cast("long").alias("h"))


@query(f"WITH {A}, f AS (SELECT iid, min(ts) AS t FROM a GROUP BY iid) SELECT iid, row_number() OVER (ORDER BY t, iid) - 1 AS item_idx FROM f")
def catalog_first_seen(spark, d):
    return validate.first_seen_index(interactions_a(spark, d), "item", "ts").withColumnRenamed("item", "iid")


@query(f"WITH {A} SELECT count(*) AS n_rows, count(DISTINCT uid) AS n_users, count(DISTINCT iid) AS n_items, (SELECT count(*) FROM (SELECT DISTINCT uid, iid FROM a)) AS n_pairs, min(ts) AS first_ts, max(ts) AS last_ts FROM a")
def interaction_profile(spark, d):
    return validate.profile(interactions_a(spark, d), "user", "item", "ts")


@query("SELECT count(*) AS n_rows, count(o_orderkey) AS n_keys FROM orders")
def parquet_row_count(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_orderkey").alias("n_keys"))


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def users_without_interactions(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query(f"WITH {A} SELECT uid, iid, ts FROM a SEMI JOIN part ON iid = p_partkey")
def catalog_membership_filter(spark, d):
    a, p = interactions_a(spark, d), table(spark, d, "part")
    return a.join(p, a.item == p.p_partkey, "left_semi").select(F.col("user").alias("uid"), F.col("item").alias("iid"), "ts")


def _marked(df):
    return df.select(F.col("user").alias("uid"), F.col("item").alias("iid"), "ts", "l_orderkey", "l_linenumber", "l_suppkey", "held")


_LAST = "count(*) OVER (PARTITION BY uid) >= 2 AND row_number() OVER (PARTITION BY uid ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, iid DESC, l_suppkey DESC) = 1"


@query(f"WITH {A} SELECT *, {_LAST} AS held FROM a")
def split_temporal_loo(spark, d):
    return _marked(splits.leave_last_out(interactions_a(spark, d), "user", ["ts", *KEYS_A]))


@query(f"""WITH {A}, m AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, iid DESC, l_suppkey DESC) AS r FROM a)
SELECT uid, iid, ts, l_orderkey, l_linenumber, l_suppkey, CASE WHEN n >= 2 AND r = 1 THEN 'test' WHEN n >= 3 AND r = 2 THEN 'validation' ELSE 'train' END AS part FROM m""")
def split_temporal_three_way(spark, d):
    parts = splits.three_way(interactions_a(spark, d), "temporal", user="user", timestamp="ts", keys=KEYS_A)
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "validation", "test"))]
    return named[0].unionByName(named[1]).unionByName(named[2]).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"""WITH {A} SELECT *, count(*) OVER (PARTITION BY uid) >= 2 AND row_number() OVER (PARTITION BY uid ORDER BY
md5(concat_ws('|', '{SEED}', uid, l_orderkey, l_linenumber, iid, l_suppkey)), l_orderkey, l_linenumber, iid, l_suppkey) = 1 AS held FROM a""")
def split_random_loo(spark, d):
    return _marked(splits.leave_random_out(interactions_a(spark, d), "user", KEYS_A, SEED))


@query(f"""WITH {A}, u AS (SELECT DISTINCT uid FROM a), k AS (SELECT least(count(*) - 1, greatest(1, round_even(count(*) * 0.2, 0))) AS n FROM u),
c AS (SELECT uid, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', uid)), uid) AS r FROM u)
SELECT a.*, r <= (SELECT n FROM k) AS held FROM a JOIN c ON a.uid = c.uid""")
def split_cold_start(spark, d):
    return _marked(splits.hold_users_out(interactions_a(spark, d), "user", SEED))


@query(f"""WITH {A}, o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM a),
cut AS (SELECT min(ts) AS t FROM o WHERE p = least(n - 1, greatest(1, floor(n * (1.0::DOUBLE - 0.2::DOUBLE))))),
real AS (SELECT CASE WHEN t = (SELECT min(ts) FROM a) THEN (SELECT min(ts) FROM a WHERE ts > t) ELSE t END AS t FROM cut)
SELECT a.*, ts >= (SELECT t FROM real) AS held FROM a""")
def split_global_temporal(spark, d):
    return _marked(splits.after_global_cut(interactions_a(spark, d), "ts"))


@query(f"WITH {SPLIT} SELECT DISTINCT uid, iid FROM train SEMI JOIN test USING (uid, iid)")
def split_overlap_audit(spark, d):
    train, test = splits.split(interactions_a(spark, d), "temporal", user="user", timestamp="ts", keys=KEYS_A)
    return splits.overlap(train, test, ["user", "item"]).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"WITH {SPLIT} SELECT held, count(*) AS n_rows, count(DISTINCT uid) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts FROM m GROUP BY held")
def split_sizes(spark, d):
    marked = splits.leave_last_out(interactions_a(spark, d), "user", ["ts", *KEYS_A])
    return marked.groupBy("held").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user").alias("n_users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {A} SELECT iid, count(*) AS n, round(count(*) / max(count(*)) OVER (), 6) AS score FROM a GROUP BY iid")
def popularity_scores(spark, d):
    return history.popularity(interactions_a(spark, d)).select(F.col("item").alias("iid"), "n", F.round("score", 6).alias("score"))


def training(spark, d):
    return splits.split(interactions_a(spark, d), "temporal", user="user", timestamp="ts", keys=KEYS_A)


kept = Kept()


def training_pairs(spark, d):
    """(train, test) as distinct (user, item, ts, n, place) with the first time, the number of rows and the place in the user's
    history, the newest first: the split is made once, and its rows are grouped and placed where they were dealt by user.
    Many lines are joined and dealt in parts."""
    lines = interactions_a(spark, d)
    size = LINE * table(spark, d, "lineitem").count()
    joined = baskets.in_parts(lines, "l_orderkey", size, kept, lambda part: part) if size > baskets.PART_BYTES else lines

    def pairs(part):
        marked = splits.leave_last_out(part, "user", ["ts", *KEYS_A])
        found = marked.groupBy("user", "item", "held").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
        return found.withColumn("place", itemcf.newest("ts", "user", "held"))

    rows = baskets.in_parts(joined, "user", size, kept, pairs)
    if joined is not lines:
        removed(joined)
    return rows.where("not held").drop("held"), rows.where("held").drop("held")


def popular_recs(train, k=10):
    return history.popular_unseen(train, history.popularity(train), history.seen_pairs(train), k)


@query(f"WITH {POPULAR} SELECT uid, iid, rank, round(score, 6) AS score FROM pop_recs")
def popularity_topk_unseen(spark, d):
    return popular_recs(training(spark, d)[0]).select(F.col("user").alias("uid"), F.col("item").alias("iid"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"WITH {A} SELECT iid, count(*) AS n FROM a GROUP BY iid ORDER BY n DESC, iid::VARCHAR LIMIT 500")
def heavy_hitters_bounded(spark, d):
    return history.heavy_hitters(interactions_a(spark, d), 500).withColumnRenamed("item", "iid")


@query(f"WITH {A}, s AS (SELECT DISTINCT uid, iid FROM a) SELECT uid, count(*) AS n_items, string_agg(iid::VARCHAR, ',' ORDER BY iid) AS items FROM s GROUP BY uid")
def history_sets(spark, d):
    return history.history_lists(interactions_a(spark, d)).select(F.col("user").alias("uid"), "n_items", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def _hash_sql(*parts: str) -> str:
    return f"concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


@query(f"WITH {B}, s AS (SELECT DISTINCT uid, iid FROM b WHERE value > 0 AND iid IS NOT NULL) SELECT {_hash_sql('uid')} % 16 AS bucket, count(*) AS n_pairs, count(DISTINCT uid) AS n_users FROM s GROUP BY 1")
def history_bucket_index(spark, d):
    pairs = history.seen_pairs(validate.positive(interactions_b(spark, d), "value").where("item is not null")).withColumn("bucket", history.bucket(F.col("user"), 16).cast("long"))
    return pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("user").alias("n_users"))


@query(f"WITH {B} SELECT DISTINCT uid, iid FROM b WHERE value > 0 AND uid IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def history_lookup(spark, d):
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user"))
    rows = validate.positive(interactions_b(spark, d), "value")
    return history.seen_pairs(rows.join(wanted, "user", "left_semi")).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"""WITH {A}, s AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, iid DESC, l_suppkey DESC) AS r FROM a WHERE {_hash_sql("'sample'", 'uid')} < 1288490188)
SELECT uid, iid, ts, l_orderkey, l_linenumber, l_suppkey FROM s WHERE r <= 20""")
def user_hash_sample_capped(spark, d):
    newest = [F.col(c).desc() for c in ("ts", *KEYS_A)]
    return history.sampled_users(interactions_a(spark, d), 0.3, 20, newest).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"WITH {A} SELECT {_hash_sql('uid')} % 1000 AS slot, count(DISTINCT uid) AS n FROM a GROUP BY 1")
def stable_user_hash(spark, d):
    return interactions_a(spark, d).groupBy((md5_number(F.col("user")) % 1000).alias("slot")).agg(F.countDistinct("user").alias("n"))


@query(f"WITH {A} SELECT DISTINCT uid, iid FROM a WHERE uid % 20 = 0")
def history_index_lookup(spark, d):
    """The histories of some users out of an index on disk, of which only their buckets are read."""
    from ..sources import history_index
    from ..sources.shared import shared_folder

    path = history_index.build(interactions_a(spark, d), f"{shared_folder(spark)}/tidewise-index", 64)
    wanted = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("user"))
    return history_index.lookup(spark, path, wanted).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"""WITH {A}, s AS (SELECT unnest([1, 2, 3]) AS seed),
 m AS (SELECT seed, a.*, count(*) OVER (PARTITION BY seed, uid) >= 2 AND row_number() OVER (PARTITION BY seed, uid ORDER BY md5(concat_ws('|', seed::VARCHAR, uid, l_orderkey, l_linenumber, iid, l_suppkey)), l_orderkey, l_linenumber, iid, l_suppkey) = 1 AS held FROM a, s),
 c AS (SELECT seed, iid, count(*) AS n FROM m WHERE NOT held GROUP BY 1, 2), p AS (SELECT seed, iid FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY n DESC, iid::VARCHAR) <= 100),
 r AS (SELECT m.seed, avg(CASE WHEN p.iid IS NULL THEN 0.0 ELSE 1.0 END) AS value FROM m LEFT JOIN p ON p.seed = m.seed AND p.iid = m.iid WHERE held GROUP BY m.seed)
SELECT 'Popularity' AS model, count(*) AS seeds, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM r""")
def hit_rate_over_seeds(spark, d):
    """Mean and deviation, over three random holdouts, of the share of held-out rows among the hundred most popular parts."""
    from ..operators.metrics import over_seeds

    runs, rows = None, interactions_a(spark, d)
    for seed in (1, 2, 3):
        marked = splits.leave_random_out(rows, "user", KEYS_A, seed)
        head = history.heavy_hitters(marked.where("not held"), 100).select("item", F.lit(1.0).alias("hit"))
        share = marked.where("held").join(F.broadcast(head), "item", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("value"))  # 100 rows
        run = share.select(F.lit("Popularity").alias("model"), F.lit(seed).alias("seed"), "value")
        runs = run if runs is None else runs.unionByName(run)
    return over_seeds(runs, ["value"]).select("model", "seeds", F.round("value_mean", 6).alias("mean"), F.round("value_deviation", 6).alias("deviation"))
