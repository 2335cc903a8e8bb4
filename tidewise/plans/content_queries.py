"""Feature encoders, content scores and graph operators, each with its SQL. Vectors are listed as (id, pos, value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import dot, lorentz_exp, lorentz_log
from ..operators import features, graph, history
from ..operators.nearest import top_by_dot
from .inputs import SPLIT, table
from .interaction_queries import kept, training, training_pairs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _listed(vectors, zeros: bool = False):
    rows = vectors.select("id", F.posexplode("vec").alias("pos", "x")).select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))
    return rows if zeros else rows.where("value <> 0")


def _entries(rows):
    return rows.select("id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


CATEGORICAL = """brand AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos FROM (SELECT DISTINCT coalesce(p_brand, '__missing__') AS v FROM part)),
 kind AS (SELECT v, (SELECT count(*) FROM brand) + row_number() OVER (ORDER BY v) - 1 AS pos FROM (SELECT DISTINCT coalesce(p_type, '__missing__') AS v FROM part)),
 cat AS (SELECT p_partkey AS id, pos, 1 / sqrt(2) AS x FROM part JOIN brand ON coalesce(p_brand, '__missing__') = v UNION ALL SELECT p_partkey, pos, 1 / sqrt(2) FROM part JOIN kind ON coalesce(p_type, '__missing__') = v)"""
NUMERIC = """med AS (SELECT coalesce(median(p_size::DOUBLE), 0) AS ms, coalesce(median(p_retailprice), 0) AS mp FROM part),
 fil AS (SELECT p_partkey AS id, coalesce(p_size::DOUBLE, ms) AS s, coalesce(p_retailprice, mp) AS p FROM part, med),
 mom AS (SELECT avg(s) AS sa, stddev_pop(s) AS ss, avg(p) AS pa, stddev_pop(p) AS ps FROM fil),
 z AS (SELECT id, (s - sa) / CASE WHEN ss = 0 THEN 1 ELSE ss END AS z0, (p - pa) / CASE WHEN ps = 0 THEN 1 ELSE ps END AS z1 FROM fil, mom),
 num AS (SELECT id, CASE WHEN z0 = 0 AND z1 = 0 THEN 0 ELSE z0 / sqrt(z0 * z0 + z1 * z1) END AS n0, CASE WHEN z0 = 0 AND z1 = 0 THEN 0 ELSE z1 / sqrt(z0 * z0 + z1 * z1) END AS n1 FROM z)"""
EMBEDDED = """el AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
 en AS (SELECT id, sqrt(sum(x * x)) AS n FROM el GROUP BY id), emb AS (SELECT id, pos, CASE WHEN n > 0 THEN x / n ELSE 0 END AS x FROM el JOIN en USING (id)),
 ev AS (SELECT id, list(x ORDER BY pos) AS v FROM emb GROUP BY id)"""
PROFILE = f"""{SPLIT}, {EMBEDDED},
 pm AS (SELECT uid, pos, avg(x) AS x FROM seen JOIN emb ON iid = id GROUP BY uid, pos), pn AS (SELECT uid, sqrt(sum(x * x)) AS n FROM pm GROUP BY uid),
 prof AS (SELECT uid, pos, CASE WHEN n > 0 THEN x / n ELSE 0 END AS x FROM pm JOIN pn USING (uid)), pv AS (SELECT uid, list(x ORDER BY pos) AS v FROM prof GROUP BY uid)"""


@query(f"WITH {CATEGORICAL} SELECT id, pos, round(x, 6) AS value FROM cat")
def feat_categorical_onehot(spark, d):
    return _entries(features.sparse_categorical(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"]))


@query(f"WITH {NUMERIC} SELECT id, round(n0, 6) AS size, round(n1, 6) AS price FROM num")
def feat_numeric_zscore(spark, d):
    v = features.numerical(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])
    return v.select("id", F.round(F.col("vec")[0], 6).alias("size"), F.round(F.col("vec")[1], 6).alias("price"))


@query(r"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS tok FROM documents),
 c AS (SELECT id, concat('0x', substr(md5(tok), 1, 8))::BIGINT % 128 AS bucket, ln(1 + count(*)) AS w FROM t GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM c GROUP BY id)
SELECT id, bucket, round(w / n, 6) AS value FROM c JOIN n USING (id)""")
def feat_text_hashed_tf(spark, d):
    w = features.text_weights(table(spark, d, "documents"), "doc_id", ["text"])
    return w.select("id", F.col("bucket").cast("long").alias("bucket"), F.round("w", 6).alias("value"))


@query(f"WITH {EMBEDDED} SELECT id, pos, round(x, 6) AS value FROM emb")
def feat_embedding_normalised(spark, d):
    return _listed(features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding"), zeros=True)


@query(f"""WITH {CATEGORICAL}, {NUMERIC}, w AS (SELECT (SELECT count(*) FROM brand) + (SELECT count(*) FROM kind) AS k),
 f AS (SELECT id, pos, x FROM cat UNION ALL SELECT id, k, n0 FROM num, w UNION ALL SELECT id, k + 1, n1 FROM num, w), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM f GROUP BY id)
SELECT * FROM (SELECT id, pos, round(x / n, 6) AS value FROM f JOIN n USING (id)) WHERE value <> 0""")
def feat_early_fusion(spark, d):
    return _entries(features.sparse_early_fusion(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"], ["p_size", "p_retailprice"])).where("value <> 0")


@query(f"WITH {EMBEDDED} SELECT p_partkey AS item, 64 AS dims, round(coalesce(sum(x), 0), 6) AS total FROM part LEFT JOIN emb ON p_partkey = id GROUP BY 1")
def feat_align_catalog(spark, d):
    vectors = features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding")
    rows = features.aligned(table(spark, d, "part").select(F.col("p_partkey").alias("item")), vectors, 64)
    return rows.select("item", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _profiles(spark, d):
    vectors = features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding")
    train, test = training(spark, d)
    seen = history.seen_pairs(train)
    return features.profiles(seen, vectors), vectors.withColumnRenamed("id", "item"), seen, test


@query(f"WITH {PROFILE} SELECT uid, pos, round(x, 6) AS value FROM prof")
def content_user_profile(spark, d):
    return _listed(_profiles(spark, d)[0].withColumnRenamed("user", "id"), zeros=True).withColumnRenamed("id", "uid")


@query(f"""WITH {PROFILE}, s AS (SELECT uid, id AS iid, round(list_dot_product(pv.v, ev.v), 6) AS score FROM pv CROSS JOIN ev)
SELECT uid, iid, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.uid ORDER BY score DESC, s.iid::VARCHAR) AS rank FROM s ANTI JOIN seen ON s.uid = seen.uid AND s.iid = seen.iid) WHERE rank <= 10""")
def content_knn_topk(spark, d):
    users, items, seen, _ = _profiles(spark, d)
    inside = seen.join(items.select("item"), "item", "left_semi").select("user", "item")
    return top_by_dot(users, items, 10, spare=inside).select(F.col("user").alias("uid"), F.col("item").alias("iid"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PROFILE}, {NUMERIC}, nv AS (SELECT id, [n0::DOUBLE, n1::DOUBLE] AS v FROM num),
 qm AS (SELECT uid, avg(n0) AS a, avg(n1) AS b FROM seen JOIN num ON iid = id GROUP BY uid), qv AS (SELECT uid, [a / sqrt(a * a + b * b), b / sqrt(a * a + b * b)] AS v FROM qm WHERE a <> 0 OR b <> 0),
 s AS (SELECT u.uid, nv.id AS iid, round((coalesce(list_dot_product(pv.v, ev.v), 0) + coalesce(list_dot_product(qv.v, nv.v), 0)) / (CASE WHEN pv.uid IS NULL THEN 0 ELSE 1 END + CASE WHEN qv.uid IS NULL THEN 0 ELSE 1 END), 6) AS score
       FROM (SELECT DISTINCT uid FROM seen) u CROSS JOIN nv LEFT JOIN ev ON ev.id = nv.id LEFT JOIN pv ON pv.uid = u.uid LEFT JOIN qv ON qv.uid = u.uid WHERE pv.uid IS NOT NULL OR qv.uid IS NOT NULL)
SELECT uid, iid, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.uid ORDER BY score DESC, s.iid::VARCHAR) AS rank FROM s ANTI JOIN seen ON s.uid = seen.uid AND s.iid = seen.iid) WHERE rank <= 10""")
def late_fusion_topk(spark, d):
    from ..models.content import late_fusion

    part, given = table(spark, d, "part"), table(spark, d, "embeddings")
    catalog = part.select(F.col("p_partkey").alias("item"))
    parts = {
        "embedding": features.aligned(catalog, features.embedding(given, "vec_id", "embedding"), 64).withColumnRenamed("item", "id"),
        "numerical": features.numerical(part, "p_partkey", ["p_size", "p_retailprice"]),
    }
    seen = training_pairs(spark, d)[0].select("user", "item")
    users, items = late_fusion(seen, parts)
    return top_by_dot(users, items, 10, spare=seen).select(F.col("user").alias("uid"), F.col("item").alias("iid"), "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH seg AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos FROM (SELECT DISTINCT coalesce(c_mktsegment, '__missing__') AS v FROM customer)),
 med AS (SELECT coalesce(median(c_acctbal), 0) AS m FROM customer), fil AS (SELECT c_custkey AS id, coalesce(c_acctbal, m) AS b FROM customer, med), mom AS (SELECT avg(b) AS a, stddev_pop(b) AS s FROM fil),
 f AS (SELECT c_custkey AS id, pos, 1.0::DOUBLE AS x FROM customer JOIN seg ON coalesce(c_mktsegment, '__missing__') = v UNION ALL SELECT id, (SELECT count(*) FROM seg), sign((b - a) / CASE WHEN s = 0 THEN 1 ELSE s END) FROM fil, mom),
 n AS (SELECT id, sqrt(sum(x * x)) AS n FROM f GROUP BY id) SELECT * FROM (SELECT id, pos, round(x / n, 6) AS value FROM f JOIN n USING (id)) WHERE value <> 0""")
def cold_start_user_vector(spark, d):
    users = table(spark, d, "customer")
    return _listed(features.early_fusion(features.blocks(users, "c_custkey", {"categorical": ["c_mktsegment"], "numerical": ["c_acctbal"]})))


@query(f"""WITH {EMBEDDED}, s AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 6) AS w FROM ev a JOIN ev b ON a.id <> b.id)
SELECT src, dst, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst::VARCHAR) AS rank FROM s) WHERE rank <= 10""")
def item_knn_graph(spark, d):
    return _graph(spark, d)


def _graph(spark, d):
    vectors = features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding")
    near = top_by_dot(vectors.withColumnRenamed("id", "user"), vectors.withColumnRenamed("id", "item"), 10, exclude_self=True)
    return near.select(F.col("user").alias("src"), F.col("item").alias("dst"), F.col("score").alias("w"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PROFILE} SELECT t.uid, t.iid, round(coalesce(list_dot_product(pv.v, ev.v), 0), 6) AS score FROM test t LEFT JOIN pv ON pv.uid = t.uid LEFT JOIN ev ON ev.id = t.iid")
def score_pairs_dot(spark, d):
    users, items, _, test = _profiles(spark, d)
    rows = test.join(users.withColumnRenamed("vec", "a"), "user", "left").join(items.withColumnRenamed("vec", "b"), "item", "left")
    return rows.select(F.col("user").alias("uid"), F.col("item").alias("iid"), F.round(F.coalesce(dot(F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("score"))


EDGES = f"{SPLIT}, e AS (SELECT uid, iid FROM train), du AS (SELECT uid, count(*) AS d FROM e GROUP BY 1), di AS (SELECT iid, count(*) AS d FROM e GROUP BY 1), w AS (SELECT uid, iid, 1 / sqrt(du.d * di.d) AS w FROM e JOIN du USING (uid) JOIN di USING (iid))"
START = "start AS (SELECT node, pos, ((abs(id) * 31 + pos * 17 + k) % 101) / 101.0::DOUBLE AS x FROM (SELECT 'u' || uid AS node, uid AS id, 7 AS k FROM du UNION ALL SELECT 'i' || iid, iid, 0 FROM di), (SELECT unnest(range(2)) AS pos))"
BOTH = "bi AS (SELECT 'u' || uid AS src, 'i' || iid AS dst, sum(w) AS w FROM w GROUP BY 1, 2 UNION ALL SELECT 'i' || iid, 'u' || uid, sum(w) FROM w GROUP BY 1, 2)"


def _edges(spark, d):
    return training(spark, d)[0].select("user", "item")


def _start_at(node, pos, k):
    return F.pmod(F.abs(node) * 31 + pos * 17 + k, F.lit(101)) / 101.0


def _start(edges):
    """Fixed numbers in place of trained vectors: two positions for each node."""
    users = edges.select(F.concat(F.lit("u"), F.col("user").cast("string")).alias("node"), F.col("user").alias("id"), F.lit(7).alias("k")).distinct()
    items = edges.select(F.concat(F.lit("i"), F.col("item").cast("string")).alias("node"), F.col("item").alias("id"), F.lit(0).alias("k")).distinct()
    nodes = users.unionByName(items).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return nodes.select("node", "pos", _start_at(F.col("id"), F.col("pos"), F.col("k")).alias("x"))


@query(f"WITH {EDGES} SELECT 'user' AS side, uid AS node, d FROM du UNION ALL SELECT 'item', iid, d FROM di")
def bipartite_degrees(spark, d):
    e = _edges(spark, d)
    return graph.degrees(e, "user").select(F.lit("user").alias("side"), "node", "d").unionByName(graph.degrees(e, "item").select(F.lit("item").alias("side"), "node", "d"))


@query(f"WITH {EDGES} SELECT uid, iid, round(w, 6) AS w FROM w")
def bipartite_sym_weights(spark, d):
    return graph.symmetric_weights(_edges(spark, d)).select(F.col("user").alias("uid"), F.col("item").alias("iid"), F.round("w", 6).alias("w"))


@query(f"WITH {EDGES}, {START}, {BOTH} SELECT dst AS node, pos, round(sum(w * x), 6) AS x FROM bi JOIN start ON src = node GROUP BY 1, 2")
def propagate_one_hop(spark, d):
    e = _edges(spark, d)
    return graph.propagate(graph.bipartite(graph.symmetric_weights(e)), _start(e)).select("node", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH {EDGES}, {START}, {BOTH}, l1 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM bi JOIN start ON src = node GROUP BY 1, 2), l2 AS (SELECT dst AS node, pos, sum(w * x) AS x FROM bi JOIN l1 ON src = node GROUP BY 1, 2)
SELECT node, pos, round(sum(x) / 3, 6) AS x FROM (SELECT * FROM start UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY 1, 2""")
def lightgcn_two_layer_mean(spark, d):
    pairs = training_pairs(spark, d)[0].select("user", "item", "n")
    users, items = (pairs.select(side).distinct().select(side, *[_start_at(F.col(side), F.lit(pos), k).alias(f"x{pos}") for pos in (0, 1)]) for side, k in (("user", 7), ("item", 0)))
    users, items = graph.mean_of_sides(pairs, users, items, 2, kept)
    nodes = users.select(F.concat(F.lit("u"), F.col("user").cast("string")).alias("node"), "x0", "x1").unionByName(items.select(F.concat(F.lit("i"), F.col("item").cast("string")).alias("node"), "x0", "x1"))
    return nodes.select("node", F.posexplode(F.array("x0", "x1")).alias("pos", "x")).select("node", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"""WITH {EDGES}, qu AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM du) WHERE p = round_even(0.95::DOUBLE * (n - 1), 0)),
 qi AS (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS p, count(*) OVER () AS n FROM di) WHERE p = round_even(0.95::DOUBLE * (n - 1), 0))
SELECT uid, iid FROM e JOIN du USING (uid) JOIN di USING (iid) WHERE du.d <= (SELECT d FROM qu) AND di.d <= (SELECT d FROM qi)""")
def freedom_degree_denoise(spark, d):
    return graph.without_hubs(_edges(spark, d), keep=kept).withColumnsRenamed({"user": "uid", "item": "iid"})


@query(f"""WITH {EDGES}, act AS (SELECT iid, d, sum(d * (d - 1)) OVER (ORDER BY d, iid ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (ORDER BY d, iid) AS r FROM di WHERE d >= 2 AND d <= 500),
 keep AS (SELECT iid, d FROM act WHERE spent <= 5000000 OR r = 1), s AS (SELECT a.uid AS src, b.uid AS dst, round(sum(1.0::DOUBLE / (d * d)), 6) AS w FROM keep JOIN e a USING (iid) JOIN e b USING (iid) WHERE a.uid <> b.uid GROUP BY 1, 2)
SELECT src, dst, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rank FROM s) WHERE rank <= 10""")
def user_cooccurrence_topk(spark, d):
    edges = _edges(spark, d).select(F.col("user").alias("left"), F.col("item").alias("right"))
    return graph.co_occurrence_top(edges, 10, 500, 5_000_000, 6).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {EMBEDDED}, s AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v), 6) AS w FROM ev a JOIN ev b ON a.id <> b.id),
 g AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst::VARCHAR) AS rank FROM s) WHERE rank <= 10), o AS (SELECT src AS node, count(*) AS d FROM g GROUP BY 1)
SELECT g.src, g.dst, round(1 / sqrt(greatest(a.d, 1) * greatest(coalesce(b.d, 0), 1)), 6) AS w FROM g JOIN o a ON a.node = src LEFT JOIN o b ON b.node = dst""")
def src_degree_edge_weight(spark, d):
    return graph.source_weights(kept(_graph(spark, d).select("src", "dst"))).withColumn("w", F.round("w", 6))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS r FROM v)
SELECT id, round((exp(r) + exp(-r)) / 2, 6) AS head, true AS returns FROM n""")
def lorentz_exp_log_roundtrip(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v")).withColumn("p", lorentz_exp(F.col("v")))
    far = F.aggregate(F.zip_with(lorentz_log(F.col("p")), F.col("v"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return v.select("id", F.round(F.col("p")[0], 6).alias("head"), (far < 1e-6).alias("returns"))
