"""Queries over trained models; SQL can't express them, tests check what must hold of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models.ann import graph_search, ivf, ivfpq, lsh, recall
from ..models.factors import FactorModel
from ..models.graph_models import BM3, DRAGON, FREEDOM, LATTICE, MGCN, MMGCN, LGMRec, LightGCN
from ..models.graph_training import behaviour_guidance, contrast_terms
from ..operators import features, history
from ..operators.nearest import top_by_dot
from .inputs import SPLIT, table
from .interaction_queries import training

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _recommended(model, seen):
    return top_by_dot(model.users, model.items, 10, spare=seen).select(F.col("user").alias("uid"), F.col("item").alias("iid"), "score", "rank")


@query
def bprmf_recommend(spark, d):
    train, _ = training(spark, d)
    return _recommended(FactorModel(epochs=3).fit(train, train.select("item").distinct()), history.seen_pairs(train))


@query
def vbpr_recommend(spark, d):
    train, _ = training(spark, d)
    catalog = train.select("item").distinct()
    vectors = features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding")
    model = FactorModel(factors=24, content_factors=12, epochs=3, learning_rate=0.02).fit(train, catalog, features.aligned(catalog, vectors, 64))
    return _recommended(model, history.seen_pairs(train))


def _vectors(spark, d):
    return features.embedding(table(spark, d, "embeddings"), "vec_id", "embedding")


def _searched(vectors):
    return vectors.withColumnRenamed("id", "user"), vectors.withColumnRenamed("id", "item")


def _ann(kind, spark, d):
    return kind(*_searched(_vectors(spark, d)), 10)


@query
def ann_ivf_topk(spark, d):
    return _ann(ivf, spark, d)


@query
def ann_ivfpq_topk(spark, d):
    return _ann(ivfpq, spark, d)


@query
def ann_lsh_topk(spark, d):
    return _ann(lsh, spark, d)


@query
def ann_graph_topk(spark, d):
    return _ann(graph_search, spark, d)


@query
def ann_graph_distances(spark, d):
    """How many vectors a graph search looks at, beside how many there are."""
    vectors = _vectors(spark, d)
    looked = graph_search(*_searched(vectors), 10, report=True)
    return looked.select("user", "distances", F.lit(vectors.count()).alias("items"))


@query
def ann_recall_vs_exact(spark, d):
    vectors = _vectors(spark, d)
    exact = top_by_dot(*_searched(vectors), 10)
    rows = [recall(exact, _ann(kind, spark, d)).withColumn("backend", F.lit(name)) for name, kind in (("graph", graph_search), ("ivf", ivf), ("ivfpq", ivfpq), ("lsh", lsh))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _graph(spark, d, kind, **settings):
    """Parts described by their vectors and by a one-hot of their brand; 8 factors and 2 epochs."""
    train, _ = training(spark, d)
    parts = table(spark, d, "part")
    content = {"embedding": _vectors(spark, d), "brand": features.categorical(parts, "p_partkey", ["p_brand"])} if kind.needs_content else {}
    model = kind(factors=8, epochs=2, **settings).fit(train, parts.select(F.col("p_partkey").alias("item")), content)
    return _recommended(model, history.seen_pairs(train))


@query
def lightgcn_recommend(spark, d):
    return _graph(spark, d, LightGCN)


@query
def freedom_recommend(spark, d):
    return _graph(spark, d, FREEDOM)


@query
def mmgcn_recommend(spark, d):
    return _graph(spark, d, MMGCN)


@query
def lattice_recommend(spark, d):
    return _graph(spark, d, LATTICE)


@query
def bm3_recommend(spark, d):
    return _graph(spark, d, BM3)


@query
def mgcn_recommend(spark, d):
    return _graph(spark, d, MGCN)


@query
def dragon_recommend(spark, d):
    return _graph(spark, d, DRAGON)


@query
def lgmrec_recommend(spark, d):
    return _graph(spark, d, LGMRec)


@query
def behaviour_guidance_by_user(spark, d):
    """How alike two views of a user's parts are: the halves of the parts' vectors stand for the views."""
    train, _ = training(spark, d)
    vec = _vectors(spark, d).select(F.col("id").alias("node"), "vec")
    first, second = (vec.select("node", F.slice("vec", at, 32).alias("vec")) for at in (1, 33))
    pairs = train.select(F.col("user").cast("long").alias("u"), F.col("item").cast("long").alias("i"))
    sums = behaviour_guidance(pairs, first, second, 32)
    both = F.aggregate(F.zip_with(F.slice("vec", 1, 32), F.slice("vec", 33, 32), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return sums.select(F.col("u").alias("uid"), F.col("m").cast("long").alias("m"), (F.round((both - F.col("own")) / (F.col("m") * F.col("m")), 6) + 0.0).alias("guidance"))


SQL["behaviour_guidance_by_user"] = f"""WITH {SPLIT},
 n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
 v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / norm) AS vec FROM n),
 t AS (SELECT uid, vec_id, vec FROM train JOIN v ON vec_id = iid),
 per_user AS (SELECT uid, count(*) AS m, sum(list_inner_product(vec[1:32], vec[33:64])) AS own FROM t GROUP BY uid),
 x AS (SELECT uid, unnest(range(1, 33)) AS pos, unnest(vec[1:32]) AS a, unnest(vec[33:64]) AS b FROM t),
 s AS (SELECT uid, pos, sum(a) AS a, sum(b) AS b FROM x GROUP BY uid, pos),
 p AS (SELECT uid, sum(a * b) AS both_sums FROM s GROUP BY uid)
SELECT uid, m, round((both_sums - own) / (m * m), 6) + 0.0 AS guidance FROM per_user JOIN p USING (uid)"""


@query
def contrast_by_vector(spark, d):
    """Of each vector's first half: its product with its own second half and the log-sum-exp with those of all vectors, and
    the same with halves exchanged; the contrastive loss is the mean of both less the own product."""
    import uuid

    from ..sources.shared import Folder, shared_folder

    folder = Folder(spark, f"{shared_folder(spark)}/tidewise-contrast/{uuid.uuid4().hex}")
    keep = lambda df: folder.save(df, uuid.uuid4().hex)
    vec = _vectors(spark, d).select(F.col("id").alias("node"), "vec")
    first, second = (vec.select("node", F.slice("vec", at, 32).alias("vec")) for at in (1, 33))
    terms = contrast_terms(vec.select("node"), first, second, 32, 0.5, keep)
    return terms.select(F.col("node").alias("vec_id"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("own", "row_lse", "column_lse")])


SQL["contrast_by_vector"] = """WITH h AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b FROM embeddings),
 u AS (SELECT vec_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS b FROM h),
 s AS (SELECT x.vec_id AS i, y.vec_id AS j, list_inner_product(x.a, y.b) / 0.5 AS p FROM u x CROSS JOIN u y),
 r AS (SELECT i, ln(sum(exp(p))) AS lse FROM s GROUP BY i), c AS (SELECT j, ln(sum(exp(p))) AS lse FROM s GROUP BY j)
SELECT r.i AS vec_id, round(s.p, 6) + 0.0 AS own, round(r.lse, 6) + 0.0 AS row_lse, round(c.lse, 6) + 0.0 AS column_lse FROM r JOIN c ON r.i = c.j JOIN s ON s.i = r.i AND s.j = r.i"""
