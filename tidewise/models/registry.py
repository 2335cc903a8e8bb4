"""The models by name. Each has fit(data) and scores users against the catalog as tables.

A model gets Data: train (user, item, ts), catalog (item), blocks {modality: (id, vec)}. It offers
recommend(users, seen, k) with (user, item, rank, score), and score(pairs, seen) with (user, item, score). With a fourth
parameter exclude_seen, seen may be only a profile, and its items are candidates too.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dot, norm
from ..operators import features, history, itemcf
from ..operators.nearest import top_by_dot
from .ann import graph_search, ivf, ivfpq, lsh
from .content import late_fusion
from .factors import FactorModel
from .graph_models import BM3, DRAGON, FREEDOM, LATTICE, MGCN, MMGCN, LGMRec, LightGCN


@dataclass
class Data:
    train: DataFrame
    catalog: DataFrame
    blocks: dict[str, DataFrame] = field(default_factory=dict)
    user_blocks: dict[str, DataFrame] = field(default_factory=dict)


class Saved:
    """A model that is tables and settings: `saved` names the attributes that are tables, `kept` those that are plain."""

    saved: tuple[str, ...] = ()
    kept: tuple[str, ...] = ()

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.saved}

    def settings(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in self.kept if hasattr(self, name)}

    @classmethod
    def revived(cls, tables: dict[str, DataFrame], settings: dict[str, Any]):
        model = cls.__new__(cls)
        for name, value in {**settings, **tables}.items():
            setattr(model, name, value)
        return model


class Popularity(Saved):
    saved = ("counts",)

    def fit(self, data: Data):
        self.counts = history.popularity(data.train)
        return self

    def recommend(self, users: DataFrame, seen: DataFrame, k: int, exclude_seen: bool = True) -> DataFrame:
        return history.popular_unseen(users, self.counts, seen if exclude_seen else seen.limit(0), k).select("user", "item", "rank", "score")

    def score(self, pairs: DataFrame, seen: DataFrame) -> DataFrame:
        return pairs.join(self.counts.select("item", "score"), "item", "left").select("user", "item", F.coalesce("score", F.lit(0.0)).alias("score"))


class ItemCF(Saved):
    saved, kept = ("near", "popular"), ("most", "history")

    def __init__(self, max_neighbors: int = itemcf.NEIGHBOURS, max_history_per_user: int = itemcf.HISTORY):
        self.most, self.history = max_neighbors, max_history_per_user

    def fit(self, data: Data):
        capped = itemcf.capped_history(data.train.join(data.catalog, "item", "left_semi"), self.history)
        self.near, self.popular = itemcf.neighbours(capped, self.most).persist(), itemcf.history_popularity(capped)
        return self

    def recommend(self, users: DataFrame, seen: DataFrame, k: int, exclude_seen: bool = True) -> DataFrame:
        return itemcf.recommend(users, seen, self.near, self.popular, k, exclude=seen if exclude_seen else seen.limit(0)).select("user", "item", "rank", "score")

    def score(self, pairs: DataFrame, seen: DataFrame) -> DataFrame:
        return itemcf.score_pairs(pairs, seen, self.near, self.popular)


class VectorModel(Saved):
    """Users and items as vectors, ranked by dot product; users without a vector get the popular items."""

    saved = ("counts", "users", "items")

    def fit(self, data: Data):
        self.counts = history.popularity(data.train)
        self._vectors(data)
        return self

    def _vectors(self, data: Data) -> None:
        raise NotImplementedError

    def user_vectors(self, seen: DataFrame) -> DataFrame:
        return self.users

    def _top(self, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
        return top_by_dot(users, self.items, k, digits=9, spare=seen).select("user", "item", "rank", "score")

    def recommend(self, users: DataFrame, seen: DataFrame, k: int, exclude_seen: bool = True) -> DataFrame:
        wanted = users.select("user").distinct()
        known = self.user_vectors(seen).join(wanted, "user", "left_semi")
        mine = seen.join(wanted, "user", "left_semi") if exclude_seen else seen.limit(0)
        cold = wanted.join(known, "user", "left_anti")
        return self._top(known, mine, k).unionByName(history.popular_unseen(cold, self.counts, mine, k).select("user", "item", "rank", "score"))

    def score(self, pairs: DataFrame, seen: DataFrame) -> DataFrame:
        rows = pairs.join(self.user_vectors(seen).withColumnRenamed("vec", "_a"), "user", "left").join(self.items.withColumnRenamed("vec", "_b"), "item", "left").join(self.counts.select("item", F.col("score").alias("_p")), "item", "left")
        value = F.when(F.col("_a").isNull(), F.coalesce("_p", F.lit(0.0))).otherwise(F.coalesce(dot(F.col("_a"), F.col("_b")), F.lit(0.0)))
        return rows.select("user", "item", value.alias("score"))


class BPRMF(VectorModel):
    def __init__(self, **settings):
        self.model = FactorModel(**settings)

    def _vectors(self, data: Data) -> None:
        self.model.fit(data.train, data.catalog)
        self.users, self.items = self.model.users, self.model.items


class VBPR(VectorModel):
    def __init__(self, id_factors: int = 24, content_factors: int = 12, epochs: int = 3, learning_rate: float = 0.02, max_training_pairs: int | None = None, **settings):
        self.model = FactorModel(factors=id_factors, content_factors=content_factors, epochs=epochs, learning_rate=learning_rate, max_training_pairs=max_training_pairs, **settings)

    def _vectors(self, data: Data) -> None:
        fused = features.early_fusion(data.blocks)
        self.model.fit(data.train, data.catalog, fused.withColumnRenamed("id", "item"))
        self.users, self.items = self.model.users, self.model.items


class MultiModalItemKNN(VectorModel):
    """ann_backend: None for exact, or graph (also named hnsw), ivf, ivfpq or lsh; effective_backend says which ran.

    A user without a history is known by their own features, where there are some with as many dimensions as items have.
    """

    _ANN = {"ivf": ivf, "ivfpq": ivfpq, "lsh": lsh, "graph": graph_search}
    saved, kept = ("counts", "items", "cold"), ("backend", "topk", "effective_backend")

    def __init__(self, ann_backend: str | None = None, ann_topk: int = 100):
        ann_backend = "graph" if ann_backend == "hnsw" else ann_backend
        if ann_backend is not None and ann_backend not in self._ANN:
            raise ValueError(f"no backend {ann_backend!r}; there are {', '.join(self._ANN)}")
        self.backend, self.topk, self.effective_backend = ann_backend, ann_topk, ann_backend or "exact"

    def _vectors(self, data: Data) -> None:
        fused = features.early_fusion(data.blocks)
        self.items = fused.withColumnRenamed("id", "item").join(data.catalog, "item", "left_semi").persist()
        self.cold = data.train.select("user", F.array(F.lit(0.0)).alias("vec")).limit(0)
        if data.user_blocks:
            own = features.early_fusion(data.user_blocks).withColumnRenamed("id", "user")
            sizes = [df.agg(F.max(F.size("vec"))).first()[0] for df in (own, fused)]
            if sizes[0] != sizes[1]:
                raise ValueError(f"users have {sizes[0]} feature dimensions and items {sizes[1]}; profiles of users without a history need as many")
            self.cold = own.where(norm(F.col("vec")) > 0).persist()

    def user_vectors(self, seen: DataFrame) -> DataFrame:
        profiles = features.profiles(seen, self.items.withColumnRenamed("item", "id"))
        return profiles.unionByName(self.cold.join(profiles, "user", "left_anti"))

    def _top(self, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
        if not self.backend:
            return super()._top(users, seen, k)
        if k > self.topk:
            warnings.warn(f"{k} items are asked for, but {self.backend} looks at {self.topk} candidates; ann_topk sets how many", UserWarning, stacklevel=3)
        found = self._ANN[self.backend](users, self.items, max(k, self.topk)).join(seen, ["user", "item"], "left_anti")
        return history.top_k(found.drop("rank"), k).select("user", "item", "rank", "score")


class MultiModalLateFusionKNN(VectorModel):
    def tables(self) -> dict[str, DataFrame]:
        return {"counts": self.counts, "items": self.items, **{f"block{k}": self.blocks[n] for k, n in enumerate(sorted(self.blocks))}}

    def settings(self) -> dict[str, Any]:
        return {"names": sorted(self.blocks)}

    @classmethod
    def revived(cls, tables, settings):
        model = super().revived({n: tables[n] for n in ("counts", "items")}, {})
        model.blocks = {name: tables[f"block{k}"] for k, name in enumerate(settings["names"])}
        return model

    def _vectors(self, data: Data) -> None:
        if len(data.blocks) < 2:
            raise ValueError("late fusion needs two blocks of features")
        self.blocks = data.blocks
        self.items = late_fusion(data.train.select("user", "item").distinct(), data.blocks)[1].join(data.catalog, "item", "left_semi").persist()

    def user_vectors(self, seen: DataFrame) -> DataFrame:
        return late_fusion(seen, self.blocks)[0]


class GraphModel(VectorModel):
    """A graph model of the given kind; training ends early with the time limit, and goes on where progress was kept."""

    kept = ("early_stopped", "num_params")

    def __init__(self, kind: type, random_state: int = 42, time_limit: float | None = None, progress: str | None = None, **settings):
        self.model = kind(random_state=random_state, time_limit=time_limit, progress=progress, **settings)

    def _vectors(self, data: Data) -> None:
        self.model.fit(data.train.select("user", "item"), data.catalog, data.blocks)
        self.users, self.items = self.model.users, self.model.items
        self.early_stopped, self.num_params = self.model.early_stopped, self.model.num_params


#: Graph models by name.
GRAPH = {kind.__name__: kind for kind in (LightGCN, FREEDOM, MMGCN, LATTICE, BM3, MGCN, DRAGON, LGMRec)}


#: Models that can be written as tables, by name.
KINDS = {kind.__name__: kind for kind in (Popularity, ItemCF, BPRMF, VBPR, MultiModalItemKNN, MultiModalLateFusionKNN, GraphModel)}


@dataclass(frozen=True)
class Spec:
    name: str
    family: str
    needs_content: bool = False


class Registry:
    def __init__(self):
        self.factories: dict[str, Callable[..., Any]] = {
            "Popularity": Popularity, "ItemCF": ItemCF, "BPRMF": BPRMF, "MultiModalItemKNN": MultiModalItemKNN, "MultiModalLateFusionKNN": MultiModalLateFusionKNN, "VBPR": VBPR,
        }
        families = ("baseline", "collaborative", "latent-factor", "multimodal-content", "multimodal-late-fusion", "multimodal-ranking")
        content = ("MultiModalItemKNN", "MultiModalLateFusionKNN", "VBPR")
        self.specs = {n: Spec(n, f, n in content) for n, f in zip(self.factories, families)}
        for name, kind in GRAPH.items():
            self.factories[name] = partial(GraphModel, kind)
            self.specs[name] = Spec(name, "multimodal-graph" if kind.needs_content else "graph-collaborative", kind.needs_content)

    def register(self, name: str, factory: Callable[..., Any], overwrite: bool = False) -> None:
        if name in self.factories and not overwrite:
            raise ValueError(f"there is a model {name!r} already")
        self.factories[name], self.specs[name] = factory, Spec(name, "custom")

    def create(self, name: str, settings: dict[str, Any], **shared: Any):
        """A model with its settings, and those shared ones that its factory names."""
        if name not in self.factories:
            raise ValueError(f"no model {name!r}; there are {', '.join(sorted(self.factories))}")
        takes = inspect.signature(self.factories[name]).parameters
        return self.factories[name](**{**{k: v for k, v in shared.items() if k in takes}, **settings})


def dense_ranks(recs: DataFrame) -> DataFrame:
    """Ranks 1..n again after rows went."""
    return recs.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy("rank")))
