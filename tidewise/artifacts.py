"""Fitted models as Parquet tables and settings: saved generations, a writer's lock, and checkpoints of a fit.

Everything goes through Hadoop's file systems. A model is written into a folder of its own and told of last; a folder
without its last file, or whose files aren't those that it tells of, doesn't count.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .models.registry import KINDS
from .sources.shared import Folder

#: Seconds after which a writer's lock that nobody renewed is taken over.
STALE = 600.0
LOCK = ".lock"


def can_be_saved(model: Any) -> bool:
    return type(model).__name__ in KINDS and type(model) is KINDS[type(model).__name__]


def write_model(folder: Folder, at: str, model: Any) -> dict[str, Any]:
    """The model's tables under folder/at; what tells of them."""
    if not can_be_saved(model):
        raise ValueError(f"a {type(model).__name__} has no tables to save")
    told = {}
    for name, df in model.tables().items():
        folder.save(df, f"{at}/{name}")
        told[name] = {"schema": df.schema.jsonValue(), "files": folder.files(f"{at}/{name}")}
    return {"kind": type(model).__name__, "settings": model.settings(), "tables": told}


def read_model(folder: Folder, at: str, told: dict[str, Any]) -> Any:
    """The model that write_model told of; raises where its files aren't the same ones."""
    for name, table in told["tables"].items():
        if folder.files(f"{at}/{name}") != [list(f) for f in table["files"]]:
            raise ValueError(f"integrity check of {folder.path}/{at}/{name} failed")
    tables = {name: folder.table(f"{at}/{name}", T.StructType.fromJson(t["schema"])) for name, t in told["tables"].items()}
    return KINDS[told["kind"]].revived(tables, told["settings"])


def numbers_in(model: Any) -> int | None:
    """Numbers in a model's tables, but for ids; None for a model without tables."""
    if not can_be_saved(model):
        return None
    total = 0
    for df in model.tables().values():
        columns = [f for f in df.schema if f.name not in ("user", "item", "id", "i", "j")]
        each = [F.size(f.name) if isinstance(f.dataType, T.ArrayType) else F.lit(1) for f in columns]
        total += df.agg(F.sum(sum(each[1:], each[0]).cast("long"))).first()[0] or 0 if each else 0
    return total


@contextlib.contextmanager
def writing(folder: Folder, stale: float = STALE):
    """Holds the folder's lock. One that is older than `stale` seconds was left behind and is taken over."""
    mine = uuid.uuid4().hex
    while not folder.create(LOCK, mine):
        try:
            if folder.age(LOCK) <= stale:
                raise RuntimeError(f"{folder.path} is being written; its lock is {folder.age(LOCK):.0f} s old")
            aside = f"{LOCK}-{mine}"
            folder.rename(LOCK, aside)  # one of several that see it old succeeds
            folder.delete(aside)
        except RuntimeError:
            raise
        except Exception:  # another writer took it, or let it go, between two steps: look again
            time.sleep(0.1)
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            if folder.read(LOCK) == mine:
                folder.delete(LOCK)


def told_digest(told: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


class Checkpoints:
    """Models of one stage of a fit, by name, under a digest of all that they depend on."""

    def __init__(self, spark: SparkSession, folder: str, stage: str, depends: Any):
        digest = hashlib.sha256(json.dumps(depends, sort_keys=True, default=str).encode()).hexdigest()[:32]
        self.folder = Folder(spark, f"{folder}/{stage}-{digest}")

    def load(self, name: str) -> tuple[Any, dict[str, Any]] | None:
        if not self.folder.exists(f"{name}/told.json"):
            return None
        told = json.loads(self.folder.read(f"{name}/told.json"))
        try:
            return read_model(self.folder, name, told["model"]), told["row"]
        except ValueError:
            return None

    def save(self, name: str, model: Any, row: dict[str, Any]) -> None:
        if not can_be_saved(model) or self.folder.exists(name):
            return
        beside = f".{name}-{uuid.uuid4().hex}"
        told = {"model": write_model(self.folder, beside, model), "row": row}
        self.folder.write(f"{beside}/told.json", json.dumps(told, sort_keys=True))
        with contextlib.suppress(OSError):  # another fit published the same model first
            self.folder.rename(beside, name)
