"""The prefix trie of conversations, against a plain trie and the query's SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.llm import conversation_trie as trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _plain(sequences: dict) -> list[tuple]:
    """All nodes of {conv_id: ((role, text), ...)}, straight from the definition."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(sequences[c]) == len(node)))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _rebuilt(turns: dict) -> dict:
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = tuple(turns.get(base, ())[:h]) + tuple(own[h:])
    return out


def _frame(spark, turns: dict, parts=3):
    rows = [(c, k, role, text, "x", 1) for c, own in turns.items() for k, (role, text) in enumerate(own)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth int").repartition(parts)


def _query(df):
    conv = F.col("conv_id")
    return trie.prefix_trie(trie.rebuilt(df, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9))


def _table(df) -> list[tuple]:
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_trie(spark, seed, monkeypatch):
    """Few different turns, so that nodes reach over several tasks; one conversation is repeated by a third of all."""
    monkeypatch.setattr(trie, "TURNS", 6 if seed % 2 else 40)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(seed)
    often = [("user", "é" * 3), ("assistant", "b")]
    turns = {c: often if rng.random() < 0.33 else [(rng.choice("ua"), rng.choice(["", "x", "yy"])) for _ in range(rng.randint(1, 6))] for c in rng.sample(range(-30, 200), 60)}
    df = _frame(spark, turns)
    assert _table(trie.prefix_trie(trie.turns(df))) == sorted(_plain({c: tuple(t) for c, t in turns.items()}), key=repr)
    if seed < 2:
        assert _table(_query(df)) == sorted(_plain(_rebuilt(turns)), key=repr)


def test_compressed_points_are_branches_and_ends():
    sequences = sorted([(1, 2, 3), (1, 2, 3, 4, 5), (1, 2, 7), (9,), ()])
    shared = [0] + [next((k for k, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q))) for p, q in zip(sequences, sequences[1:])]
    tree = trie.Points([len(s) for s in sequences], shared)
    found = sorted((sequences[lo][:d], int(hi - lo + 1)) for d, lo, hi in zip(tree.depth, tree.lo, tree.hi))
    assert found == [((), 5), ((1, 2), 3), ((1, 2, 3), 2), ((1, 2, 3, 4, 5), 1), ((1, 2, 7), 1), ((9,), 1)]
    assert [tree.order.index(v) < tree.order.index(p) for v, p in enumerate(tree.parent) if p >= 0] == [True] * 5


def test_nulls_ties_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, "user", "late"), (1, 0, None, None), (1, 0, "b", "same"), (1, 0, "b", "same"), (1, 0, "a", "tie"), (None, 1, "user", "nobody's"), (2, None, "user", "late"), (2, 0, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {1: (("user", "late"), ("", ""), ("a", "tie"), ("b", "same"), ("b", "same")), 2: (("user", "late"), ("", ""))}
    assert _table(trie.prefix_trie(trie.turns(df))) == sorted(_plain(want), key=repr)
    assert _table(_query(df.limit(0))) == []
    # every turn goes where it is a shared one that the base doesn't have: a turnless conversation ends at the root
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    lone = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], df.schema)
    assert _table(_query(lone)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_and_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{folder}/conversations.parquet'")
    want = con.execute(trie.SQL["op13_conversation_trie"])
    names = [x[0] for x in want.description]
    assert names == COLUMNS
    assert _table(trie.op13_conversation_trie(spark, f"/root/testdata/{folder}")) == sorted(want.fetchall(), key=repr)
