"""Exact copies, near copies and repeated lines, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewise.llm import exact_dedup, line_dedup, minhash_dedup
from tidewise.llm.links import components

SCHEMA = "doc_id long, text string, id string, row long, key long, n long, dropped long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet sed ut quis nisi magna velit esse aute irure culpa".split()) + rng.choice("abcdefgh") for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(k, " ".join(words(rng, rng.choice((2, 5, 40, 120))))) for k in range(60)]
    for k in range(60, 120):
        base = rng.choice(rows[:20])[1].split()
        for _ in range(rng.randint(0, 5)):
            base[rng.randrange(len(base))] = words(rng, 1)[0]
        rows.append((k, rng.choice((" ", "  ", "\n")).join(base)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "ä" * 3), (207, "long " * 30000), (5, rows[5][1]), (5, rows[5][1])]
    return rows


def exact_by_hand(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = {}
    for norm, members in groups.items():
        members.sort()
        for m in members:
            out[m[3]] = (rows[members[0][3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return sorted((rows[k][0] if rows[k][0] is not None else -1, *v) for k, v in out.items())


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = [r for r in corpus() if not (weak and r[0] == 5)] + [(None, "only here")]
    kwargs = {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1)} if weak else {}  # one hex digit: the bytes decide
    got = exact_dedup.exact_dedup(frame(spark, rows).repartition(5), files_per_batch=2, **kwargs).collect()
    want = exact_by_hand(rows)
    assert sorted((-1 if r["id"] is None else r["id"], r["keep_id"], r["group_size"]) for r in got) == [w[:3] for w in want]
    assert sum(r["kept"] for r in got) == len({w[3] for w in want})
    if not weak:
        assert sorted((-1 if r["id"] is None else r["id"], r["digest"]) for r in got) == sorted((w[0], w[3]) for w in want)


def test_exact_dedup_across_calls(spark, tmp_path):
    """Later arrivals meet the state of earlier ones, whose bytes are read at their locators."""
    rows = [r for r in corpus() if r[0] != 5]
    parts, home = (rows[:70], rows[70:120], rows[120:]), f"{tmp_path}/a state"
    got = []
    for n, part in enumerate(parts):
        frame(spark, part).repartition(3).write.parquet(f"{tmp_path}/part {n}")
        docs = spark.read.parquet(f"{tmp_path}/part {n}")
        got.append([tuple(r) for r in exact_dedup.exact_dedup(docs, state=home).select("id", "keep_id", "group_size", "digest", "kept").collect()])
        so_far = {w[0]: w for w in exact_by_hand([r for p in parts[: n + 1] for r in p])}
        assert sorted(g[:4] for g in got[-1]) == sorted(so_far[i] for i, _ in part)
        assert all(g[4] == (g[0] == g[1]) for g in got[-1])
    assert any(g[1] in {i for i, _ in parts[0]} for g in got[1])
    first = [tuple(r) for r in exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/part 0")).select("id", "keep_id", "group_size").collect()]
    assert sorted(first) == sorted(g[:3] for g in got[0])  # a call of its own starts afresh
    with pytest.raises(ValueError, match="stronger digest"):
        weak = {"digest": lambda c: F.substring(F.sha2(c, 256), 1, 1), "state": f"{tmp_path}/weak"}
        for n in range(2):
            exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/part {n}"), **weak)


def test_exact_dedup_of_a_batch_that_failed(spark, tmp_path, monkeypatch):
    """Rows that arrived before a call failed count once when it is run again, also after it succeeded."""
    frame(spark, [(1, "a b"), (2, "ab"), (3, "c"), (None, None)]).write.parquet(f"{tmp_path}/docs")
    docs, home = spark.read.parquet(f"{tmp_path}/docs"), f"{tmp_path}/state"
    call = lambda name: sorted((str(r["id"]), r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, state=home, batch=name).collect())
    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "run_stream", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            call("monday")
    want = [("1", 1, 2), ("2", 1, 2), ("3", 3, 1), ("None", None, 1)]
    assert call("monday") == want and call("monday") == want
    assert [x[2] for x in call("tuesday")] == [4, 4, 2, 2]


def test_exact_dedup_deals_out_frequent_digests(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}") for k in range(3000)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"]) for r in got) == [w[:3] for w in exact_by_hand(rows)]


def near_by_hand(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    rows = corpus()
    got = minhash_dedup.near_duplicates(frame(spark, rows + [(None, "no id here at all")]), width=width, percent=percent).collect()
    assert len(got) == len(rows) + 1
    want = near_by_hand(rows, width, percent)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got if r["id"] is not None} == want
    assert all(r["kept"] == (r["id"] is None or r["id"] == r["component_id"]) for r in got)
    assert len({v[1] for v in want.values()}) < len(want) - 5


def test_near_duplicates_of_a_large_family(spark):
    rng = random.Random(8)
    base = words(rng, 150)
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    got = minhash_dedup.near_duplicates(frame(spark, rows), width=3, percent=85).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_hand(rows, 3, 85)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (7, 3)]
    roots = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


def similar_lines(spark, texts, similarity=0.8):
    """Pairs of texts by edit distance, all with all: shared trigrams only rule out what no edits could bring about."""
    import numpy as np

    grams = np.zeros((len(texts), 4096), np.float32)
    for k, t in enumerate(texts):
        for g in zip(t, t[1:], t[2:]):
            grams[k, hash(g) % 4096] += 1
    size = np.array([len(t) for t in texts])
    pairs = []
    for a in range(len(texts)):
        longer = np.maximum(size[a], size[:a])
        most = np.floor((1 - similarity) * longer + 1e-9)
        shared = np.minimum(grams[a], grams[:a]).sum(1)  # an edit changes three trigrams at most
        pairs += [(a, int(b)) for b in np.flatnonzero((np.abs(size[a] - size[:a]) <= most) & (shared >= longer - 2 - 3 * most))]
    table = spark.createDataFrame([(a, b, texts[a], texts[b], int((1 - similarity) * max(size[a], size[b]) + 1e-9)) for a, b in pairs], "a int, b int, x string, y string, most int")
    return [tuple(r) for r in table.where(F.levenshtein("x", "y") <= F.col("most")).select("a", "b").collect()]


def lines_by_hand(spark, rows, similarity=0.8):
    """The lines to drop of each document, and those of them that aren't exact repeats."""
    first = defaultdict(list)
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(t.split("\n")):
            norm = re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", line.encode().lower()).strip(b" ").decode()
            if norm:
                first[norm].append((i, k))
    texts = list(first)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in similar_lines(spark, texts, similarity):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    groups = defaultdict(list)
    for k, t in enumerate(texts):
        groups[find(k)].append(t)
    out, fuzzy = defaultdict(list), set()
    for members in groups.values():
        for i, k in sorted(x for t in members for x in first[t])[1:]:
            out[i].append(k)
        fuzzy |= set(sorted(min(first[t]) for t in members)[1:])
    return {i: sorted(v) for i, v in out.items()}, fuzzy


def test_fuzzy_lines(spark):
    rng = random.Random(5)
    pool = [" ".join(words(rng, rng.choice((3, 6, 60, 300)))) for _ in range(30)]
    rows = []
    for k in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            w = lines[0].split()
            w[rng.randrange(len(w))] = "changed"
            lines[0] = " ".join(w).upper() + "!"
        rows.append((k, "\n".join(lines)))
    rows += [(50, None), (51, ""), (52, "\n\n!!\n"), (53, pool[0] + "\n" + pool[0].title() + ".")]
    found = line_dedup.fuzzy_lines(frame(spark, rows))
    got = {r["id"]: r for r in found.collect()}
    want, fuzzy = lines_by_hand(spark, rows)
    assert len(fuzzy) > 10
    assert {i: list(r["dropped"]) for i, r in got.items() if r["dropped"]} == want
    assert {i: r["n_lines"] for i, r in got.items()} == {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}
    clean = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(frame(spark, rows), found).collect()}
    for i, t in rows:
        assert clean[i] == (t if t is None or i not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_lines_with_one_changed_word_meet(spark):
    """Plain edit similarity is all that counts: no SimHash, no blocks."""
    rng = random.Random(8)
    rows, alike = [], set()
    for k in range(240):
        base = words(rng, (3, 4, 5, 6, 7, 10, 20, 50)[k % 8])
        copy, at = list(base), rng.randrange(len(base))
        copy[at : at + 1] = [[f"other{k}"], [], [copy[at], "new"], [copy[at][:-1] + "z"]][k // 8 % 4]
        base, copy = " ".join(base), " ".join(copy)
        rows += [(2 * k, base), (2 * k + 1, copy)]
        if edit_distance(base, copy) <= int(0.2 * max(len(base), len(copy)) + 1e-9):
            alike.add(2 * k + 1)
    got = {r["id"] for r in line_dedup.fuzzy_lines(frame(spark, rows)).collect() if r["dropped"]}
    assert len(alike) > 150 and alike <= got
    for i in got - alike:
        text = rows[i][1]
        assert any(edit_distance(text, x) <= int(0.2 * max(len(text), len(x)) + 1e-9) for j, x in rows if j != i)


def test_recall_of_lines_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, fuzzy = lines_by_hand(spark, rows)
    got = {(r["id"], k) for r in line_dedup.fuzzy_lines(docs).collect() for k in r["dropped"]}
    every = {(i, k) for i, v in want.items() for k in v}
    assert len(fuzzy) > 30 and got <= every
    assert every - got <= fuzzy and len(fuzzy & got) >= 0.9 * len(fuzzy)


def test_lines_that_differ_in_three_words_share_a_block():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (24, 60, 700):
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        two = rng.permutation(np.concatenate([one[1:], rng.integers(0, 2**63, 2).astype(np.uint64)]))  # one word less, two more
        sims, sizes = line_dedup.block_simhashes(np.concatenate([one, two]), np.repeat([0, 1], [n, n + 1]), 2)
        assert (sims[0] == sims[1]).any() and sizes.sum() == 2 * n + 1


def test_edits_within_a_bound():
    rng = random.Random(6)
    for _ in range(400):
        a = "".join(rng.choice("abcä") for _ in range(rng.choice((0, 1, 3, 20, 90))))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(("", "x", "ba"))
        b = "".join(b)
        d = edit_distance(a, b)
        assert [line_dedup.within_edits(a, b, most) for most in (d - 1, d, d + 3)] == [False, True, True]


def test_edits_of_many_pairs_at_once():
    rng = random.Random(7)
    pairs = [("", ""), ("", "abc"), ("abcdef", "abcdef"), ("x", "y" * 70)]
    for _ in range(300):
        a = "".join(rng.choice("abcd é漢😀") for _ in range(rng.choice((1, 5, 63, 64, 65, 128, 130, 200))))
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choice(("", "x", "ba"))
        pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
    one, two = [a for a, _ in pairs], [b for _, b in pairs]
    want = [edit_distance(a, b) for a, b in pairs]
    for similarity in (0.5, 0.8, 1.0):
        near = [d <= int((1 - similarity) * max(len(a), len(b)) + 1e-9) for d, (a, b) in zip(want, pairs)]
        assert line_dedup.near_pairs(one, two, similarity).tolist() == near
    assert line_dedup.near_pairs([], [], 0.8).tolist() == []
    for band in (0, 5, 31, 64, 130, 300):
        some = [k for k, (a, b) in enumerate(pairs) if a and b and abs(len(a) - len(b)) <= band]
        got = line_dedup._distances([one[k] for k in some], [two[k] for k in some], band)
        assert all(d == want[k] if want[k] <= band else d >= want[k] for k, d in zip(some, got))


def test_keys_that_several_tasks_hold(spark, monkeypatch):
    import numpy as np

    from tidewise.llm import links

    monkeypatch.setattr(links, "GATHER", 50)  # at the driver, which makes the function that tasks get
    rng = random.Random(4)
    rows = [(rng.choice((0, 0, rng.randrange(400))), k) for k in range(600)] + [(7, 5), (7, 5), (10**6, 3), (10**6, 3)]
    held = spark.createDataFrame(rows, "key long, id long").repartition(5)
    got = [tuple(r) for r in links.shared_keys(held, lambda x: (np.asarray(x.column(0)).view(np.uint64), np.asarray(x.column(1))), 600).collect()]
    ids = defaultdict(set)
    for k, i in rows:
        ids[k].add(i)
    assert sorted(got) == sorted({(k, i) for k, i in rows if len(ids[k]) > 1})


def test_simhash_counts_long_lines(spark):
    import numpy as np

    from tidewise.llm.line_dedup import simhashes

    rng = np.random.default_rng(0)
    w = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    begin, n = np.array([0, 10, 700]), np.array([10, 690, 1300])
    bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    want = [np.packbits(2 * bits[b : b + k].sum(0) > k).view(np.uint64)[0] for b, k in zip(begin, n)]
    assert simhashes(w, begin, n).tolist() == [int(x) for x in want]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert line_dedup.fuzzy_lines(none).count() == 0
