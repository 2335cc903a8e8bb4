"""Personal data, contamination, quality, language model, packing, against brute force or held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewise.llm import decontaminate, lm_scoring, packing, pii, quality


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, row long, id string")


ODD = [(900, None), (901, ""), (902, " \n "), (903, "x"), (None, "no id but text"), (904, "word " * 40000), (903, "x")]


def plain_patterns(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_patterns_equal_plain_expressions():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1.1.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "+", "-", " ", "x", "é", "123456789012345", "a.b+c@d-e.f.g@h.i", "00.0.0.000255", "()"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert pii.pattern_spans(text) == plain_patterns(text), text


def test_field_finds_what_patterns_miss_and_leaves_other_numbers():
    field = pii.trained()
    hit = total = wrong = 0
    for text, spans in pii.examples(77, 300):
        got = set(field.added(text, pii._TRIGGER.finditer(text), []))
        hit, total, wrong = hit + len(got & set(spans)), total + len(spans), wrong + len(got - set(spans))
    assert hit >= 0.97 * total and wrong <= 0.03 * total


def test_written_out_addresses_without_digits(spark):
    """Every form, in a text that has no digit, no "@" and, for some, no "dot"; with long hosts and in any case."""
    found = ["john [at] example.com", "jane (at) site.org", "john [AT] example.com", "jane AT example DOT com", "jane at averyveryverylonghostname dot com",
             "john [at] averyveryveryverylonghostname.example.com", "jane (at) mail (dot) example (dot) org", "jane [ at ] mail [ dot ] example [ dot ] com", "mary.of.the.long.long.name.here.and.there at example dot net"]
    rows = [(k, f"please write to {x} and wait") for k, x in enumerate(found)] + [(90, "look at the dots"), (91, "AT HOME"), (92, None)]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert got == {**{k: [("email", 16, 16 + len(x))] for k, x in enumerate(found)}, 90: [], 91: [], 92: []}


def test_find_pii(spark):
    texts = ["mail bob [at] site [dot] com or bob@site.com", "call (826) 555-4081", "nothing 1999-01-02", "ü 10.0.0.1 ok"]
    rows = [*enumerate(texts), *ODD]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for k, t in enumerate(texts):
        base = [(s["kind"], s["start"], s["end"]) for s in by[k]["base"]]
        assert base == plain_patterns(t)
        assert set(base) <= {(s["kind"], s["start"], s["end"]) for s in by[k]["spans"]}
    assert any(s["kind"] == "email" and texts[0][s["start"] : s["end"]] == "bob [at] site [dot] com" for s in by[0]["spans"])
    assert [s["kind"] for s in by[1]["spans"]] == ["phone"] and not by[2]["spans"]
    assert pii.find_pii(frame(spark, []).limit(0)).count() == 0


def hits_by_hand(docs, items):
    w = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = {}
    for i, t in items:
        x = w(t)
        n = min(13, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            windows.setdefault(tuple(x[k : k + n]), set()).add(i)
    lengths = {len(k) for k in windows}
    out = []
    for i, t in docs:
        x, hit, found = w(t), set(), set()
        for n in lengths:
            for k in range(len(x) - n + 1):
                if (g := tuple(x[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        out.append((i, len(x), len(hit), tuple(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(x)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontaminate(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["al", "be", "ça", "do", "em"]) + str(rng.randrange(rng.choice((3, 60))))
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 12, 13, 14, 30, 60))))) for k in range(25)] + [(90, ""), (91, None), (92, "!!"), (None, "left out")]
    docs = []
    for k in range(60):
        parts = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            source = rng.choice(items[:25])[1].split()
            a = rng.randrange(len(source))
            parts += source[a : a + rng.randint(1, 40)]
        docs.append((k, rng.choice((" ", "\n", ", ")).join(parts + [word() for _ in range(rng.randint(0, 30))]).title()))
    docs += ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r["id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in decontaminate.decontaminate(frame(spark, docs), bench).collect()]
    assert sorted(got, key=str) == hits_by_hand(docs, [x for x in items if x[0] is not None])


def test_decontaminate_empty(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, []).limit(0), bench).count() == 0
    rows = decontaminate.decontaminate(frame(spark, [(1, "a b c")]), bench.limit(0)).collect()
    assert rows[0]["n_hit"] == 0 and not rows[0]["contaminated"]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = quality.op8_quality(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert ((held["predicted"] == held["quality"]).mean()) > 0.95
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97


def test_quality_edges(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, None, 1)], "doc_id long, quality int, toxic int")
    rows = [(k, ("Good words stand here in a row. " if k % 2 else "BAD!! $$$ ### ") * (k + 1)) for k in range(40)] + ODD
    got = quality.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = quality.good_documents(frame(spark, rows), labels)
    assert kept.columns == ["doc_id", "text", "row", "id"]
    alone = quality.quality_scores(frame(spark, rows), labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}
    assert quality.quality_scores(frame(spark, []).limit(0), labels).count() == 0


def test_isotonic_rises():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 3, 1, 2, 4.0]), np.array([4, 4, 4, 4, 4.0]))
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()


def test_language_model(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(("the cat sat on", "a dog ran to", "le chat dort sur")) for _ in range(30))) for k in range(150)] + [r for r in ODD if r[0] != 904]
    monkeypatch.setattr(lm_scoring, "TABLE", 8)  # most words take the join
    got = lm_scoring.lm_scores(frame(spark, rows)).collect()
    text = lambda i: "" if i is None else str(i)
    train = Counter()
    for i, t in rows:
        if zlib.crc32(text(i).encode()) % 10:
            train.update([*(t or "").encode().lower().split(), b"\0end"])
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b"\0end"]
        want.append((text(i), zlib.crc32(text(i).encode()) % 10 == 0, len(w), sum(x in train for x in w), total, round(sum(math.log10((train[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)))
    assert sorted((text(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.lm_scores(frame(spark, []).limit(0)).count() == 0


def toy_model(rng):
    m = lm_scoring
    groups = m.TOP // m.MEMBERS
    draw = lambda *shape: rng.normal(0, 0.5, shape).astype(np.float32)
    return m.Model(draw(m.CLASSES), draw(groups, m.MEMBERS), draw(m.ROWS, m.CLASSES), draw(m.ROWS, m.MEMBERS))


def toy_history(rng, n):
    number, cls = rng.integers(-1, 2 * lm_scoring.TOP, n).astype(np.int32), rng.integers(0, lm_scoring.SUFFIXES, n)
    return lm_scoring.history(number, cls, np.array([0, n // 2, n])), number, cls


def test_probabilities_of_all_words_sum_to_one():
    """Over every class, and in it every member or, by counts, every other word and the unknown ones."""
    m, rng = lm_scoring, np.random.default_rng(1)
    model = toy_model(rng)
    features, _, _ = toy_history(rng, 40)
    total = np.zeros(40)
    for word in range(m.TOP):
        number = np.full(40, word, np.int32)
        target = m.class_of(number, np.zeros(40, np.int64))
        p, inner, _, q = m._forward(model, features, target, number)
        assert len(inner) == 40
        total += p[np.arange(40), target].astype(float) * q[:, word % m.MEMBERS]
    outside = np.full(40, -1, np.int32)
    for k in range(m.SUFFIXES):
        target = m.class_of(outside, np.full(40, k))
        counts = rng.integers(1, 9, 7)  # (c + 0.1) over N + 0.1 (V + 1), and one share for unknown words
        shares = np.append(counts + 0.1, 0.1) / (counts.sum() + 0.1 * 8)
        p, *_ = m._forward(model, features, target, outside)
        total += p[np.arange(40), target].astype(float) * shares.sum()
    assert np.abs(total - 1).max() < 1e-4


def test_a_gradient_step_equals_finite_differences():
    m, rng = lm_scoring, np.random.default_rng(2)
    model = toy_model(rng)
    for name in ("class_bias", "member_bias", "class_rows", "member_rows"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    features, number, cls = toy_history(rng, 60)
    target = m.class_of(number, cls)

    def loss():
        p, inner, _, q = m._forward(model, features, target, number)
        return -np.log(p[np.arange(60), target]).sum() - np.log(q[np.arange(len(inner)), number[inner] % m.MEMBERS]).sum()

    p, inner, rows, q = m._forward(model, features, target, number)
    p[np.arange(60), target] -= 1
    q[np.arange(len(inner)), number[inner] % m.MEMBERS] -= 1
    for table, uses, g in ((model.class_rows, features, p), (model.member_rows, rows, q)):
        step = np.zeros_like(table)
        for f in uses:
            m._descend(step, np.zeros(m.ROWS) - 9, f, g.astype(np.float32), 1.0)  # seen: undone below
        grad = np.zeros_like(table)
        for f in uses:
            np.add.at(grad, f, g)
            scale = 1 / np.sqrt(1 + np.bincount(f, minlength=m.ROWS))
            back = np.zeros_like(table)
            np.add.at(back, f, g)
            step += scale[:, None] * back
        assert np.abs(step).max() < 1e-4  # each step is the gradient of its rows, scaled by how often they were seen
        for row, k in zip(uses[0][:20], rng.integers(0, table.shape[1], 20)):
            held = table[row, k]
            table[row, k] = held + 1e-5
            up = loss()
            table[row, k] = held - 1e-5
            assert abs((up - loss()) / 2e-5 - grad[row, k]) < 1e-4
            table[row, k] = held


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    g = rng.normal(size=(500, 5)).astype(np.float32)
    starts = np.unique(np.append(rng.integers(0, 300, 120), 0))
    assert np.allclose(lm_scoring._sums(g, starts, np.diff(np.append(starts, 500))), np.add.reduceat(g, starts, axis=0), atol=1e-4)


def test_word_lookup_finds_every_word():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    table = lm_scoring.Words(h, np.ones(len(h), np.int64), np.zeros(len(h), np.int64))
    assert (table.look_up(h) == np.arange(len(h))).all()
    assert (table.look_up(rng.integers(1, 2**63, 1000, dtype=np.uint64) | np.uint64(1 << 63)) == -1).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()
    tk = Tokenizer.from_file(path)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(("naïve", "the", "'s", "\n\n", "42nd", "…", "don't", "  x", "<|endoftext|>")) for _ in range(rng.choice((0, 3, 50, 400))))) for k in range(80)] + ODD
    got = packing.pack(frame(spark, rows), tokenizer=path, size=64, with_ids=True).collect()
    want = []
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        for p, (at, n) in enumerate(packing.cut(len(ids), 64)):
            want.append((str(i), p, at, n, tuple(ids[at : at + n])))
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in got) == sorted(want)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(places) <= -(-sum(r["length"] for r in got) // 64) * 1.03 + 1
    assert packing.pack(frame(spark, []).limit(0), tokenizer=path).count() == 0


def test_packing_with_a_long_plan(spark, monkeypatch):
    """A plan that is joined by shuffle, in small blocks of ranks, gives the places of a broadcast one."""
    rng = random.Random(4)
    rows = [(k, " ".join(["word"] * rng.choice((0, 1, 5, 9, 40, 200)))) for k in range(150)]
    pack = lambda: sorted(map(tuple, packing.pack(frame(spark, rows), tokenizer=packing.public_vocabulary(), size=16).collect()))
    want = pack()
    monkeypatch.setattr(packing, "RANKS", 3)
    monkeypatch.setattr(packing, "PLAN_BROADCAST", 0)
    assert pack() == want and sum(r[3] == 16 for r in want) > 100


def test_fast_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = packing.public_vocabulary()
    encode, tk = packing.encoder(path), Tokenizer.from_file(path)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in [*texts, "", " ", "a  b\t\n c", "x" * 5000, " " * 3000 + "x", "日本語 😀 ’s 'll", "<|endoftext|>a"]:
        assert encode(t).tolist() == tk.encode(t, add_special_tokens=False).ids


def test_plan_fills_ranks_once():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(20)}
        ranges = packing.plan(counts, 50)
        for length, n in counts.items():
            ranks = sorted((lo, hi) for x, lo, hi, _, _ in ranges if x == length)
            assert ranks[0][0] == 0 and ranks[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))
