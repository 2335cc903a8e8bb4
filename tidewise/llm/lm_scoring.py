"""A hashed maximum-entropy language model with a class-factored softmax, beside a smoothed unigram.

Tokens are lower-cased words and one end for each text. P(word | history) = P(class | history) P(word | class, history).
The TOP most frequent words fill classes of MEMBERS words, and a softmax chooses among a class's members; all other
words are in classes by their last two bytes, inside which they follow their smoothed counts. Both softmaxes have
weights for hashed features of the history: the last word, the one before it (a skip), and the pair of both.

Counts are exact over all training texts: tasks add up their words, and Spark adds up the tasks. Words are looked up in
a table of the at most TABLE most frequent ones, which is broadcast; the others are counted per text and joined with
their counts. Training runs in rounds over disjoint parts of the training texts: each task makes mini-batch gradient
steps over its part, and the tasks' changes are averaged, weighted by their tokens, by a tree of sums over blocks of weights. Scores are made in
numpy batches of one slice of texts each.

Nulls: a null text is empty (one end token); a null id counts as the text "" when folds are made, and is kept. Repeated
rows each get a row. An empty table gives an empty result; without training texts the model is uniform. Other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import fold
from .store import written
from .words import _LOWER, SPACED, mixed, text_slices, word_table

TOP, MEMBERS, SUFFIXES = 512, 32, 48
CLASSES = TOP // MEMBERS + SUFFIXES
#: Words that the broadcast table holds at most (12 bytes each, in twice as many slots).
TABLE = 1 << 20
#: Rows of hashed features in either weight table.
ROWS = 1 << 13
BLOCK, FAN_IN = 512, 32
SHORT_RUN = 8
#: Distinct words that a task gathers before it passes them on.
GATHER = 2_000_000
_END = np.uint64(0xE4D0000000000001)
_EMPTY = np.uint64(0)


def tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and suffix class of each token, ends included, and the number of tokens before each text."""
    words, _, ends, first = word_table(raw, at, SPACED)
    n = len(at) - 1
    last = _LOWER[raw[ends - 1]].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    two = np.where(ends >= 2, ends - 2, 0)
    before = np.where(SPACED[raw[two]] & (ends >= 2), _LOWER[raw[two]], 0).astype(np.int64) if len(ends) else last
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
    out, cls = np.full(len(words) + n, _END), np.zeros(len(words) + n, np.int64)
    out[place] = np.where(words == _EMPTY, np.uint64(1), words)
    cls[place] = (mixed((last * 256 + before).astype(np.uint64)) % np.uint64(SUFFIXES)).astype(np.int64)
    return out, cls, first + np.arange(n + 1)


def _count(batches):
    """(hash, cls, n): sums over the task, in pieces of about GATHER distinct words."""
    parts: list[tuple] = []
    held = 0

    def merged():
        h, c, n = (np.concatenate(x) for x in zip(*parts))
        u, where, back = np.unique(h, return_index=True, return_inverse=True)
        return u, c[where], np.bincount(back, weights=n).astype(np.int64)

    def out(u, c, n):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["hash", "cls", "n"])

    for batch in batches:
        for _, _, raw, at in text_slices(batch.column(0)):
            h, c, _ = tokens(raw, at)
            u, where, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, c[where], n))
            held += len(u)
            if held >= GATHER:
                parts = [merged()]
                held = len(parts[0][0])
                if held >= GATHER // 2:
                    yield out(*parts.pop())
                    held = 0
    if parts:
        yield out(*merged())


@dataclass
class Words:
    """The broadcast table, by open addressing: a word's number by falling count, or -1."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def __post_init__(self):
        bits = max(4, int(np.ceil(np.log2(len(self.hashes) * 2 + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(self.hashes), dtype=np.int32), self.hashes & self.mask
        while len(left):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = left[free]  # of several for one slot the last stays
            won = self.numbers[slot] == left
            self.keys[slot[won]] = self.hashes[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & self.mask

    def look_up(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        number = self.numbers[slot]
        odd = np.flatnonzero((self.keys[slot] != h) & (number >= 0))
        while len(odd):
            s = (slot[odd] + np.uint64(1)) & self.mask
            slot[odd] = s
            number[odd] = self.numbers[s]
            odd = odd[(self.keys[s] != h[odd]) & (self.numbers[s] >= 0)]
        return number


@dataclass
class Model:
    class_bias: np.ndarray  # (CLASSES,)
    member_bias: np.ndarray  # (TOP / MEMBERS, MEMBERS); -inf where a class has fewer
    class_rows: np.ndarray  # (ROWS, CLASSES)
    member_rows: np.ndarray  # (ROWS, MEMBERS)


def history(number: np.ndarray, cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each token's history: the last word, the skip, the pair. A text starts after two ends."""
    name = np.where((number >= 0) & (number < 4096), number, 4096 + cls).astype(np.uint64) + np.uint64(1)
    one, two = np.zeros(len(name), np.uint64), np.zeros(len(name), np.uint64)
    one[1:], two[2:] = name[:-1], name[:-2]
    starts = first[:-1]
    one[starts] = two[starts] = 0
    later = starts[np.diff(first) > 1] + 1
    two[later] = 0
    spread = lambda x: (mixed(x) & np.uint64(ROWS - 1)).astype(np.int16)
    return spread(one * np.uint64(3) + np.uint64(1)), spread(two * np.uint64(3) + np.uint64(2)), spread((one << np.uint64(20)) * np.uint64(3) + two)


def _member_rows(features, cls):
    """The rows of the members' table: the last word's and the skip's, for each class another."""
    shift = (cls * 2654435761).astype(np.int64)
    return [((f.astype(np.int64) * 31 + shift + k) & (ROWS - 1)).astype(np.int16) for k, f in enumerate(features[:2])]


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _forward(model: Model, features, which_class: np.ndarray, number: np.ndarray):
    logits = model.class_rows[features[0]]
    for f in features[1:]:
        logits += model.class_rows[f]
    logits += model.class_bias
    p_class = _softmax(logits)
    inner = np.flatnonzero((number >= 0) & (number < TOP))
    rows = _member_rows([f[inner] for f in features], which_class[inner])
    logits = model.member_rows[rows[0]]
    logits += model.member_rows[rows[1]]
    logits += model.member_bias[which_class[inner]]
    return p_class, inner, rows, _softmax(logits)


def class_of(number: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return np.where((number >= 0) & (number < TOP), number // MEMBERS, TOP // MEMBERS + cls)


def _sums(g: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: long runs as products with ones, short ones row by row for all runs at once."""
    total = np.empty((len(starts), g.shape[1]), np.float32)
    ones = np.ones(sizes.max(), np.float32)
    for k in np.flatnonzero(sizes > SHORT_RUN):
        total[k] = ones[: sizes[k]] @ g[starts[k] : starts[k] + sizes[k]]
    short = np.flatnonzero(sizes <= SHORT_RUN)
    at, left = starts[short], sizes[short]
    some = g[at]
    for d in range(1, SHORT_RUN):
        more = np.flatnonzero(left > d)
        if not len(more):
            break
        some[more] += g[at[more] + d]
    total[short] = some
    return total


def _descend(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    where, sizes = sorted_rows[starts], np.diff(np.append(starts, len(rows)))
    seen[where] += sizes
    change = _sums(g[order], starts, sizes)
    change *= (rate / np.sqrt(10 + seen[where])).astype(np.float32)[:, None]
    table[where] -= change


def _train(batches, words, model, rate: float, batch_tokens: int):
    """Mini-batch gradient steps over the task's texts; yields the change of each block of weights,
    and the tokens it saw as its weight."""
    words, start = words.value, model.value
    now = Model(start.class_bias, start.member_bias, start.class_rows.copy(), start.member_rows.copy())
    seen, inner_seen = np.zeros(ROWS), np.zeros(ROWS)
    trained = 0
    for batch in batches:
        for _, _, raw, at in text_slices(batch.column(0)):
            h, cls, first = tokens(raw, at)
            trained += len(h)
            number = words.look_up(h)
            every = history(number, cls, first)
            target = class_of(number, cls)
            for lo in range(0, len(h), batch_tokens):
                part = slice(lo, lo + batch_tokens)
                features, n = [f[part] for f in every], number[part]
                p, inner, rows, q = _forward(now, features, target[part], n)
                p[np.arange(len(p)), target[part]] -= 1
                for f in features:
                    _descend(now.class_rows, seen, f, p, rate)
                if len(inner):
                    q[np.arange(len(q)), n[inner] % MEMBERS] -= 1
                    for r in rows:
                        _descend(now.member_rows, inner_seen, r, q, rate)
    if trained:
        for kind, new, old in ((0, now.class_rows, start.class_rows), (1, now.member_rows, start.member_rows)):
            change = (new - old) * np.float32(trained)
            for k in range(0, ROWS, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([k], pa.int32()), pa.array([float(trained)]), pa.array([change[k : k + BLOCK].tobytes()], pa.binary())], names=["kind", "block", "weight", "change"])


def _summed(table):
    """Adds up a group of changes, of about FAN_IN by their keys' making."""
    total = np.zeros(0, np.float32)
    for raw in table.column("change"):
        x = np.frombuffer(raw.as_buffer(), np.float32)
        total = total + x if len(total) else x
    weight = pa.compute.sum(table.column("weight")).as_py()
    return pa.table({"kind": table.column("kind")[:1].combine_chunks(), "block": table.column("block")[:1].combine_chunks(), "weight": [weight], "change": pa.array([total.tobytes()], pa.binary())})


_CHANGE = "kind int, block int, weight double, change binary"


def _averaged(changes: DataFrame, tasks: int) -> list:
    """The mean change of each block: groups of about FAN_IN tasks' changes are added up, then groups of those."""
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        dealt = changes.withColumn("group", (F.pmod(F.xxhash64("task"), F.lit(tasks))).cast("int"))
        summed = dealt.groupBy("kind", "block", "group").applyInArrow(_summed, _CHANGE)
        changes = written(summed.withColumn("task", F.monotonically_increasing_id()), "changes")
    return changes.groupBy("kind", "block").applyInArrow(_summed, _CHANGE).toArrow().to_pylist()  # as many rows as blocks


def most_frequent(counts: DataFrame) -> Words:
    """The at most TABLE most frequent words, taken by a threshold on counts from a histogram of a fixed size."""
    bucket = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(((r["k"], r["m"]) for r in counts.groupBy(bucket.alias("k")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)  # 1,024 rows at most
    total, least = 0, None
    for k, m in histogram:
        if total + m > TABLE:
            break
        total, least = total + m, k
    some = counts.where(F.lit(False) if least is None else bucket >= least).select("hash", "n", "cls").toArrow()
    h, n, c = (some.column(k).to_numpy() for k in range(3))
    order = np.lexsort((h, -n))
    return Words(h[order].view(np.uint64), n[order], c[order])


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = 2, rate: float = 0.5, batch_tokens: int = 4096) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts in fold 0 of `folds` teach nothing. base_score is the log10 probability of the smoothed unigram, score the
    model's.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold(F.col(id_col), folds).alias("fold"))
    train = rows.where("fold <> 0")
    counts = written(train.select("text").mapInArrow(_count, "hash long, cls int, n long").groupBy("hash").agg(F.min("cls").alias("cls"), F.sum("n").alias("n")), "counts")
    sums = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # SUFFIXES rows
    total, distinct = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    words = most_frequent(counts)
    top_n, top_c = words.counts[:TOP], words.classes[:TOP]
    in_class = np.array([sums.get(k, (0, 0)) for k in range(SUFFIXES)], float).reshape(SUFFIXES, 2)
    for n, c in zip(top_n, top_c):
        in_class[c] -= (n, 1)
    groups = TOP // MEMBERS
    member = np.zeros(TOP)
    member[: len(top_n)] = top_n
    mass = np.concatenate([member.reshape(groups, MEMBERS).sum(1), in_class[:, 0] + 1])
    with np.errstate(divide="ignore"):
        bias = Model(
            np.maximum(np.log(mass / mass.sum()), -30).astype(np.float32),
            np.maximum(np.log(member.reshape(groups, MEMBERS)), -30).astype(np.float32),
            np.zeros((ROWS, CLASSES), np.float32),
            np.zeros((ROWS, MEMBERS), np.float32),
        )
    model, sent_words = bias, spark.sparkContext.broadcast(words)
    for k in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast(model)
        part = train.where(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds)) == k).select("text")
        changes = written(part.mapInArrow(lambda it: _train(it, sent_words, sent, rate, batch_tokens), _CHANGE).withColumn("task", F.spark_partition_id().cast("long")), "changes")
        tasks = changes.where("kind = 0 and block = 0").count()
        new = Model(model.class_bias, model.member_bias, model.class_rows.copy(), model.member_rows.copy())
        for r in _averaged(changes, tasks):
            table = new.member_rows if r["kind"] else new.class_rows
            table[r["block"] : r["block"] + BLOCK] += np.frombuffer(r["change"], np.float32).reshape(BLOCK, -1) / np.float32(r["weight"])
        model = new
    sent = spark.sparkContext.broadcast(model)
    log_unigram = np.log10(total + 0.1 * (distinct + 1))
    log_class = np.log10(in_class[:, 0] + 0.1 * (in_class[:, 1] + 1))

    def score(batches):
        known, m = sent_words.value, sent.value
        known_log = np.append(np.log10(known.counts + 0.1), 0.0)
        for batch in batches:
            n_tokens, n_known, base, full, rare_h, rare_n, rare_at = [], [], [], [], [], [], [0]
            for lo, hi, raw, at in text_slices(batch.column(2)):
                h, cls, first = tokens(raw, at)
                number = known.look_up(h)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                per = lambda x: np.bincount(owner, weights=x, minlength=hi - lo)  # noqa: B023, E731
                counted = known_log[number]  # 0 for the others, whose counts are joined later
                every, target = history(number, cls, first), class_of(number, cls)
                logp = np.empty(len(h))
                for a in range(0, len(h), batch_tokens):
                    part = slice(a, a + batch_tokens)
                    p, inner, _, q = _forward(m, [f[part] for f in every], target[part], number[part])
                    logp[part] = np.log10(np.maximum(p[np.arange(len(p)), target[part]], 1e-30))
                    logp[a + inner] += np.log10(np.maximum(q[np.arange(len(q)), number[part][inner] % MEMBERS], 1e-30))
                outer = (number < 0) | (number >= TOP)
                logp[outer] += counted[outer] - log_class[cls[outer]]
                n_tokens.append(np.diff(first))
                n_known.append(per((number >= 0).astype(float)).astype(np.int64))
                base.append(per(counted - log_unigram))
                full.append(per(logp))
                odd = np.flatnonzero(number < 0)
                order = np.lexsort((h[odd], owner[odd]))
                oh, oo = h[odd][order], owner[odd][order]
                new = np.flatnonzero(np.concatenate([[True], (oh[1:] != oh[:-1]) | (oo[1:] != oo[:-1])])) if len(oh) else np.zeros(0, np.int64)
                rare_h.append(oh[new])
                rare_n.append(np.diff(np.append(new, len(oh))))
                rare_at += (rare_at[-1] + np.cumsum(np.bincount(oo[new], minlength=hi - lo))).tolist()
            cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            rare = pa.StructArray.from_arrays([pa.array(cat(rare_h, np.uint64).view(np.int64)), pa.array(cat(rare_n, np.int64), pa.int64())], names=["hash", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.equal(batch.column(1), 0), *(pa.array(cat(x, np.int64), pa.int64()) for x in (n_tokens, n_known)), *(pa.array(cat(x, float)) for x in (base, full)), pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), rare)],
                names=["id", "held_out", "n_tokens", "n_known", "base", "full", "rare"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.select("id", "fold", "text").mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, full double, rare array<struct<hash: long, times: long>>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = (
        scored.select("row", F.explode("rare").alias("r"))
        .select("row", "r.*")
        .join(counts.select("hash", "n"), "hash", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("full") + more).alias("score")
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


#: A trained score is not expressible in SQL; tests hold the base score against brute force, the model against the base.
SQL: dict[str, str] = {}
