"""Benchmark decontamination by winnowing.

A window is `window` words of an item in a row (a shorter item is one window as a whole). Documents and items are
fingerprinted alike: hashes of 8 words in a row, and of each 6 neighbouring hashes the smallest (the last of equals)
is kept, so any two texts that share 13 words in a row share a fingerprint inside that stretch. Items shorter than 13
words keep the hash of the whole item, and documents are asked for hashes of that length.

Documents' fingerprints are first tested against a bitmap of all items' fingerprints, whose size is fixed, then joined
with them by hash. A hit carries the words around it on both sides (5 before and after the 8), and is extended over
those that agree; what reaches 13 words is hit.

Nulls: a null text has no words; a null id is kept (documents) or left out (items). Rows with one id each get their own
result. An empty table of documents gives an empty result, an empty benchmark no hits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import ALNUM, gram_hashes, text_slices, word_hashes

GRAM = 8
#: Bits of the bitmap, 4 MB at any size of the benchmark; a full one only lets more through to the join.
BITMAP_BITS = 1 << 25


def fingerprints(words: np.ndarray, first: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of texts of hashed words: the kept positions, their hashes, and the words in a gram.

    first has the number of words before each text. Grams and windows never reach over a text's end.
    """
    gram = length if length < window else min(GRAM, window)
    span = length - gram + 1
    grams = gram_hashes(words, gram)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))  # of each word
    if len(words) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), gram
    if span == 1:
        at = np.flatnonzero(text[: len(grams)] == text[gram - 1 :])
        return at, grams[at], gram
    least, which = grams[: len(grams) - span + 1].copy(), np.zeros(len(grams) - span + 1, np.int64)
    for k in range(1, span):
        later = grams[k : len(grams) - span + 1 + k]
        take = later <= least
        least[take], which[take] = later[take], k
    whole = text[: len(least)] == text[length - 1 :]
    at = np.unique((np.arange(len(least)) + which)[whole])
    return at, grams[at], gram


def around(words: np.ndarray, first: np.ndarray, at: np.ndarray, gram: int, reach: int) -> np.ndarray:
    """The words from `reach` before each gram to `reach` after it; 0 where the text doesn't reach."""
    text = np.searchsorted(first, at, "right") - 1
    where = at[:, None] + np.arange(-reach, gram + reach)
    inside = (where >= first[text][:, None]) & (where < first[text + 1][:, None])
    out = words[np.clip(where, 0, len(words) - 1)] if len(words) else np.zeros(where.shape, np.uint64)
    return np.where(inside, np.where(out == 0, np.uint64(1), out), np.uint64(0))


_HIT = pa.struct([("length", pa.int32()), ("hash", pa.int64()), ("start", pa.int64()), ("around", pa.list_(pa.int64()))])


def _rows(batches, lengths: list[int], window: int, bitmap):
    """(id, n_words, hits) of each text; bitmap: hashes to look for, None for all; lengths: None for each text's own."""
    bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint64)
    for batch in batches:
        n_words, counts, parts = [], [], []
        for lo, hi, raw, at in text_slices(batch.column(1)):
            words, first = word_hashes(raw, at, ALNUM)
            size = np.diff(first)
            n_words.append(size)
            found = np.zeros(hi - lo, np.int64)
            keep = []
            own = np.unique(np.minimum(size, window)) if lengths is None else lengths
            for length in own[own > 0] if lengths is None else own:
                pos, hashes, gram = fingerprints(words, first, int(length), window)
                text = np.searchsorted(first, pos, "right") - 1
                ok = np.ones(len(pos), bool)
                if lengths is None:
                    ok &= np.minimum(size[text], window) == length
                if bits is not None:
                    slot = hashes & np.uint64(BITMAP_BITS - 1)
                    ok &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                pos, hashes, text = pos[ok], hashes[ok], text[ok]
                keep.append((text, np.full(len(pos), length), hashes, pos - first[text], around(words, first, pos, gram, int(length) - gram), pos))
            rows = [(t, int(n), h, s, a[i]) for ts, ns, hs, ss, a, _ in keep for i, (t, n, h, s) in enumerate(zip(ts, ns, hs, ss))]
            rows.sort(key=lambda r: (r[0], r[1], r[3]))
            for r in rows:
                found[r[0]] += 1
            counts.append(found)
            parts += rows
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        arounds = np.concatenate([r[4] for r in parts]).view(np.int64) if parts else np.zeros(0, np.int64)
        lens = np.concatenate([[0], np.cumsum([len(r[4]) for r in parts])]) if parts else np.zeros(1, np.int64)
        hits = pa.StructArray.from_arrays(
            [
                pa.array([r[1] for r in parts], pa.int32()),
                pa.array(np.array([r[2] for r in parts], np.uint64).view(np.int64)),
                pa.array([int(r[3]) for r in parts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(lens.astype(np.int32)), pa.array(arounds)),
            ],
            fields=list(_HIT),
        )
        words_in = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_in, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)], names=["id", "n_words", "hits"])


_SCHEMA = "n_words long, hits array<struct<length: int, hash: long, start: long, around: array<long>>>"


def _extended(batches, window: int):
    """From meetings (row, item, length, start, d_around, i_around) to the document's words that agree: (row, item, start, end)."""
    for batch in batches:
        out = {"row": [], "item": [], "start": [], "stop": []}
        lengths = np.asarray(batch.column(2))
        for length in np.unique(lengths):
            some = np.flatnonzero(lengths == length)
            part = batch.take(pa.array(some))
            n = len(some)
            doc, item = (np.asarray(part.column(k).flatten()).reshape(n, -1) for k in (4, 5))
            gram = int(length) if length < window else min(GRAM, window)
            reach = int(length) - gram
            same = (doc == item) & (doc != 0)
            core = same[:, reach : reach + gram].all(axis=1)
            left = np.logical_and.accumulate(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, reach + gram :], axis=1).sum(axis=1)
            ok = core & (left + gram + right >= length)
            start = np.asarray(part.column(3))
            for k, x in (("row", np.asarray(part.column(0))[ok]), ("start", (start - left)[ok]), ("stop", (start + gram + right)[ok])):
                out[k].append(pa.array(x, pa.int64()))
            out["item"].append(part.column(1).filter(pa.array(ok)))
        if len(lengths):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[k]) for k in out], names=list(out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, item_ids (array of strings, sorted), contaminated.

    A word is hit if it lies in an occurrence of an item's window. A document is contaminated if any word is hit and
    at least one in `share` is.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    kind = items.schema["id"].dataType.simpleString()
    prints = written(
        items.mapInArrow(lambda it: _rows(it, None, window, None), f"id {kind}, {_SCHEMA}").select("id", F.explode("hits").alias("h")).select("id", "h.*").distinct(), "item-prints"
    )
    lengths = sorted(r[0] for r in prints.select("length").distinct().collect())  # `window` values at most
    slot = F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))
    word, bit = F.shiftright(slot, 6).cast("int"), slot.bitwiseAND(F.lit(63)).cast("int")
    filled = prints.select(word.alias("word"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()  # BITMAP_BITS / 64 rows at most
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[filled["word"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(bitmap.tobytes())
    of_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = of_docs.schema["id"].dataType.simpleString()
    rows = written(of_docs.mapInArrow(lambda it: _rows(it, lengths, window, sent), f"id {kind}, {_SCHEMA}").withColumn("row", F.monotonically_increasing_id()), "document-prints")
    meet = (
        rows.select("row", F.explode("hits").alias("h"))
        .select("row", "h.*")
        .join(prints.select("length", "hash", F.col("id").cast("string").alias("item"), F.col("around").alias("i_around")), ["length", "hash"])
        .select("row", "item", "length", "start", F.col("around").alias("d_around"), "i_around")
    )
    spans = written(meet.mapInArrow(lambda it: _extended(it, window), "row long, item string, start long, stop long"), "spans")
    n_hit = spans.select("row", "start", "stop").distinct().select("row", F.explode(F.sequence("start", F.col("stop") - 1)).alias("word")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    of_row = spans.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    hit = F.coalesce("n_hit", F.lit(0))
    return (
        rows.select("row", "id", "n_words")
        .join(n_hit.join(of_row, "row"), "row", "left")
        .select("id", "n_words", hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"))
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, items)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = {
    "op7_decontaminate": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
     iw AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[k:k + least(len(words), 13) - 1], ' ') AS gram
            FROM i, LATERAL (SELECT unnest(generate_series(1, greatest(len(words) - 12, 1))) AS k) WHERE len(words) > 0),
     lens AS (SELECT DISTINCT n FROM iw),
     dw AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS gram FROM w, lens, LATERAL (SELECT unnest(generate_series(1, len(words) - n + 1)) AS k) WHERE len(words) >= n),
     hits AS (SELECT dw.doc_id, dw.n, dw.k, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.gram = iw.gram),
     hw AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS word FROM hits) GROUP BY 1),
     hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN hw ON w.doc_id = hw.doc_id LEFT JOIN hi ON w.doc_id = hi.doc_id"""
}
