"""Best-fit packing of token sequences, planned on a histogram of lengths.

Tasks tokenise the texts and cut those longer than a sequence. Lengths are counted, at most `size` numbers reach the
driver, and best fit runs there over counts: of each length, from the longest, as many pieces as fit go into all open
sequences with the least sufficient room at once. The plan is a list of ranges: "of the pieces of this length, those
ranked a to b go to sequences s, s+1, ... at this offset". Pieces get their rank within their length from counts per
(length, bucket), and join the plan on length and block of RANKS ranks, so that no length, however common, lands in one
task in either step.

Nulls: a null text is empty (it still has the end token); a null id is kept. Repeated rows are packed each. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

PIECES_PER_BUCKET = 50_000
#: Ranges of a plan, cut at blocks of RANKS ranks; so many of them (48 bytes each) a join may broadcast. Longer plans are
#: shuffled by length and block, as the pieces are, and a task gets RANKS pieces of a block at most.
RANKS, PLAN_BROADCAST = 4096, 200_000
#: The GPT-2 pre-tokeniser's pattern, fixed by the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, as tokenizers.Tokenizer.from_file(path) gives them without special tokens.

    A plain byte-level BPE file whose merges come in the order of their ids is run by tiktoken, which is three times
    as fast and gives the same ids; any other file, and any text that holds a special token's string, is not.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    ids = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    plain = model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or made != sorted(made) or not made or made[0] < 256:
        return ids
    import tiktoken

    special = [t["content"] for t in spec.get("added_tokens", [])]
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return ids(text)
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except BaseException as e:  # its regex engine gives up on some very long runs, with a panic
            if "Panic" not in type(e).__name__ and not isinstance(e, ValueError):
                raise
            return ids(text)

    return encode


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: whole sequences, and what is over first."""
    if n <= size:
        return [(0, n)]
    over = n % size
    return [(0, over)] * bool(over) + [(k, size) for k in range(over, n, size)]


def _pieces(batches, path: str, size: int, end: int, with_ids: bool):
    encode = encoder(path)
    for batch in batches:
        texts, which, piece, start, length, crc, ids = batch.column(1), [], [], [], [], [], []
        for k in range(batch.num_rows):
            tokens = np.append(encode(texts[k].as_py() or ""), np.uint32(end))
            for i, (at, n) in enumerate(cut(len(tokens), size)):
                part = tokens[at : at + n].astype("<u4")
                for to, x in ((which, k), (piece, i), (start, at), (length, n), (crc, zlib.crc32(part.tobytes()))):
                    to.append(x)
                if with_ids:
                    ids.append(part.astype(np.int32))
        columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))] if with_ids else columns, names=[*names, "ids"] if with_ids else names)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths: (length, first rank, end rank, first sequence, offset).

    Sequences that hold the same lengths are one group (count, slots); a group splits when only some of it is filled.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, count: int, slots: tuple) -> None:
        if count:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((count, slots))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = size // length
                put(size - fit * length, left // fit, ((length, fit, None),))
                put(size - left % fit * length, int(left % fit > 0), ((length, left % fit, None),))
                break
            room = rooms[k]
            count, slots = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            fit = room // length
            whole = min(count, left // fit)
            put(room - fit * length, whole, ((length, fit, slots),))
            left -= whole * fit
            over = left if whole < count else 0  # fewer than fit
            if over:
                put(room - over * length, 1, ((length, over, slots),))
                left = 0
            put(room, count - whole - bool(over), slots)
    out, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for room in sorted(groups):
        for count, slots in groups[room]:
            chain = []
            while slots:
                ((length, times, slots),) = slots
                chain.append((length, times))
            offset = 0
            for length, times in reversed(chain):
                for _ in range(times):
                    out.append((length, rank[length], rank[length] + count, sequence, offset))
                    rank[length] += count
                    offset += length
            sequence += count
    return out


def pack(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Each text's ids are followed by the id `end`; only what is longer than `size` is cut.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = written(rows.mapInArrow(lambda it: _pieces(it, tokenizer, size, end, with_ids), schema), "pieces")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // PIECES_PER_BUCKET)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    per_bucket = written(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    slots = spark.createDataFrame(plan(counts, size) or [(0, 0, 0, 0, 0)], "p_length long, lo long, hi long, first_sequence long, offset long")
    before = per_bucket.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))
    block = lambda c: F.floor(c / RANKS)
    slots = slots.where("lo < hi").withColumn("p_block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    if len(counts) and slots.count() <= PLAN_BROADCAST:
        slots = F.broadcast(slots)
    takes = (F.col("length") == F.col("p_length")) & (block(F.col("rank")) == F.col("p_block")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    sequence = F.col("first_sequence") + F.col("rank") - F.col("lo")
    return ranked.join(slots, takes).select("id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", *["ids"] * with_ids)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer=public_vocabulary()).withColumnRenamed("id", "doc_id")


#: Tokenising is not expressible in SQL; the query is tested against a brute-force version.
SQL: dict[str, str] = {}
