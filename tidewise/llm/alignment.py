"""Alignment of two tokenizers' encodings of the same texts.

Both encodings of a text cover the same bytes. Each byte gets a label: no token ends here, one of the first (A) does, one
of the second (B), or both. A regular expression cuts the label string into spans up to each "both" label, and the labels
in a span say how many tokens of each side form the group. A and B tokens that end together are linked: the last two of
each group. How often a pair of ids is linked in the whole corpus tells how good a link is.

Neither side's tokens cross from a visible ASCII character to a space. Texts are cut there, and of equal chunks of a slice
of texts one is encoded and aligned. Texts are encoded once, in tasks, and what later steps need is written to the shared folder. Of two tokens that end
together one is a suffix of the other, so the different pairs of ids are fewer than all tokens' bytes together (324,302
for the public vocabularies), however large the corpus: tasks add their links up before the shuffle, and the sums go
to the driver and to the tasks of the last step whole.

Nulls: null and empty texts have no tokens, nor has a text whose tokens, on either side, don't spell it; null ids are
kept. Repeated rows count each. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from .store import written
from .token_counts import SPACE, distinct_runs, public_model
from .words import text_slices

#: Labels of bytes: how many tokens end there, of A (1) and of B (2).
LABELS = np.frombuffer(b"-abx", np.uint8)
_SPANS = re.compile(rb"[^x]*x")
#: Bytes of text that are aligned together, and of chunks that are encoded by one call.
SLICE, JOINED = 1 << 22, 1 << 14


class Side:
    """A tokenizer: the ids of texts that begin with a space, and the bytes of each id."""

    def __init__(self, path: str, end: bytes):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda text: model.encode(text[1:] or "", num_threads=1)  # it adds the space itself
            pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
            tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.encode_special_tokens = True  # their strings in a text are ordinary text
            special = [t.content for t in plain.get_added_tokens_decoder().values()]
            fast = packing.encoder(path)
            self.ids = lambda text: plain.encode(text, add_special_tokens=False).ids if any(s in text for s in special) else fast(text)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
            of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
            vocabulary = {t: k for t, k in spec["model"]["vocab"].items()} | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            tokens = [b""] * (max(vocabulary.values()) + 1)
            for t, k in vocabulary.items():
                tokens[k] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.size, self.length = len(tokens), np.array([len(t) for t in tokens], np.int64)
        self.begin, self.raw = np.concatenate([[0], np.cumsum(self.length)])[:-1], np.frombuffer(b"".join(tokens), np.uint8)
        #: each id as digits with a comma, and after them each id with the sign that ends a list
        names = [str(k).encode() + e for e in (b",", end) for k in range(self.size)]
        self.digits = [n.ljust(8) for n in names]
        self.width = np.array([len(n) for n in names])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.raw[np.arange(n.sum()) + np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)]

    def encoded(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after the other, and whether each chunk's tokens spell it; those of others are left out.

        Chunks that end in a visible ASCII character are encoded JOINED bytes at a time, as the next one begins with a space.
        """
        ids, good, lo = [], np.ones(len(at) - 1, bool), 0
        closed = np.append((raw[at[1:] - 1] > 32) & (raw[at[1:] - 1] < 127), True)
        while lo < len(good):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + JOINED, "right")) - 1)
            open_ends = np.flatnonzero(~closed[lo:hi])
            hi = lo + int(open_ends[0]) + 1 if len(open_ends) else hi
            found = np.asarray(self.ids(raw[at[lo] : at[hi]].tobytes().decode()), np.int64)
            if np.array_equal(self.bytes_of(found), raw[at[lo] : at[hi]]):
                ids.append(found)
            elif hi == lo + 1:
                good[lo] = False
            else:
                for k in range(lo, hi):
                    one = np.asarray(self.ids(raw[at[k] : at[k + 1]].tobytes().decode()), np.int64)
                    good[k] = np.array_equal(self.bytes_of(one), raw[at[k] : at[k + 1]])
                    ids += [one] * bool(good[k])
            lo = hi
        return np.concatenate([np.zeros(0, np.int64), *ids]), good


@lru_cache(maxsize=4)
def side(path: str, end: bytes) -> Side:
    return Side(path, end)


def sides(first: str, second: str) -> tuple[Side, Side]:
    return side(first, b"|"), side(second, b";")


def spans(labels: np.ndarray) -> np.ndarray:
    """Where each group's span of a label string ends."""
    return np.cumsum(np.fromiter(map(len, _SPANS.findall(labels.tobytes())), np.int64))


def chunked(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks of texts begin, that neither side's tokens cross: at a space after a visible ASCII character.

    A pre-tokeniser's words take one space before them at most and none behind, and a piece has spaces only at its front.
    """
    cut = np.zeros(len(raw), bool)
    if len(raw):
        cut[1:] = (raw[1:] == 32) & (raw[:-1] > 32) & (raw[:-1] < 127)
        cut[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(cut)


class Aligned:
    """Aligned chunks: for each, tokens of each side, groups, and whether both sides spell it; and the groups of them all."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, a: Side, b: Side):
        (_, good_a), (_, good_b) = found = a.encoded(raw, at), b.encoded(raw, at)
        self.good, length = good_a & good_b, np.diff(at)
        (ids_a, ends_a), (ids_b, ends_b) = (self._kept(s, ids, good, length) for s, (ids, good) in zip((a, b), found))
        ends = np.zeros(int(length[self.good].sum()), np.uint8)
        ends[ends_a - 1] += 1
        ends[ends_b - 1] += 2
        group_ends = spans(LABELS[ends])
        self.upto_a, self.upto_b = (np.concatenate([[0], np.searchsorted(e, group_ends, "right")]) for e in (ends_a, ends_b))
        chunk_ends = np.cumsum(np.where(self.good, length, 0))
        self.groups = np.concatenate([[0], np.searchsorted(group_ends, chunk_ends, "right")])  # before each chunk
        self.n_a, self.n_b, self.n_groups = np.diff(self.upto_a[self.groups]), np.diff(self.upto_b[self.groups]), np.diff(self.groups)
        self.a, self.b, self.sides = ids_a, ids_b, (a, b)

    def _kept(self, side: Side, ids: np.ndarray, good: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of chunks that both sides spell, and where they end in those chunks' bytes."""
        ends = np.cumsum(side.length[ids])
        if not np.array_equal(good, self.good):
            chunk = np.flatnonzero(good)[np.searchsorted(np.cumsum(length[good]), ends, "left")]
            ids = ids[self.good[chunk]]
            ends = np.cumsum(side.length[ids])
        return ids, ends

    def links(self) -> np.ndarray:
        """Of each group the ids that end together, its last ones, as a * size of B + b."""
        return self.a[self.upto_a[1:] - 1] * self.sides[1].size + self.b[self.upto_b[1:] - 1]

    def written(self) -> list[bytes]:
        """For each chunk, its groups as decimal ids, each with its sign: a1,a2|b1;a3|b2,b3;"""
        a, b = self.sides
        of_a, of_b = self.a.copy(), self.b + 2 * a.size
        of_a[self.upto_a[1:] - 1] += a.size
        of_b[self.upto_b[1:] - 1] += b.size
        order = np.empty(len(of_a) + len(of_b), np.int64)  # A's of a group before B's
        order[np.arange(len(of_a)) + np.repeat(self.upto_b[:-1], np.diff(self.upto_a))] = of_a
        order[np.arange(len(of_b)) + np.repeat(self.upto_a[1:], np.diff(self.upto_b))] = of_b
        width = np.concatenate([a.width, b.width])[order]
        table = np.frombuffer(b"".join([*a.digits, *b.digits]), np.uint8).reshape(-1, 8)
        raw = table[order][np.arange(8) < width[:, None]].tobytes()
        before = np.concatenate([[0], np.cumsum(width)])[(self.upto_a + self.upto_b)[self.groups]].tolist()
        return [raw[p:q] for p, q in zip(before[:-1], before[1:])]


def _spaced(column: pa.Array) -> pa.Array:
    """Texts with a space before each that isn't empty."""
    column = pc.fill_null(column, "")
    return pc.if_else(pc.equal(column, ""), column, pc.binary_join_element_wise(" ", column, ""))


def _aligned(batches, first: str, second: str, with_groups: bool):
    a, b = sides(first, second)
    for batch in batches:
        for lo, hi, raw, at in text_slices(_spaced(batch.column(1)), SLICE):
            begin = chunked(raw, at)
            length, own, which = distinct_runs(raw, begin)
            sizes = length[own]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            found = Aligned(raw[np.arange(starts[-1]) + np.repeat(begin[own] - starts[:-1], sizes)], starts, a, b)
            names, codes, first_of = found.written(), found.links(), np.searchsorted(begin, at)
            numbers = np.zeros((hi - lo, 3), np.int64)
            links, times, hashes, groups = [], [], [], []
            for k in range(hi - lo):
                chunks = which[first_of[k] : first_of[k + 1]]
                if len(chunks) and not found.good[chunks].all():
                    chunks = chunks[:0]
                text = b"".join(map(names.__getitem__, chunks.tolist()))[:-1]
                n = found.n_groups[chunks]
                numbers[k] = found.n_a[chunks].sum(), found.n_b[chunks].sum(), n.sum()
                before = np.cumsum(n) - n
                code, count = np.unique(codes[np.arange(numbers[k, 2]) + np.repeat(found.groups[chunks] - before, n)], return_counts=True)
                links.append(code.astype("<i8").tobytes())
                times.append(count.astype("<i4").tobytes())
                hashes.append(hashlib.sha256(text).hexdigest() if text else "")
                if with_groups:
                    groups.append(text.decode())
            columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(numbers[:, k]) for k in range(3)), pa.array(hashes, pa.string()), pa.array(links, pa.binary()), pa.array(times, pa.binary())]
            fields = ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(groups, pa.string())] if with_groups else columns, names=[*fields, "groups"] if with_groups else fields)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries, and where each row's begin."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate([np.zeros(0, kind), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _added(batches):
    """The links of a task, added up: the different pairs of ids are few, whatever it reads."""
    codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        code, times = _numbers(batch.column(0), "<i8")[0], _numbers(batch.column(1), "<i4")[0]
        codes, back = np.unique(np.concatenate([codes, code]), return_inverse=True)
        sums = np.bincount(back, np.concatenate([sums, times]), len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["code", "n"])


def link_counts(aligned: DataFrame, second: str) -> DataFrame:
    """(a, b, n, best): how often two ids are linked in all texts, and whether no id is linked to b more often."""
    size = side(second, b";").size
    sums = aligned.select("links", "times").mapInArrow(_added, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = sums.select(F.expr(f"code div {size}").alias("a"), (F.col("code") % size).alias("b"), "n")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, *, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, groups_sha256, links and times (the different linked pairs of
    ids, a * size of B's vocabulary + b, and how often each is linked), and with_groups the groups themselves."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, times binary" + ", groups string" * with_groups
    return written(rows.mapInArrow(lambda it: _aligned(it, first, second, with_groups), schema), "aligned")


def with_link_scores(aligned: DataFrame, counts: DataFrame, second: str) -> DataFrame:
    """What align gave, with n_links, n_best and count_sum in the place of its links; counts: as link_counts gives them."""
    size = side(second, b";").size
    pairs = counts.select((F.col("a") * size + F.col("b")).alias("code"), "n", "best").toArrow()  # bounded by the vocabularies
    order = np.argsort(pairs.column("code").to_numpy(), kind="stable")
    known = aligned.sparkSession.sparkContext.broadcast(tuple(pairs.column(c).to_numpy()[order] for c in ("code", "n", "best")))
    own = [c for c in aligned.columns if c not in ("links", "times")]

    def scored(batches):
        codes, counts, best = known.value
        for batch in batches:
            code, at = _numbers(batch.column("links"), "<i8")
            times = _numbers(batch.column("times"), "<i4")[0].astype(np.int64)
            k = np.searchsorted(codes, code)
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            sums = [upto(times), upto(times * best[k]), upto(times * counts[k])] if len(codes) else [np.zeros(batch.num_rows, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(x, pa.int64()) for x in sums)], names=[*own, "n_links", "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in own)
    return aligned.mapInArrow(scored, f"{fields}, n_links long, n_best long, count_sum long")


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    first, second = packing.public_vocabulary(), public_model()
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), first=first, second=second)
    found = with_link_scores(aligned, link_counts(aligned, second), second)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


#: Tokenising is not expressible in SQL; the query is tested against a brute-force version.
SQL: dict[str, str] = {}
