"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For byte-pair encoding without a pre-tokeniser, no merge of a text's encoding crosses the borders of its final tokens, so
an encoding less its last token is the encoding of the shorter text. A prefix therefore has exactly one last token t that
is a token by itself and may follow the last token before it, and its count is that of the shorter prefix plus t's. One
pass over a text so gives the counts of all its prefixes; truncations and budgets are then read from the table, and
nothing is encoded again.

Between two characters that stand side by side in no piece of the vocabulary nothing can merge. Texts are cut there, equal
chunks of a slice of texts are counted once, and all chunks advance by one character together in numpy; only chunks that
are longer than LONG go one by one. Tasks need no shuffle, and memory follows the slice (or the longest text).

Nulls: a null text is empty and has no tokens; null ids are kept. Repeated rows are counted each. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mixed, text_slices

SPACE = "▁"
#: Bytes of text that are counted together, and the longest chunk that advances together with others.
SLICE, LONG = 1 << 22, 48
_SLOTS = 1 << 20
_PROBES = ["", " ", "a", "  two  words ", "line\nline\ttab\r\n", "<s>x</s><0x0A>▁", "ﬁ① 　日本\U00013000\0", "Strasse, straße; été é 0123456789 ................"]


def distinct_runs(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that begin at `begin` and follow each other: their lengths, one run of each kind, and each run's kind."""
    length = np.diff(np.append(begin, len(values)))
    total = np.zeros(len(values) + 1, np.uint64)
    place = (np.arange(len(values)) - np.repeat(begin, length)).astype(np.uint64)
    np.cumsum(mixed(values.astype(np.uint64) + (place << np.uint64(21)) + np.uint64(1)), out=total[1:])
    _, own, which = np.unique(total[begin + length] - total[begin] + length.astype(np.uint64), return_index=True, return_inverse=True)
    if not np.array_equal(length, length[own][which]) or not np.array_equal(values, values[np.arange(len(values)) + np.repeat(begin[own][which] - begin, length)]):
        own = which = np.arange(len(begin))  # two runs of one hash: each is its own kind
    return length, own, which


def _utf8_length(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)


class PieceCounter:
    """Prefix counts under a SentencePiece BPE model with byte fallback that leaves texts as they are but for spaces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if not any(model.is_byte(k) for k in range(size)):
            raise ValueError(f"{path} has no byte fallback")
        self.text = [model.id_to_piece(k) for k in range(size)]
        self.score = {t: model.get_score(k) for k, t in enumerate(self.text) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
        self.size = size
        chars = sorted({c for t in self.score for c in t})
        self.char = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1,) * 2, bool)  # both characters, one after the other, are in some piece
        nodes, ids = {"": 0}, {}
        for k, t in enumerate(self.text):
            if t in self.score:
                ids[t] = k
                for n in range(1, len(t) + 1):
                    nodes.setdefault(t[:n], len(nodes))
                    if n > 1:
                        self.joins[self.char[ord(t[n - 2])], self.char[ord(t[n - 1])]] = True
        self.piece = np.full(len(nodes), -1, np.int64)  # of a node, or -1
        for t, k in ids.items():
            self.piece[nodes[t]] = k
        edges = sorted((nodes[t[:-1]] * (len(chars) + 1) + int(self.char[ord(t[-1])]), n) for t, n in nodes.items() if t)
        self.edge, self.to = (np.array(x, np.int64) for x in zip(*edges))
        self.next = dict(edges)
        self.made: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.slot_key, self.slot_ok = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)
        wrong = [t for t in _PROBES if self.counts([t])[0][-1:].tolist() != [len(model.encode(t))][: len(t)]]
        if wrong:
            raise ValueError(f"{path} is no BPE model that keeps texts as they are: {wrong[0]!r}")

    def _text(self, token: int) -> str:
        return self.text[token] if token < self.size else chr(token - self.size)

    def _merges(self, token: int) -> tuple | None:
        """The merges that make a token out of its characters, in order: (score, first symbol, last symbol) after each
        merge; None if they don't end in the token. Beyond the vocabulary, a token is a character."""
        if token not in self.made:
            parts = list(self._text(token))
            steps = [(0.0, parts[0], parts[-1])]
            while len(parts) > 1:
                best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score), default=None)
                if best is None:
                    break
                k = -best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                steps.append((best[0], parts[0], parts[-1]))
            self.made[token] = tuple(steps) if len(parts) == 1 else None
        return self.made[token]

    def follows(self, before: int, token: int) -> bool:
        """Whether two tokens side by side stay as they are; with before = -1, whether the token stays by itself.

        Both are built up merge by merge, the better one first (of equals the left one), as if side by side in a text.
        They stay if at no point a merge across their border would be better than both next ones.
        """
        right = self._merges(token)
        if before < 0 or right is None:
            return right is not None
        left, i, j = self._merges(before), 0, 0
        while True:
            x = left[i + 1][0] if i + 1 < len(left) else -np.inf
            y = right[j + 1][0] if j + 1 < len(right) else -np.inf
            across = self.score.get(left[i][2] + right[j][1])
            if across is not None and across > x and across >= y:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if i + 1 < len(left) and (x >= y or j + 1 == len(right)):
                i += 1
            else:
                j += 1

    def _follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        code = (before + 1) * (self.size + 0x110000) + token
        slot = (mixed(code.view(np.uint64)) & np.uint64(_SLOTS - 1)).astype(np.int64)
        ok, unknown = self.slot_ok[slot], np.flatnonzero(self.slot_key[slot] != code)
        if len(unknown):
            codes, at, back = np.unique(code[unknown], return_index=True, return_inverse=True)
            known = np.empty(len(codes), bool)
            for k, (c, b, t) in enumerate(zip(codes.tolist(), before[unknown[at]].tolist(), token[unknown[at]].tolist())):
                if c not in self.pairs:
                    if len(self.pairs) > 1 << 22:
                        self.pairs.clear()
                    self.pairs[c] = self.follows(b, t)
                known[k] = self.pairs[c]
            self.slot_key[slot[unknown[at]]], self.slot_ok[slot[unknown[at]]] = codes, known  # the last one of a slot stays
            ok[unknown] = known[back]
        return ok

    def _together(self, cps: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Counts at every character of chunks that begin at at[:-1]."""
        char, owner = self.char[cps].astype(np.int64), np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(cps)) - at[owner]
        cost = np.where(char > 0, 1, _utf8_length(cps))
        alone = np.flatnonzero(char == 0)
        found = [(alone, alone, self.size + cps[alone].astype(np.int64))]  # first and last character, token
        start, node, left = np.flatnonzero(char), np.zeros(np.count_nonzero(char), np.int64), at[1:][owner]
        n = 0
        while len(start):
            key = node * len(self.joins) + char[start + n]
            k = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            here = self.edge[k] == key
            if not n:  # a character that only longer pieces hold is a token too, in bytes
                lone = start[~here | (self.piece[self.to[k]] < 0)]
                cost[lone] = _utf8_length(cps[lone])
                found.append((lone, lone, self.size + cps[lone].astype(np.int64)))
            start, node = start[here], self.to[k[here]]
            token = self.piece[node]
            some = token >= 0
            found.append((start[some], start[some] + n, token[some]))
            n += 1
            on = start + n < left[start]
            start, node = start[on], node[on]
        first, last, token = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(place[last].astype(np.uint16), kind="stable")
        first, last, token = first[order], last[order], token[order]
        ends = np.searchsorted(place[last], np.arange(int(place.max(initial=-1)) + 2))
        held, count = np.full(len(cps), -1, np.int64), np.zeros(len(cps), np.int64)
        for p, q in zip(ends[:-1], ends[1:]):
            f, e, t = first[p:q], last[p:q], token[p:q]
            fresh = place[f] == 0
            ok = self._follow(np.where(fresh, -1, held[f - 1]), t)
            f, e, t, fresh = f[ok], e[ok], t[ok], fresh[ok]
            held[e] = t
            count[e] = np.where(fresh, 0, count[f - 1]) + np.where(t < self.size, 1, cost[f])
        return count

    def _singly(self, cps: np.ndarray) -> np.ndarray:
        """Counts at every character of one chunk."""
        chars, bytes_of, codes = self.char[cps].tolist(), _utf8_length(cps).tolist(), cps.tolist()
        width, held, count = len(self.joins), [-1] * (len(cps) + 1), [0] * (len(cps) + 1)
        many = self.size + 0x110000
        for k in range(len(chars)):
            before, node, n, known = held[k], 0, k, self.pairs
            one = self.next.get(chars[k], -1)
            if one < 0 or self.piece[one] < 0:
                token = self.size + codes[k]
                if self.follows(before, token):
                    held[k + 1], count[k + 1] = token, count[k] + bytes_of[k]
            while n < len(chars) and (node := self.next.get(node * width + chars[n], -1)) >= 0:
                n += 1
                token = int(self.piece[node])
                if token >= 0:
                    code = (before + 1) * many + token
                    ok = known.get(code)
                    if ok is None:
                        ok = known[code] = self.follows(before, token)
                    if ok:
                        held[n], count[n] = token, count[k] + 1
        return np.array(count[1:], np.int64)

    def chunks(self, cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts (characters, and where each text begins) as chunks: the first character of each, which distinct chunk it
        is, where each distinct chunk's counts begin, and those counts."""
        if not len(cps):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        char = self.char[cps]
        cut = np.empty(len(cps), bool)
        cut[0], cut[1:] = True, ~self.joins[char[:-1], char[1:]]
        cut[at[:-1][at[:-1] < len(cps)]] = True
        begin = np.flatnonzero(cut)
        length, own, which = distinct_runs(cps, begin)
        sizes = length[own]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        some = cps[np.arange(starts[-1]) + np.repeat(begin[own] - starts[:-1], sizes)]
        counts, short = np.zeros(len(some), np.int64), sizes <= LONG
        mask = np.repeat(short, sizes)
        counts[mask] = self._together(some[mask], np.concatenate([[0], np.cumsum(sizes[short])]))
        for k in np.flatnonzero(~short):
            counts[starts[k] : starts[k + 1]] = self._singly(some[starts[k] : starts[k + 1]])
        return begin, which, starts, counts

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the tokens of its first 1, 2, ... characters."""
        cps, at = characters(*_joined(texts))
        begin, which, starts, counts = self.chunks(cps, at)
        return [c[1:] for c in _spread(cps, at, begin, which, starts, counts)]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts as the model reads them: a space before each text that isn't empty, spaces by their
    own sign; and where each text begins."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    at = before[at]
    full = np.diff(at) > 0
    cps = np.insert(np.where(cps == 32, ord(SPACE), cps).astype(np.uint32), at[:-1][full], ord(SPACE))
    return cps, at + np.concatenate([[0], np.cumsum(full)])


def _spread(cps, at, begin, which, starts, counts) -> list[np.ndarray]:
    """For each text, the count at each of its characters, the space before it among them."""
    whole = counts[starts[1:] - 1][which] if len(which) else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(whole)])
    first = np.searchsorted(begin, at)
    length = np.diff(np.append(begin, len(cps)))
    index = np.arange(len(cps)) + np.repeat(starts[:-1][which] - begin, length) if len(cps) else np.zeros(0, np.int64)
    out = counts[index] + np.repeat(before[:-1], length)
    return [out[p:q] - before[k] for p, q, k in zip(at[:-1], at[1:], first)]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _counted(batches, path: str, limit: int, with_counts: bool):
    model = counter(path)
    for batch in batches:
        for lo, hi, raw, offsets in text_slices(batch.column(1), SLICE):
            cps, at = characters(raw, offsets)
            parts = model.chunks(cps, at)
            begin, which, starts, counts = parts
            whole = counts[starts[1:] - 1][which] if len(which) else np.zeros(0, np.int64)
            first = np.searchsorted(begin, at)
            before = np.concatenate([[0], np.cumsum(whole)])
            total = before[first[1:]] - before[first[:-1]]
            chars = np.maximum(np.diff(at) - 1, 0)
            fits, tables = chars.copy(), None
            if with_counts:
                tables = [t[1:] for t in _spread(cps, at, *parts)]
            for k in np.flatnonzero(total > limit):
                if tables is not None:
                    table = tables[k]
                else:
                    own, to = slice(first[k], first[k + 1]), at[k + 1]
                    table = _spread(cps[at[k] : to], np.array([0, to - at[k]]), begin[own] - at[k], which[own], starts, counts)[0][1:]
                fits[k] = int(np.flatnonzero(table <= limit)[-1]) + 1 if (table <= limit).any() else 0
            columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), chars, total, fits))]
            names = ["id", "n_bytes", "n_chars", "n_tokens", "chars_within"]
            if with_counts:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("counts")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def token_counts(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, with_counts: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_chars, n_tokens, and chars_within, the characters of the longest prefix
    of at most `limit` tokens. with_counts: also counts, the tokens of the first 1, 2, ... characters of the text, for
    tokens_of_prefix and prefix_within."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_chars long, n_tokens long, chars_within long" + ", counts array<int>" * with_counts
    return rows.mapInArrow(lambda it: _counted(it, tokenizer, limit, with_counts), schema)


def tokens_of_prefix(chars: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first `chars` characters (of the whole text if it has fewer), from a stored table."""
    n = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts)).cast("int")
    return F.when(n < 1, F.lit(0)).otherwise(F.try_element_at(counts, n)).cast("long")


def prefix_within(tokens: Column | int, counts: str = "counts") -> Column:
    """Characters of the longest prefix of at most `tokens` tokens, from a stored table. Counts may fall when a character
    more lets tokens merge, so it is the last prefix within the budget, not the first one beyond it."""
    budget = F.lit(tokens) if isinstance(tokens, int) else tokens
    ok = F.reverse(F.transform(counts, lambda c: c <= budget))
    at = F.array_position(ok, True)
    return F.when(at > 0, F.size(counts) - at + 1).otherwise(0).cast("long")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = token_counts(docs, tokenizer=public_model(), limit=4096)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "chars_within")


#: Tokenising is not expressible in SQL; the query is tested against the library itself, prefix by prefix.
SQL: dict[str, str] = {}
