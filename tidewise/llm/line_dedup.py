"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups.

A line is what stands between line feeds; normalised, it is its lower-cased words (letters, digits, all beyond ASCII)
with one space between. Lines without words stay. Equal normalised lines are one node (a 128-bit digest), so copies
never meet as pairs.

A line's SimHash has four blocks of 48 bits; each different word of the line votes in one block, which its hash picks. So
if the word sets of two lines differ in three words at most, one block at least is the same, and lines meet in equal
blocks (of BLOCK_WORDS words or more, as a block of one frequent word would be everyone's). A block has 48 bits so that
unrelated lines don't meet by accident in large tables. What this radius misses meets by runs of words: lines of up to
SHORT words in all words but one, those of less than HALVED words in their first or last half (so lines of SHORTEST words
or more that differ by one word always meet), and longer ones in their LEAST least-hashed runs of WIDTH words. Pairs that
meet are confirmed by edit similarity, 1 - distance / longer length, of 0.8 or more. Of each connected group the first
occurrence stays, by document id, then line number.

Recall, against edit distances of all pairs, is in the README and tested. Not sure to meet: lines of one or two words, and
lines with changes in almost every word. Pairs of lines of FAR_WORDS words or more whose SimHashes are more than FAR
bits of 192 apart are not looked at: about 1 in 100 of the pairs that meet and are similar, 9 in 10 of those that meet
and aren't (by a histogram of 28,000 and 84,000 such pairs).

Nulls: a null text has no lines (n_lines 0), a null id sorts last. An empty text has one line, without words. Repeated
rows are copies: the first one's lines stay. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import linked, shared_keys
from .store import BUCKETS, spare, written
from .words import ALNUM, _powers, gram_hashes, mixed, text_slices, word_table

BLOCKS, BLOCK_BYTES, BLOCK_WORDS = 4, 6, 3
FAR, FAR_WORDS = 44, 8
#: Words of the shortest lines that meet by their words; up to SHORT, without each of them; below HALVED, by halves.
SHORTEST, SHORT, HALVED, WIDTH, LEAST = 3, 5, 16, 4, 4
#: Keys of a line, about: what a bucket of the key join is sized by.
KEYS_PER_LINE = 8
BITMAP_BITS = 1 << 25
#: Pairs whose distances are found together: at most, characters of a side at most, fewer than what isn't worth it (for each
#: word of the band); edits of the first band.
TOGETHER, TOGETHER_CHARS, FEW, BAND = 2048, 1 << 21, 24, 31
_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


#: A byte's bits in the eight lanes of a 64-bit number, so that up to 255 bytes' bits add up at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhashes(words: np.ndarray, begin: np.ndarray, n_words: np.ndarray, n_bytes: int = 8) -> np.ndarray:
    """Of runs of words that stand side by side: each of 8 * n_bytes bits by the majority of the run's words."""
    pieces = -(-n_words // 255)
    first_piece = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    nth = np.arange(pieces.sum()) - np.repeat(first_piece, pieces)
    starts = np.repeat(begin, pieces) + 255 * nth
    by_byte = words.view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.add.reduceat(_LANES[by_byte[:, k]], starts).view(np.uint8).reshape(-1, 8) for k in range(n_bytes)], 1).reshape(len(starts), 8 * n_bytes)
    half = n_words // 2
    if len(starts) > len(begin):
        ones = np.add.reduceat(ones, first_piece, axis=0, dtype=np.int64)
    else:
        half = half.astype(np.uint8)
    out = np.zeros((len(begin), 8), np.uint8)
    out[:, :n_bytes] = np.packbits(ones > half[:, None], axis=1)
    return out.view(np.uint64).ravel()


def block_simhashes(words: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n lines: each block's bits (0 where no word votes) and the number of words that vote in it."""
    word, line = distinct_words(words, line, n)
    place = line * BLOCKS + (word >> np.uint64(38)).astype(np.int64)  # rises, as the words of a line do
    sizes = np.bincount(place, minlength=n * BLOCKS)
    full = np.flatnonzero(sizes)
    sims = np.zeros(n * BLOCKS, np.uint64)
    if len(full):
        sims[full] = simhashes(mixed(word + np.uint64(1)), (np.cumsum(sizes) - sizes)[full], sizes[full], BLOCK_BYTES)
    return sims.reshape(n, BLOCKS), sizes.reshape(n, BLOCKS)


def distinct_words(words: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each line's different words as rising 40-bit hashes, with their lines. Frequent words would else rule a SimHash."""
    word = words >> np.uint64(24)  # 40 bits tell a line's words apart; a slice's lines fit above them
    if n >> 24:
        order = np.lexsort((word, line))
        word, line = word[order], line[order]
    else:
        both = np.sort((line.astype(np.uint64) << np.uint64(40)) | word)
        word, line = both & np.uint64((1 << 40) - 1), (both >> np.uint64(40)).astype(np.int64)
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (line[1:] != line[:-1])])
    return word[new], line[new]


def run_keys(words: np.ndarray, begin: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines (runs of words): the number of the line and a key, for each key by which lines meet in their words."""
    up, down = _powers(len(words) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])])
    lines, keys = [], []

    def run(a, b):
        return mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

    def add(line, key, salt):
        lines.append(line)
        keys.append(mixed(key + np.uint64(salt)))

    end = begin + n_words
    long = np.flatnonzero((n_words >= SHORT) & (n_words < HALVED))
    for some, half in ((long, n_words // 2), (long[n_words[long] % 2 == 1], n_words // 2 + 1)):
        add(some, run(begin[some], begin[some] + half[some]), 1)
        add(some, run(end[some] - half[some], end[some]), 2)
    for n in range(SHORTEST - 1, SHORT + 1):
        some = np.flatnonzero(n_words == n)
        add(some, run(begin[some], end[some]), 3)  # meets lines with one word more
        if n >= SHORTEST:
            for k in range(n):
                left = [begin[some] + x for x in range(n) if x != k]
                rest = sum(words[at] * up[x] for x, at in enumerate(left)) if len(some) else np.zeros(0, np.uint64)
                add(some, mixed(rest + np.uint64(n - 1)), 3)
    some = np.flatnonzero(n_words > SHORT)
    if len(some):
        none = np.uint64((1 << 64) - 1)
        runs = np.full(len(words), none)
        runs[: max(0, len(words) - WIDTH + 1)] = gram_hashes(words, WIDTH)
        for k in range(1, WIDTH):  # runs that would reach into the next line
            runs[np.maximum(end - k, begin)] = none
        for k in range(LEAST):
            least = np.minimum.reduceat(runs, begin)
            found = some[least[some] != none]
            add(found, least[found], 16)
            if k < LEAST - 1:
                runs[runs == np.repeat(least, n_words)] = none
    return np.concatenate(lines), np.concatenate(keys)


def line_table(raw: np.ndarray, at: np.ndarray, features: bool = False):
    """Of texts: first and end byte of each line, the lines before each text, and each line's number of words and digests.

    With features also, for the lines that have words: their numbers, the word hashes and where each line's begin.
    """
    feeds = np.flatnonzero(raw == 10)
    n = len(at) - 1
    owner_of_feed = np.searchsorted(at, feeds, "right") - 1
    counts = np.bincount(owner_of_feed, minlength=n) + 1 if n else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(before[-1], np.int64)
    ends = np.empty(before[-1], np.int64)
    place = np.arange(len(feeds)) + owner_of_feed
    ends[place], starts[place + 1] = feeds, feeds + 1
    starts[before[:-1]], ends[before[1:] - 1] = at[:-1], at[1:]
    words, w_start, _, _ = word_table(raw, at, ALNUM)
    first = np.searchsorted(w_start, starts)
    n_words = np.searchsorted(w_start, ends) - first
    full = np.flatnonzero(n_words)
    begin = first[full]
    digest = np.zeros((2, len(starts)), np.uint64)
    if len(full):
        nth = (np.arange(len(words)) - np.repeat(begin, n_words[full]) + 1).astype(np.uint64)
        for k, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            digest[k, full] = mixed(np.add.reduceat(mixed(words + nth * np.uint64(salt)), begin) + n_words[full].astype(np.uint64))
    table = starts, ends, before, n_words, digest
    return (*table, full, words, begin) if features else table


def line_keys(words: np.ndarray, begin: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys by which lines meet: the number of the line and a key, for each. All words belong to the lines, in order."""
    line, key = run_keys(words, begin, n_words)
    sims, sizes = block_simhashes(words, np.repeat(np.arange(len(begin)), n_words), len(begin))
    at, block = np.nonzero(sizes >= BLOCK_WORDS)
    return np.concatenate([line, at]), np.concatenate([key, mixed(sims[at, block] | (block.astype(np.uint64) << np.uint64(56)))])


_LINE = pa.struct([("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _lines(batches):
    for batch in batches:
        texts, totals, ends, parts, keys, done = batch.column(1), [], [np.zeros(1, np.int64)], [], [], 0
        for lo, hi, raw, at in text_slices(texts):
            _, _, before, n_words, digest, full, words, begin = line_table(raw, at, True)
            number = np.arange(before[-1]) - np.repeat(before[:-1], np.diff(before))
            line, key = line_keys(words, begin, n_words[full]) if len(full) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            keys.append((np.bincount(line, minlength=len(full)), key[np.argsort(line, kind="stable")]))
            parts.append((number[full], digest[0, full], digest[1, full]))
            ends.append(done + np.searchsorted(full, before[1:]))
            done += len(full)
            totals.append(np.diff(before))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        counts, key = (np.concatenate(x) for x in zip(*keys)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(key.view(np.int64)))
        lines = pa.StructArray.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c.view(np.int64)) for c in columns[1:]), lists], fields=list(_LINE))
        total = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        total[np.asarray(texts.is_null())] = 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), lines)], names=["id", "n_lines", "lines"])


def _keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and line digests of a batch of rows that _lines() made."""
    lines = batch.column(0).flatten()
    keys, h1 = lines.field("keys"), np.asarray(lines.field("h1"))
    return np.asarray(keys.flatten()).view(np.uint64), np.repeat(h1, np.diff(np.asarray(keys.offsets)))


def _bits(bitmap, h1: np.ndarray) -> np.ndarray:
    """Which of the digests are in the bitmap."""
    bits, slot = np.frombuffer(bitmap.value, np.uint64), h1.view(np.uint64) & np.uint64(BITMAP_BITS - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _texts(batches, bitmap):
    """Normalised lines whose digest is in the bitmap, with what the cheap check of pairs needs."""
    for batch in batches:
        for _, _, raw, at in text_slices(batch.column(0)):
            starts, ends, _, n_words, digest, full, words, begin = line_table(raw, at, True)
            some = np.flatnonzero(_bits(bitmap, digest[0, full]))
            _, once = np.unique(digest[0, full[some]], return_index=True)
            some = some[once]
            if not len(some):
                continue
            data, n = raw.tobytes(), n_words[full[some]]
            found = [_NOT_WORD.sub(b" ", data[starts[k] : ends[k]].lower()).strip(b" ").decode() for k in full[some]]
            inside = np.repeat(begin[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sims, _ = block_simhashes(words[inside], np.repeat(np.arange(len(some)), n), len(some))
            chars = pa.array([len(t) for t in found], pa.int64())
            columns = [pa.array(digest[0, full[some]].view(np.int64)), pa.array(found, pa.string()), chars, pa.array(n, pa.int64()), *(pa.array(sims[:, k].view(np.int64)) for k in range(BLOCKS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n", "words", *(f"s{k}" for k in range(BLOCKS))])


def _middles(a: str, b: str) -> tuple[str, str]:
    """The shorter and the longer text without what both begin or end with."""
    if len(a) > len(b):
        a, b = b, a
    for step in (1, -1):
        x, y = a[::step], b[::step]
        same, end = 0, len(x)
        while same < end:
            mid = (same + end + 1) // 2
            if x[same:mid] == y[same:mid]:
                same = mid
            else:
                end = mid - 1
        a, b = x[same:][::step], y[same:][::step]
    return a, b


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether at most `most` edits make one text the other: a column of the table of distances is two numbers' bits.

    Myers' bit-vector method (1999).
    """
    a, b = _middles(a, b)
    if len(b) <= most or len(b) - len(a) > most:
        return len(b) <= most
    ones, last, where = (1 << len(a)) - 1, 1 << len(a) - 1, {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    more, less, distance, left = ones, 0, len(a), len(b)
    for c in b:
        here = where.get(c, 0)
        diagonal = here | less
        across = ((((here & more) + more) ^ more) | here) & ones
        up, down = less | (ones ^ (across | more)), more & across
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        left -= 1
        if distance - left > most:
            return False
        up, down = (up << 1 | 1) & ones, down << 1 & ones
        more, less = down | (ones ^ (diagonal | up)), up & diagonal
    return distance <= most


def near_pairs(one: list[str], two: list[str], similarity: float) -> np.ndarray:
    """Which pairs of texts have that edit similarity: pairs of about one length take Myers' steps together.

    First near the diagonal only, where a distance that is found is one, if not the least; what is too far there goes on
    to a wider band (Ukkonen 1985), up to the allowed edits, where it is decided.
    """
    most = np.array([int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(one, two)], np.int64)
    cut = [_middles(x, y) for x, y in zip(one, two)]
    less, size = (np.array([len(c[k]) for c in cut], np.int64) for k in (0, 1))
    near = size <= most
    left, band = np.flatnonzero(~near & (size - less <= most)), BAND
    while len(left):
        now = left[size[left] - less[left] <= np.minimum(band, most[left])]
        now = now[np.argsort(size[now], kind="stable")]
        lo = 0
        while lo < len(now):
            # none more than half as long again as the first, and as many as the longest leaves room for
            hi = min(int(np.searchsorted(size[now], size[now[lo]] * 3 // 2 + 16, "right")), lo + TOGETHER)
            hi = max(lo + 1, min(hi, lo + TOGETHER_CHARS // int(size[now[hi - 1]])))
            some, lo = now[lo:hi], hi
            if len(some) < FEW + FEW * min(band, int(most[some].max())) // 64:
                near[some] = [within_edits(*cut[k], most[k]) for k in some]
                most[some] = np.minimum(most[some], band)  # decided
            else:
                near[some] = _distances([cut[k][0] for k in some], [cut[k][1] for k in some], min(band, int(most[some].max()))) <= most[some]
        left = left[~near[left] & (most[left] > band)]
        band *= 4
    return near


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def _distances(one: list[str], two: list[str], band: int) -> np.ndarray:
    """Numbers of edits that make texts the others, the least where that is `band` or less.

    No text of `one` is empty, and no pair's lengths differ by more than `band`. All pairs take the same steps: Myers'
    bit-vectors in words of 64 bits (Hyyrö 2003), those that the band touches. A pair's table has a row for each character of its first text; the rows' differences down a column are two bits, and
    64 rows are one word, whose lowest difference along the row comes from the word above. Characters become numbers of
    the pair's own, so that any of them may come.
    """
    order = sorted(range(len(one)), key=lambda k: len(one[k]))
    n, (a, a_size), (b, b_size) = len(one), _code_points([one[k] for k in order]), _code_points([two[k] for k in order])
    pair = np.repeat(np.arange(n), a_size)
    at = np.arange(len(a)) - np.repeat(np.cumsum(a_size) - a_size, a_size)
    wide = max(1, -(-int(a_size.max(initial=0)) // 64))
    letter = (pair.astype(np.uint64) << np.uint64(32)) | a  # of a pair
    known, number = np.unique(letter, return_inverse=True)
    masks = np.zeros((wide, len(known) + 1), np.uint64)  # the last one is that of characters that aren't in the first text
    place = (at >> 6) * (len(known) + 1) + number
    by_place = np.argsort(place, kind="stable")
    place = place[by_place]
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    masks.ravel()[place[begin]] = np.bitwise_or.reduceat(np.uint64(1) << (at[by_place] & 63).astype(np.uint64), begin)
    longest = int(b_size.max(initial=0))
    seen = np.full((longest, n), len(known), np.int64)
    pair = np.repeat(np.arange(n), b_size)
    letter = (pair.astype(np.uint64) << np.uint64(32)) | b
    found = np.searchsorted(known, letter)
    found[found == len(known)] = 0
    same = known[found] == letter
    seen[np.arange(len(b)) - np.repeat(np.cumsum(b_size) - b_size, b_size), pair] = np.where(same, found, len(known))

    u, one_bit, high = np.uint64, np.uint64(1), np.uint64(63)
    more, less = np.full((wide, n), u((1 << 64) - 1)), np.zeros((wide, n), u)
    last_word, last_bit = (a_size - 1) >> 6, ((a_size - 1) & 63).astype(u)
    ends = np.searchsorted(last_word, np.arange(wide + 1))  # pairs rise by their last word
    bits = [np.where(last_word == w, last_bit, high) for w in range(wide)]
    finished, done = np.argsort(b_size, kind="stable"), 0
    finish = np.searchsorted(b_size[finished], np.arange(longest + 2))
    lowest = min(band // 64, wide - 1)  # the last word of the band; what is below it has grown by one a row
    distance = np.minimum(a_size, 64 * (lowest + 1)).astype(u)  # at the pair's last row in those words
    found = np.zeros(n, np.int64)
    for k in range(longest):
        end = min((k + band) >> 6, wide - 1)
        if end > lowest:
            lowest = end
            distance += (np.minimum(a_size, 64 * (end + 1)) - np.minimum(a_size, 64 * end)).astype(u)
        here_of = seen[k]
        up_in, down_in = one_bit, u(0)  # the row above grows by one a column
        for w in range(max(0, k - band) >> 6, end + 1):
            here, p, m = masks[w][here_of], more[w], less[w]
            diagonal = here | m
            here |= down_in
            across = here & p
            across += p
            across ^= p
            across |= here
            up, down = across | p, p & across
            np.invert(up, out=up)
            up |= m
            lo, hi = ends[w], (n if w == end else ends[w + 1])
            if hi > lo:
                bit = bits[w][lo:hi]
                distance[lo:hi] += ((up[lo:hi] >> bit) & one_bit) - ((down[lo:hi] >> bit) & one_bit)
            if w < end:
                up_out, down_out = up >> high, down >> high
            up <<= one_bit
            up |= up_in
            down <<= one_bit
            down |= down_in
            np.bitwise_and(up, diagonal, out=m)
            diagonal |= up
            np.invert(diagonal, out=diagonal)
            np.bitwise_or(down, diagonal, out=p)
            if w < end:
                up_in, down_in = up_out, down_out
        if finish[k + 2] > done:
            now, done = finished[done : finish[k + 2]], finish[k + 2]
            found[np.array(order)[now]] = distance[now].astype(np.int64)
    return found


def _confirmed(batches, similarity: float):
    """Of (a, b, a_text, b_text) the pairs whose texts have that edit similarity."""
    for batch in batches:
        near = near_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def fuzzy_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row for each row of docs: id, n_lines, dropped (array of line numbers from 0, rising)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(_lines, f"id {kind}, n_lines long, lines array<struct<line: int, h1: long, h2: long, keys: array<long>>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = rows.select("row", "id", F.explode(F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2")))).alias("l")).select("row", "id", "l.*")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "line")
    nodes = written(lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "nodes")
    keys = written(shared_keys(rows.select("lines"), _keys_of, KEYS_PER_LINE * nodes.count()), "keys")

    # the texts of all lines that share a key, from the documents in which they come first; bitmap and numbers have a fixed size
    slot = F.col("id").bitwiseAND(F.lit(BITMAP_BITS - 1))
    filled = keys.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(id & 63 as int)))").alias("bits")).toArrow()  # BITMAP_BITS / 64 rows at most
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap.tobytes())

    def of_wanted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(_bits(sent, np.asarray(batch.column(0)))))], names=["number"])

    number = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(BUCKETS))
    wanted = nodes.select("h1", number("first.id").alias("number")).mapInArrow(of_wanted, "number long").distinct()
    some = source.withColumn("number", number("id")).join(F.broadcast(wanted), "number", "left_semi")
    sims = [f"s{k}" for k in range(BLOCKS)]
    found = some.select("text").mapInArrow(lambda it: _texts(it, sent), "id long, text string, n long, words long, " + ", ".join(f"{k} long" for k in sims))
    texts = written(found.groupBy("id").agg(F.min(F.struct("text", "n", "words", *sims)).alias("x")).select("id", "x.*"), "line-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("id").alias(p), F.col("text").alias(f"{p}_text")) for p in "ab")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "a_text", "b_text").mapInArrow(lambda it: _confirmed(it, similarity), "a long, b long")

    def near(a: str, b: str) -> Column:
        apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}_{k}").bitwiseXOR(F.col(f"{b}_{k}"))) for k in sims))
        as_long = F.least(f"{a}_n", f"{b}_n") >= similarity * F.greatest(f"{a}_n", f"{b}_n") - 1e-9
        return as_long & ((apart <= FAR) | (F.least(f"{a}_words", f"{b}_words") < FAR_WORDS))

    roots, _ = linked(keys, texts.select("id", "n", "words", *sims), near, confirm, rounds=2)
    in_groups = roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct()).withColumnRenamed("id", "h1")
    grouped = nodes.join(in_groups, "h1", "left").where("root is not null or times > 1").withColumn("root", F.coalesce("root", "h1"))
    keepers = grouped.groupBy("root").agg(F.min("first").alias("keep"), F.sum("times").alias("in_group")).where("in_group > 1").select("root", "keep")
    repeated = grouped.join(keepers, "root").select("h1", "h2", "keep")
    stays = (F.col("row") == F.col("keep.row")) & (F.col("line") == F.col("keep.line"))
    dropped = lines.join(repeated, ["h1", "h2"]).where(~stays).groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("dropped"))
    return rows.select("row", "id", "n_lines").join(dropped, "row", "left").select("id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that fuzzy_lines() drops, for a table with one row for each id."""
    other, gone = spare(docs, "other_id"), spare(docs, "dropped")
    drop = found.select(F.col("id").alias(other), F.col("dropped").alias(gone))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains(gone, k)), "\n")
    joined = docs.join(drop, F.col(id_col).eqNullSafe(F.col(other)), "left")
    return joined.withColumn(text_col, F.when(F.size(gone) > 0, kept).otherwise(F.col(text_col))).drop(other, gone)


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = fuzzy_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = F.array_join(F.transform("dropped", lambda k: k.cast("string")), ",")
    return found.select(F.col("id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("dropped")).alias("n_kept"), listed.alias("dropped"))


#: SimHash candidates and connected groups are tested against edit distances of all pairs.
SQL: dict[str, str] = {}
