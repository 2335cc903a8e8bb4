"""Prefix token counts and alignment of two tokenizers, against the tokenizers themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidewise.llm import alignment, packing, token_counts
from tidewise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NASTY = [None, "", " ", "  ", "a", "two  words ", "<s>x</s><unk><0x0A> <|endoftext|>", "▁a ▁", "ﬁ① \x00　日本語\U00013000", "a\n  b \n c\r\n\td", "x" * 300, "=-" * 100, "été naïve Straße", "日本語テキスト" * 30, "same", "same", "don't we'll  'S 12 345.6"]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_counts.public_model())


def _docs(spark, texts):
    rows = [(None if k == 3 else k, t, "own", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, counts int, n_a int")


def _random_texts(n):
    rng, parts = random.Random(4), ["in", "th", "e", "s", " ", "▁", "ing", "er", "\n", "<s>", "<0x0A>", "é", "日", "\U00013000", "0", "12", "--", "..", "A", "  ", "\t", "'s"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 90))) for _ in range(n)]


def test_counts_of_all_prefixes(pieces):
    model = token_counts.counter(token_counts.public_model())
    texts = [t for t in NASTY if t] + _random_texts(40)
    for text, found in zip(texts, model.counts(texts)):
        assert found.tolist() == [len(pieces.encode(text[: k + 1])) for k in range(len(text))], text
        alone = model._singly(token_counts.characters(*token_counts._joined([text]))[0])
        assert alone[1:].tolist() == found.tolist()


def test_two_tokens_stay_side_by_side_iff_their_text_has_them(pieces):
    """follows(a, b) against encodings of texts that begin with a."""
    model, rng = token_counts.counter(token_counts.public_model()), random.Random(2)
    first = [k for k in range(pieces.get_piece_size()) if model.text[k].startswith("▁") and "▁" not in model.text[k][1:] and len(model.text[k]) > 1]
    second = [k for k in range(pieces.get_piece_size()) if model.text[k] in model.score and "▁" not in model.text[k]]
    for _ in range(4000):
        a, b = rng.choice(first), rng.choice(second)
        assert model.follows(a, b) == (pieces.encode(model.text[a][1:] + model.text[b]) == [a, b])


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.PieceCounter(str(tmp_path / "none.model"))


def test_token_counts_of_a_table(spark, pieces):
    docs = _docs(spark, NASTY)
    found = token_counts.token_counts(docs, tokenizer=token_counts.public_model(), limit=5, with_counts=True)
    asked = found.select("*", token_counts.tokens_of_prefix(4).alias("four"), token_counts.tokens_of_prefix(0).alias("none"), token_counts.prefix_within(5).alias("within"), token_counts.prefix_within(0).alias("nothing")).toPandas()
    assert len(asked) == len(NASTY) and asked["id"].isna().sum() == 1
    for text, row in zip(NASTY, asked.to_dict("records")):
        text = text or ""
        each = [len(pieces.encode(text[: k + 1])) for k in range(len(text))]
        assert list(row["counts"]) == each and row["n_tokens"] == len(pieces.encode(text)) and row["n_bytes"] == len(text.encode()) and row["n_chars"] == len(text)
        assert row["four"] == ([0, *each][min(4, len(each))]) and row["none"] == 0 and row["nothing"] == 0
        assert row["within"] == row["chars_within"] == max([k + 1 for k, n in enumerate(each) if n <= 5], default=0)
    assert token_counts.token_counts(docs.limit(0), tokenizer=token_counts.public_model()).count() == 0


def test_op11_against_the_library(spark, pieces):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        n = len(pieces.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
        assert r["chars_within"] == len(text) or len(pieces.encode(text[: r["chars_within"]])) <= 4096


def _byte_of():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def _plain_alignment(texts, pieces):
    """Groups of each text, straight from the definition."""
    plain = Tokenizer.from_file(packing.public_vocabulary())
    plain.encode_special_tokens = True
    of, out = _byte_of(), []
    for text in texts:
        groups, raw = [], (" " + text).encode() if text else b""
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in plain.id_to_token(k)) for k in a]
        b_bytes = [bytes([k - pieces.piece_to_id("<0x00>")]) if pieces.is_byte(k) else pieces.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(a_bytes) == raw == b"".join(b_bytes):
            ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append((a[i:p], b[j:q]))
                i, j = p, q
        out.append(groups)
    return out


def _expected(texts, pieces):
    groups = _plain_alignment(texts, pieces)
    linked = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    most = {}
    for (a, b), n in linked.items():
        most[b] = max(most.get(b, 0), n)
    for own in groups:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        counts = [(linked[a[-1], b[-1]], b[-1]) for a, b in own]
        yield (
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(own), sum(n == most[b] for n, b in counts), sum(n for n, _ in counts), hashlib.sha256(text.encode()).hexdigest() if own else "", text,
        )


def test_alignment_of_a_table(spark, pieces):
    texts = NASTY + _random_texts(60)
    docs, (a, b) = _docs(spark, texts).repartition(3), (packing.public_vocabulary(), token_counts.public_model())
    aligned = alignment.align(docs, first=a, second=b, with_groups=True)
    rows = alignment.with_link_scores(aligned, alignment.link_counts(aligned, b), b).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(_expected(texts, pieces))
    assert Counter(r["id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    # a sign of its own for spaces is a space after decoding, so such a text has no tokens
    assert next(r for r in rows if r["id"] == NASTY.index("▁a ▁"))["n_a"] == 0
    none = alignment.align(docs.limit(0), first=a, second=b)
    assert alignment.with_link_scores(none, alignment.link_counts(none, b), b).count() == 0
    empty = alignment.align(_docs(spark, [None, ""]), first=a, second=b)
    assert [r["n_links"] for r in alignment.with_link_scores(empty, alignment.link_counts(empty, b), b).collect()] == [0, 0]


def test_op12_against_brute_force(spark, pieces):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, _expected(list(texts.values()), pieces)))
    rows = QUERIES["op12_alignment"](spark, SF).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows} == {k: v[:-1] for k, v in want.items()} and len(rows) == len(texts)


