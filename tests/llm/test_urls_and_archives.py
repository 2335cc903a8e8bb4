"""URL rules against a plain loop, archives by an exact round trip, the pipeline against its parts."""

import base64
import hashlib
import io
import random
import zipfile

import pytest

from tidewise.llm import url_filter, warc


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def test_url_rules(spark):
    rng = random.Random(1)
    rules = [*url_filter.RULES, ("block", "a.b.c", "/x"), ("allow", "b.c", "/x/y/z"), ("block", "b.c", ""), ("allow", "É.com", "/q/")]
    urls = [None, "", "no scheme", "http://", "://x", "https://A.B.C/xyz?q=/x/", "http://b.c", "http://b.c/x/y/z/1", "http://u:p@www.Example.com:80/en/", "http://WWW.example.com/en/a#b", "http://example.com/en", "http://notexample.com/en/", "http://a..net//es/", "http://x.net/es/\nb", "http://É.com/q/", "http://" + "a." * 3000 + "com/" + "b/" * 3000]
    urls += ["".join(rng.choice(["http://", "a.", "b.c", "com", "/", "/x", "/en/", "example.", "www.", "?", "#", "net", "/es/"]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    rows = [(k, u, "z", "clash") for k, u in enumerate(urls)] + [(None, "http://x.com/", "z", "c"), (3, urls[5], "z", "c"), (3, urls[5], "z", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], *judge(r[1], rules)) for r in rows), key=key)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {tuple(r)[3:] for r in url_filter.judge_urls(pages, none).collect()} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_url_plan_has_no_python(spark):
    plan = url_filter.op3_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u\r\nx", None), (4, "v", ""), (5, "w", "x" * 300_000), (None, "n", "<p>é</p>"), (7, "r", "same"), (7, "r", "same"), (8, "r\r\n\r\n", "WARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archives_round_trip(spark, least, monkeypatch):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, id int")
    got = warc.read_archives(warc.write_archives(pages, revisit_bytes=least)).collect()
    want = []
    for i, u, h in PAGES:
        raw = (h or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "").encode() == raw and p[0] is not None]
        first = min(same)
        revisit = len(raw) >= least and i != first
        want.append((i, (u or "").replace("\r", "%0D").replace("\n", "%0A"), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, None if revisit else (h or "")))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def foreign_archive(path):
    """An archive of another writer: two data files, two indexes, other headers, digests and record kinds."""
    import gzip
    import json

    def record(kind, ident, body, more="", http="HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"):
        block = (http.encode() + b"\r\n" + body) if http else body
        form = "Content-Type: application/http;msgtype=response\r\n" if http else "content-type: text/plain\r\n"
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: http://x/{ident}\r\n{form}{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    html = "<p>Grüße</p>".encode()
    chunked = "HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n"
    packed = [gzip.compress(x) for x in (
        record("warcinfo", "i", b"software: other", http=""),
        record("response", "a", html, f"WARC-Payload-Digest: sha256:{hashlib.sha256(html).hexdigest()}\r\n"),
        record("revisit", "b", b"", "WARC-Refers-To: a\r\nWARC-Folded: one\r\n two\r\n"),
    )]
    plain = [
        record("response", "c", b"4\r\n<p>G\r\n5;x=y\r\nr</p>\r\n0\r\n\r\n", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(b'<p>Gr</p>').digest()).decode()}\r\n", chunked),
        record("response", "d", b"not chunked", "", chunked),
        record("resource", "e", b"\xff\xfe", http=""),
        record("response", "f", b"in no index"),
    ]
    line = lambda name, at, n: f"x)/{{}} 20200101000000 " + json.dumps({"filename": name, "offset": str(at), "length": str(n)}) + "\n"
    at = lambda parts, k: sum(map(len, parts[:k]))
    one = "".join(line("p.warc.gz", at(packed, k), len(packed[k])) for k in (2, 1))
    two = "!meta 0 {}\n\n" + "".join(line("archive/q.warc", at(plain, k), len(plain[k])) for k in (0, 1, 2)) + line("p.warc.gz", at(packed, 1), len(packed[1]))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}" * 99, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("archive/p.warc.gz", b"".join(packed))
        z.writestr("indexes/one.cdx.gz", gzip.compress(one[: len(one) // 2].encode()) + gzip.compress(one[len(one) // 2 :].encode()))
        z.writestr("archive/q.warc", b"".join(plain))
        z.writestr("indexes/two.cdxj", two)


def test_archives_of_other_writers(spark, tmp_path):
    path = str(tmp_path / "other.zip")
    foreign_archive(path)
    archives = spark.createDataFrame([(path, 1)], "path string, clash int")
    got = {r["record_id"]: r for r in warc.archive_records(archives).collect()}
    html = "<p>Grüße</p>".encode()
    assert {k: (r["record_type"], r["content"] and bytes(r["content"]), r["payload_bytes"], r["refers_to_record"]) for k, r in got.items()} == {
        "a": ("response", html, len(html), None),
        "b": ("revisit", None, None, "a"),
        "c": ("response", b"<p>Gr</p>", 9, None),
        "d": ("response", b"not chunked", 11, None),
        "e": ("resource", b"\xff\xfe", 2, None),
    }
    assert got["a"]["payload_digest"] == f"sha256:{hashlib.sha256(html).hexdigest()}" and got["d"]["payload_digest"] is None and got["e"]["id"] is None
    assert {(r["url"], r["payload"]) for r in warc.read_archives(archives).collect()} == {("http://x/a", html.decode()), ("http://x/b", None), ("http://x/c", "<p>Gr</p>"), ("http://x/d", "not chunked"), ("http://x/e", None)}


def test_damaged_archives(tmp_path):
    def opened(members, method=zipfile.ZIP_STORED):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", method) as z:
            for name, data in members.items():
                z.writestr(name, data)
        return raw, len(raw.getvalue())

    line = b'k 2020 {"filename": "a.warc", "offset": "0", "length": "9"}\n'
    for members, method in (({"archive/a.warc": b"x" * 9}, 0), ({"indexes/i.cdxj": line}, 0), ({"archive/a.warc": b"x" * 8, "indexes/i.cdxj": line}, 0), ({"archive/a.warc": b"x" * 9, "indexes/i.cdxj": line}, zipfile.ZIP_DEFLATED)):
        with pytest.raises(ValueError):
            warc.places(*opened(members, method))
    raw, size = opened({"archive/a.warc": b"x" * 9, "indexes/i.cdxj": line})
    assert [n for _, n in warc.places(raw, size)] == [9]
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: a\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.parsed(good % base64.b32encode(hashlib.sha1(b"abc").digest()))["content"] == b"abc"
    for bad in (good % base64.b32encode(hashlib.sha1(b"abd").digest()), b"x" * 50):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_archives_of_ids_that_are_no_numbers(spark):
    rows = [("b/ä", "http://www.a.b/c d?e", "same"), ("", "u", "same"), (None, "v", "same"), ("x>", "w", "other"), ("x>", "w", "other")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    archives = warc.write_archives(pages)
    got = sorted((str(r["id"]), r["url"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_archives(archives, id_type="string").collect())
    assert got == [("", "u", "response", None, "same"), ("None", "v", "revisit", "", None), ("b/ä", "http://www.a.b/c d?e", "revisit", "", None), ("x>", "w", "response", None, "other"), ("x>", "w", "response", None, "other")]
    assert {r["date"] for r in warc.archive_records(archives).collect()} == {"1970-01-01T00:00:00Z"}
    assert warc.sort_key("HTTP://WWW.a.b/c d?e") == "b,a,www)/c%20d?e" and warc.sort_key("http://a.b") == "b,a)/" and warc.sort_key("") == "-"


def test_one_payload_of_most_rows_is_dealt_out(spark):
    """Pages of one payload are written by many tasks, and still refer to the smallest id."""
    from pyspark.sql import functions as F

    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") / 6).cast("long"))).alias("html"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # small pieces stay apart
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        archives = warc.write_archives(pages)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(archives).collect()}
    first, want = {}, {}
    for r in pages.orderBy("page_id").collect():
        k = first.setdefault(r["html"], r["page_id"])
        want[r["page_id"]] = ("response", None) if k == r["page_id"] else ("revisit", k)
    assert got == want and archives.agg(F.max("records")).first()[0] < 2500


def test_zip_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"one")
        z.writestr("b", b"two")
        z.comment = b"a note PK"
    found = warc.directory(raw, len(raw.getvalue()))
    for name, data in (("a", b"one"), ("b", b"two")):
        at, size, method = found[name]
        assert method == 0 and raw.getvalue()[at : at + size] == data
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"x" * 100), 100)


def test_zip64_end_record():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for k in range(66_000):  # more members than the plain end record can count
            z.writestr(zipfile.ZipInfo(str(k)), b"")
    assert len(warc.directory(raw, len(raw.getvalue()))) == 66_000


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline
    from tidewise.llm import decontaminate, exact_dedup, minhash_dedup, quality
    from tidewise.llm.store import table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    scored = {r["id"]: r["predicted"] for r in quality.quality_scores(docs, table(spark, d, "labels")).collect()}
    one = pipeline.keep_quality(spark, docs, d)
    assert ids(one) == sorted(i for i, p in scored.items() if p)
    two = pipeline.keep_first_copies(spark, one, d)
    assert ids(two) == sorted(r["id"] for r in exact_dedup.exact_dedup(one).collect() if r["kept"])
    three = pipeline.keep_one_of_near_copies(spark, two, d)
    groups = {}
    for r in minhash_dedup.near_duplicates(two).collect():
        groups.setdefault(r["component_id"], set()).add(r["id"])
    assert all(len(g & set(ids(three))) == 1 for g in groups.values()) and len(ids(three)) == len(groups) < len(ids(two))
    four = pipeline.keep_uncontaminated(spark, three, d)
    assert ids(four) == sorted(r["id"] for r in decontaminate.decontaminate(three, table(spark, d, "benchmark")).collect() if not r["contaminated"])
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    packed = {r["doc_id"] for r in pipeline.pack_sequences(spark, four, d).collect()}
    assert packed == set(ids(four))


def test_pipeline_copies_of_one_id(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "same text", "en", "s", 9), (1, "same text", "en", "s", 9), (2, "same  text", "en", "s", 10), (3, "other", "en", "s", 5), (None, "same text", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in pipeline.keep_first_copies(spark, docs, "").collect()) == [("2", "same  text"), ("3", "other")]


ROW = "doc_id long, text string, lang string, source string, n_chars long, slot long, gone long, row_key long, nth long, digest string, id string"


def strange(spark, rows):
    """Documents with further columns whose names the stages use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 9, 1, 2, 3, 4, "d", "x") for i, t in rows], ROW)


def test_pipeline_rows_of_one_id_or_none(spark):
    """Of rows that share an id, or have none, only those that are copies or contaminated go."""
    import random

    import corpus_pipeline as pipeline
    from tidewise.llm.store import table

    d, rng = "/root/testdata/sf0.001", random.Random(3)
    leak = max((r["text"] for r in table(spark, d, "benchmark").collect()), key=len)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    near, clean, own, far = text(), text(), text(), text()
    rows = [(1, leak), (1, clean), (None, leak), (None, own), (2, near), (3, near + " end"), (3, far), (4, None), (5, "")]
    docs = strange(spark, rows)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in pipeline.keep_uncontaminated(spark, docs, d).collect())
    assert kept == sorted((str(i), t) for i, t in rows if t != leak)
    one = pipeline.keep_one_of_near_copies(spark, docs, d)
    assert one.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert len(left) == len(rows) - 2 and {(3, far), (1, clean), (None, own), (4, None), (5, "")} <= set(left)
    two = pipeline.keep_first_copies(spark, strange(spark, [(7, "a b"), (7, "ab"), (7, "c"), (7, "c"), (None, "a  b"), (8, "c")]), d)
    assert two.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in two.collect()) == [("7", "c"), ("None", "a  b")]


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = strange(spark, []).limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, d).count() == 0
