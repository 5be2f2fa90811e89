import gzip
import hashlib
import io
import json

import pytest

from vectide.llm import files
from vectide.llm import warc as W
from vectide.llm.common import Scratch

ROWS = [
    (3, "http://a/ b\n", "<p>same</p>", "x"), (1, "http://a/", "<p>same</p>", "x"), (2, None, "é" * 70000, "x"), (4, "http://c", None, "x"), (5, "", "", "x"),
    (None, "http://n", "<p>same</p>", "x"), (None, "http://m", "alone", "x"), (1, "http://a/", "<p>same</p>", "x"), (6, "http://d", "WARC/1.1\r\n\r\nfake\r\n\r\n", "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")


def test_round_trip(spark, tmp_path):
    scratch = Scratch(spark, "t")
    manifest = W.write_archives(frame(spark, ROWS).repartition(2), f"file://{tmp_path}/w", scratch)
    got = W.read_archives(manifest, payloads=True).collect()
    assert len(got) == len(ROWS)
    first = {"<p>same</p>": 1, "": 4}
    for r in got:
        same = [x for x in ROWS if x[0] == r.page_id and W.digest((x[2] or "").encode()) == r.payload_digest]
        payload = (same[0][2] or "").encode()
        assert r.payload_bytes == len(payload)
        to = first.get(payload.decode())
        if to is None or r.page_id == to:
            assert (r.record_type, r.refers_to) == ("response", None) and bytes(r.payload) == payload
        else:
            assert (r.record_type, r.refers_to) == ("revisit", to) and r.payload is None
    assert not list((tmp_path / "w").glob("*.whole.gz")) and not list((tmp_path / "w").glob("*.part"))
    total = 0
    for m in manifest.collect():
        with files.reading(m.archive) as f, files.reading(m["index"]) as x:
            raw = f.read()
            for line in x:
                at = json.loads(line)
                member = raw[at["offset"] : at["offset"] + at["length"]]
                assert gzip.decompress(member).startswith(b"WARC/1.1\r\n")
                total += 1
    assert total == len(ROWS)


def test_small_archives_and_least_bytes(spark, tmp_path):
    scratch = Scratch(spark, "t")
    manifest = W.write_archives(frame(spark, ROWS), f"{tmp_path}/w", scratch, min_bytes=5, archive_bytes=100)
    assert manifest.count() > 1
    got = W.read_archives(manifest).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}
    assert sorted(r.page_id or 0 for r in got if r.record_type == "revisit") == [0, 3]


def test_normaliser_takes_any_members():
    parts = [W.record(i, "u", b"p" * i, None, False) for i in range(50)]
    want = b"".join(parts)
    for raw in (gzip.compress(want), b"".join(map(gzip.compress, parts)), gzip.compress(want[:777]) + gzip.compress(want[777:])):
        a, x = io.BytesIO(), io.BytesIO()
        n, size = W.normalise(io.BytesIO(raw), a, x)
        assert n == 50 and size == len(a.getvalue())
        lines = [json.loads(line) for line in x.getvalue().splitlines()]
        members = [a.getvalue()[v["offset"] : v["offset"] + v["length"]] for v in lines]
        assert [gzip.decompress(m) for m in members] == parts
        assert [W.parse(m)["payload"] for m in members] == [b"p" * i for i in range(50)]


def test_broken_streams():
    whole = W.record(1, "u", b"payload", None, False)
    for bad in (whole[:-9], b"junk\r\n\r\n" + whole, whole + b"WARC/1.1\r\nContent"):
        with pytest.raises(ValueError):
            W.normalise(io.BytesIO(gzip.compress(bad)), io.BytesIO(), io.BytesIO())
    with pytest.raises(ValueError):
        W.parse(gzip.compress(whole.replace(b"payload", b"paYload")))


def test_digest():
    import base64

    assert W.digest(b"x") == base64.b32encode(hashlib.sha1(b"x").digest()).decode() and len(W.digest(b"")) == 32


def test_empty_table(spark, tmp_path):
    scratch = Scratch(spark, "t")
    assert W.read_archives(W.write_archives(frame(spark, []), f"{tmp_path}/w", scratch)).count() == 0


def test_query_equals_sha1(spark):
    got = W.query(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == {k: (len(v.encode()), W.digest(v.encode())) for k, v in pages.items()}


def test_query_equals_brute_force_records(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    first = {}
    for r in rows:
        first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    want = {r.page_id: ("response", None) if first[r.html or ""] == r.page_id else ("revisit", first[r.html or ""]) for r in rows}
    assert {r.page_id: (r.record_type, r.refers_to) for r in W.query(spark, "/root/testdata/sf0.01").collect()} == want


def test_payloads_of_several_steps():
    import random

    big = random.Random(3).randbytes(3 * W.STEP + 17)  # hardly compressible, so it is read and inflated in several steps
    parts = [W.record(1, "u", big, None, False), W.record(2, "u", b"a" * 5 * W.STEP, None, False), W.record(3, "u", b"", None, False)]
    a, x = io.BytesIO(), io.BytesIO()
    assert W.normalise(io.BytesIO(gzip.compress(b"".join(parts))), a, x)[0] == 3
    lines = [json.loads(line) for line in x.getvalue().splitlines()]
    assert [gzip.decompress(a.getvalue()[v["offset"] : v["offset"] + v["length"]]) for v in lines] == parts
