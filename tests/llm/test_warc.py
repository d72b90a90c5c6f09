import base64
import gzip
import hashlib
from glob import glob

import pytest
from pyspark.sql import functions as F

from varioflow.llm import warc as W

SEEN = "page_id long, url string, html string, digest string, first long"
ROWS = [
    (5, "http://a.example.com/x?y=1#z", "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (3, "http://b.example.com", "<p>é\r\n\r\nWARC/1.1\r\n</p>"),
    (4, None, None),
    (9, "odd\r\nurl", ""),
    (7, "http://c.example.com/ü", "x" * 200_000),
    (8, "http://c.example.com/", "y"),
    (8, "http://c.example.com/", "y"),
    (None, "http://d.example.com/", "y"),
    (None, "http://d.example.com/", "only here"),
]


@pytest.mark.parametrize("least,compression", [(0, "gzip"), (2, "none")])
def test_round_trip(spark, tmp_path, least, compression):
    table = spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in ROWS], SEEN).repartition(2)
    path = str(tmp_path / "archive")
    W.write(table, path, least_bytes=least, records_per_file=7, compression=compression)
    got = W.assemble(W.read(spark, path)).collect()
    assert len(got) == len(ROWS)
    want = []
    for i, url, html in ROWS:
        html = html or ""
        ids = [j for j, _, h in ROWS if (h or "") == html and j is not None]
        refers = min(ids) if ids and len(html.encode()) >= least and (i is None or i > min(ids)) else None
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        want.append((i, url and url.replace("\r", "%0D").replace("\n", "%0A"), len(html.encode()), digest, "response" if refers is None else "revisit", refers, None if refers is not None else html))
    have = [(r.page_id, r.target, r.declared_bytes, r.main.digest, r.main.type, r.refers_to, None if r.main.payload is None else bytes(r.main.payload).decode()) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.request.id and r.metadata.id and r.main.payload_sha1 in (None, r.main.digest) for r in got)
    for name in glob(path + "/part-*"):
        raw = open(name, "rb").read()
        assert len(list(W.parsed(gzip.decompress(raw) if compression == "gzip" else raw))) <= 7


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BYTES_PER_FILE", 1 << 18)
    table = spark.createDataFrame([(k, f"http://a/{k}", chr(97 + k % 26) * (100 + k) + ("z" * 90_000 if k % 50 == 7 else ""), "d", 1) for k in range(400)], SEEN).coalesce(1)
    path = str(tmp_path / "archive")
    W.write(table, path)
    assert len(W.sizes(table, "html")) > 1 and W.assemble(W.read(spark, path)).count() == 400
    for name in glob(path + "/part-*"):
        records = list(W.parsed(gzip.decompress(open(name, "rb").read())))
        assert sum(len(block) for head, block in records if head["warc-type"] == "response") < (1 << 18) + 100 * len(records)


def test_revisits_name_what_they_refer_to(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write(spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in ROWS], SEEN), path)
    heads = [head for name in glob(path + "/part-*") for head, _ in W.parsed(gzip.decompress(open(name, "rb").read()))]
    assert {h.get("warc-refers-to-target-uri") for h in heads if h["warc-type"] == "revisit"} == {"http://b.example.com", None, "http://c.example.com/"}
    assert all(h["warc-refers-to-date"] == h["warc-date"] for h in heads if h["warc-type"] == "revisit")
    assert not any("warc-refers-to-date" in h for h in heads if h["warc-type"] != "revisit")


def test_base32(spark):
    [row] = spark.range(1).select(W.base32_sha1(F.lit("abc")).alias("d")).collect()
    assert row.d == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "archive")
    W.write(spark.createDataFrame([], SEEN), path)
    assert W.assemble(W.read(spark, path)).count() == 0


def test_a_band_of_sizes_exchanges_its_own_pages_alone(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * 10 ** (k % 4)) for k in range(12)], "page_id long, url string, html string")
    plan = W.between(W.captures(pages), 100, 2000)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(k for k, x in enumerate(plan) if "Join" in x)
    assert not any("Filter" in x for x in plan[:join]) and any("Filter" in x and "100" in x for x in plan[join:])
