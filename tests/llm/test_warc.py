import base64
import gzip
import hashlib
import json
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from strandline.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, offset int, record_type string"


@pytest.fixture(scope="module")
def pages():
    rows = [(k, f"http://a/{k}", f"<p>page {k % 40}</p>" + "\r\n\r\nWARC/1.0\r\n" * (k % 3), "a", 1, "r") for k in range(120)]
    return [*rows, (500, None, None, "a", 1, "r"), (501, "u\r\nv", "", "a", 1, "r"), (None, "n", None, "a", 1, "r"), (None, "n", "only null", "a", 1, "r"), (502, "ü", "日本 é", "a", 1, "r"), (503, "x", "z" * 300_000, "a", 1, "r")]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, pages, least):
    rows = warc.archive_round_trip(spark.createDataFrame(pages, SCHEMA).repartition(4), least).collect()
    groups = defaultdict(list)
    for p in pages:
        groups[p[2] or ""].append(p[0])
    want = []
    for i, _, html, *_ in pages:
        size = len((html or "").encode())
        first = min((x for x in groups[html or ""] if x is not None), default=None)
        kind = "response" if i == first or size < least else "revisit"
        want.append(str((i, size, sha(html), kind, None if kind == "response" else first)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == sorted(want)


def test_repeated_rows_are_one_response(spark):
    rows = warc.archive_round_trip(spark.createDataFrame([(1, "u", "same", "a", 1, "r")] * 3, SCHEMA)).collect()
    assert sorted((r.record_type, r.refers_to) for r in rows) == [("response", None), ("revisit", 1), ("revisit", 1)]


def test_members_and_index(spark, pages, tmp_path):
    target = f"file://{tmp_path}/out"
    warc.archive_pages(spark.createDataFrame(pages, SCHEMA).repartition(3), target)
    seen = 0
    for index in Path(tmp_path, "out").glob("*.index.jsonl"):
        data = Path(str(index).removesuffix(".index.jsonl")).read_bytes()
        at = 0
        for line in map(json.loads, index.read_text().splitlines()):
            assert line["offset"] == at
            one = zlib.decompressobj(31)
            text = one.decompress(data[at : at + line["length"]])
            assert one.eof and not one.unused_data and text.startswith(b"WARC/1.1\r\n")
            at += line["length"]
            seen += 1
        assert at == len(data)
        gzip.decompress(data)
    assert seen == len(pages) == warc.read_index(spark, target).count()


def test_monolithic_archives_are_one_stream(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/raw"
    rows = warc.write_monolithic(spark.createDataFrame(pages, SCHEMA).coalesce(1), folder, roll_records=50).collect()
    assert len({r.archive for r in rows}) == 3
    for f in Path(tmp_path, "raw").glob("*.gz"):
        one = zlib.decompressobj(31)
        one.decompress(f.read_bytes())
        assert one.eof and not one.unused_data


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_records_are_valid_and_their_ids_unique(spark, tmp_path):
    rows = [(1, "u", "same", "a", 1, "r")] * 3 + [(2, "v", "other " * 900_000, "a", 1, "r"), (None, "w", "same", "a", 1, "r")]
    manifest, _ = warc.archive_pages(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/out")
    heads = []
    for f in Path(tmp_path, "out").glob("*.warc.gz"):
        data, at = gzip.decompress(f.read_bytes()), 0
        while at < len(data):
            head, payload, at = warc.parse(data, at)
            heads.append(head)
            assert int(head["Content-Length"]) == len(payload)
    ids = {h["WARC-Record-ID"]: h["WARC-Type"] for h in heads}
    assert len(ids) == len(rows) and all({"WARC-Date", "WARC-Target-URI", "WARC-Type"} <= set(h) for h in heads)
    assert all(ids[h["WARC-Refers-To"]] == "response" for h in heads if h["WARC-Type"] == "revisit")


def test_reading_goes_by_the_sidecar(spark, tmp_path):
    manifest, folder = warc.archive_pages(spark.createDataFrame([(k, "u", f"page {k}", "a", 1, "r") for k in range(9)], SCHEMA).coalesce(1), f"file://{tmp_path}/out")
    for side in Path(tmp_path, "out").glob("*.index.jsonl"):
        side.write_text("".join(side.read_text().splitlines(keepends=True)[::2]))
    assert sorted(r.page_id for r in warc.read_archives(manifest, folder).collect()) == [0, 2, 4, 6, 8]
