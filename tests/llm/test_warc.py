"""WARC round trips against hashes of the payloads."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from cloudframe.llm import warc
from cloudframe.llm.warc import archive_round_trip, read_archives, write_archives

BODY = "<html>é中\r\n\r\nWARC/1.1\r\n</html>"
PAGES = [(3, "http://a/ b\nc", BODY), (1, None, BODY), (2, "u", "x" * 100_000), (9, "u", "x" * 100_000), (5, "", None), (4, "v", ""), (None, "n", BODY), (None, "n", "own"), (7, "r", "r"), (7, "r", "r"), (8, "one", "\r\n\r\n")]


def expect(least):
    size = lambda t: len((t or "").encode())
    out = []
    for page, _, text in PAGES:
        same = [p for p, _, t in PAGES if (t or "") == (text or "") and p is not None]
        first = min(same, default=None)
        refers = first if size(text) >= least and first is not None and page != first else None
        digest = base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()
        out.append((page, size(text), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,chunk", [(0, 1 << 18), (0, 7), (3, 1000)])
def test_round_trip(spark, least, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    if chunk == 7:  # many small chunks: only the short payloads
        pages = pages.where("html is null or length(html) < 1000")
    got = archive_round_trip(pages, least, chunk).drop("url").collect()
    want = expect(least) if chunk != 7 else [r for r in expect(least) if r[1] < 1000]
    assert sorted((tuple(r) for r in got), key=str) == want


def test_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = write_archives(pages, str(tmp_path / "out"))
    text = b"".join(gzip.decompress((tmp_path / "out" / r.file).read_bytes()) for r in manifest.collect())
    assert text.count(b"WARC-Type: ") == len(PAGES) and BODY.encode() in text
    assert "http://a/ b c" in {r.url for r in read_archives(manifest, str(tmp_path / "out")).collect()}


def test_batches_of_chunks_are_bounded(monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(warc.TaskContext, "get", Context)
    long = "é" * (5 * warc.BATCH // 4)
    pages = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a", None, "c", "d"]), pa.array(["x", long, None, long[:10]])], names=["page_id", "url", "html"])
    got = list(warc._chunks(warc.CHUNK, True)(iter([pages])))
    assert len(got) > 2 and max(sum(map(len, b.column("data").to_pylist())) for b in got) <= warc.BATCH
    rows = [r for b in got for r in b.to_pylist()]
    payload = {k: b"".join(r["data"] for r in rows if r["page_id"] == k) for k in (1, 2, 3, 4)}
    assert payload == {1: b"x", 2: long.encode(), 3: b"", 4: long[:10].encode()}
    for k, data in payload.items():
        mine = [r for r in rows if r["page_id"] == k]
        assert [r["chunk"] for r in mine] == list(range(len(mine))) and [r["last"] for r in mine] == [False] * (len(mine) - 1) + [True]
        assert len({r["row"] for r in mine}) == 1 and {r["whole"] for r in mine} == {hashlib.sha1(data).digest()}
        assert [r["digest"] for r in mine] == [hashlib.sha1(data[: r["bytes"]]).digest() for r in mine]


@pytest.mark.parametrize("share", [2, 1000])
def test_common_payloads_and_many_read_tasks(spark, monkeypatch, share):
    monkeypatch.setattr(warc, "HOT_SHARE", share)  # 2: the common payload is decided by the join, not before
    rows = [(k, f"u{k}", "same payload" * 900 if k % 3 else f"own {k}") for k in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = archive_round_trip(pages, chunk_bytes=4000)
    assert got.rdd.getNumPartitions() > 2
    first = min(k for k, _, t in rows if t.startswith("same"))
    want = [(k, None if k % 3 == 0 or k == first else first) for k, _, _ in rows]
    assert sorted((r.page_id, r.refers_to) for r in got.collect()) == want


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, chunk int, size string")
    assert archive_round_trip(empty).count() == 0
