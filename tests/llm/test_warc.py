import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from gridsight.llm import warc

ROWS = [(1, "u", "a"), (2, None, "a"), (3, "x\r\ny", None), (4, "x", ""), (None, "x", "a"), (None, "x", "zz"), (5, "x", "b" * 300_000), (1, "u", "a"),
        (6, "q", "ü\r\n\r\n" * 1000), (7, "q", "WARC/1.1\r\n")]


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    result = []
    for page, _, html in rows:
        data = (html or "").encode()
        earlier = first.get(html or "") if len(data) >= least else None
        earlier = None if earlier == page else earlier
        result.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if earlier is None else "revisit", earlier))
    return sorted(result, key=str)


def rows_of(found):
    found = found.select(warc.page_of("record_id").cast("bigint"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").cast("bigint"))
    return sorted([tuple(r) for r in found.collect()], key=str)


@pytest.mark.parametrize("least, size", [(0, 1 << 28), (2, 500)])
def test_pages_come_back(spark, least, size):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id bigint, url string, html string, sum int")
    files = warc.write(pages, least_bytes=least, file_bytes=size)
    found = warc.read(files)
    assert rows_of(found) == brute(ROWS, least)
    whole = {r["payload"] for r in found.filter("record_type = 'response'").collect()}
    assert {bytes(p) for p in whole} == {(h or "").encode() for _, _, h in ROWS}
    assert files.agg(F.sum("records")).first()[0] == len(ROWS)
    for row in files.collect():
        assert gzip.open(row["file"]).read().count(b"WARC-Type: ") >= row["records"]


def test_whole_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert rows_of(warc.read(warc.write(pages))) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    assert warc.read(warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_sequential_reader(chunk):
    data = b"".join(warc.page_record(str(i), "u", b"x" * size, None) for i, size in enumerate([0, 1, 5000, 200_000]))
    found = list(warc.records(io.BytesIO(data), chunk))
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, _, b in found] == [0, 1, 5000, 200_000]
    assert all(gzip.decompress(data[a:b]).startswith(b"WARC/1.1") for a, b in zip([o for o, _, _ in found], [*[o for o, _, _ in found][1:], len(data)]))


def _damaged(change):
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\nWARC-Block-Digest: sha1:%s\r\n\r\n"
    return gzip.compress(change(head % (3, warc.digest(b"abc").encode()) + b"abc\r\n\r\n"))


@pytest.mark.parametrize("change", [lambda d: d.replace(b"abc\r", b"abd\r"), lambda d: d.replace(b": 3", b": 4"), lambda d: d.replace(b": 3", b": 2"),
                                    lambda d: d.replace(b": 3", b": x"), lambda d: d[2:], lambda d: d[:-2], lambda d: d + b"more"])
def test_damage_is_found(change):
    assert len(list(warc.records(io.BytesIO(_damaged(lambda d: d))))) == 1
    with pytest.raises(warc.Damaged):
        list(warc.records(io.BytesIO(_damaged(change))))
    whole = _damaged(lambda d: d)
    with pytest.raises(warc.Damaged):
        list(warc.records(io.BytesIO(whole[:-9])))
