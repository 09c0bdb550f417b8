import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from sievework.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in data], PAGES).repartition(3)


DATA = [(5, "http://a/", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (4, "u", None), (9, "u", ""), (7, None, "é\r\n\r\nWARC/1.1\r\n" * 3), (8, "http://c/", "y" * 300_000), (1, "http://d/", "y" * 300_000), (None, "n", "only"), (3, "http://b/", "<p>x</p>")]


def outright(data):
    first = {}
    for i, _, h in data:
        b = (h or "").encode()
        if b not in first or i is None or (first[b] is not None and i < first[b]):
            first[b] = i
    out = []
    for i, _, h in data:
        b = (h or "").encode()
        again = first[b] != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_hot", [1, 4, 1000])
def test_query(spark, tmp_path, monkeypatch, most_hot):
    """No payload is hot, only that of three rows is, all are."""
    monkeypatch.setattr(warc, "MOST_HOT", most_hot)
    pages(spark, DATA).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((tuple(r) for r in warc.op1_warc(spark, str(tmp_path)).collect()), key=str) == outright(DATA)


def test_payloads_come_back_and_small_ones_are_all_responses(spark, tmp_path):
    warc.archive_pages(pages(spark, DATA), str(tmp_path / "w"), least_bytes=100)
    read = warc.read_warc(spark, str(tmp_path / "w"))
    got = sorted(bytes(r.payload) for r in read.filter("record_type = 'response'").collect())
    assert got == sorted((h or "").encode() for i, _, h in DATA if i != 8)
    assert read.filter("record_type = 'revisit'").filter(F.col("payload").isNull()).count() == 1
    assert read.filter("record_type = 'warcinfo'").count() >= 1


def test_pushed_predicates_skip_payloads(spark, tmp_path):
    warc.archive_pages(pages(spark, DATA), str(tmp_path / "w"))
    read = warc.read_warc(spark, str(tmp_path / "w"))
    one = read.filter("target_uri = 'http://c/' and record_type in ('revisit')")
    assert [r.record_id for r in one.collect()] == ["<urn:sievework:page:8>"]
    reader = warc.WarcReader({"path": str(tmp_path / "w")})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "nothing"), GreaterThan(("offset",), 3)]))
    assert [type(x) for x in left] == [GreaterThan]
    for part in reader.partitions():
        for path in part.paths:
            with open(path, "rb") as f:
                stream = Counting(f)
                assert list(reader.records(stream, path)) == []
    # 300,000 equal bytes squeeze well; a payload that does not is stepped over
    noise = warc.gzip_member(warc.record_bytes({"record_type": "resource", "record_id": "<a>", "date": "d", "payload": hashlib.shake_256(b"x").digest(1 << 20)}))
    stream = Counting(io.BytesIO(noise * 2))
    assert list(reader.records(stream, "x")) == [] and stream.got < 300_000


class Counting:
    def __init__(self, f):
        self.f, self.got = f, 0

    def read(self, n):
        out = self.f.read(n)
        self.got += len(out)
        return out

    def seek(self, n):
        return self.f.seek(n)

    def tell(self):
        return self.f.tell()


@pytest.mark.parametrize("form", ["plain", "members", "whole"])
def test_archives_of_others(spark, tmp_path, form):
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <r%d>\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate([b"", b"abc", b"\r\n\r\n" * 5, b"z" * 200_000])]
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "whole": gzip.compress(b"".join(records))}[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    read = warc.read_warc(spark, str(tmp_path))
    assert [len(r.payload) for r in read.orderBy("record_id").collect()] == [0, 3, 20, 200_000]
    assert read.first().headers["x-long"] == "a b"
    assert [r.record_id for r in read.filter("record_id = '<r3>'").collect()] == ["<r3>"]
    (tmp_path / "b.warc").write_bytes(records[1][:-6])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_a_record_without_a_length(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="without a length"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_empty(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0
