import gzip
import hashlib
import io
import json
import zlib

import pytest

from plumbline.llm.warc import _fs, archive_pages, header, member, normalise, records, with_revisits

BIG = "<p>" + "x" * 2000


def archive(n, payload=b"HTTP/1.1 200 OK\r\n\r\nbody %d"):
    return b"".join(header({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>"}, len(payload % i)) + payload % i + b"\r\n\r\n" for i in range(n))


@pytest.mark.parametrize("members", [1, 3])
def test_normaliser_round_trip(members):
    whole = archive(50)
    cuts = [len(whole) * i // members for i in range(members + 1)]
    packed = b"".join(gzip.compress(whole[a:b]) for a, b in zip(cuts, cuts[1:]))
    out, index = io.BytesIO(), io.BytesIO()
    assert normalise(io.BytesIO(packed), out, index) == 50
    assert gzip.decompress(out.getvalue()) == whole
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    assert [e["id"] for e in entries] == [f"<{i}>" for i in range(50)]
    assert entries[-1]["offset"] + entries[-1]["length"] == len(out.getvalue())
    for i in (49, 0, 7):
        fields, payload = member(out, entries[i]["offset"], entries[i]["length"])
        assert payload == b"body %d" % i and fields["warc-record-id"] == f"<{i}>"
        d = zlib.decompressobj(31)
        out.seek(entries[i]["offset"])
        d.decompress(out.read(entries[i]["length"]))
        assert d.eof and not d.unused_data


def test_broken_archives_are_refused():
    packed = gzip.compress(archive(20) * 50)
    for bad in (packed[: len(packed) // 2], gzip.compress(archive(3)[:-30]), gzip.compress(b"no archive\r\n")):
        with pytest.raises((EOFError, ValueError, zlib.error)):
            normalise(io.BytesIO(bad), io.BytesIO(), io.BytesIO())
    assert list(records(io.BufferedReader(io.BytesIO(b"")))) == []


def want(rows):
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        refers = max(same) if len(data) >= 1000 and same and max(same) != p else None
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_rows(spark):
    rows = [(1, "http://a/\r\nX: y", BIG), (2, None, BIG), (3, "http://b/é", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500)]
    rows += [(None, "u", BIG), (9, "u", "WARC/1.1\r\n\r\n" * 200), (10, "u", "z" * 3_000_000), (11, "u", "y" * 999), (12, "u", "y" * 999), (None, "u", "w" * 1000), (None, "u", "w" * 1000)]
    df = spark.createDataFrame([(*r, "d") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    got = archive_pages(df, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert archive_pages(df.limit(0)).collect() == []


def test_a_long_list_of_repeats_and_a_hot_one(spark):
    rows = [(i, "u", ("hot" if i % 2 else f"page {i // 3}") + "x" * (1500 if i % 7 else 10)) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    expected = sorted(str((p, r)) for p, _, _, _, r in want(rows))
    for few in (0, 10**6):
        found = with_revisits(df, few=few).collect()
        assert sorted(str((r.page_id, r.refers_to)) for r in found) == expected
        assert all((r.payload is None) == (r.refers_to is not None) for r in found)


def test_names_of_stores():
    assert _fs("file:///tmp/x")[1] == "/tmp/x" and _fs("/tmp/y")[1] == "/tmp/y"


def test_whole_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archive_pages(pages).collect()), key=str)
    assert got == want([(r.page_id, r.url, r.html) for r in pages.collect()])
