"""Archives read back: payloads, roles, segments, and broken input."""

import hashlib

import pytest

from factorlake.llm import warc as W

LONG = "<p>Ünïcode 世界 \r\n\r\n WARC/1.1 \U0001f600</p>" * 400


def expected(rows, min_bytes=1000):
    keeper = {}
    for page, html in rows:
        body = (html or "").encode()
        if len(body) >= min_bytes and page is not None:
            keeper[body] = max(keeper.get(body, page), page)
    out = []
    for page, html in rows:
        body = (html or "").encode()
        of = keeper.get(body)
        revisit = of is not None and of != page
        out.append(("" if page is None else str(page), "revisit" if revisit else "response", str(of) if revisit else None, hashlib.sha1(body).hexdigest(), len(body)))
    return sorted(out)


def test_round_trip(spark):
    rows = [(1, LONG), (2, LONG), (3, LONG + "x"), (4, None), (5, ""), (6, "<b>small</b>"), (7, "<b>small</b>"), (8, "x" * 999), (9, "x" * 999), (10, "y" * 1000),
            (11, "y" * 1000), (11, "y" * 1000), (12, LONG + "z"), (12, LONG + "z"), (None, "no id"), (None, LONG)]
    df = spark.createDataFrame([(a, f"http://x/{a} b", b, "q") for a, b in rows], "page_id long, url string, html string, digest string")
    for segment in (W.SEGMENT, 700):
        back = W.round_trip(df, segment).collect()
        assert sorted((r.page, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes) for r in back) == expected(rows)
        bodies = {hashlib.sha1((b or "").encode()).hexdigest(): (b or "").encode() for _, b in rows}
        assert all(bytes(r.payload) == bodies[r.payload_digest] for r in back if r.record_type == "response")


def test_record_of_many_segments(spark):
    page = LONG * 60
    df = spark.createDataFrame([(1, "u", page), (2, "u", LONG)], "page_id long, url string, html string")
    back = {r.page: bytes(r.payload) for r in W.round_trip(df, 200).collect()}
    assert back == {"1": page.encode(), "2": LONG.encode()}


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_segments_are_whole_records():
    payload = LONG.encode()
    parts = W.records(5, "http://x", payload, None, 900)
    assert len(parts) > 10 and all(len(p) < 1500 and p.decode() for p in parts)
    found = list(W.parse(b"".join(p + b"\r\n\r\n" for p in parts)))
    assert [int(f["warc-segment-number"]) for f, _ in found] == list(range(1, len(parts) + 1))
    assert int(found[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in found)
    assert W.unframed(b"".join(b for _, b in found).partition(b"\r\n\r\n")[2]) == payload


def test_broken_input(spark):
    df = spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string")
    path = W.shared_dir(spark) + "/broken-" + hashlib.sha1(str(id(df)).encode()).hexdigest()
    W.write(df, path, segment=700)
    records = W.read_records(spark, path)
    with pytest.raises(Exception, match="segments missing"):
        W.reassemble(records.where("segment IS NULL OR segment <> 3")).collect()
    with pytest.raises(ValueError, match="cut short"):
        W.unframed(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError, match="another length"):
        list(W.parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabcd\r\n\r\n"))


def test_chunk_extensions():
    assert W.unframed(b"3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") == b"abcde"
