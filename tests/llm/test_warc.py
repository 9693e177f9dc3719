import base64
import hashlib
import itertools
import os
import time
import tracemalloc

import pytest

from tremor.llm import warc

PAGES = [(1, "http://a", "<p>one</p>"), (2, "http://b", "same"), (9, "http://c", "same"), (4, None, "same"), (5, "u\r\nX: y", ""),
         (6, "http://e", None), (7, "http://é", "WARC/1.1\r\nfake\r\n\r\n" + "x" * 200_000), (9, "http://c", "same"), (None, "http://n", "only"),
         (None, "http://n", "same")]


def sha(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        top = first.get(h or "")
        many = sum((x[2] or "") == (h or "") for x in rows) > 1
        revisit = many and top is not None and i != top
        out.append((i, len((h or "").encode()), sha(h), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(spark, tmp_path, compress):
    df = spark.createDataFrame([(*p, 1, "t") for p in PAGES], "page_id long, url string, html string, n int, digest string")
    warc.write_archives(df, str(tmp_path / "w"), compress=compress, file_bytes=100_000)
    back = warc.read_archives(spark, str(tmp_path / "w"))
    assert back.where("kind = 'gap'").count() == 0
    rows = back.select(warc.page_number(back.record_id), "payload_bytes", "payload_digest", "record_type",
                       warc.page_number(back.refers_to)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(PAGES)
    body = {r["record_id"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()}
    assert body["<urn:page:7>"] == PAGES[6][2]


def test_min_bytes_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), min_bytes=5)
    assert warc.read_archives(spark, str(tmp_path / "w")).where("record_type = 'revisit'").count() == 0
    warc.write_archives(df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).collect() == []


def record(k, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:"
            + base64.b32encode(hashlib.sha1(body).digest()).decode()
            + f"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    return head.encode() + block + b"\r\n\r\n"


def read(data):
    out = list(warc.salvage(data))
    return [r["record_id"][10:-1] for r in out if r["kind"] == "record"], [(r["offset"], r["length"]) for r in out if r["kind"] == "gap"]


PARTS = [record(k, b"payload %d " % k * 9) for k in range(5)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    parts = [warc._gzip(p) for p in PARTS] if packed else PARTS
    whole = b"".join(parts)
    assert read(whole) == (list("01234"), [])
    at = [sum(map(len, parts[:k])) for k in range(6)]
    # Garbage between records.
    got = read(b"".join(parts[:2]) + b"garbage WARC/ x" + b"".join(parts[2:]))
    assert got == (list("01234"), [(at[2], 15)])
    # A flipped payload byte: that record is quarantined, later ones come back.
    bad = bytearray(whole)
    bad[at[3] - 12] ^= 1
    assert read(bytes(bad)) == (list("0134"), [(at[2], at[3] - at[2])])
    # A cut in the middle of a record.
    assert read(whole[:at[2] + 40] + whole[at[3]:]) == (list("0134"), [(at[2], 40)])
    # A truncated end.
    assert read(whole[:-30])[0] == list("0123")
    assert read(b"") == ([], [])
    assert read(b"nothing here") == ([], [(0, 12)])


def test_record_inside_a_bad_record_is_not_taken():
    inner = record(7, b"inner")
    outer = bytearray(record(1, inner + b"tail"))
    outer[-6] ^= 1
    assert read(bytes(outer) + PARTS[2]) == (["2"], [(0, len(outer))])


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("k", [0, 2, 4])
@pytest.mark.parametrize("old, new", [
    (b"sha1:", b"sha1:X"),                                  # wrong digest
    (b"OK\r\nContent-Length: ", b"OK\r\nContent-Length# "),  # malformed HTTP header line
    (b"\r\n\r\npayload", b"\r\n..payload"),                # unfinished HTTP header
])
def test_bad_record_in_a_whole_frame(packed, k, old, new):
    """The frame of the bad record is the gap, wherever it lies in the file."""
    parts = [p.replace(old, new, 1) if i == k else p for i, p in enumerate(PARTS)]
    assert parts[k] != PARTS[k]
    parts = [warc._gzip(p) for p in parts] if packed else parts
    rows = list(itertools.islice(warc.salvage(b"".join(parts)), 20))
    at = [sum(map(len, parts[:i])) for i in range(6)]
    assert [(r["kind"], r["offset"], r["length"]) for r in rows] == [
        ("gap" if i == k else "record", at[i], at[i + 1] - at[i]) for i in range(5)]


def test_wrong_length_and_header():
    wrong = PARTS[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert read(PARTS[0] + wrong + PARTS[2])[0] == ["0", "2"]
    assert read(PARTS[0] + PARTS[1].replace(b"WARC-Type: ", b"WARC-Type ", 1) + PARTS[2])[0] == ["0", "2"]


def test_damaged_file_on_disk(spark, tmp_path):
    os.mkdir(tmp_path / "d")
    (tmp_path / "d" / "x.warc").write_bytes(PARTS[0] + b"???" + PARTS[1])
    rows = warc.read_archives(spark, str(tmp_path / "d")).collect()
    assert [r["kind"] for r in sorted(rows, key=lambda r: r["offset"])] == ["record", "gap", "record"]


def test_search_after_failures_is_linear():
    """Bad version lines, whole headers without a length, false gzip members: the good
    records behind them come back, and eight times the damage costs about eight times as much."""
    good = b"".join(record(k, b"x" * 20000) for k in range(100))
    for bad in (b"WARC/1.1\r\n", b"xWARC/1.0\r\nno field\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"\x1f\x8b\x08junk"):
        spent = []
        for n in (2000, 16000):
            t = time.perf_counter()
            found = list(warc.salvage(bad * n + b"\r\n" + good))
            spent.append(time.perf_counter() - t)
            assert [r["kind"] for r in found] == ["gap"] + ["record"] * 100
        assert spent[1] < 24 * spent[0] + 0.5 and spent[1] < 5


def test_large_member_is_quarantined():
    bomb, parts = warc._gzip(b"\0" * (8 << 20)), [warc._gzip(p) for p in PARTS]
    tracemalloc.start()
    rows = list(warc.salvage(parts[0] + bomb + parts[1], member_bytes=1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["kind"] for r in rows] == ["record", "gap", "record"] and rows[1]["length"] == len(bomb)
    assert "over" in rows[1]["reason"] and peak < 4 << 20
    assert [r["kind"] for r in warc.salvage(parts[0] + bomb[:-9])] == ["record", "gap"]
