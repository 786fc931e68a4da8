"""WARC and media round trips, with damaged archives."""

from __future__ import annotations

import hashlib
import zlib

from lodestone.llm import media, warc


def test_damaged_archives_give_the_other_records():
    records = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, None, False) for i in range(6)]
    members = [warc.member(r) for r in records]
    whole = b"".join(members)
    assert [r["page_id"] for r in warc.salvage(whole)] == list(range(6))
    broken = bytearray(whole)
    at = len(members[0]) + len(members[1])
    broken[at + 30] ^= 0xFF
    got = list(warc.salvage(bytes(broken)))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 1, 3, 4, 5]
    assert [(r["at"], r["size"]) for r in got if r["kind"] == "gap"] == [(at, len(members[2]))]
    got = list(warc.salvage(b"garbage" + whole[:-20]))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == list(range(5)) and got[0]["size"] == 7
    assert got[-1]["kind"] == "gap" and got[-1]["reason"] == "member is cut off"


def test_damaged_plain_records():
    records = [warc.record(i, None, b"p%d" % i, None, False) for i in range(4)]
    bad = records[1].replace(b"p1", b"q1")
    got = list(warc.salvage(records[0] + bad + b"junk" + records[2] + records[3][:-6]))
    assert [r["page_id"] for r in got if r["kind"] == "record"] == [0, 2]
    gaps = [(r["at"], r["size"]) for r in got if r["kind"] == "gap"]
    assert gaps == [(len(records[0]), len(bad) + 4), (len(records[0] + bad) + 4 + len(records[2]), len(records[3]) - 6)]
    mixed = list(warc.salvage(records[0] + warc.member(records[1]) + records[2]))
    assert [r["page_id"] for r in mixed] == [0, 1, 2]


def test_pages_come_back(spark):
    rows = [(1, "http://a/ b\n", "<p>é</p>", "s"), (2, None, "<p>é</p>", "s"), (3, "u", None, "s"), (4, "u", "", "s"), (None, "u", "alone", "s"), (9, "v", "x" * 100_000, "s"), (9, "v", "x" * 100_000, "s"), (10, "w", "y", "s")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    archives = warc.write(pages, roll=500)
    assert archives.count() >= 1
    found = warc.read(archives, payloads=True)
    assert found.filter("kind = 'gap'").count() == 0
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in found.collect()), key=str)
    wanted = []
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        holder = max((p for p, _, h, _ in rows if (h or "").encode() == body and p is not None), default=None)
        revisit = holder is not None and holder != page_id
        wanted.append((page_id, "revisit" if revisit else "response", holder if revisit else None, len(body), warc.digest_of(body), None if revisit else body))
    assert got == sorted(wanted, key=str)
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read(warc.write(pages, least=10**6)).collect()} == {"response"}


def test_png_round_trip():
    for body in (b"", b"a", bytes(range(256)), b"x" * 6400):
        payload = media.padded(body)
        assert len(payload) % 64 == 0 and payload and media.unpng(media.png(payload)) == payload
        assert media.png_size(media.png(payload)[: media.HEADER_BYTES]) == (64, len(payload) // 64)


def test_media_columns(spark):
    rows = [(1, "abc", 7), (2, None, 7), (3, "", 7), (4, "abc", 7), (None, "é" * 500, 7), (4, "abc", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long").repartition(3)
    stored = media.store(docs, roll=64)
    places = media.directory(stored)
    assert places.count() == 3
    found = {r.digest: r for r in media.decode(media.headers(places)).collect()}
    for r in stored.collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        payload = media.padded(text.encode())
        d = found[r.digest]
        assert r.n_bytes == len(text.encode()) and d.payload_sha256 == hashlib.sha256(payload).hexdigest() == r.digest
        assert d.tail_crc32 == zlib.crc32(payload[-64:]) and d.payload_bytes == len(payload) and (d.width, d.height) == (64, len(payload) // 64)
    assert media.store(docs.limit(0)).count() == 0


def test_shards_are_tar_files(spark):
    import tarfile

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    row = media.store(docs).first()
    with tarfile.open(row.shard.removeprefix("file://")) as tar:
        names = tar.getnames()
        held = tar.extractfile(f"{row.digest}.png").read()
    assert len(names) == 5 and media.unpng(held) == media.padded(b"text 0")


def test_an_intact_record_keeps_a_gzipped_record_in_its_payload():
    inner = warc.member(warc.record(7, "http://in", b"inner", None, False))
    outer = warc.record(1, "http://out", b"before " + inner + b" after", None, False)
    got = list(warc.salvage(outer + warc.record(2, None, b"next", None, False)))
    assert [(r["kind"], r.get("page_id")) for r in got] == [("record", 1), ("record", 2)]
    assert got[0]["payload"] == b"before " + inner + b" after"


def test_gaps_are_ranges_of_the_file():
    good = warc.record(1, None, b"x" * 400, None, False)
    raw = warc.member(b"junk " * 80 + good) + b"zzzz" + warc.member(good)
    got = list(warc.salvage(raw))
    assert [r["kind"] for r in got] == ["gap", "record", "gap", "record"]
    assert all(0 <= r["at"] and r["at"] + r["size"] <= len(raw) for r in got)
    assert raw[got[2]["at"] : got[2]["at"] + got[2]["size"]] == b"zzzz"
