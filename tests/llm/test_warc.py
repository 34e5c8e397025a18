import hashlib
import base64
import random

from jobsieve.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_with_revisits_and_edges(spark, tmp_path):
    rows = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, "same"), (3, "http://c\r\nX: y", ""), (4, "u", None), (7, "u", "é" * 9000),
            (8, "u", "WARC/1.1\r\n\x1f fake\r\n\r\n"), (2, "http://b", "same"), (None, "u", "same"), (-1, "u", "neg")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    got = sorted(map(tuple, warc.archive_round_trip(spark, pages, str(tmp_path / "w")).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = i is not None and first[h or ""] != i
        want.append((i, len(b), digest(b), "revisit" if other else "response", first[h or ""] if other else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(spark, pages.where("false"), str(tmp_path / "none")).count() == 0


def test_min_revisit_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), min_revisit_bytes=4)
    assert {r.record_id: r.kind for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {
        "<urn:page:1>": "response", "<urn:page:2>": "response", "<urn:page:3>": "response", "<urn:page:4>": "revisit"}


def records(data):
    return [(h["warc-record-id"], at, n) for at, n, h, _, why in warc.salvage(data) if h is not None], [(at, n, why) for at, n, h, _, why in warc.salvage(data) if h is None]


def plain(i, body):
    return warc.record_bytes(i, "u", body, None, "2024-01-01T00:00:00Z")


def test_salvage_skips_damage_and_logs_gaps():
    rng = random.Random(1)
    parts = [plain(i, bytes(rng.randrange(256) for _ in range(400))) for i in range(6)]
    for pack in (lambda b: b, warc.gzip_member):
        packed = [pack(p) for p in parts]
        whole = b"".join(packed)
        ok, gaps = records(whole)
        assert [r[0] for r in ok] == [f"<urn:page:{i}>" for i in range(6)] and not gaps
        # damage inside record 2, garbage before record 4, record 5 cut off
        bad = bytearray(packed[2])
        bad[len(bad) // 2] ^= 0xFF
        junk = b"\x00garbage\x1f\x8b\x08 not a member WARC/1.1\r\n no header"
        data = packed[0] + packed[1] + bytes(bad) + packed[3] + junk + packed[4] + packed[5][:-30]
        ok, gaps = records(data)
        assert [r[0] for r in ok] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
        assert [g[0] for g in gaps] == [len(packed[0] + packed[1]), len(packed[0] + packed[1] + bytes(bad) + packed[3]), len(data) - len(packed[5]) + 30]
        covered = sorted([(a, n) for _, a, n in ok] + [(a, n) for a, n, _ in gaps])
        at = 0
        for a, n in covered:  # records and gaps tile the file
            assert a == at
            at += n
        assert at == len(data) and all(why for _, _, why in gaps)


def test_salvage_of_nothing_and_noise():
    assert list(warc.salvage(b"")) == []
    assert [(a, n) for a, n, h, _, _ in warc.salvage(b"noise only") if h is None] == [(0, 10)]
    assert [h for _, _, h, _, _ in warc.salvage(warc.EMPTY_MEMBER * 3)] == []


def other_record(kind, body, **headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x>", f"Content-Length: {len(body)}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_sound_records_of_other_writers_are_kept():
    page = b"<html>hello</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    sound = [
        other_record("response", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:" + digest(page), WARC_Block_Digest="sha1:" + digest(http)),
        other_record("response", http, Content_Type="application/http", WARC_Payload_Digest="md5:" + hashlib.md5(page).hexdigest()),
        other_record("response", page, WARC_Block_Digest="SHA-256:" + hashlib.sha256(page).hexdigest().upper()),
        other_record("response", page, WARC_Payload_Digest="sha1:" + digest(page).lower()),
        other_record("response", page, WARC_Payload_Digest="blake3:whatever", WARC_Block_Digest="sha1:not a digest"),
        other_record("response", chunked, Content_Type="application/http", WARC_Payload_Digest="sha1:" + digest(b"hello")),
        other_record("warcinfo", b"software: x"),
    ]
    for data in (b"".join(sound), b"".join(map(warc.gzip_member, sound)), warc.gzip_member(b"".join(sound))):
        ok, gaps = records(data)
        assert len(ok) == len(sound) and not gaps
    for wrong in (other_record("response", http, Content_Type="application/http", WARC_Payload_Digest="sha1:" + digest(http)),
                  other_record("response", page, WARC_Block_Digest="md5:" + hashlib.md5(b"x").hexdigest())):
        assert [why for *_, why in records(wrong)[1]] and not records(wrong)[0]


def test_damage_inside_a_member_of_several_records():
    parts = [other_record("response", bytes([65 + i]) * 50, WARC_Block_Digest="sha1:" + digest(bytes([65 + i]) * 50)) for i in range(4)]
    bad = bytearray(parts[1])
    bad[-10] ^= 1
    member = warc.gzip_member(parts[0] + bytes(bad) + parts[2])
    found = list(warc.salvage(member + warc.gzip_member(parts[3])))
    assert [b[:1] for *_, h, b, _ in found if h is not None] == [b"A", b"C", b"D"]
    assert [(a, n, why) for a, n, h, _, why in found if h is None] == [(0, len(member), "block digest differs")]


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 400) for i in range(40)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), file_bytes=120_000)
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) <= 120_000
    assert warc.read_archives(spark, str(tmp_path / "w")).where("kind = 'response'").count() == 40
