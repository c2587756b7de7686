import hashlib
import random
import struct
import zlib

from lamina.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
    return crc


def test_checksum_equals_the_bitwise_definition():
    rng = random.Random(0)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


def test_round_trip_of_all_sizes():
    rng = random.Random(1)
    for n in [0, 1, 63, 64, 254, 255, 256, 510, 65024, 65025, 65026, 32768, 32769, 200_001, 1_000_000]:
        payload = rng.randbytes(n)
        back, stream = ogg.demux(ogg.mux(payload))
        assert back == payload and stream["ended"] and stream["bad"] == 0


def test_packets_cross_pages_and_carry_timestamps():
    packets = [(b"OpusHead\x01\x02" + struct.pack("<H", 312) + b"\0" * 7, 0), (b"a" * 70_000, 960), (b"", 1920), (b"b" * 255, 48312)]
    data = b"".join(ogg.pages(packets, 77))
    s = ogg.parse(data)[77]
    assert [p for p, _, _ in s["packets"]] == [p for p, _ in packets]
    assert s["codec"] == "opus" and s["packets"][-1][2] == 1_000_000 and s["lost_packets"] == 0 and s["pages"] >= 3


def test_damaged_and_missing_pages():
    parts = ogg.pages([(b"head", 0), (b"x" * 100_000, 5), (b"y" * 100_000, 9)], 5)
    broken = bytearray(parts[1])
    broken[200] ^= 1
    s = ogg.parse(parts[0] + bytes(broken) + b"junk OggS junk" + b"".join(parts[2:]))
    assert s[-1]["bad_pages"] >= 1 and s[5]["lost_packets"] >= 1
    assert [p for p, _, _ in s[5]["packets"]] == [b"head", b"y" * 100_000]
    s = ogg.parse(b"".join(parts[:-1]))[5]
    assert s["lost_packets"] == 1 and not s["ended"]
    assert ogg.parse(b"") == {} and ogg.parse(b"OggS")[-1]["bad_pages"] == 1


def test_query_with_edge_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "é" * 31 + "ab"), (3, "é" * 31 + "ab"), (4, "x" * 64), (None, "long " * 50_000)]
    spark.createDataFrame([(d, t, "m") for d, t in rows], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    out = ogg.op4_ogg_media(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media = ogg.mux(payload)
        want.append((d or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted((r[0] or -1, *r[1:7]) for r in out) == sorted(want)
    stored = ogg.encode_texts(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "text")
    streams = ogg.streams(stored, "doc_id", "media").collect()
    assert len(streams) == 2 * len(rows) and {s.codec for s in streams} == {"pcm8", "crc32"}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert ogg.op4_ogg_media(spark, str(tmp_path / "none")).count() == 0


def test_null_foreign_and_damaged_media(spark):
    good = ogg.mux(b"abc" + b"\0" * 61)
    broken = bytearray(good)
    broken[-1] ^= 1
    rows = [(1, None), (2, b""), (3, b"no ogg"), (4, bytearray(broken)), (5, good), (6, b"".join(ogg.pages([(b"OpusHead" + b"\0" * 8, 0)], 1))), (7, ogg.mux(b""))]
    got = {r.k: r for r in ogg.features(spark.createDataFrame(rows, "k long, media binary"), "k", "media").collect()}
    assert got[1][1:] == (None,) * 6 and got[5].payload_bytes == 64 and got[5].feature.startswith("codec=")
    for k in (2, 3, 4, 6, 7):
        assert got[k].feature.startswith("error=") and got[k].payload_bytes is None and got[k].media_bytes == len(rows[k - 1][1])


def plain_reader(data):
    """An independent reader, page by page from the format's text: (serial, sequence, flags, granule, segments, body) and packets by serial."""
    at, pages, packets, part = 0, [], {}, {}
    while at < len(data):
        assert data[at : at + 4] == b"OggS" and data[at + 4] == 0
        flags, granule = data[at + 5], int.from_bytes(data[at + 6 : at + 14], "little", signed=True)
        serial, number, crc = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (14, 18, 22))
        n = data[at + 26]
        segments = list(data[at + 27 : at + 27 + n])
        body = data[at + 27 + n : at + 27 + n + sum(segments)]
        whole = data[at : at + 27 + n + sum(segments)]
        assert slow_crc(whole[:22] + bytes(4) + whole[26:]) == crc
        assert bool(flags & 1) == (serial in part)
        k = 0
        for size in segments:
            part[serial] = part.get(serial, b"") + body[k : k + size]
            k += size
            if size < 255:
                packets.setdefault(serial, []).append((part.pop(serial), granule))
        pages.append((serial, number, flags, granule, segments))
        at += len(whole)
    assert not part
    return pages, packets


def test_files_hold_by_an_independent_reader():
    rng = random.Random(3)
    for n in (64, 254, 255, 256, 32768, 65536, 70_001):
        payload = rng.randbytes(n)
        pages, packets = plain_reader(ogg.mux(payload))
        assert [f & 2 for _, _, f, _, _ in pages[:2]] == [2, 2] and not any(f & 2 for _, _, f, _, _ in pages[2:])
        for serial in (ogg.SAMPLES, ogg.DIGESTS):
            own = [p for p in pages if p[0] == serial]
            assert [p[1] for p in own] == list(range(len(own)))
            assert [bool(p[2] & 4) for p in own] == [False] * (len(own) - 1) + [True]
            ends = [p[3] for p in own if p[3] >= 0]
            assert ends == sorted(ends) and ends[-1] == n
            # A page that ends no packet has no position.
            assert all((p[3] == -1) == all(s == 255 for s in p[4]) for p in own)
        assert b"".join(p for p, _ in packets[ogg.SAMPLES][1:]) == payload
        sizes = [struct.unpack("<II", p) for p, _ in packets[ogg.DIGESTS][1:]]
        assert sizes == [(len(p), zlib.crc32(p)) for p, _ in packets[ogg.SAMPLES][1:]]


def test_files_of_an_independent_writer_are_read():
    def page(flags, granule, serial, number, segments, body):
        head = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + serial.to_bytes(4, "little") + number.to_bytes(4, "little")
        tail = bytes([len(segments)]) + bytes(segments) + body
        return head + slow_crc(head + bytes(4) + tail).to_bytes(4, "little") + tail

    head = b"\x80PCM8" + struct.pack("<IIQ", 8000, 1, 765)
    data = page(2, 0, 9, 0, [len(head)], head) + page(0, -1, 9, 1, [255, 255], b"a" * 510) + page(2, 0, 4, 0, [3], b"xyz") + page(1, 765, 9, 2, [255, 0], b"a" * 255) + page(4, 800, 9, 3, [35, 0], b"b" * 35)
    s = ogg.parse(data)
    assert [(p, g, t) for p, g, t in s[9]["packets"]] == [(head, 0, 0), (b"a" * 765, 765, 95625), (b"b" * 35, None, None), (b"", 800, 100000)]
    assert s[9]["ended"] and s[9]["lost_packets"] == 0 and s[4]["codec"] == "unknown" and [p for p, _, _ in s[4]["packets"]] == [b"xyz"]
