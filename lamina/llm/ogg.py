"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps.

`mux` stores a payload as two interleaved logical streams: 8-bit samples (one payload byte each, RATE
a second) and a digest stream with the length and CRC-32 of every sample packet. `parse` reads any Ogg
bytes: it verifies page checksums, drops damaged pages and finds the next capture pattern, reassembles
packets over page borders, keeps logical streams apart by serial number and turns granule positions
into microseconds.

Defined results: a null text is the empty text; bytes without any page give no streams; a packet that a
lost or damaged page leaves incomplete is dropped and counted; repeated rows give equal values; other
input columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

RATE, PACKET, BLOCK = 8000, 32768, 64
SAMPLES, DIGESTS = 1, 2
_HEAD = struct.Struct("<4sBBqIIIB")
# Ogg's checksum is CRC-32 with the most significant bit first: zlib's on mirrored bytes.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    x = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream from (packet, granule position after it). The first packet has a page of its own."""
    out: list[bytes] = []

    def put(chunk: list[tuple[bytes, int]], last: bool) -> None:
        lacing, ends = bytearray(), {}
        for data, granule in chunk:
            lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
            ends[len(lacing) - 1] = granule
        body, at = b"".join(d for d, _ in chunk), 0
        for i in range(0, len(lacing), 255):
            part = bytes(lacing[i : i + 255])
            size = sum(part)
            done = [g for j, g in ends.items() if i <= j < i + 255]
            flags = (1 if i and lacing[i - 1] == 255 else 0) | (0 if out else 2) | (4 if last and i + 255 >= len(lacing) else 0)
            out.append(_page(flags, done[-1] if done else -1, serial, len(out), part, body[at : at + size]))
            at += size

    put(packets[:1], len(packets) == 1)
    if packets[1:]:
        put(packets[1:], True)
    return out


def mux(payload: bytes) -> bytes:
    """The payload as an Ogg file."""
    samples: list[tuple[bytes, int]] = [(b"\x80PCM8" + struct.pack("<IIQ", RATE, 1, len(payload)), 0)]
    digests: list[tuple[bytes, int]] = [(b"\x80CRC32" + struct.pack("<I", RATE), 0)]
    for i in range(0, len(payload), PACKET):
        part = payload[i : i + PACKET]
        samples.append((part, i + len(part)))
        digests.append((struct.pack("<II", len(part), zlib.crc32(part)), i + len(part)))
    a, b = pages(samples, SAMPLES), pages(digests, DIGESTS)
    out = [a[0], b[0]]
    for i in range(1, max(len(a), len(b))):
        out += a[i : i + 1] + b[i : i + 1]
    return b"".join(out)


def _rate(head: bytes) -> tuple[str, int, int]:
    """(codec, granules a second, granules before the start) from a stream's first packet."""
    if head[:5] == b"\x80PCM8" and len(head) >= 9:
        return "pcm8", int.from_bytes(head[5:9], "little"), 0
    if head[:6] == b"\x80CRC32" and len(head) >= 10:
        return "crc32", int.from_bytes(head[6:10], "little"), 0
    if head[:7] == b"\x01vorbis" and len(head) >= 16:
        return "vorbis", int.from_bytes(head[12:16], "little"), 0
    if head[:8] == b"OpusHead" and len(head) >= 12:
        return "opus", 48000, int.from_bytes(head[10:12], "little")
    if head[:8] == b"Speex   " and len(head) >= 40:
        return "speex", int.from_bytes(head[36:40], "little"), 0
    if head[:5] == b"\x7fFLAC" and len(head) >= 30:
        return "flac", int.from_bytes(head[27:30], "big") >> 4, 0
    return "unknown", 0, 0


def parse(data: bytes) -> dict[int, dict]:
    """Logical streams by serial number: codec, rate, pages, bad_pages, lost_packets, ended, and packets
    as (bytes, granule position or None, end time in microseconds or None). bad pages of unknown owner count under serial -1."""
    streams: dict[int, dict] = {}

    def stream(serial: int) -> dict:
        return streams.setdefault(serial, {"codec": "unknown", "rate": 0, "skip": 0, "pages": 0, "bad_pages": 0, "lost_packets": 0, "ended": False, "packets": [], "_part": None, "_next": None})

    at, size = data.find(b"OggS"), len(data)
    while at >= 0:
        if at + 27 > size:
            stream(-1)["bad_pages"] += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > size or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            stream(-1)["bad_pages"] += 1
            at = data.find(b"OggS", at + 4)
            continue
        s = stream(serial)
        gap = s["_next"] is not None and number != s["_next"]
        s["pages"] += 1
        s["_next"] = (number + 1) & 0xFFFFFFFF
        part = s["_part"]
        if part is not None and (gap or not flags & 1):
            s["lost_packets"] += 1
            part = None
        lost = flags & 1 and part is None  # the rest of a packet whose start is missing
        part, done, i = part or b"", [], at + 27 + n
        begin = i
        open_ = False
        for lace in lacing:
            i += lace
            open_ = lace == 255
            if not open_:
                if lost:
                    lost = False
                    s["lost_packets"] += 1
                else:
                    done.append(part + data[begin:i])
                part, begin = b"", i
        s["_part"] = part + data[begin:i] if open_ and not lost else None
        for k, packet in enumerate(done):
            if not s["packets"] and s["codec"] == "unknown":
                s["codec"], s["rate"], s["skip"] = _rate(packet)
            g = granule if k == len(done) - 1 and granule >= 0 else None
            s["packets"].append((packet, g, (max(0, g - s["skip"]) * 1_000_000 // s["rate"]) if g is not None and s["rate"] else None))
        s["ended"] |= bool(flags & 4)
        at = data.find(b"OggS", end)
    for s in streams.values():
        s["lost_packets"] += s.pop("_part") is not None
        s.pop("_next")
    return streams


def demux(data: bytes) -> tuple[bytes, dict]:
    """The payload that `mux` stored, checked against the digest stream, and its sample stream. ValueError for other or damaged bytes."""
    streams = parse(data)
    if SAMPLES not in streams or DIGESTS not in streams or streams[SAMPLES]["codec"] != "pcm8":
        raise ValueError("no sample and digest streams")
    s, d = streams[SAMPLES], streams[DIGESTS]
    parts = [p for p, _, _ in s["packets"][1:]]
    if [struct.pack("<II", len(p), zlib.crc32(p)) for p in parts] != [p for p, _, _ in d["packets"][1:]]:
        raise ValueError("sample packets differ from their digests")
    return b"".join(parts), s | {"all_pages": sum(x["pages"] for x in streams.values()), "bad": sum(x["bad_pages"] for x in streams.values())}


_STREAMS = "serial long, codec string, rate long, pages long, bad_pages long, lost_packets long, n_packets long, n_bytes long, ended boolean, end_us long"


def streams(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each logical stream of each Ogg file (binary column `content`): key and the figures of `parse`."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        for batch in batches:
            out = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for serial, s in parse(data or b"").items():
                    ends = [t for _, _, t in s["packets"] if t is not None]
                    out.append((k, serial, s["codec"], s["rate"], s["pages"], s["bad_pages"], s["lost_packets"], len(s["packets"]), sum(len(p) for p, _, _ in s["packets"]), s["ended"], max(ends, default=None)))
            names = [key, *[x.split()[0] for x in _STREAMS.split(", ")]]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return df.select(key, content).mapInArrow(run, f"`{key}` {kind}, {_STREAMS}")


def encode_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_bytes, media): each text as UTF-8, zero-padded to a positive multiple of BLOCK, as an Ogg file."""
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        for batch in batches:
            for sub in _slices(batch):
                raw = [(t or "").encode() for t in sub.column(1).to_pylist()]
                media = [mux(b + b"\0" * (-len(b) % BLOCK or (0 if b else BLOCK))) for b in raw]
                yield pa.RecordBatch.from_arrays([sub.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, media binary")


def _slices(batch: pa.RecordBatch, rows: int = 1000):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def features(df: DataFrame, key: str, media: str) -> DataFrame:
    """(key, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of files that `encode_texts` made, from the bytes read back.
    Null media has nulls alone; of other or damaged media there are media_bytes, media_sha256 and a feature that begins with error=."""
    kind = dict(df.select(key).dtypes)[key]
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            rest = batch.columns[2:]
            for data in batch.column(1).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                try:
                    payload, s = demux(data)
                    if not payload:
                        raise ValueError("no samples")
                except ValueError as e:
                    rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), f"error={e}"))
                    continue
                wave = np.frombuffer(payload, np.uint8)
                end = s["packets"][-1]
                feature = f"codec={s['codec']};rate={s['rate']};pages={s['all_pages']};bad={s['bad']};packets={len(s['packets'])};granule={end[1]};end_us={end[2]};mean_milli={int(wave.sum(dtype=np.int64)) * 1000 // len(wave)};peak={int(wave.max())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], [key, *batch.schema.names[2:], *names])

    others = [c for c in df.columns if c not in (key, media)]
    kinds = dict(df.dtypes)
    return df.select(key, media, *others).mapInArrow(run, ", ".join([f"`{key}` {kind}", *[f"`{c}` {kinds[c]}" for c in others], fields]))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = encode_texts(documents(spark, sf_dir), "doc_id", "text")
    return features(stored, "doc_id", "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
