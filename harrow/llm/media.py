"""MPEG audio as a carrier and as a column: write frames, resynchronise, read tags, tables and checksums.

``store`` puts a payload into the ancillary bytes of silent MPEG-1 layer III frames, behind an ID3v2 tag and a
Xing table; ``read`` parses any MPEG audio bytes. Frames that are damaged or preceded by junk are skipped to the
next header that a second header confirms. Results for odd input: null text is empty text; empty bytes have no
frames, duration 0 and no offsets; a stream of junk has all its bytes in ``skipped``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm.common import slices

# Fixed values of the MPEG audio standard: kbit/s by bitrate index, Hz by sample-rate index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: bits of the allocation of each subband, by table: a run of subbands for each number of bits.
SUBBANDS = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

ALIGN = 64
_SIDE = 32  # side information of MPEG-1 stereo layer III
_HEAD = 4 + 2 + _SIDE


class Header:
    """A parsed frame header."""

    __slots__ = ("version", "layer", "protected", "rate", "mono", "length", "samples", "side", "kind", "kbit", "bound")

    def __init__(self, word: int) -> None:
        self.version = word >> 19 & 3  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
        self.layer = 4 - (word >> 17 & 3)
        self.protected = not word >> 16 & 1
        first = self.version == 3
        kbit = BITRATES[1 if first else 2, self.layer if first or self.layer == 1 else 2][word >> 12 & 15]
        self.rate = RATES[self.version][word >> 10 & 3]
        pad, self.mono, self.kbit = word >> 9 & 1, word >> 6 & 3 == 3, kbit
        self.bound = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32  # subbands from which on both channels share their allocation
        if self.layer == 1:
            self.samples, self.length = 384, (12000 * kbit // self.rate + pad) * 4
        else:
            self.samples = 576 if self.layer == 3 and not first else 1152
            self.length = self.samples // 8 * 1000 * kbit // self.rate + pad
        self.side = ((17, 32) if first else (9, 17))[not self.mono] if self.layer == 3 else 0
        self.kind = word & 0xFFFE0C00  # what all frames of a stream share


@lru_cache(maxsize=4096)
def header(word: int) -> Header | None:
    """The header that a 32-bit word states, or None."""
    if word >> 21 != 0x7FF or word >> 19 & 3 == 1 or not word >> 17 & 3 or word >> 12 & 15 in (0, 15) or word >> 10 & 3 == 3:
        return None
    return Header(word)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005 from 0xFFFF."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFF00) ^ _CRC[value >> 8 ^ byte]
    return value


def _crc_bits(data: bytes, bits: int) -> int:
    """The checksum of a number of bits: whole bytes, then the first bits of the next."""
    value = crc16(data[: bits // 8])
    for i in range(bits % 8):
        high = value >> 15 ^ data[bits // 8] >> 7 - i & 1
        value = (value << 1 & 0xFFFF) ^ (0x8005 if high else 0)
    return value


def checked_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: the side information of layer III, the bit allocation of layer I, and
    that and the selection of scale factors of layer II, one for each channel of a subband that has bits."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    widths = [4] * 32
    if h.layer == 2:
        each = h.kbit / channels
        widths = SUBBANDS["lsf" if h.version != 3 else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if each <= 80 or h.rate == 48000 else "b"]
    whole, at, used = int.from_bytes(body[:64], "big") << 8 * max(0, 64 - len(body)), 0, 0
    for band, width in enumerate(widths):
        for _ in range(channels if band < h.bound else 1):
            given = whole >> 512 - at - width & (1 << width) - 1
            used += bool(given) * (1 if band < h.bound else channels)
            at += width
    return at + 2 * used if h.layer == 2 else at


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _word(index: int, protected: bool) -> int:
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | index << 12


_SIZES = [144_000 * kbit // 44100 for kbit in BITRATES[1, 3]]


def pad(payload: bytes) -> bytes:
    """Zeros up to a positive multiple of 64 bytes."""
    return payload + bytes(-len(payload) % ALIGN or (0 if payload else ALIGN))


@lru_cache(maxsize=16)
def _front(index: int) -> bytes:
    head = struct.pack(">I", _word(index, True))
    return head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


def store(payload: bytes) -> bytes:
    """MPEG audio that holds the payload: ID3v2 tag, Xing frame, then protected frames of variable bitrate."""
    frames, at, top = [], 0, len(_SIZES) - 1
    while at < len(payload):
        left = len(payload) - at
        index = top if left >= _SIZES[top] - _HEAD else next(i for i in range(1, top + 1) if _SIZES[i] - _HEAD >= left)
        room = _SIZES[index] - _HEAD
        frames.append(_front(index) + payload[at : at + room].ljust(room, b"\0"))
        at += room
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    lead = struct.pack(">I", _word(5, False)) + bytes(_SIDE)
    total, offsets, here = _SIZES[5] + sum(map(len, frames)), [], _SIZES[5]
    for frame in frames:
        offsets.append(here)
        here += len(frame)
    toc = bytes(min(255, offsets[i * len(offsets) // 100] * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"ID3\x03\0\0" + _synchsafe(len(tag)) + tag + (lead + xing).ljust(_SIZES[5], b"\0") + b"".join(frames)


def _tags(data: bytes) -> tuple[dict, int, int]:
    """Text frames of the ID3v2 tag, and where the audio begins and ends."""
    found, at, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        pos, at = 10, min(end, 10 + size + (10 if data[5] & 16 else 0))
        while pos + 10 <= at and data[pos : pos + 4].isalnum():
            n = struct.unpack(">I", data[pos + 4 : pos + 8])[0]
            if data[3] == 4:
                n = sum((b & 127) << s for b, s in zip(data[pos + 4 : pos + 8], (21, 14, 7, 0)))
            body = data[pos + 10 : min(at, pos + 10 + n)]
            name = data[pos : pos + 4].decode("ascii")
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                found[key] = value.rstrip("\0")
            pos += 10 + n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        found.setdefault("TIT2", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").strip())
    return found, at, end


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table in the frame at ``at``, if it holds one."""
    pos = at + 4 + (2 if h.protected else 0) + h.side
    if data[pos : pos + 4] in (b"Xing", b"Info"):
        flags, pos, out = struct.unpack(">I", data[pos + 4 : pos + 8])[0], pos + 8, {"kind": data[pos : pos + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = struct.unpack(">I", data[pos : pos + 4])[0]
                pos += 4
        if flags & 4:
            out["toc"] = list(data[pos : pos + 100])
        return out
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI" and len(data) >= pos + 26:
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", data[pos + 10 : pos + 26])
        steps = data[pos + 26 : min(pos + 26 + entries * width, at + h.length)]
        steps = [scale * int.from_bytes(steps[i : i + width], "big") for i in range(0, len(steps) - width + 1, width)] if width else []
        # seek table: byte positions, from the first audio frame, of every each-th frame
        return {"kind": "VBRI", "frames": frames, "bytes": size, "frames_per_entry": each, "seek": [0, *accumulate(steps)]}
    return None


def read(data: bytes) -> dict:
    """Parse MPEG audio. ``offsets`` are the byte positions of the audio frames, ``payload`` their ancillary bytes."""
    tags, at, end = _tags(data)
    unpack, offsets, parts = struct.Struct(">I").unpack_from, [], []
    skipped = good = bad = samples = rate = 0
    table, kind = None, None
    while at + 4 <= end:
        h = header(unpack(data, at)[0])
        stop = at + h.length if h else 0
        ok = h is not None and stop <= end and h.length > 4
        if ok and kind != h.kind and stop + 4 <= end:  # a first header counts when the next agrees
            after = header(unpack(data, stop)[0])
            ok = after is not None and after.kind == h.kind
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at, kind = skipped + nxt - at, nxt, None
            continue
        if table is None and not offsets and (table := _table(data, at, h)) is not None:
            at, kind = stop, h.kind
            continue
        front = 4 + h.side
        if h.protected:
            front += 2
            if h.layer == 3:
                same = crc16(data[at + 2 : at + 4] + data[at + 6 : at + front]) == data[at + 4] << 8 | data[at + 5]
            else:
                covered = data[at + 2 : at + 4] + data[at + 6 : stop]
                bits = 16 + checked_bits(h, covered[2:])
                same = bits <= 8 * len(covered) and _crc_bits(covered, bits) == data[at + 4] << 8 | data[at + 5]
            good, bad = good + same, bad + (not same)
        offsets.append(at)
        parts.append(data[at + front : stop])
        samples, rate, at, kind = samples + h.samples, h.rate, stop, h.kind
    payload = b"".join(parts)
    if tags.get("payload_bytes", "").isdigit():
        payload = payload[: int(tags["payload_bytes"])]
    return {
        "tags": tags, "table": table, "offsets": offsets, "samples": samples, "rate": rate, "crc_good": good, "crc_bad": bad,
        "skipped": skipped + max(0, end - at), "payload": payload,
    }


def feature(parsed: dict) -> str:
    """The parsed stream as one line: frames, exact duration, checksums, table and a digest of the seek offsets."""
    seek = zlib.crc32(struct.pack(f"<{len(parsed['offsets'])}q", *parsed["offsets"]))
    table = parsed["table"] or {}
    return (
        f"frames={len(parsed['offsets'])};samples={parsed['samples']};rate={parsed['rate']};crc={parsed['crc_good']}/{parsed['crc_bad']};"
        f"skipped={parsed['skipped']};table={table.get('kind', '')}:{table.get('frames', '')}:{table.get('bytes', '')};seek={seek:08x}"
    )


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, duration_samples long, sample_rate int, frame_offsets array<long>"
)


def store_texts(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): the text stored as MPEG audio, read back, with features.

    Null text is empty. Repeated rows give repeated rows; other columns are ignored. ``media`` has the stored bytes
    unless keep_media is false. No shuffle; a worker holds one Arrow slice.
    """
    schema = MEDIA_SCHEMA + (", media binary" if keep_media else "")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                media = store(pad(raw))
                got = read(media)
                back = got["payload"]
                rows.append((
                    doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature(got), got["samples"], got["rate"], got["offsets"], media,
                ))
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], types)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
