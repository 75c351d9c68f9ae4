"""Media, tokens and packing: exact round trips and brute-force versions."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from harrow.llm import bpe, media, packing

ODD = [None, "", "a", " ", "\n\n  x", "é" * 3, "x" * 5000, "don't we'll 12345 \x1c\x1f z  q", "<|endoftext|> hi <|endoftext|>", "日本語 テキスト 🎉🎉", "aa " * 4000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, feature string")


def test_media_round_trip(spark):
    rows = {r.doc_id: r for r in media.store_texts(docs(spark, [*ODD, "a"])).collect()}
    for i, text in enumerate([*ODD, "a"]):
        payload = media.pad((text or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert rows[2].media_sha256 == rows[len(ODD)].media_sha256
    assert media.store_texts(docs(spark, []).limit(0)).count() == 0


def test_media_resynchronises():
    payload = bytes(random.Random(1).randrange(256) for _ in range(64 * 100))
    whole = media.store(payload)
    clean = media.read(whole)
    assert clean["payload"] == payload and clean["crc_bad"] == 0 and clean["skipped"] == 0
    assert clean["table"]["frames"] == len(clean["offsets"]) and clean["samples"] == 1152 * len(clean["offsets"])
    assert all(whole[o] == 255 for o in clean["offsets"])
    first = clean["offsets"][0]
    junk = whole[:first] + b"\xff\xfbjunk" * 9 + whole[first:]
    got = media.read(junk)
    assert got["payload"] == payload and got["skipped"] == 208 + 54  # the table frame is not confirmed by a next header
    hurt = bytearray(whole)
    hurt[first + 20] ^= 1
    assert media.read(bytes(hurt))["crc_bad"] == 1
    assert media.read(b"")["offsets"] == [] and media.read(b"\xff" * 500)["skipped"] == 500
    assert media.read(whole + b"TAG" + b"name".ljust(125, b"\0"))["tags"]["TIT2"] == "name"


def test_codec_is_tiktoken(spark):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é\n\t '’1²Ⅷ_- \x1d漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
    rows = bpe.encode_texts(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(rows) == len(ODD) and all(len(r["ids"]) == r.n_tokens for r in rows)


def test_packing_covers_every_id(spark):
    texts = [*ODD, *[" ".join(random.Random(i).choice(["alpha", "beta", "of"]) for _ in range(random.Random(i).randrange(2500))) for i in range(60)]]
    path = P.path("byte_bpe_50k.json")
    truth = Tokenizer.from_file(path)
    rows = packing.pack_texts(docs(spark, texts).coalesce(1), path, P.PATTERN).toPandas()
    for i, text in enumerate(texts):
        ids = [*truth.encode(text or "", add_special_tokens=False).ids, 0]
        own = rows[rows.doc_id == i].sort_values("start")
        assert [x for part in own.ids for x in part] == ids and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for p, c in zip(own.ids, own.ids_crc32))
    fill = 0
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
        fill += own.length.sum()
    assert rows.sequence_id.nunique() == -(-fill // 1024)
    assert packing.pack_texts(docs(spark, []).limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_tightest_window(seed):
    rng, tree, held = random.Random(seed), packing.CapacityTree(64), []
    for step in range(400):
        if rng.random() < 0.5:
            capacity = rng.randrange(65)
            tree.add(capacity, step)
            held.append(capacity)
        else:
            least = rng.randrange(65)
            want = min((c for c in held if c >= least), default=None)
            got = tree.take(least)
            assert (got[0] if got else None) == want
            if got:
                held.remove(want)


def plain_crc(bits):
    value = 0xFFFF
    for bit in bits:
        high = (value >> 15) ^ bit
        value = (value << 1) & 0xFFFF
        value ^= 0x8005 if high else 0
    return value


def bits_of(data):
    return [b >> 7 - i & 1 for b in data for i in range(8)]


@pytest.mark.parametrize(
    "layer,mode,kbit_index,rate_index,widths",
    [(1, 0, 9, 0, [4] * 32), (1, 3, 9, 0, [4] * 32), (1, 0x15 & 1, 9, 1, [4] * 32), (2, 0, 10, 0, [4] * 11 + [3] * 12 + [2] * 7), (2, 0, 10, 1, [4] * 11 + [3] * 12 + [2] * 4), (2, 3, 2, 0, [4] * 2 + [3] * 6), (2, 3, 1, 2, [4] * 2 + [3] * 10), (2, 1, 9, 0, [4] * 11 + [3] * 12 + [2] * 4), (2, 1, 10, 0, [4] * 11 + [3] * 12 + [2] * 7)],
)
def test_checksums_of_layers_one_and_two(layer, mode, kbit_index, rate_index, widths):
    """Frames of random bits, whose covered bits are counted here one by one from the standard's description."""
    rng, stream, spoilt = random.Random(layer * 10 + mode), b"", 0
    for n in range(6):
        extension = rng.randrange(4)
        word = 0x7FF << 21 | 3 << 19 | (4 - layer) << 17 | kbit_index << 12 | rate_index << 10 | mode << 6 | extension << 4
        h = media.header(word)
        body = bytes(rng.choice([0, 255, rng.randrange(255)]) for _ in range(h.length - 6))
        bound, channels = (4 * (extension + 1) if mode == 1 else 32), 1 if mode == 3 else 2
        own, at, scale = bits_of(body), 0, 0
        for band, width in enumerate(widths):
            for channel in range(channels):
                if channel and band >= bound:
                    continue
                if any(own[at : at + width]):
                    scale += channels if band >= bound else 1
                at += width
        covered = at + (2 * scale if layer == 2 else 0)
        crc = plain_crc(bits_of(word.to_bytes(4, "big")[2:]) + own[:covered])
        if n == 3:
            crc, spoilt = crc ^ 1, 1
        stream += word.to_bytes(4, "big") + crc.to_bytes(2, "big") + body
    got = media.read(stream)
    assert (got["crc_good"], got["crc_bad"], len(got["offsets"])) == (5, spoilt, 6)


def test_vbri_table():
    frame = media.header(media._word(9, False))
    head = media._word(9, False).to_bytes(4, "big")
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, 5000, 12, 3, 2, 2, 4) + struct.pack(">HHH", 100, 200, 300)
    first = (head + bytes(32) + vbri).ljust(frame.length, b"\0")
    got = media.read(first + (head + bytes(frame.length - 4)) * 12)
    assert got["table"] == {"kind": "VBRI", "frames": 12, "bytes": 5000, "frames_per_entry": 4, "seek": [0, 200, 600, 1200]} and len(got["offsets"]) == 12
    assert "table=VBRI:12:5000" in media.feature(got)
