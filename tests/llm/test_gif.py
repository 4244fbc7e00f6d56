import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manylabel.llm import gif as g

from .helpers import SCHEMA, documents, texts, write

RNG = np.random.default_rng(0)
SAMPLES = [b"", b"a", b"a" * 575, b"ab" * 288, RNG.integers(0, 256, 577, np.uint8).tobytes(), bytes(i % 7 for i in range(5000)), RNG.integers(0, 256, 5000, np.uint8).tobytes()]


@pytest.mark.parametrize("data", SAMPLES)
def test_round_trip(data):
    frames = g.read_gif(g.write_gif(data)).frames
    assert b"".join(f.samples for f in frames) == g.pad(data)
    assert [f.start_ms for f in frames] == [100 * k for k in range(len(frames))]


@pytest.mark.parametrize("data", [RNG.integers(0, 256, 90_000, np.uint8).tobytes(), b"ab" * 45_000, b"a" * 90_000])
def test_large_frames_fill_the_code_table(data):
    assert g.read_gif(g.write_gif(data, side=300)).frames[0].samples == data


def test_both_encoders_agree():
    frames = [RNG.integers(0, 6, g.FRAME, np.uint8).tobytes() for _ in range(30)]
    codes, n = g._codes_side_by_side(np.frombuffer(b"".join(frames), np.uint8).reshape(30, -1))
    assert codes.tolist() == [c for f in frames for part in g._codes_one_by_one(f, 8) for c in part]
    assert n.sum() == len(codes)


def animation(*frames) -> bytes:
    """A 4 x 2 canvas with four shared colours; frames are (left, top, w, h, samples, disposal, clear, interlaced, own palette)."""
    out = [b"GIF89a", (4).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"\xf1\0\0", bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for left, top, w, h, samples, disposal, clear, interlaced, own in frames:
        out.append(b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + (5).to_bytes(2, "little") + bytes([clear or 0]) + b"\0")
        out.append(b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([(0x40 if interlaced else 0) | (0x81 if own else 0)]) + (own or b""))
        out.append(b"\x02" + g._blocks(g._lzw_pack([bytes(samples)], 2)[0]))
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_palettes_and_interlacing():
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = animation(
        (0, 0, 4, 2, [1] * 8, 1, None, False, None),  # all red, stays
        (1, 0, 2, 1, [2, 3], 2, 3, False, None),  # green, and a hole; then cleared
        (0, 1, 2, 1, [3, 3], 3, None, False, None),  # blue; then as before
        (0, 0, 1, 2, [0, 1], 0, None, True, own),
    )
    a, b, c, d = g.read_gif(data).frames
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert a.colours.tolist() == [[red] * 4] * 2
    assert b.colours.tolist() == [[red, green, red, red], [red] * 4]
    assert c.colours.tolist() == [[red, none, none, red], [blue, blue, red, red]]
    assert d.colours.tolist() == [[[9, 9, 9], none, none, red], [[8, 8, 8], red, red, red]]
    assert [f.start_ms for f in (a, b, c, d)] == [0, 50, 100, 150]
    assert g.histograms([a]).sum() == 8


def test_first_clear_code_may_be_missing():
    body = g._lzw_pack([b"\1\2\1\2\3\0"], 2)[0]
    bare = (int.from_bytes(body, "little") >> 3).to_bytes(len(body), "little")
    assert g._lzw_unpack([bare, body], 2, [6, 6]) == [b"\1\2\1\2\3\0"] * 2


def test_damaged_files(spark):
    good = g.write_gif(b"abc")
    for bad in (b"", b"GIF89a", good[:-300], b"PNG" + good):
        with pytest.raises(ValueError):
            g.read_gif(bad)
    d = spark.createDataFrame([(1, good), (2, good[:-300]), (3, None)], "k int, media binary")
    got = {r["k"]: (r["frames"], r["error"]) for r in g.frame_columns(d).collect()}
    assert len(got[1][0]) == 1 and got[1][1] is None
    assert got[2][0] is None and got[2][1] and got[3] == (None, None)


def test_query(spark, tmp_path):
    sf = write(documents(spark), tmp_path)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in g.op2_gif_columns(spark, sf).collect())
    want = []
    for i, t in texts():
        p = g.pad((t or "").encode())
        want.append((str(i), len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert got == sorted(want)


def decoded_plainly(data: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    """Samples and palette of a file of whole frames with a global palette, one code after another."""
    palette = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(256)]
    at, out = 13 + 768, []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        assert data[at] == 0x2C and not data[at + 9] & 0xC0  # neither a palette of its own nor interlaced
        size, at, bits = data[at + 10], at + 11, bytearray()
        while data[at]:
            bits += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        stream, place, clear = int.from_bytes(bits, "little"), 0, 1 << size
        width, table, last = size + 1, [], None
        while True:
            code = stream >> place & ((1 << width) - 1)
            place += width
            if code == clear:
                width, table, last = size + 1, [bytes([i]) for i in range(clear)] + [b"", b""], None
            elif code == clear + 1:
                break
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                out.append(entry)
                if last is not None and len(table) < 4096:
                    table.append(last + entry[:1])
                last = entry
                width = max(width, min(12, len(table).bit_length())) if len(table) < 4096 else 12
    return b"".join(out), palette


def test_every_column_on_the_real_table(spark, sf):
    """The stored files, read by a decoder that shares nothing with the operator, give all columns of the query."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stored = {r["doc_id"]: r["media"] for r in g.to_gif(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("samples")), "samples").collect()}
    texts_ = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: r for r in g.op2_gif_columns(spark, sf).collect()}
    assert len(got) == len(texts_)
    for i, raw in texts_.items():
        payload, palette = decoded_plainly(stored[i])
        padded = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        bins = [0] * 64
        for x, n in Counter(payload).items():
            red, green, blue = (c // 64 for c in palette[x])
            bins[16 * red + 4 * green + blue] += n
        want = (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(stored[i]), hashlib.sha256(stored[i]).hexdigest(), ",".join(map(str, bins)))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        assert payload == padded and tuple(got[i][n] for n in names) == want


def test_stored_columns(spark, tmp_path):
    d = documents(spark).select("doc_id", "lang", F.col("text").cast("binary").alias("samples"))
    g.to_gif(d, "samples").write.parquet(str(tmp_path / "media"))
    rows = g.frame_columns(spark.read.parquet(str(tmp_path / "media"))).collect()
    assert len(rows) == len(texts()) and all((r["media"] is None) == (r["n_bytes"] is None) for r in rows)
    assert all(sum(f["histogram"]) == g.FRAME for r in rows for f in r["frames"] or [])
    assert g.to_gif(spark.createDataFrame([], SCHEMA).select(F.col("text").cast("binary").alias("x")), "x").count() == 0
