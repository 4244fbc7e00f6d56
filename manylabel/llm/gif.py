"""GIF as a media column: write, read back, and describe timed frames.

:func:`write_gif` stores 8-bit samples as frames of LZW code streams with a global palette;
:func:`read_gif` parses any GIF: it decodes the code streams (clear codes, growing widths, deferred
full tables), local and global palettes, interlacing, frame rectangles, transparency and the
disposal methods, and returns frames as they show with their start times.
:func:`to_gif` and :func:`frame_columns` run both on Spark, one narrow pass each without a
shuffle: memory holds one Arrow batch and one image at a time.

Defined results: null bytes give null columns; empty samples give one frame of padding; samples of
any length are padded with 255 to whole frames; repeated rows are stored alike; an empty table
gives an empty table. A damaged file raises ``ValueError`` in :func:`read_gif`, and
gives a null list of frames and an error text in :func:`frame_columns`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SIDE = 24
FRAME = SIDE * SIDE
DELAY_MS = 100
#: Levels of each colour channel in a histogram, and its number of bins.
LEVELS = 4
BINS = LEVELS**3

_FULL = 4096
#: Three bits of red, three of green, two of blue: each sample has a colour of its own.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85) for i in range(256)], np.uint8)


@lru_cache(maxsize=16)
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of each code of a stretch: the clear code, then code 1, 2, ... until the table is full."""
    free = (1 << size) + 2 + np.maximum(np.arange(3 * _FULL) - 2, 0)
    width = np.minimum(np.floor(np.log2(free)).astype(np.int64) + 1, 12)
    width[0] = size + 1
    return np.cumsum(width) - width, width


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _codes_one_by_one(data: bytes, size: int) -> list[list[int]]:
    """A frame's codes, a list for each stretch: clear code, codes, and after the last the end code."""
    clear = 1 << size
    free, seen, codes, out = clear + 2, {}, [clear], []
    prefix = data[0]
    for c in data[1:]:
        key = prefix << 8 | c
        code = seen.get(key)
        if code is None:
            codes.append(prefix)
            seen[key] = free
            free += 1
            prefix = c
            if free == _FULL:  # start again with an empty table
                out.append(codes)
                seen, free, codes = {}, clear + 2, [clear]
        else:
            prefix = code
    return [*out, [*codes, prefix, clear + 1]]


_SLOTS = 2048


def _codes_side_by_side(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of equally long frames whose tables cannot fill up, and their number for each frame.

    All frames advance one sample at a time; each has an open-addressing table of its own.
    """
    many, n = frames.shape
    row = np.arange(many, dtype=np.int64) * _SLOTS
    keys, vals = np.full(many * _SLOTS, -1, np.int32), np.zeros(many * _SLOTS, np.int32)
    columns = np.ascontiguousarray(frames.T).astype(np.int32)
    prefix, free = columns[0], np.full(many, 258, np.int32)
    out = np.full((n + 2, many), -1, np.int16)
    out[0] = 256
    for t in range(1, n):
        c = columns[t]
        key = prefix << 8 | c
        at = row + ((key * 40503 >> 5) & (_SLOTS - 1))
        found = keys[at]
        other = np.flatnonzero((found != key) & (found >= 0))
        while len(other):  # another key has this slot
            at[other] = row[other] + ((at[other] - row[other] + 1) & (_SLOTS - 1))
            found[other] = keys[at[other]]
            other = other[(found[other] != key[other]) & (found[other] >= 0)]
        new = np.flatnonzero(found < 0)
        out[t, new] = prefix[new]
        slot = at[new]
        keys[slot] = key[new]
        prefix = vals[at]
        prefix[new] = c[new]
        vals[slot] = free[new]
        free[new] += 1
    out[n], out[n + 1] = prefix, 257
    by_frame = out.T
    used = by_frame >= 0
    return by_frame[used].astype(np.int64), used.sum(axis=1)


def _lzw_pack(frames: list[bytes], size: int = 8) -> list[bytes]:
    """The code stream of each frame, bits from the least significant up; all frames are packed at once."""
    offsets, widths = _layout(size)
    n_samples = {len(f) for f in frames}
    if size == 8 and len(n_samples) == 1 and n_samples < set(range(1, _SLOTS // 2)):
        codes, n = _codes_side_by_side(np.frombuffer(b"".join(frames), np.uint8).reshape(len(frames), -1))
        of = np.arange(len(frames))
    else:
        stretches = [(k, x) for k, data in enumerate(frames) for x in _codes_one_by_one(data, size)]
        codes = np.array([c for _, x in stretches for c in x], np.int64)
        n, of = np.array([len(x) for _, x in stretches]), np.array([k for k, _ in stretches])
    # a later stretch opens with a clear code of the width reached, not of the least width
    reset = np.concatenate([[False], of[1:] == of[:-1]])
    extra = np.where(reset, widths[np.concatenate([[0], n[:-1]])] - widths[0], 0)
    length = offsets[n - 1] + widths[n - 1] + extra
    size_of = (np.bincount(of, weights=length).astype(np.int64) + 7) // 8
    first = np.cumsum(size_of) - size_of
    before = np.cumsum(length) - length
    begin = 8 * first[of] + before - before[np.searchsorted(of, np.arange(len(frames)))][of]
    within = _within(n)
    at = np.repeat(begin, n) + offsets[within]
    at += np.where(within > 0, np.repeat(extra, n), 0) if reset.any() else 0
    value = codes << (at & 7)
    at >>= 3
    out = np.zeros(int(size_of.sum()) + 3, np.uint8)
    for k in range(3):
        np.add.at(out, at + k, (value >> (8 * k)).astype(np.uint8))
    raw = out.tobytes()
    return [raw[a : a + m] for a, m in zip(first.tolist(), size_of.tolist())]


def _expand(codes: np.ndarray, n: np.ndarray, size: int) -> tuple[bytes, np.ndarray]:
    """The samples of stretches of codes (without clear and end codes), and their number for each stretch.

    Code ``258 + j`` of a stretch stands for what its code j stands for and one sample more, the
    first of code j + 1. So codes form chains to plain samples, which all are followed at once.
    """
    roots = (1 << size) + 2
    start = np.repeat(np.cumsum(n) - n, n)
    here = np.arange(len(codes))
    plain = codes < roots - 2
    parent = np.where(plain, here, start + codes - roots)
    if (parent > here).any() or (~plain & (parent == here)).any() or (codes[~plain] < roots).any():
        raise ValueError("a code refers to no entry")
    length, first, top, todo = np.ones(len(codes), np.int64), here.copy(), parent.copy(), np.flatnonzero(~plain)
    while len(todo):  # up by one link a round
        length[todo] += 1
        first[todo] = top[todo]
        top[todo] = parent[top[todo]]
        todo = todo[first[todo] != top[todo]]
    head = codes[first]
    last = np.where(plain, codes, head[np.minimum(parent + 1, len(codes) - 1)])
    end = np.cumsum(length)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    at, walk = end - 1, here
    while len(walk):
        out[at] = last[walk]
        more = parent[walk] != walk
        at, walk = at[more] - 1, parent[walk[more]]
    return out.tobytes(), np.add.reduceat(length, np.cumsum(n) - n) if len(n) else n


def _lzw_unpack(bodies: list[bytes], size: int, wanted: list[int]) -> list[bytes]:
    """The samples of code streams with one code size; the first stretches of all are decoded at once."""
    offsets, widths = _layout(size)
    clear = 1 << size
    raw = np.frombuffer(b"".join([*bodies, b"\0\0\0"]), np.uint8).astype(np.int64)
    wide = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    bits = 8 * np.array([len(b) for b in bodies], np.int64)
    base = np.cumsum(bits) - bits
    ends = offsets + widths

    def read(begin: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of one stretch at each bit position, their number, and the code that ended each (-1: none)."""
        n = np.searchsorted(ends, room, side="right")
        within = _within(n)
        at = np.repeat(begin, n) + offsets[within]
        flat = wide[at >> 3] >> (at & 7) & (1 << widths[within]) - 1
        stop = np.flatnonzero(((flat == clear) | (flat == clear + 1)) & (within > 0))
        edge = np.cumsum(n)
        near = np.searchsorted(stop, edge - n)
        cut = np.where(near < len(stop), np.append(stop, 0)[np.minimum(near, len(stop))], len(flat))
        cut = np.minimum(cut, edge)
        by = np.where(cut < edge, np.append(flat, -1)[np.minimum(cut, len(flat))], -1)
        used = cut - (edge - n) - 1
        keep = (within > 0) & (within <= np.repeat(used, n))
        return flat[keep], np.maximum(used, 0), by

    opens = np.array([len(b) > 1 and (b[0] | b[1] << 8) & (2 * clear - 1) == clear for b in bodies])
    if not opens.all():  # some writers leave the first clear code out
        return _lzw_unpack([b if o else _led(b, size) for b, o in zip(bodies, opens)], size, wanted)
    codes, n, by = read(base, bits)
    some = n > 0
    samples, got = _expand(codes, n[some], size)
    counts = np.zeros(len(bodies), np.int64)
    counts[some] = got
    edge, out = np.cumsum(counts), []
    for k, want in enumerate(wanted):
        own = samples[edge[k] - counts[k] : edge[k]]
        at, used, end = int(base[k]), int(n[k]), int(by[k])
        while len(own) < want and end == clear:  # the clear code opens a further stretch
            at += int(offsets[used + 1] + widths[used + 1] - widths[0])
            more, m, e = read(np.array([at]), np.array([base[k] + bits[k] - at]))
            used, end = int(m[0]), int(e[0])
            own += _expand(more, m, size)[0] if used else b""
        if len(own) < want:
            raise ValueError("the code stream ends early")
        out.append(own[:want])
    return out


def _led(body: bytes, size: int) -> bytes:
    """The code stream with the clear code that its writer left out."""
    return (int.from_bytes(body, "little") << size + 1 | 1 << size).to_bytes(len(body) + 2, "little")


#: Frames that are coded side by side, and rows of a batch of results.
_TOGETHER, _ROWS = 2000, 200


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for i in range(0, len(data), 255) if (part := data[i : i + 255])) + b"\0"


def pad(samples: bytes, unit: int = FRAME) -> bytes:
    return samples + b"\xff" * (-len(samples) % unit or (0 if samples else unit))


def write_gifs(many: list[bytes], side: int = SIDE, delay_ms: int = DELAY_MS, palette: np.ndarray = PALETTE) -> list[bytes]:
    """Each item's samples as a GIF89a of square opaque frames that show for ``delay_ms``."""
    n = side * side
    frames = [[x[at : at + n] for at in range(0, len(x), n)] for x in (pad(x, n) for x in many)]
    flat = [f for own in frames for f in own]
    streams = iter([s for at in range(0, len(flat), _TOGETHER) for s in _lzw_pack(flat[at : at + _TOGETHER])])
    top = b"".join([b"GIF89a", struct.pack("<HHBBB", side, side, 0xF7, 0, 0), palette.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"])
    head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_ms // 10, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, side, side, 0) + b"\x08"
    return [b"".join([top, *(part for _ in own for part in (head, _blocks(next(streams)))), b"\x3b"]) for own in frames]


def write_gif(samples: bytes, **options) -> bytes:
    return write_gifs([samples], **options)[0]


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    samples: bytes  # as stored in the frame's rectangle, rows from the top
    colours: np.ndarray  # the whole canvas as it shows: height x width x 3


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def _parse(data: bytes) -> tuple[int, int, list[tuple]]:
    """Width, height, and of each frame its place, palette, code stream, time and way of drawing."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    try:
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        images, delay, clear_index, disposal = [], 0, None, 0

        def sub_blocks(at: int) -> tuple[bytes, int]:
            parts = []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += 1 + n
            return b"".join(parts), at + 1

        while data[at] != 0x3B:
            if data[at] == 0x21:
                label, (body, at) = data[at + 1], sub_blocks(at + 2)
                if label == 0xF9:
                    packed, hundredths, index = struct.unpack("<BHB", body[:4])
                    delay, disposal, clear_index = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
                continue
            if data[at] != 0x2C:
                raise ValueError("a block has no known kind")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, shared
            if packed & 0x80:
                n = 3 << (packed & 7) + 1
                own, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if own is None:
                raise ValueError("a frame has no palette")
            size = data[at]
            if not 1 <= size <= 8:
                raise ValueError("a frame has no known code size")
            body, at = sub_blocks(at + 1)
            images.append((left, top, w, h, packed & 0x40, own, size, body, delay, clear_index, disposal))
            delay, clear_index, disposal = 0, None, 0
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e
    return width, height, images


def read_gifs(many: list[bytes]) -> list[Gif]:
    """Parses and renders whole files; their code streams are decoded together."""
    files = [_parse(x) for x in many]
    every = [x for f in files for x in f[2]]
    decoded: list[bytes] = [b""] * len(every)
    for size in {x[6] for x in every}:
        which = [k for k, x in enumerate(every) if x[6] == size]
        for at in range(0, len(which), _TOGETHER):
            part = which[at : at + _TOGETHER]
            for k, samples in zip(part, _lzw_unpack([every[k][7] for k in part], size, [every[k][2] * every[k][3] for k in part])):
                decoded[k] = samples
    todo = iter(decoded)
    return [_render(*f, [next(todo) for _ in f[2]]) for f in files]


def read_gif(data: bytes) -> Gif:
    return read_gifs([data])[0]


def _render(width: int, height: int, images: list[tuple], decoded: list[bytes]) -> Gif:
    """Frames as they show, drawn one after another on a canvas."""
    out, canvas, start = Gif(width, height), np.zeros((height, width, 3), np.uint8), 0
    for (left, top, w, h, interlaced, own, _, _, delay, clear_index, disposal), samples in zip(images, decoded):
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if interlaced:
            order = np.concatenate([np.arange(s, h, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(index)
            straight[order] = index
            index, samples = straight, straight.tobytes()
        if len(own) < 256 and index.size and index.max() >= len(own):
            raise ValueError("a sample has no colour")
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        visible = index[: area.shape[0], : area.shape[1]]
        if clear_index is None:
            area[:] = own[visible]
        else:
            np.copyto(area, own[visible], where=(visible != clear_index)[..., None])
        out.frames.append(Frame(start, delay, samples, canvas.copy()))
        start += delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
    return out


def histograms(frames: list[Frame]) -> np.ndarray:
    """The number of pixels of each colour, ``LEVELS`` levels a channel, one row for each frame."""
    if not frames:
        return np.zeros((0, BINS), np.int32)
    c = np.stack([f.colours for f in frames]).reshape(len(frames), -1, 3) // (256 // LEVELS)
    bins = (c[..., 0].astype(np.int64) * LEVELS + c[..., 1]) * LEVELS + c[..., 2] + np.arange(len(frames))[:, None] * BINS
    return np.bincount(bins.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS).astype(np.int32)




def to_gif(docs: DataFrame, samples: str, media: str = "media") -> DataFrame:
    """All columns with the binary column ``samples`` replaced by ``media`` and ``n_bytes`` (the samples' number before padding)."""
    keep = [c for c in docs.columns if c not in (samples, media, "n_bytes")]
    d = docs.select(*keep, samples)
    fields = [f for f in d.schema.fields if f.name in keep]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{media}` binary", "n_bytes long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                raw = [x.as_py() for x in b.column(b.num_columns - 1)]
                stored = iter(write_gifs([x for x in raw if x is not None]))
                own = [pa.array([None if x is None else next(stored) for x in raw], pa.binary()), pa.array([None if x is None else len(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], [*keep, media, "n_bytes"])

    return d.mapInArrow(run, ddl)


def _read_each(stored: list[bytes | None]) -> list[tuple[list[Frame], str | None]]:
    """Frames or an error for each file; a damaged one does not touch the others."""
    try:
        found = iter(read_gifs([x for x in stored if x is not None]))
        return [([], None) if x is None else (next(found).frames, None) for x in stored]
    except ValueError as e:
        if len(stored) == 1:
            return [([], str(e))]
        return [pair for x in stored for pair in _read_each([x])]


FRAME_TYPE = "array<struct<start_ms:int,delay_ms:int,histogram:array<int>>>"


def frame_columns(media_rows: DataFrame, media: str = "media") -> DataFrame:
    """All columns and, from the stored bytes, ``frames`` (timed, with histograms), ``samples`` and ``error``."""
    new = ("frames", "samples", "error")
    keep = [c for c in media_rows.columns if c not in (*new, media)]
    d = media_rows.select(*keep, media)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields), f"frames {FRAME_TYPE}", "samples binary", "error string"])
    counts = pa.list_(pa.int32())
    kind = pa.struct([("start_ms", pa.int32()), ("delay_ms", pa.int32()), ("histogram", counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                times, hist, ends, samples, errors = [], [np.zeros((0, BINS), np.int32)], [0], [], []
                for x, (frames, error) in zip(b.column(b.num_columns - 1), _read_each([x.as_py() for x in b.column(b.num_columns - 1)])):
                    times += [(f.start_ms, f.delay_ms) for f in frames]
                    hist.append(histograms(frames))
                    ends.append(len(times))
                    samples.append(b"".join([f.samples for f in frames]) if x.is_valid and not error else None)
                    errors.append(error)
                flat, t = np.concatenate(hist), np.array(times, np.int32).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * BINS), pa.array(flat.ravel()))
                every = pa.StructArray.from_arrays([pa.array(t[:, 0]), pa.array(t[:, 1]), lists], fields=list(kind))
                none = pa.array([s is None for s in samples])
                frames = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), every, mask=none)
                yield pa.RecordBatch.from_arrays([*b.columns, frames, pa.array(samples, pa.binary()), pa.array(errors, pa.string())], [*keep, media, *new])

    return d.mapInArrow(run, ddl)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query's digest columns from ``doc_id, n_bytes, media, frames, samples``."""
    for b in batches:
        ids, n, media, frames, samples = (b.column(i) for i in range(5))
        payload = [x.as_py() for x in samples]
        stored = [x.as_py() for x in media]
        counts = np.asarray(frames.flatten().field("histogram").flatten()).reshape(-1, BINS)
        ends = np.cumsum([0, *(len(p) // FRAME for p in payload)])
        sums = np.add.reduceat(counts, ends[:-1], axis=0, dtype=np.int64) if len(payload) else counts
        feature = [",".join(map(str, row)) for row in sums.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                ids, n, pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()), pa.array([len(m) for m in stored], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array(feature, pa.string()),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def op2_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("samples"))
    d = frame_columns(to_gif(docs, "samples")).select("doc_id", "n_bytes", "media", "frames", "samples")
    return d.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


QUERIES = {"op2_gif_columns": op2_gif_columns}
SQL: dict[str, str] = {}
