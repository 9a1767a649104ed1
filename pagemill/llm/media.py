"""Media columns: AVI files of motion JPEG, written, read by their index, decoded and cut into shots.

A payload becomes grey frames of 16 x 12 samples, each an intra-coded lossless JPEG (sequential, predictor 1).
The Huffman table gives a difference of category s a code of 12 - s bits, so that every sample takes 12 bits
and whole documents are coded and decoded with array operations; frames with any other table or size are decoded symbol
by symbol. Rows are independent: no shuffle, and memory is bounded by one text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, FPS = 16, 12, 25
SAMPLES = WIDTH * HEIGHT
BINS, WINDOW, SPREAD, LEAST_CUT = 16, 12, 3.0, 0.3


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """The 12-bit word of each difference -255..255 (at index difference + 255), and the difference of each word."""
    words, back = np.zeros(511, np.uint16), np.full(4096, 32767, np.int16)
    code, bits = 0, 4
    for category in range(8, -1, -1):
        for d in range(-(2**category) + 1, 2**category):
            if d == 0 and category == 0 or abs(d) >= 2 ** (category - 1) and category:
                if abs(d) > 255:
                    continue
                word = (code << category) | (d if d > 0 else d + 2**category - 1)
                words[d + 255], back[word] = word, d
        code, bits = (code + 1) << 1, bits + 1
    return words, back


WORD_OF, DIFFERENCE_OF = _difference_codes()
_TABLE = b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([0] * 3 + [1] * 9 + [0] * 4) + bytes(range(8, -1, -1))
_FRAME = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
_SCAN = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
JPEG_HEAD = b"\xff\xd8" + _TABLE + _FRAME + _SCAN
JPEG_END = b"\xff\xd9"


def _scans(payload: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of all frames, and how many each frame has."""
    x = payload.reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    left = np.empty_like(x)
    left[:, :, 1:] = x[:, :, :-1]
    left[:, 1:, 0] = x[:, :-1, 0]
    left[:, 0, 0] = 128
    w = WORD_OF[x - left + 255].reshape(-1, 2)
    packed = np.empty((len(w), 3), np.uint8)
    packed[:, 0] = w[:, 0] >> 4
    packed[:, 1] = (w[:, 0] << 4 & 0xF0) | w[:, 1] >> 8
    packed[:, 2] = w[:, 1] & 0xFF
    packed = packed.reshape(len(x), -1)
    full = packed == 0xFF
    sizes = packed.shape[1] + full.sum(axis=1)
    flat = packed.ravel()
    if not full.any():
        return flat, sizes
    stuffed = np.zeros(int(sizes.sum()), np.uint8)
    before = np.cumsum(full.ravel())
    stuffed[np.arange(flat.size) + before - full.ravel()] = flat
    return stuffed, sizes


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload, whose length is a positive multiple of 192."""
    data, sizes = _scans(np.frombuffer(payload, np.uint8))
    n = len(sizes)
    jpeg = len(JPEG_HEAD) + sizes + len(JPEG_END)
    chunk = 8 + jpeg + (jpeg & 1)
    at = np.cumsum(chunk) - chunk
    movi = np.zeros(int(chunk.sum()), np.uint8)
    head = np.zeros((n, 8 + len(JPEG_HEAD)), np.uint8)
    head[:, :4] = np.frombuffer(b"00dc", np.uint8)
    head[:, 4:8] = jpeg.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 8:] = np.frombuffer(JPEG_HEAD, np.uint8)
    movi[at[:, None] + np.arange(head.shape[1])] = head
    body = at + head.shape[1]
    movi[np.repeat(body - (np.cumsum(sizes) - sizes), sizes) + np.arange(data.size)] = data
    movi[(body + sizes)[:, None] + np.arange(2)] = np.frombuffer(JPEG_END, np.uint8)
    index = np.zeros(n, dtype=[("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["offset"], index["size"] = b"00dc", 0x10, at + 4, jpeg
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 10_000, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", SAMPLES, 0, 0, 0, 0)
    part = lambda name, body: name + struct.pack("<I", len(body)) + body
    strl = part(b"LIST", b"strl" + part(b"strh", strh) + part(b"strf", strf))
    hdrl = part(b"LIST", b"hdrl" + part(b"avih", avih) + strl)
    rest = hdrl + part(b"LIST", b"movi" + movi.tobytes()) + part(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", 4 + len(rest)) + b"AVI " + rest


def frame_spans(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each video frame, in order, from the RIFF index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(media, dtype=[("id", "S4"), ("flags", "<u4"), ("offset", "<u4"), ("size", "<u4")], count=size // 16, offset=at + 8)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no movi list or no index")
    index = index[np.isin(index["id"], [b"00dc", b"00db"])]
    start = index["offset"].astype(np.int64)
    start += 8 + (movi if not len(start) or media[movi + int(start[0]) : movi + int(start[0]) + 4] in (b"00dc", b"00db") else 0)
    return start, index["size"].astype(np.int64)


def _rebuilt(d: np.ndarray) -> np.ndarray:
    """Samples of (frames, rows, columns) of differences under predictor 1."""
    d = d.astype(np.int32)
    d[:, :, 0] = 128 + np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Samples (rows, columns) of one grey lossless JPEG with predictor 1 and any Huffman table."""
    at, table, shape = 2, {}, None
    while jpeg[at + 1] != 0xDA:
        kind, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if kind == 0xC4:
            code, k = 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    table[bits, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif kind == 0xC3:
            shape = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a lossless sequential JPEG")
        at += 2 + size
    size = int.from_bytes(jpeg[at + 2 : at + 4], "big")
    if shape is None or jpeg[at + 4] != 1 or jpeg[at + 2 + size - 3] != 1:
        raise ValueError("one component and predictor 1 are read")
    data = jpeg[at + 2 + size : jpeg.rindex(JPEG_END)].replace(b"\xff\x00", b"\xff")
    bits, n_bits, p, out = int.from_bytes(data, "big"), 8 * len(data), 0, []
    take = lambda a, n: bits >> (n_bits - a - n) & ((1 << n) - 1)
    for _ in range(shape[0] * shape[1]):
        n = 1
        while (n, take(p, n)) not in table:
            n += 1
            if n > 16:
                raise ValueError("bad code")
        s = table[n, take(p, n)]
        extra = take(p + n, s) if s else 0
        out.append(extra if not s or extra >> (s - 1) else extra - (1 << s) + 1)
        p += n + s
    return _rebuilt(np.array(out).reshape(1, *shape))[0]


def read_frames(media: bytes) -> np.ndarray:
    """All frames (n, rows, columns) of an AVI of grey lossless JPEGs."""
    start, size = frame_spans(media)
    b = np.frombuffer(media, np.uint8)
    if not len(start):
        return np.zeros((0, HEIGHT, WIDTH), np.uint8)
    k = len(JPEG_HEAD)
    if (b[start[:, None] + np.arange(k)] == np.frombuffer(JPEG_HEAD, np.uint8)).all():
        n = size - k - len(JPEG_END)
        data = b[np.repeat(start + k - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        stuffing = np.r_[False, (data[1:] == 0) & (data[:-1] == 0xFF)]
        v = data[~stuffing].astype(np.uint16).reshape(-1, 3)
        w = np.empty((len(v), 2), np.uint16)
        w[:, 0] = v[:, 0] << 4 | v[:, 1] >> 4
        w[:, 1] = (v[:, 1] & 15) << 8 | v[:, 2]
        return _rebuilt(DIFFERENCE_OF[w].reshape(-1, HEIGHT, WIDTH))
    return np.stack([decode_frame(media[s : s + n]) for s, n in zip(start.tolist(), size.tolist())])


def shot_starts(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and the histograms. A cut is where the histogram difference to the frame
    before is over the mean of the last differences by SPREAD deviations, and LEAST_CUT at least."""
    n = len(frames)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, BINS), np.int64)
    bins = (frames.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    hist = np.bincount(bins.ravel(), minlength=BINS * n).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * max(1, frames[0].size))
    if not len(d):
        return np.zeros(min(n, 1), np.int64), hist
    s1, s2 = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    i = np.arange(len(d))
    lo = np.maximum(0, i - WINDOW)
    m = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / m
    sd = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / m - mean**2))
    return np.r_[0, 1 + np.flatnonzero((d > mean + SPREAD * sd + 1e-9) & (d >= LEAST_CUT))], hist


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled with blanks up to a positive multiple of 192."""
    return text + b" " * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): an AVI for each row; null text is empty; repeated rows are stored each."""

    def store(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts = [(x or "").encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_avi(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, first_frame, n_frames, start_ms, end_ms, mean_level): the shots of each stored file.
    A null file has no rows."""

    def clips(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if m is None:
                    continue
                frames = read_frames(m)
                starts, _ = shot_starts(frames)
                for k, (a, z) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(frames)])):
                    rows.append((doc, k, a, z - a, a * 1000 // FPS, z * 1000 // FPS, float(frames[a:z].mean())))
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "clip", "first_frame", "n_frames", "start_ms", "end_ms", "mean_level"])

    return media.select("doc_id", "media").mapInArrow(clips, "doc_id long, clip int, first_frame long, n_frames long, start_ms long, end_ms long, mean_level double")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text, reads it back from the stored bytes, and returns digests and the shots found: a row for each row,
    repeated ones too. Null and empty texts are one frame of blanks; texts of any length are stored whole; an empty table
    gives no rows; columns other than doc_id and text play no part.
    ``feature``: frames, shots, crc32 of the shots' first frames, and the mean histogram in sixteenths of 4096."""

    def digest(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = (t or "").encode()
                media = write_avi(payload_of(text))
                frames = read_frames(media)
                back = frames.tobytes()
                starts, hist = shot_starts(frames)
                share = hist.sum(axis=0) * 4096 // len(back)
                feature = f"frames={len(frames)};shots={len(starts)};cuts={zlib.crc32(starts.astype('<u4').tobytes()):08x};levels={'.'.join(map(str, share.tolist()))}"
                rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, types)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, DIGEST)
