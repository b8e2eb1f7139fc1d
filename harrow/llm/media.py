"""Media columns: AVI motion-JPEG.

Reading: the RIFF chunks and the index of an AVI file give its frames; each is an intra (baseline) JPEG that is
decoded to quantised coefficients and to luma samples; shots are cut where the luma histogram changes much
more than it did in the frames before; each shot is a row with its times.

Writing: a payload is stored losslessly in the format's own unit, the quantised coefficient. A frame has 576
bytes as nine 8x8 blocks. Byte x is the coefficient 256 + x, which is of size category 9 whatever x is, and every
block is a restart interval, so DC values are not differences. The stream is valid baseline JPEG.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 576
SIDE = 24
PAD = 255
FPS = 25
#: A cut needs a change above so many times the mean change since the last cut, and above the least share.
ADAPTIVE, LEAST_CHANGE = 3.0, 0.25
BINS = 16

# The order in which JPEG stores the 64 coefficients of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_BLOCK_BYTES = 80  # 64 coefficients of 1 + 9 bits
_WHOLE = 1 << 12


def _inverse_cosines() -> np.ndarray:
    """Integer matrix from the coefficients (row order) to the 64 samples of a block, times _WHOLE.

    Products are exact in float64, so samples do not depend on how blocks are batched.
    """
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    return np.rint(np.einsum("yv,xu->yxvu", one, one).reshape(64, 64) * _WHOLE)


_SAMPLES = _inverse_cosines()


def luma(coefficients: np.ndarray) -> np.ndarray:
    """8-bit samples (n, 64) of dequantised blocks (n, 64) in row order."""
    return np.clip(128 + np.floor((coefficients @ _SAMPLES.T + _WHOLE / 2) / _WHOLE), 0, 255).astype(np.uint8)


# ---- writing ----------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    only = lambda kind, symbol: bytes([kind, 1, *[0] * 15, symbol])  # noqa: E731  one code, the bit 0
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, bytes([0, *[1] * 64])),
            _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0)),
            _segment(0xC4, only(0x00, 9)),
            _segment(0xC4, only(0x10, 9)),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        )
    )


_HEAD, _END = _jpeg_head(), b"\xff\xd9"


def jpeg_frames(payload: np.ndarray) -> list[bytes]:
    """One JPEG for each FRAME_BYTES of the payload."""
    blocks = payload.reshape(-1, 64).astype(np.uint64)
    # 4 coefficients are 4 * (code 0, then 9 bits 1xxxxxxxx) = 40 bits = 5 bytes
    four = blocks.reshape(-1, 4) + np.uint64(256)
    packed = (four << np.array([30, 20, 10, 0], np.uint64)).sum(1, dtype=np.uint64)
    data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(blocks), _BLOCK_BYTES)
    marker = np.empty((len(blocks), 2), np.uint8)
    marker[:, 0] = 0xFF
    marker[:, 1] = 0xD0 + np.arange(len(blocks)) % 9 % 8
    rows = np.concatenate([data, marker], axis=1).reshape(-1, 9 * (_BLOCK_BYTES + 2))[:, :-2]
    stuffed = (rows == 0xFF) & (np.arange(rows.shape[1]) % (_BLOCK_BYTES + 2) < _BLOCK_BYTES)
    lengths = rows.shape[1] + stuffed.sum(1)
    flat = np.insert(rows.ravel(), np.flatnonzero(stuffed.ravel()) + 1, 0).tobytes()
    ends = np.cumsum(lengths).tolist()
    return [_HEAD + flat[a:b] + _END for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file with one motion-JPEG stream and its index."""
    largest = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack(
        "<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height
    )
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    index, at, movie = [], 4, []
    for frame in frames:
        movie.append(_chunk(b"00dc", frame))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        at += len(movie[-1])
    head = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", *movie) + _chunk(b"idx1", b"".join(index)))


def store_payload(data: bytes) -> bytes:
    """The bytes, padded with PAD to a positive multiple of FRAME_BYTES, as an AVI file."""
    size = max(-(-len(data) // FRAME_BYTES), 1) * FRAME_BYTES
    return avi(jpeg_frames(np.frombuffer(data.ljust(size, bytes([PAD])), np.uint8)))


# ---- reading ----------------------------------------------------------------------------------------


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the chunks in data[at:end]; a chunk that is cut off ends the walk."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            return
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


@dataclass
class Movie:
    frames: list[memoryview]
    frame_seconds: float


def read_avi(blob: bytes) -> Movie | None:
    """Frames of the first video stream, by the index or, without one, in stored order; None if it is no AVI file."""
    data = memoryview(blob)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return None
    seconds, movie, index = 1.0 / FPS, None, None
    for name, at, end in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
        kind = bytes(data[at : at + 4])
        if name == b"LIST" and kind == b"hdrl":
            for inner, a, _ in _chunks(data, at + 4, end):
                if inner == b"avih":
                    seconds = int.from_bytes(data[a : a + 4], "little") / 1e6 or seconds
        elif name == b"LIST" and kind == b"movi":
            movie = (at, end)
        elif name == b"idx1":
            index = np.frombuffer(data[at : at + (end - at) // 16 * 16], "<u4").reshape(-1, 4)
    if movie is None:
        return Movie([], seconds)
    if index is None:
        frames = [data[a:b] for name, a, b in _chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]
        return Movie(frames, seconds)
    names = index[:, 0] >> 16
    video = index[(names == int.from_bytes(b"dc", "little")) | (names == int.from_bytes(b"db", "little"))]
    # offsets count from the list's kind, or from the file's start in some files
    base = movie[0] if len(video) and int(video[0, 2]) < movie[0] else 0
    starts, sizes = (base + video[:, 2] + 8).tolist(), video[:, 3].tolist()
    return Movie([data[a : a + n] for a, n in zip(starts, sizes, strict=True) if a + n <= len(data)], seconds)


class _Bits:
    """Bits of an entropy-coded interval, most significant first; reads past the end give ones."""

    def __init__(self, data: bytes):
        self.value = int.from_bytes(data + b"\xff" * 8, "big")
        self.left = 8 * len(data) + 64

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the interval has too few bits")
        return (self.value >> self.left) & ((1 << n) - 1)


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a JPEG Huffman table."""
    table, code, at = {}, 0, 0
    for length, n in enumerate(lengths, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _symbol(bits: _Bits, table: dict[tuple[int, int], int]) -> int:
    code = 0
    for length in range(1, 17):
        code = code << 1 | bits.take(1)
        if (length, code) in table:
            return table[length, code]
    raise ValueError("no such code")


def _signed(bits: _Bits, size: int) -> int:
    if not size:
        return 0
    value = bits.take(size)
    return value if value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: dict, ac: dict, before: int) -> list[int]:
    out = [0] * 64
    out[0] = before + _signed(bits, _symbol(bits, dc))
    k = 1
    while k < 64:
        run, size = divmod(_symbol(bits, ac), 16)
        if not size and run < 15:
            break
        k += run
        if size:
            if k > 63:
                raise ValueError("a block has more than 64 coefficients")
            out[k] = _signed(bits, size)
        k += 1
    return out


@dataclass
class _Picture:
    width: int = 0
    height: int = 0
    components: tuple = ()  # (id, horizontal, vertical, quantisation table)
    restart: int = 0
    scan: tuple = ()  # (component, DC table, AC table)
    data: bytes = b""


def _segments(frame: bytes) -> tuple[_Picture, dict, dict]:
    picture, quants, tables = _Picture(), {}, {}
    at = 2
    while at + 4 <= len(frame):
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC0 or marker == 0xC1:
            picture.height, picture.width = struct.unpack(">HH", body[1:5])
            picture.components = tuple((c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[i : i + 3] for i in range(6, len(body), 3)))
        elif 0xC2 <= marker <= 0xCF and marker != 0xC4 and marker != 0xCC:
            raise ValueError("only baseline JPEG is read")
        elif marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, 64 * (1 + (body[0] >> 4))
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            picture.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            picture.scan = tuple((body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0]))
            picture.data = frame[at + 2 + size : -2 if frame[-2:] == _END else None]
            break
        at += 2 + size
    if not picture.components or not picture.scan:
        raise ValueError("no picture in this frame")
    return picture, quants, tables


def _intervals(data: bytes) -> list[bytes]:
    """The restart intervals, without stuffed zeros."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist()
    bounds = [0, *(x for m in marks for x in (m, m + 2)), len(data)]
    return [data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(bounds[::2], bounds[1::2], strict=True)]


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (blocks, 64) in stored order and luma samples (blocks, 64) of the first component."""
    picture, quants, tables = _segments(bytes(frame))
    by_id = {c[0]: c for c in picture.components}
    most_h, most_v = max(c[1] for c in picture.components), max(c[2] for c in picture.components)
    if len(picture.scan) == 1:
        across, down, shape = -(-picture.width // 8), -(-picture.height // 8), {picture.scan[0][0]: 1}
    else:
        across, down = -(-picture.width // (8 * most_h)), -(-picture.height // (8 * most_v))
        shape = {c[0]: c[1] * c[2] for c in picture.components}
    intervals, per = _intervals(picture.data), picture.restart or across * down
    codes = {key: _codes(*table) for key, table in tables.items()}
    first, found = picture.scan[0][0], []
    for number, interval in enumerate(intervals):
        bits, before = _Bits(interval), dict.fromkeys(shape, 0)
        for _ in range(min(per, across * down - number * per)):
            for component, dc, ac in picture.scan:
                for _ in range(shape[component]):
                    block = _block(bits, codes[dc], codes[16 + ac], before[component])
                    before[component] = block[0]
                    if component == first:
                        found.append(block)
    coefficients = np.array(found, np.int64).reshape(-1, 64)
    return coefficients, _to_luma(coefficients, quants[by_id[first][3]])


def _to_luma(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    rows = np.empty(coefficients.shape, np.float64)
    rows[:, ZIGZAG] = coefficients * quant
    return luma(rows)


def decode_frames(frames: list[memoryview]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``decode_frame`` of each; frames with our own header are unpacked together, since all their codes are as long."""
    size, own = len(_HEAD), [f[: len(_HEAD)] == _HEAD for f in frames]
    if not frames or not all(own):
        return [decode_frame(f) for f in frames]
    data = b"".join(b"".join(_intervals(bytes(f[size:-2]))) for f in frames)
    packed = np.zeros((len(data) // 5, 8), np.uint8)
    packed[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    four = packed.view(">u8").astype(np.uint64) >> np.array([30, 20, 10, 0], np.uint64) & np.uint64(1023)
    if not (four >> np.uint64(8) == 1).all():
        raise ValueError("a code is not the one that the table has")
    blocks = four.astype(np.int64).reshape(-1, 64)
    samples = _to_luma(blocks, np.ones(64, np.int64))
    return [(blocks[i : i + 9], samples[i : i + 9]) for i in range(0, len(blocks), 9)]


def stored_payload(blob: bytes) -> tuple[bytes, list[np.ndarray]]:
    """The payload that ``store_payload`` stored, read from the file's index and frames, and the frames' samples."""
    movie = read_avi(blob)
    if movie is None:
        raise ValueError("no AVI file")
    decoded = decode_frames(movie.frames)
    payload = b"".join((c - 256).astype(np.uint8).tobytes() for c, _ in decoded)
    return payload, [s for _, s in decoded]


# ---- shots ------------------------------------------------------------------------------------------


def shots(samples: list[np.ndarray], adaptive: float = ADAPTIVE, least: float = LEAST_CHANGE) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot.

    A frame's change is the share of samples whose histogram bin differs from the frame before (half the sum of
    differences). It starts a shot if it is above ``least`` and above ``adaptive`` times the mean change since the
    last cut.
    """
    if not samples:
        return []
    bins = [np.bincount(s.ravel() >> 4, minlength=BINS) / s.size for s in samples]
    cuts, total, seen = [0], 0.0, 0
    for i in range(1, len(bins)):
        change = float(np.abs(bins[i] - bins[i - 1]).sum()) / 2
        if change > least and change > adaptive * (total / seen if seen else 0.0):
            cuts.append(i)
            total, seen = 0.0, 0
        else:
            total, seen = total + change, seen + 1
    return list(zip(cuts, [*cuts[1:], len(samples)], strict=True))


def feature(samples: list[np.ndarray]) -> str:
    """Frames, shots, mean luma of each of the first and last shots and the longest shot, as text."""
    found = shots(samples)
    means = [sum(int(samples[i].sum()) for i in range(a, b)) // (sum(samples[i].size for i in range(a, b)) or 1) for a, b in found]
    longest = max((b - a for a, b in found), default=0)
    ends = f"{means[0]},{means[-1]}" if means else ""
    return f"frames={len(samples)};shots={len(found)};longest={longest};luma={ends}"


def clips(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per shot of each AVI file: id, ``clip``, ``first_frame``, ``n_frames``, ``start_s``, ``end_s``, ``mean_luma``.

    Null, empty and damaged files have no rows. Repeated rows give their clips each. A row is read by itself:
    there is no shuffle, and memory holds one file and its decoded frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            source = []
            for row, blob in enumerate(batch.column(1)):
                try:
                    movie = read_avi(blob.as_py() or b"")
                    samples = [s for _, s in decode_frames(movie.frames)] if movie else []
                except (ValueError, KeyError, IndexError, struct.error):
                    continue
                for clip, (a, b) in enumerate(shots(samples)):
                    mean = float(np.mean([samples[i].mean() for i in range(a, b)]))
                    rows.append((clip, a, b - a, a * movie.frame_seconds, b * movie.frame_seconds, mean))
                    source.append(row)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "clip", "first_frame", "n_frames", "start_s", "end_s", "mean_luma"],
            )

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, clip int, first_frame long, n_frames long, start_s double, end_s double, mean_luma double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``media``: each text's UTF-8 bytes as an AVI file. A null text is empty; rows stay rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):  # files are larger than texts
                batch = whole.slice(first, 64)
                files = [store_payload((x.as_py() or "").encode()) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["id", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as ``payload_media`` does, reads the stored bytes back and describes both.

    id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256``,
    ``feature``. Equal texts have equal values. Null and empty texts are one frame of padding.
    Null ids and repeated rows stay rows of their own; other columns are ignored, whatever their names; an empty table
    gives an empty result. A very long text is one row, whose file and frames a task holds at once: tens of bytes for
    each byte of it.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def describe(data: bytes, media: bytes) -> tuple:
        payload, samples = stored_payload(media)
        digest = hashlib.sha256(payload).hexdigest()
        return len(data), len(payload), digest, zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode()
                rows.append(describe(data, store_payload(data)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
