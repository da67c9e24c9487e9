"""AVI with motion-JPEG: writing bytes as flat 8x8 blocks, reading through the RIFF index, and shots as timed clips."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import encode, slices

#: Blocks of a stored frame: across, down. A block holds one payload byte. Frames a second.
ACROSS, DOWN, FPS = 64, 4, 25
PAYLOAD_UNIT = 64
#: Shots: a cut is where a difference of histograms (BINS bins) passes a floor and mean + FACTOR * deviation of the last MEMORY differences.
BINS, FLOOR, FACTOR, MEMORY = 32, 0.12, 2.0, 24

# A stored frame is baseline JPEG, one component, every quantiser 8. A flat block of value v has the DC
# coefficient v - 128 and no others, so it decodes to v exactly. The DC codes of categories 8 to 0 have 4
# to 12 bits, so that code and magnitude are 12 bits always, and the end-of-block code has 4: each block
# is two bytes, neither of them 0xFF. Any JPEG reader can read it; this one reads such frames all at once.
_DC_LENGTHS = [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
_DC_SYMBOLS = bytes(range(8, -1, -1))
_AC_LENGTHS = [0, 0, 0, 1] + [0] * 12


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_header(across: int = ACROSS, down: int = DOWN) -> bytes:
    """All before a frame's entropy-coded bytes."""
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\x01\x11\x00"),
            _segment(0xC4, b"\x00" + bytes(_DC_LENGTHS) + _DC_SYMBOLS),
            _segment(0xC4, b"\x10" + bytes(_AC_LENGTHS) + b"\x00"),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        )
    )


def _codes(lengths: list[int] | bytes) -> list[tuple[int, int]]:
    """(code, length) of each symbol in order, as the JPEG standard assigns them."""
    out, code = [], 0
    for length, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _block_words() -> np.ndarray:
    """For each DC difference from -255 to 255, the 16 bits of its block."""
    code_of = {s: c for s, c in zip(_DC_SYMBOLS, _codes(_DC_LENGTHS), strict=True)}
    end = _codes(_AC_LENGTHS)[0][0]
    words = []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        magnitude = diff if diff >= 0 else diff + (1 << size) - 1
        words.append((code_of[size][0] << size | magnitude) << 4 | end)
    return np.array(words, ">u2")


_WORDS = _block_words()
_DIFF_OF = np.full(1 << 16, 1 << 14, np.int32)
_DIFF_OF[_WORDS.astype(np.int64)] = np.arange(-255, 256)
_HEADER = jpeg_header()
_FRAME = len(_HEADER) + 2 * ACROSS * DOWN + 2


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """An AVI of motion-JPEG frames whose blocks are the payload's bytes; the last frame is filled up with zeros.

    The payload's length stands in a chunk of the header list, and every frame in the index.
    """
    per = ACROSS * DOWN
    n = -(-len(payload) // per)
    samples = np.zeros((n, per), np.int32)
    samples.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    diffs = np.diff(samples, axis=1, prepend=128)
    frame = 8 + _FRAME + (_FRAME & 1)
    movie = np.zeros((n, frame), np.uint8)
    movie[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", _FRAME), np.uint8)
    movie[:, 8 : 8 + len(_HEADER)] = np.frombuffer(_HEADER, np.uint8)
    movie[:, 8 + len(_HEADER) : 8 + _FRAME - 2] = _WORDS[diffs + 255].view(np.uint8).reshape(n, -1)
    movie[:, 8 + _FRAME - 2 : 8 + _FRAME] = (0xFF, 0xD9)
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, 4 + frame * np.arange(n), _FRAME
    width, height = 8 * ACROSS, 8 * DOWN
    main = struct.pack("<14I", 1_000_000 // fps, frame * fps, 0, 0x10, n, 0, 1, _FRAME, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, _FRAME, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", picture))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams + _chunk(b"plen", struct.pack("<Q", len(payload))))
    body = b"AVI " + header + _chunk(b"LIST", b"movi" + movie.tobytes()) + _chunk(b"idx1", index.tobytes())
    return _chunk(b"RIFF", body)


@dataclass
class Movie:
    """What a RIFF file says of itself: the frames' places, and the payload's length where the file has one."""

    data: bytes
    at: np.ndarray
    size: np.ndarray
    seconds_per_frame: float
    payload: int | None


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        if start + 8 + size > end:
            raise ValueError(f"RIFF chunk at {start} ends after its list")
        yield data[start : start + 4], start + 8, size
        start += 8 + size + (size & 1)


def _is_frame(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _super_index(data: bytes, at: int) -> list[tuple[int, int]]:
    """(place, size) of the frames of an OpenDML index of indexes, over all RIFF segments of a file."""
    width, _, kind, entries = struct.unpack_from("<HBBI", data, at)
    if kind != 0 or width != 4:
        raise ValueError("an index of an unknown kind")
    out = []
    for i in range(entries):
        place, _, _ = struct.unpack_from("<QII", data, at + 24 + 16 * i)
        n, base = struct.unpack_from("<I", data, place + 12)[0], struct.unpack_from("<Q", data, place + 20)[0]
        for offset, size in np.frombuffer(data, "<u4", 2 * n, place + 32).reshape(-1, 2).tolist():
            out.append((base + offset, size & 0x7FFFFFFF))
    return out


def _movie_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    for name, at, size in _chunks(data, start, end):
        if name == b"LIST" and data[at : at + 4] == b"rec ":
            yield from _movie_chunks(data, at + 4, at + size)
        elif _is_frame(name):
            yield at, size


def parse_avi(data: bytes) -> Movie:
    """Reads the RIFF lists and the index: an OpenDML one, else idx1 of the first segment; segments without are walked chunk by chunk.

    Other files raise ValueError.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    index, whole, micros, payload, lists = None, None, 1_000_000 // FPS, None, []
    for riff, first, length in _chunks(data, 0, len(data)):
        if riff != b"RIFF":
            break
        for name, at, size in _chunks(data, first + 4, first + length):
            kind = data[at : at + 4] if name == b"LIST" else name
            if kind == b"hdrl":
                for n, a, z in _chunks(data, at + 4, at + size):
                    if n == b"avih":
                        micros = int.from_bytes(data[a : a + 4], "little")
                    elif n == b"plen":
                        payload = int.from_bytes(data[a : a + 8], "little")
                    elif n == b"LIST" and data[a : a + 4] == b"strl" and whole is None:
                        whole = next((_super_index(data, b) for m, b, _ in _chunks(data, a + 4, a + z) if m == b"indx"), None)
            elif kind == b"movi":
                lists.append((at, size))
            elif kind == b"idx1" and index is None:
                index = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], size // 16, at)
    if not lists:
        raise ValueError("an AVI file without a movi list")
    found = list(whole) if whole is not None else []
    if whole is None:
        if index is not None:
            index = index[np.char.endswith(index["id"], b"dc") | np.char.endswith(index["id"], b"db")]
            base = lists[0][0] if len(index) and index["at"][0] < lists[0][0] else 0
            found = list(zip((index["at"].astype(np.int64) + base + 8).tolist(), index["size"].tolist(), strict=True))
        for at, size in lists[index is not None :]:
            found += _movie_chunks(data, at + 4, at + size)
    at, size = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)
    if len(at) and (at + size > len(data)).any():
        raise ValueError("the index points behind the file's end")
    return Movie(data, at, size, micros / 1e6, payload)


def decode_frames(movie: Movie) -> np.ndarray:
    """The mean sample (0 to 255) of each 8x8 block of each frame, component after component: frames x blocks; intra frames only, as motion-JPEG has.

    Frames as write_avi writes them are decoded together. Others are decoded one by one (baseline); an empty chunk, by which
    writers repeat a frame, is the frame before it.
    """
    if not len(movie.at):
        return np.empty((0, 0), np.uint8)
    if (movie.size == _FRAME).all():
        steps = np.diff(movie.at)
        if not len(steps) or (steps == steps[0]).all():
            stride = int(steps[0]) if len(steps) else _FRAME
            frames = np.lib.stride_tricks.as_strided(np.frombuffer(movie.data, np.uint8)[int(movie.at[0]) :], (len(movie.at), _FRAME), (stride, 1), writeable=False)
            if (frames[:, : len(_HEADER)] == np.frombuffer(_HEADER, np.uint8)).all():
                words = np.ascontiguousarray(frames[:, len(_HEADER) : _FRAME - 2]).view(">u2")
                diffs = _DIFF_OF[words]
                if (diffs < 1 << 14).all():
                    return (np.cumsum(diffs, axis=1) + 128).astype(np.uint8)
    out: list[np.ndarray] = []
    for a, s in zip(movie.at.tolist(), movie.size.tolist(), strict=True):
        out.append(decode_jpeg(movie.data[a : a + s]) if s or not out else out[-1])
    if len({x.size for x in out}) > 1:
        raise ValueError("frames of several sizes")
    return np.stack(out)


#: The code lengths of the usual tables, which motion-JPEG frames may leave out, and the symbols with which the usual AC tables begin.
_USUAL_LENGTHS = {
    0x00: [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0],
    0x01: [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0],
    0x10: [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    0x11: [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
}
_USUAL_FIRST = {
    0x10: bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    0x11: bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
}


def _lookup(lengths: list[int] | bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """(symbol, code length) for each 16 bits that can stand next; -1 where no code begins them."""
    symbol, size = np.full(1 << 16, -1, np.int32), np.zeros(1 << 16, np.int32)
    for (code, length), s in zip(_codes(lengths), symbols, strict=True):
        start = code << 16 - length
        symbol[start : start + (1 << 16 - length)], size[start : start + (1 << 16 - length)] = s, length
    return symbol.tolist(), size.tolist()


def usual_tables() -> dict[int, tuple[list[int], list[int]]]:
    """The tables by class and number; an AC table goes on with all other runs 0 to 15 and sizes 1 to 10 in ascending order."""
    if not _TABLES:
        every = [16 * run + size for run in range(16) for size in range(1, 11)]
        for key, lengths in _USUAL_LENGTHS.items():
            first = _USUAL_FIRST.get(key)
            _TABLES[key] = _lookup(lengths, bytes(range(12)) if first is None else first + bytes(x for x in every if x not in first))
    return _TABLES


_TABLES: dict[int, tuple[list[int], list[int]]] = {}


class _Bits:
    """The entropy-coded bits of a frame, restart by restart."""

    def __init__(self, data: bytes, start: int):
        end = start
        while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
            end += 2
        self.parts = iter(re.split(rb"\xff[\xd0-\xd7]", data[start : len(data) if end < 0 else end]))
        self.restart()

    def restart(self) -> None:
        raw = np.frombuffer(next(self.parts, b"").replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
        self.windows, self.at = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist(), 0
        self.end = 8 * (len(raw) - 8) + 16

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.at > self.end:
            raise ValueError("a frame that is cut short")
        code = self.windows[self.at >> 3] >> 16 - (self.at & 7) & 0xFFFF
        if table[0][code] < 0:
            raise ValueError("a code that no table has")
        self.at += table[1][code]
        return table[0][code]

    def take(self, n: int) -> int:
        value = self.windows[self.at >> 3] >> 32 - (self.at & 7) - n & (1 << n) - 1
        self.at += n
        return value


def decode_jpeg(data: bytes) -> np.ndarray:
    """The block means of a baseline JPEG, each component's in raster order, from its DC coefficients; AC symbols are read and passed over.

    Components may be sampled at different rates, and Huffman tables left out for the usual ones.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, parts, restart, scan = 2, {}, dict(usual_tables()), [], 0, None
    while scan is None:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a segment that is cut short")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                lengths, n = body[1:17], sum(body[1:17])
                tables[body[0]] = _lookup(lengths, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            height, width, n = struct.unpack(">HHB", body[1:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline JPEG")
    if not parts or set(scan) != {p[0] for p in parts}:
        raise ValueError("a scan that doesn't have all components")
    single = len(parts) == 1
    across, down = (1, 1) if single else (max(p[1] for p in parts), max(p[2] for p in parts))
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    means, plan = [], []
    for name, h, v, q in parts:
        h, v = (1, 1) if single else (h, v)
        means.append(np.zeros((rows * v, columns * h)))
        plan.append((means[-1], h, v, tables[scan[name][0]], tables[scan[name][1]], quant[q]))
    bits, dc = _Bits(data, at), [0] * len(parts)
    for unit in range(rows * columns):
        if restart and unit and unit % restart == 0:
            bits.restart()
            dc = [0] * len(parts)
        y, x = divmod(unit, columns)
        for i, (out, h, v, dc_table, ac_table, step) in enumerate(plan):
            for block in range(h * v):
                size = bits.symbol(dc_table)
                value = bits.take(size) if size else 0
                dc[i] += value if not size or value >> (size - 1) else value - (1 << size) + 1
                out[y * v + block // h, x * h + block % h] = dc[i] * step
                k = 1
                while k < 64:
                    s = bits.symbol(ac_table)
                    if s & 15:
                        bits.at += s & 15
                        k += (s >> 4) + 1
                    elif s == 0xF0:
                        k += 16
                    else:
                        break
    inside = []
    for (_, h, v, _), own in zip(parts, means, strict=True):
        tall, wide = (-(-height * v // (8 * down)), -(-width * h // (8 * across))) if not single else (rows, columns)
        inside.append(own[:tall, :wide].ravel())
    return np.clip(np.floor(np.concatenate(inside) / 8 + 128.5), 0, 255).astype(np.uint8)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of each shot: a new one starts where the histogram changes more than it lately did."""
    n = len(frames)
    if n == 0:
        return []
    bins = frames.astype(np.int64) * BINS // 256
    histogram = np.bincount((bins + BINS * np.arange(n)[:, None]).ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / (2 * frames.shape[1])
    total, square = (np.concatenate(([0.0], np.cumsum(x))) for x in (change, change * change))
    end = np.arange(len(change))
    start = np.maximum(0, end - MEMORY)
    seen = np.maximum(1, end - start)
    mean = (total[end] - total[start]) / seen
    spread = np.sqrt(np.maximum(0.0, (square[end] - square[start]) / seen - mean * mean))
    cuts = (np.flatnonzero((change > FLOOR) & (change > mean + FACTOR * spread)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def clips_of(movie: Movie, frames: np.ndarray) -> list[tuple[int, int, int, float, float]]:
    """(clip, first_frame, end_frame, start_sec, end_sec) of each shot, at the file's own rate."""
    s = movie.seconds_per_frame
    return [(i, a, b, a * s, b * s) for i, (a, b) in enumerate(shots(frames))]


def clips(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """(media_id, clip, first_frame, end_frame, start_sec, end_sec, error): a row for each shot of each AVI (binary).

    A file that can't be read gives one row with the error; a null one and one without frames give none. Repeated rows
    give their rows each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if x.is_valid:
                    try:
                        movie = parse_avi(x.as_py())
                        rows += [(key, *c, None) for c in clips_of(movie, decode_frames(movie))]
                    except (ValueError, IndexError, KeyError, struct.error) as e:
                        rows.append((key, None, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["media_id", "clip", "first_frame", "end_frame", "start_sec", "end_sec", "error"])

    chosen = media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).alias("data"))
    return chosen.mapInArrow(run, "media_id long, clip int, first_frame long, end_frame long, start_sec double, end_sec double, error string")


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes filled with zeros up to a positive multiple of 64; null is empty."""
    data = encode(text)
    return len(data), data + b"\0" * (-len(data) % PAYLOAD_UNIT if data else PAYLOAD_UNIT)


def read_payload(media: bytes) -> tuple[bytes, Movie, np.ndarray]:
    """The payload of a file of write_avi, the movie and its frames."""
    movie = parse_avi(media)
    frames = decode_frames(movie)
    return frames.tobytes()[: movie.payload], movie, frames


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text of docs (doc_id, text) stored as an AVI and read back; feature: frames, shots, and each clip's frames and seconds.

    Null texts are empty, and stored like any other; equal texts have equal values; repeated rows stay rows of their own; other
    columns are left out; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for x in batch.column(1):
                n, stored = padded(x.as_py())
                media = write_avi(stored)
                payload, movie, frames = read_payload(media)
                cut = clips_of(movie, frames)
                feature = f"frames={len(frames)};shots={len(cut)};" + ",".join(f"{a}-{b}@{start:.2f}-{end:.2f}" for _, a, b, start, end in cut)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_media_avi(spark, sf_dir: str) -> DataFrame:
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
