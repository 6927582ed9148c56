"""AVI motion-JPEG: RIFF index, intra frames, shots by adaptive histogram differences.

Texts are stored as 24 x 24 frames of 8-bit samples, each frame a lossless JPEG (ITU-T T.81,
process 14: Huffman-coded differences to the left neighbour), in an AVI file with an idx1 index.
All frames of a chunk are decoded side by side, one sample of each per step.

Defined results: a null text is empty and makes one frame of padding; equal texts make equal files;
a null id stays null; repeated rows are treated one by one; an empty table yields no rows; other
columns are never read.
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

from tidemark.llm._scratch import col, released

SIDE, FPS = 24, 25
SAMPLES = SIDE * SIDE
#: Payload bytes of texts that are taken together, and frames coded side by side.
CHUNK_BYTES, FRAMES = 4_000_000, 1_700
#: Huffman code lengths of the difference categories 0-8, chosen for text.
CODE_LENGTHS = (4, 4, 3, 3, 2, 3, 5, 3, 6)
#: FLOOR lies above the differences that chance makes between frames of one source.
BINS, AROUND, SPREADS, FLOOR = 16, 8, 3.0, 0.15


def huffman(counts: bytes | list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a DHT segment."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


_SYMBOLS = sorted(range(9), key=lambda s: (CODE_LENGTHS[s], s))
_COUNTS = [CODE_LENGTHS.count(n) for n in range(1, 17)]
CODES = huffman(_COUNTS, _SYMBOLS)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


HEAD = b"\xff\xd8" + segment(0xC4, bytes([0, *_COUNTS, *_SYMBOLS])) + segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
TAIL = b"\xff\xd9"


def difference_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference, from -255 up."""
    bits, lengths = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = CODES[s]
        bits[d + 255], lengths[d + 255] = code << s | (d if d >= 0 else d + (1 << s) - 1), n + s
    return bits, lengths


_BITS, _LENGTHS = difference_tables()


def lookup(codes: dict[int, tuple[int, int]]) -> np.ndarray | None:
    """For the next 16 bits: difference << 8 | bits taken. None if a code and its bits don't fit in 16."""
    table = np.full(65536, 16, np.int32)
    for s, (code, n) in codes.items():
        if s > 16 or n + s > 16:
            return None
        for extra in range(1 << s):
            d = extra if s and extra >> (s - 1) else extra - (1 << s) + 1
            at = (code << s | extra) << (16 - n - s)
            table[at : at + (1 << (16 - n - s))] = d * 256 + n + s
    return table


def encode_frames(frames: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entropy-coded bytes of (n, SIDE, SIDE) samples, and where each frame's begin and the last's end."""
    x = frames.astype(np.int16)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d = d.reshape(len(x), -1) + 255
    bits, n = _BITS[d], _LENGTHS[d]
    ends = np.cumsum(n, axis=1)
    size = (ends[:, -1] + 7) >> 3
    first = np.cumsum(size) - size
    at = (first[:, None] * 8 + ends - n).ravel()
    word = bits.ravel() << (24 - n.ravel() - (at & 7))
    at >>= 3
    total = int(size.sum())
    out = sum(np.bincount(at + k, weights=(word >> (16 - 8 * k)) & 255, minlength=total + 2) for k in range(3)).astype(np.uint8)[:total]
    out[first + size - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = out == 255
    shift = np.cumsum(full) - full
    stuffed = np.zeros(total + int(full.sum()), np.uint8)
    stuffed[np.arange(total) + shift] = out
    bounds = np.append(first + shift[first], len(stuffed))
    return stuffed.tobytes(), bounds


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(pictures: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of one MJPG stream with an idx1 index."""
    largest = max(map(len, pictures), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(pictures), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(pictures), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IIIHHIIIIII", 40, width, height, 1, 8, 0x47504A4D, width * height, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index, at = [b"movi"], [], 4
    for p in pictures:
        n = len(p)
        body += (b"00dc" + struct.pack("<I", n), p, b"\0" * (n & 1))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, n))
        at += 8 + n + (n & 1)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames per second, and (begin, end) of each video frame by the index; without one, by the chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, stream = float(FPS), None, None, 0
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = (at + 8, min(end, at + 8 + n))
            elif name == b"LIST":
                todo.append((at + 12, min(end, at + 8 + n)))
            elif name == b"strh" and data[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 28)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = (at + 8, n // 16)
            at += 8 + n + (n & 1)
    if movi is None:
        return fps, []
    frames = []
    if index:
        entries = np.frombuffer(data, "S4,<u4,<u4,<u4", index[1], index[0])
        entries = entries[[x.endswith((b"dc", b"db")) for x in entries["f0"].tolist()]]
        offsets, sizes = entries["f2"].astype(np.int64), entries["f3"].astype(np.int64)
        base = movi[0] if len(offsets) and offsets[0] < movi[0] else 0  # offsets count from movi or from the file's start
        begins = offsets + base + 8
        return fps, list(zip(begins.tolist(), (begins + sizes).tolist()))
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        n = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append((at + 8, min(movi[1], at + 8 + n)))
        at += 8 + n + (n & 1)
    return fps, frames


def parse_jpeg(data: bytes) -> dict:
    """The segments of a JPEG picture: tables, frame header, scan header and the scan's bytes."""
    out: dict = {"huffman": {}, "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 255:
            at += 1
            continue
        n = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xC4:
            while body:
                counts = body[1:17]
                k = sum(counts)
                out["huffman"][body[0]] = huffman(counts, list(body[17 : 17 + k]))
                body = body[17 + k :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1, 0xC3):
            out["sof"] = marker
            out["precision"], out["height"], out["width"], k = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out["predictor"] = body[1 + 2 * body[0]]
            end = data.rfind(TAIL)
            out["data"] = data[at : end if end >= at else len(data)]
            return out
    raise ValueError("no scan")


def decode_scans(scans: list[bytes], samples: int, table: np.ndarray) -> np.ndarray:
    """(scans, samples) differences, all scans side by side."""
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0\0", np.uint8)
    sizes = np.fromiter(map(len, scans), np.int64, len(scans))
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 255)
    keep[-4:] = True
    dropped = np.cumsum(~keep)
    first = np.cumsum(sizes) - sizes
    pos = (first - np.where(first > 0, dropped[first - 1], 0)) * 8
    raw = raw[keep].astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    out = np.empty((samples, len(scans)), np.int16)
    for k in range(samples):
        word = words.take(pos >> 3, mode="clip") << (pos & 7).astype(np.uint32)
        found = table[word >> 16]
        out[k] = found >> 8
        pos += found & 255
    return out.T


def undo_left(d: np.ndarray, height: int, width: int) -> np.ndarray:
    """Samples from differences to the left neighbour, in the first column to the one above."""
    d = d.reshape(-1, height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_ANGLES = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, 8**-0.5, 0.5)


def decode_baseline(p: dict) -> np.ndarray:
    """Luma of a baseline JPEG picture, symbol by symbol; the inverse transform is one product."""
    data, at, have, bits = p["data"], 0, 0, 0

    def take(n: int) -> int:
        nonlocal at, have, bits
        while have < n:
            b = data[at] if at < len(data) else 0
            at += 1
            if b == 255 and at < len(data) and data[at] == 0:
                at += 1
            bits, have = bits << 8 | b, have + 8
        have -= n
        value = bits >> have
        bits &= (1 << have) - 1
        return value

    tables = {k: {(n, c): s for s, (c, n) in t.items()} for k, t in p["huffman"].items()}

    def symbol(table: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad code")

    def extended(s: int) -> int:
        v = take(s) if s else 0
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    parts = {c: (h, v, q) for c, h, v, q in p["parts"]}
    most_h, most_v = max(x[0] for x in parts.values()), max(x[1] for x in parts.values())
    if len(parts) == 1:
        most_h = most_v = 1
        parts = {c: (1, 1, q) for c, (_, _, q) in parts.items()}
    across, down = -(-p["width"] // (8 * most_h)), -(-p["height"] // (8 * most_v))
    luma, (lh, lv, lq) = p["scan"][0][0], parts[p["scan"][0][0]]
    blocks = np.zeros((down * lv, across * lh, 64))
    last = dict.fromkeys(parts, 0)
    for m in range(across * down):
        if p["restart"] and m and m % p["restart"] == 0:
            have = bits = 0
            at = data.index(b"\xff", at) + 2 if not (data[at - 2] == 255 and 0xD0 <= data[at - 1] <= 0xD7) else at
            last = dict.fromkeys(parts, 0)
        for c, dc, ac in p["scan"]:
            h, v, _ = parts[c]
            for k in range(h * v):
                block = [0] * 64
                last[c] += extended(symbol(tables[dc]))
                block[0] = last[c]
                i = 1
                while i < 64:
                    rs = symbol(tables[16 + ac])
                    if rs == 0:
                        break
                    i += rs >> 4
                    if rs & 15 and i < 64:
                        block[ZIGZAG[i]] = extended(rs & 15)
                    i += 1
                if c == luma:
                    blocks[m // across * lv + k // h, m % across * lh + k % h] = block
    scale = np.zeros(64)
    scale[ZIGZAG] = p["quant"][lq]
    coefficients = (blocks * scale).reshape(*blocks.shape[:2], 8, 8)
    pixels = np.clip(np.rint(np.einsum("yu,rcuv,xv->rycx", _ANGLES, coefficients, _ANGLES)) + 128, 0, 255)
    return pixels.reshape(blocks.shape[0] * 8, -1)[: p["height"], : p["width"]].astype(np.uint8)


_TABLE = lookup(CODES)


def decode_frames(pictures: list[bytes]) -> list[np.ndarray]:
    """Grey pictures. Lossless ones of this module's own kind are decoded side by side, others one by one."""
    out: list = [None] * len(pictures)
    own = [k for k, p in enumerate(pictures) if p.startswith(HEAD)]
    if own:
        found = undo_left(decode_scans([pictures[k][len(HEAD) : -2] for k in own], SAMPLES, _TABLE), SIDE, SIDE)
        for k, x in zip(own, found):
            out[k] = x
    for k, data in enumerate(pictures):
        if out[k] is None:
            p = parse_jpeg(data)
            if p.get("sof") == 0xC3:
                table = lookup(p["huffman"][p["scan"][0][1]])
                if table is None or len(p["parts"]) > 1 or p["predictor"] != 1 or p["precision"] != 8:
                    raise ValueError("lossless pictures need one 8-bit component and the left predictor")
                out[k] = undo_left(decode_scans([p["data"]], p["height"] * p["width"], table), p["height"], p["width"])[0]
            else:
                out[k] = decode_baseline(p)
    return out


def histograms(frames: np.ndarray) -> np.ndarray:
    """(n, BINS) shares of the samples of (n, samples)."""
    n = len(frames)
    at = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS) / frames.shape[1]


def shots(shares: np.ndarray) -> np.ndarray:
    """First frames of the shots: where the difference to the frame before is above the mean of its
    surroundings by several spreads, and is the largest among its neighbours."""
    n = len(shares)
    if n < 2:
        return np.zeros(1 if n else 0, np.int64)
    d = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = np.append(0, np.cumsum(d)), np.append(0, np.cumsum(d * d))
    k = np.arange(n - 1)
    a, b = np.maximum(k - AROUND, 0), np.minimum(k + AROUND + 1, n - 1)
    m = np.maximum(b - a - 1, 1)
    mean = (sums[b] - sums[a] - d) / m
    spread = np.sqrt(np.maximum((squares[b] - squares[a] - d * d) / m - mean * mean, 0))
    padded = np.pad(d, 1, constant_values=-1.0)
    cut = (d > np.maximum(mean + SPREADS * spread, FLOOR)) & (d >= padded[:-2]) & (d > padded[2:])
    return np.append(0, np.flatnonzero(cut) + 1)


def encode_texts(payloads: list[bytes]) -> list[bytes]:
    """One AVI file per payload; the payload is filled up with bytes 255 to whole frames. A bounded
    number of frames is coded at a time, so memory is a few times that of the payloads."""
    counts = [max(1, -(-len(p) // SAMPLES)) for p in payloads]
    filled = b"".join(x for p, n in zip(payloads, counts) for x in (p, b"\xff" * (n * SAMPLES - len(p))))
    frames, pictures = np.frombuffer(filled, np.uint8).reshape(-1, SIDE, SIDE), []
    for k in range(0, len(frames), FRAMES):
        data, bounds = encode_frames(frames[k : k + FRAMES])
        bounds = bounds.tolist()
        pictures += [HEAD + data[a:b] + TAIL for a, b in zip(bounds, bounds[1:])]
    out, k = [], 0
    for n in counts:
        out.append(write_avi(pictures[k : k + n]))
        k += n
    return out


def read_back(files: list[bytes]) -> Iterator[tuple[float, list[np.ndarray]]]:
    """(frames per second, frames as lists of (n, samples) arrays) of each file. A bounded number of
    frames is decoded at a time, those of short files together."""
    parsed = [parse_avi(x) for x in files]
    todo = [(k, x[a:b]) for k, (x, (_, where)) in enumerate(zip(files, parsed)) if len(where) <= FRAMES for a, b in where]
    found: dict[int, list[np.ndarray]] = {}
    for k in range(0, len(todo), FRAMES):
        part = todo[k : k + FRAMES]
        for (of, _), x in zip(part, decode_frames([p for _, p in part])):
            found.setdefault(of, []).append(x)
    del todo
    for k, (fps, where) in enumerate(parsed):
        if len(where) <= FRAMES:
            yield fps, [rows_of_frames(found.pop(k))] if k in found else []
        else:
            yield fps, [rows_of_frames(decode_frames([files[k][a:b] for a, b in where[i : i + FRAMES]])) for i in range(0, len(where), FRAMES)]


def rows_of_frames(frames: list[np.ndarray]) -> np.ndarray:
    """(n, samples); frames of different sizes are an error."""
    return np.stack(frames).reshape(len(frames), -1)


def shares_of(frames: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros((0, BINS)), *map(histograms, frames)])


def readable(files: list[bytes]) -> list[tuple[float, list[np.ndarray]]]:
    """The same; what is damaged has no frames."""
    try:
        return list(read_back(files))
    except (ValueError, IndexError, KeyError, struct.error):
        return [(float(FPS), [])] if len(files) == 1 else [x for f in files for x in readable([f])]


def in_chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and values as bytes (null: empty), a bounded number of bytes at a time."""
    ids, values, n = [], [], 0
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
        value = v.as_py() or b""
        ids.append(i)
        values.append(value if isinstance(value, bytes) else value.encode())
        n += len(values[-1])
        if n > CHUNK_BYTES:
            yield ids, values
            ids, values, n = [], [], 0
    if ids:
        yield ids, values


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, avi): the stored form of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("avi", pa.binary())])

    def run(batches):
        for batch in batches:
            for ids, payloads in in_chunks(batch):
                yield rows_of(list(zip(ids, encode_texts(payloads))), schema)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, avi binary")


def clips(media: DataFrame, id_col: str = "doc_id", avi_col: str = "avi") -> DataFrame:
    """Timed clip rows of an AVI column: one per shot. A null, empty or damaged file has none."""
    kinds = [("doc_id", pa.int64()), ("clip", pa.int32()), ("first_frame", pa.int64()), ("last_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            for ids, files in in_chunks(batch):
                known = [(i, x) for i, x in zip(ids, files) if x]
                rows = []
                for (i, _), (fps, frames) in zip(known, readable([x for _, x in known])):
                    begins = shots(shares_of(frames)).tolist()
                    for k, (a, b) in enumerate(zip(begins, [*begins[1:], sum(map(len, frames))])):
                        rows.append((i, k, a, b - 1, a / fps, b / fps))
                if rows:
                    yield rows_of(rows, schema)

    return media.select(col(id_col).cast("long").alias("doc_id"), col(avi_col).alias("avi")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, clip int, first_frame bigint, last_frame bigint, start_s double, end_s double")


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both: sizes, digests and shots."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips")
    kinds = dict.fromkeys(names, pa.int64()) | dict.fromkeys(("payload_sha256", "media_sha256", "feature"), pa.string())
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            for ids, payloads in in_chunks(batch):
                files = encode_texts(payloads)
                sizes, rows = list(map(len, payloads)), []
                payloads.clear()  # what follows comes from the stored bytes
                for i, size, file, (fps, frames) in zip(ids, sizes, files, read_back(files)):
                    got, begins = hashlib.sha256(), shots(shares_of(frames))
                    for part in frames:
                        got.update(part)
                    n = sum(map(len, frames))
                    feature = f"frames={n};fps={fps:g};shots={','.join(map(str, begins.tolist()))}"
                    rows.append((i, size, n * SAMPLES, got.hexdigest(), zlib.crc32(frames[-1][-1, -32:].tobytes()), len(file), hashlib.sha256(file).hexdigest(), feature, len(begins)))
                yield rows_of(rows, schema)

    spec = ", ".join(f"{n} {'string' if pa.types.is_string(t) else 'bigint'}" for n, t in kinds.items())
    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(lambda batches: released(run(batches)), spec)
