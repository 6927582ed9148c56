"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (spaces become the space mark, with
one put in front), the pieces (a trie over UTF-8 bytes whose final states emit a piece and go back to
the start, at the negative score of the piece) and byte fallback (each byte emits its byte piece; the
first byte of a character bears a penalty above any single piece). An input is composed with them
lazily, state by state, and the shortest path in the tropical semiring gives the ids. Where a tie
remains, the longer last piece wins.

No piece goes on past a space mark that follows other characters, so a path falls apart at those
places: units between them are composed side by side, all at the same position per step, and
remembered by the worker. A long unit (text without spaces) falls apart further wherever no arc of
its machine spans a place, which leaves the shortest path what it is.

Defined results: a null text counts as empty; an empty text has no ids; a null id stays null;
repeated rows are treated one by one; an empty table yields no rows; other columns are never read.
Decoding gives the normalised text back; a space mark in the input decodes as a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, kept, released

MARK = "▁"
UNIT = re.compile(" *[^ ]+| +")
#: Longer units (characters) are cut where no arc spans; what is then still over WIDEST bytes is
#: composed by itself, in memory proportional to its length.
LONGEST, WIDEST = 40, 160
#: Units that a worker remembers, their bytes, and the bytes that are composed side by side.
CHUNK_CHARS, CACHE_UNITS, CACHE_BYTES, CELLS = 2_000_000, 500_000, 16_000_000, 1_000_000
#: Scores below this mark pieces that are not to be used where there is another way.
BANNED = 1e8


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The compiled machines. State 0 of the trie is dead, state 1 the start."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only the identity normaliser with a leading space mark is compiled")
        self.text = [p.piece.encode() for p in model.pieces]
        self.byte_id = np.full(256, model.trainer_spec.unk_id, np.int32)
        words: dict[bytes, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.text[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (2, 3):
                self.text[i] = b""
            elif p.type in (1, 4):
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError("a piece goes on past a space mark")
                words[p.piece.replace(MARK, " ").encode()] = i
        self.size = len(model.pieces)
        self.cost = np.array([-p.score for p in model.pieces])
        usual = [self.cost[i] for i in words.values() if self.cost[i] < BANNED]
        penalty = 10 + max(usual, default=0.0)
        bytes_ = np.arange(256)
        self.byte_cost = np.where((bytes_ >= 0x80) & (bytes_ < 0xC0), 0.0, penalty)
        self.compile(words)

    def compile(self, words: dict[bytes, int]) -> None:
        inner = {b""} | {w[:k] for w in words for k in range(1, len(w))}
        state = {w: k for k, w in enumerate(sorted(inner, key=len), 1)}
        self.inner = len(state) + 1
        for w in words:
            state.setdefault(w, len(state) + 1)
        self.next = np.zeros((self.inner, 256), np.int32)  # leaves need no row
        self.final = np.full(len(state) + 1, -1, np.int32)
        for w, s in state.items():
            if w:
                self.next[state[w[:-1]], w[-1]] = s
        for w, i in words.items():
            self.final[state[w]] = i
        self.depth = max(map(len, words), default=0)


def segments(m: Pieces, unit: bytes) -> list[bytes]:
    """A unit cut wherever no arc of its machine spans the place: all its paths pass through there."""
    n, codes = len(unit), np.frombuffer(unit, np.uint8)
    reach, rows, state, q = np.arange(1, n + 1), np.arange(n), np.ones(n, np.int32), 0
    while len(rows) and q < m.depth:
        inside = rows + q < n
        rows, state = rows[inside], state[inside]
        state = m.next[state, codes[rows + q]]
        q += 1
        found = m.final[state] >= 0
        reach[rows[found]] = rows[found] + q
        more = (state > 0) & (state < m.inner)
        rows, state = rows[more], state[more]
    ends = (np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, n + 1)) + 1).tolist()
    return [unit[a:b] for a, b in zip([0, *ends], ends)]


def units_of(m: Pieces, text: str) -> list:
    """The units of a text with a space in front: strings, and bytes where a long one was cut."""
    units = UNIT.findall(" " + text)
    if units and max(map(len, units)) > LONGEST:
        return [s for u in units for s in (segments(m, u.encode()) if len(u) > LONGEST else (u,))]
    return units


def as_bytes(units: list) -> list[bytes]:
    return [u if isinstance(u, bytes) else u.encode() for u in units]


def blocks(units: list[bytes], cells: int) -> Iterator[list[int]]:
    """Places of units of similar lengths, a bounded number of bytes at a time; long ones are left out."""
    order = sorted((k for k, u in enumerate(units) if len(u) <= WIDEST), key=lambda k: len(units[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * (len(units[order[b]]) + 1) <= cells:
            b += 1
        yield order[a:b]
        a = b


def side_by_side(units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (longest first), lengths and padded bytes in that order."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    codes = np.zeros((len(units), int(lengths[0])), np.uint8)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(units[k] for k in order), np.uint8)
    return order, lengths, codes


def arcs(m: Pieces, codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The composed machine by position: (from, to, rows, pieces); at most one arc of a row in each."""
    for p in range(codes.shape[1]):
        rows = np.arange(np.searchsorted(-lengths, -p, "left"))
        yield p, p + 1, rows, m.byte_id[codes[: len(rows), p]]
        state, q = np.ones(len(rows), np.int32), p
        while len(rows) and q < p + m.depth:
            k = np.searchsorted(-lengths[rows], -q, "left")
            if not k:
                break
            rows, state = rows[:k], state[:k]
            state = m.next[state, codes[rows, q]]
            q += 1
            live = state > 0
            rows, state = rows[live], state[live]
            piece = m.final[state]
            found = piece >= 0
            if found.any():
                yield p, q, rows[found], piece[found]
            more = state < m.inner
            rows, state = rows[more], state[more]


def shortest(m: Pieces, units: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids and cost of each unit."""
    order, lengths, codes = side_by_side(units)
    n, width = codes.shape
    best = np.full((n, width + 1), np.inf)
    best[:, 0] = 0
    back, label = np.zeros((n, width + 1), np.int64), np.zeros((n, width + 1), np.int32)
    for p, q, rows, piece in arcs(m, codes, lengths):
        byte = m.cost[piece]
        if q == p + 1:  # byte arcs come first at each position
            is_byte = piece == m.byte_id[codes[rows, p]]
            byte = np.where(is_byte, m.byte_cost[codes[rows, p]], byte)
        cost = best[rows, p] + byte
        better = cost < best[rows, q]
        rows = rows[better]
        best[rows, q], back[rows, q], label[rows, q] = cost[better], p, piece[better]
    at, steps = lengths.copy(), []
    while (at > 0).any():
        live = at > 0
        rows = np.flatnonzero(live)
        steps.append((rows, label[rows, at[rows]]))
        at[rows] = back[rows, at[rows]]
    rows = np.concatenate([r for r, _ in steps[::-1]])
    ids = np.concatenate([x for _, x in steps[::-1]])
    by_row = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=n)
    parts = np.split(ids[by_row], np.cumsum(counts)[:-1])
    out: list = [None] * n
    for k, x in zip(order.tolist(), parts):
        out[k] = x
    costs = np.empty(n)
    costs[order] = best[np.arange(n), lengths]
    return out, costs


def shortest_long(m: Pieces, unit: bytes) -> tuple[np.ndarray, float]:
    """The same for one long unit."""
    n = len(unit)
    best, back, label = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int32)
    best[0] = 0
    for p in range(n):
        b, state, q, here = unit[p], 1, p, best[p]
        if here + m.byte_cost[b] < best[p + 1]:
            best[p + 1], back[p + 1], label[p + 1] = here + m.byte_cost[b], p, m.byte_id[b]
        while q < n and 0 < state < m.inner:
            state = m.next[state, unit[q]]
            q += 1
            i = m.final[state] if state else -1
            if i >= 0 and here + m.cost[i] < best[q]:
                best[q], back[q], label[q] = here + m.cost[i], p, i
    ids, at = [], n
    while at:
        ids.append(label[at])
        at = back[at]
    return np.array(ids[::-1], np.int32), float(best[n])


class Encoder:
    """Ids of texts, remembered by unit."""

    def __init__(self, m: Pieces):
        self.m = m
        self.forget()

    def forget(self) -> None:
        self.at: dict[str | bytes, int] = {}
        self.held = 0
        self.ids, self.starts, self.lengths, self.costs = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def learn(self, units: list) -> None:
        raw = as_bytes(units)
        self.held += sum(map(len, raw))
        found: list = [None] * len(raw)
        for block in blocks(raw, CELLS):
            for k, *x in zip(block, *shortest(self.m, [raw[k] for k in block])):
                found[k] = x
        for k, u in enumerate(raw):
            if found[k] is None:
                found[k] = shortest_long(self.m, u)
        lengths = np.fromiter((len(x[0]) for x in found), np.int64, len(found))
        self.at.update(zip(units, range(len(self.starts), len(self.starts) + len(units))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, *(x[0] for x in found)])
        self.costs = np.concatenate([self.costs, [x[1] for x in found]])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, float]]:
        if len(self.at) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.forget()
        units = [units_of(self.m, t.replace(MARK, " ")) if t else [] for t in texts]
        missing = set().union(*units).difference(self.at)
        if missing:
            self.learn(list(missing))
        out, get = [], self.at.__getitem__
        for x in units:
            i = np.fromiter(map(get, x), np.int64, len(x))
            n = self.lengths[i]
            at = np.repeat(self.starts[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out.append((self.ids[at], float(self.costs[i].sum())))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.m.text.__getitem__, ids.tolist())).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encoder(path: str) -> Encoder:
    return kept(f"wfst {path}", None, lambda: Encoder(Pieces(path)))


def text_chunks(batch: pa.RecordBatch, limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(first column, texts) of a batch, a bounded number of characters at a time."""
    ids, texts, n = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n > limit:
            yield ids, texts
            ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids, cost)."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            for ids, texts in text_chunks(batch):
                found = encoder(path).encode(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.float64())], names=["doc_id", "ids", "cost"])

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, ids array<int>, cost double")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(doc_id, text); null ids count as none."""
    path = model or default_model()

    def run(batches):
        for batch in batches:
            texts = [encoder(path).decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(col(id_col).cast("long").alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, text string")


def transducer_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode each text, decode the ids, and describe both."""
    path = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("n_byte_ids", pa.int64()), ("ids_crc32", pa.int64()), ("cost", pa.float64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        e = encoder(path)
        is_byte = np.zeros(e.m.size, bool)
        is_byte[e.m.byte_id] = True
        for batch in batches:
            for doc_ids, texts in text_chunks(batch):
                rows = []
                for i, t, (ids, cost) in zip(doc_ids, texts, e.encode(texts)):
                    back = e.decode(ids)
                    rows.append((i, len(ids), int(is_byte[ids].sum()), zlib.crc32(ids.astype("<u4").tobytes()), cost, zlib.crc32(back.encode()), back == t.replace(MARK, " ")))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, cost double, decoded_crc32 bigint, round_trip boolean")
