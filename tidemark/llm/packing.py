"""Bounded-space online packing of token sequences.

A document's tokens are cut into whole sequences and one rest. Each partition keeps a fixed number
of open windows: the rest goes to the fullest window that still takes it (best fit); if none does,
the fullest is emitted and a new one opened. The windows still open at a partition's end are
merged in a second pass over windows, not tokens.

Defined results: a null or empty text is one closing token; a null id stays null; repeated rows are
packed one by one; an empty table yields no rows; other columns are never read. Every token of
every document lies in exactly one piece.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, cut, kept, release, released

SIZE, WINDOWS, CLOSING_ID = 2048, 64, 1
#: Open windows that one task of the merging pass takes.
MERGED_BY_TASK = 4096
#: Characters tokenised at a time, and words remembered by a worker.
CHUNK_CHARS, CACHE_WORDS = 2_000_000, 700_000

# Letters and other numbers below U+0250; texts with other characters take the tokenizer's own way.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
OTHER_NUMBERS = "²³¹¼-¾"
PLAIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9{OTHER_NUMBERS}]|[^\\s{LETTERS}0-9{OTHER_NUMBERS}]+")
UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-ɏ]|<\\|")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Index(dict):
    """Numbers words in the order they are first looked up."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordTokens:
    """Token ids of texts, remembered by word: the tokenizer never joins tokens over words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            spec = json.load(f)
        self.by_words = spec["normalizer"] is not None and spec["model"].get("end_of_word_suffix") == "</w>"
        del spec
        release()
        self.forget()

    def forget(self) -> None:
        self.at = Index()
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Tokenise the words that were looked up for the first time."""
        found = [e.ids for e in self.whole.encode_batch_fast(self.at.new, add_special_tokens=False)]
        self.at.new = []
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.ids)
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > CACHE_WORDS:
            self.forget()
        out: list = [None] * len(texts)
        plain, words, get = [], [], self.at.__getitem__
        for k, text in enumerate(texts):
            low = text.lower()
            if not self.by_words or UNUSUAL.search(low) or UNUSUAL.search(text):
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                plain.append(k)
                found = PLAIN_WORD.findall(low)
                words.append(np.fromiter(map(get, found), np.int64, len(found)))
        if self.at.new:
            self.learn()
        for k, i in zip(plain, words):
            n = self.lengths[i]
            total = int(n.sum())
            out[k] = self.ids[np.repeat(self.starts[i] - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        return out


def word_tokens(path: str) -> WordTokens:
    return kept(f"packing {path}", None, lambda: WordTokens(path))


class Packer:
    """Best fit over a fixed number of open windows; ids count up from ``base``."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.windows, self.next = size, windows, base
        self.open: list[tuple[int, int]] = []  # (free space, window), sorted

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset, window that was emitted to make room)."""
        k, emitted = bisect_left(self.open, (length, -1)), None
        if k < len(self.open):
            free, window = self.open.pop(k)
        else:
            if len(self.open) == self.windows:
                emitted = self.open.pop(0)[1]
            free, window = self.size, self.new()
        if free > length:
            insort(self.open, (free - length, window))
        else:
            emitted = window if emitted is None else emitted
        return window, self.size - free, emitted


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, window_id bigint, offset bigint, ids array<int>"


def packing_task(size: int, windows: int, path: str, with_ids: bool):
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window_id", "offset")), ("ids", pa.list_(pa.int32()))])

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
        ids, texts, n = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            texts.append(t.as_py() or "")
            n += len(texts[-1])
            if n > CHUNK_CHARS:
                yield ids, texts
                ids, texts, n = [], [], 0
        if ids:
            yield ids, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = word_tokens(path), Packer(size, windows, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_ids, texts in chunks(batch):
                rows = []
                for doc_id, ids in zip(doc_ids, tokens.encode(texts)):
                    ids = np.append(ids, np.uint32(CLOSING_ID)).astype("<u4")
                    n = len(ids)
                    for start in range(0, n, size):
                        part = ids[start : start + size]
                        window, offset, _ = (packer.new(), 0, None) if len(part) == size else packer.place(len(part))
                        rows.append((doc_id, start, len(part), zlib.crc32(part.tobytes()), n, window, offset, part.astype("i4") if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


def merging_task(size: int, windows: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(size, windows, (1 << 62) + (TaskContext.get().partitionId() << 33))
        for frame in frames:
            put = [packer.place(int(n))[:2] for n in frame["fill"]]
            yield pd.DataFrame({"window_id": frame["window_id"], "sequence_id": [x[0] for x in put], "base": [x[1] for x in put]})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, windows: int = WINDOWS, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    path = tokenizer or default_tokenizer()
    source = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    pieces = cut(source.mapInArrow(lambda batches: released(packing_task(size, windows, path, with_ids)(batches)), PIECES), "pieces")
    fills = pieces.groupBy("window_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < size)
    fills = cut(fills, "fills")  # only windows that are not full can be merged
    parts = max(1, -(-fills.count() // MERGED_BY_TASK))
    # dealt at random, largest first in each task
    spread = fills.repartition(parts, F.xxhash64("window_id")).sortWithinPartitions(F.desc("fill"), "window_id")
    merged = cut(spread.mapInPandas(merging_task(size, windows), "window_id bigint, sequence_id bigint, base bigint"), "merged")
    out = pieces.join(merged, "window_id", "left")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("sequence_id", "window_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    return out.select(*columns, *["ids"] * with_ids)
