"""Language-model scoring by a probabilistic suffix tree.

Text is lower-cased (A-Z) and split at ASCII white space; the UTF-8 bytes of its words, with a space
after each and an end symbol after the last, are the symbols. A context of up to DEPTH symbols is
retained if it was seen LEAST_COUNT times and the distribution after it diverges from the one after
its suffix by more than a description-length test asks for; so are the suffixes of what is retained,
and every context of up to SHARED symbols. Distributions are smoothed towards the suffix's
(Witten-Bell), and each symbol is scored in the longest retained state that matches.

The tree is a distributed table. A symbol with the DEPTH symbols before it, a gram, has one
probability. Batches of documents send their distinct grams, in one array per bucket of a hash, to be
summed up; the sums go on to the family of their last SHARED + 1 context symbols, where contexts are
tested and the probabilities computed; these return to the batches by the same way. Words (for the
unigram) go to their buckets and back likewise. Buckets are as many as shuffle partitions; a
gram or word is at most once in a batch, and a family has at most 256 ** (DEPTH - SHARED) distinct
grams however large the corpus is. What tasks share are the counts after contexts of up to SHARED
symbols: at most 256 ** (SHARED + 1) numbers.

Defined results: a null text counts as empty; an empty text is the end symbol alone; a null id is
not held out; repeated rows are scored one by one; without training rows symbols are equally
likely; an empty table yields no rows; other columns are never read. A text of any length is worked
on in parts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, cut, kept, release, released
from tidemark.llm.langid import held_out
from tidemark.llm.wfst import text_chunks

DEPTH, SHARED, LEAST_COUNT = 5, 2, 2
#: Characters of a batch of documents, which gets the counts of its own words and grams.
BATCH_CHARS = 24_000_000
#: Grams that a task holds before it sums them up, positions scored at a time, and bytes split at a time.
WAITING, STRETCH, PART = 3_000_000, 1_000_000, 4_000_000
#: The end symbol is byte 10, which no word contains. It also stands before a text.
SYMBOLS = 256
SPACE = re.compile(rb"[\x09-\x0d ]")
LOW = (1 << 8 * (SHARED + 1)) - 1


def parts_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time. Bytes lower-cases A-Z only, and
    splits at ASCII white space only."""
    raw, a = text.encode().lower(), 0
    while a < len(raw):
        cut_at = SPACE.search(raw, a + PART) if len(raw) - a > PART else None
        b = cut_at.start() if cut_at else len(raw)
        yield (raw[a:b] if b - a < len(raw) else raw).split()
        a = b


def grams(raw: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol from place ``depth`` on with its context, the latest symbol lowest."""
    n = len(raw) - depth
    out = raw[depth:].astype(np.int64)
    for j in range(1, depth + 1):
        out |= raw[depth - j : depth - j + n].astype(np.int64) << (8 * j)
    return out


def mixed(x: np.ndarray, buckets: int) -> np.ndarray:
    return (((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Counter:
    """Counts of integers, summed up from time to time."""

    def __init__(self):
        self.keys, self.times, self.new, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.new.append(keys)
        self.waiting += len(keys)
        if self.waiting > WAITING:
            self.sum()

    def sum(self) -> None:
        if self.new:
            keys, times = np.unique(np.concatenate(self.new), return_counts=True)
            self.keys, self.times = summed(np.concatenate([self.keys, keys]), np.concatenate([self.times, times]))
            self.new, self.waiting = [], 0


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(times[order], starts)


def lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of lists, and the lists' sizes."""
    whole = column.combine_chunks()
    return whole.flatten(), whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


#: ``planes``, in the first row alone: the word numbers of all rows, byte by byte of significance.
DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("size", pa.int64()), ("planes", pa.binary())])
COUNTED = pa.schema([("kind", pa.string()), ("batch", pa.int64()), ("bucket", pa.int32()), ("docs", pa.binary()), ("words", pa.list_(pa.binary())), ("numbers", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
COUNTED_SQL = "kind string, batch bigint, bucket int, docs binary, words array<binary>, numbers array<int>, grams array<bigint>, n array<bigint>"


def packed(table: pa.Table) -> pa.Array:
    """One compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return pa.array([sink.getvalue().to_pybytes()], pa.binary())


def unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_py()).read_all()


class Batch:
    """Words and grams of some documents."""

    def __init__(self, number: int, depth: int, buckets: int):
        self.number, self.depth, self.buckets, self.chars = number, depth, buckets, 0
        self.words, self.times, self.grams = Numbers(), np.zeros(0, np.int64), Counter()

    def record(self, kind: str, size: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array([kind] * size, pa.string()), "batch": pa.array(np.full(size, self.number))}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in COUNTED], schema=COUNTED)

    def add(self, ids: list, held: list, texts: list[str]) -> pa.RecordBatch:
        get, numbers, streams = self.words.__getitem__, [], []
        for text, out in zip(texts, held):
            own, raw = [], [b"\n" * self.depth]
            for part in parts_of(text):
                own.append(np.fromiter(map(get, part), np.int32, len(part)))
                raw.append(b" ".join(part) + b" " if part else b"")
            own.append(np.array([get(b"\n")], np.int32))
            raw.append(b"\n")
            numbers.append(np.concatenate(own) if len(own) > 2 else np.append(*own) if len(own) == 2 else own[0])
            streams.append((b"".join(raw), out))
        times = np.zeros(len(self.words), np.int64)
        times[: len(self.times)] = self.times
        train = [x for x, out in zip(numbers, held) if not out]
        self.times = times + np.bincount(np.concatenate([np.zeros(0, np.int32), *train]), minlength=len(times))
        for out in (False, True):  # the lowest bit tells grams of held-out texts
            raw = np.frombuffer(b"".join(x for x, o in streams if o == out), np.uint8)
            sizes = np.fromiter((len(x) for x, o in streams if o == out), np.int64)
            pads = np.cumsum(sizes) - sizes
            for a in range(self.depth, len(raw), STRETCH):
                g = grams(raw[a - self.depth : a + STRETCH], self.depth)
                near = pads[(pads + self.depth > a) & (pads < a + len(g))]
                if len(near):  # no gram is scored inside the end symbols before a text
                    keep = np.ones(len(g), bool)
                    at = (near[:, None] + np.arange(self.depth)).ravel() - a
                    keep[at[(at >= 0) & (at < len(g))]] = False
                    g = g[keep]
                self.grams.add(g << 1 | out)
        self.chars += sum(map(len, texts))
        planes = np.concatenate(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        columns = [ids, held, list(map(len, numbers)), [planes, *[None] * (len(ids) - 1)]]
        return self.record("docs", 1, docs=packed(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, DOCS)], schema=DOCS)))

    def close(self) -> Iterator[pa.RecordBatch]:
        """The words by number, an array of words and one of grams for each bucket, and the counts
        after short contexts."""
        words = list(self.words)
        yield self.record("words", 1, docs=packed(pa.table({"word": pa.array(words, pa.binary())})))
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        some = np.flatnonzero(sizes)
        sizes = sizes[some]
        yield self.record("word", len(some), bucket=pa.array(some), words=lists(pa.array(words, pa.binary()).take(pa.array(order)), sizes), numbers=lists(order.astype(np.int32), sizes), n=lists(self.times[order], sizes))
        self.grams.sum()
        n = np.where(self.grams.keys & 1, 0, self.grams.times)
        keys, n = summed(self.grams.keys >> 1, n)
        low, times = summed(keys & LOW, n)
        yield self.record("low", 1, grams=lists(low[times > 0], [int((times > 0).sum())]), n=lists(times[times > 0], [int((times > 0).sum())]))
        bucket = mixed(keys, self.buckets)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        some = np.flatnonzero(sizes)
        yield self.record("gram", len(some), bucket=pa.array(some), grams=lists(keys[order], sizes[some]), n=lists(n[order], sizes[some]))


def counting_task(depth: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("suffixtree", None, dict)  # what other operators kept goes
        first, done = TaskContext.get().partitionId() << 24, 0
        batch = None
        for source in batches:
            held, at = source.column(1).to_pylist(), 0
            for ids, texts in text_chunks(source.select([0, 2]), STRETCH):
                batch = batch or Batch(first + done, depth, buckets)
                yield batch.add(ids, held[at : at + len(ids)], texts)
                at += len(ids)
                if batch.chars > BATCH_CHARS:
                    yield from batch.close()
                    batch, done = None, done + 1
        if batch:
            yield from batch.close()

    return run


def word_totals(table: pa.Table) -> pa.Table:
    """(batch, numbers, c, tokens, kinds) of a bucket: each word of each batch with its count in all."""
    words, sizes = flat(table.column("words"))
    n = flat(table.column("n"))[0].to_numpy()
    coded = words.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    total = np.bincount(at, n, len(coded.dictionary)).astype(np.int64)
    once = np.zeros((2, table.num_rows), np.int64)
    once[:, :1] = [[total.sum()], [(total > 0).sum()]]
    return pa.Table.from_arrays([table.column("batch"), table.column("numbers"), lists(total[at], sizes), pa.array(once[0]), pa.array(once[1])], names=["batch", "numbers", "c", "tokens", "kinds"])


def gram_totals(buckets: int):
    """(bucket, family, grams, n): the sums of a bucket's grams, by family."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, n = summed(flat(table.column("grams"))[0].to_numpy(), flat(table.column("n"))[0].to_numpy())
        family = mixed(keys >> 8 & LOW, buckets)
        order = np.argsort(family, kind="stable")
        sizes = np.bincount(family, minlength=buckets)
        some = np.flatnonzero(sizes)
        return pa.Table.from_arrays([pa.array(np.full(len(some), key[0].as_py()), pa.int32()), pa.array(some, pa.int32()), lists(keys[order], sizes[some]), lists(n[order], sizes[some])], names=["bucket", "family", "grams", "n"])

    return run


def below(keys: np.ndarray, d: int) -> np.ndarray:
    """The symbol with its latest ``d`` context symbols."""
    return keys & ((1 << 8 * (d + 1)) - 1)


class Low:
    """Counts after contexts of up to SHARED symbols."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.levels = []
        for d in range(SHARED + 1):
            own, count = summed(below(keys, d), n)
            ctx, total = summed(own >> 8, count)
            self.levels.append((own, count, ctx, total, summed(own >> 8, np.ones(len(own), np.int64))[1]))

    def find(self, keys: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count of the symbol after its context, of the context, and of the context's symbols."""
        own, count, ctx, total, kinds = self.levels[d]
        key = below(keys, d)
        return at(own, count, key), at(ctx, total, key >> 8), at(ctx, kinds, key >> 8)


def at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values at these keys, 0 where there are none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[k] == wanted, values[k], 0)


def smoothed(p: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray, state: np.ndarray) -> np.ndarray:
    return np.where(state, (n + kinds * p) / np.maximum(total + kinds, 1), p)


def probabilities(keys: np.ndarray, n: np.ndarray, low: Low, depth: int, least: int) -> np.ndarray:
    """log10 probability of each gram of a family (all its distinct grams), in its longest retained state."""
    p = np.full(len(keys), 1.0 / SYMBOLS)
    for d in range(min(depth, SHARED) + 1):
        up_n, up_total, kinds = low.find(keys, d)
        p = smoothed(p, up_n, up_total, kinds, up_total > 0)
    levels, open_ = [], np.zeros(len(keys), bool)
    for d in range(SHARED + 1, depth + 1):
        own, one, of = np.unique(below(keys, d), return_index=True, return_inverse=True)
        count = np.bincount(of, n, len(own))
        ctx, of_ctx = np.unique(own >> 8, return_inverse=True)
        total, kinds = np.bincount(of_ctx, count), np.bincount(of_ctx, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(count > 0, count * np.log((count / total[of_ctx]) / (up_n[one] / up_total[one])), 0)
            good = (total >= least) & (np.bincount(of_ctx, gain) >= 0.5 * kinds * np.log(total))
        where = of_ctx[of]
        up_n, up_total = count[of], total[where]
        levels.append((where, up_n, up_total, kinds[where], good))
    states = []
    for where, _, _, _, good in reversed(levels):  # suffixes of what is retained are retained
        open_ = good[where] | (np.bincount(where, open_, len(good)) > 0)[where]
        states.append(open_)
    for (_, count, total, kinds, _), state in zip(levels, reversed(states)):
        p = smoothed(p, count, total, kinds, state)
    return np.log10(p).astype(np.float32)


def family_task(shared, depth: int, least: int):
    """(bucket, grams, logs) of a family."""
    def run(table: pa.Table) -> pa.Table:
        low = kept("suffixtree", shared, lambda: Low(*shared.value))
        keys, sizes = flat(table.column("grams"))
        logs = probabilities(keys.to_numpy(), flat(table.column("n"))[0].to_numpy(), low, depth, least)
        return pa.Table.from_arrays([table.column("bucket"), table.column("grams"), lists(logs, sizes)], names=["bucket", "grams", "logs"])

    return run


def reply_task(asked: pa.Table, known: pa.Table) -> pa.Table:
    """(batch, grams, logs): what each batch asked a bucket for."""
    keys, logs = (flat(known.column(c))[0].to_numpy() for c in ("grams", "logs"))
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    wanted, sizes = flat(asked.column("grams"))
    return pa.Table.from_arrays([asked.column("batch"), asked.column("grams"), lists(logs[np.searchsorted(keys, wanted.to_numpy())], sizes)], names=["batch", "grams", "logs"])


class Lookup:
    """Numbers by distinct integer keys, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, values.dtype)
        place, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[left[free]]  # of several, one stays
            done = self.keys[place] == keys[left]
            self.values[place[done]] = values[left[done]]
            place, left = (place[~done] + 1) & (size - 1), left[~done]

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys that are all there."""
        place = self.place(keys)
        out = self.values[place]
        left = np.flatnonzero(self.keys[place] != keys)
        place = place[left]
        while len(left):
            place = (place + 1) & (len(self.keys) - 1)
            found = self.keys[place] == keys[left]
            out[left[found]] = self.values[place[found]]
            left, place = left[~found], place[~found]
        return out


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def text_scores(raw: np.ndarray, firsts: np.ndarray, depth: int, logs: Lookup) -> np.ndarray:
    """The sum of log probabilities of each text; ``firsts`` are the places of the end symbols before it."""
    out = np.zeros(len(firsts))
    for a in range(depth, len(raw), STRETCH):
        g = grams(raw[a - depth : a + STRETCH], depth)
        b = a + len(g)
        one, last = np.searchsorted(firsts + depth, [a, b - 1], "right") - 1
        inside = firsts[one : last + 2]
        pads = (inside[:, None] + np.arange(depth)).ravel()
        pads = pads[(pads >= a) & (pads < b)] - a
        score = np.ones(len(g), bool)
        score[pads] = False
        values = np.zeros(len(g), np.float64)
        values[score] = logs.of(g[score])
        out[one : last + 1] += np.add.reduceat(values, np.maximum(firsts[one : last + 1] + depth, a) - a)
    return out


def scoring_task(tokens: int, kinds: int, depth: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        is_words = pa.compute.equal(blocks.column("kind"), "words")
        spelt = unpacked(blocks.filter(is_words).column("docs")[0]).column("word").to_pylist()
        own = replies.filter(pa.compute.is_valid(replies.column("numbers")))
        c = np.empty(len(spelt), np.int64)
        c[flat(own.column("numbers"))[0].to_numpy()] = flat(own.column("c"))[0].to_numpy()
        told = replies.filter(pa.compute.is_valid(replies.column("logs")))
        logs = Lookup(flat(told.column("grams"))[0].to_numpy(), flat(told.column("logs"))[0].to_numpy())
        # the bytes of each word, a space after it (not after the end symbol); last the end symbols before a text
        data = np.frombuffer(b"".join(x for w in (*spelt, b"\n" * depth) for x in (w, b" ")), np.uint8)
        length = np.fromiter((len(w) + 1 for w in (*spelt, b"\n" * depth)), np.int64, len(spelt) + 1)
        start = np.cumsum(length) - length
        length[-1], length[spelt.index(b"\n")] = depth, 1
        base, known = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1))), c > 0
        done = []
        for block in blocks.filter(pa.compute.invert(is_words)).column("docs"):
            docs = unpacked(block)
            sizes = docs.column("size").to_numpy()
            planes = np.frombuffer(docs.column("planes")[0].as_py(), np.uint8).reshape(4, -1)
            k = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            line = np.insert(k, first, len(c))
            n = length[line]
            raw = np.concatenate([data[np.repeat(start[x] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))] for x, m in ((line[a : a + STRETCH], n[a : a + STRETCH]) for a in range(0, len(line), STRETCH))])
            before = (np.cumsum(n) - n)[first + np.arange(len(first))]
            columns = [docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), sizes, np.add.reduceat(known[k], first, dtype=np.int64), np.full(len(sizes), tokens), np.add.reduceat(base[k], first), text_scores(raw, before, depth, logs)]
            done.append(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCORED)], schema=SCORED))
        release()
        return pa.concat_tables(done)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, depth: int = DEPTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Learn from the rows that are not held out, score all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    if not SHARED <= depth <= 6:
        raise ValueError(f"contexts have {SHARED} to 6 symbols")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(col(id_col).cast("long").alias("doc_id"), held_out(col(id_col), folds, fold).alias("held_out"), col(text_col).alias("text"))
    counted = cut(source.mapInArrow(lambda batches: released(counting_task(depth, buckets)(batches)), COUNTED_SQL), "counted")
    of = lambda kind, *columns: counted.where(F.col("kind") == kind).select(*columns)
    known = cut(of("word", "bucket", "batch", "words", "numbers", "n").groupBy("bucket").applyInArrow(word_totals, "batch bigint, numbers array<int>, c array<bigint>, tokens bigint, kinds bigint"), "known")
    tokens, kinds = known.agg(F.sum("tokens"), F.sum("kinds")).first()
    low = of("low", F.explode(F.arrays_zip("grams", "n")).alias("x")).groupBy(F.col("x.grams").alias("key")).agg(F.sum("x.n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(tuple(low.column(c).to_numpy().astype(np.int64) for c in ("key", "n")))
    asked = of("gram", "bucket", "batch", "grams", "n")
    sums = asked.groupBy("bucket").applyInArrow(gram_totals(buckets), "bucket int, family int, grams array<bigint>, n array<bigint>")
    tree = sums.groupBy("family").applyInArrow(family_task(shared, depth, least_count), "bucket int, grams array<bigint>, logs array<float>")
    replies = asked.groupBy("bucket").cogroup(tree.groupBy("bucket")).applyInArrow(reply_task, "batch bigint, grams array<bigint>, logs array<float>")
    replies = known.select("batch", "numbers", "c").unionByName(replies, allowMissingColumns=True)
    spec = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    blocks = counted.where("kind IN ('docs', 'words')").select(F.col("batch").alias("of"), "kind", "docs")
    return blocks.groupBy("of").cogroup(replies.groupBy("batch")).applyInArrow(scoring_task(int(tokens or 0), int(kinds or 0), depth), spec)
