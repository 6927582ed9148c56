"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: term frequency times inverse document
frequency, 1 - ln(share of the documents that have it). Shares are counted over all different texts
(copies of a text would make what they share weigh less than the edits of its near copies, the less the more
there are) in 2^22 hash counters, less what an average shingle finds there by collision, so the table that tasks
share never grows; below RARE_SHARE (one document in 8192), where such counters cannot tell shares apart in a
large corpus, all weigh the same. A weight thus depends on shares alone, at any size of the corpus. Each document gets K consistent
weighted samples (Ioffe 2010), grouped to bands; documents that share a band are candidates, and a
pair is linked if its exact weighted Jaccard similarity is at least 0.8. Classes are the connected
components of the links.

Every pair that shares a band is looked at, unless its rows are in one component already. To get
there early, each bucket first compares its members with a few of them, the most central (whose
buckets are largest in sum: in a family of edited copies that is the original), for a few rounds.
In every bucket that still holds more than one component, all pairs of the rest then meet in blocks
of a bounded number of members and of their shingles. That part grows with the square of such a bucket.

Equal texts are one node of the graph from the start, however many rows have them.

Defined results: a row whose text is null or has no words is a class of its own; a text of fewer
than five words is one shingle; a null id comes before any other; of repeated rows one is kept; an
empty table yields no rows; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, cut, fresh, kept, released

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: Counters of document frequencies, and the share of all documents below which a shingle is just rare.
DF_BITS, RARE_SHARE = 22, 2.0**-13
#: Counters that travel together.
DF_BLOCK = 1 << 16
#: Shingles that a task gathers before it counts them.
DF_OPEN = 2_000_000
#: A candidate pair whose samples agree in less than this share is not looked at further: at a
#: similarity of 0.8 that is 4.2 standard deviations away.
LEAST_AGREEMENT = 0.56
CHUNK_CHARS, CACHE_WORDS, BLOCK = 1_000_000, 300_000, 1024
#: Members of a bucket that all its members are compared with in one round.
LEADERS = 4
#: Rounds of leaders before all pairs of the rest meet, and members of a bucket in a block of the rest.
LEADER_ROUNDS, BLOCK_ROWS = 4, 256
#: Distinct shingles of the members of a block together, so that long texts come in smaller blocks.
BLOCK_SHINGLES = 1_000_000
#: A node is hot if it holds more than this share of all rows; there are fewer than 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000

WORD = re.compile(r"\w+")
_U = np.uint64
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered by the worker."""

    def __init__(self):
        self.new: list[str] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words of each text."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.hashes = np.zeros(0, np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        get = self.__getitem__
        at = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(get, x), np.int64, len(x)) for x in texts)])
        if self.new:
            self.hashes = np.concatenate([self.hashes, pd.util.hash_array(np.array(self.new, dtype=object), categorize=False)])
            self.new = []
        return self.hashes[at], sizes


def word_hashes() -> WordHashes:
    return kept("neardup", None, WordHashes)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts, text after text, and where each text's begin and end."""
    h, sizes = word_hashes().of([WORD.findall(t.lower()) for t in texts])
    ends = np.cumsum(sizes)
    total = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        shifted = np.zeros(len(h), np.uint64)
        shifted[: max(len(h) - k, 0)] = h[k:]
        if k:  # words of the next text don't count
            left = np.repeat(ends, sizes) - np.arange(len(h))
            shifted[left <= k] = 0
        total += (shifted ^ _U(k)) * _TURNS[k]
    total = mix(total)
    found, counts = [], []
    for a, n in zip(ends - sizes, sizes):
        x, c = np.unique(total[a : a + max(n - WORDS + 1, min(n, 1))], return_counts=True)
        found.append(x)
        counts.append(c)
    bounds = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(empty + found), np.concatenate([np.zeros(0, np.int64), *counts]), bounds


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - DF_BITS)).astype(np.int64)


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    """Weights by counter: each counter less the mean of the others estimates one shingle's documents."""
    others, size, out = df.sum(), max(len(df) - 1, 1), np.empty(len(df), np.float32)
    for a in range(0, len(df), DF_BLOCK):
        own = df[a : a + DF_BLOCK] * (1 + 1 / size) - others / size
        out[a : a + DF_BLOCK] = 1 - np.log(np.clip(own / max(n, 1), RARE_SHARE, 1))
    return out


@lru_cache(maxsize=2)
def draws(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of K samples, and quantiles at 2^16 points: -ln u, and of the Gamma(2, 1) distribution."""
    seeds = mix(np.arange(1, k + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    u = (np.arange(65536) + 0.5) / 65536
    x = np.full(65536, 1.7)
    for _ in range(60):  # Newton steps on the distribution function 1 - (1 + x) exp(-x)
        x = np.clip(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 3, x * 3 + 1e-3)
    return seeds, (-np.log(u)).astype(np.float32), x.astype(np.float32), u.astype(np.float32)


def samples(h: np.ndarray, w: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(texts, K) consistent weighted samples; texts without shingles get zeros."""
    seeds, log_u, gamma, uniform = draws(k)
    n = len(bounds) - 1
    best, sig = np.full((n, k), np.inf, np.float32), np.zeros((n, k), np.uint32)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    log_w = np.log(w).astype(np.float32)
    for a in range(0, len(h), BLOCK):
        own, x = owner[a : a + BLOCK], h[a : a + BLOCK, None]
        z = (x ^ seeds) * _U(0xD6E8FEB86659FD93)
        z ^= z >> _U(32)
        z *= _U(0xC2B2AE3D27D4EB4F)
        z ^= z >> _U(29)
        part = np.ascontiguousarray(z).view(np.uint16).reshape(len(own), k, 4)
        r, beta = gamma.take(part[:, :, 3]), uniform.take(part[:, :, 2])
        t = np.floor(log_w[a : a + BLOCK, None] / r + beta)
        value = log_u.take(part[:, :, 1])
        value += log_u.take(part[:, :, 0])
        np.log(value, out=value)
        beta -= t
        beta -= 1
        beta *= r
        value += beta
        label = x.astype(np.uint32) * np.uint32(0x9E3779B1) ^ t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA77)
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        least = np.minimum.reduceat(value, starts, axis=0)
        rows = own[starts]
        at_least = value == np.repeat(least, np.diff(np.append(starts, len(own))), axis=0)
        chosen = np.maximum.reduceat(np.where(at_least, label, 0), starts, axis=0)
        before = best[rows]  # a text may have begun in an earlier block
        sig[rows] = np.where(least < before, chosen, np.where(least == before, np.maximum(chosen, sig[rows]), sig[rows]))
        best[rows] = np.minimum(least, before)
    return sig


def text_chunks(batch: pa.RecordBatch):
    """(columns but the last, texts) of a batch, a bounded number of characters at a time."""
    texts, first, n = [], 0, 0
    for k, t in enumerate(batch.column(batch.num_columns - 1)):
        texts.append(t.as_py() or "")
        n += len(texts[-1])
        if n > CHUNK_CHARS or k == batch.num_rows - 1:
            yield batch.slice(first, len(texts)), texts
            texts, first, n = [], k + 1, 0


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Sums of the document frequencies of the shingles by bucket, and the number of documents. Each
    task sends its counters as compressed blocks, and blocks are summed where they meet; 2^22 numbers reach the driver."""
    def run(batches):
        df, n, open_ = np.zeros(1 << DF_BITS, np.int32), 0, []
        for batch in batches:
            for _, texts in text_chunks(batch):
                open_.append(buckets(shingles(texts)[0]).astype(np.int32))
                n += len(texts)
                if sum(map(len, open_)) > DF_OPEN:
                    df += np.bincount(np.concatenate(open_), minlength=len(df)).astype(np.int32)
                    open_ = []
        if open_:
            df += np.bincount(np.concatenate(open_), minlength=len(df)).astype(np.int32)
        blocks = df.reshape(-1, DF_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1)).tolist()
        packed = [zlib.compress(blocks[k].tobytes(), 1) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([n.to_bytes(8, "little"), *packed], pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = counts.as_py()
                own = np.frombuffer(raw, np.int64) if block < 0 else np.frombuffer(zlib.decompress(raw), np.int32)
                total[block] = total.get(block, 0) + own.astype(np.int64)
        packed = [x.tobytes() if block < 0 else zlib.compress(x.tobytes(), 1) for block, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    form = "block int, counts binary"
    counts = rows.select("text").mapInArrow(lambda batches: released(run(batches)), form).repartition("block").mapInArrow(lambda batches: released(add(batches)), form)
    df, n = np.zeros((1 << DF_BITS) // DF_BLOCK * DF_BLOCK, np.int64), 0
    for block, raw in counts.collect():  # one row for each block
        if block < 0:
            n = int.from_bytes(raw, "little")
        else:
            df[block * DF_BLOCK : (block + 1) * DF_BLOCK] = np.frombuffer(zlib.decompress(raw), np.int64)
    return df, n


def digest_of(text: str = "text") -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def different(rows: DataFrame) -> DataFrame:
    """(text) of ``rows``, equal ones once. Texts whose digest is not repeated stay where they are; only the others are
    shuffled, behind a bitmap that may let more through."""
    texts = rows.select(digest_of().alias("node"), "text")
    repeated = cut(texts.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated")
    maybe = F.col("node").isNull() | may_be_in(repeated)
    return texts.where(~maybe).select("text").union(texts.where(maybe).dropDuplicates(["node"]).select("text"))


def table_of(idf) -> np.ndarray:
    """The weights, of an array or of what was sent to all tasks once."""
    return idf if isinstance(idf, np.ndarray) else idf.value


def signatures(rows: DataFrame, idf, k: int) -> DataFrame:
    """(id, row, node, size, sig): node is a digest of the text, null for a text without words; size is
    the number of its shingles."""
    def run(batches):
        for batch in batches:
            for part, texts in text_chunks(batch):
                h, c, bounds = shingles(texts)
                sig = samples(h, (c * table_of(idf)[buckets(h)]).astype(np.float32), bounds, k).view(np.int32)
                some = np.diff(bounds) > 0
                nodes = [hashlib.md5(t.encode()).digest() if s else None for t, s in zip(texts, some)]
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(np.diff(bounds), pa.int32()), sigs], names=["id", "row", "node", "size", "sig"])

    return rows.select("id", "row", "text").mapInArrow(lambda batches: released(run(batches)), "id bigint, row bigint, node binary, size int, sig array<int>")


def weighted_jaccard(texts: list[str], idf) -> list[tuple[np.ndarray, np.ndarray]]:
    h, c, bounds = shingles(texts)
    w = c * table_of(idf)[buckets(h)].astype(np.float64)
    return [(h[a:b], w[a:b]) for a, b in zip(bounds, bounds[1:])]


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j]).sum()
    return float(both / (x[1].sum() + y[1].sum() - both)) if len(x[0]) and len(y[0]) else 0.0


def verified(pairs: DataFrame, idf, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, text_a, text_b) at ``least`` or above."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            for k in range(0, batch.num_rows, 200):
                n = min(200, batch.num_rows - k)
                left, right = batch.column(2).slice(k, n).to_pylist(), batch.column(3).slice(k, n).to_pylist()
                distinct = list(dict.fromkeys(left + right))
                known = dict(zip(distinct, weighted_jaccard(distinct, idf)))
                s = np.array([similarity(known[x], known[y]) for x, y in zip(left, right)])
                yes = pa.array(s >= least)
                yield pa.RecordBatch.from_arrays([a.slice(k, n).filter(yes), b.slice(k, n).filter(yes), pa.array(s[s >= least])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: released(run(batches)), "a binary, b binary, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by label propagation with pointer jumping:
    a node takes the least label of its neighbours and of its own label. Each round ends in a table
    in the shared folder."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = labels.join(up, "label").join(near, "node").select("node", F.least("label", "up", "near").alias("label"), (F.least("up", "near") < F.col("label")).alias("changed"))
        new = cut(new, "labels")
        if new.where("changed").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def may_be_in(nodes: DataFrame, bits: int = 20) -> Column:
    """False for most nodes that are not among ``nodes``, by a bitmap of 2^20 hash values: spares
    their texts the shuffle. Its size is fixed; with very many nodes it only lets more through."""
    place = F.pmod(F.xxhash64("node"), F.lit(1 << bits))
    at = F.shiftright(place, 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = nodes.groupBy(at.alias("at")).agg(F.bit_or(bit).alias("w")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words.column("at").to_numpy()] = words.column("w").to_numpy()
    return F.get(F.lit(bitmap), at).bitwiseAND(bit) != 0


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after new links (a, b), which join old components."""
    if labels is None:
        return components(links)
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    moved = components(cut(between, "between")).select(F.col("node").alias("old"), F.col("label").alias("new"))
    named = labels.union(links.select(F.explode(F.array("a", "b")).alias("node"), F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    return cut(named.join(moved, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def grouped(batches, columns: int):
    """Tables of the rows that agree in the first ``columns`` columns, from batches sorted by them."""
    open_, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)])
        starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            key = tuple(keys[a])
            if open_ and key != last:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
            last = key
    if open_:
        yield pa.Table.from_batches(open_)


def candidates(part: pa.Table, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block that may be links, as two arrays of places, and the labels as numbers.
    Each pair is looked at in the first band that it shares and nowhere else."""
    lo, hi, band = (part.column(k)[0].as_py() for k in (1, 2, 3))
    sig = part.column("sig").combine_chunks().flatten().to_numpy().reshape(part.num_rows, bands * rows)
    label = np.unique(np.array(part.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
    own = part.column("own").to_numpy()
    left = np.arange(part.num_rows) if lo == hi else np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    xs, ys = [], []
    for x in left:
        y = right[(label[right] != label[x]) & ((right > x) if lo == hi else True)]
        same = sig[y] == sig[x]
        first = same[:, : band * rows].reshape(len(y), band, rows).all(axis=2).any(axis=1)
        y = y[~first & (same.sum(axis=1) >= LEAST_AGREEMENT * bands * rows)]
        xs.append(np.full(len(y), x))
        ys.append(y)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + xs), np.concatenate(none + ys), label


def rest_links(entries: DataFrame, nodes: DataFrame, keys: Column, texts: DataFrame, idf, least: float, bands: int, rows: int) -> DataFrame:
    """(a, b, similarity) between different components of the entries (key, node, label): links that
    join all that any pair of a bucket joins. A bucket is cut to blocks of its members, and each two
    blocks meet in a group of their own, so that no task holds a bucket."""
    many = entries.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("size")).where("lo <> hi")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    many = many.select("key", parts.alias("parts"))
    own = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("parts")).cast("int")
    rest = entries.select("key", "node", "label").join(many, "key").withColumn("own", own)
    rest = rest.join(nodes.select("node", "sig").hint("merge"), "node").withColumn("band", (F.array_position(keys, F.col("key")) - 1).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "band", "own", "node", "label", "sig")
    place = ["key", "lo", "hi"]

    def meet(batches):
        for part in grouped(batches, 3):
            x, y, _ = candidates(part, bands, rows)
            if len(x):
                yield from part.take(pa.array(np.union1d(x, y))).to_batches()

    def verify(batches):
        for part in grouped(batches, 3):
            x, y, label = candidates(part, bands, rows)
            known = weighted_jaccard(part.column("text").to_pylist(), idf)
            sums = np.array([w.sum() for _, w in known])
            able = np.minimum(sums[x], sums[y]) >= least * np.maximum(sums[x], sums[y]) * (1 - 1e-9)
            links = []
            for i, j in zip(x[able], y[able]):
                if label[i] != label[j]:
                    s = similarity(known[i], known[j])
                    if s >= least:
                        links.append((i, j, s))
                        label[label == label[j]] = label[i]
            if links:
                i, j, s = zip(*links)
                names = part.column("node").to_pylist()
                ends = [(min(names[a], names[b]), max(names[a], names[b])) for a, b in zip(i, j)]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], pa.binary()), pa.array([b for _, b in ends], pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    near = cut(rest.repartition(*place).sortWithinPartitions(*place).mapInArrow(meet, rest.schema), "near")
    near = near.join(texts.select("node", "text").hint("merge"), "node").select(*rest.columns, "text")
    return cut(near.repartition(*place).sortWithinPartitions(*place).mapInArrow(verify, "a binary, b binary, similarity double"), "links")


def links_of(nodes: DataFrame, texts: DataFrame, idf, least: float, bands: int, rows: int) -> DataFrame | None:
    """(node, label) of the nodes (node, sig) that have links; nothing if none have."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))
    # the joins of tables that grow with the corpus are sort-merge joins at every size
    nodes = nodes if "size" in nodes.columns else nodes.withColumn("size", F.lit(1))
    entries = cut(nodes.select("node", "size", F.explode(keys).alias("key")), "entries")
    size = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(entries.join(cut(size, "sizes").hint("merge"), "key"), "shared")
    central = cut(shared.groupBy("node").agg(F.sum("n").alias("central")), "central")
    if central.isEmpty():
        return None
    # to compare samples, eight bits of each are enough
    bits = nodes.select("node", F.transform("sig", lambda x: F.shiftright(x, 24).cast("tinyint")).alias("bits"))
    central = central.join(bits.where(may_be_in(central)), "node")
    entries = cut(shared.select("key", "node", "size").join(central, "node"), "entries")
    # one of equal texts is enough, and all but one go before the shuffle
    texts = texts.where(may_be_in(shared)).dropDuplicates(["node"])
    texts = cut(texts.join(shared.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")
    entries, labels = entries.withColumn("label", F.col("node")), None
    for turn in range(LEADER_ROUNDS):
        # buckets that hold different components, and in each of their LEADERS parts the most central
        mixed = entries.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        part = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(LEADERS)).alias("part")
        lead = entries.groupBy("key", part).agg(F.max(F.struct("central", "node", "bits", "label")).alias("lead")).join(mixed, "key")
        lead = cut(lead.select("key", F.col("lead.node").alias("lead"), F.col("lead.bits").alias("lead_bits"), F.col("lead.label").alias("lead_label")), "lead")
        agree = F.aggregate(F.zip_with("bits", "lead_bits", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        met = entries.join(lead, "key").where("label <> lead_label").where(agree >= LEAST_AGREEMENT * bands * rows)
        pairs = met.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        for side in ("a", "b"):
            pairs = cut(pairs, "pairs").join(texts.hint("merge").select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
        links = cut(verified(pairs, idf, least), "links")
        found = not links.isEmpty()
        if found:
            labels = joined(labels, links)
        # who has led has met the whole bucket
        rest = entries.drop("label").join(lead.select("key").distinct(), "key", "left_semi").join(lead.select("key", F.col("lead").alias("node")), ["key", "node"], "left_anti")
        rest = rest.withColumn("label", F.col("node")) if labels is None else rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        entries = cut(rest.select("key", "node", "size", "bits", "central", "label"), "rest")
        if not found:
            break
    links = rest_links(entries, nodes, keys, texts, idf, least, bands, rows)
    return labels if links.isEmpty() else joined(labels, links)


def classes(rows: DataFrame, least: float = SIMILARITY, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """(id, row, class_id, class_rows, kept) of the rows (id, row, text), which must be a table:
    the least id of the class, its number of rows, and whether this row is the one that stays."""
    df, n = document_frequencies(different(rows))
    idf = rows.sparkSession.sparkContext.broadcast(idf_table(df, n))  # 2^22 numbers at any size
    signed = cut(signatures(rows, idf, bands * band_rows), "signatures")
    worded = signed.where("node IS NOT NULL")
    own = worded.groupBy("node").agg(F.min(F.struct("id", "row")).alias("top"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = cut(own, "nodes")
    texts = rows.select(digest_of().alias("node"), "text")
    labels = links_of(nodes.select("node", "sig", "size"), texts, idf, least, bands, band_rows)
    if labels is None:
        labelled = nodes.select("node", F.col("node").alias("label"), "top", "n")
    else:
        labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "top", "n")
    labelled = cut(labelled, "labelled")
    groups = cut(labelled.groupBy("label").agg(F.min("top").alias("class_top"), F.sum("n").alias("class_rows")), "groups")
    by_node = cut(labelled.join(groups, "label").select("node", "n", "class_top", "class_rows"), "by_node")
    few = F.broadcast(by_node.where(F.col("n") > rows.count() * HOT_SHARE))  # fewer than 1 / HOT_SHARE nodes
    mass = worded.join(few.select("node"), "node", "left_anti").join(by_node, "node")
    known = mass.select("id", "row", "class_top", "class_rows").union(worded.join(few, "node").select("id", "row", "class_top", "class_rows"))
    alone = signed.where("node IS NULL").select("id", "row", F.struct("id", "row").alias("class_top"), F.lit(1).cast("long").alias("class_rows"))
    return known.union(alone).select("id", "row", F.col("class_top.id").alias("class_id"), "class_rows", (F.col("row") == F.col("class_top.row")).alias("kept"))


def numbered(docs: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    """``docs`` as a table with a row number."""
    return cut(docs.select(*[col(c) for c in docs.columns], F.monotonically_increasing_id().alias(row)), "numbered")


def near_dup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_rows, kept."""
    rows = numbered(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), "id", "text", "row").select("id", "row", "text")
    return classes(rows, **options).select(F.col("id").alias("doc_id"), "class_id", "class_rows", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class."""
    (row,) = fresh(docs, "_row")
    table = numbered(docs, id_col, text_col, row)
    found = classes(table.select(col(id_col).cast("long").alias("id"), col(row).alias("row"), col(text_col).alias("text")), **options)
    kept = found.where("kept").select(F.col("row").alias(row))
    return table.join(kept, row, "left_semi").select(*[col(c) for c in docs.columns])
