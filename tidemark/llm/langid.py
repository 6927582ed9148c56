"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and for every byte).
The probability of a text is the sum over all its segmentations into pieces, computed by the
forward algorithm; pieces never go past a space, so it is a product over space-separated units, and
over the parts of a long unit where no piece of the vocabulary goes on past a place.
The probabilities are learned by expectation-maximisation (forward-backward) on a bounded sample
of labelled rows.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null language is not learned from;
without any labelled row every text is ``und``; a null id counts as not held out; repeated rows are
treated one by one; scripts outside the vocabulary are scored byte by byte; more than MAX_LANGUAGES
languages are refused with an error; an empty table yields no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._scratch import col, kept, released
from tidemark.llm.wfst import CACHE_BYTES, WIDEST, Pieces, arcs, as_bytes, blocks, default_model, side_by_side, text_chunks, units_of

#: Rows of each language that the probabilities are fitted on, in expectation.
SAMPLE_ROWS = 1500

ROUNDS, SMOOTHING, CACHE_UNITS = 2, 0.05, 300_000
#: Numbers that the forward algorithm holds at a time: bytes of units times languages.
CELLS = 1_000_000
#: Bytes after which sums are scaled anew: a byte's share is 1e-9 at least.
RESCALE = 8
#: Languages that are told apart: the model has a column for each.
MAX_LANGUAGES = 400


def held_out(id_: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == fold, F.lit(False))


def forward(m, units: list[bytes], probability: np.ndarray) -> np.ndarray:
    """(units, languages) log probabilities. Sums are scaled anew every RESCALE bytes, so that no unit
    is too unlikely for a double."""
    out = np.empty((len(units), probability.shape[1]))
    for block in blocks(units, max(1, CELLS // probability.shape[1])):
        order, lengths, codes = side_by_side([units[k] for k in block])
        alpha = np.zeros((len(block), codes.shape[1] + 1, probability.shape[1]))
        alpha[:, 0] = 1
        total, at = np.zeros((len(block), probability.shape[1])), 0
        for p, q, rows, piece in arcs(m, codes, lengths):
            if p >= at + RESCALE:  # all arcs to this place are in
                own, at = alpha[: len(rows), p], p
                total[: len(rows)] += np.log(own)
                alpha[: len(rows), p : p + m.depth + 1] /= own[:, None].copy()
            alpha[rows, q] += alpha[rows, p] * probability[piece]
        out[np.array(block)[order]] = total + np.log(alpha[np.arange(len(block)), lengths])
    for k, u in enumerate(units):
        if len(u) > WIDEST:
            out[k] = forward_long(m, u, probability)
    return out


def forward_long(m, unit: bytes, probability: np.ndarray) -> np.ndarray:
    """The same for one long unit, scaled at every position; memory is that of the longest piece."""
    depth, total = max(m.depth, 1), np.zeros(probability.shape[1])
    ahead = np.zeros((depth + 1, probability.shape[1]))
    ahead[0] = 1
    for p, b in enumerate(unit):
        here, state, q = ahead[p % (depth + 1)].copy(), 1, p
        ahead[p % (depth + 1)] = 0
        scale = np.where(here > 0, here, 1.0)
        total += np.log(scale)
        ahead /= scale
        here = here / scale
        ahead[(p + 1) % (depth + 1)] += here * probability[m.byte_id[b]]
        while q < len(unit) and 0 < state < m.inner:
            state = m.next[state, unit[q]]
            q += 1
            i = m.final[state] if state else -1
            if i >= 0:
                ahead[q % (depth + 1)] += here * probability[i]
    return total + np.log(np.maximum(ahead[len(unit) % (depth + 1)], 1e-300))


def expected_counts(m, units: list[bytes], weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in short units under one language, each unit ``weights`` times.
    Forward and backward sums are scaled to 1 at every place, and the scales kept as logarithms."""
    order, lengths, codes = side_by_side(units)
    n, width = len(units), codes.shape[1] + 1
    alpha, log_alpha, total = np.zeros((n, width)), np.zeros((n, width)), np.zeros(n)
    alpha[:, 0] = 1
    steps, at = [], -1
    for p, q, rows, piece in arcs(m, codes, lengths):
        if p > at:
            own, at = alpha[: len(rows), p].copy(), p
            total[: len(rows)] += np.log(own)
            log_alpha[: len(rows), p] = total[: len(rows)]
            alpha[: len(rows), p : p + m.depth + 1] /= own[:, None]
        alpha[rows, q] += alpha[rows, p] * probability[piece]
        steps.append((p, q, rows, piece))
    log_z = total + np.log(alpha[np.arange(n), lengths])
    beta, total, w = np.zeros((n, width)), np.zeros(n), weights[order]
    beta[np.arange(n), lengths] = 1
    counts, k = np.zeros(len(probability)), len(steps)
    while k:  # the arcs of one place together, last place first
        p, first = steps[k - 1][0], k
        while first and steps[first - 1][0] == p:
            first -= 1
        for _, q, rows, piece in steps[first:k]:
            on = probability[piece] * beta[rows, q]
            beta[rows, p] += on
            counts += np.bincount(piece, weights=w[rows] * np.exp(log_alpha[rows, p] + total[rows] - log_z[rows]) * on, minlength=len(counts))
        live = int(np.searchsorted(-lengths, -p, "left"))
        own = beta[:live, p].copy()
        total[:live] += np.log(own)
        beta[:live, p : p + m.depth + 1] /= own[:, None]
        k = first
    return counts


def arcs_at(m, unit: bytes, p: int) -> list[tuple[int, int]]:
    """(to, piece) of the arcs from one position of a unit."""
    found, state, q = [(p + 1, m.byte_id[unit[p]])], 1, p
    while q < len(unit) and 0 < state < m.inner:
        state = m.next[state, unit[q]]
        q += 1
        i = m.final[state] if state else -1
        if i >= 0:
            found.append((q, i))
    return found


def expected_counts_long(m, unit: bytes, weight: float, probability: np.ndarray) -> np.ndarray:
    """The same for one long unit, in logarithms; memory is proportional to its length."""
    n, log_p = len(unit), np.log(np.maximum(probability, 1e-300))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0], beta[n] = 0, 0
    for p in range(n):
        for q, i in arcs_at(m, unit, p):
            alpha[q] = np.logaddexp(alpha[q], alpha[p] + log_p[i])
    counts = np.zeros(len(probability))
    for p in range(n - 1, -1, -1):
        for q, i in arcs_at(m, unit, p):
            on = log_p[i] + beta[q]
            beta[p] = np.logaddexp(beta[p], on)
            counts[i] += weight * np.exp(alpha[p] + on - alpha[n])
    return counts


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    probability: np.ndarray  # (pieces, languages): its size is fixed by vocabulary and languages
    prior: np.ndarray
    path: str


def sample(labelled: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """About ``rows`` rows of each language, chosen by a hash; no shuffle."""
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("id"), F.col("text")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(u < F.element_at(share, F.col("lang")))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on the rows with a language. What reaches the driver is one count per piece and language."""
    path = path or default_model()
    source = labelled.select(col(id_col).alias("id"), F.lower(col(text_col)).alias("text"), col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in source.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, m = sorted(counts), Pieces(path)
    total = np.array([float(counts[x]) for x in languages])
    # at first, every piece is as likely as its length allows
    start = np.where(m.final >= 0, 1.0, 0.0)
    base = np.full(m.size, 1e-9)
    base[m.final[m.final >= 0]] = 1.0 / start.sum()
    base[m.byte_id] = np.maximum(base[m.byte_id], 1e-6)
    probability = np.repeat(base[:, None], max(len(languages), 1), axis=1)
    chosen = sample(source, counts, rows).select("text", "lang") if languages else None
    for _ in range(rounds if languages else 0):
        at, now = {x: k for k, x in enumerate(languages)}, probability.astype(np.float32)

        def run(batches, at=at, now=now):
            own, found = worker(path)["pieces"], {}
            for batch in batches:
                for langs, texts in text_chunks(batch.select(["lang", "text"]), 500_000):
                    seen: dict[str, dict[bytes, int]] = {}
                    for lang, text in zip(langs, texts):
                        by = seen.setdefault(lang, {})
                        for u in units_of(own, text):
                            by[u] = by.get(u, 0) + 1
                    for lang, by in seen.items():
                        raw, times, p = as_bytes(list(by)), np.array(list(by.values()), float), now[:, at[lang]].astype(float)
                        for block in blocks(raw, CELLS):
                            found[lang] = found.get(lang, 0) + expected_counts(own, [raw[k] for k in block], times[block], p)
                        for u, n in zip(raw, times):
                            if len(u) > WIDEST:
                                found[lang] = found.get(lang, 0) + expected_counts_long(own, u, n, p)
            for lang, c in found.items():
                i = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(c[i], pa.float64())], names=["lang", "piece", "n"])

        summed = chosen.mapInArrow(lambda batches, run=run: released(run(batches)), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        c = np.zeros_like(probability)
        c[summed["piece"].to_numpy(np.int64), [at[x] for x in summed["lang"]]] = summed["n"].to_numpy(float)
        usable = (base > 1e-9)[:, None]
        c = np.where(usable, c + SMOOTHING, 0.0)
        probability = np.maximum(c / c.sum(axis=0), 1e-9)
    return LanguageModel(languages, probability.astype(np.float32), np.log(total / total.sum()) if languages else np.zeros(1), path)


def worker(path: str) -> dict:
    """What a worker keeps for this operator: the pieces, and the scorer of a model."""
    return kept(f"langid {path}", None, lambda: {"pieces": Pieces(path), "of": None, "scorer": None})


class Scorer:
    """Log probabilities of texts, remembered by unit."""

    def __init__(self, m: Pieces, probability: np.ndarray):
        self.m, self.probability = m, probability.astype(float)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str | bytes, int] = {}
        self.held, self.table = 0, np.zeros((0, self.probability.shape[1]), np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        if len(self.at) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.forget()
        units = [units_of(self.m, t) for t in texts]
        missing = list(set().union(*units).difference(self.at))
        if missing:
            raw = as_bytes(missing)
            self.held += sum(map(len, raw))
            self.at.update(zip(missing, range(len(self.table), len(self.table) + len(missing))))
            self.table = np.concatenate([self.table, forward(self.m, raw, self.probability).astype(np.float32)])
        get, out = self.at.__getitem__, np.zeros((len(texts), self.table.shape[1]))
        for k, x in enumerate(units):
            if x:
                out[k] = self.table[np.fromiter(map(get, x), np.int64, len(x))].sum(axis=0, dtype=float)
        return out


def _scorer(holder) -> Scorer:
    own = worker(holder.value.path)
    if own["of"] is not holder:
        own["of"], own["scorer"] = holder, Scorer(own["pieces"], holder.value.probability)
    return own["scorer"]


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more: the language and its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(text: pd.Series, letters: pd.Series) -> pd.DataFrame:
        scorer, model, lang, score = _scorer(shared), shared.value, [], []
        texts, has = text.tolist(), letters.tolist()
        k = 0
        while k < len(texts):  # a bounded number of characters at a time
            n, end = 0, k
            while end < len(texts) and (n == 0 or n < 2_000_000):
                n += len(texts[end] or "") + 1
                end += 1
            good = [bool(h) and bool(model.languages) for h in has[k:end]]
            logs = scorer.score([t if g else "" for t, g in zip(texts[k:end], good)]) + model.prior
            best = logs.argmax(axis=1)
            p = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            lang += [model.languages[b] if g else "und" for b, g in zip(best, good)]
            score += [float(x) if g else 0.0 for x, g in zip(p, good)]
            k = end
        return pd.DataFrame({"lang": lang, "score": score})

    @F.pandas_udf("lang string, score double")
    def predict(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from released(judged(*x) for x in columns)

    low = F.lower(col(text_col))
    found = predict(low, F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return docs.select(*[col(c) for c in docs.columns], found.alias(out[0] + out[1])).select(*[col(c) for c in docs.columns], F.col(f"`{out[0]}{out[1]}`.lang").alias(out[0]), F.col(f"`{out[0]}{out[1]}`.score").alias(out[1]))


def language_report(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out (a third is), predict all."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    model = learn(rows.where(~F.col("held_out")))
    return identify(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
