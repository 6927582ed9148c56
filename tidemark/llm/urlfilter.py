"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is judged by the model on its intercept; repeated rows get equal verdicts; an empty table yields
no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._scratch import LOWER, UPPER, col

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A page is blocked from this probability on.
THRESHOLD = 0.5
#: Rules are compared with every url, so a list of them stays short.
MAX_RULES = 1000

#: The small labelled table: hosts made of two words, of which the first says what a site is about.
BLOCKED_TOPICS = (
    "casino", "poker", "jackpot", "slots", "roulette", "betting", "lottery", "bingo", "escort", "adult", "nude", "viagra", "pills", "payday",
    "loans", "giveaway", "replica", "warez", "keygen", "torrent", "adserver", "banner", "followers", "backlinks", "prize",
    "spam", "ads", "track", "clicks", "popup",
)
BLOCKED_PLACES = ("bonus", "free", "win", "cheap", "club24", "deals", "vip", "farm")
ALLOWED_TOPICS = (
    "library", "museum", "garden", "weather", "news", "university", "recipes", "software", "cycling", "physics", "letters", "parks", "birds",
    "railway", "health", "school", "chess", "gallery", "travel", "books", "astronomy", "geology", "botany", "philosophy", "linguistics",
    "mathematics", "engineering", "economics", "theatre", "orchestra", "cooking", "photography", "sailing", "history", "council", "bakery",
    "climate", "river", "ocean", "dictionary", "radio", "science", "teachers", "parliament", "statistics",
)
ALLOWED_PLACES = ("archive", "city", "institute", "journal", "society", "notes", "public", "national")
#: Words beside the topic that either kind may have.
SHARED_PLACES = ("online", "world", "center", "daily", "group", "best", "hub", "home")
#: Paths that either kind may have, and those of one kind.
PATHS, BLOCKED_PATHS, ALLOWED_PATHS = ("", "en/12", "fr/7?page=2", "de/33.html", "es/index/"), ("free-spins/play", "win-now/claim"), ("articles/2019/review", "about/contact")


def hosts(topics: tuple[str, ...], places: tuple[str, ...]) -> list[str]:
    """Each topic with two words of its kind and two of either, before it or behind; other ones from topic to topic."""
    turn = lambda of, k: of[k % len(of)]
    own = lambda k, j: turn(places, 2 * k + j)
    either = lambda k, j: turn(SHARED_PLACES, 2 * k + j)
    return [name for k, topic in enumerate(topics) for name in (f"{topic}-{own(k, 0)}.test", f"{own(k, 1)}{topic}.test", f"{topic}-{either(k, 0)}.test", f"{either(k, 1)}{topic}.test")]


LABELLED = [
    (f"https://{host}/{path}", label)
    for topics, places, own, label in ((BLOCKED_TOPICS, BLOCKED_PLACES, BLOCKED_PATHS, 1), (ALLOWED_TOPICS, ALLOWED_PLACES, ALLOWED_PATHS, 0))
    for k, host in enumerate(hosts(topics, places))
    for path in (PATHS[k % len(PATHS)], PATHS[(k + 2) % len(PATHS)], own[k % 2] if k % 4 == 0 else PATHS[(k + 3) % len(PATHS)])
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path, both empty where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, of equals the one with the longer host, as a struct (n, h, rule, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compared with every url")
    fits = [
        F.when(
            ((host == F.lit(h)) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(len(h)).alias("h"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def ngram_buckets(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """Distinct hash buckets of the character n-grams of host and path."""
    def grams(text: Column, tag: str) -> list[Column]:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.pmod(F.xxhash64(F.lit(f"{tag}{n}"), g), F.lit(buckets)).cast("int")) for n in sizes]

    return F.array_distinct(F.concat(*grams(host, "h"), *grams(path, "p")))


def margin(features: Column, weights: np.ndarray, intercept: float) -> Column:
    """Dot product of the indicator features, scaled to unit length, and a fixed-size array of weights."""
    table = F.split(F.lit(",".join(map(repr, weights.tolist()))), ",").cast("array<double>")  # folded to one constant
    total = F.aggregate(features, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return total / F.sqrt(F.greatest(F.size(features), F.lit(1)).cast("double")) + F.lit(float(intercept))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), buckets: int = 4096, steps: int = 25, rate: float = 6.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with momentum on (url, label). The gradient of each step is a
    DataFrame aggregation; the driver holds one weight per bucket, whatever the table's size."""
    host, path = host_path(F.col("url"))
    rows = labelled.select(ngram_buckets(host, path, sizes, buckets).alias("f"), F.col("label").cast("double").alias("y")).where("y IS NOT NULL").cache()
    n = max(rows.count(), 1)
    weights, speed, intercept, pull = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0
    for _ in range(steps):
        error = (1 / (1 + F.exp(-margin(F.col("f"), weights, intercept))) - F.col("y")).alias("e")
        parts = rows.select(error, F.col("f"))
        scaled = (F.col("e") / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))).alias("g")
        by_bucket = parts.select(F.explode(F.concat(F.col("f"), F.array(F.lit(-1)))).alias("b"), scaled, "e").groupBy("b").agg(F.sum("g").alias("g"), F.sum("e").alias("e")).collect()
        gradient, bias = l2 * weights, 0.0
        for b, g, e in by_bucket:  # at most one row per bucket
            if b < 0:
                bias = e / n
            else:
                gradient[b] += g / n
        speed, pull = 0.9 * speed - rate * gradient, 0.9 * pull - rate * 0.1 * bias
        weights, intercept = weights + speed, intercept + pull
    rows.unpersist()
    return weights, intercept


def judge_urls(pages: DataFrame, weights: np.ndarray, intercept: float, rules=RULES, id_col: str = "page_id", url_col: str = "url", sizes: tuple[int, ...] = (3, 4), threshold: float = THRESHOLD) -> DataFrame:
    host, path = host_path(col(url_col))
    rows = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    p = 1 / (1 + F.exp(-margin(ngram_buckets(F.col("host"), F.col("path"), sizes, len(weights)), weights, intercept)))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("*", rule.alias("fit"), p.alias("score")).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), by_model).alias("verdict"), "score")


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int").coalesce(1)


def url_filter(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    weights, intercept = train(labelled_table(pages.sparkSession) if labelled is None else labelled)
    return judge_urls(pages, weights, intercept)


def url_rules(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path and rule alone: what needs no model."""
    host, path = host_path(col(url_col))
    rows = pages.select(col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return rows.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules)["rule"])


_FITS = ", ".join(f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': {len(h) + len(p)}, 'h': {len(h)}, 'rule': '{h}{p}'}} END" for h, p, _ in RULES)
RULES_SQL = rf"""
WITH r AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^(?s:.*?)://((?s:.*))$', 1) AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, list_max(list_filter([{_FITS}], lambda x: x IS NOT NULL)).rule AS rule FROM s
"""
