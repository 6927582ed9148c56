"""Queries over the ``events`` table (and ``documents``, ``pages``, ``labels`` for generic operators),
each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import slicing, stats
from tidemark.functions.slicing import width_of
from tidemark.operators import compact, detect, distort, evidence, integrity, profile, releases, reorder, rules
from tidemark.plans import oracle as O
from tidemark.plans import results, sweeps, verdicts
from tidemark.sources import events as ev
from tidemark.sources import archive, layout, lines, sinks
from tidemark.sources.cases import CaseSource, subset
from tidemark.sources.scratch import cut, scratch_path
from tidemark.streaming import rule, sharded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

START, END = 1_704_672_000_000_000, 1_705_881_600_000_000  # 2024-01-08 and 2024-01-22, UTC
RULES, PID = rules.CATALOGUE, rules.pid_rules()
N = [r.threshold for r in RULES]
TWO = {"structures": ("random", "delete"), "fractions": (0.2,), "seeds": (0, 1)}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def projected(spark, d, which=RULES):
    return rules.project(ev.table_events(spark, d), which)


def _sweep(spark, d, which=RULES, **options):
    return sweeps.ordering_sweep(ev.table_events(spark, d), which, with_alerts=False, **options)


RECORD = ["rule", "fraction", "multiple", "structure", "seed", "rows", "dropped_late", "keys", "keys_lost", "baseline_keys"]
SQL_RECORD = ", ".join(RECORD) + ", round(key_reduction, 6) AS key_reduction"


def record(df):
    return df.select(*RECORD, F.round("key_reduction", 6).alias("key_reduction"))


# --- sources, sinks, integrity


@query("src01_jsonl_scan", f"WITH {O.EV} SELECT action, count(*) AS n, min(t) AS first_t, max(t) AS last_t, count(DISTINCT k) AS ks FROM ev GROUP BY action")
def _(spark, d):
    rows = ev.table_events(spark, d)
    lines = rows.select(F.col("seq").cast("string").alias("id"), "object", "action", "pid", "properties", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"))
    path = scratch_path(spark, "jsonl")
    sinks.write_new(lines, path)
    return ev.read_events(spark, path).groupBy("action").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.countDistinct(F.col("properties")["k"]).alias("ks"))


@query("src02_case_loader", f"WITH {O.EV} SELECT seq, t, pid, pid % 7 = 0 AS marked FROM ev WHERE t >= {START} AND t < {END}")
def _(spark, d):
    return ev.table_events(spark, d).where((F.col("t") >= START) & (F.col("t") < END)).select("seq", "t", "pid", rules.malicious().alias("marked"))


@query("src02_sorted_window", ORACLE["src02_case_loader"])
def _(spark, d):
    """The same window from a log laid out by time, of which it reads the files that it meets."""
    path = scratch_path(spark, "log")
    layout.lay_out(ev.table_events(spark, d).select("seq", "t", "pid"), path)
    return layout.read_window(spark, path, START, END).select("seq", "t", "pid", rules.malicious().alias("marked"))


@query("src03_minimal_window", f"WITH {O.EV} SELECT pid, count(*) AS n FROM ev WHERE t >= {START} AND t < {END} GROUP BY pid")
def _(spark, d):
    return ev.table_events(spark, d).where((F.col("t") >= START) & (F.col("t") < END)).groupBy("pid").agg(F.count("*").alias("n"))


@query("src04_positions", f"WITH {O.EV} SELECT seq, row_number() OVER (ORDER BY t, seq) - 1 AS pos FROM ev")
def _(spark, d):
    return ev.positions(ev.table_events(spark, d).select("seq", "t"), "t", "seq").select("seq", "pos")


@query("src04_line_positions", f"WITH {O.EV} SELECT seq, row_number() OVER (ORDER BY t, seq) - 1 AS pos FROM ev")
def _(spark, d):
    """Positions of lines over the text files of an event log, in the order of their names."""
    path = scratch_path(spark, "lines")
    rows = ev.table_events(spark, d).select("seq", "t").repartitionByRange("t", "seq").sortWithinPartitions("t", "seq")
    rows.select(F.col("seq").cast("string").alias("value")).write.text(path)
    return lines.line_positions(spark, path, across=True).select(F.col("value").cast("long").alias("seq"), "pos")


@query("src05_record_loader", f"WITH {O.EV} SELECT pid, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE action = 'purchase' GROUP BY pid")
def _(spark, d):
    path = scratch_path(spark, "records")
    rows = ev.table_events(spark, d).where("action = 'purchase'").select(F.lit("purchase-v1").alias("schema"), "pid", "value")
    rows.write.json(path)
    schema = T.StructType([T.StructField("schema", T.StringType()), T.StructField("pid", T.LongType()), T.StructField("value", T.DoubleType())])
    return ev.read_records(spark, path, schema, "purchase-v1").groupBy("pid").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src06_label_ids", "SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1")
def _(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    if ids.isEmpty():
        raise ValueError("no labels")
    return ids


@query("src07_projection_cache", f"WITH {O.proj()} SELECT rule, count(*) AS n, count(DISTINCT key) AS keys, CAST(sum(t // 1000000) AS BIGINT) AS checksum FROM proj GROUP BY rule")
def _(spark, d):
    source = CaseSource(spark, lambda case: ev.table_events(spark, d), RULES, scratch_path(spark, "projections"))
    source.fill("events")
    return source.get("events").groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum(F.floor(F.col("t") / 1_000_000)).alias("checksum"))


@query("src08_case_source", f"WITH {O.proj()} SELECT rule, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM proj GROUP BY rule")
def _(spark, d):
    source = CaseSource(spark, lambda case: ev.table_events(spark, d), RULES)
    assert source.get("events") is source.get("events")
    return source.get("events").groupBy("rule").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("flt02_grid_subset", f"WITH {O.proj()} SELECT 'all' AS list, rule, count(*) AS n FROM proj GROUP BY rule UNION ALL SELECT 'two', rule, count(*) FROM proj WHERE rule IN ('mid_cp', 'prop_key') GROUP BY rule")
def _(spark, d):
    rows = projected(spark, d)
    of = lambda name, allowed: subset(rows, "rule", allowed).groupBy(F.lit(name).alias("list"), "rule").agg(F.count("*").alias("n"))
    return of("all", []).union(of("two", ["mid_cp", "prop_key"]))


@query("flt10_integrity_join", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("input_sha256"))
    artefact = cut(docs, "artefact")  # what another step wrote, against what is here
    return integrity.same_facts(docs, artefact, ["doc_id"], ["input_sha256", "source"]).groupBy("source").agg(F.count("*").alias("n"))


@query("int02_hash_and_pins", """WITH p AS (SELECT page_id, sha256(replace(html, chr(13) || chr(10), chr(10))) AS sha FROM pages),
pinned AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN sha256('other') ELSE sha END AS sha FROM p UNION ALL SELECT -1, sha256('gone'))
SELECT CAST(q.page_id AS VARCHAR) AS name, CASE WHEN p.sha IS NULL THEN 'missing' WHEN p.sha = q.sha THEN 'ok' ELSE 'mismatch' END AS status
FROM pinned q LEFT JOIN p USING (page_id)""")
def _(spark, d):
    found = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), integrity.text_hash(F.col("html")).alias("sha256"))
    other, gone = F.sha2(F.lit("other"), 256), F.sha2(F.lit("gone"), 256)
    pinned = found.select("name", F.when(F.col("name").cast("long") % 10 == 3, other).otherwise(F.col("sha256")).alias("sha256"))
    return integrity.verify_pins(found, pinned.union(spark.range(1).select(F.lit("-1"), gone)))


@query("int01_file_hash")
def _(spark, d):
    return integrity.file_hashes(spark, f"{d}/*.parquet").select("size", "sha256")


@query("int03_stored_member", f"WITH {O.EV} SELECT count(*) AS events, count(DISTINCT seq) AS ids FROM ev")
def _(spark, d):
    path = scratch_path(spark, "member")
    ev.table_events(spark, d).select(F.col("seq").cast("string").alias("id"), "action").write.option("compression", "gzip").json(path)
    headers = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path).select("path", F.col("length").alias("size"))
    events = integrity.stored_members(spark, headers, ev.EVENT).agg(F.sum("events").alias("events"))
    return events.join(ev.read_events(spark, path).agg(F.countDistinct("id").alias("ids")))  # one row each


@query("int04_conflicts", "SELECT source, count(DISTINCT lang) AS variants, CASE WHEN count(DISTINCT lang) = 1 THEN 'one' ELSE 'conflict' END AS verdict FROM documents WHERE source LIKE '%1' GROUP BY source")
def _(spark, d):
    return integrity.variants(table(spark, d, "documents").where(F.col("source").endswith("1")), "source", ["lang"])


@query("int05_member_offsets", """WITH m AS (SELECT doc_id, source, octet_length(encode(text)) AS size FROM documents),
o AS (SELECT *, coalesce(sum(512 + CAST(ceil(size / 512.0) AS BIGINT) * 512) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS header FROM m),
n AS (SELECT *, header + 512 + CAST(ceil(size / 512.0) AS BIGINT) * 512 AS next_header FROM o)
SELECT source, count(*) AS members, CAST(max(next_header) AS BIGINT) AS length, count(*) FILTER (WHERE before IS NOT NULL AND before <> header) AS breaks
FROM (SELECT *, lag(next_header) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM n) GROUP BY source""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.octet_length("text").alias("size"))
    rows = rows.withColumn("step", integrity.next_offset(F.lit(0), F.col("size")).cast("long"))
    width = slicing.width_of(rows, ["source"], "doc_id")
    rows = slicing.running(rows, ["source"], ["doc_id"], "doc_id", F.sum, "step", "header", width).withColumn("header", F.coalesce("header", F.lit(0)))
    rows = rows.withColumn("next_header", integrity.next_offset(F.col("header"), F.col("size")).cast("long"))
    rows = slicing.previous(rows, ["source"], ["doc_id"], "doc_id", "next_header", "before", width)
    return rows.groupBy("source").agg(F.count("*").alias("members"), F.max("next_header").alias("length"), F.count_if(F.col("before") != F.col("header")).alias("breaks"))


@query("int05_archive_index", ORACLE["int05_member_offsets"])
def _(spark, d):
    """The same offsets from the headers of archives: one for each source, its documents as members."""
    path = scratch_path(spark, "archives")
    rows = table(spark, d, "documents").select(F.col("source").alias("archive"), F.col("doc_id").alias("place"), F.col("doc_id").cast("string").alias("name"), F.col("text").cast("binary").alias("data"))
    cut(archive.write_archives(rows, path), "written")
    index = cut(archive.archive_index(spark, f"{path}/*.tar"), "index").withColumn("source", F.regexp_extract("archive", r"([^/]+)\.tar$", 1))
    index = slicing.previous(index, ["source"], ["header_offset"], "header_offset", "next_offset", "before")
    return index.groupBy("source").agg(F.count("*").alias("members"), F.max("next_offset").alias("length"), F.count_if(F.col("before") != F.col("header_offset")).alias("breaks"))


# --- projections, filters, checks


@query("flt01_rule_projection", f"WITH {O.proj()} SELECT rule, seq, t, key, pid FROM proj")
def _(spark, d):
    return projected(spark, d).select("rule", "seq", "t", "key", "pid")


@query("flt03_pid_rules", f"WITH {O.proj(PID)} SELECT rule, count(*) AS n FROM proj GROUP BY rule")
def _(spark, d):
    return projected(spark, d, PID).groupBy("rule").agg(F.count("*").alias("n"))


@query("flt04_time_window", f"WITH {O.EV} SELECT action, count(*) AS n FROM ev WHERE t >= {START} AND t < {END} GROUP BY action")
def _(spark, d):
    return ev.table_events(spark, d).where((F.col("t") >= START) & (F.col("t") < END)).groupBy("action").agg(F.count("*").alias("n"))


@query("flt05_window_positions", f"""WITH {O.EV}, p AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS pos, t, lag(t) OVER (ORDER BY seq) AS before FROM ev)
SELECT count(*) AS events, count(*) FILTER (t >= {START} AND t < {END}) AS in_window, count(*) FILTER (t < before) AS order_violations,
       min(pos) FILTER (t >= {START} AND t < {END}) AS selection_start, max(pos) FILTER (t >= {START} AND t < {END}) + 1 AS selection_end FROM p""")
def _(spark, d):
    rows = ev.positions(ev.table_events(spark, d).select("seq", "t"), "seq")
    after = rows.select((F.col("pos") + 1).alias("pos"), F.col("t").alias("before"))
    return evidence.window_positions(rows.join(after, "pos", "left"), START, END)


@query("flt06_monotonic", f"WITH {O.EV}, l AS (SELECT pid, t >= lag(t) OVER (PARTITION BY pid ORDER BY seq) AS ok FROM ev) SELECT pid, coalesce(bool_and(ok), true) AS ordered FROM l GROUP BY pid")
def _(spark, d):
    rows = ev.table_events(spark, d).select(F.col("pid").alias("run"), F.col("seq").alias("arr"), "seq", F.col("t").alias("occ"))
    return reorder.in_order(rows).withColumnRenamed("run", "pid")


RECORD_JSON = """'{"id":' || event_id || ',"who":{"user":' || user_id || ',"type":"' || event_type || '"},"props":' || props
|| CASE WHEN event_type = 'purchase' THEN ',"tags":["a",{"b":' || event_id || '},null]' WHEN event_type = 'error' THEN ',"tags":true' ELSE '' END || '}'"""


@query("flt07_json_paths", f"""WITH j AS (SELECT event_id, {RECORD_JSON} AS j FROM events),
v AS (SELECT event_id, regexp_replace(t.fullkey, '\\[\\d+\\]', '[*]', 'g') AS path, t.type FROM j, json_tree(j.j) t),
k AS (SELECT event_id, path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind FROM v),
e AS (SELECT path, count(DISTINCT event_id) = (SELECT count(*) FROM j) AS in_every_row FROM k GROUP BY path)
SELECT path, kind, count(*) AS n, count(DISTINCT event_id) AS in_rows, any_value(in_every_row) AS in_every_row FROM k JOIN e USING (path) GROUP BY path, kind""")
def _(spark, d):
    return profile.profile(table(spark, d, "events").select(F.expr(RECORD_JSON).alias("record")), "record")


@query("flt07_schema_profile", """WITH e AS (SELECT event_id, props, CAST(ts AS VARCHAR) AS ts FROM events), o AS (SELECT *, lag(ts) OVER (ORDER BY event_id) AS before FROM e)
SELECT 'key' AS what, 'props.k' AS name, count(json_extract_string(props, '$.k')) AS n FROM e
UNION ALL SELECT 'digits', CAST(length(regexp_extract(ts, '\\.(\\d+)', 1)) AS VARCHAR), count(*) FROM e GROUP BY 2
UNION ALL SELECT 'disorder', 'string', count(*) FILTER (ts < before) FROM o
UNION ALL SELECT 'time-like', column_name, 1 FROM (DESCRIBE SELECT * FROM events) WHERE lower(column_name) = 'ts' OR regexp_matches(lower(column_name), 'time|stamp|date')""")
def _(spark, d):
    raw = table(spark, d, "events").withColumn("ts", F.col("ts").cast("string"))
    props = raw.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("name"))
    keys = props.groupBy(F.concat(F.lit("props."), "name").alias("name")).agg(F.count("*").alias("n")).select(F.lit("key").alias("what"), "name", "n")
    digits = raw.groupBy(F.length(F.regexp_extract("ts", r"\.(\d+)", 1)).cast("string").alias("name")).agg(F.count("*").alias("n")).select(F.lit("digits").alias("what"), "name", "n")
    rows = ev.positions(raw.select("event_id", "ts"), "event_id")
    pairs = rows.join(rows.select((F.col("pos") + 1).alias("pos"), F.col("ts").alias("before")), "pos")
    disorder = pairs.agg(F.count_if(F.col("ts") < F.col("before")).alias("n")).select(F.lit("disorder").alias("what"), F.lit("string").alias("name"), "n")
    hints = [c for c in raw.columns if c.lower() == "ts" or any(h in c.lower() for h in ("time", "stamp", "date"))]
    timed = spark.createDataFrame([("time-like", c, 1) for c in hints], "what string, name string, n bigint")
    return keys.union(digits).union(disorder).union(timed)


@query("flt08_record_checks", """SELECT 'known_type' AS rule, count(*) FILTER (NOT coalesce(event_type IN ('signup', 'error', 'click', 'view'), false)) AS n FROM events
UNION ALL SELECT 'positive', count(*) FILTER (NOT coalesce(value > 1, false)) FROM events
UNION ALL SELECT 'user', count(*) FILTER (user_id IS NULL) FROM events""")
def _(spark, d):
    return integrity.violations(table(spark, d, "events"), {"known_type": F.col("event_type").isin("signup", "error", "click", "view"), "positive": F.col("value") > 1, "user": F.col("user_id").isNotNull()})


@query("flt09_mask_validation", f"WITH {O.EV}, m AS (SELECT pid, list(seq ORDER BY CASE WHEN pid % 3 = 0 THEN -t ELSE t END) AS p FROM ev GROUP BY pid) SELECT pid FROM m WHERE p <> list_sort(list_distinct(p)) OR len(list_filter(p, lambda x: x < 0 OR x >= 5000)) > 0")
def _(spark, d):
    place = F.when(F.col("pid") % 3 == 0, -F.col("t")).otherwise(F.col("t"))
    masks = ev.table_events(spark, d).select(F.col("pid").alias("run"), place.alias("place"), F.col("seq").alias("pos"))
    return evidence.validate_mask(masks, 0, 5000).select(F.col("run").alias("pid"))


# --- joins and sets


@query("jon01_membership", f"WITH {O.EV} SELECT pid, count(*) AS n FROM ev WHERE pid IN (SELECT pid FROM ev WHERE pid % 7 = 0 AND action = 'error') GROUP BY pid")
def _(spark, d):
    rows = ev.table_events(spark, d)
    marked = rows.where(rules.malicious() & (F.col("action") == "error")).select("pid").distinct()
    return rows.join(marked, "pid", "left_semi").groupBy("pid").agg(F.count("*").alias("n"))


LABELLED_SQL = f"""{O.EV}, p AS (SELECT *, row_number() OVER (ORDER BY t, seq) - 1 AS pos FROM ev),
lab AS (SELECT pos, t, pid, action = 'signup' AS is_create FROM p WHERE pid % 7 = 0 AND action IN ('error', 'signup'))"""


def _positions(spark, d):
    return ev.positions(ev.table_events(spark, d).select("seq", "t", "pid", "action"), "t", "seq")


def _labelled(rows):
    return rows.where(rules.malicious() & F.col("action").isin("error", "signup")).select("pos", "t", "pid", (F.col("action") == "signup").alias("is_create"))


@query("jon02_label_events", f"WITH {LABELLED_SQL} SELECT pos, pid, is_create, pos >= 2000 AND pos < 8000 AS in_selection FROM lab")
def _(spark, d):
    rows = _positions(spark, d)
    ids = rows.where(rules.malicious() & F.col("action").isin("error", "signup")).select("seq").distinct()
    out = rows.join(ids, "seq")
    return out.select("pos", "pid", (F.col("action") == "signup").alias("is_create"), F.col("pos").between(2000, 7999).alias("in_selection"))


RATES, PATTERNS, MASK_SEEDS = ["0.01", "0.10", "0.29"], ("random", "contiguous"), [0, 1, 2]


def _mask_sql() -> str:
    rows = [(r, p, s) for r in RATES for p in PATTERNS for s in MASK_SEEDS]
    return f"""{LABELLED_SQL}, size AS (SELECT count(*) AS n FROM p),
m AS (SELECT rate, pattern, seed, n, CAST(floor(n * CAST(rate AS DECIMAL(9, 4))) AS BIGINT) AS k FROM {O.values(rows)} v(rate, pattern, seed), size),
gone AS (SELECT rate, pattern, seed, pos FROM (SELECT m.*, pos, row_number() OVER (PARTITION BY rate, pattern, seed ORDER BY md5('mask:' || seed || ':' || pos), pos) AS rk FROM m, p WHERE pattern = 'random') WHERE rk <= k
         UNION ALL SELECT rate, pattern, seed, s + i FROM (SELECT *, ('0x' || substr(md5('mask:' || seed || ':start'), 1, 8))::BIGINT % (n - k + 1) AS s, unnest(range(0, k)) AS i FROM m WHERE pattern = 'contiguous'))"""


def _masks(spark, d):
    rows = _positions(spark, d)
    mask = evidence.masks(spark, rows.count(), RATES, MASK_SEEDS)
    return rows, mask, evidence.deleted(rows, mask)


def _by_mask(df, mask):
    return df.join(F.broadcast(mask.select("run", "rate", "pattern", "seed")), "run").drop("run")


@query("dst12_mask_random", f"WITH {_mask_sql()} SELECT rate, seed, count(*) AS k, CAST(sum(pos) AS BIGINT) AS checksum, min(pos) AS lo, max(pos) AS hi FROM gone WHERE pattern = 'random' GROUP BY rate, seed")
def _(spark, d):
    _, mask, gone = _masks(spark, d)
    return _by_mask(gone, mask).where("pattern = 'random'").groupBy("rate", "seed").agg(F.count("*").alias("k"), F.sum("pos").alias("checksum"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query("dst13_mask_contiguous", f"WITH {_mask_sql()} SELECT rate, seed, count(*) AS k, min(pos) AS lo, max(pos) AS hi FROM gone WHERE pattern = 'contiguous' GROUP BY rate, seed")
def _(spark, d):
    _, mask, gone = _masks(spark, d)
    return _by_mask(gone, mask).where("pattern = 'contiguous'").groupBy("rate", "seed").agg(F.count("*").alias("k"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))


@query("jon03_mask_application", f"WITH {_mask_sql()} SELECT pos, seq, t FROM p WHERE pos NOT IN (SELECT pos FROM gone WHERE rate = '0.10' AND pattern = 'random' AND seed = 1)")
def _(spark, d):
    rows, mask, gone = _masks(spark, d)
    return evidence.apply_mask(rows, _by_mask(gone, mask).where("rate = '0.10' AND pattern = 'random' AND seed = 1")).select("pos", "seq", "t")


MEASURE_SQL = f"""{_mask_sql()},
h AS (SELECT m.rate, m.pattern, m.seed, l.pos, l.pid, l.is_create, g.pos IS NOT NULL AS gone FROM m CROSS JOIN lab l
      LEFT JOIN gone g ON g.rate = m.rate AND g.pattern = m.pattern AND g.seed = m.seed AND g.pos = l.pos),
b AS (SELECT rate, pattern, seed, pid, count(*) AS n, count(*) FILTER (gone) AS d, count(*) FILTER (is_create) AS c, count(*) FILTER (is_create AND gone) AS cd FROM h GROUP BY ALL),
measured AS (SELECT rate, pattern, seed, CAST(sum(n) AS BIGINT) AS events, CAST(sum(d) AS BIGINT) AS events_deleted, count(pid) AS processes, count(pid) FILTER (n = d) AS silenced,
       CAST(sum(c) AS BIGINT) AS creates, CAST(sum(cd) AS BIGINT) AS creates_deleted, sum(d) / sum(n) AS event_rate,
       count(pid) FILTER (n = d) / CAST(nullif(count(pid), 0) AS DOUBLE) AS silenced_rate, sum(cd) / nullif(sum(c), 0) AS create_rate FROM b GROUP BY ALL)"""


def _measured(spark, d):
    rows, mask, gone = _masks(spark, d)
    return _by_mask(evidence.measure(_labelled(rows), gone, mask), mask)


@query("agg16_evidence_measure", f"WITH {MEASURE_SQL} SELECT rate, pattern, seed, events, events_deleted, processes, silenced, creates, creates_deleted, round(event_rate, 6) AS event_rate, round(silenced_rate, 6) AS silenced_rate, round(create_rate, 6) AS create_rate FROM measured")
def _(spark, d):
    rates = [F.round(c, 6).alias(c) for c in ("event_rate", "silenced_rate", "create_rate")]
    return _measured(spark, d).select("rate", "pattern", "seed", "events", "events_deleted", "processes", "silenced", "creates", "creates_deleted", *rates)


@query("swp07_evidence_sweep", f"WITH {MEASURE_SQL} SELECT rate, pattern, count(*) AS runs, round(avg(event_rate), 6) AS mean_rate, round(max(event_rate), 6) AS worst FROM measured GROUP BY rate, pattern")
def _(spark, d):
    return _measured(spark, d).groupBy("rate", "pattern").agg(F.count("*").alias("runs"), F.round(F.avg("event_rate"), 6).alias("mean_rate"), F.round(F.max("event_rate"), 6).alias("worst"))


@query("agg17_evidence_aggregate", f"""WITH {MEASURE_SQL}, s AS (SELECT rate, pattern, avg(event_rate) AS mean, coalesce(stddev_samp(event_rate), 0) AS sd FROM measured GROUP BY ALL)
SELECT r.rate, round(c.sd - r.sd, 6) AS ev, round(c.mean - r.mean, 6) AS mean_difference, round(CASE WHEN r.sd > 0 THEN c.sd / r.sd END, 6) AS sd_ratio
FROM s r JOIN s c ON r.rate = c.rate AND r.pattern = 'random' AND c.pattern = 'contiguous'""")
def _(spark, d):
    s = _measured(spark, d).groupBy("rate").pivot("pattern", ["random", "contiguous"]).agg(F.avg("event_rate").alias("mean"), F.coalesce(F.stddev_samp("event_rate"), F.lit(0.0)).alias("sd"))
    return s.select("rate", F.round(F.col("contiguous_sd") - F.col("random_sd"), 6).alias("ev"), F.round(F.col("contiguous_mean") - F.col("random_mean"), 6).alias("mean_difference"), F.round(F.when(F.col("random_sd") > 0, F.col("contiguous_sd") / F.col("random_sd")), 6).alias("sd_ratio"))


@query("agg17_evidence_overall", f"""WITH {MEASURE_SQL}, s AS (SELECT rate, pattern, avg(event_rate) AS mean, coalesce(stddev_samp(event_rate), 0) AS sd FROM measured GROUP BY ALL)
SELECT count(*) AS cases, round(avg(c.sd - r.sd), 6) AS mean_ev, coalesce(bool_and(c.sd - r.sd > 0), false) AS all_positive
FROM s r JOIN s c ON r.rate = c.rate AND r.pattern = 'random' AND c.pattern = 'contiguous' WHERE r.rate = '0.10'""")
def _(spark, d):
    s = _measured(spark, d).where("rate = '0.10'").groupBy("rate").pivot("pattern", ["random", "contiguous"]).agg(F.coalesce(F.stddev_samp("event_rate"), F.lit(0.0)))
    ev_ = F.col("contiguous") - F.col("random")
    return s.agg(F.count("*").alias("cases"), F.round(F.avg(ev_), 6).alias("mean_ev"), F.coalesce(F.bool_and(ev_ > 0), F.lit(False)).alias("all_positive"))


@query("agg18_mask_overlap", f"""WITH {_mask_sql()}, w AS (SELECT count(*) FILTER (t >= {START} AND t < {END}) AS window_events FROM p)
SELECT rate, pattern, seed, min(t) AS first_t, max(t) AS last_t, round((max(t) - min(t)) / 1e6, 3) AS span_seconds, count(*) FILTER (t >= {START} AND t < {END}) AS inside,
       round(count(*) FILTER (t >= {START} AND t < {END}) / CAST(any_value(window_events) AS DOUBLE), 6) AS fraction FROM gone JOIN p USING (pos), w GROUP BY ALL""")
def _(spark, d):
    rows, mask, gone = _masks(spark, d)
    out = evidence.overlap(rows.select("pos", "t"), gone, START, END)
    return _by_mask(out, mask).select("rate", "pattern", "seed", "first_t", "last_t", F.round("span_seconds", 3).alias("span_seconds"), "inside", F.round("fraction", 6).alias("fraction"))


@query("agg19_node_scores", """WITH s AS (SELECT doc_id AS node, n_chars / 5000.0 AS score FROM documents), l AS (SELECT DISTINCT doc_id AS node FROM labels WHERE quality = 1)
SELECT labelled, detected, absent, alerted, round(detected / CAST(nullif(alerted, 0) AS DOUBLE), 6) AS precision, round(detected / CAST(labelled AS DOUBLE), 6) AS recall FROM
(SELECT count(*) AS labelled, count(*) FILTER (score > 0.5) AS detected, count(*) FILTER (score IS NULL) AS absent FROM l LEFT JOIN s USING (node)), (SELECT count(*) FILTER (score > 0.5) AS alerted FROM s)""")
def _(spark, d):
    scores = table(spark, d, "documents").select(F.col("doc_id").alias("node"), (F.col("n_chars") / 5000.0).alias("score"))
    out = evidence.score_nodes(scores, table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("node")), 0.5)
    return out.select("labelled", "detected", "absent", "alerted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("jon08_label_overlap", "SELECT l.doc_id AS node, d.n_chars IS NULL AS absent, coalesce(d.n_chars > 2500, false) AS alerted FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l LEFT JOIN documents d USING (doc_id)")
def _(spark, d):
    scored = table(spark, d, "documents").select("doc_id", "n_chars")
    labels = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return labels.join(scored, "doc_id", "left").select(F.col("doc_id").alias("node"), F.col("n_chars").isNull().alias("absent"), F.coalesce(F.col("n_chars") > 2500, F.lit(False)).alias("alerted"))


RUNS_SQL = f'''{MEASURE_SQL}, runs AS (
SELECT 'one' AS "case", rate AS requested_rate, pattern, seed, processes - silenced AS detected, processes AS total, (processes - silenced) / CAST(processes AS DOUBLE) AS recall,
       (processes - silenced) > 0 AS case_detected FROM measured),
base AS (SELECT 'one' AS "case", count(DISTINCT pid) / CAST(count(DISTINCT pid) AS DOUBLE) AS baseline_recall, count(DISTINCT pid) > 0 AS baseline_detected FROM lab),
arms AS (SELECT r."case", requested_rate, pattern, count(*) AS seeds, count(*) FILTER (case_detected) AS detected_runs, avg(CAST(case_detected AS DOUBLE)) AS R, avg(recall) AS RC, min(recall) AS RC_min,
         max(recall) AS RC_max, max(recall) - min(recall) AS RC_range, coalesce(stddev_samp(recall), 0) AS RC_stdev, count(*) FILTER (recall < 0.5 * baseline_recall) AS severe_seeds,
         avg(CASE WHEN recall < 0.5 * baseline_recall THEN CAST(1 AS DOUBLE) ELSE 0 END) AS severe_seed_fraction FROM runs r JOIN base USING ("case") GROUP BY ALL),
effects AS (SELECT a."case", a.requested_rate, baseline_detected, baseline_recall, a.R AS random_R, b.R AS contiguous_R, b.RC_stdev - a.RC_stdev AS EV, b.RC_stdev / nullif(a.RC_stdev, 0) AS EV_ratio,
            b.severe_seed_fraction - a.severe_seed_fraction AS E_severe, 1 - a.R AS L_random, 1 - b.R AS L_contiguous, a.R - b.R AS E, baseline_recall - a.RC AS LC_random, baseline_recall - b.RC AS LC_contiguous, a.RC - b.RC AS EC
            FROM arms a JOIN arms b ON a.requested_rate = b.requested_rate AND a.pattern = 'random' AND b.pattern = 'contiguous' JOIN base ON base."case" = a."case")'''
ARM = ["R", "RC", "RC_min", "RC_max", "RC_range", "RC_stdev", "severe_seed_fraction"]


def _run_records(spark, d):
    """A run record per mask, and the baseline's: a process is a labelled node, detected while any of its events is left."""
    measured = cut(_measured(spark, d), "measured")
    base = measured.limit(1).select(F.lit("0").alias("rate"), F.lit("baseline").alias("pattern"), F.lit(None).cast("int").alias("seed"), "processes", F.lit(0).cast("long").alias("silenced"))
    rows = measured.select("rate", "pattern", "seed", "processes", "silenced").union(base)
    detected = F.col("processes") - F.col("silenced")
    fixed = {"host": F.lit("h"), "input_sha256": F.lit("-"), "detector_commit": F.lit("-"), "checkpoint_sha256": F.lit("-"), "started_at_utc": F.lit("-"), "finished_at_utc": F.lit("-"), "exit_status": F.lit("completed"), "case": F.lit("one"), "requested_rate": F.col("rate")}
    made = {"run_id": F.concat_ws("/", "rate", "pattern", "seed"), "mask_sha256": F.when(F.col("seed").isNotNull(), F.lit("-")), "selection_start": F.lit(0).cast("long"), "selection_end": F.lit(1).cast("long"), "deleted_count": F.lit(0).cast("long"), "threshold": F.lit(0.5), "case_detected": detected > 0, "detected_label_nodes": detected, "total_label_nodes": F.col("processes")}
    return results.checked(rows.withColumns(fixed | made).withColumn("seed", F.col("seed").cast("long")).select(*results.FIELDS))


@query("agg20_recall_arms", f'WITH {RUNS_SQL} SELECT "case", requested_rate, pattern, seeds, detected_runs, severe_seeds, {", ".join(f"round({c}, 6) AS {c}" for c in ARM)} FROM arms')
def _(spark, d):
    return results.arms(_run_records(spark, d)).select("case", "requested_rate", "pattern", "seeds", "detected_runs", "severe_seeds", *[F.round(c, 6).alias(c) for c in ARM])


@query("agg21_effect_rows", f'WITH {RUNS_SQL} SELECT "case", requested_rate, baseline_detected, {", ".join(f"round({c}, 6) AS {c}" for c in results.EFFECTS)}, CAST(NULL AS VARCHAR) AS excluded_reason FROM effects')
def _(spark, d):
    return results.effects(_run_records(spark, d)).select("case", "requested_rate", "baseline_detected", *[F.round(c, 6).alias(c) for c in results.EFFECTS], "excluded_reason")


@query("agg22_overall", f"WITH {RUNS_SQL} SELECT count(*) AS evaluable_cases, round(avg(E), 6) AS mean_E, round(avg(EC), 6) AS mean_EC, round(avg(EV), 6) AS mean_EV, round(avg(E_severe), 6) AS mean_E_severe, coalesce(bool_and(random_R = 1 AND contiguous_R = 1), false) AS saturated, CASE WHEN coalesce(bool_and(random_R = 1 AND contiguous_R = 1), false) THEN 'frozen_label_node_recall' ELSE 'case_detection_rate' END AS metric FROM effects WHERE requested_rate = '0.10'")
def _(spark, d):
    return results.overall(_run_records(spark, d)).select("evaluable_cases", *[F.round(f"mean_{c}", 6).alias(f"mean_{c}") for c in ("E", "EC", "EV", "E_severe")], "saturated", "metric")


@query("flt08_run_records", f"WITH {RUNS_SQL} SELECT count(*) + 1 AS records, 0 AS broken FROM runs")
def _(spark, d):
    records = _run_records(spark, d)
    broken = integrity.violations(records, results.rules()).agg(F.sum("n").cast("int").alias("broken"))
    return records.agg(F.count("*").alias("records")).join(F.broadcast(broken))  # one row each


# --- streams


@query("str05_detected_subjects", f"WITH {O.base()} SELECT rule, key, first_t FROM known")
def _(spark, d):
    rows = sweeps.plain(projected(spark, d), RULES)
    return sweeps.named(detect.subjects(rows, N), RULES).select("rule", "key", "first_t")


def _marked(spark, d, allowed=0, which=RULES, **options):
    _, stream, rows = sweeps.distorted(ev.table_events(spark, d), which, **options)
    return detect.mark_late(rows, allowed, width=sweeps.Sizes.of(stream).width)


@query("str01_late_drop", f"WITH {O.marked(**TWO)} SELECT rule, multiple, structure, seed, count(*) AS rows, count(*) FILTER (late) AS dropped_late FROM marked GROUP BY ALL")
def _(spark, d):
    return _marked(spark, d, **TWO).groupBy("rule", "multiple", "structure", "seed").agg(F.count("*").alias("rows"), F.count_if("late").alias("dropped_late"))


@query("str02_allowed_lateness", f"WITH {O.marked(**TWO)}, l AS (SELECT *, coalesce(occ < max(occ) OVER (PARTITION BY {O.RUN} ORDER BY arr, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - w - 43200000000, false) AS very_late FROM seen) SELECT rule, multiple, structure, seed, count(*) FILTER (very_late) AS dropped_late FROM l GROUP BY ALL")
def _(spark, d):
    return _marked(spark, d, 43_200_000_000, **TWO).groupBy("rule", "multiple", "structure", "seed").agg(F.count_if("late").alias("dropped_late"))


@query("str03_alerts_in_order", f"WITH RECURSIVE {O.base()}, {O.greedy('proj', 'rule')} SELECT rule, count(*) AS alerts, count(DISTINCT key) AS keys FROM picks GROUP BY rule")
def _(spark, d):
    rows = sweeps.plain(projected(spark, d), RULES)
    return sweeps.named(detect.alerts_in_order(rows, N), RULES).groupBy("rule").agg(F.count("*").alias("alerts"), F.countDistinct("key").alias("keys"))


@query("str03_alert_rows", f"""WITH RECURSIVE {O.base()}, {O.greedy('proj', 'rule')},
numbered AS (SELECT *, row_number() OVER (PARTITION BY rule, key ORDER BY t, seq) AS rn FROM proj)
SELECT p.rule, p.key, b.t AS fired_at, CAST(b.n AS INTEGER) AS count, a.t AS window_start, b.t AS window_end
FROM picks p JOIN numbered b ON b.rule = p.rule AND b.key = p.key AND b.rn = p.rn JOIN numbered a ON a.rule = p.rule AND a.key = p.key AND a.rn = p.rn - b.n + 1""")
def _(spark, d):
    rows = sweeps.plain(projected(spark, d), RULES)
    return sweeps.named(detect.alerts_in_order(rows, N), RULES).select("rule", "key", "fired_at", "count", "window_start", "window_end")


ONE_RUN = {"structures": ("random",), "fractions": (0.2,), "seeds": (0,)}


@query("str04_alerts_out_of_order", f"WITH RECURSIVE {O.alert_sweep(**ONE_RUN)} SELECT rule, multiple, count(*) AS alerts, count(DISTINCT key) AS keys FROM fired WHERE structure <> 'base' GROUP BY rule, multiple")
def _(spark, d):
    rows = cut(_marked(spark, d, **ONE_RUN).where("NOT late"), "kept")
    found = detect.alerts(rows)
    return found.join(F.broadcast(rows.select("run", "rule", "multiple").distinct()), "run").groupBy("rule", "multiple").agg(F.count("*").alias("alerts"), F.countDistinct("key").alias("keys"))


def _in_parts(rows, parts):
    """``rows`` in parts by time of arrival, as they would come."""
    lo, hi = rows.agg(F.min("arr"), F.max("arr")).first()
    width = 1 if lo is None else (hi - lo) // parts + 1
    return [rows.where(F.floor((F.col("arr") - (lo or 0)) / width) == k) for k in range(parts)]


def _drained(stream, out):
    """What a stream has to say about all that is there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


@query("str11_stream_alerts", ORACLE["str04_alerts_out_of_order"])
def _(spark, d):
    """The same alerts as from the table, from a stream that comes in three parts, each a micro-batch."""
    runs, rows = sweeps.moving(ev.table_events(spark, d), RULES, **ONE_RUN)
    rows = compact.each_run(rows, runs).select(F.col("run").alias("stream"), "key", "arr", "seq", F.col("t").alias("occ"), "w", "n")
    path = scratch_path(spark, "stream")
    for part in _in_parts(rows, 3):
        part.write.mode("append").parquet(f"{path}/in")
        sharded.mark_stream(spark.readStream.schema(sharded.ROWS).parquet(f"{path}/in"), path, f"{path}/checkpoint").awaitTermination()
    with rule.state_store(spark):
        _drained(sharded.held_alerts(sharded.marked_rows(spark, path)), f"{path}/alerts")
    found = spark.read.parquet(f"{path}/alerts").withColumnRenamed("stream", "run")
    return found.join(F.broadcast(runs.select("run", "rule", "multiple")), "run").groupBy("rule", "multiple").agg(F.count("*").alias("alerts"), F.countDistinct("key").alias("keys"))


SIZES = (0.0, 0.5, 2.0)
BUFFERED = {"fractions": (0.2,), "seeds": (0,)}
BUFFER_SQL = O.buffers(SIZES, PID, **BUFFERED)


def _behind(spark, d):
    """The distorted rows as they arrive, runs and sizes of buffers by rule, and what each (run, size) is."""
    runs, rows = sweeps.moving(ev.table_events(spark, d), PID, structures=("random",), **BUFFERED)
    sizes = {r.name: [int(b * r.window) for b in SIZES] for r in PID}
    own, cells = {r.name: [] for r in PID}, []
    for r in runs.collect():  # the caller's list
        own[r.rule].append(r.run)
        cells += [(r.run, k, r.rule, r.multiple, b, sizes[r.rule][k]) for k, b in enumerate(SIZES)]
    return rows, own, sizes, F.broadcast(spark.createDataFrame(cells, "run int, size int, rule string, multiple double, b double, buffer bigint"))


def _buffered(spark, d):
    rows, runs, sizes, cells = _behind(spark, d)
    return releases.released(releases.arrived(rows), runs, sizes, width_of(rows, ["rule"], "t")), cells


@query("str06_reorder_buffer", f"WITH {BUFFER_SQL} SELECT rule, multiple, buffer_windows AS b, seq, released FROM rel")
def _(spark, d):
    out, cells = _buffered(spark, d)
    return out.join(cells, ["run", "size"]).select("rule", "multiple", "b", "seq", "released")


CHECKSUM = "(seq * 1000003 + coalesce(released, 0)) % 2147483647"


@query("str06_buffer_checksums", f"""WITH {BUFFER_SQL} SELECT rule, multiple, buffer_windows AS b, count(*) AS n, count(*) FILTER (released IS NULL) AS flushed,
CAST(sum(released - arr) AS BIGINT) AS held, CAST(sum({CHECKSUM}) AS BIGINT) AS checksum FROM rel GROUP BY ALL""")
def _(spark, d):
    """What ``str06_reorder_buffer`` lists, summed: rows, those the end releases, microseconds that the
    buffer held rows back, and a checksum over (seq, released)."""
    return _checksums(*_buffered(spark, d))


def _checksums(released, cells):
    sums = [F.count("*").alias("n"), F.count_if(F.col("released").isNull()).alias("flushed"), F.sum(F.col("released") - F.col("arr")).alias("held"), F.sum(F.expr(CHECKSUM)).alias("checksum")]
    return released.groupBy("run", "size").agg(*sums).join(cells, ["run", "size"]).select("rule", "multiple", "b", "n", "flushed", "held", "checksum")


@query("str06_stream_buffer", ORACLE["str06_buffer_checksums"])
def _(spark, d):
    """The same releases from a stream that comes in three parts; what it still holds at the end, the end releases."""
    rows, runs, sizes, cells = _behind(spark, d)
    path = scratch_path(spark, "buffer")
    parts = _in_parts(releases.arrived(rows), 3)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        sharded.buffer_stream(spark.readStream.schema(releases.ARRIVED).parquet(f"{path}/in"), runs, sizes, path, f"{path}/checkpoint").awaitTermination()
    return _checksums(sharded.buffer_releases(spark, path), cells)


WAITS = {"median": 0.5, "p90": 0.9, "p99": 0.99}


@query("str07_buffer_waits", f"""WITH {BUFFER_SQL}, x AS (SELECT rule, multiple, buffer_windows AS b, released - occ - buffer AS wait FROM rel),
q AS (SELECT *, row_number() OVER (PARTITION BY rule, multiple, b ORDER BY wait) AS i, count(*) OVER (PARTITION BY rule, multiple, b) AS n FROM x WHERE wait IS NOT NULL),
f AS (SELECT rule, multiple, b, count(*) FILTER (wait IS NULL) AS flushed FROM x GROUP BY ALL)
SELECT rule, multiple, b, any_value(n) AS n, any_value(flushed) AS flushed, min(wait) AS least, {", ".join(f"max(wait) FILTER (i = floor({v} * (n - 1)) + 1) AS {k}" for k, v in WAITS.items())}, max(wait) AS most FROM q JOIN f USING (rule, multiple, b) GROUP BY ALL""")
def _(spark, d):
    found, cells = _buffered(spark, d)
    after = found.groupBy("run", "size", (F.col("released") - F.col("t")).alias("after")).agg(F.count("*").alias("rows"))  # equal waits are many
    rows = cut(after.join(cells, ["run", "size"]).select("rule", "multiple", "b", (F.col("after") - F.col("buffer")).alias("wait"), "rows"), "waits")
    out = stats.index_quantiles(rows, ["rule", "multiple", "b"], "wait", WAITS, count=F.sum("rows"))
    return out.join(rows.groupBy("rule", "multiple", "b").agg(F.coalesce(F.sum(F.when(F.col("wait").isNull(), F.col("rows"))), F.lit(0)).alias("flushed")), ["rule", "multiple", "b"]).select("rule", "multiple", "b", "n", "flushed", "least", *WAITS, "most")


@query("str08_run_summary", f"WITH RECURSIVE {O.alert_sweep(clock='M2', **TWO)} SELECT rule, multiple, structure, seed, rows AS accepted, dropped_late, keys, alerts FROM records")
def _(spark, d):
    out = sweeps.ordering_sweep(ev.table_events(spark, d), RULES, clock="M2", **TWO)
    return out.select("rule", "multiple", "structure", "seed", F.col("rows").alias("accepted"), "dropped_late", "keys", "alerts")


@query("str09_malicious_subjects", f"WITH {O.base(PID)} SELECT rule, key, first_t FROM known WHERE CAST(key AS BIGINT) % 7 = 0")
def _(spark, d):
    rows = sweeps.plain(projected(spark, d, PID).where(rules.malicious()), PID)
    return sweeps.named(detect.subjects(rows, N), PID).select("rule", "key", "first_t")


# --- distortion


@query("dst01_exact_choice", f"WITH {O.chosen(structures=('random', 'targeted'), multiples=(1.0,))} SELECT rule, fraction, structure, seed, count(*) AS n, count(*) FILTER (chosen) AS k, CAST(sum(seq) FILTER (chosen) AS BIGINT) AS checksum FROM chosen GROUP BY ALL")
def _(spark, d):
    runs = distort.grid(spark, RULES, sweeps.FRACTIONS, (1.0,), sweeps.SEEDS, ("random", "targeted"))
    rows = distort.chosen(distort.draws(projected(spark, d), runs), runs)
    return rows.groupBy("rule", "fraction", "structure", "seed").agg(F.count("*").alias("n"), F.count_if("chosen").alias("k"), F.sum(F.when(F.col("chosen"), F.col("seq"))).alias("checksum"))


def _arrivals(name, clock, structures, out):
    options = {"structures": structures, "fractions": (0.2,), "seeds": (0,), "multiples": (1.0,)}

    @query(name, f"WITH {O.marked(PID, clock=clock, **options)} SELECT rule, seq, pid, arr, occ FROM seen")
    def _(spark, d):
        return sweeps.distorted(ev.table_events(spark, d), PID, clock=clock, **options)[2].select("rule", "seq", "pid", "arr", "occ")


_arrivals("dst03_fixed_delay_m1", "M1", ("random",), None)
_arrivals("dst04_fixed_delay_m2", "M2", ("random",), None)
_arrivals("dst02_targeted_delay", "M1", ("targeted",), None)
_arrivals("dst05_delete_control", "M1", ("delete",), None)

ONE = {"structures": ("random",), "fractions": (0.2,), "seeds": (0, 1), "multiples": (1.0, 2.0)}


@query("dst07_uniform_delay", f"WITH {O.marked(PID, delay='uniform', **ONE)} SELECT rule, multiple, seed, seq, arr - t AS delay FROM arrived WHERE chosen")
def _(spark, d):
    return sweeps.distorted(ev.table_events(spark, d), PID, delay="uniform", **ONE)[2].where("chosen").select("rule", "multiple", "seed", "seq", (F.col("arr") - F.col("t")).alias("delay"))


@query("dst08_lognormal_delay", f"WITH {O.chosen(PID, **ONE)} SELECT rule, multiple, seed, seq, CAST(round(exp(ln(multiple * w) - 0.5 + {O.NORMAL})) AS BIGINT) // 1000000 AS delay_s FROM chosen WHERE chosen")
def _(spark, d):
    return sweeps.distorted(ev.table_events(spark, d), PID, delay="lognormal", **ONE)[2].where("chosen").select("rule", "multiple", "seed", "seq", F.floor((F.col("arr") - F.col("t")) / 1_000_000).alias("delay_s"))


@query("dst09_burst_delay", f"WITH {O.burst(PID, **ONE)} SELECT rule, multiple, seed, count(*) FILTER (take) AS slots, CAST(sum(c) FILTER (take) AS BIGINT) AS rows FROM slots GROUP BY ALL")
def _(spark, d):
    runs = distort.grid(spark, PID, ONE["fractions"], ONE["multiples"], ONE["seeds"], ("random",))
    rows = distort.burst(distort.spread(projected(spark, d, PID), runs)).where("chosen")
    first = projected(spark, d, PID).groupBy("rule").agg(F.min("t").alias("t0"))
    slot = F.floor((F.col("t") - F.col("t0")) / F.col("w"))
    return rows.join(F.broadcast(first), "rule").groupBy("rule", "multiple", "seed").agg(F.countDistinct(slot).alias("slots"), F.count("*").alias("rows"))


@query("dst10_bernoulli_delay", f"WITH {O.EV} SELECT fraction, count(*) AS n, count(*) FILTER (('0x' || substr(md5('pick:0:' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE < fraction) AS chosen FROM ev, (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.2 AS DOUBLE)]) AS fraction) GROUP BY fraction")
def _(spark, d):
    grid = spark.createDataFrame([(0.05, 0), (0.2, 0)], "fraction double, seed int")
    return distort.bernoulli(ev.table_events(spark, d).join(F.broadcast(grid))).groupBy("fraction").agg(F.count("*").alias("n"), F.count_if("chosen").alias("chosen"))


@query("dst11_longest_delay", f"WITH {O.marked(PID, delay='uniform', **ONE)} SELECT rule, multiple, seed, max(arr - t) AS longest FROM arrived GROUP BY ALL")
def _(spark, d):
    return sweeps.distorted(ev.table_events(spark, d), PID, delay="uniform", **ONE)[2].groupBy("rule", "multiple", "seed").agg(F.max(F.col("arr") - F.col("t")).alias("longest"))


# --- sweeps and what is said of them


@query("swp01_ordering_sweep_keys", f"WITH {O.sweep()} SELECT {SQL_RECORD} FROM sweep")
def _(spark, d):
    return record(_sweep(spark, d))


ALERT_RECORD = ["rule", "fraction", "multiple", "structure", "seed", "alerts", "baseline_alerts", "alerts_lost", "keys_lost", "dropped_late"]


@query("swp01_ordering_sweep_alerts", f"WITH RECURSIVE {O.alert_sweep()} SELECT {', '.join(ALERT_RECORD)}, round(alert_reduction, 6) AS alert_reduction FROM records")
def _(spark, d):
    return sweeps.ordering_sweep(ev.table_events(spark, d), RULES).select(*ALERT_RECORD, F.round("alert_reduction", 6).alias("alert_reduction"))


@query("swp01_ordering_sweep_m2", f"WITH {O.sweep(clock='M2')} SELECT {SQL_RECORD} FROM sweep")
def _(spark, d):
    return record(_sweep(spark, d, clock="M2"))


TARGET_SQL = f"""{O.sweep(PID)}, marks AS (SELECT rule, count(*) AS malicious_detected FROM known WHERE CAST(key AS BIGINT) % 7 = 0 GROUP BY rule),
escaped AS (SELECT {', '.join('g.' + c for c in O.RUN.split(', '))}, count(*) AS malicious_evaded FROM grid g JOIN known k USING (rule) WHERE CAST(k.key AS BIGINT) % 7 = 0
            AND NOT EXISTS (SELECT 1 FROM found f WHERE {O.same('f', 'g')} AND f.key = k.key) GROUP BY ALL),
evasion AS (SELECT s.rule, s.fraction, s.multiple, s.structure, s.seed, m.malicious_detected, coalesce(e.malicious_evaded, 0) AS malicious_evaded, coalesce(e.malicious_evaded, 0) / CAST(m.malicious_detected AS DOUBLE) AS evasion_rate
            FROM sweep s JOIN marks m USING (rule) LEFT JOIN escaped e ON {O.same('e', 's')})"""


@query("swp02_targeting_sweep", f"WITH {TARGET_SQL} SELECT * REPLACE (round(evasion_rate, 6) AS evasion_rate) FROM evasion")
def _(spark, d):
    out = sweeps.targeting_sweep(ev.table_events(spark, d), PID)
    return out.select("rule", "fraction", "multiple", "structure", "seed", "malicious_detected", "malicious_evaded", F.round("evasion_rate", 6).alias("evasion_rate"))


MITIGATION = {"fractions": (0.2,), "seeds": (0, 1), "multiples": (1.0, 2.0)}
BUFFERS = (0.0, 0.5, 1.0, 2.0)
CELL_RECORD = ["rule", "fraction", "multiple", "seed", "buffer_windows", "dropped_late", "keys_lost", "alerts", "baseline_alerts", "alerts_evaded", "max_delay"]


@query("swp03_mitigation_sweep", f"WITH RECURSIVE {O.mitigation(BUFFERS, PID, **MITIGATION)} SELECT {', '.join(CELL_RECORD)}, round(evasion_remaining, 6) AS evasion_remaining, round(buffer_windows * w / 1e6, 3) AS detection_delay_seconds FROM cells JOIN (SELECT rule, w FROM rules) USING (rule)")
def _(spark, d):
    out = sweeps.mitigation_sweep(ev.table_events(spark, d), PID, BUFFERS, **MITIGATION)
    return out.select(*CELL_RECORD, F.round("evasion_remaining", 6).alias("evasion_remaining"), F.round(F.col("buffer") / 1e6, 3).alias("detection_delay_seconds"))


@query("swp04_premise_check", f"""WITH {O.EV}, g AS (SELECT * FROM {O.values([(0.0, 0), (0.05, 60), (0.05, 86400), (0.2, 86400), (0.2, 172800), (0.5, 172800)])} v(fraction, delay)),
a AS (SELECT ev.*, CAST(pid AS VARCHAR) AS key, fraction, delay, t + CASE WHEN ('0x' || substr(md5('pick:0:' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE < fraction THEN CAST(delay AS BIGINT) * 1000000 ELSE 0 END AS arr, 86400000000 AS w, 5 AS n FROM ev, g),
m AS (SELECT *, coalesce(t < max(t) OVER (PARTITION BY fraction, delay ORDER BY arr, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - w, false) AS late FROM a), k AS (SELECT * FROM m WHERE NOT late),
f AS (SELECT fraction, delay, count(DISTINCT key) AS keys FROM {O.hits('k', 'fraction, delay')} WHERE hit GROUP BY fraction, delay)
SELECT m.fraction, CAST(m.delay AS BIGINT) * 1000000 AS delay, count(*) FILTER (NOT late) AS accepted, count(*) FILTER (late) AS dropped_late, any_value(coalesce(f.keys, 0)) AS keys FROM m LEFT JOIN f USING (fraction, delay) GROUP BY m.fraction, m.delay""")
def _(spark, d):
    return sweeps.premise_check(ev.table_events(spark, d), 86_400_000_000, 5).select("fraction", "delay", "accepted", "dropped_late", "keys")


FINE = {"structures": ("random",), "fractions": (0.2,), "seeds": (0, 1), "multiples": (0.9, 0.99, 1.0, 1.01)}


@query("swp05_fine_grid", f"WITH {O.sweep(PID[:3], **FINE)} SELECT rule, multiple, round(avg(key_reduction), 6) AS reduction, round(avg(dropped_late), 4) AS drops FROM sweep GROUP BY rule, multiple")
def _(spark, d):
    return _sweep(spark, d, PID[:3], **FINE).groupBy("rule", "multiple").agg(F.round(F.avg("key_reduction"), 6).alias("reduction"), F.round(F.avg("dropped_late"), 4).alias("drops"))


RESET = {"structures": ("random",), "fractions": (0.2,), "seeds": (0, 1)}


@query("swp06_reset_and_none", f"""WITH RECURSIVE {O.alert_sweep(PID, **RESET)},
a AS (SELECT {O.RUN}, count(*) AS without_reset FROM found GROUP BY {O.RUN}), b AS (SELECT {O.RUN}, count(DISTINCT key) AS with_reset FROM fired GROUP BY {O.RUN})
SELECT g.rule, g.multiple, g.seed, coalesce(without_reset, 0) AS without_reset, coalesce(with_reset, 0) AS with_reset FROM grid g LEFT JOIN a ON {O.same('a', 'g')} LEFT JOIN b ON {O.same('b', 'g')}""")
def _(spark, d):
    runs, stream, rows = sweeps.distorted(ev.table_events(spark, d), PID, **RESET)
    kept = cut(detect.mark_late(rows.select(*sweeps.SEEN), width=sweeps.Sizes.of(stream).width).where("NOT late"), "kept")
    a = detect.count(detect.subjects(kept, N), "without_reset")
    b = detect.alerts(kept).groupBy("run").agg(F.countDistinct("key").alias("with_reset"))
    return runs.select("run", "rule", "multiple", "seed").join(a, "run", "left").join(b, "run", "left").na.fill(0).drop("run")


def _on_sweep(name, body, which=RULES, **options):
    """A query on the sweep's records that is the same text in both engines."""
    @query(name, f"WITH {O.sweep(which, **options)} {body}")
    def _(spark, d):
        return spark.sql(body.replace("FROM sweep", "FROM {sweep}").replace("JOIN sweep", "JOIN {sweep}"), sweep=cut(_sweep(spark, d, which, **options), "sweep"))


CELL = "rule, fraction, multiple, structure"
_on_sweep("agg01_cell_means", f"SELECT {CELL}, count(*) AS n, round(avg(key_reduction), 6) AS mean FROM sweep GROUP BY {CELL}")
_on_sweep("agg04_shares", "SELECT rule, structure, CAST(sum(CASE WHEN dropped_late > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_drops, round(avg(CASE WHEN keys_lost = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS share_intact, bool_and(keys_lost >= 0) AS sane, bool_or(keys_lost > 0) AS any_loss FROM sweep GROUP BY rule, structure")
_on_sweep("agg12_loss_by_region", "SELECT rule, multiple <= 1 AS inside, count(*) AS runs, CAST(sum(CASE WHEN keys_lost > 0 THEN 1 ELSE 0 END) AS BIGINT) AS losing, CAST(sum(CASE WHEN keys_lost > 0 AND dropped_late = 0 THEN 1 ELSE 0 END) AS BIGINT) AS loss_without_drops FROM sweep WHERE structure <> 'delete' GROUP BY rule, multiple <= 1")
_on_sweep("agg11_targeted_advantage", "SELECT a.rule, a.fraction, a.multiple, round(b.m - a.m, 4) AS advantage FROM (SELECT rule, fraction, multiple, avg(key_reduction) AS m FROM sweep WHERE structure = 'random' GROUP BY rule, fraction, multiple) a JOIN (SELECT rule, fraction, multiple, avg(key_reduction) AS m FROM sweep WHERE structure = 'targeted' GROUP BY rule, fraction, multiple) b ON a.rule = b.rule AND a.fraction = b.fraction AND a.multiple = b.multiple")
_on_sweep("jon06_treatment_control", "SELECT a.rule, a.fraction, a.multiple, round(a.m - b.m, 6) AS difference FROM (SELECT rule, fraction, multiple, avg(key_reduction) AS m FROM sweep WHERE structure = 'random' GROUP BY rule, fraction, multiple) a JOIN (SELECT rule, fraction, avg(key_reduction) AS m FROM sweep WHERE structure = 'delete' GROUP BY rule, fraction) b ON a.rule = b.rule AND a.fraction = b.fraction")
_on_sweep("snk04_figure_series", "SELECT rule, multiple, round(avg(key_reduction), 6) AS mean, min(dropped_late) AS least_drops, max(dropped_late) AS most_drops FROM sweep WHERE structure = 'random' GROUP BY rule, multiple")


def _sweep_cut(spark, d, **options):
    return cut(_sweep(spark, d, **options), "sweep")


@query("agg02_summary", f"WITH {O.sweep()} SELECT rule, structure, count(key_reduction) AS n, round(avg(key_reduction), 6) AS mean, CASE WHEN count(key_reduction) > 0 THEN round(coalesce(stddev_samp(key_reduction), 0), 6) END AS sd, round(max(key_reduction), 6) AS most FROM sweep GROUP BY rule, structure")
def _(spark, d):
    n, mean, sd, _, most, _ = stats.summary("key_reduction")
    return _sweep(spark, d).groupBy("rule", "structure").agg(n, F.round(mean, 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(most, 6).alias("most"))


@query("agg03_describe", f"WITH {O.sweep()} SELECT rule, count(dropped_late) AS n, round(avg(dropped_late), 4) AS mean, round(coalesce(stddev_samp(dropped_late), 0), 4) AS sd, min(dropped_late) AS least, max(dropped_late) AS most, max(dropped_late) - min(dropped_late) AS range FROM sweep GROUP BY rule")
def _(spark, d):
    n, mean, sd, lo, hi, span = stats.summary("dropped_late")
    return _sweep(spark, d).groupBy("rule").agg(n, F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("sd"), lo.alias("least"), hi.alias("most"), span)


@query("agg05_median_ratio", f"WITH {O.sweep()}, c AS (SELECT rule, fraction, multiple, avg(dropped_late) FILTER (structure = 'random') AS r, avg(dropped_late) FILTER (structure = 'targeted') AS t FROM sweep WHERE structure <> 'delete' GROUP BY ALL) SELECT rule, count(*) AS cells, round(quantile_cont(r / t, 0.5), 6) AS median_ratio FROM c WHERE r > 0 AND t > 0 GROUP BY rule")
def _(spark, d):
    c = _sweep(spark, d).where("structure <> 'delete'").groupBy("rule", "fraction", "multiple").pivot("structure", ["random", "targeted"]).agg(F.avg("dropped_late"))
    return c.where("random > 0 AND targeted > 0").groupBy("rule").agg(F.count("*").alias("cells"), F.round(F.percentile(F.col("random") / F.col("targeted"), 0.5), 6).alias("median_ratio"))


@query("agg06_index_quantiles", f"WITH {O.EV}, q AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY value) AS i, count(*) OVER (PARTITION BY action) AS n FROM ev WHERE value IS NOT NULL) SELECT action, any_value(n) AS n, count(*) FILTER (value = 0) AS zeros, min(value) AS least, max(value) FILTER (i = floor(0.1 * (n - 1)) + 1) AS p10, max(value) FILTER (i = floor(0.5 * (n - 1)) + 1) AS median, max(value) FILTER (i = floor(0.9 * (n - 1)) + 1) AS p90, max(value) AS most FROM q GROUP BY action")
def _(spark, d):
    return stats.index_quantiles(ev.table_events(spark, d), ["action"], "value", {"p10": 0.1, "median": 0.5, "p90": 0.9})


@query("agg07_percentile", f"WITH {O.EV} SELECT action, round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.975), 6) AS p975 FROM ev GROUP BY action")
def _(spark, d):
    out = stats.quantiles(ev.table_events(spark, d), ["action"], "value", {"p025": 0.025, "p975": 0.975})
    return out.select("action", F.round("p025", 6).alias("p025"), F.round("p975", 6).alias("p975"))


@query("agg08_spearman", f"WITH {O.sweep()}, x AS (SELECT *, rank() OVER (PARTITION BY rule ORDER BY dropped_late) + (count(*) OVER (PARTITION BY rule, dropped_late) - 1) / 2.0 AS a, rank() OVER (PARTITION BY rule ORDER BY key_reduction) + (count(*) OVER (PARTITION BY rule, key_reduction) - 1) / 2.0 AS b FROM sweep WHERE key_reduction IS NOT NULL) SELECT rule, count(*) AS n, round(CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END, 6) AS rho FROM x GROUP BY rule")
def _(spark, d):
    return stats.spearman(_sweep(spark, d), ["rule"], "dropped_late", "key_reduction").select("rule", "n", F.round("rho", 6).alias("rho"))


def _bootstrap_sql(source: str, value: str) -> str:
    """CTEs ``cells`` and ``drawn``: the arms of each cell, and percentiles of the resampled difference."""
    u = lambda arm: f"[{arm}[CAST(floor(('0x' || substr(md5('boot:' || cell || ':{'targeted' if arm == 'a' else 'random'}:' || r || ':' || j), 1, 8))::BIGINT / 4294967296.0::DOUBLE * len({arm})) AS BIGINT) + 1] FOR j IN range(0, len({arm}))]"
    return f"""arms AS (SELECT rule, fraction, multiple, concat_ws('/', rule, fraction, multiple) AS cell, list({value} ORDER BY seed) FILTER (structure = 'targeted' AND {value} IS NOT NULL) AS a,
          list({value} ORDER BY seed) FILTER (structure = 'random' AND {value} IS NOT NULL) AS b FROM {source} WHERE multiple IS NOT NULL GROUP BY rule, fraction, multiple),
rounds AS (SELECT cell, a, b, unnest(range(0, {stats.RESAMPLES})) AS r FROM arms WHERE len(a) > 0 AND len(b) > 0),
drawn AS (SELECT cell, quantile_cont(list_sum({u('a')}) / len(a) - list_sum({u('b')}) / len(b), [0.025, 0.05, 0.95, 0.975]) AS p FROM rounds GROUP BY cell),
boot AS (SELECT rule, fraction, multiple, list_sum(a) / len(a) - list_sum(b) / len(b) AS difference, p[1] AS p025, p[2] AS p05, p[3] AS p95, p[4] AS p975 FROM arms LEFT JOIN drawn USING (cell))"""


BOOT = ["difference", "p025", "p05", "p95", "p975"]


@query("agg09_bootstrap", f"WITH {O.sweep()}, {_bootstrap_sql('sweep', 'key_reduction')} SELECT rule, fraction, multiple, {', '.join(f'round({c}, 6) AS {c}' for c in BOOT)} FROM boot")
def _(spark, d):
    records = _sweep_cut(spark, d).where("multiple IS NOT NULL")
    out = stats.bootstrap_difference(records, ["rule", "fraction", "multiple"], "structure", "targeted", "random", "key_reduction")
    return out.select("rule", "fraction", "multiple", *[F.round(c, 6).alias(c) for c in BOOT])


@query("agg10_delay_shape", f"WITH {O.sweep()}, c AS (SELECT rule, fraction, structure, multiple, avg(key_reduction) AS m FROM sweep WHERE structure <> 'delete' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rule, fraction, structure ORDER BY m DESC, multiple) AS i, min(multiple) OVER p AS lo, max(multiple) OVER p AS hi FROM c WHERE m IS NOT NULL WINDOW p AS (PARTITION BY rule, fraction, structure)) SELECT rule, fraction, structure, multiple AS peak_at, round(m, 4) AS peak, multiple > lo AND multiple < hi AS interior, multiple = hi AS at_largest FROM r WHERE i = 1")
def _(spark, d):
    cells = _sweep(spark, d).where("structure <> 'delete'").groupBy("rule", "fraction", "structure", "multiple").agg(F.avg("key_reduction").alias("m"))
    out = stats.first_maximum(cells, ["rule", "fraction", "structure"], "multiple", "m")
    return out.withColumn("peak", F.round("peak", 4))


@query("agg13_trace_size", f"WITH {O.sweep()}, q AS (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY dropped_late) AS i, count(*) OVER (PARTITION BY structure) AS n FROM sweep WHERE keys_lost > 0) SELECT structure, any_value(n) AS n, count(*) FILTER (dropped_late = 0) AS zeros, min(dropped_late) AS least, max(dropped_late) FILTER (i = floor(0.5 * (n - 1)) + 1) AS median, max(dropped_late) AS most FROM q GROUP BY structure")
def _(spark, d):
    return stats.index_quantiles(_sweep(spark, d).where("keys_lost > 0"), ["structure"], "dropped_late", {"median": 0.5})


MATCHED_SQL = f"""{TARGET_SQL}, evading AS (SELECT s.rule, s.fraction, s.multiple, s.structure, avg(s.dropped_late) AS drops FROM sweep s JOIN escaped e ON {O.same('e', 's')} WHERE s.structure <> 'delete' GROUP BY ALL)"""


@query("agg13_matched_ratio", f"WITH {MATCHED_SQL} SELECT count(*) AS cells, round(quantile_cont(r.drops / t.drops, 0.5), 6) AS median_ratio FROM evading r JOIN evading t ON {O.same('r', 't', 'rule, fraction, multiple')} AND r.structure = 'random' AND t.structure = 'targeted' WHERE r.drops > 0 AND t.drops > 0")
def _(spark, d):
    cells = _evading_drops(spark, d).where("structure <> 'delete'").groupBy("rule", "fraction", "multiple").pivot("structure", ["random", "targeted"]).agg(F.avg("dropped_late"))
    both = cells.where("random > 0 AND targeted > 0")
    return both.agg(F.count("*").alias("cells"), F.round(F.percentile(F.col("random") / F.col("targeted"), 0.5), 6).alias("median_ratio"))


BURST = {"structures": ("random",), "fractions": (0.2,), "seeds": (0, 1)}


def _burst_sql(delay: str) -> str:
    return f"SELECT '{delay}' AS delay, rule, multiple, round(avg(key_reduction), 6) AS reduction, round(avg(dropped_late), 4) AS drops FROM (WITH {O.sweep(PID, delay=delay, **BURST)} SELECT * FROM sweep) GROUP BY rule, multiple"


@query("agg14_burst_and_fixed", f"{_burst_sql('fixed')} UNION ALL {_burst_sql('burst')}")
def _(spark, d):
    both = [_sweep(spark, d, PID, delay=x, **BURST).withColumn("delay", F.lit(x)) for x in ("fixed", "burst")]
    return both[0].unionByName(both[1]).groupBy("delay", "rule", "multiple").agg(F.round(F.avg("key_reduction"), 6).alias("reduction"), F.round(F.avg("dropped_late"), 4).alias("drops"))


@query("jon04_baseline_join", f"WITH {O.sweep(**TWO)} SELECT rule, multiple, structure, seed, keys, baseline_keys, baseline_keys - keys AS missing FROM sweep")
def _(spark, d):
    return _sweep(spark, d, **TWO).select("rule", "multiple", "structure", "seed", "keys", "baseline_keys", (F.col("baseline_keys") - F.col("keys")).alias("missing"))


def _evading_drops(spark, d):
    """Runs in which marked subjects evade, with their drops: two sweeps joined by run."""
    e = ev.table_events(spark, d)
    key = ["rule", "fraction", "structure", "seed"]
    a = sweeps.targeting_sweep(e, PID).where("malicious_evaded > 0").select(*key, "multiple", "malicious_evaded").alias("a")
    b = sweeps.ordering_sweep(e, PID, with_alerts=False).select(*key, "multiple", "dropped_late").alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "multiple"]]
    return a.join(b, on).select(*[f"a.{k}" for k in [*key, "multiple"]], "b.dropped_late", "a.malicious_evaded")


@query("jon05_drop_join", f"WITH {TARGET_SQL} SELECT s.rule, s.fraction, s.multiple, s.structure, s.seed, s.dropped_late, e.malicious_evaded FROM sweep s JOIN escaped e ON {O.same('e', 's')}")
def _(spark, d):
    return _evading_drops(spark, d)


OLD, NEW = {**TWO, "seeds": (0, 1)}, {**TWO, "seeds": (1, 2), "delay": "uniform"}


@query("jon07_regression", f"""SELECT count(*) FILTER (a.rule IS NOT NULL AND b.rule IS NOT NULL AND (a.keys <> b.keys OR a.keys_lost <> b.keys_lost OR a.dropped_late <> b.dropped_late)) AS mismatches,
count(*) FILTER (b.rule IS NULL) AS only_old, count(*) FILTER (a.rule IS NULL) AS only_new
FROM (WITH {O.sweep(**OLD)} SELECT * FROM sweep) a FULL JOIN (WITH {O.sweep(**NEW)} SELECT * FROM sweep) b ON {O.same('a', 'b')}""")
def _(spark, d):
    """Two runs of the sweep that share a seed, with fixed and with uniform delays."""
    old, new = (cut(_sweep(spark, d, **options), "records") for options in (OLD, NEW))
    return integrity.compare(old, new, distort.RUN, ["keys", "keys_lost", "dropped_late"])


@query("set01_lost_keys", f"WITH {O.sweep(**TWO)} SELECT g.rule, g.multiple, g.structure, g.seed, k.key FROM grid g JOIN known k USING (rule) WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.rule = g.rule AND f.multiple IS NOT DISTINCT FROM g.multiple AND f.structure = g.structure AND f.seed = g.seed AND f.key = k.key)")
def _(spark, d):
    return sweeps.lost_subjects(ev.table_events(spark, d), RULES, **TWO).select("rule", "multiple", "structure", "seed", "key")


@query("set02_set_equality", f"WITH {O.base(PID)} SELECT a.rule AS rule_a, b.rule AS rule_b, (SELECT count(*) FROM (SELECT key FROM known WHERE rule = a.rule EXCEPT SELECT key FROM known WHERE rule = b.rule)) = 0 AND (SELECT count(*) FROM (SELECT key FROM known WHERE rule = b.rule EXCEPT SELECT key FROM known WHERE rule = a.rule)) = 0 AS equal FROM (SELECT 'dense_any' AS rule) a, (SELECT 'near_thr' AS rule) b")
def _(spark, d):
    known = cut(sweeps.baseline_subjects(projected(spark, d, PID), PID), "known")
    a, b = (known.where(F.col("rule") == r).select("key") for r in ("dense_any", "near_thr"))
    odd = a.exceptAll(b).union(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))
    return odd.select(F.lit("dense_any").alias("rule_a"), F.lit("near_thr").alias("rule_b"), "equal")


@query("set03_union_relabel", f"WITH {O.sweep(**TWO)} SELECT label, structure, count(*) AS runs, sum(keys_lost) AS keys_lost FROM (SELECT 'fixed' AS label, * FROM sweep UNION ALL SELECT 'fixed-again', * FROM sweep WHERE seed = 0) GROUP BY label, structure".replace("sum(keys_lost)", "CAST(sum(keys_lost) AS BIGINT)"))
def _(spark, d):
    s = _sweep_cut(spark, d, **TWO)
    both = s.withColumn("label", F.lit("fixed")).unionByName(s.where("seed = 0").withColumn("label", F.lit("fixed-again")))
    return both.groupBy("label", "structure").agg(F.count("*").alias("runs"), F.sum("keys_lost").alias("keys_lost"))


@query("set04_distinct", f"WITH {O.proj()} SELECT rule, count(DISTINCT key) AS keys, count(DISTINCT pid) AS pids FROM proj GROUP BY rule")
def _(spark, d):
    return projected(spark, d).groupBy("rule").agg(F.countDistinct("key").alias("keys"), F.countDistinct("pid").alias("pids"))


# --- hypotheses


def _records(spark, d, which=RULES, **options):
    return cut(sweeps.ordering_sweep(ev.table_events(spark, d), which, **options), "records")


def _mitigations(spark, d, which=PID, **options):
    return cut(sweeps.mitigation_sweep(ev.table_events(spark, d), which, **{**MITIGATION, **options}), "cells")


REGRESSION = {"fractions": (0.2,), "seeds": (0, 1), "multiples": (1.0, 2.0)}
EQUAL = ["alerts", "keys_lost", "dropped_late"]


@query("hyp0_regression_equal", f"""SELECT count(*) FILTER (a.rule IS NOT NULL AND b.rule IS NOT NULL AND ({' OR '.join(f'a.{c} IS DISTINCT FROM b.{c}' for c in EQUAL)})) AS mismatches, count(*) FILTER (b.rule IS NULL) AS only_old, count(*) FILTER (a.rule IS NULL) AS only_new
FROM (WITH RECURSIVE {O.alert_sweep(PID, structures=('random',), **REGRESSION)} SELECT * FROM records) a
FULL JOIN (WITH RECURSIVE {O.mitigation((0.0,), PID, **REGRESSION)} SELECT * FROM cells) b ON a.rule = b.rule AND a.multiple = b.multiple AND a.seed = b.seed""")
def _(spark, d):
    """Two ways to one result: the plain sweep, and behind a buffer of size 0."""
    a = _records(spark, d, PID, structures=("random",), **REGRESSION)
    b = _mitigations(spark, d, buffers=(0.0,), **REGRESSION)
    return integrity.compare(a, b, ["rule", "fraction", "multiple", "structure", "seed"], EQUAL)


_on_sweep("hyp0a_no_drops_inside", "SELECT count(*) AS runs, CAST(sum(CASE WHEN dropped_late > 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM sweep WHERE multiple <= 1 AND structure <> 'delete'")


@query("hyp0b_full_buffer_harmless", f"WITH RECURSIVE {O.mitigation(BUFFERS, PID, delay='uniform', **MITIGATION)} SELECT count(*) AS runs, count(*) FILTER (CAST(buffer_windows * w AS BIGINT) >= max_delay) AS full, count(*) FILTER (CAST(buffer_windows * w AS BIGINT) >= max_delay AND alerts_evaded <> 0) AS violations FROM cells JOIN (SELECT rule, w FROM rules) USING (rule)")
def _(spark, d):
    return verdicts.full_buffer_harmless(_mitigations(spark, d, buffers=BUFFERS, delay="uniform"))


VERDICT = ", round(avg(CASE WHEN holds THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER (), 6) AS share"
BEYOND = {"structures": ("random", "delete"), "multiples": verdicts.BEYOND, "seeds": (0, 1)}


@query("hyp1_beyond_is_delete", f"""WITH RECURSIVE {O.alert_sweep(**BEYOND)}, late AS (SELECT rule, fraction, multiple, avg(alert_reduction) AS m FROM records WHERE structure = 'random' GROUP BY ALL),
gone AS (SELECT rule, fraction, avg(alert_reduction) AS m FROM records WHERE structure = 'delete' GROUP BY ALL), c AS (SELECT rule, fraction, multiple, a.m - b.m AS difference, abs(a.m - b.m) <= 0.01 AS holds FROM late a JOIN gone b USING (rule, fraction))
SELECT rule, fraction, multiple, round(difference, 6) AS difference, holds{VERDICT}, avg(CASE WHEN holds THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER () >= 0.9 AS adopted FROM c""")
def _(spark, d):
    out = verdicts.beyond_is_delete(_records(spark, d, **BEYOND))
    return out.select("rule", "fraction", "multiple", F.round("difference", 6).alias("difference"), "holds", F.round("share", 6).alias("share"), "adopted")


CLOCKS = {"structures": ("random",), "fractions": (0.2,), "multiples": (*verdicts.HIDDEN, verdicts.VISIBLE), "seeds": (0, 1)}
UNITS_SQL = f"""{O.alert_sweep(**CLOCKS)}, means AS (SELECT rule, fraction, multiple, avg(alert_reduction) AS m, CAST(sum(dropped_late) AS BIGINT) AS drops FROM records GROUP BY ALL),
units AS (SELECT rule, max(m) FILTER (multiple <= 1) AS hidden, max(m) FILTER (multiple = 2) AS visible FROM means GROUP BY rule)"""


@query("hyp2_hidden_below_visible", f"WITH RECURSIVE {UNITS_SQL}, c AS (SELECT *, hidden < visible AS holds FROM units) SELECT rule, round(hidden, 6) AS hidden, round(visible, 6) AS visible, holds{VERDICT}, count(*) FILTER (holds) OVER () * 15 >= count(*) OVER () * 13 AS adopted FROM c")
def _(spark, d):
    out = verdicts.hidden_below_visible(_records(spark, d, **CLOCKS))
    return out.select("rule", F.round("hidden", 6).alias("hidden"), F.round("visible", 6).alias("visible"), "holds", F.round("share", 6).alias("share"), "adopted")


@query("hyp2_largest_without_drops", f"WITH RECURSIVE {UNITS_SQL} SELECT rule, fraction, multiple, round(m, 6) AS reduction FROM means WHERE drops = 0 AND m IS NOT NULL ORDER BY m DESC, rule DESC, fraction DESC, multiple DESC LIMIT 1")
def _(spark, d):
    return verdicts.largest_without_drops(_records(spark, d, **CLOCKS)).withColumn("reduction", F.round("reduction", 6))


FAR = {"structures": ("random",), "fractions": (0.2,), "multiples": (10.0,), "seeds": (0, 1)}
IMMUNE = ("dense_any", "prop_key")


@query("hyp3_rank_of_clocks", f"""WITH u AS (WITH RECURSIVE {UNITS_SQL} SELECT rule, hidden FROM units), f AS (WITH RECURSIVE {O.alert_sweep(clock='M2', **FAR)} SELECT rule, avg(alert_reduction) AS far FROM records GROUP BY rule),
x AS (SELECT hidden, far, rank() OVER (ORDER BY far) + (count(*) OVER (PARTITION BY far) - 1) / 2.0 AS a, rank() OVER (ORDER BY hidden) + (count(*) OVER (PARTITION BY hidden) - 1) / 2.0 AS b FROM u JOIN f USING (rule) WHERE hidden IS NOT NULL AND far IS NOT NULL),
r AS (SELECT count(*) AS n, CASE WHEN min(a) < max(a) AND min(b) < max(b) THEN corr(a, b) END AS rho FROM x),
h AS (SELECT count(*) AS immune, count(*) FILTER (hidden >= 0.02) AS hits FROM u JOIN f USING (rule) WHERE rule IN {IMMUNE})
SELECT n, round(rho, 6) AS rho, immune, hits, coalesce(rho < 0.5, false) AS rank_adopted, hits * 6 >= immune * 4 AS hits_adopted FROM r, h""")
def _(spark, d):
    return verdicts.rank_of_clocks(_records(spark, d, **CLOCKS), _records(spark, d, clock="M2", **FAR), IMMUNE).withColumn("rho", F.round("rho", 6))


EQUIVALENCE_SQL = f"""{TARGET_SQL}, {_bootstrap_sql('evasion', 'evasion_rate')},
cells AS (SELECT b.*, m.malicious_detected, m.malicious_detected >= {verdicts.PRIMARY} AS primary_, p05 >= -{verdicts.MARGIN} AND p95 <= {verdicts.MARGIN} AS holds, CASE WHEN p025 > 0 THEN 'targeted' WHEN p975 < 0 THEN 'random' END AS direction, p025 > {verdicts.MARGIN} AS beyond
          FROM boot b JOIN marks m USING (rule)),
verdict AS (SELECT count(*) FILTER (primary_ AND holds) / CAST(nullif(count(*) FILTER (primary_), 0) AS DOUBLE) AS share, count(*) FILTER (primary_ AND beyond) AS worst FROM cells)"""


@query("hyp4_targeting_equivalence", f"WITH {EQUIVALENCE_SQL} SELECT rule, fraction, multiple, malicious_detected, primary_ AS \"primary\", {', '.join(f'round({c}, 6) AS {c}' for c in BOOT)}, holds, direction, beyond, round(share, 6) AS share, coalesce(share >= 0.7 AND worst = 0, false) AS adopted FROM cells, verdict")
def _(spark, d):
    out = verdicts.targeting_equivalence(cut(sweeps.targeting_sweep(ev.table_events(spark, d), PID), "evasion"))
    return out.select("rule", "fraction", "multiple", "malicious_detected", "primary", *[F.round(c, 6).alias(c) for c in BOOT], "holds", "direction", "beyond", F.round("share", 6).alias("share"), "adopted")


BAND = "CASE WHEN malicious_detected >= 20 THEN '20 and more' WHEN malicious_detected >= 5 THEN '5 to 19' ELSE 'below 5' END"


@query("agg15_equivalence_bands", f"WITH {EQUIVALENCE_SQL} SELECT {BAND} AS band, count(*) AS cells, count(*) FILTER (holds) AS equivalent, round(avg(CASE WHEN holds THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share, count(*) FILTER (direction = 'targeted') AS targeted, count(*) FILTER (direction = 'random') AS random FROM cells GROUP BY band")
def _(spark, d):
    out = verdicts.targeting_equivalence(cut(sweeps.targeting_sweep(ev.table_events(spark, d), PID), "evasion"))
    return out.withColumn("band", F.expr(BAND)).groupBy("band").agg(F.count("*").alias("cells"), F.count_if("holds").alias("equivalent"), F.round(F.avg(F.col("holds").cast("double")), 6).alias("share"), F.count_if(F.col("direction") == "targeted").alias("targeted"), F.count_if(F.col("direction") == "random").alias("random"))


STAIRS = (0.0, 1.0, 2.0)


def _cells_sql(delay: str) -> str:
    return f"WITH RECURSIVE {O.mitigation(STAIRS, PID, delay=delay, **MITIGATION)} SELECT rule, fraction, multiple, buffer_windows, avg(evasion_remaining) AS remaining FROM cells GROUP BY ALL"


def _staircase(name: str, delay: str) -> None:
    @query(name, f"""WITH m AS ({_cells_sql(delay)}), c AS (SELECT rule, fraction, multiple, a.remaining AS r0, b.remaining AS rd, b.remaining > 0.1 * a.remaining AND b.remaining < 0.9 * a.remaining AS holds
FROM m a JOIN m b USING (rule, fraction, multiple) WHERE a.buffer_windows = 0 AND a.remaining >= 0.02 AND b.buffer_windows = multiple)
SELECT rule, fraction, multiple, round(r0, 6) AS r0, round(rd, 6) AS rd, holds{VERDICT}, avg(CASE WHEN holds THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER () >= 0.75 AS adopted FROM c""")
    def _(spark, d):
        out = verdicts.staircase(_mitigations(spark, d, buffers=STAIRS, delay=delay))
        return out.select("rule", "fraction", "multiple", *[F.round(c, 6).alias(c) for c in ("r0", "rd")], "holds", F.round("share", 6).alias("share"), "adopted")


_staircase("hyp5_staircase", "uniform")
_staircase("hyp5_staircase_lognormal", "lognormal")


@query("hyp6_partial_buffer", f"""WITH m AS ({_cells_sql('fixed')}), c AS (SELECT rule, fraction, multiple, b.buffer_windows, b.remaining - a.remaining AS difference, b.remaining - a.remaining <= 0.01 AS holds
FROM m a JOIN m b USING (rule, fraction, multiple) WHERE a.buffer_windows = 0 AND b.buffer_windows <> 0)
SELECT rule, fraction, multiple, buffer_windows, round(difference, 6) AS difference, holds{VERDICT}, bool_and(holds) OVER () AS adopted FROM c""")
def _(spark, d):
    out = verdicts.partial_buffer(_mitigations(spark, d, buffers=STAIRS))
    return out.select("rule", "fraction", "multiple", "buffer_windows", F.round("difference", 6).alias("difference"), "holds", F.round("share", 6).alias("share"), "adopted")


TABLE = {"structures": ("random", "delete"), "fractions": (0.2,), "seeds": (0, 1)}


@query("hyp7_m1_table", f"WITH RECURSIVE {O.alert_sweep(**TABLE)} SELECT rule, {', '.join(f'round(avg(alert_reduction) FILTER (multiple = {m}), 6) AS at_{k}, round(avg(dropped_late) FILTER (multiple = {m}), 4) AS drops_{k}' for k, m in (('half', 0.5), ('one', 1), ('two', 2)))}, round(avg(alert_reduction) FILTER (structure = 'delete'), 6) AS deleted FROM records GROUP BY rule")
def _(spark, d):
    at = lambda c, m: F.avg(F.when(F.col("multiple") == m, F.col(c)))
    picks = [x for k, m in (("half", 0.5), ("one", 1.0), ("two", 2.0)) for x in (F.round(at("alert_reduction", m), 6).alias(f"at_{k}"), F.round(at("dropped_late", m), 4).alias(f"drops_{k}"))]
    gone = F.round(F.avg(F.when(F.col("structure") == "delete", F.col("alert_reduction"))), 6).alias("deleted")
    return _records(spark, d, **TABLE).groupBy("rule").agg(*picks, gone)


@query("hyp7_mitigation_shape", f"WITH m AS ({_cells_sql('burst')}) SELECT rule, multiple, {', '.join(f'round(max(remaining) FILTER (buffer_windows = {b}), 6) AS {n}' for n, b in (('none', 0), ('one', 1), ('two', 2)))} FROM m GROUP BY rule, multiple")
def _(spark, d):
    cells = verdicts.buffer_cells(_mitigations(spark, d, buffers=STAIRS, delay="burst"))
    return cells.groupBy("rule", "multiple").pivot("buffer_windows", list(STAIRS)).agg(F.round(F.first("remaining"), 6)).toDF("rule", "multiple", "none", "one", "two")


@query("snk03_sharded_records", f"WITH {O.sweep(**TWO)} SELECT {SQL_RECORD} FROM sweep")
def _(spark, d):
    """Records written one folder per rule, refused if any is missing, and read back in the catalogue's order."""
    path = scratch_path(spark, "shards")
    sinks.write_shards(_sweep(spark, d, **TWO), path, ["rule"])
    sinks.write_manifest(spark, path, "sharded-run", grid={k: list(v) for k, v in TWO.items()}, shards=[r.name for r in RULES])
    assert sinks.read_manifest(spark, path)["engine_version"] == sinks.ENGINE_VERSION
    return record(sinks.stitched(spark, path, ["rule"], [(r.name,) for r in RULES], ["fraction", "multiple", "structure", "seed"]))


@query("snk03_resumed_shards", ORACLE["snk03_sharded_records"])
def _(spark, d):
    """The same records, a shard for each rule: a first call runs some, a second the rest."""
    path = scratch_path(spark, "resumed")
    shards = {r.name: (lambda r=r: _sweep(spark, d, (r,), **TWO)) for r in RULES}
    sinks.run_shards(spark, path, dict(list(shards.items())[:2]))
    sinks.run_shards(spark, path, shards, side_by_side=2)
    return record(sinks.read_shards(spark, path, list(shards), ["fraction", "multiple", "structure", "seed"]))


@query("snk04_buffer_series", f"WITH m AS ({_cells_sql('fixed')}) SELECT multiple, buffer_windows, round(avg(remaining), 6) AS mean FROM m GROUP BY multiple, buffer_windows")
def _(spark, d):
    """The line of each delay over buffer sizes."""
    return verdicts.buffer_cells(_mitigations(spark, d, buffers=STAIRS)).groupBy("multiple", "buffer_windows").agg(F.round(F.avg("remaining"), 6).alias("mean"))


@query("snk04_range_series", f"""WITH {O.sweep()}, q AS (SELECT *, row_number() OVER (PARTITION BY structure, multiple ORDER BY dropped_late) AS i, count(*) OVER (PARTITION BY structure, multiple) AS n FROM sweep WHERE keys_lost > 0 AND multiple IS NOT NULL)
SELECT structure, multiple, any_value(n) AS n, min(dropped_late) AS least, {', '.join(f'max(dropped_late) FILTER (i = floor({v} * (n - 1)) + 1) AS {k}' for k, v in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))} FROM q GROUP BY structure, multiple""")
def _(spark, d):
    """Drops of losing runs: least, tenth, median and ninetieth percentile by place."""
    rows = _sweep_cut(spark, d).where("keys_lost > 0 AND multiple IS NOT NULL")
    return stats.index_quantiles(rows, ["structure", "multiple"], "dropped_late", {"p10": 0.1, "median": 0.5, "p90": 0.9}).drop("zeros", "most")
