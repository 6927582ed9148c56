"""The same plans as SQL text, for an independent engine to check."""

from __future__ import annotations

from tidemark.operators.rules import CATALOGUE, pid_rules
from tidemark.plans.sweeps import FRACTIONS, MULTIPLES, SEEDS

RUN = "rule, fraction, multiple, structure, seed"
EV = "ev AS (SELECT event_id AS seq, epoch_us(ts) AS t, user_id AS pid, event_type AS action, json_extract_string(props, '$.k') AS k, value FROM events)"


def values(rows) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def proj(rules=CATALOGUE) -> str:
    rows = [(r.name, r.actions, r.key, r.window, r.threshold) for r in rules]
    return f"""{EV}, rules AS (SELECT * FROM {values(rows)} r(rule, actions, key_name, w, n)),
proj AS (SELECT rule, seq, t, CASE WHEN key_name = 'pid' THEN CAST(pid AS VARCHAR) ELSE k END AS key, pid, w, n
         FROM ev JOIN rules ON list_contains(actions, action) WHERE key_name = 'pid' OR k IS NOT NULL)"""


def nth(x: str, over: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN n = {n} THEN lag({x}, {n - 1}) OVER {over} END" for n in sorted({r.threshold for r in CATALOGUE})) + ")"


def hits(source: str, run: str, x: str = "t") -> str:
    return f"(SELECT *, coalesce({x} - {nth(x, 'o')} <= w, false) AS hit FROM {source} WINDOW o AS (PARTITION BY {run}, key ORDER BY {x}, seq))"


def base(rules=CATALOGUE) -> str:
    return f"""{proj(rules)},
known AS (SELECT rule, key, min(t) AS first_t FROM {hits('proj', 'rule')} WHERE hit GROUP BY rule, key),
basis AS (SELECT r.rule, count(key) AS baseline_keys FROM (SELECT DISTINCT rule FROM proj) r LEFT JOIN known k USING (rule) GROUP BY r.rule)"""


def grid(rules=CATALOGUE, structures=("random", "targeted", "delete"), fractions=FRACTIONS, multiples=MULTIPLES, seeds=SEEDS) -> str:
    rows = [(r.name, f, None if s == "delete" else float(m), s, x) for r in rules for f in fractions for s in structures for m in ((0,) if s == "delete" else multiples) for x in seeds]
    return f"grid AS (SELECT rule, fraction, CAST(multiple AS DOUBLE) AS multiple, structure, seed FROM {values(rows)} g({RUN}))"


def same(a: str, b: str, columns: str = RUN) -> str:
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns.split(", "))


UNIFORM = "CAST(round(2 * multiple * w * (('0x' || substr(md5('delay:' || seed || ':' || seq), 1, 8))::BIGINT / 4294967296.0::DOUBLE)) AS BIGINT)"
NORMAL = "sqrt(-2 * ln((('0x' || substr(md5('delay:' || seed || ':' || seq), 1, 8))::BIGINT + 1) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (('0x' || substr(md5('delay:' || seed || ':' || seq), 9, 8))::BIGINT / 4294967296.0::DOUBLE))"
FIXED = "CAST(round(multiple * w) AS BIGINT)"
DELAYS = {"fixed": FIXED, "burst": FIXED, "uniform": UNIFORM, "lognormal": f"CAST(round(exp(ln(multiple * w) - 0.5 + {NORMAL})) AS BIGINT)"}


def chosen(rules=CATALOGUE, **options) -> str:
    return f"""{base(rules)}, {grid(rules, **options)},
spread AS (SELECT p.*, fraction, multiple, structure, seed, structure <> 'targeted' OR pid % 7 = 0 AS eligible, md5('pick:' || seed || ':' || seq) AS h
           FROM proj p JOIN grid g USING (rule)),
sized AS (SELECT *, count(*) FILTER (eligible) OVER (PARTITION BY {RUN}) AS ne,
                 row_number() OVER (PARTITION BY {RUN}, eligible ORDER BY h, seq) AS rk FROM spread),
chosen AS (SELECT *, eligible AND rk <= greatest(1, floor(ne * fraction)) AS chosen FROM sized WHERE ne > 0)"""


def burst(rules=CATALOGUE, **options) -> str:
    return f"""{base(rules)}, {grid(rules, **options)},
spread AS (SELECT p.*, fraction, multiple, structure, seed, (t - min(t) OVER (PARTITION BY {RUN})) // w AS slot, count(*) OVER (PARTITION BY {RUN}) AS nn FROM proj p JOIN grid g USING (rule)),
counted AS (SELECT {RUN}, slot, count(*) AS c, any_value(nn) AS nn FROM spread GROUP BY {RUN}, slot),
slots AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY {RUN} ORDER BY md5('slot:' || seed || ':' || slot), slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < greatest(1, floor(nn * fraction)) AS take FROM counted),
chosen AS (SELECT p.*, s.take AS chosen FROM spread p JOIN slots s ON {same('p', 's', RUN + ', slot')})"""


def marked(rules=CATALOGUE, clock: str = "M1", delay: str = "fixed", **options) -> str:
    occ = "t" if clock == "M1" else "arr"
    return f"""{(burst if delay == 'burst' else chosen)(rules, **options)},
arrived AS (SELECT *, t + CASE WHEN chosen AND structure <> 'delete' THEN {DELAYS[delay]} ELSE 0 END AS arr
            FROM chosen WHERE NOT (structure = 'delete' AND chosen)),
seen AS (SELECT *, {occ} AS occ FROM arrived),
marked AS (SELECT *, coalesce(occ < max(occ) OVER (PARTITION BY {RUN} ORDER BY arr, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - w, false) AS late FROM seen)"""


def sweep(rules=CATALOGUE, **options) -> str:
    return f"""{marked(rules, **options)},
kept AS (SELECT * FROM marked WHERE NOT late),
found AS (SELECT {RUN}, key, min(occ) AS first_t FROM {hits('kept', RUN, 'occ')} WHERE hit GROUP BY {RUN}, key),
drops AS (SELECT {RUN}, count(*) AS rows, count(*) FILTER (late) AS dropped_late FROM marked GROUP BY {RUN}),
keys AS (SELECT {RUN}, count(*) AS keys FROM found GROUP BY {RUN}),
losses AS (SELECT {', '.join('g.' + c for c in RUN.split(', '))}, count(*) AS keys_lost FROM grid g JOIN known k USING (rule)
           WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.rule = g.rule AND f.fraction = g.fraction AND f.multiple IS NOT DISTINCT FROM g.multiple
                             AND f.structure = g.structure AND f.seed = g.seed AND f.key = k.key) GROUP BY ALL),
sweep AS (SELECT d.*, coalesce(k.keys, 0) AS keys, coalesce(l.keys_lost, 0) AS keys_lost, b.baseline_keys,
                 CASE WHEN b.baseline_keys > 0 THEN coalesce(l.keys_lost, 0) / CAST(b.baseline_keys AS DOUBLE) END AS key_reduction
          FROM drops d LEFT JOIN keys k ON {' AND '.join(f'd.{c} IS NOT DISTINCT FROM k.{c}' for c in RUN.split(', '))}
          LEFT JOIN losses l ON {' AND '.join(f'd.{c} IS NOT DISTINCT FROM l.{c}' for c in RUN.split(', '))} JOIN basis b ON b.rule = d.rule)"""


def greedy(source: str, run: str, x: str = "t") -> str:
    """CTE ``picks``: the alerts of streams in order, as row numbers."""
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM p.{k}" for k in [*run.split(", "), "key"])
    return f"""cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {run}, key ORDER BY {x}, seq) AS rn FROM {hits(source, run, x)}) WHERE hit),
picks AS (SELECT {run}, key, min(rn) AS rn FROM cand GROUP BY {run}, key
          UNION ALL SELECT {', '.join('p.' + k for k in run.split(', '))}, p.key, min(c.rn) FROM picks p JOIN cand c ON {on} AND c.rn >= p.rn + c.n GROUP BY ALL)"""


def fold(source: str, run: str, order: str) -> str:
    """CTE ``fired``: the alerts of any stream of (run, key, occ, w, n), event by event: each key's
    held times as a list, the new one put in, the largest span that holds it, and a new start where
    that has n. Times too old for any later span go."""
    return f"""told AS (SELECT *, dense_rank() OVER (ORDER BY {run}, key) AS gid, row_number() OVER (PARTITION BY {run}, key ORDER BY {order}) AS rn FROM {source}),
folded AS (SELECT DISTINCT gid, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS held, false AS fires FROM told
           UNION ALL SELECT gid, rn, CASE WHEN best >= n THEN [] ELSE h END, best >= n FROM
           (SELECT *, list_max([len(list_filter(h, lambda y: y >= a AND y <= a + w)) FOR a IN h IF a >= occ - w AND a <= occ]) AS best FROM
            (SELECT e.gid, e.rn, e.occ, e.w, e.n, list_sort(list_append(list_filter(f.held, lambda z: z >= list_max(f.held) - 2 * e.w), e.occ)) AS h
             FROM folded f JOIN told e ON e.gid = f.gid AND e.rn = f.rn + 1))),
fired AS (SELECT e.* FROM folded f JOIN told e USING (gid, rn) WHERE f.fires)"""


def alert_sweep(rules=CATALOGUE, **options) -> str:
    """CTE ``records``: the sweep with alerts, as recursive SQL."""
    return f"""{sweep(rules, **options)},
streams AS (SELECT {RUN}, key, occ, arr, seq, w, n FROM kept UNION ALL SELECT rule, NULL, NULL, 'base', NULL, key, t, t, seq, w, n FROM proj),
{fold('streams', RUN, 'arr, seq')},
counts AS (SELECT {RUN}, count(*) AS alerts FROM fired GROUP BY {RUN}),
records AS (SELECT s.*, coalesce(a.alerts, 0) AS alerts, coalesce(b.alerts, 0) AS baseline_alerts, coalesce(b.alerts, 0) - coalesce(a.alerts, 0) AS alerts_lost,
                   (coalesce(b.alerts, 0) - coalesce(a.alerts, 0)) / CAST(nullif(b.alerts, 0) AS DOUBLE) AS alert_reduction
            FROM sweep s LEFT JOIN counts a ON {same('a', 's')} LEFT JOIN counts b ON b.structure = 'base' AND b.rule = s.rule)"""


def buffers(sizes, rules, **options) -> str:
    """CTE ``rel``: the rows of the runs behind each buffer, with the arrival that releases them."""
    return f"""{marked(rules, structures=('random',), **options)},
probe AS (SELECT s.*, CAST(b * w AS BIGINT) AS buffer, CAST(b AS DOUBLE) AS buffer_windows FROM seen s, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in sizes)}]) AS b)),
gates AS (SELECT {RUN}, arr AS gate_arr, min(seq) AS gate_seq FROM seen GROUP BY {RUN}, arr),
rel AS (SELECT p.*, CASE WHEN gate_arr IS NOT NULL THEN greatest(gate_arr, p.arr) END AS released,
               CASE WHEN gate_arr > p.arr THEN gate_seq WHEN gate_arr = p.arr THEN greatest(gate_seq, p.seq) WHEN gate_arr < p.arr THEN p.seq END AS rel_seq
        FROM probe p ASOF LEFT JOIN gates g ON {' AND '.join(f'p.{c} = g.{c}' for c in RUN.split(', '))} AND p.occ + p.buffer <= g.gate_arr)"""


CELL = RUN + ", buffer_windows"


def mitigation(sizes, rules, **options) -> str:
    """CTE ``cells``: a record per run and buffer."""
    return f"""{buffers(sizes, rules, **options)},
judged AS (SELECT *, coalesce(occ < max(occ) OVER (PARTITION BY {CELL} ORDER BY released NULLS LAST, rel_seq, occ, arr, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - w, false) AS late FROM rel),
kept AS (SELECT * FROM judged WHERE NOT late),
streams AS (SELECT {CELL}, key, occ, released, rel_seq, arr, seq, w, n FROM kept UNION ALL SELECT rule, NULL, NULL, 'base', NULL, NULL, key, t, t, seq, t, seq, w, n FROM proj),
{fold('streams', CELL, 'released NULLS LAST, rel_seq, occ, arr, seq')},
counts AS (SELECT {CELL}, count(*) AS alerts FROM fired GROUP BY {CELL}),
found AS (SELECT DISTINCT {CELL}, key FROM {hits('kept', CELL, 'occ')} WHERE hit),
missing AS (SELECT {', '.join('c.' + x for x in CELL.split(', '))}, count(*) FILTER (NOT EXISTS (SELECT 1 FROM found f WHERE {same('f', 'c', CELL)} AND f.key = k.key)) AS keys_lost, count(*) AS baseline_keys
            FROM (SELECT DISTINCT {CELL} FROM judged) c JOIN known k USING (rule) GROUP BY ALL),
drops AS (SELECT {CELL}, count(*) FILTER (late) AS dropped_late, max(arr - t) AS max_delay FROM judged GROUP BY {CELL}),
cells AS (SELECT d.*, coalesce(m.keys_lost, 0) AS keys_lost, coalesce(m.baseline_keys, 0) AS baseline_keys, coalesce(a.alerts, 0) AS alerts, b.alerts AS baseline_alerts,
                 b.alerts - coalesce(a.alerts, 0) AS alerts_evaded, (b.alerts - coalesce(a.alerts, 0)) / CAST(b.alerts AS DOUBLE) AS evasion_remaining
          FROM drops d LEFT JOIN missing m ON {same('m', 'd', CELL)} LEFT JOIN counts a ON {same('a', 'd', CELL)} JOIN counts b ON b.structure = 'base' AND b.rule = d.rule)"""


PID_RULES = pid_rules()
