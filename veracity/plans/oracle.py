"""Pieces of DuckDB SQL that the expected results of the queries share: the views of sources.adapters, and
the rounding both engines apply."""

from __future__ import annotations

import re

from ..operators.registry import BOOTSTRAP, DEV_FRACTION, SEED, SIGNALS, TARGETS

#: Newton rounds of the calibrator, unrolled.
ROUNDS = 25


def shown(x: str, places: int = 6) -> str:
    """A number as results give it: rounded, never -0, null unless finite."""
    return f"CASE WHEN isfinite({x}) THEN CASE WHEN round({x}, {places}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({x}, {places}) END END"


_TEXT = "coalesce(text, '')"
_COUNT = "CAST(length(t) - length(regexp_replace(t, '{}', '', 'g')) AS DOUBLE)"
_TASK = "CASE WHEN {} % 2 = 0 THEN 'nq_open' ELSE 'gsm8k' END"

#: One document with its counts, label and task.
STAT = f"""stat AS (SELECT doc_id, n_chars, CAST(length(t) AS DOUBLE) AS n, {_COUNT.format(' ')} AS spaces, {_COUNT.format('[#*$%&|<>!?]')} AS symbols,
  {_COUNT.format(chr(92) + 'n')} AS lines, {_COUNT.format('[0-9]')} AS digits, ok, {_TASK.format('doc_id')} AS task
  FROM (SELECT d.doc_id, n_chars, {_TEXT} AS t, quality = 1 AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id))"""

_NAN = "CAST('NaN' AS DOUBLE)"
_SPAN = f"CASE WHEN doc_id % 5 = 0 THEN {_NAN} ELSE {{}} END"
VALUES = {
    "mean_entropy": "n_chars / CAST(1000 AS DOUBLE)",
    "max_entropy": "symbols / greatest(n, 1e0)",
    "log_perplexity": "(doc_id % 97) / CAST(97 AS DOUBLE)",
    "mean_max_prob": "1e0 - symbols / greatest(n, 1e0)",
    "min_margin": "spaces / greatest(n, 1e0)",
    "seq_prob": "1e0",
    "answer_mean_entropy": _SPAN.format("(n % 101) / 1e2"),
    "answer_max_entropy": _SPAN.format("2e0 * symbols / greatest(n, 1e0)"),
    "answer_min_margin": _SPAN.format("digits / greatest(n, 1e0)"),
    "semantic_entropy": "1e2 * lines / (1e0 + n)",
    "lexical_entropy": "symbols",
    "self_consistency": "1e0 / (1e0 + symbols)",
    "num_distinct_answers": "lines",
    "verbalized_confidence": _NAN,
}

#: The registry, as far as queries read it.
REGISTRY = "registry(ordinal, signal, up, tier) AS (VALUES " + ", ".join(f"({i}, '{n}', {up}, '{tier}')" for i, n, up, _, tier in SIGNALS) + ")"

#: Dev and test by hash order within a task.
SPLIT = f"""split AS MATERIALIZED (SELECT *, CASE WHEN position <= round_even(n_task * {DEV_FRACTION}, 0) THEN 'dev' ELSE 'test' END AS split FROM (
  SELECT *, md5('{SEED}-' || doc_id) AS pos, row_number() OVER (PARTITION BY task ORDER BY md5('{SEED}-' || doc_id), doc_id) AS position, count(*) OVER (PARTITION BY task) AS n_task FROM stat))"""

#: All signals as rows, u oriented.
LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, task, ok, pos, split, '{k}' AS signal, CAST({v} AS DOUBLE) AS value FROM split" for k, v in VALUES.items()) + ")"

#: Signals that vary among the finite values of the rows chosen.
USABLE = """usable AS (SELECT task, signal, count(*) AS n_finite FROM long WHERE isfinite(value){where} GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT value) >= 2)"""

#: Finite, oriented values of usable signals; on test rows, signals that vary there.
U = """u AS MATERIALIZED (SELECT l.doc_id, l.task, l.signal, r.ordinal, r.tier, CASE WHEN r.up THEN value ELSE -value END + 0e0 AS u, ok, pos, split
  FROM long l JOIN registry r USING (signal) JOIN usable USING (task, signal) WHERE isfinite(value))"""

AUROC = """auroc AS (SELECT task, signal, CASE WHEN p > 0 AND n > 0 THEN (s - p * (p + 1) / 2e0) / (CAST(p AS DOUBLE) * n) END AS auroc, p AS n_wrong, n AS n_right FROM (
  SELECT task, signal, sum(CASE WHEN NOT ok THEN r ELSE 0 END) AS s, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS p, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (
    SELECT task, signal, ok, rank() OVER (PARTITION BY task, signal ORDER BY u) + (count(*) OVER (PARTITION BY task, signal, u) - 1) / 2e0 AS r FROM {rows}) GROUP BY ALL))"""

CURVE = """curve AS MATERIALIZED (SELECT task, signal, doc_id, u, pos, rank, wrong / CAST(rank AS DOUBLE) AS risk, rank / CAST(n AS DOUBLE) AS coverage, wrong FROM (
  SELECT *, row_number() OVER w AS rank, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS wrong, count(*) OVER (PARTITION BY task, signal) AS n
  FROM {rows} WINDOW w AS (PARTITION BY task, signal ORDER BY u, pos)))"""


def signals(where: str = "", more: list[str] | None = None) -> str:
    """WITH clause up to u and what else is given; where: the rows that decide which signals count."""
    return "WITH RECURSIVE " + ",\n".join([STAT, REGISTRY, SPLIT, LONG, USABLE.format(where=where), U, *(more or [])]) + "\n"


ON_TEST = " AND split = 'test'"
DEV, TEST = "dev AS (SELECT * FROM u WHERE split = 'dev')", "test AS (SELECT * FROM u WHERE split = 'test')"


def calibrated() -> list[str]:
    """CTEs that end in `model` (w, b, base by group) and `conf` (test rows with their confidence)."""
    out = ["sums AS (SELECT task, signal, count(*) AS n, CAST(sum(CAST(ok AS INT)) AS DOUBLE) AS k FROM dev GROUP BY ALL)", "n0 AS MATERIALIZED (SELECT task, signal, 0e0 AS w, ln(k / (n - k)) AS b FROM sums WHERE k >= 2 AND n - k >= 2)"]
    for i in range(1, ROUNDS + 1):
        out.append(f"""n{i} AS MATERIALIZED (SELECT task, signal, w - greatest(-4e0, least(4e0, (hbb * (gw + w) - hwb * gb) / ((hww + 1e0) * hbb - hwb * hwb))) AS w,
  b - greatest(-4e0, least(4e0, ((hww + 1e0) * gb - hwb * (gw + w)) / ((hww + 1e0) * hbb - hwb * hwb))) AS b FROM (
  SELECT task, signal, any_value(w) AS w, any_value(b) AS b, sum((p - y) * u) AS gw, sum(p - y) AS gb, sum(p * (1 - p) * u * u) AS hww, sum(p * (1 - p) * u) AS hwb, sum(p * (1 - p)) AS hbb FROM (
    SELECT task, signal, w, b, u, CAST(ok AS INT) AS y, 1e0 / (1e0 + exp(-(w * u + b))) AS p FROM dev JOIN n{i - 1} USING (task, signal)) GROUP BY ALL))""")
    out.append(f"model AS (SELECT task, signal, w, b, k / n AS base FROM sums LEFT JOIN n{ROUNDS} USING (task, signal))")
    out.append("conf AS MATERIALIZED (SELECT task, signal, doc_id, u, pos, ok, round(coalesce(1e0 / (1e0 + exp(-(w * u + b))), base, 0.5e0), 9) AS conf FROM test LEFT JOIN model USING (task, signal))")
    return out


#: Bins of conf: fixed edges are the array's own doubles, equal-mass edges interpolated quantiles.
EDGES = {
    "fixed_width": "edges AS (SELECT DISTINCT task, signal, [" + ", ".join(f"{i} * 0.1e0" for i in range(1, 10)) + "] AS inner_ FROM conf)",
    "equal_mass": "edges AS (SELECT task, signal, list_sort(list_distinct(list_filter([" + ", ".join(f"quantile_cont(conf, {i / 10})" for i in range(1, 10)) + "], lambda q: q > 0 AND q < 1))) AS inner_ FROM conf GROUP BY ALL)",
}
BINS = """bins AS (SELECT task, signal, bin, count(*) AS n, avg(conf) AS mean_conf, avg(CAST(ok AS INT)) AS accuracy, any_value(inner_) AS inner_ FROM (
  SELECT task, signal, conf, ok, inner_, len(list_filter(inner_, lambda e: e <= conf)) AS bin FROM conf JOIN edges USING (task, signal)) GROUP BY task, signal, bin)"""
ECE = "ece AS (SELECT task, signal, sum(n * abs(mean_conf - accuracy)) / sum(n) AS ece, max(abs(mean_conf - accuracy)) AS mce FROM bins GROUP BY ALL)"


#: Mixing of a node's hash and a replicate to a number in (0, 1), in steps of 32 bits.
_UNIT = """SELECT * EXCLUDE (x), (xor(x, x >> 15) + 0.5e0) / 4294967296e0 AS unit FROM (SELECT * EXCLUDE (x), (xor(x, x >> 15) * 1935289751) & 4294967295 AS x FROM (
    SELECT * EXCLUDE (x), (xor(x, x >> 16) * 569420461) & 4294967295 AS x FROM (SELECT *, (('0x' || substr(md5({name}), 1, 8))::BIGINT + rep * 2654435769) & 4294967295 AS x FROM {rows})))"""


def draws(rows: str, replicates: int = BOOTSTRAP) -> list[str]:
    """CTEs that end in `drawn`: the rows with their count k in each replicate (rep) that drew them, by binomial splitting: between the classes of
    a group, then between halves of a class's rows in the order of their values."""
    root, node = f"'{SEED}-' || n || '-' || n_wrong", f"'{SEED}-' || n || '-' || n_wrong || '-' || class || '-' || low || '-' || high"
    return [
        f"""placed AS MATERIALIZED (SELECT *, CAST(ok AS INT) AS class, CASE WHEN ok THEN rank - wrong_so_far - 1 ELSE wrong_so_far - 1 END AS idx FROM (
  SELECT *, row_number() OVER w AS rank, CAST(sum(1 - CAST(ok AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS wrong_so_far, count(*) OVER g AS n, CAST(sum(1 - CAST(ok AS INT)) OVER g AS BIGINT) AS n_wrong
  FROM {rows} WINDOW w AS (PARTITION BY task, signal ORDER BY u, pos), g AS (PARTITION BY task, signal)))""",
        "kinds AS MATERIALIZED (SELECT DISTINCT n, n_wrong FROM placed)",
        """tree AS (SELECT DISTINCT size FROM (SELECT n_wrong AS size FROM kinds UNION ALL SELECT n - n_wrong FROM kinds)
  UNION SELECT DISTINCT CASE WHEN side = 0 THEN size // 2 ELSE size - size // 2 END FROM tree, (VALUES (0), (1)) AS s(side) WHERE size > 1)""",
        "shapes AS (SELECT size // 2 AS part, size FROM tree WHERE size > 1 UNION SELECT size - size // 2, size FROM tree WHERE size > 1 UNION SELECT n_wrong, n FROM kinds WHERE n_wrong > 0 AND n_wrong < n)",
        """ways AS (SELECT d, j, coalesce(sum(CASE WHEN j > 0 THEN ln((d - j + 1) / CAST(j AS DOUBLE)) END) OVER (PARTITION BY d ORDER BY j ROWS UNBOUNDED PRECEDING), 0e0) AS ways
  FROM range(0, (SELECT max(n) + 1 FROM kinds)) AS a(d), LATERAL (SELECT unnest(range(0, d + 1)) AS j))""",
        """reach AS (SELECT part, size, d, j, sum(exp(ways + j * ln(part / CAST(size AS DOUBLE)) + (d - j) * ln(1 - part / CAST(size AS DOUBLE)))) OVER (PARTITION BY part, size, d ORDER BY j ROWS UNBOUNDED PRECEDING) AS reach FROM shapes, ways)""",
        "shares AS MATERIALIZED (SELECT part, size, d, j, CASE WHEN j = 0 THEN -1e0 ELSE lag(reach) OVER w END AS above, CASE WHEN j = d THEN 2e0 ELSE reach END AS reach FROM reach WINDOW w AS (PARTITION BY part, size, d ORDER BY j))",
        f"""roots AS MATERIALIZED (SELECT u.n, u.n_wrong, rep, CASE WHEN n_wrong = 0 THEN 0 WHEN n_wrong = u.n THEN n ELSE j END AS d FROM ({_UNIT.format(name=root, rows=f"(SELECT * FROM kinds, range(0, {replicates}) AS r(rep))")}) u
  LEFT JOIN shares s ON s.part = n_wrong AND s.size = n AND s.d = n AND unit > above AND unit <= reach)""",
        f"""nodes AS (SELECT n, n_wrong, rep, 0 AS class, CAST(0 AS BIGINT) AS low, n_wrong AS high, d FROM roots WHERE n_wrong > 0 UNION ALL SELECT n, n_wrong, rep, 1, 0, n - n_wrong, n - d FROM roots WHERE n_wrong < n
  UNION ALL SELECT n, n_wrong, rep, class, CASE WHEN side = 0 THEN low ELSE (low + high) // 2 END, CASE WHEN side = 0 THEN (low + high) // 2 ELSE high END, CASE WHEN side = 0 THEN j ELSE u.d - j END
  FROM ({_UNIT.format(name=node, rows="(SELECT * FROM nodes WHERE high - low > 1 AND d > 0)")}) u JOIN shares s ON s.part = (low + high) // 2 - low AND s.size = high - low AND s.d = u.d AND unit > above AND unit <= reach, (VALUES (0), (1)) AS t(side))""",
        "drawn AS MATERIALIZED (SELECT p.*, rep, d AS k FROM placed p JOIN (SELECT * FROM nodes WHERE high - low = 1 AND d > 0) t ON p.n = t.n AND p.n_wrong = t.n_wrong AND p.class = t.class AND p.idx = t.low)",
    ]


#: `each`: the value of every replicate (task, signal, rep), from `drawn`.
EACH = {
    "auroc": [
        "ties AS (SELECT task, signal, rep, u, sum(CASE WHEN ok THEN 0 ELSE k END) AS wrong, sum(CASE WHEN ok THEN k ELSE 0 END) AS right_ FROM drawn GROUP BY ALL)",
        "run AS (SELECT *, coalesce(sum(right_) OVER (PARTITION BY task, signal, rep ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ties)",
        "each AS (SELECT task, signal, rep, sum(wrong * (below + right_ / 2e0)) / (CAST(sum(wrong) AS DOUBLE) * sum(right_)) AS value FROM run GROUP BY ALL HAVING sum(wrong) > 0 AND sum(right_) > 0)",
    ],
    # Every copy is a row here.
    "aurc": [
        "copies AS (SELECT task, signal, rep, rank, copy, ok FROM drawn, LATERAL (SELECT unnest(range(0, k)) AS copy))",
        "each AS (SELECT task, signal, rep, avg(wrong / CAST(place AS DOUBLE)) AS value FROM (SELECT task, signal, rep, row_number() OVER w AS place, sum(1 - CAST(ok AS INT)) OVER (w ROWS UNBOUNDED PRECEDING) AS wrong FROM copies WINDOW w AS (PARTITION BY task, signal, rep ORDER BY rank, copy)) GROUP BY ALL)",
    ],
    "brier": ["each AS (SELECT task, signal, rep, sum(k * (conf - CAST(ok AS INT)) * (conf - CAST(ok AS INT))) / sum(k) AS value FROM drawn GROUP BY ALL)"],
    "ece": ["each AS (SELECT task, signal, rep, sum(abs(gap)) / sum(n) AS value FROM (SELECT task, signal, rep, len(list_filter([" + ", ".join(f"{i} * 0.1e0" for i in range(1, 10)) + "], lambda e: e <= conf)) AS bin, sum(k * (conf - CAST(ok AS INT))) AS gap, sum(k) AS n FROM drawn GROUP BY ALL) GROUP BY ALL)"],
}


def bootstrap_values(rows: str, replicates: int = BOOTSTRAP, metric: str = "auroc") -> list[str]:
    """CTEs that end in `each`, the metric's value in every replicate."""
    return [*draws(rows, replicates), *EACH[metric]]


def poisson_values(rows: str, replicates: int = BOOTSTRAP) -> list[str]:
    """bootstrap_values() of the AUROC by independent Poisson(1) counts of the rows."""
    steps, total, p = [], 0.0, 0.36787944117144233
    for i in range(1, 12):
        total, p = total + p, p / i
        steps.append(f"CASE WHEN unit >= {total!r}e0 THEN 1 ELSE 0 END")
    drawn = f"SELECT *, (('0x' || substr(md5('{SEED}-' || rep || '-' || pos), 1, 8))::BIGINT + 0.5e0) / 4294967296e0 AS unit FROM {rows}, range(0, {replicates}) AS r(rep)"
    return [f"drawn AS MATERIALIZED (SELECT *, {' + '.join(steps)} AS k FROM ({drawn}) WHERE unit >= 0.36787944117144233e0)", *EACH["auroc"]]


def both_errors() -> list[str]:
    """CTEs ece_fixed_width and ece_equal_mass, from conf."""
    out = []
    for strategy, edges in EDGES.items():
        names = [re.sub(r"\b(edges|bins)\b", rf"\1_{strategy}", part) for part in (edges, BINS, ECE)]
        out += [*names[:2], re.sub("^ece AS", f"ece_{strategy} AS", names[2])]
    return out


LADDER = "ladder(task, target) AS (VALUES " + ", ".join(f"('{t}', {x}e0)" for t, xs in TARGETS.items() for x in xs) + ")"

#: Samples of a customer's orders or a user's events.
SAMPLES = "samples AS (SELECT o_custkey AS prompt_id, o_orderkey AS sample_idx, {answer} AS answer, -o_totalprice / 1e5 AS logp FROM orders)"
USERS = "samples AS (SELECT user_id AS prompt_id, event_id AS sample_idx, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS answer, -value / 1e2 AS logp FROM events)"

#: Steps of an order's line items with their softmax.
STEPS = """steps AS MATERIALIZED (SELECT seq_id, step, span_start, span_end, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) AS entropy, greatest(p0, p1, p2) AS max_probability,
  greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)) AS margin, ln(CASE chosen WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS chosen_log_probability FROM (
  SELECT *, exp(a - top) / z AS p0, exp(b - top) / z AS p1, exp(c - top) / z AS p2 FROM (SELECT *, exp(a - top) + exp(b - top) + exp(c - top) AS z FROM (SELECT *, greatest(a, b, c) AS top FROM (
    SELECT l_orderkey AS seq_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS step, l_quantity / 10 AS a, l_discount * 30 AS b, l_tax * 30 AS c,
      l_linenumber % 3 AS chosen, CASE WHEN l_orderkey % 4 <> 0 THEN 1 END AS span_start, CASE WHEN l_orderkey % 4 <> 0 THEN 3 END AS span_end FROM lineitem)))))"""
