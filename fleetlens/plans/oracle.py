"""DuckDB SQL for the queries of the catalog, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from fleetlens.operators.profile import LAGS, METRICS
from fleetlens.operators.rules import GATE_FAILED, NO_MATCH, RULES, TAGS

EVENTS = "SELECT user_id AS entity, epoch_us(ts) AS us, value AS v, event_id AS t1, 0 AS t2 FROM events WHERE user_id IS NOT NULL"
ITEMS = "SELECT l_suppkey AS entity, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, CAST(l_quantity AS DOUBLE) AS v, l_orderkey AS t1, l_linenumber AS t2 FROM lineitem"
ORDERS = "SELECT o_custkey AS entity, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS us, CAST(o_totalprice AS DOUBLE) AS v, o_orderkey AS t1, 0 AS t2 FROM orders"
NULLS = "SELECT user_id AS entity, epoch_us(ts) AS us, CASE WHEN event_id % 3 <> 0 THEN value END AS v, event_id AS t1, 0 AS t2 FROM events"
DAY = 86_400_000_000


def slots(width: int | str, value: str = "avg(v)", source: str = EVENTS) -> str:
    return f"""
s AS ({source}), o AS (SELECT entity, CAST(floor(min(us) / {DAY}.0) AS BIGINT) * {DAY} AS origin FROM s GROUP BY entity),
z AS (SELECT s.*, origin, CAST(floor((us - origin) / CAST({width} AS DOUBLE)) AS BIGINT) AS slot FROM s JOIN o USING (entity)),
g AS (SELECT entity, origin, slot, {value} AS v, count(v) > 0 AS observed FROM z GROUP BY entity, origin, slot)"""


def dense(width: int, value: str, empty: str) -> str:
    return f"""{slots(width, value)},
b AS (SELECT entity, origin, min(slot) AS a, max(slot) AS b FROM g GROUP BY entity, origin),
e AS (SELECT entity, origin, unnest(generate_series(a, b)) AS slot FROM b),
d AS (SELECT e.entity, e.origin + e.slot * {width} AS slot_us, CASE WHEN g.slot IS NULL THEN {empty} ELSE g.v END AS v, coalesce(g.observed, false) AS was_observed FROM e LEFT JOIN g ON e.entity = g.entity AND e.slot = g.slot)"""


def resampled(width: int, value: str, empty: str = "NULL") -> str:
    return f"WITH {dense(width, value, empty)} SELECT entity, make_timestamp(slot_us) AS slot_start, round(v, 6) AS v, was_observed FROM d"


def metrics(rows: str) -> str:
    """CTEs ending in `m`: unrounded metrics of `rows`, a query of (entity, us, v, t1, t2)."""
    lagged = ", ".join(f"sum(y * y{k}) AS a{k}" for k in LAGS)
    acf = ", ".join(f"coalesce(abs(a{k} / nullif(ss, 0)), 0)" for k in LAGS)
    return f"""
src AS ({rows}),
st AS (SELECT entity, count(*) AS row_count, count(v) AS n, avg(v) AS mu, stddev_pop(v) AS sd0, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(us) AS times, min(us) AS u0, max(us) AS u1 FROM src GROUP BY entity),
ob AS (SELECT src.*, v - mu AS y, row_number() OVER w - 1 AS i, lag(v) OVER w AS pv FROM src JOIN st USING (entity) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY us NULLS LAST, t1, t2)),
ol AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS y{k}" for k in LAGS)}, sum(CASE WHEN pv IS NULL OR pv <> v THEN 1 ELSE 0 END) OVER w AS island FROM ob WINDOW w AS (PARTITION BY entity ORDER BY i)),
ac AS (SELECT entity, sum(y * y) AS ss, {lagged}, covar_pop(CAST(i AS DOUBLE), v) AS cv, var_pop(CAST(i AS DOUBLE)) AS vi, min_by(v, i) AS v0, stddev_pop(v - pv) AS dsd, count(v - pv) AS dn FROM ol GROUP BY entity),
fl AS (SELECT entity, sum(CASE WHEN c >= 3 THEN c ELSE 0 END) AS flat FROM (SELECT entity, island, count(*) AS c FROM ol GROUP BY entity, island) GROUP BY entity),
ct AS (SELECT ob.entity, count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outl, count(*) FILTER (abs(v - pv) > 3.0 * dsd) AS spk FROM ob JOIN st USING (entity) JOIN ac USING (entity) GROUP BY ob.entity),
gp AS (SELECT entity, (us - lag(us) OVER (PARTITION BY entity ORDER BY us NULLS LAST, t1, t2)) / 1e6 AS gap FROM src),
gs AS (SELECT entity, median(gap) AS mg, stddev_pop(gap) AS gsd, max(gap) AS xg FROM gp GROUP BY entity),
m AS (SELECT st.entity, row_count, n AS effective_row_count, 1 - n / row_count AS missing_rate,
  CASE WHEN mu = 0 THEN least(1, (CASE WHEN lo = hi THEN 0 ELSE sd0 END) / (abs(v0) + 1e-9)) ELSE (CASE WHEN lo = hi THEN 0 ELSE sd0 END / abs(mu)) / ((CASE WHEN lo = hi THEN 0 ELSE sd0 END / abs(mu)) + 1) END AS volatility,
  CASE WHEN n < 3 OR lo = hi THEN 0.0 ELSE least(1.0, abs(cv / sqrt(vi) / sd0)) END AS trend_strength,
  CASE WHEN n < 8 OR lo = hi THEN 0.0 ELSE least(1.0, greatest(0.0, {acf})) END AS seasonality_strength,
  CASE WHEN n < 4 OR q1 = q3 THEN 0.0 ELSE outl / n END AS outlier_ratio,
  CASE WHEN n < 3 OR NOT dsd > 0 THEN 0.0 ELSE spk / dn END AS spike_ratio,
  CASE WHEN n < 3 THEN 0.0 ELSE flat / n END AS flatline_ratio,
  CASE WHEN times < 3 THEN 0.0 WHEN mg <= 0 THEN 1.0 ELSE (gsd / mg) / (gsd / mg + 1) END AS sampling_irregularity,
  1.0::DOUBLE AS coverage_ratio,
  CASE WHEN times < 2 THEN 0.0 ELSE xg END AS max_gap_seconds,
  CASE WHEN times < 2 THEN CAST(times AS DOUBLE) ELSE times / greatest((u1 - u0) / {DAY}.0, 1 / 86400.0) END AS observation_density,
  CASE WHEN times < 2 THEN 0.0 ELSE greatest((u1 - u0) / {DAY}.0, 1 / 86400.0) END AS span_days
  FROM st LEFT JOIN ac USING (entity) LEFT JOIN fl USING (entity) LEFT JOIN ct USING (entity) LEFT JOIN gs USING (entity))"""


def _round(*names: str) -> str:
    return ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" for x in names)


def shown(rows: str, *names: str) -> str:
    return f"WITH {metrics(rows)} SELECT entity, row_count, effective_row_count, {_round(*names)} FROM m"


DENSE_DAYS = f"SELECT entity, slot_us AS us, v, 0 AS t1, 0 AS t2 FROM d"
DAILY_CTES = dense(DAY, "avg(v)", "NULL") + f""",
cov AS (SELECT entity, count(*) FILTER (was_observed) / count(*) AS coverage FROM d GROUP BY entity), {metrics(DENSE_DAYS)},
p AS (SELECT entity, row_count, effective_row_count, {_round(*[x for x in METRICS if x != "coverage_ratio"])}, round(coverage, 6) AS coverage_ratio FROM m JOIN cov USING (entity))"""
RAW_CTES = metrics(EVENTS) + f", p AS (SELECT entity, row_count, effective_row_count, {_round(*METRICS)} FROM m)"
ITEM_CTES = metrics(ITEMS) + f", p AS (SELECT entity, row_count, effective_row_count, {_round(*METRICS)} FROM m)"
SUM_CTES = dense(DAY, "coalesce(sum(v), 0.0)", "0.0") + f""",
cov AS (SELECT entity, count(*) FILTER (was_observed) / count(*) AS coverage FROM d GROUP BY entity), {metrics(DENSE_DAYS)},
p AS (SELECT entity, row_count, effective_row_count, {_round(*[x for x in METRICS if x != "coverage_ratio"])}, round(coverage, 6) AS coverage_ratio FROM m JOIN cov USING (entity))"""


def check(name: str, column: str, floor: bool, bound: float, decimals: int | None) -> str:
    op, good, bad = (">=", ">=", "below minimum") if floor else ("<=", "<=", "exceeds maximum")
    label = "effective rows" if decimals is None else column
    seen = f"CAST({column} AS VARCHAR)" if decimals is None else f"printf('%.{decimals}f', {column})"
    text = str(bound) if decimals is None else f"{bound:.{decimals}f}"
    return f"SELECT entity, '{name}' AS name, {column} {op} {bound} AS passed, '{label} ' || {seen} || CASE WHEN {column} {op} {bound} THEN ' {good} {text}' ELSE ' {bad} {text}' END AS message, CAST({bound} AS DOUBLE) AS threshold, CAST({column} AS DOUBLE) AS observed FROM p"


def checks(min_rows=30, missing=0.25, irregular=0.6, coverage=None, gap=None) -> str:
    parts = [check("min_rows", "effective_row_count", True, min_rows, None)]
    parts += [check(n, n, False, b, 3) for n, b in (("missing_rate", missing), ("outlier_ratio", 0.2), ("spike_ratio", 0.15), ("flatline_ratio", 0.5), ("sampling_irregularity", irregular))]
    if coverage is not None:
        parts.append(check("min_coverage_ratio", "coverage_ratio", True, coverage, 3))
    if gap is not None:
        parts.append(check("max_gap_seconds", "max_gap_seconds", False, gap, 1))
    return " UNION ALL ".join(x.replace("SELECT entity", f"SELECT entity, {i} AS place", 1) for i, x in enumerate(parts))


def gate_ctes(**limits) -> str:
    return f"c AS ({checks(**limits)}), q AS (SELECT entity, bool_and(passed) AS gate_passed, coalesce(string_agg(name, ',' ORDER BY place) FILTER (NOT passed), '') AS failures FROM c GROUP BY entity)"


#: The rules as SQL conditions on p, in the order of RULES.
CONDITIONS = (
    "coverage_ratio < 0.30 AND effective_row_count < 50",
    "coverage_ratio < 0.60 AND sampling_irregularity >= 0.35",
    "trend_strength < 0.25 AND seasonality_strength < 0.25 AND volatility < 0.40 AND NOT (coverage_ratio < 0.60 AND sampling_irregularity >= 0.35)",
    "volatility < 0.45 AND spike_ratio < 0.10 AND flatline_ratio < 0.35",
    "(trend_strength >= 0.20 OR seasonality_strength >= 0.20) AND volatility < 0.55 AND sampling_irregularity < 0.50",
    "effective_row_count >= 100 AND coverage_ratio >= 0.50 AND (seasonality_strength >= 0.30 OR trend_strength >= 0.30) AND volatility >= 0.25",
    "effective_row_count >= 60 AND effective_row_count < 250 AND coverage_ratio >= 0.50 AND (seasonality_strength >= 0.20 OR trend_strength >= 0.20) AND volatility < 0.70",
    "volatility >= 0.45 AND (spike_ratio >= 0.05 OR outlier_ratio >= 0.05) AND effective_row_count >= 80",
    "volatility >= 0.50 AND spike_ratio >= 0.08 AND effective_row_count >= 120",
)


def _matched() -> str:
    parts = [
        f"SELECT p.*, {r.priority} AS priority, '{r.model}' AS model, '{r.family}' AS family, '{r.reason}' AS reason, '{','.join(TAGS[r.model])}' AS tags FROM p WHERE {c}" + ("" if i == 0 else f" AND NOT ({CONDITIONS[0]})")
        for i, (r, c) in enumerate(zip(RULES, CONDITIONS, strict=True))
    ]
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY priority, model) - 1 AS place FROM ({' UNION ALL '.join(parts)}))"


MATCHED = _matched()


def advice(most: int) -> str:
    return f"""{MATCHED},
k AS (SELECT entity, string_agg(model, ',' ORDER BY place) AS models, min_by(model, place) AS best_model, count(*) AS n, min_by(reason, place) AS r1, max(CASE WHEN place = 1 THEN reason END) AS r2 FROM r WHERE place < {most} GROUP BY entity),
a AS (SELECT p.entity, coalesce(models, '') AS models, best_model, CASE WHEN n IS NULL THEN '{NO_MATCH}' WHEN n = 1 THEN r1 ELSE r1 || ' Also consider: ' || lower(rtrim(r2, '.')) || '.' END AS reason FROM p LEFT JOIN k USING (entity))"""


def selection(ctes: str, most: int = 3, **limits) -> str:
    return f"""WITH {ctes}, {gate_ctes(**limits)}, {advice(most)},
s9 AS (SELECT p.*, gate_passed, failures, CASE WHEN gate_passed THEN models ELSE '' END AS models, CASE WHEN gate_passed THEN best_model END AS best_model, CASE WHEN gate_passed THEN reason ELSE '{GATE_FAILED}' END AS reason FROM p JOIN q USING (entity) JOIN a USING (entity))"""


PARAMETERS = """
SELECT entity, model, 'coverage_ratio' AS parameter, CAST(round(coverage_ratio, 3) AS VARCHAR) AS value FROM r WHERE model = 'insufficient_data' OR priority = 8
UNION ALL SELECT entity, model, 'effective_row_count', CAST(effective_row_count AS VARCHAR) FROM r WHERE model = 'insufficient_data'
UNION ALL SELECT entity, model, 'strategy', 'last_value' FROM r WHERE model = 'naive'
UNION ALL SELECT entity, model, 'window', CAST(greatest(3, least(28, row_count // 10)) AS VARCHAR) FROM r WHERE model = 'moving_average'
UNION ALL SELECT entity, model, 'seasonal', CAST(seasonality_strength >= 0.20 AS VARCHAR) FROM r WHERE model = 'exponential_smoothing'
UNION ALL SELECT entity, model, 'trend', CAST(trend_strength >= 0.20 AS VARCHAR) FROM r WHERE model = 'exponential_smoothing'
UNION ALL SELECT entity, model, 'sequence_length', CAST(greatest(12, least(96, row_count // 5)) AS VARCHAR) FROM r WHERE model IN ('lstm', 'gru')
UNION ALL SELECT entity, model, 'residual_baseline', 'moving_average' FROM r WHERE model = 'residual_lstm'
UNION ALL SELECT entity, model, 'volatility_hint', CAST(round(volatility, 3) AS VARCHAR) FROM r WHERE model = 'residual_lstm'
UNION ALL SELECT entity, model, 'conv_filters', '32' FROM r WHERE model = 'cnn_lstm'
UNION ALL SELECT entity, model, 'spike_ratio_hint', CAST(round(spike_ratio, 3) AS VARCHAR) FROM r WHERE model = 'cnn_lstm'
"""

RUNS = """
per AS (SELECT event_type AS dataset, count(DISTINCT user_id) AS entities, count(*) AS rows FROM events GROUP BY event_type),
runs AS (SELECT dataset, mode, entities, rows, 12.34 AS span_days, entities / (speed * 10) AS elapsed_seconds, speed * 10 AS entities_per_second, round(rows % 10 / 10, 1) AS gate_pass_rate, round(rows % 7 / 20, 2) AS routing_diversity_rate, rows % 4 + 1 AS unique_models, 0.5 AS mean_coverage_ratio
  FROM per CROSS JOIN (VALUES ('plain_loop', 8.0::DOUBLE), ('profile_loop', 2.0::DOUBLE), ('full_stack', 1.0::DOUBLE)) AS t(mode, speed)),
kpi AS (SELECT dataset, entities, rows, 12.3::DOUBLE AS span_days, round(gate_pass_rate, 4) AS gate_pass_rate, round(1 - gate_pass_rate, 4) AS training_jobs_avoided_rate, CAST(round_even(entities * (1 - gate_pass_rate), 0) AS BIGINT) AS entities_blocked,
  entities - CAST(round_even(entities * (1 - gate_pass_rate), 0) AS BIGINT) AS entities_cleared, round(routing_diversity_rate, 4) AS routing_diversity_rate, unique_models AS unique_models_assigned, 10.0::DOUBLE AS screening_throughput_eps, 80.0::DOUBLE AS plain_loop_throughput_eps, 20.0::DOUBLE AS profile_loop_throughput_eps,
  0.5::DOUBLE AS mean_coverage_ratio, round(entities / 10.0 - entities / 20.0, 3)::DOUBLE AS orchestration_overhead_seconds, 8.0::DOUBLE AS profiling_cost_factor FROM runs WHERE mode = 'full_stack')"""

LOG = "log AS (SELECT user_id AS entity_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'completed' ELSE 'failed' END AS status, ts, event_id FROM events), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)"
DONE = "SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'"

SQL: dict[str, str] = {
    "entity_list": "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL",
    "entity_limit": "SELECT event_id, user_id, value FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25)",
    "skip_completed_anti": f"SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 15)",
    "skipped_count": f"SELECT count(*) AS skipped FROM ({DONE})",
    "batch_assignment": "SELECT o_custkey, (row_number() OVER (ORDER BY o_custkey) - 1) // 100 AS batch FROM (SELECT DISTINCT o_custkey FROM orders)",
    "entity_stats": "SELECT user_id, count(*) AS row_count, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id",
    "dataset_summary": f"SELECT count(*) AS entities, CAST(sum(n) AS BIGINT) AS rows, min(n) AS min_rows_per_entity, round(median(n), 6) AS median_rows_per_entity, max(n) AS max_rows_per_entity, round((max(b) - min(a)) / {DAY}.0, 6) AS span_days FROM (SELECT user_id, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id)",
    "head_rows_per_entity": "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5",
    "group_sizes": "SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_suppkey",
    "source_projection": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000",
    "coerced_times": "SELECT event_id, event_id % 7 <> 0 AS is_time FROM events",
    "null_rows_dropped": "SELECT event_id, value FROM events WHERE event_id % 5 <> 0 AND value IS NOT NULL",
    "unpivot_long": " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS entity_id, CAST({c} AS DOUBLE) AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "standard_names": "SELECT user_id AS entity_id, value, event_id FROM events",
    "rolling_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events",
    "zscore_anomaly": "WITH z AS (SELECT event_id, CASE WHEN stddev_samp(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w ELSE 0 END AS z FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(z, 6) AS zscore, abs(z) > 2.5 AS is_anomaly FROM z",
    "grid_mean": resampled(DAY, "avg(v)"),
    "grid_sum": resampled(DAY // 2, "coalesce(sum(v), 0.0)", "0.0"),
    "grid_last": resampled(DAY // 4, "arg_max(v, (us, t1)) FILTER (v IS NOT NULL)"),
    "grid_non_divisor_freq": resampled(7 * DAY // 24, "avg(v)"),
    "grid_coverage": f"WITH {slots(7 * DAY // 24)} SELECT entity, max(slot) - min(slot) + 1 AS grid_slot_count, count(*) FILTER (observed) AS observed_slot_count, round(count(*) FILTER (observed) / (max(slot) - min(slot) + 1), 6) AS coverage_ratio FROM g GROUP BY entity",
    "infer_freq": f"WITH s AS ({EVENTS}), d AS (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us) AS gap FROM s), f AS (SELECT entity, CAST(floor(median(gap)) AS BIGINT) AS f FROM d GROUP BY entity) SELECT entity, CASE WHEN f > 0 THEN f END AS freq_us, CASE " + " ".join(f"WHEN f = {w} THEN '{u}' WHEN f % {w} = 0 THEN CAST(f // {w} AS VARCHAR) || '{u}'" for u, w in (("D", DAY), ("h", DAY // 24), ("min", 60_000_000), ("s", 1_000_000), ("ms", 1000), ("us", 1))) + " END AS freq FROM f",
    "calendar_metrics": f"WITH {metrics(ORDERS)} SELECT entity, {_round('span_days', 'max_gap_seconds', 'observation_density')} FROM m",
    "resample_2h": "SELECT user_id, time_bucket(INTERVAL 2 HOURS, ts, TIMESTAMP '1970-01-01') AS slot_start, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL",
    "stream_grid": "SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS slot_start, round(avg(value), 6) AS mean_value, count(*) AS rows, count(value) > 0 AS observed FROM events GROUP BY user_id, slot_start",
    "profile_volatility": shown(EVENTS, "volatility"),
    "profile_trend": shown(EVENTS, "trend_strength"),
    "profile_seasonality": shown(EVENTS, "seasonality_strength"),
    "profile_outlier": shown(EVENTS, "outlier_ratio"),
    "profile_spike": shown(ITEMS, "spike_ratio"),
    "profile_flatline": shown(ITEMS, "flatline_ratio"),
    "profile_irregularity": shown(ORDERS, "sampling_irregularity"),
    "profile_missing": shown(NULLS, "missing_rate"),
    "profile_calendar": shown(EVENTS, "max_gap_seconds", "observation_density", "span_days"),
    "profile_full": shown(EVENTS, *METRICS),
    "profile_full_items": shown(ITEMS, *METRICS),
    "profile_full_orders": shown(ORDERS, *METRICS),
    "profile_with_nulls": shown(NULLS, *METRICS),
    "profile_on_grid": f"WITH {DAILY_CTES} SELECT entity, row_count, effective_row_count, {', '.join(METRICS)} FROM p",
    "profile_on_sum_grid": f"WITH {SUM_CTES} SELECT entity, row_count, effective_row_count, {', '.join(METRICS)} FROM p",
    "profile_inferred_grid": f"""WITH s AS ({EVENTS}), dd AS (SELECT entity, us - lag(us) OVER (PARTITION BY entity ORDER BY us) AS gap FROM s), f AS (SELECT entity, CAST(floor(median(gap)) AS BIGINT) AS width FROM dd GROUP BY entity),
o AS (SELECT entity, CAST(floor(min(us) / {DAY}.0) AS BIGINT) * {DAY} AS origin FROM s GROUP BY entity),
z AS (SELECT s.entity, v, CAST(floor((us - origin) / width) AS BIGINT) AS slot FROM s JOIN o USING (entity) JOIN f USING (entity)), g AS (SELECT entity, slot, avg(v) AS v FROM z GROUP BY entity, slot),
h AS (SELECT entity, max(slot) - min(slot) + 1 AS row_count, count(v) AS n, stddev_pop(v) / abs(avg(v)) AS c FROM g GROUP BY entity), {metrics(EVENTS)}
SELECT h.entity, h.row_count, h.n AS effective_row_count, round(1 - h.n / h.row_count, 6) AS missing_rate, round(h.n / h.row_count, 6) AS coverage_ratio, round(c / (c + 1), 6) AS volatility, round(m.sampling_irregularity, 6) AS raw_sampling_irregularity, round(m.max_gap_seconds, 6) AS raw_max_gap_seconds FROM h JOIN m USING (entity)""",
    "gate_checks": f"WITH {RAW_CTES}, c AS ({checks(coverage=0.5, gap=200000.0)}) SELECT entity, name, passed, message, threshold, observed FROM c",
    "gate_failures": f"WITH {RAW_CTES}, {gate_ctes()} SELECT entity, gate_passed, failures FROM q",
    "gate_evaluation_preset": f"WITH {ITEM_CTES}, {gate_ctes(min_rows=100, missing=0.55, irregular=0.8, coverage=0.15)} SELECT entity, gate_passed, failures FROM q",
    "rule_matches": f"WITH {RAW_CTES}, {MATCHED} SELECT entity, CAST(place AS INTEGER) AS place, priority, model, family, reason, tags FROM r",
    "rule_parameters": f"WITH {DAILY_CTES}, {MATCHED} {PARAMETERS}",
    "recommend_topk": f"WITH {DAILY_CTES}, {advice(2)} SELECT entity, models, best_model FROM a",
    "select_full": f"{selection(RAW_CTES)} SELECT entity, gate_passed, failures, models, best_model, reason FROM s9",
    "select_daily_grid": f"{selection(DAILY_CTES, min_rows=10, missing=0.6)} SELECT entity, gate_passed, models, best_model, reason FROM s9",
    "summary_reason": f"WITH {DAILY_CTES}, {advice(3)} SELECT entity, reason, models AS with_reasons FROM a",
    "profile_per_entity": f"{selection(ITEM_CTES, 2, min_rows=100, missing=0.55, irregular=0.8, coverage=0.15)} SELECT entity, row_count AS rows, gate_passed, best_model, round(coverage_ratio, 4) AS coverage_ratio, round(volatility, 4) AS volatility FROM s9",
    "model_distribution": f"{selection(RAW_CTES)} SELECT coalesce(best_model, 'none') AS model, count(*) AS entities FROM s9 GROUP BY 1",
    "routing_summary": f"""{selection(RAW_CTES)}, t AS (SELECT coalesce(best_model, 'none') AS model, count(*) AS n FROM s9 GROUP BY 1), d9 AS (SELECT model, n FROM t ORDER BY n DESC, model LIMIT 1)
SELECT (SELECT count(*) FROM s9) AS entities_profiled, (SELECT round(avg(CASE WHEN gate_passed THEN 1.0 ELSE 0.0 END), 6) FROM s9) AS gate_pass_rate, (SELECT count(*) FROM t) AS unique_models_assigned, model AS default_model, (SELECT count(*) FROM s9) - n AS entities_differing_from_default,
round(((SELECT count(*) FROM s9) - n) / (SELECT count(*) FROM s9), 6) AS routing_diversity_rate, (SELECT count(*) FROM s9 WHERE best_model = 'insufficient_data') AS insufficient_data_count, (SELECT round(avg(coverage_ratio), 6) FROM s9) AS mean_coverage_ratio FROM d9""",
    "kpi_datasets": f"WITH {RUNS} SELECT * FROM kpi",
    "kpi_portfolio": f"WITH {RUNS} SELECT count(*) AS datasets_evaluated, CAST(sum(entities) AS BIGINT) AS total_entities, CAST(sum(entities_blocked) AS BIGINT) AS total_entities_blocked, round(sum(entities_blocked) / sum(entities), 4) AS portfolio_training_jobs_avoided_rate, round(avg(gate_pass_rate), 4) AS mean_gate_pass_rate, round(avg(routing_diversity_rate), 4) AS mean_routing_diversity_rate, round(avg(screening_throughput_eps), 2) AS mean_screening_throughput_eps, max(unique_models_assigned) AS max_unique_models_assigned FROM kpi",
    "kpi_normalised": f"WITH {RUNS} SELECT dataset, round(entities / max(entities) OVER (), 6) AS entities_share FROM kpi",
    "run_metrics": f"WITH {RUNS} SELECT dataset, mode, round(1 - gate_pass_rate, 4) AS training_waste_avoided_rate, CAST(round_even(entities * (1 - gate_pass_rate), 0) AS BIGINT) AS entities_blocked, entities - CAST(round_even(entities * (1 - gate_pass_rate), 0) AS BIGINT) AS entities_cleared FROM runs",
    "udf_entity_summary": "SELECT user_id, true AS success, count(*) AS rows, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id",
    "udf_failure_envelope": "SELECT user_id, user_id % 7 <> 0 AS success, 1 AS attempts, CASE WHEN user_id % 7 = 0 THEN 'ValueError' END AS error_type, CASE WHEN user_id % 7 = 0 THEN 'no luck with ' || user_id END AS error_message, CASE WHEN user_id % 7 <> 0 THEN count(*) END AS rows FROM events GROUP BY user_id",
    "run_summary": "WITH u AS (SELECT DISTINCT user_id FROM events) SELECT count(*) AS processed, count(*) FILTER (user_id % 7 <> 0) AS succeeded, count(*) FILTER (user_id % 7 = 0) AS failed, CAST(0 AS BIGINT) AS retries, round(count(*) FILTER (user_id % 7 <> 0) / count(*), 6) AS success_rate FROM u",
    "checkpoint_latest": f"WITH {LOG} SELECT entity_id, status, event_id FROM last",
    "checkpoint_completed": f"WITH {LOG} SELECT entity_id FROM last WHERE status = 'completed'",
    "checkpoint_summary": f"WITH {LOG} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS tracked_entities, (SELECT count(*) FROM log) AS total_entries FROM last",
    "retry_delays": "SELECT range AS attempt, CASE WHEN range <= 1 THEN 0.0::DOUBLE ELSE least(0.5 * pow(2, range - 2), 30) END AS seconds FROM range(1, 11)",
}
