"""DuckDB SQL for the queries of runs.py."""

from __future__ import annotations

from fleetlens.plans.oracle import LOG, MATCHED, PARAMETERS, RAW_CTES, RUNS, SQL as CATALOG
from fleetlens.plans.oracle import advice, checks, selection


def cases(**found: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("_", " "), v.replace("'", "''")) for k, v in found.items()) + ") AS t(\"case\", found)"


CSV_EVENTS = "e AS (SELECT user_id, event_id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events)"
USERS = "u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS place FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL))"


def share(modulus: int) -> str:
    return f"(p_partkey % {modulus}) / 100::DOUBLE"


FIGURES = f"""p AS (SELECT p_partkey AS entity, p_partkey * 7 % 900 AS row_count, p_partkey * 11 % 293 + 1 AS effective_row_count, {share(107)} AS missing_rate, {share(89)} AS volatility, {share(83)} AS trend_strength, {share(79)} AS seasonality_strength,
  {share(41)} AS outlier_ratio, {share(31)} AS spike_ratio, {share(101)} AS flatline_ratio, {share(103)} AS sampling_irregularity, {share(97)} AS coverage_ratio, CAST(p_partkey * 47 % 1000 AS DOUBLE) AS max_gap_seconds FROM part)"""
LOOSE = selection(FIGURES, missing=0.9).replace("outlier_ratio <= 0.2", "outlier_ratio <= 0.9").replace("spike_ratio <= 0.15", "spike_ratio <= 0.9").replace("flatline_ratio <= 0.5", "flatline_ratio <= 0.9")
SIGNALS = "CAST(unique_models_assigned >= 2 AS INTEGER) + CAST(routing_diversity_rate >= 0.25 AS INTEGER) + CAST(insufficient_data_count > 0 OR gate_pass_rate < 0.9 AS INTEGER)"

SQL: dict[str, str] = {
    "csv_source": f"WITH {CSV_EVENTS} SELECT user_id, count(*) AS rows, count(value) AS values, round(avg(value), 6) AS mean_value, min(ts) AS first FROM e GROUP BY user_id",
    "json_lines_source": "SELECT count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS corrupt, CAST(sum(event_id) FILTER (event_id % 50 <> 0) AS BIGINT) AS id_sum FROM events",
    "source_lifecycle": "SELECT * FROM (VALUES ('before', 'False'), ('loaded', 'True'), ('cleared', 'False'), ('columns', 'o_orderkey,o_custkey'), ('lazy', 'False')) AS t(\"case\", found) UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM orders",
    "source_errors": cases(no_file="SourceNotFound", no_selected_column="SourceSchemaError", no_required_column="SourceSchemaError", required_but_not_selected="SourceSchemaError", fine="none", no_csv="SourceNotFound"),
    "fixture_source": "SELECT user_id AS entity_id, count(ts) AS rows, round(avg(value), 6) AS mean_value FROM events GROUP BY user_id",
    "wide_channels": """SELECT 'quantity' AS entity_id, count(*) AS rows, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean_value, min(CAST(l_shipdate AS TIMESTAMP)) + INTERVAL '7 hours 30 minutes' AS first FROM lineitem WHERE l_linenumber % 3 <> 0
UNION ALL SELECT 'tax', count(*), round(avg(CAST(l_tax AS DOUBLE)), 6), min(CAST(l_shipdate AS TIMESTAMP)) + INTERVAL '7 hours 30 minutes' FROM lineitem WHERE l_orderkey % 4 <> 0""",
    "mote_log": "SELECT CAST(user_id AS INTEGER) AS entity_id, count(*) AS rows, round(avg(value), 6) AS mean_value FROM events WHERE event_id % 9 <> 0 GROUP BY user_id",
    "report_sink": f"SELECT datasets_evaluated, total_entities, mean_gate_pass_rate, 8::BIGINT AS lines FROM ({CATALOG['kpi_portfolio']})",
    "flow_decorated": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last, count(*) AS rows, 'user_id ' || user_id || ' ts 1' AS told FROM events GROUP BY user_id",
    "flow_resume": f"WITH {USERS} SELECT 1::BIGINT AS run, count(*) AS processed, count(*) FILTER (user_id % 7 <> 0) AS succeeded, count(*) FILTER (user_id % 7 = 0) AS failed FROM u UNION ALL SELECT 2, count(*), 0, count(*) FROM u WHERE user_id % 7 = 0",
    "flow_limit": f"WITH {USERS} SELECT user_id, user_id % 7 <> 0 AS success, CASE WHEN user_id % 7 <> 0 THEN count(*) END AS rows FROM events WHERE user_id IN (SELECT user_id FROM u WHERE place <= 10) GROUP BY user_id",
    "flow_unfit_output": "SELECT user_id, user_id % 5 <> 0 AS success, user_id % 5 = 0 AS told, CASE WHEN user_id % 5 <> 0 THEN count(*) END AS rows FROM events GROUP BY user_id",
    "single_entity": "SELECT user_id, count(*) AS rows, arg_max(event_id, (ts, event_id)) AS last_event, 'KeyError' AS unknown FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY user_id",
    "runner_csv": f"WITH {USERS} SELECT user_id, true AS success, 1 AS attempts, count(*) AS rows, (SELECT CAST(ceil(count(*) / 60) AS BIGINT) FROM u) AS batches FROM events GROUP BY user_id",
    "runner_resume": f"""WITH {USERS} SELECT 1::BIGINT AS run, count(*) AS processed, count(*) FILTER (user_id % 7 <> 0) AS succeeded, count(*) FILTER (user_id % 7 = 0) AS failed, 0::BIGINT AS skipped, CAST(ceil(count(*) / 40) AS BIGINT) AS batches FROM u WHERE user_id % 3 = 0
UNION ALL SELECT 2, count(*), count(*) FILTER (user_id % 7 <> 0), count(*) FILTER (user_id % 7 = 0), (SELECT count(*) FROM u WHERE user_id % 3 = 0 AND user_id % 7 <> 0), CAST(ceil(count(*) / 40) AS BIGINT) FROM u WHERE user_id % 3 <> 0 OR user_id % 7 = 0""",
    "runner_parallel": "SELECT user_id, user_id % 7 <> 0 AS success, CASE WHEN user_id % 7 <> 0 THEN count(*) END AS rows, CASE WHEN user_id % 7 <> 0 THEN 'completed' ELSE 'failed' END AS status, true AS told FROM events GROUP BY user_id",
    "runner_retries": f"""WITH {USERS} SELECT user_id, user_id % 4 < 3 AS success, CAST(least(user_id % 4 + 1, 3) AS INTEGER) AS attempts, CASE WHEN user_id % 4 = 3 THEN 'TimeoutError' END AS error_type, CASE WHEN user_id % 4 = 3 THEN 'attempt 3' END AS error_message,
(SELECT CAST(sum(least(user_id % 4, 2)) AS BIGINT) FROM u) AS retries FROM u""",
    "runner_fail_fast": f"WITH {USERS}, b AS (SELECT (min(place) - 1) // 5 AS batch, min(user_id) AS entity FROM u WHERE user_id % 7 = 0) SELECT entity, least((batch + 1) * 5, (SELECT count(*) FROM u)) AS logged FROM b",
    "runner_errors": cases(no_flow="TypeError", no_batch="ValueError", no_worker="ValueError", no_attempt="ValueError", fine="none", no_column="MissingColumns", no_context="TypeError", two_names="ValueError"),
    "legacy_flow": "SELECT user_id, 1::BIGINT AS place, max(event_id) AS event_id FROM events WHERE user_id % 7 > 1 GROUP BY user_id UNION ALL SELECT user_id, 2, min(event_id) FROM events WHERE user_id % 7 > 1 GROUP BY user_id",
    "legacy_flow_summary": f"""WITH {USERS} SELECT 1::BIGINT AS run, count(*) AS processed, count(*) FILTER (user_id % 7 > 1) AS succeeded, count(*) FILTER (user_id % 7 <= 1) AS failed, 0::BIGINT AS skipped FROM u WHERE place <= 20
UNION ALL SELECT 2, count(*) FILTER (user_id % 7 <= 1), 0, count(*) FILTER (user_id % 7 <= 1), count(*) FILTER (user_id % 7 > 1) FROM u WHERE place <= 20""",
    "processor_checks": cases(marked="True", plain="False", object="True", no_processor="TypeError", warns="['DeprecationWarning']", no_name="ValueError", no_limit="ValueError", defaults="(True, False, 3, None)", context="True"),
    "legacy_store": "SELECT * FROM (VALUES ('a', true, NULL, 1::BIGINT, '', 0::BIGINT), ('b', false, 'y', 3, '2024-01-04', 0)) AS t(entity_id, success, error, attempts, failed_at, \"left\")",
    "checkpoint_marks": cases(
        entries="3", completed="['1']", failed="['2']", skips="(True, False)", file="checkpoints.jsonl", entry_1_failed="(0.0, 1, 'x', {})", entry_1_completed="(2.0, 1, None, {})", entry_2_failed="(0.0, 3, 'y', {})", summary="(1, 1, 2, 3)", cleared="0",
    ),
    "checkpoint_log_scan": "SELECT CAST(i % 300 AS VARCHAR) AS entity_id, arg_max(CASE WHEN i % 4 <> 0 THEN 'completed' ELSE 'failed' END, i) AS status, 'CheckpointError' AS corrupt FROM range(1000) AS t(i) GROUP BY i % 300",
    "checkpoint_shared": f"WITH {LOG} SELECT CAST(entity_id AS VARCHAR) AS entity_id FROM last WHERE status = 'completed' UNION ALL SELECT 'x'",
    "checkpoint_new_entries": f"""WITH {LOG}, done AS (SELECT entity_id FROM log WHERE event_id % 2 = 0 GROUP BY entity_id HAVING arg_max(status, (ts, event_id)) = 'completed'),
fresh AS (SELECT * FROM log WHERE event_id % 2 = 1 AND entity_id NOT IN (SELECT entity_id FROM done)), ended AS (SELECT entity_id, min((ts, event_id)) FILTER (status = 'completed') AS e FROM fresh GROUP BY entity_id)
SELECT entity_id, event_id, status FROM fresh JOIN ended USING (entity_id) WHERE e IS NULL OR (ts, event_id) <= e""",
    "rule_figures": f"WITH {FIGURES}, {MATCHED} SELECT entity, CAST(place AS INTEGER) AS place, priority, model, family, reason, tags FROM r",
    "rule_figures_parameters": f"WITH {FIGURES}, {MATCHED} {PARAMETERS}",
    "recommended_figures": f"WITH {FIGURES}, {MATCHED} SELECT entity, CAST(place AS INTEGER) AS place, model FROM r WHERE place < 3",
    "gate_figures": f"WITH {FIGURES}, c AS ({checks(coverage=0.5, gap=500.0)}) SELECT entity, name, passed, message, threshold, observed FROM c",
    "selection_payload": f"{LOOSE} SELECT entity, gate_passed, failures <> '' AS has_failures, failures, models, best_model, reason FROM s9",
    "profile_payload": f"WITH {RAW_CTES} SELECT entity, row_count, effective_row_count, volatility, span_days FROM p",
    "recommendation_payload": f"WITH {FIGURES}, {advice(2)}, l AS (SELECT entity, string_agg(model || ' ' || priority, ',' ORDER BY place) AS recipes FROM r WHERE place < 2 GROUP BY entity) SELECT a.entity, best_model, reason, coalesce(recipes, '') AS recipes FROM a LEFT JOIN l USING (entity)",
    "single_series": f"""WITH {RAW_CTES}, o AS (SELECT * FROM p WHERE entity = (SELECT min(user_id) FROM events)) SELECT 'rows' AS "case", CAST(row_count AS VARCHAR) AS found FROM o UNION ALL SELECT 'volatility', printf('%.4f', volatility) FROM o UNION ALL SELECT 'empty', '0'
UNION ALL SELECT * FROM (VALUES ('no column', 'ProfileError'), ('no values', 'ProfileError'), ('bad sigma', 'ValueError'))""",
    "performance_summary": "SELECT * FROM (VALUES (1::BIGINT, 10.0::DOUBLE, 1.0::DOUBLE), (2, 20.0, 2.0), (4, 80.0, 8.0)) AS t(workers, entities_per_second, speedup)",
    "usefulness": f"WITH s AS (SELECT {SIGNALS} AS n FROM ({CATALOG['routing_summary']})) SELECT 1::BIGINT AS run, n >= 2 AS useful, CAST(n AS BIGINT) AS signals, CAST(4 - n AS BIGINT) AS gaps FROM s UNION ALL SELECT 2, n >= 1, n + 1, 3 - n FROM s",
    "report_highlights": f"""WITH {RUNS}, w AS (SELECT row_number() OVER (ORDER BY dataset) - 1 AS place, 'In ' || dataset || ', ' || entities_blocked || ' of ' || entities || ' entities are stopped.' AS sentence FROM kpi WHERE training_jobs_avoided_rate >= 0.30)
SELECT place, sentence, 3::BIGINT AS before FROM w UNION ALL SELECT -1, 'none', 3 WHERE NOT EXISTS (SELECT * FROM w)""",
    "report_verdict": f"""WITH {RUNS}, t AS (SELECT CAST(sum(entities) AS BIGINT) AS entities, sum(entities_blocked) AS blocked, round(avg(screening_throughput_eps), 2) AS eps, round(avg(routing_diversity_rate), 4) AS diverse, max(unique_models_assigned) AS models,
  avg(plain_loop_throughput_eps / screening_throughput_eps) AS slow, coalesce(string_agg(dataset, ', ' ORDER BY dataset) FILTER (gate_pass_rate = 0 AND entities > 0), '') AS stopped FROM kpi)
SELECT 'orchestration' AS criterion, CASE WHEN slow <= 15 AND entities >= 10 THEN 'pass' WHEN slow > 50 THEN 'fail' ELSE 'partial' END AS status FROM t UNION ALL SELECT 'lightweight_statistics', CASE WHEN slow <= 25 THEN 'partial' ELSE 'fail' END FROM t
UNION ALL SELECT 'blocks_unfit_entities', CASE WHEN blocked > 0 THEN 'pass' ELSE 'partial' END FROM t UNION ALL SELECT 'routes_model_families', CASE WHEN diverse > 0.05 OR models > 1 THEN 'pass' ELSE 'partial' END FROM t
UNION ALL SELECT 'forecast_accuracy', 'not_tested' UNION ALL SELECT 'batch_operations', 'not_tested' UNION ALL SELECT 'screening_throughput', CASE WHEN eps >= 100 THEN 'pass' WHEN eps >= 30 THEN 'partial' ELSE 'fail' END FROM t UNION ALL SELECT 'all_blocked', stopped FROM t""",
    "cli_checks": "SELECT * FROM (VALUES ('run', '0'), ('run main', '0'), ('validate', '0'), ('no entry point', '1'), ('broken', '1'), ('no script', '1'), ('status', '0'), ('no log', '1'), ('info', '0'), ('completed: 1', 'True'), ('hint: define one of', 'True'), ('entry point run', 'True')) AS t(\"case\", found)",
    "helper_checks": cases(tracked="3", measured="True", delta="True", peak="True", snapshots="1", logger="fleetlens.x", level="30", handlers="1"),
}
