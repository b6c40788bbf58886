"""Metering, catalogue and queue queries as SQL over the tables; one statement serves Spark and the oracle.

{table} names a table. @name stands for what the two dialects write differently (see DIALECT).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Name: Spark's form, the oracle's form.
DIALECT = {
    "k": ("CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract_string(props, '$.k') AS INT)"),
    "now": ("TIMESTAMP_NTZ '2024-01-31 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"),
    "age_s": ("timestampdiff(SECOND, CAST(ts AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '2024-01-31 00:00:00')", "date_sub('second', ts, TIMESTAMP '2024-01-31 00:00:00')"),
    "window_start": ("CAST(date_trunc('hour', ts) AS STRING)", "CAST(date_trunc('hour', ts) AS VARCHAR)"),
    "p95": ("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)", "quantile_disc(latency, 0.95)"),
    "words": ("explode(split(text, ' '))", "unnest(string_split(text, ' '))"),
    "sorted_types": ("array_join(array_sort(collect_set(event_type)), '|')", "array_to_string(list_sort(list(DISTINCT event_type)), '|')"),
    "add_months_k": ("add_months(CAST(a AS DATE), k)", "CAST(CAST(a AS DATE) + to_months(k) AS DATE)"),
    "add_months_k1": ("add_months(CAST(a AS DATE), k + 1)", "CAST(CAST(a AS DATE) + to_months(k + 1) AS DATE)"),
    "month_diff": ("CAST((year(@now) - year(a)) * 12 + month(@now) - month(a) AS INT)", "CAST((year(@now) - year(a)) * 12 + month(@now) - month(a) AS INT)"),
    "lines": ("size(split(text, '\\n'))", "len(string_split(text, chr(10)))"),
    "json_turns": ("to_json(transform(array_sort(collect_list(struct(turn, role, length(text) AS chars))), x -> x.chars))", "CAST(to_json(list(length(text) ORDER BY turn, role, length(text))) AS VARCHAR)"),
    "list_text": ("array_join(transform(array_sort(collect_list(struct(turn, role))), x -> x.role), ',')", "array_to_string(list(role ORDER BY turn, role), ',')"),
    "sha": ("sha2(text, 256)", "sha256(text)"),
    "base36": ("lower(conv(seq, 10, 36))", "lower(CASE WHEN seq < 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(seq + 1 AS INT), 1) ELSE concat(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(seq // 36 + 1 AS INT), 1), substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(seq % 36 + 1 AS INT), 1)) END)"),
    "epoch_ms": ("unix_millis(CAST(ts AS TIMESTAMP))", "epoch_us(ts) // 1000"),
    "file": ("regexp_extract(url, '^[a-z]+://[^?#]*', 0)", "regexp_extract(url, '^[a-z]+://[^?#]*', 0)"),
    "string": ("STRING", "VARCHAR"),
}

#: Turn metrics: an event is a turn, its type the model, its value the tokens, props.k the latency.
TURNS = "turns AS (SELECT event_id, ts, user_id, event_type AS model, CAST(floor(greatest(coalesce(value, 0), 0)) AS BIGINT) AS tokens, coalesce(@k, 0) AS latency FROM {events})"
#: Run facts: an order is a run, its lines the stage executions.
RUNS = """facts AS (SELECT o.o_orderkey AS run, o.o_custkey AS owner, o.o_orderstatus AS state, o.o_orderdate AS started, l.l_linenumber AS line, concat(l.l_linestatus, l.l_returnflag) AS stage,
    CAST(l.l_quantity AS BIGINT) AS tokens, l.l_extendedprice * (1 - l.l_discount) AS cost, l.l_shipdate AS shipped FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey)"""
#: Prices by model, each for a million tokens; a trailing star is a prefix.
PRICES = "prices AS (SELECT * FROM (VALUES ('view', 0.25E0, 1.5E0, 0), ('purchase', 2E0, 12E0, 0), ('c*', 0.15E0, 0.6E0, 1), ('s*', 0.5E0, 3E0, 2)) AS p(pattern, input_price, output_price, priority))"

STATEMENTS: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    STATEMENTS[name] = sql


_add("overview_totals", f"WITH {TURNS} SELECT count(*) AS turns, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, coalesce(avg(latency), 0.0) AS avg_latency, count(DISTINCT user_id) AS users FROM turns")
_add("model_rollup", f"""WITH {TURNS}, g AS (SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(latency) AS BIGINT) AS latency FROM turns GROUP BY model)
    SELECT CASE WHEN model IS NULL OR trim(model) = '' THEN 'unknown' ELSE model END AS model, calls, tokens, CASE WHEN calls = 0 THEN 0.0 ELSE floor(latency * 1.0E0 / calls + 0.5) END AS avg_latency FROM g""")
for _unit in ("hour", "day", "week", "month"):
    _add(f"series_{_unit}", f"""WITH {TURNS} SELECT CAST(date_trunc('{_unit}', ts) AS @string) AS bucket, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(latency) AS BIGINT) AS latency
        FROM turns WHERE ts < @now GROUP BY 1""")
_add("p95_latency", f"WITH {TURNS} SELECT model, @p95 AS p95, count(*) AS n FROM turns WHERE latency >= 0 GROUP BY model")
_add("throughput", f"WITH {TURNS} SELECT model, CASE WHEN sum(latency) = 0 THEN 0.0 ELSE floor(sum(tokens) * 1.0E0 / (sum(latency) / 1.0E3) * 1E3 + 0.5) / 1E3 END AS tokens_per_s FROM turns GROUP BY model")
_add("cost_breakdown", f"""WITH {TURNS}, {PRICES},
    exact AS (SELECT t.*, p.input_price AS ep, p.output_price AS eo FROM turns t LEFT JOIN prices p ON p.pattern = t.model),
    ranked AS (SELECT e.*, p.input_price AS pp, p.output_price AS po, row_number() OVER (PARTITION BY e.event_id ORDER BY p.priority) AS r FROM exact e
        LEFT JOIN prices p ON p.pattern LIKE '%*' AND e.model LIKE concat(substring(p.pattern, 1, length(p.pattern) - 1), '%')),
    priced AS (SELECT model, tokens, least(tokens, greatest(latency, 0)) AS cached, coalesce(ep, pp, 0.1E0) AS price, coalesce(eo, po, 0.4E0) AS out_price FROM ranked WHERE r = 1),
    cost AS (SELECT model, ((tokens - cached) * price + cached * price * 0.1E0) / 1E6 AS input_usd, tokens * 0.25E0 * out_price / 1E6 AS output_usd FROM priced)
    SELECT model, round(sum(input_usd), 11) AS input_usd, round(sum(output_usd), 11) AS output_usd, round(sum(input_usd + output_usd), 11) AS usd FROM cost GROUP BY model""")
_add("fx_convert", "SELECT o_orderkey, floor(o_totalprice * 0.92E0 * 1E6 + 0.5) / 1E6 AS eur, round(o_totalprice * 0.92E0 * 107, 2) AS rub FROM {orders}")
_add("user_rollup", f"""WITH {RUNS}, by_owner AS (SELECT owner, count(DISTINCT run) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens, sum(cost) AS cost FROM facts GROUP BY owner)
    SELECT c.c_custkey AS user_id, coalesce(b.runs, 0) AS runs, coalesce(b.tokens, 0) AS tokens, round(coalesce(b.cost, 0.0E0), 4) AS cost FROM {{customer}} c LEFT JOIN by_owner b ON b.owner = c.c_custkey""")
_add("stage_rollup", f"""WITH {RUNS}, s AS (SELECT run, stage, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, min(shipped) AS started, max(shipped) AS completed,
    max(CASE WHEN tokens > 45 THEN 4 WHEN tokens > 30 THEN 3 WHEN tokens > 10 THEN 2 ELSE 1 END) AS worst FROM facts GROUP BY run, stage)
    SELECT run, stage, tokens, cost, CAST(started AS @string) AS started, CAST(completed AS @string) AS completed, CASE worst WHEN 4 THEN 'failed' WHEN 3 THEN 'running' WHEN 2 THEN 'completed' ELSE 'queued' END AS state FROM s""")
_add("run_current_stage", f"""WITH {RUNS}, s AS (SELECT run, state, stage, line, CASE WHEN tokens > 45 THEN 1 WHEN tokens > 30 THEN 2 ELSE 3 END AS urgency FROM facts),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY urgency, line, stage) AS n FROM s) SELECT run, CASE WHEN state = 'F' THEN 'finalize' ELSE stage END AS current_stage FROM r WHERE n = 1""")
_add("status_counts", """SELECT s.state, coalesce(g.n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X'), ('Y')) AS s(state) LEFT JOIN (SELECT o_orderstatus AS state, count(*) AS n FROM {orders} GROUP BY 1) g ON g.state = s.state""")
_add("library_page", f"""WITH {RUNS}, g AS (SELECT owner, count(DISTINCT run) AS runs, round(sum(cost), 4) AS cost FROM facts GROUP BY owner)
    SELECT c.c_custkey AS id, c.c_name AS title, n.n_name AS owner, coalesce(g.runs, 0) AS runs, coalesce(g.cost, 0.0) AS cost FROM {{customer}} c JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN g ON g.owner = c.c_custkey ORDER BY c.c_name, c.c_custkey LIMIT 50 OFFSET 100""")
_add("popular_sort", """SELECT c.c_custkey AS id, coalesce(g.n, 0) AS likes FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) g ON g.o_custkey = c.c_custkey ORDER BY likes DESC, id LIMIT 100""")
_add("search_contains", """SELECT s.s_suppkey AS id, s.s_name AS name, n.n_name AS nation FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
    WHERE contains(lower(s.s_name), lower('1')) OR contains(lower(n.n_name), lower('an'))""")
_add("visibility", """SELECT c.c_custkey AS id, c.c_acctbal > 0 AS is_public, EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS in_library FROM {customer} c
    WHERE c.c_mktsegment = 'BUILDING' OR c.c_acctbal > 5000""")
_add("exists_any_child", """SELECT c.c_custkey AS id FROM {customer} c WHERE c.c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000) OR c.c_custkey IN (SELECT user_id FROM {events} WHERE event_type = 'purchase')""")
_add("or_join", """SELECT e.event_id, coalesce(a.c_name, b.s_name) AS name FROM {events} e LEFT JOIN {customer} a ON a.c_custkey = e.user_id AND e.event_type = 'purchase'
    LEFT JOIN {supplier} b ON b.s_suppkey = e.user_id WHERE e.event_type IN ('purchase', 'click')""")
_add("scalar_subqueries", """SELECT c.c_custkey AS id, CAST(coalesce(o.first_order, e.first_event) AS @string) AS first_seen FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM {orders} GROUP BY 1) o ON o.o_custkey = c.c_custkey
    LEFT JOIN (SELECT user_id, min(ts) AS first_event FROM {events} GROUP BY 1) e ON e.user_id = c.c_custkey""")
_add("backfill_anti", "SELECT c.conv_id, c.turn FROM {conversations} c LEFT JOIN (SELECT DISTINCT doc_id FROM {labels}) l ON l.doc_id = c.conv_id WHERE c.role = 'assistant' AND l.doc_id IS NULL")
_add("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) WHERE r = 1")
_add("thread_list", """SELECT conv_id, turn AS last_turn, role AS last_role, messages FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r, count(*) OVER (PARTITION BY conv_id) AS messages FROM {conversations}) WHERE r = 1""")
_add("last_messages", """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM {conversations}) WHERE r <= 3""")
_add("thread_export", "SELECT conv_id, @json_turns AS turns, @list_text AS roles FROM {conversations} GROUP BY conv_id")
_add("history_compaction", """SELECT conv_id, n, CASE WHEN n <= 4 THEN 0 ELSE n - 4 END AS boundary, CASE WHEN n <= 4 THEN 'pass' WHEN chars < 2000 THEN 'reuse' ELSE 'regenerate' END AS action
    FROM (SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM {conversations} GROUP BY conv_id)""")
_add("upsert_merge", """SELECT id, value, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated DESC, source) AS r FROM (SELECT user_id AS id, value, ts AS updated, 'old' AS source FROM {events} WHERE event_type = 'view'
    UNION ALL SELECT user_id, value, ts, 'new' FROM {events} WHERE event_type = 'click') u) WHERE r = 1""")
_add("insert_ignore", "SELECT user_id, count(*) AS n FROM {events} e WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = e.user_id AND o.o_orderstatus = 'P') GROUP BY user_id")
_add("update_from_join", "SELECT o.o_orderkey, coalesce(c.c_nationkey, -1) AS nation FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey")
_add("version_alloc", """SELECT doc_id, source, CAST(sum(changed) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS version FROM (SELECT doc_id, source, CASE WHEN lag(@sha) OVER (PARTITION BY source ORDER BY doc_id) = @sha THEN 0 ELSE 1 END AS changed FROM {documents})""")
_add("attempt_alloc", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM {events}")
_add("text_hash", "SELECT doc_id, @sha AS text_hash, length(text) AS n_chars, CASE WHEN length(text) <= 220 THEN text ELSE concat(substring(text, 1, 217), '...') END AS card FROM {documents}")
_add("period_window", """WITH u AS (SELECT user_id, min(ts) AS a FROM {events} GROUP BY user_id), m AS (SELECT user_id, a, @month_diff AS k0 FROM u),
    s AS (SELECT user_id, a, k0 AS k FROM m), f AS (SELECT user_id, a, CASE WHEN @add_months_k > CAST(@now AS DATE) THEN k - 1 ELSE k END AS k FROM s)
    SELECT user_id, CAST(@add_months_k AS @string) AS period_start, CAST(@add_months_k1 AS @string) AS period_end FROM f""")
_add("bucket_usage", f"""WITH {TURNS}, u AS (SELECT user_id, count(CASE WHEN contains(model, 'purch') THEN 1 END) AS pro, count(CASE WHEN contains(model, 'view') THEN 1 END) AS lite FROM turns WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < @now GROUP BY user_id)
    SELECT user_id, pro, lite, greatest(5 - pro, 0) AS pro_left, greatest(40 - lite, 0) AS lite_left, pro >= 5 AS pro_exhausted, lite >= 40 AS lite_exhausted FROM u""")
_add("progress_eta", """SELECT o_orderkey, p, CASE WHEN p > 5 THEN greatest(1, CAST(ceil(600000.0E0 * (100 - p) / p / 60000) AS INT)) ELSE 2 END AS eta_min FROM (SELECT o_orderkey, CASE WHEN n = 0 THEN 5 ELSE least(99, greatest(0, CAST(floor(done * 100.0E0 / n + 0.5) AS INT))) END AS p
    FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done FROM {lineitem} GROUP BY 1))""")
_add("allocation", """SELECT o_orderkey, CASE WHEN l + r = 0 THEN total ELSE CAST(floor(total * 1.0E0 * l / (l + r) + 0.5) AS BIGINT) END AS first_part, CASE WHEN l + r = 0 THEN 0 ELSE total - CAST(floor(total * 1.0E0 * l / (l + r) + 0.5) AS BIGINT) END AS second_part FROM
    (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS total, CAST(o_orderkey % 7 AS BIGINT) AS l, CAST(o_custkey % 5 AS BIGINT) AS r FROM {orders})""")
_add("storage_map_sum", "SELECT user_id, event_type AS kind, CAST(sum(@k) AS BIGINT) AS bytes FROM {events} WHERE @k > 0 GROUP BY user_id, event_type")
_add("json_props_agg", "SELECT event_type, count(*) AS n, count(@k) AS with_k, CAST(coalesce(sum(@k), 0) AS BIGINT) AS sum_k, max(@k) AS max_k FROM {events} GROUP BY event_type")
_add("tool_config_key", "SELECT user_id, coalesce(nullif(@sorted_types, ''), 'none') AS config FROM {events} GROUP BY user_id")
_add("backoff", "SELECT event_id, least(900000.0E0, 5000.0E0 * power(2, @k % 10)) AS delay_ms FROM {events}")
_add("anchors_top80", """WITH w AS (SELECT @words AS anchor FROM {benchmark} UNION ALL SELECT @words AS anchor FROM {conversations}), c AS (SELECT trim(BOTH ' .,!?:;«»"' FROM anchor) AS anchor FROM w)
    SELECT anchor, count(*) AS n FROM c WHERE length(anchor) >= 3 GROUP BY anchor ORDER BY n DESC, anchor LIMIT 80""")
_add("file_formats", """SELECT page_id, CASE WHEN path LIKE '%.fb2.zip' THEN 'fb2_zip' WHEN path LIKE '%.epub' THEN 'epub' WHEN path LIKE '%.pdf' THEN 'pdf' WHEN path LIKE '%.html' THEN 'html' END AS format,
    trim(regexp_replace(regexp_replace(regexp_replace(path, '^.*/', ''), '[.][a-z0-9]+$', ''), '[._-]+', ' '@g)) AS title FROM (SELECT page_id, lower(@file) AS path FROM {pages})""")
DIALECT["g"] = ("", ", 'g'")
_add("outbox_claim", """SELECT event_id, user_id, CAST(ts AS @string) AS available_at FROM {events} WHERE event_type IN ('click', 'purchase') AND ts <= @now AND @k % 10 < 8 ORDER BY ts, event_id LIMIT 16""")
_add("fair_share", """WITH f AS (SELECT user_id, count(*) AS in_flight FROM {events} WHERE event_type = 'signup' GROUP BY user_id),
    q AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events} WHERE event_type = 'purchase')
    SELECT q.event_id, q.user_id, coalesce(f.in_flight, 0) = 0 AND q.n = 1 AS dispatch FROM q LEFT JOIN f ON f.user_id = q.user_id""")
_add("idempotent_enqueue", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, @k ORDER BY ts, event_id) AS r FROM {events} WHERE event_type = 'click') e WHERE r = 1
    AND NOT EXISTS (SELECT 1 FROM {events} d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id AND d.ts >= e.ts)""")
_add("retry_state", """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'processed' WHEN @k % 10 >= 8 THEN 'dead_letter' WHEN value > 90 THEN 'forced' ELSE 'retry' END AS state, least(8, @k % 10 + 1) AS attempt FROM {events}""")
_add("stale_watchdog", """SELECT event_id, CASE WHEN @k % 10 < 5 THEN 'requeue' ELSE 'fail' END AS action FROM {events} WHERE (event_type = 'view' AND @age_s > 2700) OR (event_type = 'signup' AND @age_s > 600) ORDER BY ts, event_id LIMIT 50""")
_add("event_fanout", "SELECT user_id, count(CASE WHEN event_type IN ('click', 'purchase', 'view', 'signup') THEN 1 END) AS emitted, count(CASE WHEN event_type NOT IN ('click', 'purchase', 'view', 'signup') OR @k IS NULL THEN 1 END) AS dropped FROM {events} GROUP BY user_id")
_add("rate_limit", """SELECT event_id, user_id, n <= 2 AS allowed, greatest(2 - n, 0) AS remaining FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, @window_start ORDER BY ts, event_id) AS n FROM {events})""")
_add("event_ids", """SELECT event_id, concat(CAST(ms AS @string), '-', @base36) AS id FROM (SELECT event_id, @epoch_ms AS ms, row_number() OVER (PARTITION BY @epoch_ms ORDER BY event_id) - 1 AS seq FROM {events})""")
_add("queue_health", """SELECT count(CASE WHEN @k % 10 = 0 THEN 1 END) AS pending, count(CASE WHEN @k % 10 BETWEEN 1 AND 4 THEN 1 END) AS active, count(CASE WHEN @k % 10 BETWEEN 5 AND 7 THEN 1 END) AS retrying, count(CASE WHEN @k % 10 >= 8 THEN 1 END) AS dead,
    CAST(max(CASE WHEN @k % 10 = 0 THEN @age_s END) AS BIGINT) AS oldest_s FROM {events}""")
_add("stability", """SELECT user_id, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS spread, round(stddev_pop(value), 6) AS std FROM {events} GROUP BY user_id""")
_add("step_metrics", f"""WITH {TURNS} SELECT model AS step, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(latency), 4) AS avg_latency, round(sum(tokens) * 0.25E0 / 1E6, 8) AS cost FROM turns GROUP BY model ORDER BY cost DESC, step""")
_add("regression_gate", """SELECT b.l_linestatus AS suite, round(b.c, 4) AS base_cost, round(n.c, 4) AS cost, n.c <= b.c * 1.25 AS cost_ok, n.q >= b.q - 0.1 AS grounded_ok FROM (SELECT l_linestatus, avg(l_extendedprice) AS c, avg(l_tax) AS q FROM {lineitem} WHERE l_returnflag = 'A' GROUP BY 1) b
    JOIN (SELECT l_linestatus, avg(l_extendedprice) AS c, avg(l_tax) AS q FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) n ON n.l_linestatus = b.l_linestatus""")
_add("question_class", """SELECT conv_id, turn, CASE WHEN length(text) < 40 THEN 'short' WHEN length(text) > 400 THEN 'long' ELSE 'plain' END AS size, CASE WHEN @lines > 3 THEN 12 ELSE 8 END AS k FROM {conversations} WHERE role = 'user'""")
_add("readiness", """SELECT l_orderkey AS book, min(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS all_done, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS any_done,
    CASE WHEN min(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'full' WHEN max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'none' END AS mode FROM {lineitem} GROUP BY 1""")
_add("tier_override", """SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 5 THEN 'small' WHEN event_type = 'purchase' THEN 'large' ELSE 'small' END AS model FROM {events}""")
_add("performance_dto", f"""WITH {RUNS} SELECT run, count(*) AS blocks, round(CASE WHEN sum(tokens) = 0 THEN 0 ELSE count(*) * 60.0E0 / sum(tokens) END, 3) AS blocks_per_min, round(sum(cost), 4) AS cost FROM facts GROUP BY run""")
_add("segment_attempts", "SELECT l_orderkey AS run, l_returnflag AS segment, count(*) AS attempts, CAST(sum(l_quantity) AS BIGINT) AS bytes, max(l_linenumber) AS last_attempt FROM {lineitem} GROUP BY 1, 2")
_add("complaints_page", """SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM {orders} WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') ORDER BY o_orderdate DESC, o_orderkey LIMIT 25""")
_add("account_purge", "SELECT l.l_orderkey, l.l_linenumber FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 10 = 3)")


def written_for(sql: str, engine: int, sf_dir: str | None = None) -> str:
    for _ in range(2):  # a form may hold another
        sql = re.sub(r"@(\w+)", lambda m: DIALECT[m[1]][engine], sql)
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`" if engine == 0 else m[1], sql)


def statement(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(written_for(STATEMENTS[name], 0, sf_dir))

    query.__name__ = name
    return query


QUERIES = {name: statement(name) for name in STATEMENTS}
SQL = {name: written_for(sql, 1) for name, sql in STATEMENTS.items()}
