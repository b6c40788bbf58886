"""Metering queries built from operators that can be called, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import metering
from lexloom.plans.retrieval import HALF, LISTS, read, second_list

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: A catalogue of prices: entries of a model, wildcards by place, a price that is missing and one that is no price.
CATALOGUE = (("N-O-1", 3, 0.25, 1.5), ("n-o*", 1, 2.0, 12.0), ("n*", 2, 0.3, 2.5), (" A-F-2 ", 4, 0.1, None), ("a-*", 5, -1.0, 0.4), ("x*", 6, 9.0, 9.0))
ENTRIES = ", ".join(f"('{p}', {n}, {i}E0, {'CAST(NULL AS DOUBLE)' if o is None else f'{o}E0'})" for p, n, i, o in CATALOGUE)
USAGE = "SELECT l_orderkey AS run, l_linenumber AS line, concat(' ', l_returnflag, '-', l_linestatus, '-', l_linenumber % 3) AS model, CAST(floor(l_extendedprice) AS BIGINT) AS input, CAST(floor(l_quantity) AS BIGINT) * 1000 AS cached, l_partkey * 10 - 500 AS output"


@query(f"""WITH u AS ({USAGE} FROM lineitem), c AS (SELECT lower(trim(p)) AS p, place, i, o FROM (VALUES {ENTRIES}) AS v(p, place, i, o)), m AS (SELECT DISTINCT lower(trim(model)) AS m FROM u),
    f AS (SELECT m, i, o FROM m JOIN c ON c.p = m.m OR (c.p LIKE '%*' AND starts_with(m.m, left(c.p, length(c.p) - 1))) QUALIFY row_number() OVER (PARTITION BY m ORDER BY c.p <> m.m, place) = 1),
    p AS (SELECT u.*, CASE WHEN i >= 0 THEN i ELSE 0.5E0 END AS ip, CASE WHEN o >= 0 THEN o ELSE 1E0 END AS op FROM u LEFT JOIN f ON f.m = lower(trim(u.model))),
    x AS (SELECT trim(model) AS model, (greatest(input, 0) - least(greatest(cached, 0), greatest(input, 0))) / 1E6 * ip + least(greatest(cached, 0), greatest(input, 0)) / 1E6 * ip * 0.1E0 + greatest(output, 0) / 1E6 * op AS usd FROM p),
    s AS (SELECT model, count(*) AS calls, CAST(sum(CAST(floor(usd * 1E9 + 0.5) AS BIGINT)) AS BIGINT) / 1E9 AS usd FROM x GROUP BY 1) SELECT model, calls, {HALF('usd')} AS usd, {HALF('usd * 0.92E0')} AS eur, {HALF('usd * 0.92E0 * 107')} AS rub FROM s""")
def model_costs(spark, d):
    """Costs of calls by model, with cached input at its discount, in three currencies."""
    u = read(spark, d, "lineitem").select(
        F.concat_ws("-", F.concat(F.lit(" "), "l_returnflag"), "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("model"), F.floor("l_extendedprice").cast("long").alias("input"), (F.floor("l_quantity").cast("long") * 1000).alias("cached"), (F.col("l_partkey") * 10 - 500).alias("output"))
    catalogue = spark.createDataFrame(CATALOGUE, "pattern string, place int, input_price double, output_price double")
    p = metering.priced(u, catalogue, (0.5, 1.0))
    usd = metering.cost(*(F.col(c) for c in ("input", "cached", "output", "input_price", "output_price")))
    nanos = F.floor(usd * 1e9 + 0.5).cast("long")  # whole numbers, so that no order of addition changes the sum
    g = p.groupBy(F.trim("model").alias("model")).agg(F.count("*").alias("calls"), (F.sum(nanos) / 1e9).alias("usd"))
    eur = F.col("usd") * metering.USD_EUR
    return g.select("model", "calls", T.half_up(F.col("usd"), 6).alias("usd"), T.half_up(eur, 6).alias("eur"), T.half_up(eur * metering.EUR_RUB, 6).alias("rub"))


CHAPTERS = """l_orderkey AS run, element_at(array('paragraphs', 'scenes', 'scene_embeddings', 'fragments', 'other'), cast(l_linenumber % 5 + 1 as int)) AS stage, l_partkey AS chapter, l_suppkey AS supplier, cast(l_quantity as bigint) AS tokens,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failed' WHEN l_quantity > 40 THEN 'running' WHEN l_quantity > 10 THEN 'completed' ELSE 'queued' END AS state, cast(cast(l_shipdate as date) as string) AS started,
    CASE WHEN l_quantity > 10 AND l_quantity <= 40 THEN cast(cast(l_shipdate as date) as string) END AS completed, CASE WHEN l_partkey % 3 = 0 THEN concat('error ', l_partkey) WHEN l_partkey % 3 = 1 THEN '' END AS error, map(l_returnflag, cast(l_quantity as bigint), 'all', l_partkey - 20) AS storage"""


def chapters(spark, d):
    return read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _columns(CHAPTERS)])


def _columns(text: str) -> list[str]:
    """The parts between commas outside parentheses."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


CHAPTERS_SQL = """c AS (SELECT l_orderkey AS run, ['paragraphs', 'scenes', 'scene_embeddings', 'fragments', 'other'][CAST(l_linenumber % 5 + 1 AS INTEGER)] AS stage, l_partkey AS chapter, CAST(l_quantity AS BIGINT) AS tokens, l_returnflag AS flag, l_partkey - 20 AS rest,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failed' WHEN l_quantity > 40 THEN 'running' WHEN l_quantity > 10 THEN 'completed' ELSE 'queued' END AS state, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS started,
    CASE WHEN l_quantity > 10 AND l_quantity <= 40 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS completed, CASE WHEN l_partkey % 3 = 0 THEN concat('error ', l_partkey) END AS error FROM lineitem),
    r AS (SELECT run, stage, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN count(CASE WHEN state = 'failed' THEN 1 END) > 0 THEN 'failed' WHEN count(CASE WHEN state = 'running' THEN 1 END) > 0 THEN 'running' WHEN count(CASE WHEN state = 'completed' THEN 1 END) > 0 THEN 'completed' ELSE 'queued' END AS state,
        min(started) AS started, max(completed) AS completed, arg_min(error, chapter) FILTER (error IS NOT NULL) AS first_error FROM c GROUP BY 1, 2)"""


@query(f"""WITH {CHAPTERS_SQL}, b AS (SELECT run, stage, kind, greatest(0, sum(n)) AS n FROM (SELECT run, stage, flag AS kind, tokens AS n FROM c UNION ALL SELECT run, stage, 'all', rest FROM c) GROUP BY 1, 2, 3), s AS (SELECT run, stage, string_agg(kind || '=' || CAST(n AS BIGINT), ',' ORDER BY kind) AS storage FROM b GROUP BY 1, 2)
    SELECT r.run, r.stage, tokens, state, started, completed, CASE WHEN state = 'failed' THEN coalesce(first_error, 'Stage failed') END AS error, storage FROM r JOIN s ON s.run = r.run AND s.stage = r.stage""")
def stage_metrics(spark, d):
    """Stages of runs from their chapters: states, times, first errors and summed storage."""
    r = metering.stage_rollup(chapters(spark, d), ["run", "stage"], "chapter", ["tokens"])
    held = F.array_join(F.transform(F.array_sort(F.map_entries("storage")), lambda x: F.concat_ws("=", x.key, x.value.cast("string"))), ",")
    return r.withColumn("storage", held)


@query(f"""WITH {CHAPTERS_SQL}, o AS (SELECT run, stage, CASE state WHEN 'failed' THEN 1 WHEN 'running' THEN 2 WHEN 'queued' THEN 3 END AS u, list_position(['paragraphs', 'scenes', 'scene_embeddings', 'fragments', 'finalize'], stage) AS p FROM r),
    f AS (SELECT run, stage FROM o WHERE u IS NOT NULL AND p > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY u, p) = 1), d AS (SELECT o_orderkey AS run, o_orderstatus = 'F' AS done FROM orders)
    SELECT x.run, CASE WHEN done THEN 'finalize' ELSE coalesce(f.stage, 'finalize') END AS current_stage FROM (SELECT DISTINCT run FROM r) x JOIN d ON d.run = x.run LEFT JOIN f ON f.run = x.run""")
def current_stages(spark, d):
    """The stage that each run is in."""
    r = metering.stage_rollup(chapters(spark, d), ["run", "stage"], "chapter", ["tokens"])
    done = read(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("done"))
    return metering.current_stage(r.join(done, "run"), "run", F.col("done"))


@query("""WITH s AS (SELECT c_custkey AS book, c_custkey % 4 AS version, CAST(c_custkey % 3 AS VARCHAR) AS sha, c_custkey % 5 AS attempts FROM customer WHERE c_custkey % 4 > 0),
    u AS (SELECT o_custkey AS book, o_orderkey AS id, CAST(o_orderkey // 3 % 3 AS VARCHAR) AS sha FROM orders), p AS (SELECT u.*, s.version AS v, s.attempts AS n, coalesce(lag(u.sha) OVER (PARTITION BY u.book ORDER BY id), s.sha) AS before FROM u LEFT JOIN s ON s.book = u.book),
    k AS (SELECT *, CAST(coalesce(v, 0) + sum(CASE WHEN before = sha THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY id) AS BIGINT) AS version FROM p)
    SELECT book, id, sha, version, row_number() OVER (PARTITION BY book, version ORDER BY id) + CASE WHEN version = v THEN n ELSE 0 END AS attempt FROM k""")
def content_versions(spark, d):
    """Versions and attempts of uploads (orders of a customer) behind those that are stored."""
    stored = read(spark, d, "customer").where("c_custkey % 4 > 0").selectExpr("c_custkey AS book", "c_custkey % 4 AS version", "concat(c_custkey % 3, ' ') AS sha", "c_custkey % 5 AS attempts")
    uploads = read(spark, d, "orders").selectExpr("o_custkey AS book", "o_orderkey AS id", "cast(o_orderkey div 3 % 3 AS string) AS sha")
    return metering.versions(uploads, stored, "book", ["id"], "sha")


@query(f"""WITH {LISTS}, ca AS (SELECT query_id, ref, rank, CASE WHEN ref % 11 = 0 THEN '' ELSE 'r' || (ref % 6) END AS id, CASE WHEN ref % 13 = 0 THEN '' ELSE 'c' || ref END AS content FROM lx WHERE rank <= 20),
    st AS (SELECT DISTINCT query_id, query_id % 300 <> 0 AS enabled, CASE WHEN query_id % 700 = 0 THEN 'timeout' END AS failure FROM ca), sv AS (SELECT ca.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS position FROM ca JOIN st USING (query_id) WHERE id <> '' AND content <> '' AND enabled AND failure IS NULL),
    me AS (SELECT *, CASE WHEN position % 3 <> 1 AND query_id % 900 <> 200 THEN (position * 37 + ref) % 101 END AS rerank FROM sv), so AS (SELECT query_id, count(rerank) AS hits, count(*) AS n_sent FROM me GROUP BY 1),
    fi AS (SELECT st.query_id, coalesce(hits > 0, FALSE) AS used, CASE WHEN enabled THEN coalesce(failure, CASE WHEN n_sent > 0 AND hits = 0 THEN 'empty rerank result' END) END AS error FROM st LEFT JOIN so ON so.query_id = st.query_id),
    w AS (SELECT ca.query_id, ca.ref, ca.rank, used, error, CASE WHEN used THEN me.rerank END AS rerank, me.ref IS NOT NULL AS sent FROM ca JOIN fi ON fi.query_id = ca.query_id LEFT JOIN me ON me.query_id = ca.query_id AND me.ref = ca.ref),
    pl AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank IS NULL, rerank DESC, rank) AS INTEGER) AS place FROM w WHERE NOT used OR sent) SELECT query_id, ref, place, rerank, used, error FROM pl WHERE place <= 12""")
def ranked_anew(spark, d):
    """Candidates ranked anew by a model that is off, fails or answers nothing for some queries; ids repeat and are blank."""
    r = F.col("ref")
    c = second_list(spark, d).select("query_id", "ref", "rank", F.when(r % 11 == 0, "").otherwise(F.concat(F.lit("r"), (r % 6).cast("string"))).alias("id"), F.lit("").alias("title"), F.when(r % 13 == 0, "").otherwise(F.concat(F.lit("c"), r.cast("string"))).alias("content"))
    status = c.select("query_id").distinct().withColumns({"enabled": F.col("query_id") % 300 != 0, "failure": F.when(F.col("query_id") % 700 == 0, "timeout")})
    model = lambda sent: sent.where((F.col("position") % 3 != 1) & (F.col("query_id") % 900 != 200)).select("query_id", "unique_id", ((F.col("position") * 37 + r) % 101).alias("score"))
    return metering.ranked_anew(c, status, model, 12)


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events), j AS (SELECT *, CASE WHEN k % 3 = 0 THEN k * 10 END AS said_tokens, CASE WHEN k % 5 = 0 THEN -1E0 WHEN k % 5 = 1 THEN k / 1E3 END AS said_cost FROM e)
    SELECT event_id, coalesce(said_tokens, CAST(floor(value) AS BIGINT)) AS tokens, coalesce(CASE WHEN said_cost >= 0 THEN said_cost END, value * 2 / 1E6) AS usd FROM j WHERE k IS NOT NULL AND value IS NOT NULL""")
def legacy_turns(spark, d):
    """Turns of older records: what their JSON says, else what is computed; a number below 0, a text or a null says nothing."""
    k = F.get_json_object("props", "$.k").cast("int")
    tokens = F.when(k % 3 == 0, (k * 10).cast("string")).when(k % 3 == 1, "none")
    usd = F.when(k % 5 == 0, -1.0).when(k % 5 == 1, k / 1e3)
    e = read(spark, d, "events").withColumn("record", F.to_json(F.struct(tokens.alias("promptTokens"), usd.alias("costUsd")))).where(k.isNotNull() & F.col("value").isNotNull())
    return e.select("event_id", metering.explicit(F.col("record"), "promptTokens", F.floor("value"), "long").alias("tokens"), metering.explicit(F.col("record"), "costUsd", F.col("value") * 2 / 1e6).alias("usd"))
