"""Queries of ingest rules, search extras and the catalogue, by DataFrames; their SQL is written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import rules
from lexloom.functions import text as T
from lexloom.operators import evidence, intake, lexical, segment
from lexloom.plans.retrieval import ALL, BM25, FUZZY, FULL, ASK, HALF, LISTS, PARA, POST, SCENE, TERMS, WIN, asked, hits, lengths, near, paras, read, recall_mrr, second_list, GOLD

NOW = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
SQL_K = "CAST(json_extract_string(props, '$.k') AS INT)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def happened(spark, d):
    return read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""WITH t AS (SELECT doc_id, concat(lang, ':', source, ':', doc_id) AS s FROM documents), h AS (SELECT doc_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(unicode(substr(s, i, 1)) AS BIGINT))),
    lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS h FROM t) SELECT doc_id, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS lock_key FROM h""")
def lock_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", rules.lock_key(F.concat("lang", F.lit(":"), "source", F.lit(":"), F.col("doc_id").cast("string"))).alias("lock_key"))


@query(f"""WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Upstream: Connection Reset' WHEN 'click' THEN 'call failed, STATUS: ' || (400 + 2 * {SQL_K}) WHEN 'view' THEN 'bad request' WHEN 'signup' THEN 'request timed out' END AS message FROM events)
    SELECT event_id, regexp_matches(coalesce(lower(message), ''), 'status[ :=]+(408|429|5[0-9][0-9])|connection reset|timed out') AS retriable FROM m""")
def retry_class(spark, d):
    t = F.col("event_type")
    message = F.when(t == "error", "Upstream: Connection Reset").when(t == "click", F.concat(F.lit("call failed, STATUS: "), (400 + 2 * F.col("k")).cast("string"))).when(t == "view", "bad request").when(t == "signup", "request timed out")
    return happened(spark, d).select("event_id", rules.retriable(message).alias("retriable"))


@query("""SELECT w AS name, (SELECT count(*) FROM events WHERE h IS NULL OR ts >= TIMESTAMP '2024-01-31 00:00:00' - to_hours(h)) AS n FROM (VALUES ('24H ', 24), ('7d', 168), ('30d', 720), ('90d', 2160), ('all', NULL), ('odd', 720)) AS v(w, h)""")
def admin_windows(spark, d):
    names = ["24H ", "7d", "30d", "90d", "all", "odd"]
    inside = {n: F.coalesce(F.col("ts") >= rules.window_start(F.lit(n), F.expr(NOW)), F.lit(True)) for n in names}
    counted = happened(spark, d).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in inside.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in names))).alias("x")).select("x.*")


@query(f"""WITH {LISTS}, m AS (SELECT query_id, ref, s.score AS s, l.rank AS l, ref % 3 = 0 AS r, CASE WHEN ref % 3 = 0 THEN ((ref * 7) % 101) / 100E0 ELSE greatest(coalesce(s.score, 0), coalesce(floor(1E6 / (20 + l.rank) + 0.5) / 1E6, 0)) END AS score
    FROM (SELECT query_id, vec_id AS ref, score FROM near WHERE rank <= 20) s FULL JOIN (SELECT * FROM lx WHERE rank <= 20) l USING (query_id, ref))
    SELECT query_id, ref, score, CASE WHEN r AND score >= 0.75 THEN 'high' WHEN s IS NOT NULL AND l IS NOT NULL THEN 'high' WHEN score >= 0.55 OR (s IS NOT NULL)::INT + (l IS NOT NULL)::INT + r::INT >= 2 THEN 'medium' ELSE 'low' END AS level FROM m""")
def evidence_levels(spark, d):
    """Merged hits with the score of a second ranking where there is one (refs divisible by 3 stand for those it returned)."""
    s = near(spark, d, 20).select("query_id", F.col("vec_id").alias("ref"), F.col("score").alias("s"))
    m = s.join(second_list(spark, d).select("query_id", "ref", F.col("rank").alias("l")), ["query_id", "ref"], "full")
    again = F.when(F.col("ref") % 3 == 0, F.col("ref") * 7 % 101 / 100)
    score = F.coalesce(again, F.greatest(F.coalesce("s", F.lit(0.0)), F.coalesce(T.half_up(1 / (20 + F.col("l")), 6), F.lit(0.0))))
    by = F.array_compact(F.array(F.when(again.isNotNull(), "rerank"), F.when(F.col("s").isNotNull(), "semantic"), F.when(F.col("l").isNotNull(), "lexical")))
    return m.select("query_id", "ref", score.alias("score"), rules.confidence(score, by).alias("level"))


@query("""WITH i AS (SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type ELSE ' ' END AS raw, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
    b AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'record_' || pos ELSE raw END AS base FROM i), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, base ORDER BY pos) - 1 AS dup FROM b)
    SELECT event_id, CASE WHEN dup = 0 THEN base ELSE base || '__dup_' || dup || '_' || pos END AS unique_id FROM n""")
def rerank_ids(spark, d):
    e = happened(spark, d).withColumn("raw", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" "))
    placed = e.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return intake.unique_ids(placed, "user_id", "raw", "position").select("event_id", "unique_id")


@query(f"""WITH q AS (SELECT conv_id, turn, len(list_distinct({TERMS('text')})) AS n FROM conversations WHERE role = 'user'), s AS (SELECT *, CASE WHEN n >= 8 THEN 12 ELSE 8 END AS k FROM q),
    c AS (SELECT *, greatest(k, least(60, 80, 5 * k)) AS cand FROM s) SELECT conv_id, turn, n AS n_terms, k, cand AS candidates, greatest(12, least(40, 3 * cand)) AS probe FROM c""")
def question_sizes(spark, d):
    q = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce(rules.n_terms(F.col("text")), F.lit(0)).alias("n_terms"), rules.answer_size(F.col("text")).alias("k"))
    return q.withColumn("candidates", rules.candidates(F.col("k"), 60)).withColumn("probe", rules.probe(F.col("candidates")))


@query(r"""WITH s AS (SELECT conv_id, turn, g.i AS part, regexp_replace(l[g.i], '^\s+|\s+$', '', 'g') AS query FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]') AS l FROM conversations WHERE role = 'user') t, unnest(range(1, len(l) + 1)) AS g(i)),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, regexp_replace(lower(query), '\s+', ' ', 'g') ORDER BY turn, part) AS r FROM s WHERE query <> ''),
    p AS (SELECT conv_id, query, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS INTEGER) AS place FROM f WHERE r = 1) SELECT * FROM p WHERE place <= 8""")
def query_pool(spark, d):
    """The queries of each conversation: the sentences of the user's turns."""
    s = read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(F.split("text", r"[.\n]")).alias("part", "query"))
    return intake.query_pool(s, "conv_id", ["turn", "part"])


@query(r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents),
    b AS (SELECT doc_id, t, CAST(g.i AS INTEGER) AS block, l[g.i] AS text, sum(length(l[g.i]) + 2) OVER (PARTITION BY doc_id ORDER BY g.i) AS upto FROM (SELECT doc_id, t, string_split(t, chr(10) || chr(10)) AS l FROM c WHERE t <> '') x, unnest(range(1, len(l) + 1)) AS g(i))
    SELECT doc_id, block, CAST(upto - length(text) - 2 AS INTEGER) AS start_char, CAST(upto - 2 AS INTEGER) AS end_char, text, substr(t, CAST(upto - length(text) - 1 AS INTEGER), length(text)) = text AS there FROM b""")
def block_offsets(spark, d):
    """Blocks of the documents with every line as a block."""
    docs = read(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    whole = docs.select("doc_id", T.canonical(F.col("text")).alias("t"))
    return intake.block_offsets(docs).join(whole, "doc_id").withColumn("there", F.substr("t", F.col("start_char") + 1, F.length("text")) == F.col("text")).drop("t")


LINES = """concat(CASE doc_id % 7 WHEN 0 THEN concat(doc_id, '-', doc_id + 3, ' | part ', quality, ' | first; First ;second;; third | a; b | c;A') WHEN 1 THEN concat(doc_id, '<', doc_id + 2, '<tabbed part<f1; f2<name') WHEN 2 THEN '```tsv'
    WHEN 3 THEN 'only | two' WHEN 4 THEN concat(doc_id, ' – ', doc_id + 1, '|dash|one|x|') WHEN 5 THEN concat(doc_id + 4, '|', doc_id, '|turned|one|x') ELSE concat(doc_id, '|', doc_id, '| |one|x') END, '  ')"""


@query(f"""WITH l AS (SELECT doc_id, quality FROM labels), u AS (
    SELECT doc_id, doc_id AS a, doc_id + 3 AS b, concat('part ', quality) AS summary, 'first|second|third' AS beats, 'a|b|c' AS anchors, NULL AS error FROM l WHERE doc_id % 7 = 0
    UNION ALL SELECT doc_id, doc_id, doc_id + 2, 'tabbed part', 'f1|f2', 'name', NULL FROM l WHERE doc_id % 7 = 1 UNION ALL SELECT doc_id, doc_id, doc_id + 1, 'dash', 'one', 'x', NULL FROM l WHERE doc_id % 7 = 4
    UNION ALL SELECT doc_id, doc_id + 4, doc_id, 'turned', 'one', 'x', 'outside' FROM l WHERE doc_id % 7 = 5 UNION ALL SELECT doc_id, doc_id, doc_id, '', 'one', 'x', 'no summary' FROM l WHERE doc_id % 7 = 6)
    SELECT doc_id, CAST(a AS INTEGER) AS paragraph_start, CAST(b AS INTEGER) AS paragraph_end, summary, beats, anchors, CASE WHEN a < 2 OR b > 100 AND b > doc_id + 3 THEN 'outside' ELSE error END AS error FROM u""")
def search_units(spark, d):
    """Lines of all shapes made of the labels' ids, each against its own bounds (2 to its id and 3)."""
    lines = read(spark, d, "labels").select("doc_id", F.replace(F.expr(LINES), F.lit("<"), F.lit("\t")).alias("line"), F.lit(2).alias("lo"), F.greatest(F.lit(100), F.col("doc_id") + 3).alias("hi"))
    u = intake.search_units(lines)
    return u.select("doc_id", "paragraph_start", "paragraph_end", "summary", F.array_join("beats", "|").alias("beats"), F.array_join("anchors", "|").alias("anchors"), "error")


@query(f"""WITH r AS (SELECT user_id, {SQL_K} % 50 AS item, min(ts) AS since FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND {SQL_K} IS NOT NULL GROUP BY 1, 2), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY since, item) AS INTEGER) AS place FROM r),
    o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT user_id, item, place, coalesce(n, 0) + place <= 5 AS added FROM p LEFT JOIN o ON o_custkey = user_id""")
def library_adds(spark, d):
    asked_for = happened(spark, d).where("event_type = 'click' AND user_id IS NOT NULL AND k IS NOT NULL").select("user_id", (F.col("k") % 50).alias("item"), F.col("ts").alias("at"))
    owned = read(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    return intake.with_slots(asked_for, owned)


@query("""WITH h AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') SELECT c_custkey AS user_id, c_nationkey AS scope, (SELECT count(*) FROM h x WHERE x.c_nationkey = h.c_nationkey) > (SELECT count(*) FROM h y WHERE y.c_nationkey = h.c_nationkey AND y.c_acctbal < 4000 AND y.c_custkey <= h.c_custkey) AS allowed FROM h WHERE c_acctbal < 4000""")
def role_updates(spark, d):
    holders = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("scope"), "c_acctbal")
    return intake.guarded(holders.where("c_acctbal < 4000"), holders, "scope", "user_id").select("user_id", "scope", "allowed")


@query("""SELECT c_custkey AS book, count(o_orderkey) AS runs, CASE WHEN count(CASE WHEN o_orderstatus = 'P' THEN 1 END) > 0 THEN 'rejected' ELSE 'queued' END AS state, CASE WHEN count(CASE WHEN o_orderstatus = 'P' THEN 1 END) > 0 THEN NULL ELSE count(o_orderkey) + 1 END AS attempt FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def analysis_requests(spark, d):
    """A new run for every book but those with one queued or running (open orders stand for such runs)."""
    runs = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("book")).agg(F.count("*").alias("runs"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("busy"))
    books = read(spark, d, "customer").select(F.col("c_custkey").alias("book")).join(runs, "book", "left").fillna(0)
    return books.select("book", "runs", F.when(F.col("busy") > 0, "rejected").otherwise("queued").alias("state"), F.when(F.col("busy") == 0, F.col("runs") + 1).alias("attempt"))


@query("""SELECT concat('/books/', c_custkey) AS url, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS modified FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_custkey ORDER BY modified DESC NULLS LAST, url""")
def sitemap(spark, d):
    last = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").cast("date").cast("string").alias("modified"))
    public = read(spark, d, "customer").where("c_acctbal > 0").join(last, "c_custkey", "left")
    return public.select(F.concat(F.lit("/books/"), F.col("c_custkey").cast("string")).alias("url"), "modified").orderBy(F.desc_nulls_last("modified"), "url")


@query(f"WITH {PARA} SELECT doc_id, CAST(count(*) AS INTEGER) AS n, string_agg(text, chr(10) ORDER BY paragraph_index) AS content FROM para GROUP BY doc_id")
def chapter_content(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("paragraph_index", "text")))
    return paras(spark, d).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.array_join(F.transform(ordered, lambda x: x.text), "\n").alias("content"))


@query("""SELECT conv_id, string_agg(concat(turn, ':', role, ':', coalesce(CAST(quality AS VARCHAR), '-')), ',' ORDER BY turn, role) AS messages, count(quality) AS measured FROM conversations LEFT JOIN labels ON doc_id = conv_id AND role = 'assistant' GROUP BY conv_id""")
def message_list(spark, d):
    """Messages in order, an assistant's with its metric where there is one."""
    metric = read(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.lit("assistant").alias("role"), "quality")
    said = read(spark, d, "conversations").join(metric, ["conv_id", "role"], "left")
    one = F.concat_ws(":", F.col("turn").cast("string"), "role", F.coalesce(F.col("quality").cast("string"), F.lit("-")))
    return said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", one.alias("m")))), lambda x: x.m), ",").alias("messages"), F.count("quality").alias("measured"))


@query("""WITH r AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT o_orderkey AS run, o_orderstatus AS state, string_agg(concat(l_linenumber, l_linestatus), ',' ORDER BY l_linenumber, l_linestatus) FILTER (l_linenumber IS NOT NULL) AS stages, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS tokens FROM r LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def run_details(spark, d):
    runs = read(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("state"))
    stages = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_linestatus", "l_quantity")
    of_runs = runs.join(stages, "run", "left").groupBy("run", "state").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus"))).alias("s"), F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long").alias("tokens"))
    listed = F.transform(F.filter("s", lambda x: x.l_linenumber.isNotNull()), lambda x: F.concat(x.l_linenumber.cast("string"), x.l_linestatus))
    return of_runs.select("run", "state", F.nullif(F.array_join(listed, ","), F.lit("")).alias("stages"), "tokens")


@query("SELECT l_orderkey AS run, l_linenumber AS artifact, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS total FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 200 OFFSET 200")
def artifact_page(spark, d):
    rows = intake.matching(read(spark, d, "lineitem"), l_returnflag=["R"], l_quantity_min=0, l_suppkey=None)
    return intake.page(rows, [F.desc("l_shipdate"), "l_orderkey", "l_linenumber"], 2, 200).select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("artifact"), "total")


@query("""WITH b AS (SELECT o_custkey AS u, count(*) AS books, sum(o_totalprice) AS usd FROM orders GROUP BY 1), t AS (SELECT user_id AS u, count(*) AS threads FROM events WHERE event_type = 'signup' GROUP BY 1), m AS (SELECT user_id AS u, count(*) AS turns, sum(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT c_custkey AS user_id, coalesce(books, 0) AS books, round(coalesce(usd, 0), 2) AS usd, coalesce(threads, 0) AS threads, coalesce(turns, 0) AS turns, round(coalesce(v, 0), 4) AS chat_value FROM customer LEFT JOIN b ON b.u = c_custkey LEFT JOIN t ON t.u = c_custkey LEFT JOIN m ON m.u = c_custkey""")
def user_detail(spark, d):
    """Facts grouped each by itself before they meet, so that none multiplies another's sums; chat comes in one pass."""
    owner = F.col("c_custkey").alias("user_id")
    book = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("books"), F.sum("o_totalprice").alias("usd"))
    click = F.col("event_type") == "click"
    chat = happened(spark, d).groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "signup", 1)).alias("threads"), F.count(F.when(click, 1)).alias("turns"), F.sum(F.when(click, F.col("value"))).alias("chat_value"))
    all_users = read(spark, d, "customer").select(owner).join(book, "user_id", "left").join(chat, "user_id", "left").fillna(0)
    return all_users.withColumn("usd", F.round("usd", 2)).withColumn("chat_value", F.round("chat_value", 4))


@query("""WITH r AS (SELECT event_id, user_id, ts, date_trunc('hour', ts) AS w, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'view'))
    SELECT event_id, n <= 1 AS allowed, greatest(1 - n, 0) AS remaining, CASE WHEN n <= 1 THEN 0 ELSE CAST(greatest(1, ceil((epoch_us(w) + 3600000000 - epoch_us(ts)) / 1E6)) AS INTEGER) END AS retry_after FROM r""")
def complaint_intake(spark, d):
    return intake.limited(happened(spark, d).where("event_type IN ('error', 'view')"), "user_id", "ts", "event_id", 1, 3600).select("event_id", "allowed", "remaining", "retry_after")


@query("""WITH g AS (SELECT l_orderkey AS book, count(*) AS n, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS done FROM lineitem GROUP BY 1) SELECT book, n, done, CASE WHEN done = n THEN 'completed' WHEN done > 0 THEN 'running' ELSE 'queued' END AS state, CASE WHEN done = n THEN concat('book.completed:', book) END AS event FROM g""")
def progress_snapshots(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("book")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("done"))
    all_done = F.col("done") == F.col("n")
    return g.withColumn("state", F.when(all_done, "completed").when(F.col("done") > 0, "running").otherwise("queued")).withColumn("event", F.when(all_done, F.concat(F.lit("book.completed:"), F.col("book").cast("string"))))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('{"q": ', quality, '}') WHEN 1 THEN concat('{"q": ', quality, '}') WHEN 2 THEN concat('{"q": {"a": ', quality, '}}') END AS answer FROM labels""")
def answers_json(spark, d):
    """Model answers of six shapes: bare, fenced, in prose, broken, none, and a list."""
    q = F.col("quality").cast("string")
    shapes = [F.concat(F.lit(' {"q": '), q, F.lit("} ")), F.concat(F.lit('Here:\n```JSON\n{"q": '), q, F.lit("}\n``` {")), F.concat(F.lit('so {"q": {"a": '), q, F.lit("}} it is")), F.lit('{"q": '), F.lit("nothing"), F.lit("[1, 2]")]
    return read(spark, d, "labels").select("doc_id", rules.lenient_json(F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int"))).alias("answer"))


@query(ALL + f", h AS (SELECT t.*, p.text, CASE rank % 4 WHEN 0 THEN 900 WHEN 1 THEN 1200 WHEN 2 THEN 1400 ELSE 18000 END AS cap FROM tp t JOIN para p ON p.doc_id = t.doc_id AND p.paragraph_index = t.paragraph_index WHERE rank <= 10) SELECT query_id, rank, score, CASE WHEN length(text) <= cap THEN text ELSE substr(text, 1, cap - 3) || '...' END AS text FROM h")
def shaped_hits(spark, d):
    kinds = F.array(*(F.lit(k) for k in rules.SHAPED))
    return hits(spark, d, 10).join(paras(spark, d).select("doc_id", "paragraph_index", "text"), ["doc_id", "paragraph_index"]).select("query_id", "rank", "score", rules.shaped(F.col("text"), F.element_at(kinds, F.col("rank") % 4 + 1)).alias("text"))


@query(ALL + """, g AS (SELECT t.query_id, t.doc_id, s.scene_index, s.paragraph_start, s.paragraph_end, min(rank) AS r FROM tp t JOIN scene s ON s.doc_id = t.doc_id AND t.paragraph_index BETWEEN s.paragraph_start AND s.paragraph_end WHERE rank <= 20 GROUP BY ALL),
    c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INTEGER) AS place FROM g), x AS (SELECT c.query_id, c.doc_id, c.scene_index, c.paragraph_start, c.paragraph_end, place, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_index) AS t FROM c JOIN para p ON p.doc_id = c.doc_id AND p.paragraph_index BETWEEN c.paragraph_start AND c.paragraph_end WHERE place <= 8 GROUP BY ALL)
    SELECT query_id, doc_id, scene_index, paragraph_start, paragraph_end, place, CASE WHEN length(t) <= 220 THEN t ELSE substr(t, 1, 217) || '...' END AS reason FROM x""")
def citations(spark, d):
    """The scenes of a query's hits as evidence, in the hits' order."""
    p = paras(spark, d)
    scenes = segment.scenes(segment.sizes(p))
    found = segment.first_scene(hits(spark, d).select("query_id", "doc_id", "paragraph_index", "rank"), scenes).join(scenes, ["doc_id", "scene_index"])
    text = evidence.slice_text(p, found.select("doc_id", "paragraph_start", "paragraph_end").distinct())
    return intake.citations(found.join(text, ["doc_id", "paragraph_start", "paragraph_end"]), "rank")


@query(f"""WITH r AS (SELECT user_id, {SQL_K} AS k, value FROM events WHERE event_type <> 'view') SELECT user_id, count(*) AS calls, CAST(sum(CAST(greatest(0, floor(coalesce(value, 0) + 0.5)) AS BIGINT)) AS BIGINT) AS records, count(CASE WHEN k % 3 <> 0 THEN 1 END) AS failed, round(sum(CASE WHEN k % 3 = 0 THEN 1E-3 ELSE 0 END), 6) AS cost_usd FROM r WHERE k % 3 = 0 OR k % 5 = 0 GROUP BY 1""")
def rerank_spend(spark, d):
    runs = happened(spark, d).select("user_id", (F.col("event_type") != "view").alias("enabled"), (F.col("k") % 3 == 0).alias("used"), F.when(F.col("k") % 5 == 0, "timeout").alias("error"), F.col("value").alias("records"), F.lit(8.0).alias("returned"), F.col("k").alias("latency"))
    calls = intake.rerank_calls(runs, 1.0)
    return calls.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("records").alias("records"), F.count("error").alias("failed"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("""WITH a AS (SELECT ps_user, id, min(o) AS o FROM (SELECT user_id AS ps_user, CAST(event_id % 40 AS INT) AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS o FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1, 2)
    SELECT ps_user AS user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY o) AS both_ids, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY o) FILTER (NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = ps_user AND e.event_type = 'purchase' AND e.event_id % 40 = id)), '') AS missing FROM a GROUP BY 1""")
def id_sets(spark, d):
    """Ids of clicks, then of purchases not among them, in order; and those of clicks alone."""
    e = happened(spark, d).where("event_type IN ('click', 'purchase')").withColumn("id", (F.col("event_id") % 40).cast("int"))
    of = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "id")))), lambda x: x.id)
    both = e.groupBy("user_id").agg(of("click").alias("a"), of("purchase").alias("b"))
    return both.select("user_id", F.array_join(F.array_union("a", "b"), ",").alias("both_ids"), F.array_join(F.array_except("a", "b"), ",").alias("missing"))


@query(ALL + "SELECT query_id, doc_id, paragraph_index, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, paragraph_index) AS by_score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id, paragraph_index) AS by_place FROM tp WHERE rank <= 20")
def sort_switch(spark, d):
    place = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    return hits(spark, d).select("query_id", "doc_id", "paragraph_index", place(F.desc("score"), "doc_id", "paragraph_index").alias("by_score"), place("doc_id", "paragraph_index").alias("by_place"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 50 ORDER BY doc_id LIMIT 40")
def keyset_batch(spark, d):
    return intake.batch_after(read(spark, d, "documents"), "doc_id", 50, 40).select("doc_id", "lang")


@query(f"""WITH {SCENE}, e AS (SELECT p.source, p.doc_id, p.paragraph_index, s.scene_index, length(concat_ws(chr(10), 'Document: ' || p.doc_id, CASE WHEN s.scene_index % 5 > 0 THEN 'Scene: ' || s.scene_index END, '', p.text)) AS n FROM para p JOIN scene s ON s.doc_id = p.doc_id AND p.paragraph_index BETWEEN s.paragraph_start AND s.paragraph_end)
    SELECT doc_id, count(*) AS paragraphs, count(CASE WHEN scene_index % 5 > 0 THEN 1 END) AS with_scene, round(avg(n), 4) AS avg_chars, max(n) AS max_chars FROM e GROUP BY doc_id""")
def embedding_sources(spark, d):
    """The texts to embed: what a paragraph stands in, an empty line, its text. Every fifth scene stands for none."""
    p = paras(spark, d)
    placed = segment.first_scene(p, segment.scenes(segment.sizes(p)))
    scene = F.when(F.col("scene_index") % 5 > 0, F.concat(F.lit("Scene: "), F.col("scene_index").cast("string")))
    text = F.concat_ws("\n", F.concat(F.lit("Document: "), F.col("doc_id").cast("string")), scene, F.lit(""), "text")
    return placed.select("doc_id", scene.isNotNull().alias("w"), F.length(text).alias("n")).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count(F.when(F.col("w"), 1)).alias("with_scene"), F.round(F.avg("n"), 4).alias("avg_chars"), F.max("n").alias("max_chars"))


SQL_FLAT = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


@query(f"""WITH s AS (SELECT doc_id, substr(text, 1, 200) AS summary, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 150) WHEN 1 THEN substr(text, 30, 400) ELSE concat('so ', lower(text)) END AS source FROM documents),
    n AS (SELECT doc_id, length(regexp_replace(summary, '^\\s+|\\s+$', '', 'g')) AS chars, {SQL_FLAT.format('summary')} AS a, {SQL_FLAT.format('source')} AS b FROM s), m AS (SELECT *, greatest(40, CAST(floor(length(a) * 0.6E0) AS INTEGER)) AS k, replace(a, ' ', '') AS dense FROM n),
    f AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, ch, count(*) AS c FROM (SELECT doc_id, unnest(string_split(dense, '')) AS ch FROM m) GROUP BY ALL) GROUP BY 1)
    SELECT m.doc_id, chars < 60 OR coalesce(top, 0) * 2 > length(dense) OR (length(b) >= 20 AND (a = b OR (length(b) >= k AND (contains(a, substr(b, 1, k)) OR contains(b, substr(a, 1, k)))))) AS suspicious FROM m LEFT JOIN f ON f.doc_id = m.doc_id""")
def suspicious_summaries(spark, d):
    """Beginnings of documents as summaries, against sources that repeat them, begin within them or hold them."""
    docs, text = read(spark, d, "documents"), F.col("text")
    source = F.when(F.col("doc_id") % 3 == 0, F.substring(text, 1, 150)).when(F.col("doc_id") % 3 == 1, F.substring(text, 30, 400)).otherwise(F.concat(F.lit("so "), F.lower(text)))
    return docs.select("doc_id", rules.suspicious(F.substring(text, 1, 200), F.array(source)).alias("suspicious"))


FRAG = f"{SCENE.replace('para AS', 'para0 AS', 1).replace('FROM para GROUP', 'FROM para0 GROUP')}, {WIN}, para AS (SELECT any_value(source) AS source, w.doc_id, window_start AS paragraph_index, scene_index, max(window_end) AS window_end, string_agg(text, chr(10) || chr(10) ORDER BY p.paragraph_index) AS text FROM win w JOIN para0 p ON p.doc_id = w.doc_id AND p.paragraph_index BETWEEN window_start AND window_end GROUP BY w.doc_id, window_start, scene_index)"


@query(f"WITH {FRAG}, {ASK}, {POST}, {BM25}, {FULL} SELECT query_id, doc_id, paragraph_index AS window_start, score, rank FROM tp WHERE rank <= 32")
def fragment_search(spark, d):
    """Lexical search over windows of five paragraphs in scenes, with the windows' own statistics; 32 results at most."""
    p = paras(spark, d)
    windows = segment.windows_in(segment.scenes(segment.sizes(p)), 5, 2).withColumnsRenamed({"window_start": "paragraph_start", "window_end": "paragraph_end"})
    text = evidence.slice_text(p, windows.select("doc_id", "paragraph_start", "paragraph_end")).withColumnRenamed("paragraph_start", "paragraph_index")
    return lexical.top(lexical.full_score(text, asked(spark)), 32).withColumnRenamed("paragraph_index", "window_start")


@query(f"WITH q AS ({GOLD}) SELECT count(*) AS questions, {HALF('avg(recall_5)')} AS recall_5, {HALF('avg(recall_10)')} AS recall_10, {HALF('avg(mrr)')} AS mrr, {HALF('avg(CASE WHEN mrr > 0 THEN 1E0 ELSE 0 END)')} AS hit_rate FROM q")
def eval_means(spark, d):
    mean = lambda c: T.half_up(F.avg(c), 6)
    return recall_mrr(spark, d).agg(F.count("*").alias("questions"), mean("recall_5").alias("recall_5"), mean("recall_10").alias("recall_10"), mean("mrr").alias("mrr"), mean((F.col("mrr") > 0).cast("double")).alias("hit_rate"))
