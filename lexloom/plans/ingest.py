"""Segmentation responses, inline runs, joins by either key, anchored periods and nested exports, with SQL written apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import rules
from lexloom.operators import intake, planning
from lexloom.plans.retrieval import PARA, PROPOSED, lengths, paras, parsers, proposals, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def responses(spark, d):
    """A segmentation response for each document, of its irregular intervals: in three notations, after a fence; by the last
    digit of the id some are empty, without units, with a blank summary, or reach beyond the end."""
    units = proposals(spark, d).join(lengths(spark, d), "doc_id")
    s, digit = F.col("paragraph_start"), F.col("doc_id") % 10
    end = F.when((digit == 7) & (s + 5 > F.col("n")), F.col("n") + 1).otherwise(F.col("paragraph_end"))
    summary = F.when((digit == 3) & (s == 6), "").otherwise(F.concat(F.lit("unit "), s.cast("string")))
    beats = F.concat(F.lit("b"), s.cast("string"), F.lit("; B"), s.cast("string"), F.lit(";; x"))
    tab = F.lit("\t")
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(s.cast("string"), F.lit("-"), end.cast("string"), F.lit(" | "), summary, F.lit(" | "), beats, F.lit(" | a; b | c; A ")))
    line = line.when(F.col("doc_id") % 3 == 1, F.concat(s.cast("string"), tab, end.cast("string"), tab, summary, tab, beats, tab, F.lit("a; b;c")))
    line = line.otherwise(F.concat(F.lit("  "), s.cast("string"), F.lit(" – "), end.cast("string"), F.lit("|"), summary, F.lit("|"), beats, F.lit("|a|b; c")))
    joined = F.concat(F.lit("```tsv\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(s.alias("s"), line.alias("t")))), lambda x: x.t), "\r\n"))
    told = units.groupBy("doc_id").agg(joined.alias("content"), F.max("n").alias("hi"))
    content = F.when(digit == 9, F.lit(" \n")).when(digit == 5, F.lit("no lines\nhere | x")).otherwise(F.col("content"))
    return told.select(F.col("doc_id").alias("segment_id"), content.alias("content"), F.lit(1).alias("lo"), "hi")


@query(f"""WITH {PROPOSED}, s AS (SELECT *, coalesce(max(paragraph_end) OVER (PARTITION BY doc_id ORDER BY paragraph_start, paragraph_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM prop),
    k AS (SELECT doc_id, paragraph_start AS named, greatest(paragraph_start, reach + 1) AS s FROM s WHERE paragraph_end > reach), m AS (SELECT doc_id, named, s, row_number() OVER w AS i, lead(s) OVER w AS nx FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY s))
    SELECT m.doc_id AS segment_id, CAST(i AS INTEGER) AS scene_index, CASE WHEN i = 1 THEN 1 ELSE s END AS paragraph_start, coalesce(nx - 1, n) AS paragraph_end, 'unit ' || named AS summary, 'b' || named || '|x' AS beats, 'a|b|c' AS anchors
    FROM m JOIN sz ON sz.doc_id = m.doc_id WHERE m.doc_id % 10 NOT IN (5, 7, 9) AND NOT (m.doc_id % 10 = 3 AND n >= 6)""")
def segmentation_responses(spark, d):
    """The scenes of the responses that have no error, parsed and repaired."""
    scenes, _ = intake.segmentation(responses(spark, d))
    return scenes.withColumns({c: F.array_join(c, "|") for c in ("beats", "anchors")})


@query(f"""WITH {PROPOSED}, c AS (SELECT doc_id, count(*) AS units FROM prop GROUP BY 1)
    SELECT doc_id AS segment_id, CAST(CASE doc_id % 10 WHEN 3 THEN 3 WHEN 7 THEN units + 1 END AS INTEGER) AS line, CASE doc_id % 10 WHEN 3 THEN 'no summary' WHEN 7 THEN 'outside' WHEN 9 THEN 'empty response' ELSE 'no units' END AS error
    FROM c WHERE doc_id % 10 IN (5, 7, 9) OR (doc_id % 10 = 3 AND units >= 2)""")
def segmentation_errors(spark, d):
    """The responses that have an error, with its line."""
    return intake.segmentation(responses(spark, d))[1]


@query(f"""WITH {PROPOSED}, w AS (SELECT *, lag(paragraph_end) OVER o AS before, lead(paragraph_start) OVER o AS after FROM prop JOIN sz USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph_start, paragraph_end)),
    e AS (SELECT doc_id, paragraph_start, CASE WHEN before IS NULL AND paragraph_start <> 1 THEN 'start' WHEN paragraph_start > before + 1 THEN 'gap' WHEN paragraph_start <= before THEN 'overlap' WHEN after IS NULL AND paragraph_end <> n THEN 'end' END AS error FROM w)
    SELECT doc_id AS segment_id, arg_min(error, paragraph_start) AS error FROM e WHERE error IS NOT NULL GROUP BY 1""")
def segmentation_strict(spark, d):
    """What the strict form has against the documents' irregular intervals."""
    units = proposals(spark, d).join(lengths(spark, d), "doc_id")
    return intake.strict_segmentation(units.select(F.col("doc_id").alias("segment_id"), F.lit(1).alias("lo"), F.col("n").alias("hi"), "paragraph_start", "paragraph_end"))


@query(f"""WITH {PARA}, r AS (SELECT doc_id, paragraph_index, doc_id * 1000000 + paragraph_index AS id, length(text) AS n FROM para),
    l AS (SELECT doc_id AS d, paragraph_index AS i, CASE WHEN (doc_id + paragraph_index) % 4 IN (0, 2) THEN id - CASE WHEN paragraph_index % 5 = 0 THEN 1 ELSE 0 END END AS ref_id, doc_id AS ref_doc, CASE WHEN (doc_id + paragraph_index) % 4 IN (1, 2) THEN paragraph_index ELSE -paragraph_index END AS ref_index FROM r)
    SELECT l.d, l.i, r.id AS found_id, r.n AS found_n FROM l LEFT JOIN r ON r.id = l.ref_id OR (r.doc_id = l.ref_doc AND r.paragraph_index = l.ref_index)""")
def join_by_either(spark, d):
    """References to paragraphs by id, by place, by both (some to two different ones), and by neither."""
    p = paras(spark, d).select("doc_id", "paragraph_index", (F.col("doc_id") * 1_000_000 + F.col("paragraph_index")).alias("id"), F.length("text").alias("n"))
    kind = (F.col("doc_id") + F.col("paragraph_index")) % 4
    ref_id = F.when(kind.isin(0, 2), F.col("id") - F.when(F.col("paragraph_index") % 5 == 0, 1).otherwise(0))
    left = p.select(F.col("doc_id").alias("d"), F.col("paragraph_index").alias("i"), ref_id.alias("ref_id"), F.col("doc_id").alias("ref_doc"), F.when(kind.isin(1, 2), F.col("paragraph_index")).otherwise(-F.col("paragraph_index")).alias("ref_index"))
    right = p.select(F.col("id").alias("ref_id"), F.col("doc_id").alias("ref_doc"), F.col("paragraph_index").alias("ref_index"), F.col("id").alias("found_id"), F.col("n").alias("found_n"))
    return intake.either_join(left, right, (["ref_id"], ["ref_doc", "ref_index"]), ["found_id", "found_n"]).select("d", "i", "found_id", "found_n")


@query()
def page_runs(spark, d):
    """The inline runs of every block of every page: text with the same marks."""
    runs = parsers().html_blocks(read(spark, d, "pages")).select("page_id", "block", F.posexplode("runs").alias("run", "r"))
    return runs.select("page_id", "block", "run", F.col("r.text").alias("text"), F.array_join("r.marks", "+").alias("marks"))


@query("""WITH a AS (SELECT user_id, min(ts) AS anchor FROM events GROUP BY 1), e AS (SELECT e.user_id, anchor, event_type, ts, (year(ts) - year(anchor)) * 12 + month(ts) - month(anchor) AS k FROM events e JOIN a ON a.user_id = e.user_id WHERE event_type IN ('purchase', 'view')),
    p AS (SELECT *, CASE WHEN anchor + to_months(CAST(k AS INTEGER)) <= ts THEN k ELSE k - 1 END AS period FROM e)
    SELECT user_id, epoch_us(anchor + to_months(CAST(period AS INTEGER))) AS period_start, epoch_us(anchor + to_months(CAST(period + 1 AS INTEGER))) AS period_end, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS pro, count(CASE WHEN event_type = 'view' THEN 1 END) AS lite,
        greatest(5 - count(CASE WHEN event_type = 'purchase' THEN 1 END), 0) AS pro_left, count(CASE WHEN event_type = 'view' THEN 1 END) >= 40 AS lite_exhausted FROM p GROUP BY user_id, anchor, period""")
def quota_periods(spark, d):
    """Uses by months from each user's first event, at its time of day, against a plan's limits."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    anchors = e.groupBy("user_id").agg(F.min("ts").alias("anchor"))
    used = e.where("event_type IN ('purchase', 'view')").join(anchors, "user_id").withColumn("period", rules.period_of(F.col("anchor"), F.col("ts")))
    g = used.groupBy("user_id", "anchor", "period").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("pro"), F.count(F.when(F.col("event_type") == "view", 1)).alias("lite"))
    bound = lambda k: F.unix_micros(rules.month_on(F.col("anchor"), k))
    return g.select("user_id", bound(F.col("period")).alias("period_start"), bound(F.col("period") + 1).alias("period_end"), "pro", "lite", F.greatest(5 - F.col("pro"), F.lit(0)).alias("pro_left"), (F.col("lite") >= 40).alias("lite_exhausted"))


@query("""WITH l AS (SELECT l_orderkey, list({'line': l_linenumber, 'part': l_partkey, 'shipped': CAST(CAST(l_shipdate AS DATE) AS VARCHAR)} ORDER BY l_linenumber, l_partkey, l_shipdate) AS lines FROM lineitem GROUP BY 1),
    o AS (SELECT o_custkey, list({'id': o_orderkey, 'status': o_orderstatus, 'lines': coalesce(lines, [])} ORDER BY o_orderkey) AS orders FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
    e AS (SELECT user_id, list({'id': event_id, 'type': event_type} ORDER BY event_id) AS events FROM events GROUP BY 1)
    SELECT c_custkey AS id, CAST(to_json({'id': c_custkey, 'name': c_name, 'nation': n_name, 'orders': coalesce(orders, []), 'events': coalesce(events, [])}) AS VARCHAR) AS export FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""")
def account_export(spark, d):
    """Everything of a customer as one JSON text: orders with their lines, and events, each level in order."""
    held = lambda rows, key, order, names: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*names).alias("v")))), lambda x: x.v).alias("held"))
    line = [F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").cast("date").cast("string").alias("shipped")]
    lines = held(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], line)
    o = read(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    empty = lambda c, like: F.coalesce(c, F.array().cast(like))
    orders = held(o, "o_custkey", ["o_orderkey"], [F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), empty(F.col("held"), dict(lines.dtypes)["held"]).alias("lines")]).withColumnRenamed("held", "orders")
    events = held(read(spark, d, "events"), "user_id", ["event_id"], [F.col("event_id").alias("id"), F.col("event_type").alias("type")]).withColumnRenamed("held", "events")
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").join(events, F.col("user_id") == F.col("c_custkey"), "left")
    whole = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"), empty(F.col("orders"), dict(orders.dtypes)["orders"]).alias("orders"), empty(F.col("events"), dict(events.dtypes)["events"]).alias("events"))
    return c.select(F.col("c_custkey").alias("id"), F.to_json(whole).alias("export"))


#: Words that tell of a question's class in the invented languages of the tables.
WORDS = {"talk": ("hello", "the an", "zu "), "book": ("ing", "cion", "heit"), "fact": ("is ", "est ", "who"), "complex": ("tion", "erung", "why")}


def HAS(kind: str) -> str:  # noqa: N802
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in WORDS[kind]) + ")"


@query(rf"""WITH s AS (SELECT conv_id, turn, lower(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS q FROM conversations WHERE role = 'user'), f AS (SELECT *, length(q) AS n, length(q) <= 60 AND {HAS('talk')} AS small_talk FROM s),
    b AS (SELECT *, {HAS('book')} OR (NOT small_talk AND n > 85) AS about_book, {HAS('complex')} OR n >= 140 AS hard FROM f)
    SELECT conv_id, turn, small_talk, about_book, about_book AND NOT hard AND ({HAS('fact')} OR n <= 80) AS simple, about_book AND hard AS complex FROM b""")
def question_classes(spark, d):
    """Classes of the users' questions by parts of words and length."""
    q = read(spark, d, "conversations").where("role = 'user'")
    return q.select("conv_id", "turn", planning.question_class(F.col("text"), WORDS).alias("c")).select("conv_id", "turn", "c.*")


@query("""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), s AS (SELECT conv_id, n, CASE WHEN conv_id % 4 > 0 THEN CAST((conv_id * 3) % (n + 2) AS INTEGER) END AS through FROM t),
    a AS (SELECT *, CASE WHEN n < 6 THEN 'pass' WHEN through >= 1 AND through = n - 4 THEN 'exact' WHEN through >= 1 AND n - 4 - through BETWEEN 1 AND 3 THEN 'reuse' ELSE 'regenerate' END AS action FROM s),
    c AS (SELECT *, CAST(CASE action WHEN 'pass' THEN 0 WHEN 'reuse' THEN through ELSE n - 4 END AS INTEGER) AS summary_through FROM a) SELECT conv_id, n, through, action, summary_through, summary_through + 1 AS inline_from FROM c""")
def history_windows(spark, d):
    """What of each conversation is summed up and what is said in full, given stored summaries that reach to places made from ids."""
    n = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    stored = n.withColumn("through", F.when(F.col("conv_id") % 4 > 0, ((F.col("conv_id") * 3) % (F.col("n") + 2)).cast("int")))
    return planning.compacted(stored)


#: Plans made of a document's words: lists with blanks, repeats and more entries than are kept.
PLANNED = """to_json(named_struct('normalizedQuestion', if(doc_id % 5 = 0, ' ', concat(w[0], '  ', w[1])), 'entityHints', slice(w, 1, 14), 'broadQueries', slice(w, 3, 9), 'focusedQueries', slice(w, 2, 12),
    'searchQueries', transform(slice(w, 1, 6), x -> concat(' ', x, '\n', x)), 'queryGroups', transform(slice(w, 1, 8), (x, i) -> named_struct('part', if(i % 3 = 0, '', x), 'searchQueries', if(i % 3 < 2, array(' '), array(x, x)), 'focusedQueries', if(i % 2 = 0, array(), array(x, 'f'))))))"""


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:20] AS w FROM documents), u AS (SELECT doc_id, w, CASE WHEN doc_id % 5 > 0 THEN coalesce(w[1], '') || ' ' || coalesce(w[2], '') ELSE '' END AS question FROM w WHERE len(w) >= 2),
    q AS (SELECT doc_id, question, w, list_concat(list_transform(w[1:6], lambda x: x || ' ' || x), w[3:10], w[2:11]) AS q FROM u), r AS (SELECT doc_id, question, w, unnest(q) AS query, generate_subscripts(q, 1) AS i FROM q), f AS (SELECT doc_id, query, min(i) AS i FROM r GROUP BY ALL),
    k AS (SELECT doc_id, string_agg(query, '|' ORDER BY i) AS queries FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 14) GROUP BY 1),
    g AS (SELECT doc_id, unnest(w[1:8]) AS x, generate_subscripts(w[1:8], 1) - 1 AS i FROM u), h AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN '' ELSE x END AS part, list_concat(CASE WHEN i % 3 = 2 THEN [x] ELSE [] END, CASE WHEN i % 2 = 1 THEN list_filter([x, 'f'], lambda v: NOT (i % 3 = 2 AND v = x)) ELSE [] END) AS qs, x FROM g),
    z AS (SELECT doc_id, string_agg(part || ':' || array_to_string(CASE WHEN i % 2 = 1 AND x = 'f' THEN ['f'] ELSE qs END, '+'), '|' ORDER BY i) AS groups FROM (SELECT * FROM h WHERE part <> '' OR len(qs) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 6) GROUP BY 1)
    SELECT u.doc_id, question, array_to_string(w[1:12], '|') AS hints, queries, coalesce(groups, '') AS groups FROM u JOIN k ON k.doc_id = u.doc_id LEFT JOIN z ON z.doc_id = u.doc_id""")
def search_plans(spark, d):
    """Search plans of JSON texts that are made of each document's first words."""
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 20)
    docs = read(spark, d, "documents").select("doc_id", words.alias("w")).where("size(w) >= 2").withColumn("json", F.expr(PLANNED))
    p = docs.select("doc_id", planning.search_plan(F.col("json")).alias("p"))
    groups = F.transform("p.queryGroups", lambda g: F.concat(g.part, F.lit(":"), F.array_join(g.searchQueries, "+")))
    return p.select("doc_id", F.col("p.normalizedQuestion").alias("question"), F.array_join("p.entityHints", "|").alias("hints"), F.array_join("p.searchQueries", "|").alias("queries"), F.array_join(groups, "|").alias("groups"))


SHOWN = """to_json(named_struct('characters', transform(slice(w, 1, 14), (x, i) -> named_struct('name', if(i % 2 = 0, x, lower(x)), 'description', if(i % 5 = 4, ' ', concat('d', i)), 'rank', if(i % 3 = 0, null, cast(14 - i as string)))),
    'events', transform(slice(w, 1, 16), (x, i) -> named_struct('title', x, 'description', concat('e', i), 'importance', element_at(array('Critical', 'high', 'low', ' medium '), cast(i % 4 + 1 as int))))))"""


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:20] AS w FROM documents), c AS (SELECT doc_id, unnest(w[1:14]) AS x, generate_subscripts(w[1:14], 1) - 1 AS i FROM w),
    p AS (SELECT doc_id, i, CASE WHEN i % 2 = 0 THEN x ELSE lower(x) END AS name, CASE WHEN i % 3 = 0 THEN i + 1 ELSE 14 - i END AS rank FROM c WHERE i % 5 < 4), u AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY rank, i) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS place FROM u), e AS (SELECT doc_id, unnest(w[1:16]) AS title, generate_subscripts(w[1:16], 1) - 1 AS i FROM w),
    v AS (SELECT * FROM e WHERE i % 4 <> 2 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY i) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM v)
    SELECT w.doc_id, coalesce((SELECT string_agg(place || ':' || name || ':d' || i, '|' ORDER BY place) FROM n WHERE n.doc_id = w.doc_id AND place <= 8), '') AS characters,
        coalesce((SELECT string_agg(title || ':' || CASE i % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'medium' END, '|' ORDER BY place) FROM k WHERE k.doc_id = w.doc_id AND place <= 8), '') AS events FROM w""")
def showcases(spark, d):
    """Characters and events of showcases that are made of each document's first words."""
    docs = read(spark, d, "documents").select("doc_id", F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 20).alias("w")).withColumn("json", F.expr(SHOWN))
    parts = planning.showcase(F.col("json"))
    people = F.transform("characters", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["name"], x.description))
    return docs.select("doc_id", parts["characters"].alias("characters"), parts["events"].alias("events")).select("doc_id", F.array_join(people, "|").alias("characters"), F.array_join(F.transform("events", lambda x: F.concat_ws(":", x.title, x.importance)), "|").alias("events"))
