"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import chat_format, fill_middle, html_extract, license_scan, maxscore_topk, pattern_packing, pii, quality_rules, secret_scan, simhash_dedup, source_mixing, spelling, suffix_dedup
from lexloom.llm.common import read

PROBE = "</s>[INST] ok [/INST]"


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe as windows for training, as digests."""
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(chat_format.format_conversations(turns))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces with their places in sequences."""
    return pattern_packing.packed_report(read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules for every document."""
    return quality_rules.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once repeated passages go."""
    return suffix_dedup.repeats_report(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture takes every document."""
    return source_mixing.mix(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return pii.span_report(read(spark, sf_dir, "documents"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash_dedup.simhash_report(read(spark, sf_dir, "documents"))


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every fiftieth one."""
    return maxscore_topk.top_k(read(spark, sf_dir, "embeddings"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut for filling in its middle, as digests."""
    return fill_middle.fill_middle_report(read(spark, sf_dir, "documents"))


def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every text: base matches and what the field tags."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all texts with its near words' count, its form and its root."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the quality rules and the base rule, without the fitted cutoffs."""
    counted = quality_rules.with_counts(read(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the base phrases of licenses."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much personal data the base patterns find, with a model that adds nothing."""
    nothing = pii.SpanModel("0D", {k: 1e9 for k in pii.GENERATORS})
    return pii.span_report(read(spark, sf_dir, "documents"), nothing).select("doc_id", *(f"n_{k}" for k in pii.BASE))


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets the base patterns find, with a field that adds nothing."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents"), secret_scan.silent()).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (
    op1_chat_windows, op2_pattern_packing, op3_html_extraction, op4_quality_rules, op5_suffix_dedup, op6_source_mixing, op7_license_scan, op8_pii_spans, op9_simhash_components, op10_maxscore_topk, op11_fill_middle, op12_secret_spans, op13_spelling_variants, pipeline, base_quality_counts, base_license_places, base_pii_counts, base_secret_counts,
)}

SQL = {
    # windows are cut turn by turn, hence the recursion; a turn's markup counts 4 tokens and 8 characters, an escaped character 2
    "op1_chat_windows": r"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        f AS (SELECT *, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) + 4 AS tokens, 8 + length(role || text) + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS chars,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
        g AS (SELECT *, sum(tokens) OVER w AS upto, first(role) OVER w = 'system' AS has_system, 832 - CASE WHEN first(role) OVER w = 'system' THEN first(tokens) OVER w ELSE 0 END AS room
            FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
        walk AS (SELECT conv_id, i, CAST(0 AS HUGEINT) AS base, i AS start FROM g WHERE i = 1 UNION ALL
            SELECT g.conv_id, g.i, CASE WHEN upto - base > room AND upto - tokens > base THEN upto - tokens ELSE base END, CASE WHEN upto - base > room AND upto - tokens > base THEN g.i ELSE start END
            FROM walk JOIN g ON g.conv_id = walk.conv_id AND g.i = walk.i + 1),
        spans AS (SELECT conv_id, start, max(i) AS last, max(base) AS base FROM walk GROUP BY conv_id, start),
        per_window AS (SELECT s.conv_id, s.start, sum(g.chars) AS chars FROM spans s JOIN g ON g.conv_id = s.conv_id AND (g.i BETWEEN s.start AND s.last OR (has_system AND g.i = 1)
            OR (g.i < s.start AND g.i >= greatest(s.start - 8, CASE WHEN has_system THEN 2 ELSE 1 END) AND s.base - (g.upto - g.tokens) <= 192)) GROUP BY s.conv_id, s.start),
        formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM per_window GROUP BY conv_id),
        said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss FROM f GROUP BY conv_id)
        SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows FROM said JOIN formatted USING (conv_id)""",
    "op11_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op10_maxscore_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS score
              FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "base_quality_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM w, unnest(range(1, len(w) - 1)) AS r(i)), many AS (SELECT doc_id, s FROM g GROUP BY ALL HAVING count(*) > 1),
        c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN many USING (doc_id, s), (VALUES (0), (1), (2)) AS v(k) GROUP BY 1)
        SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN c ON c.doc_id = w.doc_id""",
    "base_license_places": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT doc_id, i, CASE WHEN w[i + 1] = 'license' AND w[i] = 'mit' THEN 'mit' WHEN w[i + 1] = 'license' AND w[i] = 'apache' THEN 'apache' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
        f AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
        SELECT w.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN f ON f.doc_id = w.doc_id""",
    "base_pii_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS m FROM d UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) FROM d
            UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) FROM d UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) FROM d),
        x AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM m),
        l AS (SELECT *, list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(g, i, 1) AS INTEGER) + 1] ELSE CAST(substr(g, i, 1) AS INTEGER) END)) AS luhn FROM x WHERE kind <> 'card' OR length(g) BETWEEN 16 AND 19),
        k AS (SELECT * FROM l WHERE kind = 'email' OR (kind = 'ip' AND list_max(list_transform(string_split(m, '.'), lambda y: coalesce(TRY_CAST(y AS BIGINT), 999))) <= 255) OR (kind = 'card' AND luhn % 10 = 0) OR (kind = 'phone' AND length(g) BETWEEN 8 AND 15))
        SELECT d.doc_id, count(CASE WHEN kind = 'email' THEN 1 END) AS n_email, count(CASE WHEN kind = 'ip' THEN 1 END) AS n_ip, count(CASE WHEN kind = 'card' THEN 1 END) AS n_card, count(CASE WHEN kind = 'phone' THEN 1 END) AS n_phone FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY 1""",
    "base_secret_counts": r"""
        SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
            len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents""",
}
