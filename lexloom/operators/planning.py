"""What surrounds a chat's answers: classes of questions, search plans, compacted histories, and a book's showcase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Messages that stay as they are, from how many messages on a history is compacted, and how many may come on top
#: of an old summary before a new one is made.
KEEP_INLINE, COMPACT_FROM, REFRESH_AFTER = 4, 6, 4
#: Most entries of a search plan's lists, and of a group's.
PLAN = {"entityHints": 12, "broadQueries": 8, "focusedQueries": 10, "searchQueries": 14, "notes": 6}
GROUP, GROUPS = {"broadQueries": 4, "focusedQueries": 6, "searchQueries": 8}, 6
PLAN_SCHEMA = "normalizedQuestion string, entityHints array<string>, broadQueries array<string>, focusedQueries array<string>, searchQueries array<string>, notes array<string>, queryGroups array<struct<part: string, broadQueries: array<string>, focusedQueries: array<string>, searchQueries: array<string>>>"
#: Most characters and entries of a showcase, and the kinds of importance.
THEMES, CHARACTERS, EVENTS, QUOTES, RANKS = 6, 8, 8, 8, 32
IMPORTANCE = ("critical", "high", "medium")
SHOWCASE_SCHEMA = "themes array<struct<name: string, description: string>>, characters array<struct<name: string, description: string, rank: string>>, events array<struct<title: string, description: string, importance: string>>, quotes array<struct<text: string, chapterOrderIndex: string, chapterTitle: string>>"


def question_class(question: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """A struct of small_talk, about_book, simple and complex of a question. `words` holds parts that tell of each: "talk", "book",
    "fact" and "complex"; they are compared without case. Long questions are about the book, and longer ones complex."""
    q = F.lower(F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s+|\s+$", ""))

    def has(kind: str) -> Column:
        out = F.lit(False)
        for w in words[kind]:
            out = out | q.contains(w.lower())
        return out

    n, small = F.length(q), (F.length(q) <= 60) & has("talk")
    book, hard = has("book") | (~small & (n > 85)), has("complex") | (n >= 140)
    return F.struct(small.alias("small_talk"), book.alias("about_book"), (book & ~hard & (has("fact") | (n <= 80))).alias("simple"), (book & hard).alias("complex"))


def _flat(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")


def _listed(values: Column, most: int) -> Column:
    """The first so many entries with text, white space flattened."""
    return F.slice(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: _flat(F.coalesce(x, F.lit("")))), lambda x: x != ""), 1, most)


def search_plan(json: Column) -> Column:
    """A search plan of a JSON object, each list bounded: normalizedQuestion, entityHints, searchQueries (its own, then broad, then
    focused ones, each once), broadQueries, focusedQueries, queryGroups and notes. Null where nothing in it says anything."""
    p = F.from_json(json, PLAN_SCHEMA)
    own = {name: _listed(p[name], most) for name, most in PLAN.items()}

    def group(g: Column) -> Column:
        lists = {name: _listed(g[name], most) for name, most in GROUP.items()}
        queries = F.slice(F.array_distinct(F.concat(lists["searchQueries"], lists["broadQueries"], lists["focusedQueries"])), 1, GROUP["searchQueries"])
        return F.struct(_flat(F.coalesce(g.part, F.lit(""))).alias("part"), queries.alias("searchQueries"), lists["broadQueries"].alias("broadQueries"), lists["focusedQueries"].alias("focusedQueries"))

    empty = F.array().cast("array<struct<part: string, broadQueries: array<string>, focusedQueries: array<string>, searchQueries: array<string>>>")
    groups = F.slice(F.filter(F.transform(F.coalesce(p.queryGroups, empty), group), lambda g: (g.part != "") | (F.size(g.searchQueries) > 0)), 1, GROUPS)
    queries = F.slice(F.array_distinct(F.concat(own["searchQueries"], own["broadQueries"], own["focusedQueries"])), 1, PLAN["searchQueries"])
    question = _flat(F.coalesce(p.normalizedQuestion, F.lit("")))
    plan = F.struct(question.alias("normalizedQuestion"), own["entityHints"].alias("entityHints"), queries.alias("searchQueries"), own["broadQueries"].alias("broadQueries"), own["focusedQueries"].alias("focusedQueries"), groups.alias("queryGroups"), own["notes"].alias("notes"))
    return F.when((question != "") | (F.size(own["entityHints"]) > 0) | (F.size(queries) > 0) | (F.size(groups) > 0), plan)


def compacted(threads: DataFrame) -> DataFrame:
    """threads (n: messages; through: the place from 1 of the last one that a stored summary covers, or null) with action (pass,
    exact, reuse or regenerate), summary_through (the last place covered afterwards) and inline_from (the first place said
    in full). A summary that lacks few messages is kept, and those are said in full; an older one is made anew."""
    cutoff = F.col("n") - KEEP_INLINE
    short, known = F.col("n") < COMPACT_FROM, F.col("through").between(1, cutoff)
    lacking = cutoff - F.col("through")
    action = F.when(short, "pass").when(known & (lacking == 0), "exact").when(known & (lacking < REFRESH_AFTER), "reuse").otherwise("regenerate")
    covered = F.when(F.col("action") == "pass", 0).when(F.col("action") == "reuse", F.col("through")).otherwise(cutoff)
    return threads.withColumn("action", action).withColumn("summary_through", covered.cast("int")).withColumn("inline_from", (F.col("summary_through") + 1).cast("int"))


def _clamped(x: Column, most: int) -> Column:
    text = T.canonical(F.replace(F.coalesce(x, F.lit("")), F.lit("\u00a0"), F.lit(" ")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+$", ""), F.lit("\u2026")))


def _first(rows: Column, key: str) -> Column:
    """The first of the rows whose key is the same but for its case."""
    keys = F.transform(rows, lambda x: F.lower(x[key]))
    return F.filter(rows, lambda x, i: F.array_position(keys, F.lower(x[key])) == i + 1)


def _number(x: Column) -> Column:
    n = F.regexp_extract(F.coalesce(x, F.lit("")), r"^\s*\+?(\d{1,9})", 1)
    return F.when(n.rlike("[1-9]"), n.cast("int"))


def showcase(json: Column) -> dict[str, Column]:
    """The parts of a showcase in a JSON text, each validated, without repeats but for case, and bounded: themes, characters by
    rank and numbered anew, events of a known importance, and quotes of ten characters or more."""
    p = F.from_json(json, SHOWCASE_SCHEMA)
    rows = lambda name, kind: F.coalesce(p[name], F.array().cast(kind))
    kinds = dict(x.split(" ", 1) for x in SHOWCASE_SCHEMA.replace(", characters", "|characters").replace(", events", "|events").replace(", quotes", "|quotes").split("|"))
    full = lambda *names: lambda x: F.forall(F.array(*(x[n] for n in names)), lambda v: v != "")
    themes = F.filter(F.transform(rows("themes", kinds["themes"]), lambda x: F.struct(_clamped(x["name"], 120).alias("name"), _clamped(x.description, 320).alias("description"))), full("name", "description"))
    ranked = F.transform(rows("characters", kinds["characters"]), lambda x, i: F.struct(F.greatest(F.lit(1), F.least(F.lit(RANKS), F.coalesce(_number(x["rank"]), i + 1))).alias("rank"), i.alias("i"), _clamped(x["name"], 140).alias("name"), _clamped(x.description, 320).alias("description")))
    people = _first(F.array_sort(F.filter(ranked, full("name", "description"))), "name")
    events = F.transform(rows("events", kinds["events"]), lambda x: F.struct(_clamped(x.title, 140).alias("title"), _clamped(x.description, 320).alias("description"), F.lower(F.trim(F.coalesce(x.importance, F.lit("")))).alias("importance")))
    events = F.filter(events, lambda x: (x.title != "") & (x.description != "") & x.importance.isin(*IMPORTANCE))
    quotes = F.transform(rows("quotes", kinds["quotes"]), lambda x: F.struct(_clamped(x.text, 360).alias("text"), _number(x.chapterOrderIndex).alias("chapterOrderIndex"), F.nullif(_clamped(x.chapterTitle, 180), F.lit("")).alias("chapterTitle")))
    return {
        "themes": F.slice(_first(themes, "name"), 1, THEMES),
        "characters": F.slice(F.transform(people, lambda x, i: F.struct(x["name"].alias("name"), x.description.alias("description"), (i + 1).alias("rank"))), 1, CHARACTERS),
        "events": F.slice(_first(events, "title"), 1, EVENTS),
        "quotes": F.slice(_first(F.filter(quotes, lambda x: F.length(x.text) >= 10), "text"), 1, QUOTES),
    }


def showcase_rows(showcases: DataFrame, book: str, json: str) -> DataFrame:
    """(book, kind, key, content): the showcase's parts as artifacts, to be upserted by book, kind and key."""
    parts = showcase(F.col(json))
    each = F.array(*(F.struct(F.lit(f"showcase_{k}").alias("kind"), F.lit("main").alias("key"), F.to_json(v).alias("content")) for k, v in parts.items()))
    return showcases.select(F.col(book).alias("book"), F.explode(each).alias("a")).select("book", "a.*")
