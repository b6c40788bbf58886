"""Rules of ingest, search and metering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

#: Parts of messages of errors that pass.
TRANSIENT = (
    "resource exhausted", "error-code-429", "rate limit", "too many requests", "status 429", "status 408", "timeout", "timed out", "abort", "aborted", "fetch failed",
    "network", "connection reset", "econnreset", "etimedout", "econnrefused", "socket hang up", "bad gateway", "service unavailable", "gateway timeout",
)
#: Hours back from now; any other name is 30d, and all has no start.
WINDOW_HOURS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24, "90d": 90 * 24}
#: Most characters of a shaped hit by its kind.
SHAPED = {"scene": 900, "paragraph": 1200, "fragment": 1400, "slice": 18_000}


def lock_key(text: Column) -> Column:
    """FNV-1a of 32 bits, signed, over the UTF-16 units of a text (null: empty)."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    at = F.filter(F.sequence(F.lit(0), (F.length(units) / 4).cast("int")), lambda i: i * 4 < F.length(units))
    unit = lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    h = F.aggregate(at, F.lit(0x811C9DC5).cast("long"), lambda a, i: (a.bitwiseXOR(unit(i)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(h >= 2**31, h - 2**32).otherwise(h).cast("int")


def retriable(message: Column) -> Column:
    """Whether an error may pass: status 408, 429 or 5xx, or a part that says so. Null is no such error."""
    m = F.lower(F.coalesce(message, F.lit("")))
    status = F.regexp_extract(m, r"\bstatus[\s:=]+(\d{3})\b", 1)
    fit = status.isin("408", "429") | status.startswith("5")
    for part in TRANSIENT:
        fit = fit | m.contains(part)
    return fit


def confidence(score: Column, by: Column) -> Column:
    """high, medium or low, from a score and the array of what found it (rerank, semantic, lexical)."""
    has = lambda x: F.array_contains(by, F.lit(x))
    high = (has("rerank") & (score >= 0.75)) | (has("semantic") & has("lexical"))
    return F.when(high, "high").when((score >= 0.55) | (F.size(by) >= 2), "medium").otherwise("low")


def window_start(name: Column, now: Column) -> Column:
    """The start of a named window that ends now; null for all time."""
    n, start = F.lower(F.trim(F.coalesce(name, F.lit("")))), F.timestamp_add("HOUR", F.lit(-WINDOW_HOURS["30d"]), now)
    for known, hours in WINDOW_HOURS.items():
        start = F.when(n == known, F.timestamp_add("HOUR", F.lit(-hours), now)).otherwise(start)
    return F.when(n != "all", start)


def n_terms(question: Column) -> Column:
    return F.size(F.array_distinct(T.terms(question)))


def answer_size(question: Column) -> Column:
    """How many results a question gets: more for one of eight distinct terms or more."""
    return F.when(n_terms(question) >= 8, 12).otherwise(8)


def candidates(k: Column, cap: int) -> Column:
    """Results to rank anew for k wanted ones."""
    return F.greatest(k, F.least(F.lit(cap), F.lit(80), k * 5))


def probe(n_candidates: Column) -> Column:
    """Lexical hits to look at for so many candidates."""
    return F.greatest(F.lit(12), F.least(F.lit(40), n_candidates * 3))


def listed(text: Column, most: int) -> Column:
    """The parts between semicolons, trimmed, each once by lower case, at most `most`."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    first = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def suspicious(summary: Column, sources: Column) -> Column:
    """Whether a summary is too short, mostly one character, or copied from a source (an array of texts): equal to one, or
    sharing 40 characters or 60 % of its own, from the start of either. Sources under 20 characters are ignored."""
    s = F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", "")
    dense = F.regexp_replace(F.lower(s), r"\s+", "")
    counts = F.transform(F.array_distinct(F.split(dense, "")), lambda c: F.length(dense) - F.length(F.replace(dense, c, F.lit(""))))
    flat = F.regexp_replace(F.lower(s), r"\s+", " ")
    least = F.greatest(F.lit(40), F.floor(F.length(flat) * 0.6).cast("int"))
    plain = F.filter(F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), "^ | $", "")), lambda x: F.length(x) >= 20)
    copied = F.exists(plain, lambda x: (x == flat) | ((F.length(x) >= least) & (flat.contains(F.substr(x, F.lit(1), least)) | x.contains(F.substr(flat, F.lit(1), least)))))
    return (F.length(s) < 60) | (F.array_max(counts) * 2 > F.length(dense)) | copied


def lenient_json(text: Column) -> Column:
    """The JSON object of a text: all of it, else of its first fenced block, else what lies between the outermost braces; null
    where none of them parses."""

    def valid(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull() & F.regexp_like(x, F.lit(r"^\s*\{")), F.regexp_replace(x, r"^\s+|\s+$", ""))

    fence = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(valid(text), valid(fence), valid(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def shaped(text: Column, kind: Column) -> Column:
    """A hit's text, clamped by its kind."""
    out = text
    for name, most in SHAPED.items():
        out = F.when(kind == name, T.clamped(text, most)).otherwise(out)
    return out


def month_on(anchor: Column, k: Column) -> Column:
    """The instant k months after an anchor: its day, or the month's last, at its time of day."""
    day = F.add_months(anchor.cast("date"), k.cast("int")).cast("timestamp")
    return F.timestamp_micros(F.unix_micros(day) + F.unix_micros(anchor) - F.unix_micros(anchor.cast("date").cast("timestamp")))


def period_of(anchor: Column, at: Column) -> Column:
    """Which of the anchor's months an instant falls in, from 0."""
    k = (F.year(at) - F.year(anchor)) * 12 + F.month(at) - F.month(anchor)
    return F.when(month_on(anchor, k) <= at, k).otherwise(k - 1)
