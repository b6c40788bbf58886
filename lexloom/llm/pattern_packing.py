"""Best-fit packing by length patterns: non-negative least squares over the histogram of lengths, then best fit.

Only the histogram (at most `size` numbers) reaches the driver, and the plan made from it is bounded by `size` as well,
whatever the number of documents. Tasks then look up each piece's place by its length and its rank among equals.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import checkpointed, written

SIZE = 4096
#: Lengths are fitted in bins of size / BINS; patterns have at most DEPTH documents.
BINS, DEPTH = 64, 4
#: Salts by which equal lengths are ranked, so that a frequent length is no single task: as many at least, and one for so many
#: pieces.
SALTS, PER_SALT = 64, 1_000_000
#: Distinct words whose ids a task keeps.
KEPT_WORDS = 400_000
TEXTS_AT_ONCE = 256


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# What the tokenizer parts lower-cased words by, spelt out for letters and numbers below U+0250. Texts with
# other characters are left to it whole.
_LETTERS, _NUMBERS = "a-zªµºß-öø-\u024F", "0-9²³¹¼-¾"
_WORD = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7E\u00A1-\u00AC\u00AE-\u012F\u0131-\u024F]*+")


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, joins nothing over the bounds of words, and marks each word's last
    token by a suffix. Distinct words are kept, so a word is tokenized about once a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.last[number] = token.endswith("</w>")

    def learn(self, words: list[str]) -> None:
        """All in one call, parted again after each last token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        data, at = ids.tobytes(), 0
        for word, end in zip(words, ends, strict=True):
            self.known[word] = data[at:end]
            at = end

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t and unicodedata.is_normalized("NFC", t) for t in texts]
        parted = [_WORD.findall(t.lower()) if p else () for t, p in zip(texts, plain, strict=True)]
        words = set().union(*parted)
        if len(self.known) + len(words) > KEPT_WORDS:
            self.known = {}
        if new := list(words - self.known.keys()):
            self.learn(new)
        known = self.known
        return [
            b"".join([known[w] for w in words]) if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, p, words in zip(texts, plain, parted, strict=True)
        ]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit) of every
    document's ids and the end id; only documents longer than `size` are cut. A null or empty text has the end id alone."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())][: 5 + ids]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for b in it:
            for first in range(0, len(b), TEXTS_AT_ONCE):
                part, rows = b.slice(first, TEXTS_AT_ONCE), []
                for doc, data in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data += end
                    cut = ((at // 4, data[at : at + 4 * size]) for at in range(0, len(data), 4 * size))
                    rows += [(doc, n, at, len(x) // 4, zlib.crc32(x), x) for n, (at, x) in enumerate(cut)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=False)], names=[n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, schema)


def patterns(bins: int = BINS, depth: int = DEPTH, spare: int = 0) -> np.ndarray:
    """All sets of at most `depth` bins over `spare` that add up to `bins` - `spare`, as counts by bin (columns)."""
    found = []

    def grow(left: int, most: int, chosen: list[int]) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for b in range(min(left, most), spare, -1):
                if b * (depth - len(chosen)) < left:
                    break
                grow(left - b, b, [*chosen, b])

    grow(bins - spare, bins, [])
    out = np.zeros((bins, len(found)))
    for j, chosen in enumerate(found):
        for b in chosen:
            out[b - 1, j] += 1
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        used[j] = True
        while True:
            z = np.zeros_like(x)
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if (z[used] > 0).all():
                x = z
                break
            low = used & (z <= 0)
            x = x + np.min(x[low] / (x[low] - z[low])) * (z - x)
            used &= x > 1e-12
            x[~used] = 0
    return x


def plan(histogram: dict[int, int], size: int = SIZE, bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, dict[int, int]]]:
    """The best of the plans whose patterns leave some bins of room to shorter pieces: the one of fewest sequences."""
    plans = [plan_with(histogram, spare, size, bins, depth) for spare in (16, 12, 8, 4, 0)]
    return min(plans, key=lambda p: sum(count for count, _ in p))


def plan_with(histogram: dict[int, int], spare: int, size: int = SIZE, bins: int = BINS, depth: int = DEPTH) -> list[tuple[int, dict[int, int]]]:
    """Sequences that hold all of the histogram: how many, and the number of pieces of each length in each.

    Patterns are of bins above `spare` and leave `spare` bins of each sequence free.

    Fitted pattern counts are rounded down and filled from the longest lengths of each bin. What remains goes, longest
    first, where it fits best: the room that patterns leave and, if there is none, new sequences. Equal lengths move
    together, so the plan's size depends on the number of lengths, not of pieces.
    """
    left = Counter({n: c for n, c in histogram.items() if c})
    width = -(-size // bins)
    by_bin = [sorted((n for n in left if (n - 1) // width == b), reverse=True) for b in range(bins)]
    a = patterns(bins, depth, spare)
    x = nonnegative_least_squares(a, np.array([sum(left[n] for n in group) if b >= spare else 0 for b, group in enumerate(by_bin)], float))
    made: list[list] = []  # room, count, lengths
    for j in np.flatnonzero(x > 0):
        todo, slots = int(x[j] + 1e-6), [b for b in range(bins - 1, -1, -1) for _ in range(int(a[b, j]))]
        while todo > 0:
            taken: Counter = Counter()
            for b in slots:
                n = next((n for n in by_bin[b] if left[n] > taken[n]), None)
                if n is None:
                    break
                taken[n] += 1
            else:
                times = min(todo, *(left[n] // k for n, k in taken.items()))
                for n, k in taken.items():
                    left[n] -= times * k
                made.append([size - sum(n * k for n, k in taken.items()), times, dict(taken)])
                todo -= times
                continue
            break
    rooms = sorted((room, i) for i, (room, _, _) in enumerate(made))
    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            k = bisect.bisect_left(rooms, (n, -1))
            if k == len(rooms):
                per = min(size // n, left[n])
                made.append([size - per * n, left[n] // per, {n: per}])
                left[n] -= per * (left[n] // per)
                bisect.insort(rooms, (made[-1][0], len(made) - 1))
                continue
            room, i = rooms.pop(k)
            per = min(room // n, left[n])
            times = min(made[i][1], left[n] // per)
            if times < made[i][1]:  # the others stay as they are
                made.append([room, made[i][1] - times, dict(made[i][2])])
                bisect.insort(rooms, (room, len(made) - 1))
            made[i] = [room - per * n, times, made[i][2] | {n: made[i][2].get(n, 0) + per}]
            left[n] -= per * times
            bisect.insort(rooms, (made[i][0], i))
    return [(count, lengths) for _, count, lengths in made]


def slots(planned: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank: pieces of a length with
    ranks from `first rank` on fill the sequences from `first sequence` on, some to each."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for count, lengths in planned:
        at = 0
        for n, k in sorted(lengths.items(), reverse=True):
            rows.append((n, rank[n], k, sequence, at))
            rank[n] += count * k
            at += n * k
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(made: DataFrame, size: int = SIZE) -> DataFrame:
    """made (doc_id, piece, length, ...) with sequence_id (from 0, without gaps) and offset (without gaps in each sequence).

    Pieces are ranked among those of their length in groups by a hash of doc_id and piece, more of them the more pieces
    there are. Rows that repeat both are packed one by one. Lengths must be 1 to `size`. An empty table gives no rows.
    Columns named __salt, __rank, __first or __at are overwritten and lost.
    """
    salts = max(SALTS, made.count() // PER_SALT)
    salted = made.withColumn("__salt", F.expr(f"cast(pmod(xxhash64(doc_id, piece, start), {salts}) as int)"))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = checkpointed(groups.withColumn("__first", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    table = slots(plan(histogram, size))
    own = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(groups.drop("n"), ["length", "__salt"]).withColumn("__rank", F.col("__first") + F.row_number().over(own) - 1)
    shared = made.sparkSession.sparkContext.broadcast(table)  # bounded by size, whatever the number of pieces

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = shared.value
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), np.int64)
        for x in np.unique(n):
            here = n == x
            lo, hi = np.searchsorted(t[:, 0], [x, x + 1])
            at[here] = lo + np.searchsorted(t[lo:hi, 1], r[here], side="right") - 1
        q = r - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 3] + q // t[at, 2], "offset": t[at, 4] + q % t[at, 2] * n})

    return ranked.withColumn("__at", place("length", "__rank")).select(*made.columns, "__at.sequence_id", "__at.offset")


def packed_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per piece with its crc and place; the tokens' table is written once, as numbers only. A null or empty text is a
    piece of the end id alone; rows that repeat a doc_id or a text are packed one by one; an empty table gives none."""
    return pack(checkpointed(pieces(docs, tokenizer or tokenizer_path(), ids=False))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """sequence_id and ids (array) of the packed sequences themselves: real training rows. Texts as in packed_report."""
    placed = pack(written(pieces(docs, tokenizer or tokenizer_path(), size=size)), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `size` pieces in a sequence

    @F.pandas_udf("array<long>")
    def joined(values):
        return values.map(lambda v: np.frombuffer(b"".join(v), "<u4").astype(np.int64))

    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", joined(F.transform("parts", lambda p: p.ids)).alias("ids"))
