"""Spelling variants: pairs of words one edit apart, from a positional q-gram index with a count filter.

A word of length L, padded on both sides, has L + q - 1 grams of q characters, and one edit spoils at most q of them. So of
the grams of two near words, the longer one of length L, at least L - 1 are the same, at the same place, or in the longer word
one place on: the count filter's bound. Two words over the bound share one of their q + 1 rarest grams; only these are
posted. Postings are dealt by length and gram and sorted by place, Spark's sort merging the runs through a heap; a task walks each
list's merged order, meets only postings of fitting lengths and places, counts the grams that two words share, and verifies
what passes the bound by its characters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z are lower-cased
#: Characters of words are numbers below 256; these stand for the padding.
START, END = 1, 2
#: Postings of a list that meet in one cell; longer lists are dealt over pairs of blocks.
BLOCK = 4096
#: Pairs looked at together in a task.
TOGETHER = 1 << 18


def spelt(doc_id, text: str) -> Counter:
    """How often each word occurs in a text: its runs of letters with A-Z lower-cased, some of them with one character taken
    out, as the id and the run's checksum say."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        at = h % len(run)
        out[run if h % 97 else run[:at] + run[at + 1 :]] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of at least `shortest` code points and `least` occurrences in all texts. A task counts the words of a
    batch before they are shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total.update({w: n for w, n in spelt(i, t.as_py() or "").items() if len(w) >= shortest})
                if len(total) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                    total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_size(shorter: int) -> int:
    """q for two words of which the shorter has this length: longer grams are rarer."""
    return min(shorter // 2 + 1, 8)


def matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of characters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """The padded grams of each row, as numbers."""
    rows, length = chars.shape
    padded = np.full((rows, length + 2 * q - 2), START, np.uint64)
    padded[:, q - 1 : q - 1 + length] = chars
    padded[:, q - 1 + length :] = END
    codes = np.zeros((rows, length + q - 1), np.uint64)
    for k in range(q):
        codes = codes * np.uint64(1_099_511_628_211) + padded[:, k : k + length + q - 1]
    return codes


def chances(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How common a character is in a word, and how common it is behind another, as numbers that grow with it; padding goes on
    for certain. A table of 256 x 256 at most comes to the driver, whatever the vocabulary."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(65_536, np.int64)
        for batch in it:
            data = np.frombuffer(b"".join(bytes((START,)) + w.encode("latin-1") + bytes((END,)) for w in batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            seen += np.bincount(data[:-1] * 256 + data[1:], minlength=65_536)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    counts = np.zeros((256, 256))
    for r in words.select("word").mapInArrow(batches, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"] // 256, r["pair"] % 256] = r["n"]
    all_of = counts.sum(1, keepdims=True)
    steps = np.round(1000 * np.log((counts + 0.5) / (all_of + 128))).astype(np.int64)
    firsts = np.round(1000 * np.log((all_of[:, 0] + 0.5) / max(all_of[START, 0], 1))).astype(np.int64)
    steps[START, START] = steps[END, END] = firsts[START] = 0
    return firsts, steps


def rarest(chars: np.ndarray, q: int, likely: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the q + 1 rarest grams of each row: by the chance that their characters follow on each other,
    then by number and place, an order that all words share."""
    codes, (rows, length) = grams(chars, q), chars.shape
    padded = np.concatenate([np.full((rows, q - 1), START), chars, np.full((rows, q - 1), END)], axis=1).astype(np.int64)
    steps = likely[1][padded[:, :-1], padded[:, 1:]]
    upto = np.concatenate([np.zeros((rows, 1), np.int64), np.cumsum(steps, axis=1)], axis=1)
    chance = upto[:, q - 1 :] - upto[:, : upto.shape[1] - q + 1] + likely[0][padded[:, : codes.shape[1]]]
    at = np.lexsort((codes, chance), axis=1)[:, : q + 1]
    return np.take_along_axis(codes, at, 1), at


POSTING = "m int, list long, at int, word binary, n long"


def postings(words: DataFrame, likely: tuple[np.ndarray, np.ndarray], shortest: int = 5) -> DataFrame:
    """The index: for the shorter length m of a pair (the word's own, or one less) the rarest grams of each word. `at` is twice
    the gram's place, and one more where the word is the longer one."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            by_length: dict[int, list] = {}
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_length.setdefault(len(w), []).append((w.encode("latin-1"), n))
            for length, rows in by_length.items():
                for begin in range(0, len(rows), step := max(1, 2_000_000 // (length * 16))):
                    some = rows[begin : begin + step]
                    for m in (length, length - 1)[: 1 + (length > shortest)]:
                        q = gram_size(m)
                        codes, places = rarest(matrix([w for w, _ in some]), q, likely)
                        width = codes.shape[1]
                        key = (codes * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(m)).view(np.int64).ravel()
                        columns = (np.full(key.size, m, np.int32), key, (places * 2 + (length - m)).astype(np.int32).ravel())
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([w for w, _ in some for _ in range(width)], pa.binary()), pa.array(np.repeat([n for _, n in some], width), pa.int64())], names=[x.split()[0] for x in POSTING.split(", ")])

    return words.select("word", "n").mapInArrow(batches, POSTING)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of a and b (as long, or one longer) are exactly one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many grams two words share place by place; of a longer word b a gram may stand one place on."""
    same = np.zeros(b.shape, bool)
    if a.shape[1] == b.shape[1]:
        same = a == b
    else:
        same[:, : a.shape[1]] = a == b[:, :-1]
        same[:, 1:] |= a == b[:, 1:]
    return same.sum(1)


def met(rows: dict[str, np.ndarray], q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of near words, from the sorted postings of some whole lists of one shorter length. A word of that length
    meets those behind it at its gram's place, and longer ones at that place or the next."""
    at, longer = rows["at"].astype(np.int64), rows["at"] % 2 == 1
    starts = np.concatenate([[True], (rows["list"][1:] != rows["list"][:-1]) | (rows["x"][1:] != rows["x"][:-1]) | (rows["y"][1:] != rows["y"][:-1])])
    order = np.cumsum(starts) * (int(at.max()) + 4) + at
    chars = [matrix(list(rows["word"][longer == side])) if (longer == side).any() else None for side in (False, True)]
    if chars[0] is None:
        return
    codes, own = [None if c is None else grams(c, q) for c in chars], np.where(longer, np.cumsum(longer), np.cumsum(~longer)) - 1
    left = np.flatnonzero(~longer)
    here = np.searchsorted(order, order[left] + 1, side="right") - left - 1
    onward = np.searchsorted(order, order[left] + 3, side="left")
    ahead = np.searchsorted(order, order[left] + 3, side="right") - onward
    for first, count in ((left + 1, here), (onward, ahead)):
        upto = np.cumsum(count)
        begin = 0
        while begin < len(left):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + TOGETHER, side="right")))
            n = count[begin:end]
            i = np.repeat(left[begin:end], n)
            j = np.repeat(first[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            apart = (rows["x"][i] == rows["y"][i]) | (rows["block"][i] != rows["block"][j])
            i, j = i[apart], j[apart]
            for side in (False, True):
                a, b = i[longer[j] == side], j[longer[j] == side]
                if len(a):
                    passed = shared(codes[0][own[a]], codes[side][own[b]]) >= chars[side].shape[1] - 1
                    a, b = a[passed], b[passed]
                    fits = one_edit(chars[0][own[a]], chars[side][own[b]])
                    yield a[fits], b[fits]
            begin = end


def near_words(words: DataFrame, shortest: int = 5) -> DataFrame:
    """(word, near, n): for each word (latin-1 bytes) every word one edit apart and how often that occurs; a pair comes once a
    direction, or more often where it shares several rare grams."""
    posts = written(postings(words, chances(words), shortest))
    hot = written(posts.groupBy("m", "list").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("m", "list", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    cell = lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell))
    dealt = posts.join(hot, ["m", "list"], "left").withColumn("block", F.coalesce(block, F.lit(0))).withColumn("cell", F.explode(cells))
    dealt = dealt.select("m", "list", "cell.x", "cell.y", "block", "at", "word", "n")
    names = dealt.columns

    def near(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for m in np.unique(rows["m"]):
            some = {k: v[rows["m"] == m] for k, v in rows.items()}
            for a, b in met(some, gram_size(int(m))):
                if len(a):
                    one, two, n = some["word"][np.concatenate([a, b])], some["word"][np.concatenate([b, a])], some["n"][np.concatenate([b, a])]
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(n)], names=["word", "near", "n"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in it:
            rows = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names)}
            rows = rows if rest is None else {k: np.concatenate([rest[k], rows[k]]) for k in names}
            last = np.ones(len(rows["m"]), bool)  # rows of the list that the next batch may go on with
            for k in ("m", "list", "x", "y"):
                last &= rows[k] == rows[k][-1]
            yield from near({k: v[~last] for k, v in rows.items()})
            rest = {k: v[last] for k, v in rows.items()}
        if rest is not None:
            yield from near(rest)

    return dealt.repartition("m", "list", "x", "y").sortWithinPartitions("m", "list", "x", "y", "at").mapInArrow(batches, "word binary, near binary, n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Each round doubles the steps, so rounds are as many as the
    logarithm of the longest chain; a form occurs twice as often as its word, so that chain is short."""
    step = written(forms.select("word", F.col("form").alias("root")))
    while True:
        up = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(step.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("word", "root")


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts (see spelt and vocabulary).

    A word's near words are those exactly one inserted, deleted or replaced code point away. Its form is the most frequent of
    them (ties: the first in code-point order) if that occurs `times` times as often as the word or more, else null; root is
    where following forms ends, the word itself if it has none. Null and empty texts have no words; a null id counts as an
    empty one; repeated rows count one by one. Empty tables give no rows; other columns of docs are not read.
    """
    words = written(vocabulary(docs, shortest, least))
    word = lambda c: F.decode(c, "ISO-8859-1")
    # a word has no more near words than its length and the alphabet allow, so no word is a hot key
    pairs = near_words(words, shortest).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("f"))
    best = written(best.select(word("word").alias("word"), "n_near", word("f.near").alias("best"), (-F.col("f.less")).alias("best_n")))
    known = words.join(best, "word", "left").withColumn("fits", F.col("best_n") >= times * F.col("n"))
    formed = written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("best")).alias("form"), F.when(F.col("fits"), F.col("best_n")).alias("form_n")))
    ends = roots(formed.where("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
