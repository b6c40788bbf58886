"""Near-duplicate classes of texts: SimHash candidates by the Gray-order index, settled by the exact similarity.

A link is a Jaccard similarity of NUM / DEN or more of the texts' distinct word shingles. The SimHash index finds most of
them; what its bands miss is found by a prefix filter that loses no link: shingles have one order for all texts, frequent
ones last, and of n shingles two linked sets share one among the first n - ceil(n * NUM / DEN) + 1 of each. Sets that meet
there are compared by sketches first: a sketch holds for each of SKETCH cells whether an odd number of shingles falls into
it, so two sketches differ in no more cells than the sets in shingles, and no link is lost here either. Every candidate is
settled by the sets themselves before components are made. Shingles stand for their 64-bit hashes, texts of equal sets are
one class before any search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import simhash_dedup
from lexloom.llm.common import written
from lexloom.llm.components import components

SHINGLE, NUM, DEN = 5, 4, 5
#: Words of 64 bits of a fingerprint, and how many of its bits may differ in a candidate (about those of similarity 0.8).
WORDS64, RADIUS = 4, 40
#: Cells of a sketch.
SKETCH = 512
#: Most shingles whose counts order them; this many rows are broadcast. It changes what is compared, never what is linked.
FREQUENT = 500_000
#: Bits (8 MB) that mark the documents whose sets are compared. They change which texts are hashed again, never what is linked.
MARKS = 1 << 26
#: Share of the hashes, from zero on, that are counted.
COUNTED = 0.4
#: Documents that a task turns into sets at a time.
AT_ONCE = 512
#: Classes of a shingle that a task compares at once; larger groups are compared block by block.
BLOCK = 4096
#: Classes of a shingle up to which all groups are compared together.
SMALL = 32


def distinct(text: str | None) -> np.ndarray:
    return np.unique(simhash_dedup.shingle_hashes(text or "", SHINGLE))


def class_id(h: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)))


def sketch(h: np.ndarray) -> bytes:
    return np.packbits(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def prefix(h: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by count where it is known, then by hash. frequent is sorted."""
    count = np.zeros(len(h), np.int64)
    if len(frequent) and len(h):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        count = np.where(frequent[at] == h, counts[at], 0)
    return h[np.lexsort((h, count))[: len(h) - -(-len(h) * NUM // DEN) + 1]]


def _new(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, bool]]]]:
    """Batches of rows whose last column is a text, and of each text its class, its set and whether the class is new in the task."""
    seen: set[int] = set()
    for b in (whole.slice(i, AT_ONCE) for whole in it for i in range(0, len(whole), AT_ONCE)):
        rows = []
        for t in b.column(b.num_columns - 1).to_pylist():
            h = distinct(t)
            cid = class_id(h)
            rows.append((cid, h, cid not in seen))
            seen.add(cid)
        yield b, rows


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, class, size, fingerprint and sketch; the last two only where a class is first met in the task, so that copies
    cost no more than their names. The set itself is made anew where it is needed: written, it takes more than the text."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    for b, sets in _new(it):
        rows = [(cid, len(h), simhash_dedup.majority(h, WORDS64), sketch(h)) if new else (cid, len(h), None, None) for cid, h, new in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "cid", "n", "fp", "sketch"])


def _hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes and their sets, each class once in a task."""
    for _, sets in _new(it):
        rows = [(cid, h.view(np.int64)) for cid, h, new in sets if new]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([h for _, h in rows], pa.list_(pa.int64()))], names=["cid", "hashes"])


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles in the lower COUNTED of all hashes, of each class once in a task."""
    for _, sets in _new(it):
        h = np.concatenate([np.zeros(0, np.int64), *(h.view(np.int64) for _, h, new in sets if new)])
        yield pa.RecordBatch.from_arrays([pa.array(h[(h >= 0) & (h < int(COUNTED * 2**64))])], names=["token"])


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all sets and their counts: those over the least power of two that leaves at most FREQUENT.

    Only shingles whose hash is in the lower COUNTED of all hashes are counted, over all documents: prefixes are the lower
    fifth of a set and what takes the place of frequent ones in it, so others hardly ever come into one.
    """
    counts = written(texts.mapInArrow(_counted, "token long").groupBy("token").count().where("count > 3"))
    over = counts.agg(*(F.expr(f"count_if(count >= {2**p}L)") for p in range(63))).first()  # one row; by group it would be a task for each partition
    least = next(2**p for p, n in enumerate(over) if n <= FREQUENT)
    rows = counts.where(F.col("count") >= least).toArrow()
    tokens, n = (rows.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], n[order]


def _filed(frequent: np.ndarray, counts: np.ndarray):
    """token, cid, n and left of the prefix of each class once in a task: left is how many shingles of the set come from this
    one on in the common order, itself included."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _new(it):
            own = [(cid, len(h), prefix(h, frequent, counts)) for cid, h, new in sets if new and len(h)]
            sizes = [len(x) for _, _, x in own]
            cid, n = (np.repeat(np.array([row[k] for row in own], np.int64), sizes) for k in (0, 1))
            left = n - np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in sizes)])
            token = np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in own)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(cid), pa.array(n.astype(np.int32)), pa.array(left.astype(np.int32))], names=["token", "cid", "n", "left"])

    return batches


def _partnered(n: np.ndarray, left: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rows of the groups (all small) have another that they may be linked to by a first common shingle here: all that
    two sets share then lies in what is left of either."""
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    found = np.zeros(len(n), bool)
    for step in range(1, int(sizes.max(initial=0))):
        i = at[ends - at > step]
        j = i + step
        fits = np.minimum(left[i], left[j]) * (NUM + DEN) >= NUM * (n[i] + n[j])
        found[i[fits]] = found[j[fits]] = True
    return found


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token and cid of rows sorted by token and class: of tokens with several classes, each once; a single row is held. Of
    small groups that lie whole in a batch only the rows that have a partner are given out."""
    last, given = None, False  # the row before this batch, and whether it was given out
    for b in it:
        if not b.num_rows:
            continue
        token, cid, n, left = (b.column(c).to_numpy().astype(np.int64) for c in ("token", "cid", "n", "left"))
        begun = last is not None
        if begun:
            token, cid, n, left = (np.append(x, y) for x, y in zip(last, (token, cid, n, left), strict=True))
        new = np.append(True, (token[1:] != token[:-1]) | (cid[1:] != cid[:-1]))
        token, cid, n, left = token[new], cid[new], n[new], left[new]
        alike = token[1:] == token[:-1]
        keep = np.append(False, alike) | np.append(alike, False)
        if given:
            keep[0] = False
        given = bool(keep[-1]) or (given and len(token) == 1)
        last = (token[-1], cid[-1], n[-1], left[-1])
        starts = np.flatnonzero(np.append(True, ~alike))
        sizes = np.diff(starts, append=len(token))
        whole = (sizes > 1) & (sizes <= SMALL)
        whole[-1] = False
        whole[0] &= not begun
        inside = np.repeat(whole, sizes)
        keep[inside] = _partnered(n, left, starts[whole], sizes[whole])[inside]
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(cid[keep])], names=["token", "cid"])


def _possible(n: np.ndarray, cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) those whose sizes and sketches allow a link, and in how many cells they differ."""
    fits = (n[j] * DEN >= n[i] * NUM) & (n[j] * NUM <= n[i] * DEN)
    i, j = i[fits], j[fits]
    apart = np.bitwise_count(cells[j] ^ cells[i]).sum(axis=1, dtype=np.int64)
    needed = -(-(n[i] + n[j]) * NUM // (NUM + DEN))
    fits = apart <= n[i] + n[j] - 2 * needed
    return i[fits], j[fits], apart[fits]


def _in_small(starts: np.ndarray, sizes: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unlike labels in small groups, all groups at once: each row with the next, the second next and so on."""
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    left = np.repeat(starts + sizes, sizes) - at  # rows of the group from here on, own included
    for step in range(1, int(sizes.max(initial=0))):
        i = at[left > step]
        yield (i := i[label[i] != label[i + step]]), i + step


def _in_large(label: np.ndarray, half: np.ndarray, split: bool, closest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unlike labels in one group, those of a row at once; where it is two blocks (split), only pairs across. Rows
    of the commonest label are not compared among themselves, so what is connected costs no more. With `closest` a row
    comes with all others, not only those behind it."""
    names, own = np.unique(label, return_inverse=True)
    common = own == np.argmax(np.bincount(own))
    for i in np.flatnonzero(~common) if len(names) > 1 else ():
        other = (own != own[i]) & (common | (np.arange(len(label)) > i) | closest)
        j = np.flatnonzero(other & (half != half[i]) if split else other)
        yield np.full(len(j), i), j


def _pairs(it: Iterator[pa.RecordBatch], closest: bool = False) -> Iterator[pa.RecordBatch]:
    """Candidates of each group; rows come sorted by group, and one group, of at most two blocks, is held. With `closest` a
    row of a large group comes only with the one that its sketch is closest to."""

    def paired(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.stack([t.column(c).to_numpy() for c in ("token", "low", "high")])
        cid, n, label, half = (t.column(c).to_numpy() for c in ("cid", "n", "label", "block"))
        cells = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(cid), -1)
        starts = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        sizes = np.diff(starts, append=len(cid))
        small = (sizes <= SMALL) & (group[1, starts] == group[2, starts])

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from _in_small(starts[small], sizes[small], label)
            for a, m in zip(starts[~small].tolist(), sizes[~small].tolist(), strict=True):
                for i, j in _in_large(label[a : a + m], half[a : a + m], group[1, a] != group[2, a], closest):
                    yield a + i, a + j

        for i, j in found():
            alone = closest and len(i) > SMALL and (i == i[0]).all()
            i, j, apart = _possible(n, cells, i, j)
            if alone and len(i):
                i, j, apart = (x[[np.argmin(apart)]] for x in (i, j, apart))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j])), pa.array(apart)], names=["a", "b", "apart"])

    yield from simhash_dedup.by_group(it, ["token", "low", "high"], paired)


def _marked(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """texts whose doc_id is among ids, and few others: by MARKS bits, broadcast, so that no other text is moved or hashed."""
    bit = f"pmod(xxhash64(doc_id), {MARKS}L)"
    maps = ids.select(F.expr(bit).alias("bit")).groupBy(F.expr("bit div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("map"))
    near = texts.withColumn("bit", F.expr(bit)).withColumn("part", F.expr("bit div 32768")).join(F.broadcast(maps), "part")
    return near.where("getbit(cast(conv(hex(substring(map, cast(bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1").select(*texts.columns)


def _settled(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links, by their sets, which are made again from a text of each class."""
    sized = sets.where("sketch is not null").select("cid", "n", "sketch").dropDuplicates(["cid"])
    pairs = pairs.select("a", "b").distinct().join(sized.toDF("a", "n", "sketch"), "a").join(sized.toDF("b", "m", "other"), "b")
    pairs = written(pairs.mapInArrow(_unlike, "a long, b long"))
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    ids = sets.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    own = _marked(texts, ids).mapInArrow(_hashes, "cid long, hashes array<long>").join(wanted, "cid", "left_semi").dropDuplicates(["cid"])
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    shared = f"size(array_intersect(x, y)) * {NUM + DEN} >= {NUM} * (size(x) + size(y))"
    return written(both.where(shared).select("a", "b"))


def _unlike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a link."""
    for b in it:
        k = b.num_rows
        n = np.append(b.column("n").to_numpy(), b.column("m").to_numpy())
        cells = np.frombuffer(b"".join(b.column("sketch").to_pylist() + b.column("other").to_pylist()), np.uint64).reshape(2 * k, -1)
        i = _possible(n, cells, np.arange(k), np.arange(k, 2 * k))[0]
        yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(i)), b.column("b").take(pa.array(i))], names=["a", "b"])


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links (its own included), of every row with a doc_id.

    Null texts and texts without words have no shingles and are one class; texts of fewer words than a shingle are one
    shingle. Repeated rows are all returned; other columns are ignored; an empty table gives an empty result. docs is read
    several times, as sets of hashes would take more disk than the texts.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    sets = written(named.mapInArrow(_sets, f"doc_id {dict(docs.dtypes)['doc_id']}, cid long, n long, fp binary, sketch binary"))
    rows = sets.count()

    # SimHash: keys of as many bits as tell the corpus' texts apart, so that buckets stay small whatever its size
    digits = max(4, math.ceil((math.log2(max(rows, 1)) + 2) / 4))
    blocks = 16 * WORDS64 // digits
    prints = sets.where("fp is not null").select("fp", F.col("cid").alias("rep")).dropDuplicates(["rep"])
    close = simhash_dedup.close_pairs(prints, RADIUS, 4 * digits * blocks, blocks, 1)

    # what the bands miss
    filed = named.select("text").mapInArrow(_filed(*_frequent(named.select("text"))), "token long, cid long, n int, left int")
    filed = written(filed.repartition("token").sortWithinPartitions("token", "cid").mapInArrow(_shared, "token long, cid long"))
    blocked = filed.join(filed.groupBy("token").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("k")), "token")
    blocked = blocked.withColumn("block", F.expr("cast(pmod(xxhash64(cid), k) as int)")).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    sized = sets.where("sketch is not null").select("cid", "n", "sketch").join(filed.select("cid").distinct(), "cid", "left_semi").dropDuplicates(["cid"])
    ready = written(blocked.join(sized, "cid").select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "n", "sketch"))

    def candidates(labelled: DataFrame, closest: bool) -> DataFrame:
        dealt = labelled.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "n", "cid")
        return dealt.mapInArrow(lambda it: _pairs(it, closest), "a long, b long, apart long")

    # first each class with the one that is closest to it, together with the index's pairs
    pairs = candidates(ready.withColumn("label", F.col("cid")), True)
    ends = pairs.selectExpr("inline(array(named_struct('a', a, 'b', b, 'apart', apart), named_struct('a', b, 'b', a, 'apart', apart)))")  # a union would compare all twice
    closest = ends.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _settled(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(closest), sets, named)
    found = components(links)
    # then all that are not connected yet
    more = _settled(candidates(ready.join(found, ready.cid == found.id, "left").select(*ready.columns, F.coalesce("component", "cid").alias("label")), False), sets, named)
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))  # stars say what links say
    named_by = written(sets.join(found, sets.cid == found.id, "left").select("doc_id", F.coalesce("component", "cid").alias("component")))
    least = named_by.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named_by.join(least, "component").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those that have a near duplicate of smaller doc_id in their component. doc_id names documents: of rows
    that repeat it one stays; rows without doc_id all stay."""
    gone = near_classes(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.where("doc_id is not null").join(gone, docs.doc_id == F.col("__gone"), "left_anti")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
