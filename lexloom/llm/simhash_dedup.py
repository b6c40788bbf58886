"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are filed under block keys so that close ones share a bucket. In a bucket they are sorted by Gray
rank and cut into leaves; each node of the tree above keeps the bits that all below share (mask and pattern). Two nodes
are compared only while the shared bits' differences stay within the radius, and not at all once known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed
from lexloom.llm.components import components

LEAF, FAN = 32, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed values: splitmix64's increment and multipliers
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: Shingles whose hashes are held at a time, and rows that are unpacked to bits at a time.
CHUNK, FEW = 1 << 14, 24


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of rows (n, words) have each bit set, highest bit first. Carry-save adders make of three rows of a weight
    one of that weight and one of twice it, until so few are left that they are unpacked."""
    total, weight = np.zeros(64 * rows.shape[1], np.int64), 1
    while len(rows):
        carries = [rows[:0]]
        while len(rows) > FEW:
            k = len(rows) // 3
            x, y, z = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            either = x ^ y
            carries.append((x & y) | (either & z))
            rows = np.concatenate([either ^ z, rows[3 * k :]])
        total += weight * np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1).sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries), 2 * weight
    return total


def hashes(h: np.ndarray, words64: int) -> np.ndarray:
    """h (n) as (n, words64): itself, then further hashes made from it."""
    x = h[:, None] + np.arange(words64, dtype=np.uint64) * _STEP
    if words64 > 1:
        more = x[:, 1:]
        more = (more ^ (more >> np.uint64(30))) * _MIX[0]
        more = (more ^ (more >> np.uint64(27))) * _MIX[1]
        x[:, 1:] = more ^ (more >> np.uint64(31))
    return x


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; of fewer words than a shingle, one; without words, none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z lowered, parted at the six blanks of ASCII
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle + 1, 1)
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())), np.uint64, n)


def majority(h: np.ndarray, words64: int) -> bytes:
    """Big-endian fingerprint: a bit is 1 if set in over half of the hashes; all zero if there are none."""
    n = len(h)
    if not n:
        return bytes(8 * words64)
    ones = sum(bit_counts(hashes(h[i : i + CHUNK], words64)) for i in range(0, n, CHUNK))
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: str, shingle: int, words64: int) -> bytes:
    """The fingerprint of a text's word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle), words64)


def fingerprints(docs: DataFrame, shingle: int = 3, words64: int = 1) -> DataFrame:
    """doc_id and fp (binary) of every row. Texts of fewer words than a shingle are one shingle; without words, fp is zero."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [fingerprint(t or "", shingle, words64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, fp binary")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Order of codes (n, words) by their place in the Gray sequence: the running xor of the bits from the highest."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(len(codes), -1), axis=1)
    rank = np.packbits(np.bitwise_xor.accumulate(bits, axis=1), axis=1)
    return np.lexsort(rank.T[::-1])


class Bucket:
    """The hierarchical index of one bucket's codes, and the spanning links between codes within the radius."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.order = gray_rank(codes)
        self.codes, self.radius = codes[self.order], radius
        self.parent = np.arange(len(codes))
        self.edges: list[tuple[int, int]] = []  # close pairs that span the groups
        self.levels = []  # from the leaves up: first row, ones shared, zeros shared
        at = np.arange(0, len(codes), LEAF)
        ones, zeros = np.bitwise_and.reduceat(self.codes, at), np.bitwise_and.reduceat(~self.codes, at)
        self.levels.append((at, ones, zeros))
        while len(at) > 1:
            up = np.arange(0, len(at), FAN)
            at, ones, zeros = at[up], np.bitwise_and.reduceat(ones, up), np.bitwise_and.reduceat(zeros, up)
            self.levels.append((at, ones, zeros))

    def rows(self, level: int, i: int) -> tuple[int, int]:
        at = self.levels[level][0]
        return at[i], at[i + 1] if i + 1 < len(at) else len(self.codes)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def connected(self, *spans: tuple[int, int]) -> bool:
        first = self.root(spans[0][0])
        return all(self.root(i) == first for a, b in spans for i in range(a, b))

    def search(self) -> None:
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, i, j = todo.pop()
            _, ones, zeros = self.levels[level]
            # bits that all of one node have set and all of the other clear
            apart = int(np.bitwise_count((ones[i] & zeros[j]) | (zeros[i] & ones[j])).sum())
            if apart > self.radius:
                continue
            a, b = self.rows(level, i), self.rows(level, j)
            if i != j and self.connected(a, b):
                continue
            if level:
                below = len(self.levels[level - 1][0])
                left, right = range(i * FAN, min((i + 1) * FAN, below)), range(j * FAN, min((j + 1) * FAN, below))
                pairs = [(level - 1, x, y) for x in left for y in right if x <= y]
                todo += sorted(pairs, key=lambda p: p[1] - p[2])  # near pairs are looked at first
                continue
            apart = np.bitwise_count(self.codes[a[0] : a[1], None] ^ self.codes[None, b[0] : b[1]]).sum(axis=2, dtype=np.int64)
            for x, y in zip(*np.nonzero(apart <= self.radius), strict=True):
                r, s = self.root(a[0] + x), self.root(b[0] + y)
                if r != s:
                    self.parent[max(r, s)] = min(r, s)
                    self.edges.append((a[0] + x, b[0] + y))

    def spanning(self) -> np.ndarray:
        """Close pairs that connect all that are connected, as rows (n, 2) of numbers in the order given."""
        self.search()
        return self.order[np.array(self.edges, np.int64).reshape(-1, 2)]


def worth_indexing(codes: np.ndarray, starts: np.ndarray, radius: int) -> np.ndarray:
    """Which buckets (rows from starts[i] on) to index: those over a leaf's size, and smaller ones that hold a close pair.
    Rows of all small buckets are compared at once, each with the next, the second next and so on."""
    sizes = np.diff(starts, append=len(codes))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # rows of the bucket from here on, own included
    bucket, found = np.repeat(np.arange(len(starts)), sizes), sizes > LEAF
    left[found[bucket]] = 0
    for step in range(1, LEAF):
        rows = np.flatnonzero(left > step)
        if not len(rows):
            break
        near = np.bitwise_count(codes[rows] ^ codes[rows + step]).sum(axis=1, dtype=np.int64) <= radius
        found[bucket[rows[near]]] = True
    return found


def by_group(it: Iterator[pa.RecordBatch], names: list[str], work) -> Iterator[pa.RecordBatch]:
    """Calls work(table) on whole groups; rows come sorted by the names, so a batch and the group that it ends are held."""
    held: list[pa.RecordBatch] = []  # parts of the last group, which may go on
    for b in it:
        if not b.num_rows:
            continue
        held.append(b)
        if all(held[0].column(c)[0] == b.column(c)[-1] for c in names):
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.logical_and.reduce([pc.equal(t.column(c), t.column(c)[-1]).to_numpy() for c in names])
        first = int(np.flatnonzero(~same)[-1]) + 1
        yield from work(t.slice(0, first))
        held = t.slice(first).to_batches()
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def _links(radius: int):
    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t.column("key")
        starts = np.append(0, 1 + np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy()))
        codes = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(t.num_rows, -1)
        ids, ends = t.column("rep").to_numpy(), np.append(starts[1:], t.num_rows)
        for i in np.flatnonzero(worth_indexing(codes, starts, radius)):
            pairs = ids[starts[i] : ends[i]][Bucket(codes[starts[i] : ends[i]], radius).spanning()]
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_group(it, ["key"], links)

    return partition


def block_keys(fp: str, bits: int, blocks: int, kept: int) -> str:
    """SQL: keys of each choice of `kept` of `blocks` equal blocks of bytes or half bytes: which, and their digits."""
    digits = bits // 4 // blocks
    if digits * 4 * blocks > bits or digits < 1:
        raise ValueError("blocks must be of whole hexadecimal digits")
    part = lambda i: f"substring(hex({fp}), {i * digits + 1}, {digits})"
    return "array(" + ", ".join(f"concat('{n}:', {', '.join(part(i) for i in chosen)})" for n, chosen in enumerate(combinations(range(blocks), kept))) + ")"


def close_pairs(classes: DataFrame, radius: int, bits: int, blocks: int, kept: int) -> DataFrame:
    """(a, b): pairs of classes (fp, rep) within the radius that share a bucket; of each bucket as many as connect it."""
    keyed = classes.select(F.explode(F.expr(block_keys("fp", bits, blocks, kept))).alias("key"), "fp", F.col("rep").cast("long").alias("rep"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, words64: int = 1, radius: int = 2, blocks: int = 4, kept: int = 2, block_bits: int | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, its own included) of every row.

    Fingerprints of 64 * words64 bits link at `radius` or fewer differing bits. Links are sought in buckets that share
    `kept` of `blocks` blocks of the first `block_bits` bits (all, if None); with blocks - kept >= radius none is missed
    (pigeonhole), else it is a banding that finds close pairs with the more probability the closer. Equal fingerprints are
    one class before any search, so copies cost nothing there, and of links only a spanning forest leaves a bucket.

    Null and empty texts have the fingerprint zero, linked like any other; a row with a null doc_id takes part in its
    class but never names it; repeated rows are all returned. An empty table gives an empty result.
    """
    own = checkpointed(fingerprints(docs, shingle, words64))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    found = components(close_pairs(classes, radius, block_bits or 64 * words64, blocks, kept))
    named = classes.join(found, classes.rep == found.id, "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id"))
    return own.join(named, own.fp == named.class_fp, "left").select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row. Null and empty texts have fingerprint 0, linked
    like any other; repeated rows are all returned; an empty table gives no rows; other columns are not read."""
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component_id").cast("long").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates of a smaller doc_id: candidates by this index, settled by the exact similarity of the
    texts, with an exact way for what the index misses (see exact_near)."""
    from lexloom.llm import exact_near

    return exact_near.keep_one(docs)
