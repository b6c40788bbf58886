"""Removal of repeated passages by blockwise suffix sorting with a difference cover.

A suffix (here: the `SPAN` bytes from a position on) is filed under the least hash of the K-byte strings inside it, so equal
suffixes meet in one bucket. Neighbouring suffixes with the same least string form a run, about one in nineteen bytes.

1. Runs go to buckets by their key. Runs of equal bytes are settled by a hash of the run: all but those of the smallest
   document are repeats. Those of the smallest document stay open where a run of another document shares their key and
   short hashes of what stands before or behind the least string say that the two can have an equal suffix.
2. The bytes of open runs go to the buckets, and each bucket's suffixes are sorted, one bucket at a time: by words of 8
   bytes first; the long ties that remain are resolved by ranks precomputed at the positions of a difference cover.
3. The covered ranges meet their documents again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import written

SPAN, K = 50, 16
_W = SPAN - K + 1  # K-byte strings in a suffix
#: Difference cover: every difference modulo 7 is one of two of these residues.
COVER_MOD, COVER = 7, (0, 1, 3)
#: Bytes that a cover rank stands for. With the words at 0, 8, 16 and 42, a block from 18 to 24 on closes the gap to 50.
BLOCK, NEAREST = 24, 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]  # fixed values: odd multipliers
_ODD_INVERSE = np.uint64(pow(int(_ODD[2]), -1, 2**64))
#: An equal suffix with LEFT bytes or more before its least string has the K bytes from there on in common; any other one the K
#: bytes that start _W - LEFT behind.
LEFT, SHORT, SEG = _W // 2, np.uint64(4095), np.uint64(2**56 - 1)
RUN = np.dtype([("key", "<u4"), ("seg", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<u4"), ("at", "<u4"), ("n", "<u4")])  # n windows from `at` on
RANGE = np.dtype([("key", "<u4"), ("doc", "<u4"), ("at", "<u4"), ("n", "<u4")])
DOC = np.dtype([("id", "<i8"), ("crc", "<u4")])  # the crc, 0 if no doc_id is repeated, tells rows apart that repeat one


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; zero bytes follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view("<u8").ravel()


def runs_of(data: bytes) -> np.ndarray:
    """The runs of a text; `doc` is left 0. Equal suffixes have equal keys wherever they stand; equal runs, equal segs. `left` and
    `right` are 0 where no suffix of the run needs them, and both where the least string stands more than once."""
    if len(data) < SPAN:
        return np.zeros(0, RUN)
    w = words(np.frombuffer(data, np.uint8))
    n = len(w) - K + 1
    h = _mixed(w[:n] * _ODD[1] ^ _mixed(w[8 : n + 8]))
    leasts, reach = [h], 1
    while 2 * reach <= _W:
        leasts.append(np.minimum(leasts[-1][:-reach], leasts[-1][reach:]))
        reach *= 2
    least = leasts[-1]
    if reach < _W:
        least = np.minimum(least[: len(least) - (_W - reach)], least[_W - reach :])
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.concatenate([at[1:], [len(least)]])
    first, behind = at.copy(), end + _W - 1  # of the places of the least string, by halving: the first, and the one behind the last
    for m in reversed(leasts):
        size = n - len(m) + 1
        first += size * ((first < len(m)) & (m[np.minimum(first, len(m) - 1)] > least[at]))
        behind -= size * ((behind >= size) & (m[np.maximum(behind - size, 0)] > least[at]))
    once = first + 1 == behind
    del leasts
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD[2])]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD_INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:n])])
    out = np.zeros(len(at), RUN)
    out["key"], out["at"], out["n"] = least[at] & np.uint64(2**32 - 1), at, end - at  # low bits: least hashes have small high ones
    out["left"] = np.where(once & (first - at >= LEFT), h[np.maximum(first - LEFT, 0)] % SHORT + np.uint64(1), 0)
    out["right"] = np.where(once & (first - end < LEFT - 1), h[np.minimum(first + _W - LEFT, n - 1)] % SHORT + np.uint64(1), 0)
    out["seg"] = _mixed((sums[end + _W - 1] - sums[at]) * inverse[at] + (end - at).astype(np.uint64) * _ODD[0]) & SEG
    return out


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def stretch(data: bytes) -> bytes:
    return zstandard.decompress(data)


def _planes(column: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next, and so on: bytes that are zero throughout are squeezed away."""
    return np.ascontiguousarray(np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.dtype.itemsize).T).tobytes()


def _from_planes(data: bytes, kind: np.dtype, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()


def _pack(docs: np.ndarray, rows: np.ndarray, extra: bytes = b"") -> bytes:
    """Rows and the documents they name, column by column, squeezed. Documents are told by steps, small ones if rows are in their order."""
    used, own = np.unique(rows["doc"], return_inverse=True)
    rows, named = rows.copy(), docs[used]
    rows["doc"] = np.diff(own.astype(np.uint32), prepend=np.uint32(0))
    named["id"] = np.diff(named["id"], prepend=0)
    columns = b"".join(_planes(t[c]) for t in (named, rows) for c in t.dtype.names)
    return squeeze(np.array([len(used), len(rows), len(extra)], "<i8").tobytes() + columns + extra)


def _unpack(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, bytes]:
    data = stretch(blob)
    n_docs, n, n_extra = np.frombuffer(data, "<i8", 3).tolist()
    docs, rows, at = np.zeros(n_docs, DOC), np.zeros(n, kind), 24
    for t in (docs, rows):
        for c in t.dtype.names:
            t[c] = _from_planes(data, t.dtype[c], len(t), at)
            at += len(t) * t.dtype[c].itemsize
    docs["id"], rows["doc"] = np.cumsum(docs["id"]), np.cumsum(rows["doc"], dtype=np.uint32)
    return docs, rows, data[at : at + n_extra]


def _gathered(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The rows of many blobs, and their documents in order of doc_id."""
    all_docs, all_rows, base = [], [], 0
    for blob in blobs:
        docs, rows, _ = _unpack(blob, kind)
        rows["doc"] += np.uint32(base)
        base += len(docs)
        all_docs.append(docs)
        all_rows.append(rows)
    docs, rows = np.concatenate(all_docs), np.concatenate(all_rows)
    known, own = np.unique(docs, return_inverse=True)
    rows["doc"] = own[rows["doc"]]
    return known, rows


def _spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """From each start to the next, the last to n; none if there is no start."""
    return zip(starts.tolist(), [*starts[1:].tolist(), n][: len(starts)], strict=True)


def _dealt(docs: np.ndarray, rows: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((rows["at"], rows["doc"], to))
    for a, b in _spans(np.flatnonzero(np.diff(to[order], prepend=-1)), len(to)):
        yield int(to[order[a]]), _pack(docs, rows[order[a:b]])


def _batch(pairs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["bucket", "blob"])


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the high bits, so that the keys of a bucket have them in common."""
    return (keys.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _first_in(rows: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """True at the first row of each group; rows are sorted by the names."""
    new = np.ones(len(rows), bool)
    if len(rows):
        new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names])
    return new


def _apart(ids: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """True at rows of which another with equal columns has another id."""
    out = np.zeros(len(ids), bool)
    if len(ids):
        order = np.lexsort(columns)
        starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])]))
        of = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(ids)))
        out[order] = (np.minimum.reduceat(ids[order], starts) < np.maximum.reduceat(ids[order], starts))[of]
    return out


def _find_runs(buckets: int, repeated: bool = True, at_once: int = 24_000_000):
    """Runs by key bucket (blob of RUN). Of equal runs in one task only those of the smallest document travel; the others
    are known to be repeats, and go to a bucket of their document, marked by a seg of 0 and a key of 0."""

    def settle(docs: list[tuple], parts: list[np.ndarray]) -> pa.RecordBatch | None:
        if not parts:
            return None
        known, rows = np.array(docs, DOC), np.concatenate(parts)
        ids = known["id"][rows["doc"]]
        rows = rows[order := np.lexsort((ids, rows["seg"], rows["key"]))]
        ids = ids[order]
        new = _first_in(rows, ("key", "seg"))
        least = ids[new][np.cumsum(new) - 1]
        repeat = ids > least
        to = _key_bucket(rows["key"], buckets)
        to[repeat] = _bucket_of(ids[repeat], buckets)
        for c in ("key", "seg", "left", "right"):
            rows[c][repeat] = 0
        return _batch(list(_dealt(known, rows, to)))

    def partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held = [], [], 0
        for b in it:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(rows := runs_of(data)):
                    rows["doc"] = len(docs)
                    docs.append((i, zlib.crc32(data) if repeated else 0))
                    parts.append(rows)
                    if (held := held + len(data)) > at_once:
                        yield settle(docs, parts)
                        docs, parts, held = [], [], 0
        if (out := settle(docs, parts)) is not None:
            yield out

    return partition


def _by_bucket(work):
    """Calls work(blobs) for each bucket; the rows come sorted by bucket, and one bucket is held at a time."""

    def partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in it:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield from work(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from work(blobs)

    return partition


def _settle_runs(buckets: int):
    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, rows = _gathered(blobs, RUN)  # docs are in order of doc_id
        rows = rows[np.lexsort((rows["at"], rows["doc"], rows["seg"], rows["key"]))]
        sure = (rows["key"] == 0) & (rows["seg"] == 0)
        ids = docs["id"][rows["doc"]]
        seg, key = _first_in(rows, ("key", "seg")), _first_in(rows, ("key",))
        of_seg, of_key = np.cumsum(seg) - 1, np.cumsum(key) - 1
        repeat = sure | (ids > ids[seg][of_seg])
        starts = np.flatnonzero(key)
        several = np.add.reduceat(seg.astype(int), starts)[of_key] > 1 if len(starts) else np.zeros(0, bool)
        apart = (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts))[of_key] if len(starts) else several
        # of runs of equal bytes only those of the smallest document stay open, all of them: the others are repeats as they
        # are. Rows that repeat doc_id and text have the same ranges, so one stands for all
        maybe = np.flatnonzero(~repeat & several & apart & _first_in(rows, ("key", "seg", "doc", "at")))
        left, right, of = rows["left"][maybe], rows["right"][maybe], of_key[maybe]
        any_place = np.zeros(len(starts), bool)  # keys of a run whose least string stands more than once
        any_place[of[(left == 0) & (right == 0)]] = True
        meets = any_place[of] | ((left > 0) & _apart(ids[maybe], left, of)) | ((right > 0) & _apart(ids[maybe], right, of))
        for is_open, chosen in ((False, np.flatnonzero(repeat)), (True, maybe[meets])):
            out = np.zeros(len(chosen), RANGE)
            for c in ("doc", "at", "n", *(("key",) if is_open else ())):
                out[c] = rows[c][chosen]
            if len(out):
                dealt = _batch(list(_dealt(docs, out, _bucket_of(docs["id"][out["doc"]], buckets))))
                yield dealt.append_column("open", pa.array([is_open] * dealt.num_rows))

    return _by_bucket(work)


def _fetch(buckets: int):
    """Blobs of open runs by key bucket, with their bytes, from the documents of a bucket and its ranges."""

    def cell(texts: pa.Table, ranges: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        if texts.num_rows and ranges.num_rows:
            docs, rows = _gathered(ranges.column("blob").to_pylist(), RANGE)
            data = {(i, c): t for i, c, t in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "crc", "text")), strict=True)}
            rows = rows[np.lexsort((rows["at"], rows["doc"], _key_bucket(rows["key"], buckets)))]
            to = _key_bucket(rows["key"], buckets)
            kept: dict[int, bytes] = {}
            for a, b in _spans(np.flatnonzero(np.diff(to, prepend=-1)), len(to)):
                part, body = rows[a:b], []
                for d, at, n in zip(part["doc"].tolist(), part["at"].tolist(), part["n"].tolist(), strict=True):
                    if d not in kept:
                        kept[d] = stretch(data[int(docs["id"][d]), int(docs["crc"][d])])
                    body.append(kept[d][at : at + n + SPAN - 1])
                out.append((int(to[a]), _pack(docs, part, b"".join(body))))
        return pa.Table.from_batches([_batch(out)])

    return cell


def equal_suffixes(key: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the classes of equal SPAN-byte strings among the positions `at` of data, each under its key.

    Sorted by key and the words at 0, 8, 16 and 42; ties are resolved by the ranks of BLOCK-byte strings at cover
    positions: for two positions there is a shift from NEAREST to NEAREST + 6 that puts both on the cover.
    """
    w = words(data)
    columns = [key, w[at], w[at + 8], w[at + 16], w[at + SPAN - 8]]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(at), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    shift = np.array([[next(d for d in range(NEAREST, NEAREST + COVER_MOD) if (a + d) % COVER_MOD in COVER and (b + d) % COVER_MOD in COVER) for b in range(COVER_MOD)] for a in range(COVER_MOD)])
    where = at[order]
    needed = np.zeros(len(data) + SPAN, bool)
    needed[np.unique(where[tied][:, None] + np.arange(NEAREST, NEAREST + COVER_MOD))] = True
    sample = np.flatnonzero(needed[: len(data)] & np.isin(np.arange(len(data)) % COVER_MOD, COVER))
    blocks = [w[sample + d] for d in range(0, BLOCK, 8)]
    by = np.lexsort(blocks[::-1])
    rise = np.zeros(len(sample), bool)
    for c in blocks:
        rise[1:] |= c[by][1:] != c[by][:-1]
    rank = np.zeros(len(data) + SPAN, np.int64)
    rank[sample[by]] = np.cumsum(rise)
    left, label, fresh = np.flatnonzero(tied), group.copy(), int(group[-1]) + 1
    while len(left):  # each round parts off what equals the first of its group
        first = _first_in(np.rec.fromarrays([label[left]], names="g"), ("g",))
        lead = where[left][np.flatnonzero(first)[np.cumsum(first) - 1]]
        d = shift[where[left] % COVER_MOD, lead % COVER_MOD]
        other = left[rank[where[left] + d] != rank[lead + d]]
        if not len(other):
            break
        _, label_of = np.unique(label[other], return_inverse=True)
        label[other] = fresh + label_of
        fresh += int(label_of.max()) + 1
        left = other
    out = np.empty(len(at), np.int64)
    out[order] = label
    return out


def _resolve(buckets: int):
    def work(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(b, RANGE) for b in blobs]
        docs = np.concatenate([p[0] for p in parts])
        data = np.frombuffer(b"".join(p[2] for p in parts) + bytes(SPAN), np.uint8)
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        for (_, r, _), b in zip(parts, base, strict=False):
            r["doc"] += np.uint32(b)
        rows = np.concatenate([p[1] for p in parts])
        n = rows["n"].astype(np.int64)
        text_at = np.concatenate([[0], np.cumsum(n + SPAN - 1)])[:-1]
        run = np.repeat(np.arange(len(rows)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        label = equal_suffixes(rows["key"][run], data, text_at[run] + step)
        ids = docs["id"][rows["doc"][run]]
        least = np.full(int(label.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        covered = ids > least[label]
        # neighbouring covered suffixes of a run make one range
        starts = covered & ~np.concatenate([[False], covered[:-1] & (run[1:] == run[:-1])])
        if starts.any():
            out = np.zeros(int(starts.sum()), RANGE)
            first = np.flatnonzero(starts)
            out["doc"], out["at"] = rows["doc"][run[first]], rows["at"][run[first]] + step[first]
            out["n"] = np.bincount((np.cumsum(starts) - 1)[covered], minlength=len(first))
            yield _batch(list(_dealt(docs, out, _bucket_of(docs["id"][out["doc"]], buckets))))

    return _by_bucket(work)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _cut(texts: pa.Table, ranges: pa.Table) -> pa.Table:
    found: dict[tuple[int, int], list] = {}
    if ranges.num_rows:
        docs, rows = _gathered(ranges.column("blob").to_pylist(), RANGE)
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        for a, b in _spans(np.flatnonzero(_first_in(rows, ("doc",))), len(rows)):
            d = docs[rows["doc"][a]]
            found[int(d["id"]), int(d["crc"])] = rows[a:b]
    out = []
    for i, crc, squeezed in zip(*(texts.column(c).to_pylist() for c in ("doc_id", "crc", "text")), strict=True):
        data = stretch(squeezed)
        own = found.get((i, crc), ())
        kept, spans = data, 0
        if len(own):
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, own["at"].astype(np.int64), 1)
            np.add.at(edge, own["at"].astype(np.int64) + own["n"] + SPAN - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pa.Table.from_pylist([dict(zip(RESULT.names, r, strict=True)) for r in out], schema=RESULT)


def _texts(buckets: int, repeated: bool):
    def partition(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            data = [t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            columns = [pa.array(_bucket_of(ids, buckets), pa.int32()), b.column(0), pa.array([zlib.crc32(d) if repeated else 0 for d in data], pa.int64()), pa.array([squeeze(d) for d in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "crc", "text"])

    return partition


def remove_repeats(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that remain) of every row.

    A byte goes if it lies in a SPAN-byte string of the text (as UTF-8) that also starts in a document of smaller doc_id;
    all strings are judged on the input. A null or empty text has no bytes. Rows that repeat a doc_id are cut one by one
    and take nothing from each other; rows without doc_id neither lose nor cover anything. An empty table gives none.

    buckets: two for each shuffle partition by default; a task holds one bucket of runs, open runs or documents.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named, blobs = base.where("doc_id is not null"), "bucket int, blob binary"
    dealt = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    repeated = bool(named.groupBy("doc_id").count().where("count > 1").head(1))  # crcs are as long as runs' keys: only if needed
    ranges = written(dealt(named.mapInArrow(_find_runs(buckets, repeated), blobs)).mapInArrow(_settle_runs(buckets), f"{blobs}, open boolean"))
    texts = named.mapInArrow(_texts(buckets, repeated), "bucket int, doc_id long, crc long, text binary").groupBy("bucket")
    of_kind = lambda kind: ranges.where(kind).select("bucket", "blob")
    fetched = texts.cogroup(of_kind("open").groupBy("bucket")).applyInArrow(_fetch(buckets), blobs)
    resolved = dealt(fetched).mapInArrow(_resolve(buckets), blobs)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = texts.cogroup(of_kind("NOT open").unionByName(resolved).groupBy("bucket")).applyInArrow(_cut, result)
    whole = base.where("doc_id is null").selectExpr(
        "doc_id", "cast(octet_length(text) as long) as n_bytes", "0L as n_removed", "0L as n_spans", "sha2(text, 256) as kept_sha256", "cast(text as binary) as kept")
    return cut.unionByName(whole)


def repeats_report(docs: DataFrame) -> DataFrame:
    """remove_repeats without the bytes that stay: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. Nulls,
    empty texts and empty tables as there."""
    return remove_repeats(docs).drop("kept")
