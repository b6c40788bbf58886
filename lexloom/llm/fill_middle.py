"""Fill-in-the-middle: texts cut in three at unit ranks and put together in another order, by overlapping chunks.

A text's bytes are dealt into chunks that overlap by one byte, so that a predicate on two adjacent bytes can say of every
byte whether a unit (a code point, a word, a line) begins there. Each chunk counts its units alone; prefix sums of the counts
route a cut's rank to the one chunk that owns it, and only that chunk is scanned again for the place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk.
CHUNK = 1 << 16
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Whether a unit begins at a byte (here), from it and the byte before; a line end stands before a text.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "character": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "line": lambda before, here: before == 10,
}
SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output binary"


class Chunks:
    """The units of one text, counted by chunk."""

    def __init__(self, text: bytes, unit: str = "character", size: int = CHUNK):
        self.text, self.begins, self.size = np.frombuffer(b"\n" + text, np.uint8), UNITS[unit], size
        counts = [int(np.count_nonzero(self.scan(k))) for k in range(-(-len(text) // size))]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])  # units before each chunk; the last: in all

    def scan(self, k: int) -> np.ndarray:
        piece = self.text[k * self.size : (k + 1) * self.size + 1]  # with the last byte of the chunk before
        return self.begins(piece[:-1], piece[1:])

    @property
    def n(self) -> int:
        return int(self.before[-1])

    def place(self, rank: int) -> int:
        """The byte at which the unit of this rank begins; 0 for rank 0, the text's end for rank n."""
        if rank == 0 or rank >= self.n:
            return 0 if rank == 0 else len(self.text) - 1
        owner = int(np.searchsorted(self.before, rank, side="right")) - 1
        return owner * self.size + int(np.flatnonzero(self.scan(owner))[rank - self.before[owner]])


def rearranged(text: bytes, draws: tuple[int, int, int, int], unit: str = "character", rate: int = 90, spm_rate: int = 20, size: int = CHUNK) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, units of the prefix and of the middle, and the output of one text."""
    chunks = Chunks(text, unit, size)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return chunks.n, "plain", None, None, text
    first, last = sorted((draws[0] % (chunks.n + 1), draws[1] % (chunks.n + 1)))
    a, b = chunks.place(first), chunks.place(last)
    if draws[3] % 100 < spm_rate:
        return chunks.n, "spm", first, last - first, b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return chunks.n, "psm", first, last - first, b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_middle(docs: DataFrame, unit: str = "character", seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output): a row for each row of docs, whole texts.

    n counts a text's units (see UNITS). Of all texts `rate` percent are cut, of these `spm_rate` percent put the suffix first
    (spm), the others the prefix (psm); the rest stays as it is (plain), as do empty texts and those that hold a mark.
    All draws come from sha256 of `seed:doc_id`, so equal ids are drawn alike, and repeated rows give equal rows.
    A null text is empty, a null doc_id draws as an empty id. Empty tables give no rows; other columns of docs are not read.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, drawn = batch.column(0), batch.column(1), list(zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True))
            at, most = 0, 16 << 20  # outputs of about so many bytes a batch
            while at < len(ids):
                rows, size, begin = [], 0, at
                while at < len(ids) and (not rows or size < most):
                    rows.append(rearranged(texts[at].as_py(), drawn[at], unit, rate, spm_rate))
                    size, at = size + len(rows[-1][-1]), at + 1
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin).cast(pa.int64()), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    made = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *draws).mapInArrow(batches, SCHEMA)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: marks never occur in a cut text, so they part the output."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(i)) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle_report(docs: DataFrame) -> DataFrame:
    """fill_middle by code points as digests: doc_id, n, form, prefix_chars, middle_chars, output_sha256, and restored_sha256 of
    the text rebuilt from output and form. Nulls, empty texts and repeats as there."""
    made = fill_middle(docs)
    whole = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))
