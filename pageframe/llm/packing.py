"""Bounded-space best-fit packing of token ids into sequences of a fixed length.

Each task packs its own documents online: a fixed number of bins is open, a bitset keyed by
free space tells which amounts of free space are there, and a piece goes to the bin that it
fills most.  If none fits and all bins are open, the fullest closes.  Bins still open when a
task ends are packed once more, whole, over groups of tasks, so few of them stay half empty.

Nothing but those last bins is shuffled.  Defined results: a null or empty text is one piece
that holds the end id only; repeated rows and null ids are packed like others; an empty table
gives no piece; only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.common import stored
from pageframe.llm.tokens import encoder, tokenizer_path

CAPACITY, OPEN_BINS, END_ID = 2048, 256, 0
#: Documents that are sorted by length at once.
ROWS = 2000
#: Tasks whose last bins are packed together, and bins open then.
TASKS_PER_GROUP, LAST_OPEN = 64, 4096


class BestFit:
    """Open bins by free space.  ``put`` returns (bin, offset); ``closed`` gets full bins."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0  # bit f is set if an open bin has f places free
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return one

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            one = self._take(free)
        else:
            if self.n_open == self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, one = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(one)
            self.bits |= 1 << left
            self.n_open += 1
        return one, self.capacity - free

    def still_open(self) -> dict[int, int]:
        """Free space by bin."""
        return {b: f for f, bins in self.by_free.items() for b in bins}


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes the remainder, the others are full."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, bin long, offset long, free int"


def _pack_task(path: str, capacity: int, most_open: int, end_id: int, with_ids: bool, at_once: int = ROWS):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        fit, enc = BestFit(capacity, most_open), encoder(path)
        waiting: dict[int, list[tuple]] = defaultdict(list)  # rows of bins that are still open

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "free"] + ["ids"] * with_ids
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.int32()] + [pa.binary()] * with_ids
            arrays = {n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)}
            arrays["task"] = pa.array([task] * len(rows), pa.int32())
            order = [f.split(" ")[0] for f in _PIECE.split(", ")] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays([arrays[n] for n in order], names=order)

        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids = b.column(0).to_pylist()
            texts = b.column(1)
            coded = [
                blob
                for at in range(0, len(ids), at_once)
                for blob in enc.encode([t or "" for t in texts.slice(at, at_once).to_pylist()])
            ]
            # Longest first within these: small pieces then fill what is left.
            for k in sorted(range(len(ids)), key=lambda k: -len(coded[k])):
                blob = coded[k] + end
                for i, (start, length) in enumerate(pieces_of(len(blob) // 4, capacity)):
                    part = blob[4 * start : 4 * (start + length)]
                    one, offset = fit.put(length)
                    row = (ids[k], i, start, length, zlib.crc32(part), one, offset)
                    waiting[one].append((*row, part) if with_ids else row)
            still = fit.still_open()
            done = [one for one in waiting if one not in still]
            if rows := [(*r[:7], 0, *r[7:]) for one in done for r in waiting.pop(one)]:
                yield batch(rows)
        still = fit.still_open()
        if rows := [(*r[:7], still.get(one, 0), *r[7:]) for one, rs in waiting.items() for r in rs]:
            yield batch(rows)

    return run


def _pack_last(capacity: int, most_open: int):
    def run(key, pdf):
        fit = BestFit(capacity, most_open)
        pdf = pdf.sort_values(["used", "task", "bin"], ascending=[False, True, True], ignore_index=True)
        placed = [fit.put(int(n)) for n in pdf["used"]]
        pdf["new_bin"] = [p[0] for p in placed]
        pdf["base"] = [p[1] for p in placed]
        return pdf[["task", "bin", "last_group", "new_bin", "base"]]

    return run


def packed(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    most_open: int = OPEN_BINS,
    end_id: int = END_ID,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    at_once: int = ROWS,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids]); ``ids`` are
    the piece's ids as little-endian unsigned 32-bit bytes.  ``at_once`` texts are encoded
    together: their chunks are Python objects, far larger than the texts, and fewer take less memory."""
    path = path or tokenizer_path()
    schema = _PIECE + ", ids binary" * with_ids
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = stored(source.mapInArrow(_pack_task(path, capacity, most_open, end_id, with_ids, at_once), schema), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    # Full bins: task and bin are the sequence's number.  Even numbers here, odd ones below.
    number = lambda high, low: F.shiftleft(high.cast("long"), 32) + low * 2
    full = pieces.where("free = 0").withColumn("sequence_id", number(F.col("task"), F.col("bin")))
    last = pieces.where("free > 0")
    group = F.floor(F.col("task") / TASKS_PER_GROUP).cast("int")
    bins = last.groupBy("task", "bin").agg((capacity - F.first("free")).cast("long").alias("used"))
    bins = bins.withColumn("last_group", group)
    again = bins.groupBy("last_group").applyInPandas(
        _pack_last(capacity, LAST_OPEN), "task int, bin long, last_group int, new_bin long, base long"
    )
    rest = last.join(again, ["task", "bin"]).select(
        *[c for c in columns if c not in ("sequence_id", "offset")],
        (number(F.col("last_group"), F.col("new_bin")) + 1).alias("sequence_id"),
        (F.col("offset") + F.col("base")).alias("offset"),
    )
    return full.select(columns).unionByName(rest.select(columns))
