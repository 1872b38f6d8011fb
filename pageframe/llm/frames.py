"""Token ids in seekable zstandard files: one independent frame per document.

A file is a row of zstandard frames, each one document's ids as little-endian unsigned 32-bit
numbers with the frame's own checksum; then a skippable frame with the documents' ids; then
the seek table of the public seekable format (a skippable frame with compressed size, size and
checksum of each frame, and a footer).  A reader needs the two last frames and only the data
frames of the documents that it wants.

Files go to the shared folder.  A task writes a file of its own name per attempt and the rows
that it returns name the file, so what a lost attempt leaves behind is never read.

Defined results: a null or empty text is a document of the end id alone; null ids come first;
documents with equal ids lie side by side, ordered by a hash of their text; an empty table
gives no file; only the two named columns are read, so others cannot clash.  One document may
have up to 2**30 - 1 ids (the format's sizes have 32 bits).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.common import stored, width
from pageframe.llm.tokens import encoder, tokenizer_path
from pageframe.sources.shared import fresh_path

# Fixed values of the public seekable format and of skippable frames.
SKIPPABLE, INDEX_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
END_ID, LEVEL = 2, 3
#: Documents that are encoded at once.
ROWS = 2000
_FOOTER = struct.Struct("<IBI")
_HEAD = struct.Struct("<II")
_ENTRY = struct.Struct("<III")
_DOC = struct.Struct("<?q")


def checksum(content: bytes) -> int:
    """The format's: the low 32 bits of XXH64."""
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path and the path in it; any store that pyarrow knows."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class FrameWriter:
    """Appends documents to one file; ``close`` writes the index and the seek table."""

    def __init__(self, path: str, level: int = LEVEL):
        import zstandard

        fs, name = file_system(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(name, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[bytes] = []
        self.docs: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.entries.append(_ENTRY.pack(len(frame), len(ids), checksum(ids)))
        self.docs.append(_DOC.pack(doc_id is not None, doc_id or 0))

    def close(self) -> None:
        index, table = b"".join(self.docs), b"".join(self.entries)
        self.out.write(_HEAD.pack(INDEX_FRAME, len(index)) + index)
        footer = _FOOTER.pack(len(self.entries), 0x80, SEEKABLE)
        self.out.write(_HEAD.pack(SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class FrameReader:
    """Random access to one file."""

    def __init__(self, path: str):
        import zstandard

        fs, name = file_system(path)
        self.file, self.zstd = fs.open_input_file(name), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError(f"{path} has no seek table")
        table_at = size - _FOOTER.size - n * _ENTRY.size
        self.entries = list(_ENTRY.iter_unpack(self.file.read_at(n * _ENTRY.size, table_at)))
        index_at = table_at - _HEAD.size - n * _DOC.size
        docs = _DOC.iter_unpack(self.file.read_at(n * _DOC.size, index_at))
        self.doc_ids = [d if known else None for known, d in docs]
        self.starts = [0]
        for packed, _, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        packed, size, expected = self.entries[k]
        ids = self.zstd.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)
        if len(ids) != size or checksum(ids) != expected:
            raise ValueError(f"frame {k} is damaged")
        return ids

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """Only the frames of the wanted documents are read and decompressed."""
        wanted = set(wanted)
        for k, d in enumerate(self.doc_ids):
            if d in wanted:
                yield d, self.frame(k)


def _write_task(folder: str, path: str, end_id: int, level: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n, n_ids = TaskContext.get(), None, 0, 0
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            coded = encoder(path).encode([t or "" for t in b.column(1).to_pylist()])
            for doc_id, ids in zip(b.column(0).to_pylist(), coded):
                if out is None:
                    name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
                    out = FrameWriter(name, level)
                out.add(doc_id, ids + end)
                n, n_ids = n + 1, n_ids + len(ids) // 4 + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_docs": [n], "n_ids": [n_ids]}
            )

    return run


def write(
    docs: DataFrame,
    folder: str | None = None,
    path: str | None = None,
    end_id: int = END_ID,
    level: int = LEVEL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending id order, a file per range of ids.  Returns the list
    of files, (shard, file, n_docs, n_ids, start): start is the number of ids before the file."""
    folder = folder or fresh_path(docs.sparkSession, "frames")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(width(docs), "id", tie).sortWithinPartitions("id", tie)
    files = ordered.mapInArrow(
        _write_task(folder, path or tokenizer_path(), end_id, level), "shard int, file string, n_docs long, n_ids long"
    )
    files = stored(files, "files")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))  # one row per file


_ROW = "doc_id long, start long, n_tokens long, ids binary"


def _read_task(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader, rows, held = FrameReader(name), [], 0
                for k, d in enumerate(reader.doc_ids):
                    ids = reader.frame(k)
                    rows.append((d, start, len(ids) // 4, zlib.crc32(ids) if digest else ids))
                    start, held = start + len(ids) // 4, held + (0 if digest else len(ids))
                    if len(rows) >= 10_000 or held > 16_000_000:
                        yield _rows(rows, digest)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, digest)

    return run


def _rows(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read(files: DataFrame, digest: bool = False) -> DataFrame:
    """All documents of the files: (doc_id, start, n_tokens, ids), or ids_crc32 for ids."""
    dealt = files.select("file", "start").repartition(width(files), "file")
    return dealt.mapInArrow(_read_task(digest), _ROW.replace("ids binary", "ids_crc32 long") if digest else _ROW)
