"""Frames: exact round trip through files, random access, damage, odd input."""

import zlib

import pytest

from pageframe.llm import frames as Z
from pageframe.llm import tokens as T
from pageframe.llm.queries import op7_seekable_frames
from tests.llm.test_packing import make_texts


def test_query_equals_plain_encoding(spark, folder):
    texts = {i * 7 - 300: t for i, t in enumerate(make_texts())}
    out = op7_seekable_frames(spark, folder(list(texts.items())))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()}
    enc, at = T.Encoder(T.tokenizer_path()), 0
    for i in sorted(texts):
        ids = enc.whole([texts[i] or ""])[0] + (2).to_bytes(4, "little")
        assert got.pop(i) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert not got


def test_only_wanted_frames_are_read(table, tmp_path):
    docs = table([(i, f"text number {i} " * 50) for i in range(40)] + [(None, None), (5, "again")])
    files = Z.write(docs, folder=str(tmp_path / "f")).collect()
    enc, found = T.Encoder(T.tokenizer_path()), {}
    for f in files:
        reader = Z.FrameReader(f["file"])
        read, reader.frame = [], lambda k, real=reader.frame: read.append(k) or real(k)
        for d, ids in reader.documents([3, 5, 39]):
            found.setdefault(d, []).append(ids)
        assert len(read) == sum(d in (3, 5, 39) for d in reader.doc_ids)
    assert {d: len(x) for d, x in found.items()} == {3: 1, 5: 2, 39: 1}
    assert found[3][0][:-4] == enc.whole(["text number 3 " * 50])[0]


def test_damage_is_seen(tmp_path):
    path = str(tmp_path / "d.zst")
    w = Z.FrameWriter(path)
    w.add(1, b"abcd" * 90)
    w.add(2, bytes(range(200)))
    w.close()
    data = bytearray(open(path, "rb").read())
    at = Z.FrameReader(path).starts[1] + 20
    data[at] ^= 255
    open(path, "wb").write(data)
    reader = Z.FrameReader(path)
    assert reader.frame(0) == b"abcd" * 90
    with pytest.raises(Exception):
        reader.frame(1)


def test_empty_table(table):
    assert Z.read(Z.write(table([]))).count() == 0


def test_a_reader_of_the_public_format_accepts_the_files(tmp_path):
    """The seek table by its published layout, read without this library: the skippable frame's head,
    an entry (compressed size, size, low half of XXH64) for each frame, number, flags and magic."""
    import struct

    import xxhash
    import zstandard

    path, contents = str(tmp_path / "p.zst"), [b"abcd" * 90, bytes(range(200)), b"wxyz"]
    w = Z.FrameWriter(path)
    for k, content in enumerate(contents):
        w.add(k, content)
    w.close()
    data = open(path, "rb").read()
    number, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (number, flags & 0x80, magic) == (3, 0x80, 0x8F92EAB1)
    table = data[-9 - 12 * number : -9]
    head = data[-9 - 12 * number - 8 : -9 - 12 * number]
    assert struct.unpack("<II", head) == (0x184D2A5E, len(table) + 9)
    at = 0
    for content, (packed, size, check) in zip(contents, struct.iter_unpack("<III", table)):
        assert zstandard.ZstdDecompressor().decompress(data[at : at + packed]) == content and size == len(content)
        assert check == xxhash.xxh64(content).intdigest() & 0xFFFFFFFF
        at += packed
    # what follows are skippable frames, so a plain reader gives the whole content
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(contents)
