"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks.

A chunk is one white space character at most, then letters and digits, or then anything else
up to the next white space.  The byte-level splitter always cuts at both places, so a text's
ids are its chunks' ids one after another.  Texts with other white space (runs, at an end) or
with the mark of a special token go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

from pageframe.llm.common import KEPT  # noqa: E402

#: Marks of special tokens, and white space that the library's splitter does not take for such.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
CHUNK = re.compile(r"\s?[^\W_]+|\s?\S+")
#: Bytes of remembered chunks and their ids; characters of a chunk that is remembered; chunks or
#: texts given to the library at once (each makes a large object until its ids are read), and
#: chunks that are put together to one text for it.
MOST_BYTES, LONG_CHUNK, AT_ONCE, TOGETHER = 120_000_000, 200, 2048, 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = MOST_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A byte-level token has one character for each byte that it stands for.
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, "<i8")
        self.n_bytes[list(vocab.values())] = list(map(len, vocab))
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.before: set[str] = set()
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), AT_ONCE):
            done = self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in done]
        return out

    def apart(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each chunk.  The splitter cuts before a chunk that begins with white space, so these
        are encoded side by side and their ids are told apart by the bytes they stand for."""
        spaced = [c for c in chunks if c[0].isspace()]
        bare = [c for c in chunks if not c[0].isspace()]
        found = dict(zip(bare, self.whole(bare)))
        for k in range(0, len(spaced), AT_ONCE):
            part = spaced[k : k + AT_ONCE]
            texts = ["".join(part[at : at + TOGETHER]) for at in range(0, len(part), TOGETHER)]
            done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in done])
            sizes = map(len, part) if all(map(str.isascii, texts)) else (len(c.encode()) for c in part)
            reached, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum(np.fromiter(sizes, "<i8", len(part)))
            ends = np.searchsorted(reached, wanted) + 1
            if ends[-1] == len(ids) and (reached[ends - 1] == wanted).all():
                blob, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                found.update(zip(part, [blob[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:  # a vocabulary without some bytes
                found.update(zip(part, self.whole(part)))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """A batch of texts, each encoded whole."""
        known = self.known
        chunks = [chunks_of(t) for t in texts]
        asked = set().union(*filter(None, chunks))
        new = list(asked - known.keys())
        ids = self.apart(new)
        known.update(ids)
        self.held += sum(map(len, ids.values())) + sum(map(len, new)) + 180 * len(new)
        odd = iter(self.whole([t for t, c in zip(texts, chunks) if c is None]))
        out = [next(odd) if c is None else b"".join(map(known.__getitem__, c)) for c in chunks]
        if self.held > self.most:  # keep what this batch and the one before have in common
            self.known = {c: known[c] for c in asked & self.before if len(c) <= LONG_CHUNK}
            self.held = sum(len(c) + len(b) + 180 for c, b in self.known.items())
            if 2 * self.held > self.most:
                self.forget()
        self.before = asked
        return out


def chunks_of(text: str) -> list[str] | None:
    """The chunks of a text, None if it has to be encoded whole: white space that follows white
    space or ends the text is in no chunk."""
    if text[:1].isspace() or any(x in text for x in ODD):
        return None
    chunks = CHUNK.findall(text)
    return chunks if sum(map(len, chunks)) == len(text) else None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Ends the encoders of this worker, with all that they remember."""
    _ENCODERS.clear()


KEPT.append(forget)
