"""Benchmark decontamination by templates.

A text becomes a row of tokens.  Numbers, units after a number and names (capitalised words
inside a sentence) become typed placeholders and keep their value beside them, as slots.
Windows of ``WINDOW`` template tokens of documents and items are joined by hash.  Windows that
lie on one diagonal (the same distance between the places in the document and in the item)
are one occurrence: its slots are consistent if each value of the item always stands for one
value of the document, and the other way round.  So a question with other numbers or names is
found, but a text that only has the same frame and mixes its values is not.  A capitalised word
that begins a sentence may be a name or not, so windows are read both ways, unless it is one of
``FUNCTION_WORDS``.  Each window is also hashed by its values without regard to case, so verbatim
copies do not depend on case.  A window with fewer than ``LITERALS`` plain words is only hashed
with its values, as placeholders alone say little.
Items with fewer tokens than a window are one window of their own length.

The items' window hashes go to all tasks if they are few enough (``MOST_HASHES``, counted
first); documents' windows outside of them never leave the task.  Beyond that size all windows
are joined by the shuffle, with equal results.

Defined results: null and empty texts, of documents or items, match nothing; repeated rows of a
document count as one document; equal items are found each; empty tables give no rows; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageframe.llm.common import Memo, freed, mixed, stored, without

WINDOW, LITERALS, LEAST_COVERED = 10, 5, 0.5
MOST_HASHES = 2_000_000

# Units of measure.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second "
    "seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles "
    "inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres dollar "
    "dollars cent cents euro euros percent degree degrees mph kph kmh hz khz mhz ghz w kw v a b kb mb gb tb".split()
)
# Capitalised at the start of a sentence, these are no names.
FUNCTION_WORDS = frozenset(
    "a an the this that these those i you he she it we they my your his her its our their me him us them there here who whom "
    "whose what which when where why how if then so and or but nor yet as at by for from in into of off on onto out over to "
    "under up with without after before during until while since because although though however also each every all any "
    "some no not none both either neither one two three is are was were be been do does did has have had can could may might "
    "must shall should will would let find given suppose calculate once now today yesterday tomorrow more most less many much "
    "only even still just than about between through per please".split()
)
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"^[$€£]?[+-]?\d[\d.,:/]*(%|[a-zA-Z]{1,3})?$")
_NAME = re.compile(r"^[^\W\d_]")
LITERAL, NUMBER, UNIT, NAME, BREAK, NOTHING, STARTER = range(7)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TYPED = np.array([0, 11, 12, 13, 0, 0, 0], np.uint64)


def _token(word: str) -> int:
    """Word to one number: 60 bits of value hash, 3 of kind, 1 if it ends a sentence."""
    if word.isalpha():  # most words need no pattern
        core, ends, letters = word, False, True
    elif word[:-1].isalpha() and word[-1] in ",.!?:;":
        core, ends, letters = word[:-1], word[-1] != ",", True
    else:
        core, ends, letters = _EDGE.sub("", word), word.rstrip("\"')]»”")[-1:] in ".!?:;", False
    low = core.lower()
    if word == "\0":
        kind = BREAK
    elif not core:
        kind = NOTHING
    elif not letters and _NUMBER.match(core):
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif core[0].isupper() and (letters or _NAME.match(core)) and not core.isupper():
        kind = STARTER if low in FUNCTION_WORDS else NAME
    else:
        kind = LITERAL
    digest = hashlib.blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    value = int.from_bytes(digest, "little") >> 4 << 4
    return value | kind << 1 | int(ends or kind == BREAK)


_TOKENS = Memo(_token)


def forget() -> None:
    _TOKENS.clear()


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, value hashes, slot kind or 0) of the tokens of a text."""
    value, slot, _ = _slots(text)
    return _frame(value, slot), value, slot


def _frame(value: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.where(slot == LITERAL, value, _TYPED[slot])


def _slots(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value hashes, slot kinds, slot kinds with names at the start of sentences)."""
    _TOKENS.trim()
    words = (text or "").replace("\0", " ").replace("\n", " \0 ").split()
    if not words:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int8), np.zeros(0, np.int8)
    packed = np.fromiter(map(_TOKENS.__getitem__, words), np.uint64, len(words))
    value, kind = packed >> np.uint64(4), ((packed >> np.uint64(1)) & np.uint64(7)).astype(np.int8)
    ends, real = (packed & np.uint64(1)).astype(np.int8), (kind < BREAK) | (kind == STARTER)
    # The last real token before each, and whether a sentence ended since.
    at = np.flatnonzero(real)
    ended = np.add.accumulate(ends.astype(np.int64))
    value, kind = value[at], kind[at]
    starts = np.ones(len(at), bool)
    starts[1:] = ended[at[1:] - 1] > ended[at[:-1]] - ends[at[:-1]]
    # Inside a sentence a capitalised word is a name, whatever word it is.
    slot = np.where(kind == STARTER, NAME, kind)
    begins = (slot == NAME) & starts
    slot[begins] = LITERAL
    after_number = np.zeros(len(at), bool)
    after_number[1:] = slot[:-1] == NUMBER
    slot[(kind == UNIT) & ~after_number] = LITERAL
    return value, slot, np.where(begins & (kind == NAME), NAME, slot)


def windows(text: str | None, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, places of windows, their hashes, value hashes, slot kinds) for each length that
    fits and each reading: by value (no slots), by template, with names that begin a sentence."""
    value, slot, other = _slots(text)

    def hashed(row: np.ndarray, w: int) -> np.ndarray:
        n = len(row) - w + 1
        h = np.full(n, w, np.uint64)
        for k in range(w):
            h *= _STEP
            h += row[k : k + n]
        return h

    def held(marks: np.ndarray, w: int) -> np.ndarray:
        sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=sums[1:])
        return sums[w:] - sums[:-w]

    for w in lengths:
        if len(value) < w:
            continue
        exact = mixed(hashed(value, w) * _STEP + np.uint64(1)).view(np.int64)
        yield w, np.arange(len(exact)), exact, value.view(np.int64), np.zeros(len(slot), np.int8)
        for reading, new in ((slot, slot != LITERAL), (other, other != slot)):
            # Without a slot of its own, a reading has no window that another one has not.
            at = np.flatnonzero((held(reading == LITERAL, w) >= min(LITERALS, (w + 1) // 2)) & (held(new, w) > 0))
            if len(at):
                yield w, at, mixed(hashed(_frame(value, reading), w)[at]).view(np.int64), value.view(np.int64), reading


_HITS = "id long, window long, place long, slots array<long>"
_HIT_SCHEMA = pa.schema(
    [("id", pa.int64()), ("window", pa.int64()), ("place", pa.int64()), ("slots", pa.list_(pa.int64()))]
)


def _emit(lengths, wanted):
    """Windows of each text, only those of ``wanted`` (sorted hashes) if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        # Most windows are not wanted: their low bits tell, without a search.
        low = np.int64((1 << max(10, 4 + len(known).bit_length())) - 1) if known is not None else None
        if known is not None:
            maybe = np.zeros(int(low) + 1, bool)
            maybe[known & low] = True
        sizes = lengths or [WINDOW]
        for b in batches:
            out, held = ([], [], [], []), 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                own = sizes if lengths else [min(WINDOW, max(1, len(template(text)[0])))]
                for w, place, h, value, slot in windows(text, own):
                    if known is None:
                        at = np.arange(len(h))
                    elif len(known):
                        at = np.flatnonzero(maybe[h & low])
                        i = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
                        at = at[known[i] == h[at]]
                    else:
                        at = np.zeros(0, np.int64)
                    out[0].extend([doc] * len(at))
                    out[1].extend(h[at].tolist())
                    out[2].extend(place[at].tolist())
                    out[3].extend(value[k : k + w][slot[k : k + w] != LITERAL].tolist() for k in place[at])
                    held += len(at)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _HIT_SCHEMA)], schema=_HIT_SCHEMA)
                    out, held = ([], [], [], []), 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _HIT_SCHEMA)], schema=_HIT_SCHEMA)

    return freed(run, forget)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item_id, window, item_place, item_slots, item_windows, length)."""
    source = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).distinct()

    def sized(batches):
        for b in batches:
            lengths = [len(template(t)[0]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int64())], names=["a", "b", "n"])

    counted = stored(source.mapInArrow(sized, "item_id long, text string, n long").where("n > 0"), "items")
    each = counted.select("item_id", "text").mapInArrow(_emit(None, None), _HITS)
    return each.join(counted.select(F.col("item_id").alias("id"), "n"), "id").select(
        F.col("id").alias("item_id"), "window", F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"), F.least("n", F.lit(WINDOW)).cast("int").alias("length"), "n",
    )


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_hashes: int = MOST_HASHES
) -> DataFrame:
    """Rows (doc_id, item_id, n_windows, covered, consistent, same_values, contaminated) of
    documents and items with a common window.  ``covered`` is the share of the item's windows
    in consistent occurrences."""
    spark = docs.sparkSession
    bench = stored(item_windows(items), "item_windows")
    lengths = sorted(r["length"] for r in bench.select("length").distinct().collect())  # WINDOW of them at most
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashes = bench.select("window").distinct()
    wanted = None
    if hashes.count() <= most_hashes:
        wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in hashes.collect()], np.int64)))
    found = source.mapInArrow(_emit(lengths, wanted) if lengths else _nothing, _HITS)
    pairs = found.join(bench, "window").select(
        F.col("id").alias("doc_id"), "item_id", "item_place", "n", "length",
        (F.col("place") - F.col("item_place")).alias("diagonal"),
        F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")).alias("slots"),
    )
    occurrence = ["doc_id", "item_id", "diagonal"]
    # A map from value to value, both ways; an occurrence has at most its item's slots.
    occurrences = pairs.groupBy(*occurrence).agg(
        F.collect_set("item_place").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        F.first("n").alias("n"),
        F.first("length").alias("length"),
    )
    one_to_one = (F.size(F.array_distinct("slots.a")) == F.size("slots")) & (
        F.size(F.array_distinct("slots.b")) == F.size("slots")
    )
    occurrences = occurrences.select(
        "*", one_to_one.alias("consistent"), F.forall("slots", lambda s: s["a"] == s["b"]).alias("same")
    )
    good = F.when(F.col("consistent"), F.col("places"))
    per_item = occurrences.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set(good)))).alias("n_good"),
        F.bool_or("consistent").alias("consistent"),
        F.bool_and("same").alias("same_values"),
        F.first("n").alias("n"),
        F.first("length").alias("length"),
    )
    covered = F.col("n_good") / (F.col("n") - F.col("length") + 1)
    return per_item.select(
        "doc_id", "item_id", "n_windows", covered.alias("covered"), "consistent", "same_values",
        (covered >= LEAST_COVERED).alias("contaminated"),
    )


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        pass
    return iter(())


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that hold no item; rows with a null id share one verdict."""
    bad = matches(docs, items, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("_bad_id")).distinct()
    bad = stored(bad, "contaminated")
    return without(docs, bad, docs[id_col].cast("long").eqNullSafe(bad["_bad_id"]))
