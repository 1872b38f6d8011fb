"""Spelling variants: words one edit apart, found by search schemes on an FM-index.

A search scheme for one error has two searches: the first half of a word is matched exactly and
the rest is read to the right with one error allowed; the second half is matched exactly and the
rest is read to the left.  Each runs on suffix-rank intervals of the delimited vocabulary, the
first on the index of the reversed words (it extends to the right), the second on that of the
words (to the left): together the two directions of a bidirectional index.

Distribution: a match shares one of the two exact halves, so words are dealt by halves.  A word
goes to its own halves, where it is looked for, and to those that a word one code point longer
or shorter would look for: four rows a word.  Buckets of halves have a bounded number of rows, by
the counted vocabulary; the words of a half with more rows than that are split into slices and
the words to look for go to each.  A bucket is one index of one direction, so nothing grows
beyond a bucket, and a lost task builds its own again.

Defined results: null and empty texts have no words; a null id counts as an empty one; repeated
rows count each; a run of any length is one word; ties of forms go by code point; an empty table
gives an empty table; only the two named columns are read, so others cannot clash.
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

from pageframe.llm.common import stored

LEAST_CHARS, LEAST_SEEN, RATIO, TYPO_EVERY = 5, 3, 2, 97
#: Words that a task counts before it passes them on; rows of an index; words looked for at once.
HELD_WORDS, BUCKET_ROWS, AT_ONCE = 200_000, 24_000, 2048
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_CHARS)


def runs_of(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """(word, times) of the runs that may be words, those with a planted slip of the pen changed."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, times in Counter(_RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % TYPO_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        yield run, times


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for word, times in runs_of(doc_id, text or ""):
                seen[word] = seen.get(word, 0) + times
            if len(seen) > HELD_WORDS:
                yield out()
                seen = {}
    if seen:
        yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: at least five code points, seen at least three times."""
    source = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    counts = source.mapInArrow(_count_task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)


def suffix_ranks(text: np.ndarray, n_delimiters: int) -> np.ndarray:
    """Start places of the suffixes in their order; delimiters (0) count by place, so all differ."""
    n = len(text)
    rank = np.where(text == 0, np.cumsum(text == 0) - 1, text + n_delimiters).astype(np.int64)
    step = 1
    while True:
        then = np.zeros(n, np.int64)
        then[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + then
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class OneWayIndex:
    """FM-index of sorted, distinct words between delimiters; patterns grow to the left.

    Row ``k`` of the delimiter's rows is the suffix that starts with word ``k``."""

    def __init__(self, words: list[str]):
        self.n_words = len(words)
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, codes = np.unique(text, return_inverse=True)
        order = suffix_ranks(codes.astype(np.int64), self.n_words + 1)
        # left of the first delimiter is the last one, as its last place, which no interval holds
        row = np.where(order == 0, len(codes), np.arange(len(codes)))
        self.n = len(codes) + 1
        self.places = np.sort(codes[order - 1].astype(np.int64) * self.n + row)

    def codes(self, word: str) -> np.ndarray:
        return np.searchsorted(self.letters, np.frombuffer(word.encode("utf-32-le"), np.uint32))

    def extend(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one more character to the left: places of (character, row) in order
        are the rows of the suffixes that start there."""
        base = code * self.n
        return np.searchsorted(self.places, base + lo), np.searchsorted(self.places, base + hi)

    def near(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the wanted word, number of the near word), the last half of the wanted word
        exact and one error in what stands before it.  A pair may come more than once."""
        found = [self._near(wanted[at : at + AT_ONCE], at) for at in range(0, len(wanted), AT_ONCE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _near(self, wanted: list[str], base: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in wanted])
        first = np.cumsum(sizes) - sizes
        flat = self.codes("".join(wanted)).astype(np.int64)
        left = sizes - self.half(sizes)  # characters that may hold the error
        q, rem = np.arange(len(wanted)), sizes.copy()
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.n_words + 1)
        while True:  # the exact half
            go = np.flatnonzero(rem > left)
            if not len(go):
                break
            rem[go] -= 1
            lo[go], hi[go] = self.extend(lo[go], hi[go], flat[first[go] + rem[go]])
        spent = [np.zeros(0, np.int64)] * 4  # (q, rem, lo, hi) with the error behind them
        letters = np.arange(1, len(self.letters))
        out_q, out_word = [], []
        while len(q) or len(spent[0]):
            alive = hi > lo
            q, rem, lo, hi = q[alive], rem[alive], lo[alive], hi[alive]
            more = rem > 0
            here = np.where(more, flat[np.where(more, first[q] + rem - 1, 0)], -1)
            # any character: one too many, or another one in place of ours
            clo, chi = self.extend(np.repeat(lo, len(letters)), np.repeat(hi, len(letters)), np.tile(letters, len(q)))
            at = np.flatnonzero(chi > clo)
            state, char = at // max(len(letters), 1), letters[at % max(len(letters), 1)]
            extra = (q[state], rem[state], clo[at], chi[at])
            other = more[state] & (char != here[state])
            swapped = (q[state][other], rem[state][other] - 1, clo[at][other], chi[at][other])
            missing = (q[more], rem[more] - 1, lo[more], hi[more])
            # those with an error go on exactly; at the word's start only a delimiter may follow
            done = spent[1] == 0
            dlo, dhi = self.extend(spent[2][done], spent[3][done], np.zeros(done.sum(), np.int64))
            hit = dhi > dlo
            out_q.append(spent[0][done][hit])
            out_word.append(dlo[hit])
            sq, srem, slo, shi = (s[~done] for s in spent)
            slo, shi = self.extend(slo, shi, flat[first[sq] + srem - 1] if len(sq) else sq)
            on = shi > slo
            onward = (sq[on], srem[on] - 1, slo[on], shi[on])
            spent = [np.concatenate(x) for x in zip(onward, extra, swapped, missing)]
            # the error is still to come
            q, rem = q[more], rem[more] - 1
            lo, hi = self.extend(lo[more], hi[more], here[more])
        return np.concatenate(out_q) + base, np.concatenate(out_word)

    @staticmethod
    def half(size: np.ndarray) -> np.ndarray:
        """Length of the exact half, which is the last here."""
        return (size + 1) // 2


class ReversedIndex(OneWayIndex):
    """The same on reversed words: patterns of the words themselves grow to the right."""

    @staticmethod
    def half(size: np.ndarray) -> np.ndarray:
        return size // 2


def _bucket(key: tuple, table: pa.Table) -> pa.Table:
    """Near pairs of one bucket; its side tells the direction."""
    flip = 1 if key[0].as_py() % 2 else -1
    counts = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
    words = sorted(w[::flip] for w in counts)
    asked = {w for w, a in zip(table["word"].to_pylist(), table["asked"].to_pylist()) if a}
    wanted = [w for w in words if w[::flip] in asked]
    q, k = (OneWayIndex if flip == 1 else ReversedIndex)(words).near(wanted) if wanted else ([], [])
    pairs = [(wanted[a][::flip], words[b][::flip]) for a, b in sorted(set(zip(map(int, q), map(int, k))))]
    pairs = [(a, b) for a, b in pairs if a != b]
    return pa.table(
        {
            "word": pa.array([a for a, _ in pairs], pa.string()),
            "near": pa.array([b for _, b in pairs], pa.string()),
            "near_n": pa.array([counts[b] for _, b in pairs], pa.int64()),
        }
    )


def dealt(words: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, word, n, asked): four rows a word, and more copies of those asked in split halves."""
    size = F.length("word")
    # (side, length of the half, is it the half that the word itself looks for)
    halves = F.array(
        *[F.struct(F.lit(0).alias("side"), (F.floor((size + d) / 2)).cast("int").alias("chars")) for d in (-1, 0, 1)],
        *[F.struct(F.lit(1).alias("side"), (F.floor((size + d) / 2)).cast("int").alias("chars")) for d in (0, 1, 2)],
    )
    rows = words.select("word", "n", F.explode(F.array_distinct(halves)).alias("h"))
    left, chars = F.col("h.side") == 0, F.col("h.chars")
    rows = rows.select(
        "word", "n", F.col("h.side").alias("side"),
        F.when(left, F.expr("substr(word, 1, h.chars)")).otherwise(F.expr("right(word, h.chars)")).alias("half"),
        (chars == F.when(left, F.floor(size / 2)).otherwise(F.floor((size + 1) / 2))).alias("asked"),
    )
    rows = stored(rows, "halves")
    by_half = rows.groupBy("side", "half").agg(F.count("*").alias("rows"))
    split = by_half.where(F.col("rows") > bucket_rows)
    slices = F.coalesce(F.ceil(F.col("rows") / bucket_rows), F.lit(1))
    own = F.pmod(F.xxhash64("word"), slices)
    n_buckets = max(1, -(-rows.count() // bucket_rows))
    copied = rows.join(split, ["side", "half"], "left").select(
        "word", "n", "side", "half", "asked", own.alias("own"),
        F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(own))).alias("slice"),
    )
    # a word that is asked in another slice than its own is not part of the index there, but
    # being in it too does no harm: pairs are made distinct
    number = F.pmod(F.xxhash64("half", "slice"), F.lit(n_buckets)) * 2 + F.col("side")
    return copied.select(number.alias("bucket"), "word", "n", "asked")


def near_pairs(words: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one inserted, deleted or replaced code
    point apart, near_n the count of the second."""
    found = dealt(words, bucket_rows).groupBy("bucket").applyInArrow(_bucket, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last of the forms that follow one another.  Counts
    double at least from a word to its form, so there is no circle and few rounds."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = links.join(ahead, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")
        )
        step = stored(step, "roots")
        links = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return links


def grouped(words: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n)."""
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    near = near_pairs(words, bucket_rows).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    largest = -F.col("best.minus")
    chosen = largest >= RATIO * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(chosen, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, largest).alias("form_n"),
    )
    rows = stored(rows, "variants")
    last = roots(rows.where("form IS NOT NULL"))
    return rows.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def duckdb_sql() -> str:
    """The query over ``documents`` for DuckDB: near words by deleting each code point."""
    crc_step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"""
    WITH RECURSIVE runs AS (
      SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents) u
      WHERE length(run) >= {LEAST_CHARS} GROUP BY doc_id, run),
    bytes AS (
      SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs),
    summed AS (
      SELECT *, xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i::INT + 1, 2) AS BIGINT))),
               lambda c, b: {crc_step})) AS h
      FROM bytes),
    words AS (
      SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, times
        FROM summed) v
      WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(times) >= {LEAST_SEEN}),
    cut AS (
      SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest
      FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words) x),
    pairs AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (
      SELECT word, n_near, near, near_n FROM (
        SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
               row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
        FROM pairs) p WHERE place = 1),
    formed AS (
      SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
             CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form,
             CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
      FROM words w LEFT JOIN best b ON w.word = b.word),
    chain AS (
      SELECT word, word AS at, form AS then FROM formed
      UNION ALL
      SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.then = f.word)
    SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM formed f JOIN chain c ON c.word = f.word AND c.then IS NULL"""
