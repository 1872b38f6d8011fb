"""Join of documents by the Jaccard similarity of their word n-grams: all links, exactly.

The document by n-gram incidence matrix A is kept as (class, n-gram, size) entries; a class is
a set of n-grams, however many documents have it.  The wanted pairs are the cells of A * A'
that reach a bound, and most cells are never computed:

1. ``incidence``: each task hashes its texts.  An n-gram seen twice within the task is known
   to be shared; the others go, one entry per task and n-gram, packed and compressed, to
   column blocks, where those that some other class has come out.  N-grams that only one
   class has can add to no overlap and end here.
2. ``survivors``: a class of size s needs a partner with an overlap of at least 0.8 s, so a
   class with fewer shared n-grams than that goes.
3. ``entries``: with rarest first, linked classes meet in one of the first s - ceil(0.8 s) + 1
   n-grams.  Only those are joined, and only if the rest can still reach the bound
   ceil(t (s1 + s2) / (1 + t)) and the classes' parity bits differ in no more places than
   n-grams of linked classes may.
4. Candidate pairs are row products, computed on blocks of pairs.  First each class only
   meets two others of its n-gram's list, from other components than its own, which in a few
   rounds ties large groups of near copies together without their pairs; then come all pairs
   between different components.

Hashes have 56 bits.  Nothing of the corpus reaches the driver but counts.  No list of an
n-gram is ever gathered in one task: lists are joined, and large ones may be split.

Defined results: a text without words (null or empty) has an empty set, is linked with nothing
and is its own component; fewer words than n make one n-gram of the whole; equal sets are
linked; rows with one id are one document for the links; a null id is no component's number
(rows of null ids alone get null).  Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.common import Memo, components, freed, mixed, stored, width, without

N, THRESHOLD = 5, Fraction(80, 100)
HASH_BITS = 56
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Word to 64-bit hash, remembered.
_WORDS = Memo(lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))


def forget() -> None:
    _WORDS.clear()


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams."""
    _WORDS.trim()
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
        if len(h) >= n:
            total = h[: len(h) - n + 1].copy()
            for k in range(1, n):
                total = total * _STEP + h[k : len(h) - n + 1 + k]
        elif len(h):
            total = np.array([len(h)], np.uint64)
            for k in range(len(h)):
                total = total * _STEP + h[k]
        else:
            total = h
        out.append(np.unique(mixed(total) >> np.uint64(64 - HASH_BITS)))
    return out


def class_key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _packed(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: high bytes that hardly change cost little."""
    import zstandard

    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return planes.T.copy().view(kind).ravel()


_PART = pa.schema(
    [
        ("bucket", pa.int32()),
        ("doc_id", pa.int64()),
        ("cls", pa.int64()),
        ("n", pa.int32()),
        ("gram", pa.int64()),
        ("grams", pa.binary()),
        ("rows", pa.binary()),
        ("classes", pa.binary()),
        ("sizes", pa.binary()),
    ]
)
_PART_SQL = "bucket int, doc_id long, cls long, n int, gram long, grams binary, rows binary, classes binary, sizes binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("gram", pa.int64())])
_OUT_SQL = "doc_id long, cls long, n int, gram long"
#: Entries that a task holds before it sends them on.
HELD = 1_500_000


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [
        pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def gram_rows(n: int):
    """Texts to (class keys, sets); an empty set has no class."""

    def run(texts: list[str | None]) -> tuple[list[int | None], list[np.ndarray]]:
        sets = shingle_sets(texts, n)
        return [class_key(g) if len(g) else None for g in sets], sets

    return run


def _measure(rows_of, buckets: int, most: int | None = None):
    shift = np.uint64(HASH_BITS - 16)

    def flush(classes: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Sends all entries on and empties both lists."""
        if not classes:
            return
        # arrays end as soon as they can: all cores of an executor do this at once
        cls = np.array(classes, np.int64)
        size = np.array([len(s) for s in sets], np.int32)
        classes.clear()
        gram = np.concatenate(sets)
        sets.clear()
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        row = np.repeat(np.arange(len(cls), dtype=np.uint32), size)[order]
        del order
        new = gram[1:] != gram[:-1]
        first = np.r_[True, new]
        known = ~(first & np.r_[new, True])
        del new
        at = np.flatnonzero(known)
        for k in range(0, len(at), 200_000):
            i = at[k : k + 200_000]
            bucket = (((gram[i] >> shift).astype(np.int64) * buckets) >> 16).astype(np.int32)
            yield _batch(_PART, bucket=bucket, cls=cls[row[i]], n=size[row[i]], gram=gram[i].astype(np.int64))
        # One entry per n-gram goes to its block; row 2**32 - 1 stands for those known here.
        row[known] = 2**32 - 1
        del at, known
        gram, row = gram[first], row[first]
        # the least n-gram of each block
        least = [-((-b << 16) // buckets) << int(shift) for b in range(buckets)]
        edge = np.append(np.searchsorted(gram, np.array(least, np.uint64)), len(gram))
        parts: dict[str, list] = {k: [] for k in ("bucket", "grams", "rows", "classes", "sizes")}
        for b in range(buckets):
            i, j = edge[b], edge[b + 1]
            if i < j:
                used, local = np.unique(row[i:j], return_inverse=True)
                some = used[used < len(cls)]
                parts["bucket"].append(b)
                parts["grams"].append(_packed(np.diff(gram[i:j], prepend=np.uint64(0))))
                parts["rows"].append(_packed(local.astype(np.uint32)))
                parts["classes"].append(cls[some].tobytes())
                parts["sizes"].append(size[some].tobytes())
                if len(parts["bucket"]) == 64:
                    yield _batch(_PART, **parts)
                    parts = {k: [] for k in parts}
        if parts["bucket"]:
            yield _batch(_PART, **parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        classes: list[int] = []
        sets: list[np.ndarray] = []
        held = 0
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1)
            for k in range(0, len(docs), 500):
                keys, grams = rows_of(texts[k : k + 500].to_pylist())
                # documents only pass through the blocks: dealt by turns, so copies of one text spread
                yield _batch(
                    _PART,
                    bucket=(np.arange(len(keys)) + k) % buckets,
                    doc_id=docs[k : k + 500],
                    cls=keys,
                    n=[len(g) for g in grams],
                )
                for c, g in zip(keys, grams):
                    if c is not None and c not in seen:
                        seen.add(c)
                        classes.append(c)
                        sets.append(g)
                        held += len(g)
                if most is not None and held > most:
                    yield from flush(classes, sets)
                    seen, held = set(), 0
            if held > HELD:
                yield from flush(classes, sets)
                seen, held = set(), 0
        yield from flush(classes, sets)

    return freed(run, forget)


def _shared(table: pa.Table) -> pa.Table:
    """One column block: passes on documents and known entries, finds n-grams of two classes."""
    packed = table.filter(pc.is_valid(table["grams"]))
    rest = table.filter(pc.is_null(table["grams"])).select(_OUT.names)
    grams, cls, size = [], [], []
    for g, r, c, s in zip(*(packed[k].to_pylist() for k in ("grams", "rows", "classes", "sizes"))):
        local = _unpacked(r, np.uint32)
        # The last number may stand for "known in its task": no class, but the n-gram counts.
        grams.append(np.cumsum(_unpacked(g, np.uint64)))
        cls.append(np.append(np.frombuffer(c, np.int64), 0)[local])
        size.append(np.append(np.frombuffer(s, np.int32), 0)[local])
    out = [rest.cast(_OUT)]
    if grams:
        gram, cls, size = np.concatenate(grams), np.concatenate(cls), np.concatenate(size)
        order = np.lexsort((cls, gram))
        gram, cls, size = gram[order], cls[order], size[order]
        same = (gram[1:] == gram[:-1]) & (cls[1:] == cls[:-1])
        new = np.r_[True, ~same | (size[1:] == 0)]
        gram, cls, size = gram[new], cls[new], size[new]
        # Shared: two classes, or one that is known to be shared in its task.
        run = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        length = np.diff(np.append(run, len(gram)))
        known = np.maximum.reduceat((size == 0).astype(np.int8), run)
        keep = np.repeat((length > 1) | (known == 1), length) & (size > 0)
        out.append(
            pa.Table.from_batches(
                [_batch(_OUT, cls=cls[keep], n=size[keep], gram=gram[keep].astype(np.int64))], schema=_OUT
            )
        )
    return pa.concat_tables(out)


def incidence(
    docs: DataFrame, rows_of, id_col: str = "doc_id", text_col: str = "text", most: int | None = None
) -> DataFrame:
    """Rows of documents (doc_id, cls, n; gram null) and of shared entries (cls, n, gram).  With ``most``
    a task sends its entries on as soon as it holds so many, also inside an Arrow batch."""
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    parts = source.mapInArrow(_measure(rows_of, 2 * width(docs), most), _PART_SQL)
    return stored(parts.groupBy("bucket").applyInArrow(_shared, _OUT_SQL), "incidence")


def _least_overlap(size: Column, t: Fraction) -> Column:
    """Smallest overlap of a set of this size with any partner."""
    return F.ceil(size * t.numerator / F.lit(t.denominator) - F.lit(1e-9)).cast("int")


def _pair_bound(a: Column, b: Column, t: Fraction) -> Column:
    return F.ceil((a + b) * t.numerator / F.lit(t.numerator + t.denominator) - F.lit(1e-9)).cast("int")


def survivors(found: DataFrame, t: Fraction) -> DataFrame:
    """Entries (cls, n, gram) of classes that have enough shared n-grams for any link."""
    rows = found.where("gram IS NOT NULL").select("cls", "n", "gram")
    # One exchange for the distinct rows and the count: both hold the rows of a class together.
    rows = rows.repartition(width(rows), "cls").distinct()
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("cls")))
    return rows.where(F.col("c") >= _least_overlap(F.col("n"), t))


def prefixes(entries: DataFrame, t: Fraction) -> DataFrame:
    """The first n-grams of each class, rarest first, with their place and what follows."""
    often = entries.groupBy("gram").agg(F.count("*").alias("df"))
    rows = entries.join(often, "gram")
    whole = Window.partitionBy("cls")
    rank = F.row_number().over(whole.orderBy("df", "gram"))
    rows = rows.withColumn("pos", F.col("n") - F.col("c") + rank.cast("int") - 1)
    bit, word = F.expr("shiftleft(1L, CAST(gram & 63 AS INT))"), F.expr(f"(gram >> 6) % {PARITY_WORDS}")
    parity = [F.coalesce(F.bit_xor(F.when(word == k, bit)).over(whole), F.lit(0)) for k in range(PARITY_WORDS)]
    own = (F.col("n") - F.col("c")).cast("int").alias("own")
    rows = rows.withColumn("parity", F.struct(own, *[x.alias(f"w{k}") for k, x in enumerate(parity)]))
    return rows.where((F.col("df") > 1) & (F.col("pos") <= F.col("n") - _least_overlap(F.col("n"), t))).select(
        "gram", "cls", "n", "pos", "parity"
    )


#: Numbers of 64 parity bits by class: a bit tells whether an odd number of its shared n-grams hash to it.
PARITY_WORDS = 4


def _few_differences(a: str, b: str, t: Fraction) -> Column:
    """Of linked sets, at most (1 - t) / (1 + t) of all n-grams are in one of the two only.  All that no
    other class has (``own``) are such, and every parity bit that differs needs one more."""
    differ = sum(F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))) for k in range(PARITY_WORDS))
    differ = differ + F.col(f"{a}.own") + F.col(f"{b}.own")
    total = F.col("n") + F.col("n2")
    return differ * (t.denominator + t.numerator) <= total * (t.denominator - t.numerator)


def _reach(t: Fraction) -> Column:
    """The rest after this common n-gram can reach the pair's bound, and the sizes fit."""
    bound = _pair_bound(F.col("n"), F.col("n2"), t)
    left = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return (left >= bound) & (F.least("n", "n2") >= bound)


def _overlaps(t: Fraction):
    """Row products on a block of pairs: equal (pair, n-gram) cells are adjacent once sorted."""
    num, den = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            n1, n2 = (b.column(k).to_numpy().astype(np.int64) for k in ("n", "n2"))
            linked = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(b.column("grams").to_pylist(), b.column("grams2").to_pylist())):
                both = np.concatenate([np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)])
                both.sort(kind="stable")
                overlap = np.count_nonzero(both[1:] == both[:-1])
                linked[k] = den * overlap >= num * (n1[k] + n2[k] - overlap)
            yield pa.RecordBatch.from_pydict({"a": a[linked], "b": c[linked]})

    return run


def _row_blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = [np.sort(np.array(g, np.int64)).tobytes() for g in b.column("grams").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("cls"), b.column("n"), pa.array(grams, pa.binary())], names=["cls", "n", "grams"]
        )


def verified(pairs: DataFrame, rows: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold."""
    left = rows.select(F.col("cls").alias("a"), "n", "grams")
    right = rows.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("grams").alias("grams2"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_overlaps(t), "a long, b long")


def _labelled(first: DataFrame, links: DataFrame | None) -> DataFrame:
    """Prefix entries with their component so far."""
    if links is None:
        return first.withColumn("component", F.col("cls"))
    found = components(links, first.sparkSession).withColumnRenamed("id", "cls")
    rows = first.join(found, "cls", "left")
    return stored(rows.withColumn("component", F.coalesce("component", "cls")), "labelled")


_PAIR = (F.least, F.greatest)


def _pair() -> list[Column]:
    return [order("cls", "cls2").alias(name) for order, name in zip(_PAIR, "ab")]


#: Others that a class is compared with in a linear round.
PARTNERS = 4


def _towards_two(rows: DataFrame, t: Fraction) -> DataFrame:
    """Each class with a few others of its n-grams' lists, of a list's first and last component,
    among sizes that can fit together: as many pairs as classes, not the square of a list."""
    scale = F.floor(F.log("n") / F.log(F.lit(1 / float(t)))).cast("int")
    keyed = rows.withColumn("scale", scale)
    one = F.struct("component", F.xxhash64("cls", "gram").alias("h"), "cls", "n", "pos", "parity")
    ends = keyed.groupBy("gram", "scale").agg(F.min(one).alias("low"), F.max(one).alias("high"))
    ends = ends.where("low.component <> high.component").withColumn("end", F.explode(F.array("low", "high")))
    ends = ends.select(
        "gram", "scale", F.col("end.cls").alias("cls2"), F.col("end.n").alias("n2"), F.col("end.pos").alias("pos2"),
        F.col("end.component").alias("component2"), F.col("end.parity").alias("parity2"),
    )
    apart = (F.col("component") != F.col("component2")) & _reach(t) & _few_differences("parity", "parity2", t)
    near = keyed.join(ends, ["gram", "scale"]).where(apart)
    # of all those met, a few that hashes choose: enough to tie a group, and as many rows as classes
    met = [F.struct(F.xxhash64(F.lit(k), "cls2").alias("h"), "cls2") for k in range(PARTNERS // 2)]
    chosen = near.groupBy("cls").agg(F.array(*[f(x) for x in met for f in (F.min, F.max)]).alias("met"))
    return chosen.select("cls", F.explode("met.cls2").alias("cls2")).select(*_pair()).distinct()


def _all_apart(rows: DataFrame, t: Fraction, key: str = "component") -> DataFrame:
    """All pairs of different components (or of another ``key``) that can still be linked: the rest
    after a common n-gram reaches the bound and few parity bits differ."""
    lists = rows.groupBy("gram").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    rows = rows.join(lists.where("lo <> hi").select("gram"), "gram")
    other = rows.select(
        "gram", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"),
        F.col("parity").alias("parity2"), F.col(key).alias("key2"),
    )
    apart = (F.col(key) < F.col("key2")) & _reach(t) & _few_differences("parity", "parity2", t)
    return rows.join(other, "gram").where(apart).select(*_pair()).distinct()


#: Rounds towards two others before all open pairs are looked at.
LINEAR_ROUNDS = 3


def _tables(found: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Written rows of the classes that may be linked, and their first n-grams."""
    entries = stored(survivors(found, t), "entries")
    rows = entries.groupBy("cls", "n").agg(F.collect_list("gram").alias("grams"))
    rows = stored(rows.mapInArrow(_row_blob, "cls long, n int, grams binary"), "rows")
    return rows, stored(prefixes(entries, t), "prefixes")


def links(
    docs: DataFrame, n: int = N, t: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(all linked pairs (a, b) of different classes, rows (doc_id, class_id, n_links)).  n_links
    counts the other classes that a class is linked with, null without a class; no component
    spares a pair, so the work grows with the pairs of a group."""
    found = incidence(docs, gram_rows(n), id_col, text_col)
    rows, first = _tables(found, t)
    pairs = stored(verified(stored(_all_apart(first, t, "cls"), "pairs"), rows, t), "links")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b"))
    counted = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    members = found.where("gram IS NULL").select("doc_id", "cls").join(counted, "cls", "left")
    n_links = F.when(F.col("cls").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return pairs, members.select("doc_id", F.col("cls").alias("class_id"), n_links.alias("n_links"))


def class_links(found: DataFrame, t: Fraction = THRESHOLD) -> DataFrame:
    """Edges (a, b) between classes that span all components of the linked classes."""
    rows, first = _tables(found, t)
    links, tried = None, None
    for k in range(LINEAR_ROUNDS + 1):
        labelled = _labelled(first, links)
        pairs = _towards_two(labelled, t) if k < LINEAR_ROUNDS else _all_apart(labelled, t)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        more = stored(verified(pairs, rows, t), "links")
        links = more if links is None else links.union(more)
        tried = pairs if tried is None else tried.union(pairs)
    return links


def linked_documents(
    docs: DataFrame, n: int = N, t: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, class_id)."""
    found = incidence(docs, gram_rows(n), id_col, text_col)
    rows = found.where("gram IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "cls")
    of_class = components(class_links(found, t), docs.sparkSession)
    # The component's number is the smallest document in any of its classes; documents that
    # have several rows tie their classes together.
    smallest = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least_id"))
    labelled = smallest.join(of_class.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls")
    )
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "component").select("cls", "component_id")
    # Copies a third of all rows: the class rows are few and narrow, the documents may be split.
    return rows.join(named, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id")
    )


def duckdb_sql(table: str = "documents") -> str:
    """The same for DuckDB, by all pairs that share an n-gram and their closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t),
n AS (SELECT t.doc_id, coalesce(c, 0) AS n FROM t LEFT JOIN (SELECT doc_id, count(*) AS c FROM s GROUP BY 1) USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, m) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.m) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2"""


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each group of linked ones, the smallest id; rows of one id
    stay or go together, rows without id stay."""
    linked = linked_documents(docs, id_col=id_col, text_col=text_col)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
    gone = stored(gone, "gone")
    return without(docs, gone, docs[id_col].cast("long") == gone["_gone_id"])
