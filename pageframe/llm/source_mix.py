"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is its share of the mix by weight, at most ``MOST_EPOCHS`` times its own
words; what is cut off there is shared by weight among the others.  A source is taken whole as
often as its target holds it.  The rest of the target is filled in the order of Efraimidis'
and Spirakis' keys, an exponential number divided by the document's quality weight, so
documents of good quality come first more often.  The last document is taken in part, so a
source's words meet its target.

The keys come from a digest of the document's id and size, so reruns agree.  Texts are read
once.  Narrow rows are sorted over all tasks by source and key; each task sums its rows, and a
source's running total is that of its earlier ranges plus that in the range, so a source of
any size is split.  Built-in functions only.  One row per source meets in one task.

Defined results: a null or empty text has no words and nothing of it is taken; a null source is
a source, the last one; a null id counts as an empty one; repeated rows are taken each on its
own; a source without words has target 0; an empty table gives an empty table; only the three
named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm.common import stored, width

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix by words of all sources, and most times a source is taken.
SHARE, MOST_EPOCHS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of anything but letters, blanks and the marks of prose: digits, symbols, markup.
ODD = r"""[^\x20\x09-\x0DA-Za-z\x{C0}-\x{FF}.,;:!?'"()-]+"""
ODD_COST = 10
_UNIT = 2**52

_SOURCE = ["no_source", "source"]
_ORDER = ["key", "doc_id", "size"]


def quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: the more odd runs by word, the smaller."""
    odd = F.regexp_count(text, F.lit(ODD))
    return 1.0 / (1.0 + ODD_COST * odd / F.greatest(size, F.lit(1)))


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """(doc_id, no_source, source, size, key); the smallest keys of a source are taken first.
    ``weight`` is a positive column of ``docs``, the quality of the text by default."""
    text, source = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{source_col}`").cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.lit(None) if weight is None else weight).cast("double").alias("weight"),
        text.alias("text"),
    )
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))
    unit = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / _UNIT
    by = F.coalesce("weight", quality(F.col("text"), F.col("size")))
    return sized.select("doc_id", *_SOURCE, "size", (-F.log(unit) / by).alias("key"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(no_source, source, source_size, target) of rows (no_source, source, source_size).

    Sources are filled in the order of words by weight.  Before the first whose share is not
    above its bound, all are at their bounds; from there on all have the same target by weight.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(*_SOURCE)) - 1
    numbered = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights)))
    numbered = numbered.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source_size") / F.col("weight"), *_SOURCE)))
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    bound = F.lit(float(MOST_EPOCHS)) * F.col("source_size")
    left = share * F.sum("source_size").over(everything) - MOST_EPOCHS * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    levelled = numbered.withColumn("level", left / F.sum("weight").over(later))
    free = F.col("level") * F.col("weight") <= bound
    first = F.min(F.when(free, F.struct("rank", "level"))).over(everything)
    return levelled.withColumn("first", first).select(
        *_SOURCE,
        "source_size",
        F.when(F.col("rank") < F.col("first.rank"), bound).otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one per document."""
    if share > MOST_EPOCHS:
        raise ValueError("the mix is larger than all sources taken as often as they may be")
    narrow = stored(measured(docs, id_col, text_col, source_col, weight), "sizes")
    ranges = narrow.repartitionByRange(width(narrow), *_SOURCE, *_ORDER)
    ranges = stored(ranges.withColumn("range", F.spark_partition_id()), "ranges")
    sums = stored(ranges.groupBy(*_SOURCE, "range").agg(F.sum("size").alias("words")), "range-sums")
    aims = targets(sums.groupBy(*_SOURCE).agg(F.sum("words").alias("source_size")), weights, share)
    epochs = F.least(F.floor(F.try_divide("target", "source_size")), F.lit(MOST_EPOCHS))
    aims = aims.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    aims = aims.withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = Window.partitionBy(*_SOURCE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    inside = Window.partitionBy(*_SOURCE, "range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    running = ranges.withColumn("running", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    left = F.col("budget") - F.col("before") - F.col("running")
    last = F.least("size", F.greatest(left, F.lit(0)))
    return running.join(parts.join(aims, _SOURCE), [*_SOURCE, "range"]).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken")
    )


def copies(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``copy`` (from 1), a row for each time a document
    is taken.  The last copy may end after the words that are left of ``taken``.  Ids are unique."""
    clash = {"copy", "_taken", "_size"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the documents already")
    wanted = mix.where("taken > 0").select(
        F.col("doc_id").alias(id_col), F.col("taken").alias("_taken"), F.col("size").alias("_size")
    )
    each = docs.join(wanted, id_col).withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")))))
    here = (F.col("_taken") - (F.col("copy") - 1) * F.col("_size")).cast("int")
    # cut before each word: every piece then is one word and the blanks behind it
    words = F.split(F.regexp_replace(text_col, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    text = F.when(here >= F.col("_size"), F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, here), ""))
    return each.withColumn(text_col, text).select(*docs.columns, "copy")


def duckdb_sql() -> str:
    """The query over ``documents`` for DuckDB."""
    odd = ODD.replace("'", "''")
    n = len(WEIGHTS)
    return f"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
             len(regexp_extract_all(coalesce(text, ''), '{odd}')) AS odd
      FROM documents),
    k AS (
      SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 13) AS BIGINT) + 0.5)
                    / {_UNIT}.0) * (1.0 + {ODD_COST} * odd / greatest(size, 1)::DOUBLE) AS key
      FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
    w AS (
      SELECT *, [{', '.join(f'{float(x)}::DOUBLE' for x in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1] AS weight
      FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rank FROM w),
    l AS (
      SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - {MOST_EPOCHS} * coalesce(sum(source_size) OVER
               (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r),
    f AS (SELECT rank AS first_rank, level AS first_level FROM l WHERE level * weight <= {MOST_EPOCHS}::DOUBLE * source_size
          ORDER BY rank LIMIT 1),
    t AS (
      SELECT source, source_size,
             CASE WHEN rank < first_rank THEN {MOST_EPOCHS}::DOUBLE * source_size ELSE first_level * weight END AS target
      FROM l, f),
    e AS (
      SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(floor(target / source_size) AS BIGINT), {MOST_EPOCHS}) END AS epochs
      FROM t),
    b AS (
      SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
             CAST(round(e.target - e.epochs * e.source_size) AS BIGINT) - coalesce(sum(k.size) OVER (PARTITION BY k.source
               ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(epochs * size + least(size, greatest(rest, 0)) AS BIGINT) AS taken
    FROM b"""
