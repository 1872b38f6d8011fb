"""A persisted inverted index and the best documents per query, without scoring them all.

A document's score for a query is the number of times that it has the query's words.  The
index has three tables: ``terms`` (documents and largest count of a word), ``blocks`` (postings of a
word with counts of one level, a bounded number each) and ``forward`` (a row per document
with its words and counts).

The search takes the documents of each word's highest levels, scores them exactly and so has
a score that the tenth best of the query reaches at least.  A document reaches that score only if
it has some word of the query at least as often as the word's share of it (shares by largest
count); levels under their share are skipped, whatever their number of documents.  What is left
is scored exactly.  So a word that all documents and many queries have costs the documents
that have it very often, not their product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe.functions.urls import bind, let
from pageframe.sources import shared

BLOCK_POSTINGS = 512
#: Counts up to this are a level each; above, four levels to each doubling.
EXACT_LEVELS = 16


def terms_of(text: Column) -> Column:
    """Lower-cased words: runs of letters or digits, of any length."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def term_counts(text: Column) -> Column:
    """``array<struct<term, n>>`` of a text, in one row: sorted words, cut where they change."""
    starts = "filter(sequence(0, greatest(size(v) - 1, 0)), i -> i < size(v) AND (i = 0 OR get(v, i) <> get(v, i - 1)))"
    runs = (
        "transform(st, (a, j) -> named_struct('term', get(v, a), 'n', "
        "CAST(coalesce(get(st, j + 1), size(v)) - a AS BIGINT)))"
    )
    return let(F.array_sort(F.coalesce(terms_of(text), F.array().cast("array<string>"))), bind(starts, "st", runs))


def level_of(n: Column) -> Column:
    above = EXACT_LEVELS + F.floor(4 * F.log2(n / EXACT_LEVELS))
    return F.when(n <= EXACT_LEVELS, n).otherwise(above).cast("int")


@dataclass(frozen=True)
class CorpusIndex:
    """The tables of an index on shared storage."""

    terms: DataFrame
    levels: DataFrame
    blocks: DataFrame
    forward: DataFrame


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_index(docs: DataFrame, path: str | None = None, block_postings: int = BLOCK_POSTINGS) -> CorpusIndex:
    """Index ``docs`` (doc_id, text; ids unique) under ``path``.  Texts are read once; a document's
    counts need no shuffle; a word of all documents is dealt over as many blocks as it needs."""
    path = path or shared.fresh_path(docs.sparkSession, "index")
    counted = docs.select("doc_id", term_counts(F.col("text")).alias("counts"))
    forward = _table(counted, f"{path}/forward")
    postings = forward.select("doc_id", F.explode("counts").alias("c")).select("doc_id", "c.term", "c.n")
    postings = postings.withColumn("level", level_of(F.col("n")))
    levels = postings.groupBy("term", "level").agg(F.count("*").alias("size"), F.max("n").alias("most"))
    levels = _table(levels, f"{path}/levels")
    terms = levels.groupBy("term").agg(F.sum("size").alias("documents"), F.max("most").alias("most"))
    # one in BLOCK_POSTINGS of all postings at most is a row here
    large = levels.where(F.col("size") > block_postings).select(
        "term", "level", F.ceil(F.col("size") / block_postings).alias("slices")
    )
    dealt = postings.join(large, ["term", "level"], "left").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), F.coalesce("slices", F.lit(1)))
    )
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by range before they are grouped, so that happens once and in place; sorted, so a reader's
    # terms select row groups
    dealt = dealt.select("doc_id", "n", "term", "level", "slice").repartitionByRange(width, "term", "level", "slice")
    blocks = dealt.groupBy("term", "level", "slice").agg(F.collect_list(F.struct("doc_id", "n")).alias("postings"))
    blocks = blocks.sortWithinPartitions("term", "level")
    return CorpusIndex(_table(terms, f"{path}/terms"), levels, _table(blocks, f"{path}/blocks"), forward)


def open_index(spark, path: str) -> CorpusIndex:
    return CorpusIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("terms", "levels", "blocks", "forward")))


def _scored(index: CorpusIndex, wanted: DataFrame, words: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of the wanted documents and every query that asks for a word of theirs;
    ``words`` has (query_id, term).  A document's counts meet the words by equality, so a row is a hit, and
    no document is searched for the words of each query."""
    docs = shared.only_keys(index.forward, wanted.select("doc_id"), "doc_id")
    docs = docs.withColumn("row", F.monotonically_increasing_id())  # an id that repeats is scored row by row
    counts = docs.select("doc_id", "row", F.explode("counts").alias("c")).select("doc_id", "row", "c.term", "c.n")
    hits = counts.join(words.where("query_id IS NOT NULL").select("query_id", "term"), "term")
    return hits.groupBy("query_id", "doc_id", "row").agg(F.sum("n").alias("score")).drop("row")


def candidates(index: CorpusIndex, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(written pairs (query_id, doc_id) that may be among the best ``k``, (query_id, term, ..) of the words)."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms_of(F.col("query")))).alias("term"))
    words = shared.cut_lineage(words.distinct().join(index.terms, "term"))
    # the highest levels of a word that hold k documents together: at most a row per level of a word
    wanted_levels = index.levels.join(words.select("term").distinct(), "term", "left_semi")
    higher = Window.partitionBy("term").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = wanted_levels.withColumn("before", F.coalesce(F.sum("size").over(higher), F.lit(0)))
    top = levels.where(F.col("before") < k).select("term", "level")
    first = index.blocks.join(top, ["term", "level"], "left_semi").select("term", F.explode("postings").alias("p"))
    # k documents of a word are enough to start from
    best = Window.partitionBy("term").orderBy(F.col("p.n").desc(), F.col("p.doc_id"))
    first = first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    seeds = shared.cut_lineage(words.join(first, "term").select("query_id", F.col("p.doc_id").alias("doc_id")).distinct())
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    reached = _scored(index, seeds, words).withColumn("place", F.row_number().over(order))
    floor = reached.where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    shares = words.withColumn("share", F.col("most") / F.sum("most").over(Window.partitionBy("query_id")))
    bounds = shares.join(floor, "query_id", "left").select(
        "query_id", "term", (F.coalesce("floor", F.lit(0)) * F.col("share") * (1 - 1e-9)).alias("least")
    )
    open_levels = bounds.join(wanted_levels.select("term", "level", "most"), "term").where(F.col("most") >= F.col("least"))
    found = index.blocks.join(open_levels, ["term", "level"]).select("query_id", "least", F.explode("postings").alias("p"))
    pairs = found.where(F.col("p.n") >= F.col("least")).select("query_id", F.col("p.doc_id").alias("doc_id"))
    return shared.cut_lineage(pairs.distinct()), words


def search(index: CorpusIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best documents per query (ties by id)."""
    pairs, words = candidates(index, queries, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    ranked = _scored(index, pairs, words).withColumn("_rank", F.row_number().over(best))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
