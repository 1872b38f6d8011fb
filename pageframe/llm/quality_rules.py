"""Quality rules: a threshold table compiled into one projection, without user functions.

``METRICS`` names what is measured in a text, ``RULES`` bounds it.  ``measured`` adds the
metrics, ``verdict`` turns the table into one Boolean column.

Defined results: a null text counts as an empty one, and both have no words and fail
``n_words``.  Repeated rows are judged each on its own.  Columns of the input never clash with
the metrics: they travel in one struct.  An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.llm.common import SPACE, SPACES, words_of

WINDOW = 8

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as at be this have from by not or an which they we can you he "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "le la les et des en un du une que est pour qui dans par plus pas au sur ne se avec ce sont de "
    "el los las por con una su para es del lo como más pero sus al y o se no que si ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``lower <= metric <= upper``; None leaves a side open."""

    metric: str
    lower: float | None = None
    upper: float | None = None


RULES = (
    Rule("mean_word_chars", 1.5, 40.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("stop_word_share", 0.01, None),
    Rule("upper_share", None, 0.6),
    Rule("shouted_share", None, 0.5),
    Rule("dup_line_share", None, 0.5),
    Rule("echo_share", None, 0.3),
    Rule("mean_line_chars", 4.0, None),
)
#: The contract's own bounds: fewest words; most words, in percent, in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30


def _stop_word_set() -> list[str]:
    return sorted({w for s in STOP_WORDS for w in (s, s[:1].upper() + s[1:])})


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (struct of the input's columns) and one per metric."""
    staged = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
    )
    staged = staged.select("row", "_t", words_of(F.col("_t")).alias("_w"))
    staged = staged.select(
        "row",
        "_t",
        "_w",
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    echo = F.zip_with("_h", F.slice("_h", 2, 1 << 30), lambda x, y: x == y)
    staged = staged.select("*", F.size(F.filter(echo, lambda same: same)).alias("_echo"))
    # Hashes of one word, then of 2, 4 and 8 words, each from two of the step before.
    for step in (1, 2, 4):
        staged = staged.select(
            "row", "_t", "_w", "_lines", "_echo",
            F.zip_with("_h", F.slice("_h", step + 1, 1 << 30), lambda x, y: F.xxhash64(x, y)).alias("_h"),
        )
    staged = staged.select(
        "row", "_t", "_w", "_lines", "_echo",
        F.slice("_h", 1, F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))).alias("_win"),
    )
    counted = staged.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_win")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("_echo").cast("long").alias("n_echo"),
        F.size(F.filter("_w", lambda w: w.isin(_stop_word_set()))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_t", "[^!]+", "")).cast("long").alias("n_shouts"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    return counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbols_per_word"),
        ratio("n_stop_words", "n_words").alias("stop_word_share"),
        ratio("n_upper", "n_letters").alias("upper_share"),
        ratio("n_shouts", "n_words").alias("shouted_share"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_share"),
        ratio("n_echo", "n_words").alias("echo_share"),
        ratio("word_chars", "n_lines").alias("mean_line_chars"),
    )


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash is there twice or more.

    Equal hashes are adjacent once sorted; then each repeated window adds the words up to
    the next repeated one, at most a whole window.
    """
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # A one-element array binds a value by name inside the lambda.
    starts = F.flatten(
        F.transform(
            F.array(ordered),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)))
                        | (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
    )
    covered = F.get(
        F.transform(
            F.array(starts),
            lambda s: F.aggregate(
                F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        ),
        F.lit(0),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one condition; a metric that is null fails its rule."""
    passed = F.lit(True)
    for rule in rules:
        if rule.lower is not None:
            passed = passed & (F.col(rule.metric) >= rule.lower)
        if rule.upper is not None:
            passed = passed & (F.col(rule.metric) <= rule.upper)
    return F.coalesce(passed, F.lit(False))


def kept_rows(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the input's columns.

    Written as a generator of one row or none: a filter would be pushed below the metrics,
    with a copy of their expressions for each use.
    """
    good = F.when(~base_failed() & verdict(rules), F.array("row"))
    return measured(df, text).select(F.explode(good).alias("row")).select("row.*")


def duckdb_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB: all metrics with base_failed and kept, per row."""
    space = r"[\x20\x09-\x0D]"
    stop = ", ".join(f"'{w}'" for w in _stop_word_set())
    bounds = " AND ".join(
        f"{r.metric} {op} CAST({v} AS DOUBLE)"
        for r in rules
        for op, v in ((">=", r.lower), ("<=", r.upper))
        if v is not None
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w FROM {table}),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    list_transform(range(1, greatest(len(w) - {WINDOW - 2}, 1)),
        lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS win FROM t),
p AS (SELECT doc_id, unnest(win) AS h, unnest(range(len(win))) AS i FROM l),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM
    (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
    len(list_filter(range(1, greatest(len(w), 1)), lambda i: w[i] = w[i + 1])) AS n_echo,
    length(t) - length(translate(t, '!', '')) AS n_shouts FROM l LEFT JOIN c USING (doc_id)),
r AS (SELECT *, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS mean_word_chars,
    CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) AS symbols_per_word,
    CAST(n_stop_words AS DOUBLE) / greatest(n_words, 1) AS stop_word_share,
    CAST(n_upper AS DOUBLE) / greatest(n_letters, 1) AS upper_share,
    CAST(n_shouts AS DOUBLE) / greatest(n_words, 1) AS shouted_share,
    CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) AS dup_line_share,
    CAST(n_echo AS DOUBLE) / greatest(n_words, 1) AS echo_share,
    CAST(word_chars AS DOUBLE) / greatest(n_lines, 1) AS mean_line_chars,
    n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {bounds} AS kept FROM r"""
