"""Main content: which container holds the article?

Every text run gives points to its nearest containers; the container with the
most points wins.  Points go up at most five levels, so a run becomes at most
five narrow rows, and the owner at each level is the last container opened
there: a running window, not a join of runs with containers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageframe import constants as K
from pageframe.operators.tokens import running


def run_points() -> Column:
    """``1 + commas + min(len div 100, 3)`` of a run with text, else 0."""
    return F.when(
        F.col("txt_len") > 0,
        1 + F.col("commas") + F.least(F.floor(F.col("txt_len") / 100), F.lit(3)),
    ).otherwise(0)


def mark_main(runs: DataFrame) -> DataFrame:
    """Add ``in_main``: does the run lie in the winning container?  Null when
    no container of the page holds text."""
    along, owner = running("page_id", order="rb"), Window.partitionBy("page_id", "_owner")
    opens, closes = F.col("container_up") == 1, F.col("container_down") == -1
    deep = runs.withColumns(
        {
            "_depth": F.sum(F.col("container_up") * opens.cast("int") + F.col("container_down")).over(
                along
            ),
            "_seen": F.sum("txt_len").over(along),
        }
    )
    own = F.when(closes, F.col("_depth") + 1).otherwise(F.col("_depth"))
    scored = (F.col("txt_len") > 0) & (F.col("_depth") > 0)
    lowest = F.greatest(own - (len(K.ANCESTOR_WEIGHTS) - 1), F.lit(1))
    levels = F.when(scored, F.sequence(own, lowest, F.lit(-1))).otherwise(
        F.array(F.when(opens | closes, own))
    )
    spread = deep.withColumn("_own", own).select(
        "*", F.posexplode(levels).alias("_up", "_level")
    )
    # only the first copy of a run keeps its wide columns
    wide = [c for c in ("text", "html", "page") if c in runs.columns]
    spread = spread.withColumns({c: F.when(F.col("_up") == 0, F.col(c)) for c in wide})
    owned = spread.withColumn(
        "_owner",
        F.when(
            F.col("_level").isNotNull(),
            F.last(F.when(opens, F.col("rb")), ignorenulls=True).over(running("page_id", "_level", order="rb")),
        ),
    )
    weights = F.array(*[F.lit(w) for w in K.ANCESTOR_WEIGHTS])
    points = F.when(scored, run_points() * F.get(weights, F.col("_up"))).otherwise(0)
    totals = owned.withColumns(
        {
            "_score": F.sum(points).over(owner),
            "_chars": (F.max("_seen").over(owner) - F.min("_seen").over(owner)),
            "_end": F.max(F.when(closes, F.col("rb"))).over(owner),
        }
    )
    tier = (
        F.when(F.col("_chars") >= K.FIRST_PASS_CHARS, 2)
        .when(F.col("_chars") >= K.SECOND_PASS_CHARS, 1)
        .otherwise(0)
    )
    candidate = F.when(
        F.col("_owner").isNotNull() & (F.col("_chars") > 0),
        F.struct(
            tier.alias("tier"),
            F.col("_score").alias("score"),
            F.col("_owner").alias("start"),
            F.col("_end").alias("end"),
        ),
    )
    won = totals.withColumn("_best", F.max(candidate).over(Window.partitionBy("page_id"))).where(F.col("_up") == 0)
    return won.withColumn(
        "in_main",
        F.col("rb").between(F.col("_best.start"), F.col("_best.end")),
    ).withColumn("main_score", F.col("_best.score")).withColumn(
        "main_start", F.col("_best.start")
    ).drop(
        "_depth", "_seen", "_own", "_up", "_level", "_owner", "_score", "_chars", "_end", "_best"
    )


def select_body(marked: DataFrame) -> DataFrame:
    """Runs of the main content, or of the whole page where there is none."""
    return marked.where(F.col("is_page") | F.coalesce("in_main", F.lit(True))).drop(
        "in_main", "main_score", "main_start"
    )


def main_content(runs: DataFrame) -> DataFrame:
    """``(page_id, main_start, main_score, n_runs, n_chars)`` of the winner."""
    inside = mark_main(runs).where(F.col("in_main") & ~F.col("is_page"))
    return inside.groupBy("page_id").agg(
        F.max("main_start").alias("main_start"),
        F.max("main_score").alias("main_score"),
        F.count(F.when(F.col("txt_len") > 0, 1)).alias("n_runs"),
        F.sum("txt_len").alias("n_chars"),
    )
