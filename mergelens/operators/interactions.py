"""Interactions of others with a pull request: reviews, comments, timeline events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.functions import fixed
from mergelens.functions.parsing import linked
from mergelens.operators.tables import PR_KEY, Tables


def interactions(tables: Tables, prs: DataFrame, cutoff: str | None = "merged_at", carry: tuple[str, ...] = ()) -> DataFrame:
    """Interactions with the given pull requests: key, actor, kind, at, carried columns.

    Bots and the author are left out, and with a ``cutoff`` column everything at
    or after it; a null cutoff does not limit. Timeline events count once per
    actor and time, but are not compared with reviews or comments.
    ``prs`` may hold one pull request several times, for several subjects.
    """
    people = F.col("user_type") != fixed.BOT
    reviews = tables.reviews.filter(people).select(
        *PR_KEY, F.col("user_login").alias("actor"), F.lit("review").alias("kind"), F.col("submitted_at").alias("at")
    )
    comments = tables.comments.filter(people & linked(F.col("number"))).select(
        *PR_KEY,
        F.col("user_login").alias("actor"),
        F.when(F.col("type") == "review", "comment_review").otherwise("comment_issue").alias("kind"),
        F.col("created_at").alias("at"),
    )
    events = (
        tables.timeline.filter(F.col("event").isin(*fixed.INTERACTION_EVENTS))
        .filter(F.col("actor_type") != fixed.BOT)
        .select(*PR_KEY, F.col("actor_login").alias("actor"), F.lit("timeline").alias("kind"), F.col("created_at").alias("at"))
    )
    limit = F.col(cutoff) if cutoff else F.lit(None).cast("timestamp")
    sides = prs.select(*PR_KEY, F.col("user_login").alias("_author"), limit.alias("_cutoff"), *carry)
    counted = (F.col("actor") != F.col("_author")) & (F.col("_cutoff").isNull() | (F.col("at") < F.col("_cutoff")))

    def on_prs(rows: DataFrame) -> DataFrame:
        return rows.join(sides, PR_KEY).filter(counted).drop("_author", "_cutoff")

    # Only events of the wanted pull requests are compared with each other.
    return on_prs(reviews.unionByName(comments)).unionByName(on_prs(events).distinct())


def kind_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number of interactions per group and per kind, as four columns and a total."""
    kinds = [F.count_if(F.col("kind") == kind).alias(kind) for kind in fixed.INTERACTION_KINDS]
    return rows.groupBy(*keys).agg(F.count("*").alias("back_and_forth"), *kinds)


def breakdown():
    """Map from kind to count, of the kinds that occur."""
    pairs = F.array(*[F.struct(F.lit(kind), F.coalesce(F.col(kind), F.lit(0))) for kind in fixed.INTERACTION_KINDS])
    return F.map_from_entries(F.filter(pairs, lambda pair: pair["col2"] > 0))
