"""Exclusive choice: each of one side takes one of the other, in turn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.sources.folders import cut_lineage

#: Pairs that a task sorts, on average.
PAIRS_A_TASK = 500_000


def exclusive_choices(pairs: DataFrame, chooser: Sequence[str], chosen: Sequence[str], turn: Sequence[Column], preference: Sequence[Column]) -> DataFrame:
    """(chooser, chosen): what choosers get who, one by one in the order of `turn`, take what they like best of what is left.

    pairs has a row for each thing that a chooser may take; those without a row are out of the question.  As all things go to
    whoever is first in turn, this is the one stable matching, and offers in rounds find it: every chooser asks for the best
    that is not lost to it, a thing is held for the first in turn that asks, and is lost to all who come later.  A round is two grouped minima and
    a join, so no group has to fit in a task; a chain of n choosers who all want the same things takes up to n rounds, others few.

    Ties of preference go to the lesser `chosen`, ties of turn to the lesser `chooser`.  Repeated pairs are one.
    """
    one, other = F.struct(*chooser), F.struct(*chosen)
    left = pairs.select(one.alias("one"), other.alias("other"), F.struct(*turn, *chooser).alias("turn"), F.struct(*preference, *chosen).alias("liking"))
    # there are more partitions where there are more pairs, so what a task sorts does not grow
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(left: DataFrame, size: int) -> DataFrame:
        return left.repartition(max(width, -(-size // PAIRS_A_TASK)), "other")

    left = cut_lineage(left)
    left = cut_lineage(dealt(left, left.count()).groupBy("one", "other").agg(F.min("turn").alias("turn"), F.min("liking").alias("liking")))
    size = left.count()
    while True:
        asked = left.groupBy("one").agg(F.min(F.struct("liking", "other", "turn")).alias("best")).select("one", "best.other", "best.turn")
        held = asked.groupBy("other").agg(F.min("turn").alias("first"))
        kept = cut_lineage(dealt(left, size).join(held, "other", "left").filter("first IS NULL OR turn <= first").drop("first"))
        before, size = size, kept.count()
        if size == before:
            return asked.select("one.*", "other.*")
        left = kept
