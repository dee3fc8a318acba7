"""ROC-AUC as a tie-corrected rank sum: exact, for any number of models, folds and classes in one job.

The area equals the share of (positive, negative) pairs that the score puts in order, a tie counting half.  Rows are counted by
score first; what each score needs is the number of negatives below it, a running total in the order of the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.operators.sequence import totals_before


def rank_sum_auc(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", positive: str = "positive", blocks: int | None = None
) -> DataFrame:
    """(by..., rows, positives, auc): the area is NULL where only one of the two classes occurs.

    ``positive`` is a boolean, NULL counts as negative; a NULL score lies below all others, NaN above.
    """
    groups = [col(b) for b in by]
    yes = F.coalesce(col(positive), F.lit(False))
    cells = scored.groupBy(*groups, col(score).cast("double").alias("_score")).agg(
        F.count_if(yes).alias("_yes"), F.count_if(~yes).alias("_no")
    )
    ranked = totals_before(cells, "_score", ["_no"], by, blocks)
    pairs = F.sum(F.col("_yes").cast("double") * (F.col("_no_before") + F.col("_no") / 2))
    ordered = ranked.groupBy(*groups).agg(pairs.alias("_won"), F.sum("_yes").alias("positives"), F.sum("_no").alias("_negatives"))
    area = F.try_divide(F.col("_won"), F.col("positives").cast("double") * F.col("_negatives"))
    return ordered.select(*groups, (F.col("positives") + F.col("_negatives")).alias("rows"), "positives", area.alias("auc"))


def class_auc(
    scored: DataFrame, classes: Sequence[float], by: Sequence[str] = (), label: str = "label", scores: str = "scores", blocks: int | None = None
) -> DataFrame:
    """(by..., roc_auc): the area of the second of two classes, or every class against the rest, weighted by class shares.

    ``scores`` is an array with the score of class c at place c.  A class that no row or every row of a group has adds nothing.
    """

    def cell(c: float) -> Column:
        return F.struct(
            F.lit(float(c)).alias("class"), F.get(col(scores), F.lit(int(c))).alias("score"), (col(label) == c).alias("positive")
        )

    wanted = classes[1:] if len(classes) == 2 else classes
    each = scored.select(*[col(b) for b in by], F.explode(F.array(*[cell(c) for c in wanted])).alias("cell"))
    areas = rank_sum_auc(each.select(*[col(b) for b in by], "cell.*"), [*by, "class"], blocks=blocks)
    weight = F.lit(1.0) if len(wanted) == 1 else F.col("positives") / F.col("rows")
    return areas.groupBy(*[col(b) for b in by]).agg(F.sum(F.coalesce(F.col("auc") * weight, F.lit(0.0))).alias("roc_auc"))
