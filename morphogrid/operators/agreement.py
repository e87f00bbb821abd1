"""Validation of labels: agreement, confusion, strata, weighted quantiles, breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Class pairs next to each other in compactness and in height.
COMPACTNESS = ((1, 4), (2, 5), (3, 6))
HEIGHT = ((1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6))


def ratio(num: Column, den: Column, decimals: int = 6) -> Column:
    return F.round(F.when(den > 0, num / den), decimals)


def share(part: Column, whole: Column, decimals: int = 6) -> Column:
    """part / whole, 0 where the whole is nothing."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), decimals)


def comparable(least_coverage: float = 0.5) -> Column:
    """A unit with a prediction and a reference of enough coverage; an unknown coverage isn't enough."""
    return F.col("predicted").isNotNull() & F.col("reference").isNotNull() & (F.coalesce("coverage", F.lit(0.0)) >= least_coverage)


def _area(condition: Column) -> Column:
    return F.sum(F.when(F.coalesce(condition, F.lit(False)), F.col("area")).otherwise(0.0))


def summary(frame: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """One row: units left out by reason (each once: no prediction, no reference, low coverage), and shares of the compared area.

    `frame`: predicted, reference, coverage, area. overall, built and natural: agreeing area over all, built (1 to 10) and natural
    references; built_or_natural: area whose two labels are of one family; natural_share: area of natural references. Shares of nothing
    are 0.
    """
    ok = comparable(least_coverage)
    n = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0))
    same, built, predicted_built = F.col("predicted") == F.col("reference"), F.col("reference") <= 10, F.col("predicted") <= 10
    predicted, known = F.col("predicted").isNotNull(), F.col("reference").isNotNull()
    return frame.agg(
        F.count("*").alias("n_units"), n(~predicted).alias("no_prediction"), n(predicted & ~known).alias("no_reference"), n(predicted & known & ~ok).alias("low_coverage"),
        n(ok).alias("n_compared"), n(ok & ~same).alias("n_disagree"), _area(ok).alias("area_compared"), share(_area(ok & same), _area(ok)).alias("overall"),
        share(_area(ok & built & same), _area(ok & built)).alias("built"), share(_area(ok & ~built & same), _area(ok & ~built)).alias("natural"),
        share(_area(ok & (built == predicted_built)), _area(ok)).alias("built_or_natural"), share(_area(ok & ~built), _area(ok)).alias("natural_share"),
    )


def confusion(frame: DataFrame) -> DataFrame:
    """Units and area of each pair of labels that occurs among the compared units."""
    return frame.where(comparable()).groupBy("reference", "predicted").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def per_class(frame: DataFrame) -> DataFrame:
    """Producer's and user's accuracy and F1 by area, over the union of both label sets."""
    pair = confusion(frame)
    hit = F.col("reference") == F.col("predicted")
    ref = pair.groupBy(F.col("reference").alias("code")).agg(F.sum("n").alias("n_reference"), F.sum("area").alias("area_reference"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_agree"), F.sum(F.when(hit, F.col("area")).otherwise(0.0)).alias("area_agree"))
    pred = pair.groupBy(F.col("predicted").alias("code")).agg(F.sum("n").alias("n_predicted"), F.sum("area").alias("area_predicted"))
    both = ref.join(pred, "code", "full").na.fill(0)
    user, producer = (F.when(F.col(c) > 0, F.col("area_agree") / F.col(c)).otherwise(0.0) for c in ("area_predicted", "area_reference"))
    return both.select("*", F.round(producer, 6).alias("producer"), F.round(user, 6).alias("user"), F.round(F.when(user + producer > 0, 2 * user * producer / (user + producer)).otherwise(0.0), 6).alias("f1"))


def weighted_agreement(frame: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean similarity of the two labels of the compared units; `weights`: (reference, predicted, w), one row for each pair of classes."""
    return confusion(frame).join(F.broadcast(weights), ["reference", "predicted"]).agg(share(F.sum(F.col("n") * F.col("w")), F.sum("n")).alias("weighted_agreement"))


def axis_pairs(frame: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Of each class pair: confusions either way, and their share of all disagreeing units and of their area."""
    wrong = confusion(frame).where("reference <> predicted")
    axis = frame.sparkSession.createDataFrame([*pairs], "a int, b int")
    forward = (F.col("reference") == F.col("a")) & (F.col("predicted") == F.col("b"))
    cells = F.broadcast(axis).join(wrong, F.least("reference", "predicted").eqNullSafe(F.col("a")) & F.greatest("reference", "predicted").eqNullSafe(F.col("b")), "left")
    total = wrong.agg(F.sum("n").alias("all_n"), F.sum("area").alias("all_area"))
    of = cells.groupBy("a", "b").agg(F.sum(F.when(forward, F.col("n")).otherwise(0)).alias("n_forward"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
    out = of.crossJoin(F.broadcast(total))  # one row
    return out.select("a", "b", "n_forward", (F.col("n_total") - F.col("n_forward")).alias("n_backward"), "n_total", share(F.col("n_total"), F.col("all_n")).alias("share_of_disagreement"), share(F.col("area"), F.col("all_area")).alias("share_of_disagreement_area"))


def axis_lift(frame: DataFrame) -> DataFrame:
    """Each axis pooled over its pairs: its share of the disagreeing units, what chance gives, and the ratio of both (lift).

    Chance keeps each disagreeing unit's reference r and the run's distribution q of wrong labels, but breaks the link between them: the
    expected share is the sum over r of (n_r / N) * (sum of q over r's partners) / (1 - q_r). Eligible are disagreeing units whose
    reference stands on any axis.
    """
    spark = frame.sparkSession
    partners = [(name, x, y) for name, axis in (("compactness", COMPACTNESS), ("height", HEIGHT)) for a, b in axis for x, y in ((a, b), (b, a))]
    axes = F.broadcast(spark.createDataFrame(partners, "axis string, reference int, predicted int"))
    eligible = sorted({x for _, x, _ in partners})
    wrong = confusion(frame).where("reference <> predicted")
    totals = wrong.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("all_area"), F.coalesce(F.sum(F.when(F.col("reference").isin(eligible), F.col("n"))), F.lit(0)).alias("n_axis_eligible"))
    observed = axes.join(wrong, ["reference", "predicted"], "left").groupBy("axis").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
    q = wrong.groupBy("predicted").agg(F.sum("n").alias("q"))
    n_r = wrong.groupBy("reference").agg(F.sum("n").alias("n_r"))
    own = q.select(F.col("predicted").alias("reference"), F.col("q").alias("own"))
    reach = axes.join(q, "predicted").groupBy("axis", "reference").agg(F.sum("q").alias("reach")).join(n_r, "reference").join(own, "reference", "left")
    chance = reach.crossJoin(F.broadcast(totals.select("all_n"))).where("coalesce(own, 0) < all_n").groupBy("axis").agg(F.sum(F.col("n_r") / F.col("all_n") * F.col("reach") / (F.col("all_n") - F.coalesce("own", F.lit(0)))).alias("expected"))
    out = observed.join(chance, "axis", "left").crossJoin(F.broadcast(totals)).withColumn("expected", F.coalesce("expected", F.lit(0.0)))
    seen = F.when(F.col("all_n") > 0, F.col("n_total") / F.col("all_n")).otherwise(0.0)
    return out.select(
        "axis", "n_total", F.round(seen, 6).alias("share_of_disagreement"), share(F.col("area"), F.col("all_area")).alias("share_of_disagreement_area"), "n_axis_eligible",
        share(F.col("n_total"), F.col("n_axis_eligible")).alias("share_of_axis_eligible"), F.round("expected", 6).alias("expected_share"), share(seen, F.col("expected")).alias("lift"),
    )


def strata(frame: DataFrame, value: str = "completeness", bands: int = 10) -> DataFrame:
    """Area agreement of the compared units in equal bands of `value` over 0 to 1, the last closed, empty bands kept with 0."""
    known = frame.where(comparable() & F.col(value).between(0, 1))
    each = known.groupBy(F.least(F.floor(F.col(value) * bands), F.lit(bands - 1)).cast("int").alias("band")).agg(F.count("*").alias("n"), F.sum("area").alias("area"), _area(F.col("predicted") == F.col("reference")).alias("same"))
    every = frame.sparkSession.range(bands).select(F.col("id").cast("int").alias("band"))
    return every.join(F.broadcast(each), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("area", F.lit(0.0)).alias("area"), share(F.col("same"), F.col("area")).alias("agreement"))


def above_baseline(frame: DataFrame, group: str) -> DataFrame:
    """Of each group: the area share of the largest reference class, the area agreement, and what it has above that baseline."""
    each = frame.where(comparable()).groupBy(group, "reference").agg(F.sum("area").alias("area"), _area(F.col("predicted") == F.col("reference")).alias("same"))
    base, agree = F.max("area") / F.sum("area"), F.sum("same") / F.sum("area")
    return each.groupBy(group).agg(F.round(base, 6).alias("baseline"), F.round(agree, 6).alias("agreement"), F.round(agree - base, 6).alias("above"))


def weighted_quantiles(frame: DataFrame, group: str, value: str, weight: str, order: str, quantiles: Sequence[float]) -> DataFrame:
    """Per group the first value whose running weight reaches q of the total: no interpolation; unknown values are left out.

    Groups are first summed by value, so that a large group with few values sorts few rows.
    """
    known = frame.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(group, value).agg(F.sum(weight).alias("w"))
    ordered = Window.partitionBy(group).orderBy(value)
    run = known.withColumn("run", F.sum("w").over(ordered)).withColumn("total", F.sum("w").over(Window.partitionBy(group)))
    return run.groupBy(group).agg(*[F.min(F.when(F.col("run") >= F.lit(q) * F.col("total"), F.col(value))).alias(f"q{int(q * 100)}") for q in quantiles])


def breaks(frame: DataFrame, column: str, k: int) -> DataFrame:
    """k + 1 linearly interpolated quantiles, equal ones once."""
    steps = F.array(*[F.lit(i / k) for i in range(k + 1)])
    return frame.agg(F.array_distinct(F.transform(F.percentile(column, steps), lambda x: F.round(x, 6))).alias("b")).select(F.posexplode("b").alias("place", "value"))


def significant(column: Column, digits: int = 3) -> Column:
    """Rounded half to even at so many significant digits; 0 stays."""
    factor = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(column))))
    return F.when(column == 0, column).otherwise(F.rint(column * factor) / factor)


def spearman_within(frame: DataFrame, group: str, x: str, y: str, least: int = 3) -> DataFrame:
    """Rank correlation in each group of `least` rows and more, ties at their mean rank; constant groups are left out."""
    known = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def mean_rank(c: str) -> Column:
        w = Window.partitionBy(group).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(group, c)) - 1) / 2.0

    ranked = known.select(group, mean_rank(x).alias("rx"), mean_rank(y).alias("ry"))
    out = ranked.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return out.where((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0)).select(group, "n", F.round(F.col("c") / (F.col("sx") * F.col("sy")), 6).alias("rho"))
