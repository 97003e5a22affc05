"""One ranking from scores on unlike scales (problem 7): closeness to an ideal point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ideal_point_ranking(df: DataFrame, group: list[str], key: str, scores: list[str], weights: list[float] | None = None, trim: float = 0.03) -> DataFrame:
    """Group columns, key, closeness (0 to 1, or null), place (from 1).

    Within each group every score is winsorised by a share `trim` of its values at either end, by one value at least
    (the highest takes the value of the second highest, the lowest that of the second lowest, from four values on),
    measured from the level of a missing score, divided by its Euclidean norm and weighted. Closeness is the distance from the anti-ideal point as a share of the
    distances from both points. A null or NaN score lies one spread below the lowest value. Equal closeness is ordered
    by the sum of the places on the single scores, then by key. A row without any score has a null closeness and ranks
    last. A group of one row, or of rows that are all alike, has closeness 1. Repeated keys count once with their
    highest scores; rows with a null key or a null group column are left out. Other columns are ignored.
    """
    if not 0 <= trim < 0.5:
        raise ValueError("trim must be from 0 to below 0.5")
    weights = weights or [1.0 / len(scores)] * len(scores)
    ids = [f"g{i}" for i in range(len(group))]
    clean = [F.when(~F.isnan(df[f"`{s}`"].cast("double")), df[f"`{s}`"].cast("double")).alias(f"s{i}") for i, s in enumerate(scores)]
    rows = df.select(*[df[f"`{g}`"].alias(i) for g, i in zip(group, ids, strict=True)], df[f"`{key}`"].alias("k"), *clean)
    rows = rows.where(" and ".join(f"{c} is not null" for c in [*ids, "k"]))
    # Repeats fall in the partial aggregate, so a row delivered very often never fills one task.
    rows = rows.groupBy(*ids, "k").agg(*[F.max(f"s{i}").alias(f"s{i}") for i in range(len(scores))])
    whole = Window.partitionBy(*ids)
    for i in range(len(scores)):
        rows = rows.withColumn(f"p{i}", F.row_number().over(whole.orderBy(F.col(f"s{i}").desc_nulls_last(), "k")))
        rows = rows.withColumn(f"n{i}", F.count(f"s{i}").over(whole))

    def at(i: int, place: Column) -> Column:
        return F.max(F.when(F.col(f"p{i}") == place, F.col(f"s{i}"))).over(whole)

    cut = {i: F.greatest(F.lit(1), F.floor(F.col(f"n{i}") * trim).cast("int")) for i in range(len(scores))}
    rows = rows.withColumns({f"hi{i}": at(i, F.least(cut[i] + 1, F.col(f"n{i}"))) for i in range(len(scores))} | {
        f"lo{i}": at(i, F.when(F.col(f"n{i}") > 3, F.col(f"n{i}") - cut[i]).otherwise(F.col(f"n{i}"))) for i in range(len(scores))
    })
    values = {}
    for i in range(len(scores)):
        s, lo, hi = F.col(f"s{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        lo = F.least(lo, hi)
        span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        values[f"v{i}"] = F.when(s.isNull(), 0.0).otherwise(F.least(F.greatest(s, lo), hi) - lo + span)
    rows = rows.withColumns(values)
    rows = rows.withColumns({f"e{i}": F.sqrt(F.sum(F.col(f"v{i}") * F.col(f"v{i}")).over(whole)) for i in range(len(scores))})
    rows = rows.withColumns({
        f"r{i}": F.when(F.col(f"e{i}") > 0, F.col(f"v{i}") / F.col(f"e{i}")).otherwise(0.0) * w for i, w in enumerate(weights)
    })
    far = sum(((F.max(f"r{i}").over(whole) - F.col(f"r{i}")) ** 2 for i in range(len(scores))), F.lit(0.0))
    near = sum(((F.col(f"r{i}") - F.min(f"r{i}").over(whole)) ** 2 for i in range(len(scores))), F.lit(0.0))
    rows = rows.withColumn("far", F.sqrt(far)).withColumn("near", F.sqrt(near))
    scored = F.coalesce(*[F.col(f"s{i}") for i in range(len(scores))]).isNotNull()
    share = F.when(F.col("far") == 0, 1.0).otherwise(F.col("near") / (F.col("far") + F.col("near")))
    rows = rows.withColumn("closeness", F.when(scored, share))
    places = sum((F.when(F.col(f"s{i}").isNull(), F.col(f"n{i}") + 1).otherwise(F.col(f"p{i}")) for i in range(len(scores))), F.lit(0))
    order = whole.orderBy(F.col("closeness").desc_nulls_last(), places, "k")
    return rows.withColumn("place", F.row_number().over(order)).select(
        *[F.col(i).alias(g) for g, i in zip(group, ids, strict=True)], F.col("k").alias(key), "closeness", "place"
    )
