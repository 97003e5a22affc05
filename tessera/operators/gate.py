"""Release gates: thresholds, regressions against the best, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verdicts(cells: DataFrame, name: str, limits: dict[str, tuple[float | None, float | None]], drops: dict[str, float]) -> DataFrame:
    """name, verdict: INCOMPARABLE where a metric is missing, else FAIL where it breaks a limit or falls too far below
    the best of all, else PASS."""
    missing, fails = F.lit(False), F.lit(False)
    whole = Window.partitionBy(F.lit(0))
    out = cells
    for metric, (low, high) in limits.items():
        missing = missing | F.col(metric).isNull()
        if low is not None:
            fails = fails | (F.col(metric) < low)
        if high is not None:
            fails = fails | (F.col(metric) > high)
    for metric, drop in drops.items():
        out = out.withColumn(f"best_{metric}", F.max(metric).over(whole))
        fails = fails | (F.col(metric) < F.col(f"best_{metric}") - drop)
    return out.select(name, F.when(missing, "INCOMPARABLE").when(fails, "FAIL").otherwise("PASS").alias("verdict"))


def rules(
    cells: DataFrame, champion: DataFrame, judged: DataFrame, name: str, same: dict[str, str], explicit: str, most_unjudged: float, least_kappa: float,
    limits: dict[str, tuple[float | None, float | None]], drops: dict[str, float],
) -> DataFrame:
    """name, kind, rule, outcome (PASS, FAIL or SKIP) of each cell against the one row of the champion.

    comparability: the columns of `same` agree, and `explicit` names no moving alias. validity: judged holds one row with
    the share of unjudged labels and the raters' kappa. absolute: limits; a missing value fails. regression: no value
    lies further from the champion's than its drop (a negative drop is for metrics of which less is better); a value
    that the champion lacks is skipped.
    """
    held = champion.select(*[F.col(c).alias(f"best_{c}") for c in {*same.values(), *drops}], F.lit(True).alias("some"))
    rows = cells.join(F.broadcast(held), F.lit(True), "left").join(F.broadcast(judged), F.lit(True), "left")  # one row each
    ok = lambda c: F.when(F.coalesce(c, F.lit(False)), "PASS").otherwise("FAIL")
    found = [("comparability", rule, F.when(F.col("some").isNull(), "SKIP").otherwise(ok(F.col(c).eqNullSafe(F.col(f"best_{c}"))))) for rule, c in same.items()]
    found.append(("comparability", "explicit_identity", ok(~F.col(explicit).contains("latest"))))
    found.append(("validity", "unjudged", F.when(F.col("unjudged").isNull(), "SKIP").otherwise(ok(F.col("unjudged") <= most_unjudged))))
    found.append(("validity", "kappa", F.when(F.col("kappa").isNull(), "SKIP").otherwise(ok(F.col("kappa") >= least_kappa))))
    for metric, (low, high) in limits.items():
        inside = F.col(metric).isNotNull()
        inside = inside & (F.col(metric) >= low) if low is not None else inside
        found.append(("absolute", metric, ok(inside & (F.col(metric) <= high) if high is not None else inside)))
    for metric, drop in drops.items():
        kept = F.col(metric) >= F.col(f"best_{metric}") - drop if drop >= 0 else F.col(metric) <= F.col(f"best_{metric}") - drop
        found.append(("regression", metric, F.when(F.col(metric).isNull(), "FAIL").when(F.col(f"best_{metric}").isNull(), "SKIP").otherwise(ok(kept))))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), outcome.alias("outcome")) for kind, rule, outcome in found])
    return rows.select(name, F.explode(each).alias("r")).select(name, "r.*")


def status(found: DataFrame, name: str) -> DataFrame:
    """name, status, exit_code: INCOMPARABLE (2) before FAIL (1) before PASS (0)."""
    failed = F.col("outcome") == "FAIL"
    sums = found.groupBy(name).agg(F.bool_or(failed & (F.col("kind") == "comparability")).alias("blocked"), F.bool_or(failed).alias("failed"))
    code = F.when(F.col("blocked"), 2).when(F.col("failed"), 1).otherwise(0)
    return sums.select(name, F.when(code == 2, "INCOMPARABLE").when(code == 1, "FAIL").otherwise("PASS").alias("status"), code.alias("exit_code"))


def version_key(version: str) -> tuple:
    """Order of semantic versions: numbers, then a release after its pre-releases, whose parts order by kind."""
    core, _, pre = version.split("+")[0].partition("-")
    numbers = tuple(int(x) for x in core.split("."))
    parts = tuple((0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre.split(".")) if pre else ()
    return (*numbers, not pre, parts)
