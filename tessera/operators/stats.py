"""Agreement between raters and comparison of paired runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answers import resamples

#: Cumulative chances of 0, 1, .. events at rate one.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
#: Numbers that are drawn at once, and groups whose sums a task holds.
DRAWN, GROUPS_HELD = 400_000, 200


def confusion(pairs: DataFrame, labels: list[str], a: str, b: str, weight: str) -> DataFrame:
    """a, b, weight summed over every cell of the closed label set; an unknown label is an error."""
    unknown = ~F.col(a).isin(*labels) | ~F.col(b).isin(*labels)
    checked = pairs.withColumn(a, F.when(unknown, F.raise_error(F.lit("unknown label"))).otherwise(F.col(a)))
    sums = checked.groupBy(a, b).agg(F.sum(weight).alias("weight"))
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], f"{a} string, {b} string")
    return grid.join(sums, [a, b], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def agreement(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """observed, expected, kappa (null where chance agrees fully), pabak from confusion cells."""
    total = Window.partitionBy(F.lit(0))
    rows = cells.groupBy(F.col(a).alias("l")).agg(F.sum("weight").alias("r"))
    columns = cells.groupBy(F.col(b).alias("l")).agg(F.sum("weight").alias("c"))
    same = cells.groupBy(F.col(a).alias("l")).agg(F.sum(F.when(F.col(a) == F.col(b), F.col("weight")).otherwise(0.0)).alias("s"))
    each = rows.join(columns, "l").join(same, "l").withColumn("t", F.sum("r").over(total))
    out = each.agg((F.sum("s") / F.max("t")).alias("o"), (F.sum(F.col("r") * F.col("c")) / F.max(F.col("t") * F.col("t"))).alias("e"))
    kappa = F.when(1 - F.col("e") >= 1e-12, (F.col("o") - F.col("e")) / (1 - F.col("e")))
    return out.select(F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(kappa, 6).alias("kappa"), F.round(2 * F.col("o") - 1, 6).alias("pabak"))


def label_scores(cells: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """label, precision, recall, f1 of rater b against a; null where undefined, f1 0 where either is 0."""
    right = F.sum(F.when(F.col(a) == F.col(b), F.col("weight")).otherwise(0.0)).alias("hit")
    rows = cells.groupBy(F.col(a).alias("label")).agg(F.sum("weight").alias("r"), right)
    columns = cells.groupBy(F.col(b).alias("label")).agg(F.sum("weight").alias("c"))
    each = rows.join(columns, "label")
    p, r = F.col("hit") / F.nullif(F.col("c"), F.lit(0.0)), F.col("hit") / F.nullif(F.col("r"), F.lit(0.0))
    f1 = F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))
    return each.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _log_choose(n: Column, k: Column) -> Column:
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))


def mcnemar(better: Column, worse: Column) -> Column:
    """Exact two-sided p of unequal discordant counts; 1 where there are none. Linear in their number: each chance
    follows from the one before it."""
    n, top = better + worse, F.greatest(better, worse)
    first = F.exp(_log_choose(n, n - top) - n * F.log(F.lit(2.0)))
    further = F.when(top < n, F.sequence((top + 1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(
        further, F.struct(first.alias("t"), first.alias("s")),
        lambda acc, x: F.struct((acc["t"] * (n - x + 1) / x).alias("t"), (acc["s"] + acc["t"] * (n - x + 1) / x).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def least_p(n: Column) -> Column:
    """The smallest p that n discordant pairs can give."""
    return F.least(F.lit(1.0), F.lit(2.0) / F.pow(F.lit(2.0), n))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., metric, a, b, diff of the queries and metrics that both have (keys.., metric, value)."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), [*keys, "metric"]).withColumn("diff", F.col("b") - F.col("a"))


def compared(pairs: DataFrame) -> DataFrame:
    """metric, n, mean_a, mean_b, diff, better, worse, p (exact sign test), least_p, step (the smallest move of a mean)."""
    sums = pairs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("diff").alias("d"),
        F.sum((F.col("diff") > 1e-9).cast("bigint")).alias("better"), F.sum((F.col("diff") < -1e-9).cast("bigint")).alias("worse"),
        F.min(F.when(F.abs("diff") > 1e-9, F.abs("diff"))).alias("least"),
    )
    return sums.select(
        "metric", "n", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round("d", 6).alias("diff"), "better", "worse",
        F.round(mcnemar(F.col("better"), F.col("worse")), 6).alias("p"), F.round(least_p(F.col("better") + F.col("worse")), 6).alias("least_p"),
        F.round(F.col("least") / F.col("n"), 9).alias("step"),
    )


def bootstrap(pairs: DataFrame, key: Column, draws: int = 200, level: float = 0.95) -> DataFrame:
    """metric, low, high of the mean difference over resamples with Poisson weights.

    A row's weight in each resample comes from a hash of its key, so resamples are sums that combine before the
    shuffle, any engine draws the same, and no task holds a whole run.
    """
    spread = pairs.select("metric", "diff", F.md5(key.cast("string")).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = F.conv(F.substring(F.md5(F.concat("h", F.lit("/"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    weight = sum(((u >= p).cast("int") for p in POISSON), F.lit(0))
    means = spread.withColumn("w", weight).groupBy("metric", "draw").agg((F.sum(F.col("w") * F.col("diff")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    placed = means.where("m is not null").withColumn("i", F.row_number().over(Window.partitionBy("metric").orderBy("m")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("metric")))
    low, high = F.floor(F.col("n") * tail), F.least(F.col("n") - 1, F.floor(F.col("n") * (1 - tail)))
    return placed.groupBy("metric").agg(F.round(F.max(F.when(F.col("i") == low, F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == high, F.col("m"))), 6).alias("high"))


def poisson_weights(seeds: np.ndarray, draws: int) -> np.ndarray:
    """Weights at rate one, a row a seed and a column a draw, the same wherever they are drawn (splitmix64)."""
    with np.errstate(over="ignore"):
        z = seeds.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    out = np.zeros(z.shape, np.uint8)
    for p in POISSON:
        out += z >= np.uint64(int(p * 2**64))
    return out


def resample_sums(df: DataFrame, group: str, value: str, key: Column, draws: int) -> DataFrame:
    """group, draw, k, kv: the rows' Poisson weights, and weights times values, summed for each resample.

    A row's weights come from a hash of its key. Each task sums its own rows, so the shuffle carries one row a task,
    group and draw, whatever the number of rows. A missing value counts as 0.
    """
    rows = df.select(F.col(group).alias("g"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), F.xxhash64(key.cast("string")).alias("h"))
    kind = rows.schema["g"].dataType.simpleString()
    strip = max(1, DRAWN // draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None

        def flushed() -> Iterator[pa.RecordBatch]:
            for g, (k, kv) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * draws, kind), pa.array(np.arange(draws, dtype=np.int32)), pa.array(k), pa.array(kv)], names=["g", "draw", "k", "kv"])
            held.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            v, h = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            places: dict = {}
            for i, g in enumerate(names):
                places.setdefault(g, []).append(i)
            for g, own in places.items():
                if g not in held and len(held) >= GROUPS_HELD:
                    yield from flushed()
                k, kv = held.setdefault(g, (np.zeros(draws), np.zeros(draws)))
                for at in range(0, len(own), strip):
                    some = own[at : at + strip]
                    w = poisson_weights(h[some], draws)
                    k += w.sum(axis=0, dtype=np.float64)
                    kv += v[some] @ w.astype(np.float64)
        yield from flushed()

    parts = rows.mapInArrow(run, f"g {kind}, draw int, k double, kv double")
    return parts.groupBy(F.col("g").alias(group), "draw").agg(F.sum("k").alias("k"), F.sum("kv").alias("kv"))


def bounds(means: DataFrame, groups: list[str], tail: float, shift: int = 0) -> DataFrame:
    """groups.., low, high of the draws' statistic m (a row a draw), each a shift below its place."""
    own = Window.partitionBy(*groups or [F.lit(0)])
    placed = means.where("m is not null").withColumn("i", F.row_number().over(own.orderBy("m")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    low = F.greatest(F.lit(0), F.floor(F.col("n") * tail + 1e-9) - shift)
    high = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * (1 - tail) + 1e-9) - shift))
    return placed.groupBy(*groups).agg(F.round(F.max(F.when(F.col("i") == low, F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("i") == high, F.col("m"))), 6).alias("high"))


def intervals(pairs: DataFrame, key: Column, draws: int | None = None, level: float = 0.95) -> DataFrame:
    """metric, low, high of the mean difference over 10 000 resamples, or more if a tail needs them."""
    tail = (1 - level) / 2
    sums = resample_sums(pairs.where("diff is not null"), "metric", "diff", key, draws or resamples(tail, start=10_000))
    return bounds(sums.where("k > 0").select("metric", (F.col("kv") / F.col("k")).alias("m")), ["metric"], tail)


def unpaired_interval(df: DataFrame, side: str, left: str, right: str, value: str, key: Column, draws: int | None = None, level: float = 0.95) -> DataFrame:
    """low, high of the left side's mean less the right one's, each resampled by itself; places are one less than of pairs."""
    tail = (1 - level) / 2
    sums = resample_sums(df.where(F.col(side).isin(left, right) & F.col(value).isNotNull()), side, value, key, draws or resamples(tail, start=10_000))
    of = lambda which: F.max(F.when((F.col(side) == which) & (F.col("k") > 0), F.col("kv") / F.col("k")))  # noqa: E731  one row a draw and side
    return bounds(sums.groupBy("draw").agg((of(left) - of(right)).alias("m")), [], tail, 1)


def verdict(comparison: DataFrame, intervals: DataFrame, alpha: float = 0.05) -> DataFrame:
    """metric, verdict: identical, underpowered, real difference, within noise, contradictory or inconclusive."""
    both = comparison.join(intervals, "metric")
    outside = (F.col("low") > 0) | (F.col("high") < 0)
    named = (
        F.when((F.col("better") == 0) & (F.col("worse") == 0), "identical")
        .when(F.col("least_p") > alpha, "underpowered")
        .when(outside & (F.col("p") <= alpha) & (F.signum(F.col("diff")) == F.signum((F.col("better") - F.col("worse")).cast("double"))), "real difference")
        .when(outside & (F.col("p") <= alpha), "contradictory")
        .when(~outside & (F.col("p") > alpha), "within noise")
        .otherwise("inconclusive")
    )
    return both.select("metric", "diff", "low", "high", "p", named.alias("verdict"))


#: Metrics of yes or no for each query, by the start of their names.
BINARY = ("hit", "precision_1")
#: Metrics that don't depend on how many labels a query has, by the start of their names.
SCALE_FREE = ("hit", "precision", "mrr")
#: Metrics of which more is better; of all others less is.
HIGHER_BETTER = ("ndcg", "mrr", "hit", "recall", "precision", "map")


def starts(metric: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | metric.startswith(name)
    return out


def tested(pairs: DataFrame, group: str, alpha: float = 0.05, corrected: bool = True) -> DataFrame:
    """group, metric, test, n, mean_a, mean_b, diff, better, worse, p, alpha, verdict of paired differences.

    Metrics of yes or no are tested by McNemar, others by the sign test, both exact. With `corrected` alpha is divided
    by the number of groups times metrics. Verdicts in order: identical, underpowered (no outcome could reach alpha),
    within noise, split (the mean and the majority point apart), real difference.
    """
    sums = pairs.groupBy(group, "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("diff").alias("d"),
        F.count_if(F.col("diff") > 1e-9).alias("better"), F.count_if(F.col("diff") < -1e-9).alias("worse"),
    )
    whole = Window.partitionBy(F.lit(0))  # a row a group and metric
    family = F.size(F.collect_set(F.coalesce(F.col(group), F.lit("\0"))).over(whole)) * F.size(F.collect_set("metric").over(whole)) if corrected else F.lit(1)
    rows = sums.withColumn("alpha", F.lit(alpha) / family).withColumn("p", mcnemar(F.col("better"), F.col("worse")))
    verdict = (
        F.when((F.col("better") + F.col("worse") == 0) & (F.abs("d") < 1e-12), "identical")
        .when(least_p(F.col("better") + F.col("worse")) >= F.col("alpha"), "underpowered")
        .when(F.col("p") >= F.col("alpha"), "within noise")
        .when((F.col("better") - F.col("worse")) * F.col("d") <= 0, "split")
        .otherwise("real difference")
    )
    test = F.when(starts(F.col("metric"), BINARY), "mcnemar").otherwise("sign")
    return rows.select(
        group, "metric", test.alias("test"), "n", F.round("ma", 6).alias("mean_a"), F.round("mb", 6).alias("mean_b"), F.round("d", 6).alias("diff"),
        "better", "worse", F.round("p", 6).alias("p"), F.round("alpha", 9).alias("alpha"), verdict.alias("verdict"),
    )


def winner_buckets(tests: DataFrame, runs: DataFrame, group: str, top: str) -> DataFrame:
    """group, bucket, worse, better of every run: top, equivalent (in no metric worse than the top), beaten (in all),
    contested (in some), incomparable (nothing shared). better counts metrics in which it truly beats the top."""
    real = F.col("verdict") == "real difference"
    counts = tests.groupBy(group).agg(F.count_if(real & (F.col("diff") < 0)).alias("worse"), F.count_if(real & (F.col("diff") > 0)).alias("better"), F.count(F.lit(1)).alias("usable"))
    bucket = (
        F.when(F.col(group) == top, "top").when(F.col("usable").isNull(), "incomparable").when(F.col("worse") == 0, "equivalent")
        .when(F.col("worse") == F.col("usable"), "beaten").otherwise("contested")
    )
    zero = F.lit(0).cast("bigint")
    return runs.select(group).distinct().join(counts, group, "left").select(group, bucket.alias("bucket"), F.coalesce("worse", zero).alias("worse"), F.coalesce("better", zero).alias("better"))


def flagged(pairs: DataFrame, key: Column, alpha: float = 0.05, draws: int | None = None) -> DataFrame:
    """metric, test, diff, low, high, p, resolution, unstable, split, verdict, each metric by the test that suits it.

    Metrics of yes or no are judged by McNemar's exact p. Others are judged by the bootstrap's bounds unless the bound
    nearest to zero lies within one step of the grid (resolution) or loses its sign one standard deviation of the
    tail's count away (unstable): then the row is inconclusive. Where mean and majority point apart it is contradictory.
    """
    tail = alpha / 2
    sums = resample_sums(pairs.where("diff is not null"), "metric", "diff", key, draws or resamples(tail, start=10_000))
    means = sums.where("k > 0").select("metric", (F.col("kv") / F.col("k")).alias("m"))
    own = Window.partitionBy("metric")
    placed = means.withColumn("i", F.row_number().over(own.orderBy("m")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    held = F.floor(F.col("n") * tail + 1e-9)
    place = {"low": held, "high": F.least(F.col("n") - 1, F.floor(F.col("n") * (1 - tail) + 1e-9))}

    def at(name: str, shift: int) -> Column:
        where = F.greatest(F.lit(0), F.least(F.col("n") - 1, place[name] + shift * F.ceil(F.sqrt(held))))
        return F.max(F.when(F.col("i") == where, F.col("m")))

    found = placed.groupBy("metric").agg(*[at(name, shift).alias(f"{name}{shift + 1}") for name in place for shift in (-1, 0, 1)])
    sums = pairs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("d"), F.count_if(F.col("diff") > 1e-9).alias("better"), F.count_if(F.col("diff") < -1e-9).alias("worse"),
        F.min(F.when(F.abs("diff") > 1e-9, F.abs("diff"))).alias("least"),
    )
    rows = sums.join(found, "metric").withColumn("p", mcnemar(F.col("better"), F.col("worse")))
    low_near = F.abs("low1") <= F.abs("high1")
    rows = rows.withColumns({
        "binary": starts(F.col("metric"), BINARY),
        "resolution": F.coalesce(F.least(F.abs("low1"), F.abs("high1")) < F.col("least") / F.col("n"), F.lit(False)),
        "unstable": (F.when(low_near, F.col("low0")).otherwise(F.col("high0")) <= 0) & (F.when(low_near, F.col("low2")).otherwise(F.col("high2")) >= 0),
        "split": (F.abs("d") > 1e-12) & (F.col("better") + F.col("worse") > 0) & ((F.col("better") - F.col("worse")) * F.col("d") <= 0),
        "outside": (F.col("low1") > 0) | (F.col("high1") < 0),
    })
    verdict = (
        F.when((F.col("better") + F.col("worse") == 0) & (F.abs("d") < 1e-12), "identical")
        .when(F.col("binary") & (least_p(F.col("better") + F.col("worse")) >= alpha), "underpowered")
        .when(F.col("binary"), F.when(F.col("p") < alpha, "real difference").otherwise("within noise"))
        .when(F.col("outside") & (F.col("resolution") | F.col("unstable")), "inconclusive")
        .when(F.col("outside") & F.col("split"), "contradictory")
        .when(F.col("outside"), "real difference")
        .when(F.col("resolution"), "inconclusive")
        .otherwise("within noise")
    )
    return rows.select(
        "metric", F.when(F.col("binary"), "mcnemar").otherwise("bootstrap").alias("test"), F.round("d", 6).alias("diff"), F.round("low1", 6).alias("low"), F.round("high1", 6).alias("high"),
        F.round("p", 6).alias("p"), "resolution", "unstable", "split", verdict.alias("verdict"),
    )


def group_contrast(pairs: DataFrame, group: str, key: Column, draws: int | None = None, level: float = 0.95) -> DataFrame:
    """group, delta, low, high, verdict: how far the mean difference of the best group lies above that of each other one.

    Both are resampled apart, so the groups need not share queries; only metrics that don't depend on the number of
    labels may be compared so. Verdicts: top, truly above, or not distinguishable.
    """
    tail = (1 - level) / 2
    deltas = pairs.groupBy(group).agg(F.avg("diff").alias("delta"))
    best = deltas.orderBy(F.round("delta", 9).desc(), group).limit(1).select(F.col(group).alias("best"))
    sums = resample_sums(pairs.where(F.col("diff").isNotNull()), group, "diff", key, draws or resamples(tail, start=10_000)).where("k > 0").withColumn("m", F.col("kv") / F.col("k"))
    ahead = sums.join(F.broadcast(best), F.col(group) == F.col("best")).select("draw", F.col("m").alias("top"))  # a row a draw
    apart = sums.join(F.broadcast(best), F.col(group) != F.col("best")).join(ahead, "draw").select(group, (F.col("top") - F.col("m")).alias("m"))
    found = deltas.join(bounds(apart, [group], tail, 1), group, "left")
    verdict = F.when(F.col("low").isNull(), "top").when(F.col("low") > 0, "truly above").otherwise("not distinguishable")
    return found.select(group, F.round("delta", 6).alias("delta"), "low", "high", verdict.alias("verdict"))


def stratified_sample(df: DataFrame, stratum: str, key: str, wanted: int, seed: str = "0") -> DataFrame:
    """At most `wanted` rows of each stratum in hash order, with the weight that stands for the stratum's rows."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + "/"), F.col(key))), key)
    # The limit by place runs in each task before the shuffle; sizes come from a partial count.
    chosen = df.withColumn("i", F.row_number().over(w)).where(F.col("i") <= wanted).drop("i")
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    both = chosen.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return both.withColumn("weight", F.round(F.col("n") / F.least(F.col("n"), F.lit(wanted)), 6)).drop("n", "_s")


def winners(means: DataFrame, run: str, metric: str, value: str, margin: float) -> DataFrame:
    """run, metric, value, state: top, equivalent (within the margin of the top) or beaten."""
    best = F.max(value).over(Window.partitionBy(metric))
    state = F.when(F.col(value) == best, "top").when(F.col(value) >= best - margin, "equivalent").otherwise("beaten")
    return means.select(run, metric, value, state.alias("state"))


def calibration(df: DataFrame, predicted: Column, actual: Column, *groups: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and bias (predicted over actual, less one) of a detector; nulls are left out."""
    rows = df.withColumn("_p", predicted).withColumn("_a", actual).where("_p is not null and _a is not null")
    sums = rows.groupBy(*groups).agg(F.count_if(F.expr("_p and _a")).alias("tp"), F.count_if(F.expr("_p and not _a")).alias("fp"), F.count_if(F.expr("_a and not _p")).alias("fn"))
    tp, said, is_so = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    zero = F.lit(0)
    return sums.select(
        *groups, "tp", "fp", "fn", F.round(tp / F.nullif(said, zero), 6).alias("precision"), F.round(tp / F.nullif(is_so, zero), 6).alias("recall"),
        F.round(2 * tp / F.nullif(said + is_so, zero), 6).alias("f1"), F.round(said / F.nullif(is_so, zero) - 1, 6).alias("bias"),
    )


def comparable(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """shared, only_a, only_b and differing keys of two runs' label digests; comparable where no digest differs."""
    both = a.select(key, F.col(digest).alias("a")).join(b.select(key, F.col(digest).alias("b")), key, "full")
    differ = F.count_if(F.col("a") != F.col("b"))
    return both.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"), differ.alias("differing"), (differ == 0).alias("comparable"),
    )


def stratified_bootstrap(df: DataFrame, stratum: str, weight: str, value: str, key: Column, draws: int | None = None, level: float = 0.95) -> DataFrame:
    """low, high of a weighted mean, resampled within strata with Poisson weights from hashes of the key, as often as a
    tail needs."""
    tail = (1 - level) / 2
    totals = df.groupBy(F.col(stratum).alias("_s")).agg(F.sum(weight).alias("w"))
    sums = resample_sums(df, stratum, value, key, draws or resamples(tail)).where("k > 0").join(totals, F.col(stratum).eqNullSafe(F.col("_s")))
    means = sums.groupBy("draw").agg((F.sum(F.col("kv") / F.col("k") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return bounds(means, [], tail)
