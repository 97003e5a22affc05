"""Ranking metrics of query results against labels, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(hits: DataFrame, gold: DataFrame, keys: list[str], recalls=(1, 5, 10, 20), ndcg_at: int = 10, map_at: int = 20) -> DataFrame:
    """A row for each key with metrics of its hits (keys.., item_id, rank) against gold (keys.., relevant array).

    Metrics: recall@k, precision@k, hit@k, mrr, ndcg, map. They are null, not 0, where nothing is labelled, and 0
    where nothing was returned. precision divides by k however few were returned. Repeated labels count once.
    """
    labels = gold.withColumn("relevant", F.array_distinct("relevant"))
    joined = labels.join(hits, keys, "left").withColumn("rel", F.coalesce(F.array_contains("relevant", F.col("item_id")).cast("int"), F.lit(0)))
    run = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("seen", F.sum("rel").over(run))
    inside = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    sums = [inside(k).alias(f"h{k}") for k in recalls]
    dcg = F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= ndcg_at), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    ap = F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= map_at), F.col("seen") / F.col("rank")).otherwise(0.0)).alias("ap")
    rr = F.max(F.when(F.col("rel") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("rr")
    out = joined.groupBy(*keys).agg(F.first(F.size("relevant")).alias("n"), F.count("item_id").alias("returned"), *sums, dcg, ap, rr)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(ndcg_at))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    known = lambda c: F.when(F.col("n") > 0, c)
    columns: dict[str, Column] = {}
    for k in recalls:
        columns[f"recall_{k}"] = known(F.col(f"h{k}") / F.col("n"))
        columns[f"precision_{k}"] = known(F.col(f"h{k}") / F.lit(k))
        columns[f"hit_{k}"] = known((F.col(f"h{k}") > 0).cast("double"))
    columns |= {"mrr": known(F.col("rr")), f"ndcg_{ndcg_at}": known(F.col("dcg") / ideal), f"map_{map_at}": known(F.col("ap") / F.least(F.col("n"), F.lit(map_at)))}
    return out.select(*keys, F.col("n").alias("n_relevant"), F.col("returned").alias("n_returned"), *[c.alias(name) for name, c in columns.items()])


def long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys.., metric, value; a metric that is null gives no row."""
    return df.unpivot(keys, metrics, "metric", "value").where("value is not null")


def summary(df: DataFrame, metrics: list[str], groups: list[list[str]]) -> DataFrame:
    """Means over the rows that have each metric, for several groupings in one pass, and how many had no label."""
    names = sorted({g for group in groups for g in group})
    sets = df.groupingSets([[F.col(c) for c in group] for group in groups], *[F.col(c) for c in names])
    return sets.agg(
        F.count(F.lit(1)).alias("queries"), F.sum((F.col("n_relevant") == 0).cast("bigint")).alias("unlabelled"),
        *[F.round(F.avg(m), 6).alias(m) for m in metrics],
    )


def ordered_values(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """groups, v, upto, n: each distinct value with the rows up to it and in all.

    Rows combine by value before the shuffle, so a hot group sends its distinct values, not its rows.
    """
    w = Window.partitionBy(*groups)
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))


def value_at(index: Column) -> Column:
    """The value at a place (from 0) of the sorted rows, from `ordered_values`."""
    return F.min(F.when(F.col("upto") > index, F.col("v")))


def latency(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """n, mean, the values at n // 2 and int(.95 n), maximum and sample deviation of each group."""
    rows = df.where(F.col(column).isNotNull())
    sums = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max"), F.round(F.stddev_samp(column), 5).alias("deviation"))
    last = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    places = ordered_values(df, column, *groups).groupBy(*groups).agg(value_at(F.floor(F.col("n") / 2)).alias("p50"), value_at(last).alias("p95"))
    for g in groups:
        places = places.withColumnRenamed(g, f"_{g}")
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return sums.join(places, same).select(*groups, "n", "mean", "p50", "p95", "max", "deviation")


def auc(df: DataFrame, score: str, positive: str, *groups: str) -> DataFrame:
    """Chance that a positive row scores above a negative one, ties by half; from counts of each distinct score."""
    w = Window.partitionBy(*groups)
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    counts = rows.groupBy(*groups, score).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum((~F.col(positive)).cast("bigint")).alias("m"))
    below = F.sum("m").over(w.orderBy(score)) - F.col("m")
    sums = counts.withColumn("won", F.col("p") * (below + F.col("m") / 2)).groupBy(*groups).agg(F.sum("p").alias("positives"), F.sum("m").alias("negatives"), F.sum("won").alias("won"))
    return sums.select(*groups, "positives", "negatives", F.round(F.col("won") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0)), 6).alias("auc"))


def token_report(texts: DataFrame, limit: int, special: int = 2, neighbour: int = 100) -> DataFrame:
    """Token statistics over all texts (lang, n, chars) and of each language, with the chunk size that would fit.

    Percentiles are at the rounded place, from counts of distinct values. The budget in characters goes by the 5th
    percentile of characters a token (to four digits), suggested leaves room for the neighbours' context on both sides,
    safe is its minimum over languages.
    """
    density = F.round(F.when(F.col("n") > 0, F.col("chars") / F.col("n")), 4)
    scopes = F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("overall"), F.col("lang").cast("string").alias("lang")))
    rows = texts.select("n", "chars", density.alias("d"), F.explode(scopes).alias("s")).select("s.*", "n", "chars", "d")
    keys = ["overall", "lang"]

    def at(value: str, **shares: float) -> DataFrame:
        found = ordered_values(rows, value, *keys).groupBy(*keys).agg(*[value_at(F.rint(F.lit(share) * (F.col("n") - 1))).alias(name) for name, share in shares.items()])
        return found.select(F.col("overall").alias("_o"), F.col("lang").alias("_l"), *shares)

    kept = F.sum(F.least("n", F.lit(limit)))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("n") > limit).alias("truncated"), F.sum("n").alias("tokens"), kept.alias("kept"),
        F.round(1 - kept / F.nullif(F.sum("n"), F.lit(0)), 6).alias("lost"), F.max("n").alias("longest"),
    )
    for found in (at("n", p50=0.5, p95=0.95), at("d", d=0.05)):
        sums = sums.join(found, F.col("overall").eqNullSafe(F.col("_o")) & F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_o", "_l")
    budget = F.floor((limit - special) * F.coalesce("d", F.lit(0.0)))
    out = sums.withColumn("budget", budget).withColumn("suggested", F.greatest(F.lit(0).cast("bigint"), F.col("budget") - 2 * neighbour)).withColumn("density_p05", F.round("d", 6)).drop("d")
    safe = F.min(F.when(~F.col("overall"), F.col("suggested"))).over(Window.partitionBy(F.lit(0)))  # a row a language
    return out.withColumn("safe", safe)


def refusals(rows: DataFrame, unanswerable: str, refused: str, *groups: str) -> DataFrame:
    """groups, answers, unjudged, recall, false_refusal, accuracy of refusals; rows without label or answer are unjudged."""
    u, r = F.col(unanswerable), F.col(refused)
    known = u.isNotNull() & r.isNotNull()
    share = lambda part, of: F.round(F.count_if(part) / F.nullif(F.count_if(of), F.lit(0)), 6)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(~known).alias("unjudged"), share(r & u, known & u).alias("recall"),
        share(r & ~u, known & ~u).alias("false_refusal"), share(known & (r == u), known).alias("accuracy"),
    )


def grounding(cited: DataFrame, uncited: DataFrame, again: DataFrame, quotes: DataFrame) -> DataFrame:
    """One row of measures from labels of cited claims (ref, l), of uncited ones (ref, l), of second judgements (ref, any:
    whether some source supports it), and the share of verified quotes (quotes).

    Claims labelled NO_CLAIM are left out. misattribution: failed cited claims that some source supports, among the
    supported ones and the failed ones judged again.
    """
    counted = lambda df, i: df.agg(F.count_if(F.col("l") == "SUPPORTED").alias(f"s{i}"), F.count_if(F.col("l") != "NO_CLAIM").alias(f"n{i}"))
    failed = cited.where(F.col("l").isin("NOT_FOUND", "CONTRADICTED")).join(again, "ref").agg(F.count_if("any").alias("wrong"), F.count(F.lit(1)).alias("again"))
    row = counted(cited, 1).crossJoin(counted(uncited, 2)).crossJoin(failed).crossJoin(quotes)  # one row each
    share = lambda part, of: F.round(part / F.nullif(of, F.lit(0)), 6)
    s1, n1, s2, n2 = (F.col(c) for c in ("s1", "n1", "s2", "n2"))
    return row.select(
        n1.alias("claims"), share(s1, n1).alias("faithfulness"), n2.alias("uncited_claims"), share(s2, n2).alias("uncited_grounding"),
        share(s1 + s2, n1 + n2).alias("derived"), share(n1, n1 + n2).alias("cited_share"), share(F.col("wrong"), s1 + F.col("again")).alias("misattribution"),
        F.round("quotes", 6).alias("quote_level"),
    )
