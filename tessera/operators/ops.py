"""Operational analytics: histories, histograms, spend, limits, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(df: DataFrame, group: str, order: list[str], wanted: Column, value: str, out: str) -> DataFrame:
    """Each row with the latest value, at or before it in its group, of the rows that are wanted."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))


def questions(messages: DataFrame) -> DataFrame:
    """id, conversation_id, question_id of each assistant message (id, conversation_id, role, created_at, user_message_id).

    A keyed answer belongs to the message that its key names, and to none if there is no such message. Only an answer
    without key takes the latest user message of its conversation up to its own time, the greater id first.
    """
    rows = messages.select("id", "conversation_id", "role", "created_at", "user_message_id").distinct()
    answers = rows.where("role = 'assistant'")
    known = rows.where("id is not null").select(F.col("id").alias("question_id")).distinct()
    keyed = answers.where("user_message_id is not null").join(known, F.col("user_message_id") == F.col("question_id"), "left")
    rest = rows.where("role = 'user' or (role = 'assistant' and user_message_id is null)")
    # Messages of the same time count as earlier, whatever their ids.
    w = Window.partitionBy("conversation_id").orderBy("created_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = (F.col("role") == "user") & F.col("created_at").isNotNull()
    latest = F.max(F.when(asked, F.struct("created_at", "id"))).over(w)["id"]
    known_place = F.col("conversation_id").isNotNull() & F.col("created_at").isNotNull()
    timed = rest.withColumn("question_id", F.when(known_place, latest)).where("role = 'assistant'")
    return keyed.select("id", "conversation_id", "question_id").unionByName(timed.select("id", "conversation_id", "question_id"))


def last_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group in the given (descending) order; Spark limits each task before the shuffle."""
    return df.withColumn("age", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("age") <= n)


def page_after(df: DataFrame, keys: list[str], cursor: list[Column], n: int) -> DataFrame:
    """The next n rows after a cursor in key order."""
    return df.where(F.struct(*keys) > F.struct(*[c.alias(k) for k, c in zip(keys, cursor, strict=True)])).orderBy(*keys).limit(n)


def histogram(df: DataFrame, value: str, edges: list[float], *groups: str) -> DataFrame:
    """groups, le, count: how many values are at most each edge; the last edge is infinite."""
    per = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(
        *[F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)], F.count(value).alias("all")
    )
    cells = [F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("count")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("count")))
    return per.select(*groups, F.explode(F.array(*cells)).alias("c")).select(*groups, "c.le", "c.count")


def histogram_quantile(buckets: DataFrame, p: float, *groups: str) -> DataFrame:
    """The quantile from cumulative buckets, interpolated inside its bucket; the last finite edge beyond it."""
    w = Window.partitionBy(*groups).orderBy("le")
    total = F.max("count").over(Window.partitionBy(*groups))
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("count").over(w), F.lit(0))).withColumn("target", total * p)
    hit = rows.where((F.col("count") >= F.col("target")) & (F.col("under") < F.col("target")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("target") - F.col("under")) / (F.col("count") - F.col("under"))
    return hit.select(*groups, F.round(F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def running_spend(df: DataFrame, tenant: Column, at: str, cost: str, key: str) -> DataFrame:
    """Each row with its tenant's spend so far on the UTC day."""
    w = Window.partitionBy("tenant", "day").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("tenant", tenant).withColumn("day", F.to_date(at)).withColumn("spent", F.sum(cost).over(w))


def sequential(df: DataFrame, group: str, order: list[str], step, start, out: str, kind: str, uses: str) -> DataFrame:
    """A decision for each row that depends on the ones before it in its group.

    Rows stream sorted through each task and only one state is held, so a group of any size needs no more memory;
    step(state, value) gives (state, decision), where value is the row's `uses` column.
    """
    names = df.columns
    schema = df.schema.add(out, kind)
    ordered = df.repartition(group).sortWithinPartitions(group, *order)
    g, u = names.index(group), names.index(uses)
    types = {"boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            made = []
            for own, value in zip(batch.column(g).to_pylist(), batch.column(u).to_pylist(), strict=True):
                if own != now:
                    now, state = own, start()
                state, decision = step(state, value)
                made.append(decision)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, types[kind])], names=[*names, out])

    return ordered.mapInArrow(run, schema)


def token_bucket(df: DataFrame, group: str, seconds: str, order: list[str], per_minute: float, burst: float) -> DataFrame:
    """`allowed` of each row: a bucket refills by the minute's share each second and a row takes one token."""

    def step(state, at):
        level, before = state
        level = min(burst, level + max(0.0, at - before) * per_minute / 60) if before is not None else burst
        return ((level - 1, at), True) if level >= 1 else ((level, at), False)

    return sequential(df, group, order, step, lambda: (burst, None), "allowed", "boolean", seconds)


def circuit_breaker(df: DataFrame, group: str, event: str, order: list[str], failures: int = 3, open_seconds: float = 30.0) -> DataFrame:
    """`state` of each row (struct column `event` of at, failed): closed, open or probe.

    After so many failures in a row the circuit is open for a while; then one row probes it. A null `failed` is neutral.
    """

    def step(state, row):
        count, since = state
        if since is not None and row["at"] - since < open_seconds:
            return state, "open"
        named = "closed" if since is None else "probe"
        if row["failed"] is None:
            return state, named
        if not row["failed"]:
            return (0, None), named
        count += 1
        return ((count, row["at"]) if count >= failures or named == "probe" else (count, None)), named

    return sequential(df, group, order, step, lambda: (0, None), "state", "string", event)
