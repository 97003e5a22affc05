"""Consensus from several annotators' labels (problem 3): expectation-maximisation over confusion matrices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, written

#: Annotators up to which their confusion matrices are broadcast; beyond it they are joined by shuffling.
MOST_BROADCAST = 20_000
#: Rounds after which a fit that still moves is given up with an error.
MOST_ROUNDS = 1000


def usable_votes(df: DataFrame, item: str, annotator, label: str, labels: list[str], at: str | None = None) -> DataFrame:
    """Item, annotator and label of every vote; labels are matched without regard to case, blanks and separators.

    Null and unknown labels, items and annotators are no vote. The latest vote of an annotator on an item stands, the
    greatest label where times are equal.
    """
    spelled = F.regexp_replace(F.trim(F.regexp_replace(F.upper(F.col(label)), r"[\s\p{Z}_\-]+", " ")), " ", "_")
    rows = df.select(F.col(item).cast("string").alias("item"), annotator.alias("annotator"), spelled.alias("label"), (F.col(at) if at else F.lit(None).cast("timestamp")).alias("at"))
    rows = rows.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isin(*labels))
    # max over a struct is a partial aggregate: a vote delivered very often never fills one task.
    return rows.groupBy("item", "annotator").agg(F.max(F.struct("at", "label"))["label"].alias("label"))


def best_naming(table: list[list[float]]) -> list[int]:
    """The label of each class that gives the greatest sum of table[class][label], each label once; by subsets."""
    k = len(table)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in range(k):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, names) in best.items():
            for label in range(k):
                if not used >> label & 1:
                    made = (total + table[c][label], [*names, label])
                    key = used | 1 << label
                    if key not in after or made[0] > after[key][0]:
                        after[key] = made
        best = after
    return best[(1 << k) - 1][1]


def lean(k: int, smoothing: float) -> np.ndarray:
    """What is added to a confusion matrix: it leans to the right label, so a little-used annotator is taken as somewhat
    better than chance."""
    return np.where(np.eye(k, dtype=bool), 2.0 * smoothing, smoothing / max(1, k - 1))


class _Rounds:
    """Counts rounds until what they give no longer moves."""

    def __init__(self, asked: int | None, tolerance: float):
        self.asked, self.tolerance, self.done, self.before = asked, tolerance, 0, None

    def settled(self, now: np.ndarray, moved: float = 0.0) -> bool:
        if self.before is not None:
            moved = max(moved, float(np.abs(now - self.before).max(initial=0)))
        still = self.before is None or moved >= self.tolerance
        self.before, self.done = now, self.done + 1
        if self.asked is not None and self.done >= self.asked:
            return True
        if still and self.done > MOST_ROUNDS:
            raise RuntimeError(f"the consensus still moves by {moved} after {MOST_ROUNDS} rounds")
        return not still


class Consensus:
    """Fitted consensus: `items` (item, votes, p0..) and `model` (annotator, c, l, p: chance of label l for class c).

    Rounds go on until no class share and no cell of a confusion matrix moves by `tolerance`; without that in
    MOST_ROUNDS an error names the last move. `rounds` asks for at most that many instead.
    """

    def __init__(self, votes: DataFrame, labels: list[str], rounds: int | None = None, smoothing: float = 1.0, tolerance: float = 1e-4):
        self.labels, self.spark, self.smoothing = labels, votes.sparkSession, smoothing
        index = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
        coded = votes.select("item", "annotator", index.alias("l"))
        names = [r.annotator for r in coded.select("annotator").distinct().orderBy("annotator").limit(MOST_BROADCAST + 1).collect()]
        fit = self._fit_packed if len(names) <= MOST_BROADCAST else self._fit_joined
        fit(coded, names, _Rounds(rounds, tolerance))

    # Few annotators: their matrices go to every task, and a round is one pass over the items.

    def _fit_packed(self, votes: DataFrame, names: list, rounds: _Rounds) -> None:
        k = len(self.labels)
        numbers = self.spark.createDataFrame(list(enumerate(names)), f"a int, annotator {votes.schema['annotator'].dataType.simpleString()}")
        codes = votes.join(F.broadcast(numbers), "annotator").select("item", "annotator", "l", (F.col("a") * k + F.col("l")).alias("code"))
        # An item has one vote of an annotator at most, so a list is as short as the annotators are few.
        self.votes = written(codes.groupBy("item").agg(F.sort_array(F.collect_list("code")).alias("codes")))
        counts, mass = self._counted(None, None, len(names))
        while True:
            model, prior = self._smoothed(counts, mass)
            if rounds.settled(np.concatenate((model.ravel(), prior))):
                break
            counts, mass = self._counted(model, prior, len(names))
        # What a vote tells about the class, whatever the classes' names, times the number of votes.
        joint = model * prior[None, :, None]
        told = (joint * np.log(model / joint.sum(axis=1, keepdims=True))).sum(axis=(1, 2)) if len(names) else np.zeros(0)
        given = counts.sum(axis=1).reshape(len(names), k).sum(axis=1)
        order = best_naming((joint * (told * given)[:, None, None]).sum(axis=0).tolist())
        back = [order.index(n) for n in range(k)]
        model, prior = model[:, back, :], prior[back]
        self.prior = prior.tolist()
        cells = [(name, c, l, float(model[a, c, l])) for a, name in enumerate(names) for c in range(k) for l in range(k)]
        self.model = self.spark.createDataFrame(cells, f"annotator {votes.schema['annotator'].dataType.simpleString()}, c int, l int, p double")
        self.items = self._posteriors(model, prior)
        self.coded = lambda: self.votes.select("item", F.explode("codes").alias("code")).join(F.broadcast(numbers), F.expr(f"a = code div {k}")).select("item", "annotator", (F.col("code") % k).alias("l"))

    def _smoothed(self, counts: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Confusion matrices [annotator, class, label] and class shares from sums [annotator * labels, class]."""
        k = len(self.labels)
        cells = counts.reshape(-1, k, k).transpose(0, 2, 1) + lean(k, self.smoothing)
        mass = mass + self.smoothing
        return cells / cells.sum(axis=2, keepdims=True), mass / mass.sum()

    def _judged(self, model: np.ndarray | None, prior: np.ndarray | None):
        """A function of a batch of items: codes, owner of each code, votes and class chances of each item."""
        k = len(self.labels)
        shared = self.spark.sparkContext.broadcast(None if model is None else (np.log(model).transpose(0, 2, 1).reshape(-1, k), np.log(prior)))

        def run(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            codes, sizes = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            if shared.value is None:
                chances = np.stack([np.bincount(owner, codes % k == c, len(sizes)) for c in range(k)], axis=1) / sizes[:, None]
            else:
                table, start = shared.value
                logs = np.stack([np.bincount(owner, table[codes, c], len(sizes)) for c in range(k)], axis=1) + start
                grown = np.exp(logs - logs.max(axis=1, keepdims=True))
                chances = grown / grown.sum(axis=1, keepdims=True)
            return codes, owner, sizes, chances

        return run

    def _counted(self, model: np.ndarray | None, prior: np.ndarray | None, annotators: int) -> tuple[np.ndarray, np.ndarray]:
        """One round: class chances summed for each annotator and label, and over all items."""
        k = len(self.labels)
        judged = self._judged(model, prior)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, mass = np.zeros((annotators * k, k)), np.zeros(k)
            for batch in batches:
                if len(batch):
                    codes, owner, _, chances = judged(batch.column(0))
                    for c in range(k):
                        sums[:, c] += np.bincount(codes, chances[owner, c], annotators * k)
                    mass += chances.sum(axis=0)
            met = np.flatnonzero(sums.any(axis=1))
            rows = np.concatenate((mass[None, :], sums[met]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], met)).astype(np.int32)), *[pa.array(rows[:, c]) for c in range(k)]], names=["code", *[f"p{c}" for c in range(k)]])

        parts = self.votes.select("codes").mapInArrow(run, "code int, " + ", ".join(f"p{c} double" for c in range(k)))
        counts, mass = np.zeros((annotators * k, k)), np.zeros(k)
        for row in parts.groupBy("code").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)]).collect():  # a row a label of each annotator
            (mass if row.code < 0 else counts[row.code])[:] = row[1:]
        return counts, mass

    def _posteriors(self, model: np.ndarray, prior: np.ndarray) -> DataFrame:
        k = len(self.labels)
        judged = self._judged(model, prior)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    _, _, sizes, chances = judged(batch.column(1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int64)), *[pa.array(chances[:, c]) for c in range(k)]], names=["item", "votes", *[f"p{c}" for c in range(k)]])

        kind = self.votes.schema["item"].dataType.simpleString()
        return self.votes.mapInArrow(run, f"item {kind}, votes bigint, " + ", ".join(f"p{c} double" for c in range(k)))

    # Too many annotators to send: their matrices are joined to the votes by shuffling.

    def _fit_joined(self, votes: DataFrame, names: list, rounds: _Rounds) -> None:
        k = len(self.labels)
        self.votes = written(votes)
        self.coded = lambda: self.votes
        share = cut(self.votes.groupBy("item").agg(F.count(F.lit(1)).alias("votes"), *[F.avg((F.col("l") == c).cast("double")).alias(f"p{c}") for c in range(k)]))
        before = None
        while True:
            model, prior = self._maximise(share)
            moved = 0.0
            if before is not None:
                moved = model.join(before.withColumnRenamed("p", "q"), ["annotator", "c", "l"]).agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] or 0.0
            if rounds.settled(np.array(prior), moved):
                break
            before, share = model, self._expect(model, prior)
        self.model, self.prior, self.items = self._named(model, prior, share)

    def _named(self, model: DataFrame, prior: list[float], share: DataFrame) -> tuple[DataFrame, list[float], DataFrame]:
        """Name the classes by the annotators that tell most.

        The likelihood is the same for any naming of the classes, and EM keeps the one it started with, which a biased
        majority may have set. The right naming puts the consistent annotators on the diagonal: each confusion matrix
        counts by its votes times the information that a vote gives about the class, whatever the names.
        """
        k = len(self.labels)
        shares = F.element_at(F.array(*[F.lit(p) for p in prior]), F.col("c") + 1)
        joint = model.withColumn("j", F.col("p") * shares)
        margin = F.sum("j").over(Window.partitionBy("annotator", "l"))
        told = joint.withColumn("i", F.col("j") * F.log(F.col("p") / margin)).groupBy("annotator").agg(F.sum("i").alias("told"))
        counts = self.votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("votes"))
        weight = F.sum(F.col("j") * F.col("told") * F.col("votes"))
        cells = joint.join(told, "annotator").join(counts, "annotator").groupBy("c", "l").agg(weight.alias("w")).collect()
        table = [[0.0] * k for _ in range(k)]
        for cell in cells:
            table[cell.c][cell.l] = cell.w
        names = best_naming(table)
        renamed = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)
        back = [names.index(n) for n in range(k)]
        shared = share.select("item", "votes", *[F.col(f"p{back[n]}").alias(f"p{n}") for n in range(k)])
        return model.withColumn("c", renamed), [prior[back[n]] for n in range(k)], shared

    def _maximise(self, share: DataFrame) -> tuple[DataFrame, list[float]]:
        k = len(self.labels)
        sums = self.votes.join(share.drop("votes"), "item").groupBy("annotator", "l").agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)])
        totals = share.agg(*[F.sum(f"p{c}").alias(f"p{c}") for c in range(k)]).first()
        mass = [(totals[c] or 0.0) + self.smoothing for c in range(k)]
        prior = [m / sum(mass) for m in mass]
        given = [F.struct(F.lit(l).alias("l"), F.lit(c).alias("c"), F.coalesce(F.max(F.when(F.col("l") == l, F.col(f"p{c}"))), F.lit(0.0)).alias("n")) for l in range(k) for c in range(k)]
        grid = sums.groupBy("annotator").agg(F.array(*given).alias("g")).select("annotator", F.explode("g").alias("g")).select("annotator", "g.c", "g.l", "g.n")
        leaning = lean(k, self.smoothing)
        counts = grid.withColumn("n", F.col("n") + F.when(F.col("c") == F.col("l"), float(leaning[0, 0])).otherwise(float(leaning[0, -1])))
        p = F.col("n") / F.sum("n").over(Window.partitionBy("annotator", "c"))
        return cut(counts.select("annotator", "c", "l", p.alias("p"))), prior

    def _expect(self, model: DataFrame, prior: list[float]) -> DataFrame:
        k = len(self.labels)
        table = model.groupBy("annotator", "l").agg(*[F.max(F.when(F.col("c") == c, F.log("p"))).alias(f"g{c}") for c in range(k)])
        each = self.votes.join(table, ["annotator", "l"])
        logs = each.groupBy("item").agg(F.count(F.lit(1)).alias("votes"), *[(F.sum(f"g{c}") + F.log(F.lit(prior[c]))).alias(f"g{c}") for c in range(k)])
        top = F.greatest(*[F.col(f"g{c}") for c in range(k)])
        grown = logs.select("item", "votes", *[F.exp(F.col(f"g{c}") - top).alias(f"e{c}") for c in range(k)])
        total = reduce(lambda a, b: a + b, [F.col(f"e{c}") for c in range(k)])
        return cut(grown.select("item", "votes", *[(F.col(f"e{c}") / total).alias(f"p{c}") for c in range(k)]))

    def labelled(self, items: DataFrame) -> DataFrame:
        """item, label, confidence, votes of every given item; one without votes takes the most frequent class, at its share."""
        k = len(self.labels)
        best = F.greatest(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(-c).alias("c")) for c in range(k)])
        chosen = self.items.select("item", best.alias("b"), "votes")
        usual = max(range(k), key=self.prior.__getitem__)
        name = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.coalesce(-F.col("b.c"), F.lit(usual)) + 1)
        return items.join(chosen, "item", "left").select("item", name.alias("label"), F.coalesce("b.p", F.lit(self.prior[usual])).alias("confidence"), F.coalesce("votes", F.lit(0)).alias("votes"))

    def annotators(self) -> DataFrame:
        """annotator, votes, reliability (chance of the right label at the classes' shares), kappa against the consensus."""
        k = len(self.labels)
        shares = F.element_at(F.array(*[F.lit(p) for p in self.prior]), F.col("c") + 1)
        right = self.model.where("c = l").groupBy("annotator").agg(F.sum(F.col("p") * shares).alias("reliability"))
        each = self.coded().join(self.items.drop("votes"), "item")
        agree = F.element_at(F.array(*[f"p{c}" for c in range(k)]), F.col("l") + 1)
        seen = each.groupBy("annotator").agg(
            F.count(F.lit(1)).alias("votes"), F.avg(agree).alias("o"),
            *[F.avg((F.col("l") == c).cast("double")).alias(f"v{c}") for c in range(k)], *[F.avg(f"p{c}").alias(f"w{c}") for c in range(k)],
        )
        chance = reduce(lambda a, b: a + b, [F.col(f"v{c}") * F.col(f"w{c}") for c in range(k)])
        kappa = F.when(chance < 1, (F.col("o") - chance) / (1 - chance)).otherwise(F.lit(None).cast("double"))
        return seen.join(right, "annotator").select("annotator", "votes", "reliability", kappa.alias("kappa"))


def agreement(votes: DataFrame) -> DataFrame:
    """One row: items (with two votes or more), votes, observed, expected, alpha (chance-corrected, nominal).

    alpha is Krippendorff's, for any number of votes an item; null where nothing can disagree.
    """
    counts = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    paired = counts.join(per.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    total = per.agg(F.count(F.lit(1)).alias("items"), F.sum("m").alias("votes"), (F.sum(F.col("same") / (F.col("m") - 1)) / F.sum("m")).alias("observed"))
    spread = paired.agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).select((F.col("s") / (F.col("t") * (F.col("t") - 1))).alias("expected"))
    none = F.lit(None)
    both = total.withColumn("expected", none.cast("double")).unionByName(
        spread.select(none.cast("bigint").alias("items"), none.cast("bigint").alias("votes"), none.cast("double").alias("observed"), "expected")
    ).agg(*[F.max(c).alias(c) for c in ("items", "votes", "observed", "expected")])
    return both.select("items", "votes", "observed", "expected", F.when(F.col("expected") < 1, 1 - (1 - F.col("observed")) / (1 - F.col("expected"))).alias("alpha"))
