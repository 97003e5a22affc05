"""All places of many passages in a corpus, in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: Passages are sent to the tasks in blocks of about this many characters; each block is a pass over the corpus.
BLOCK_CHARS = 2_000_000

#: The automaton of a worker and the passages that it was made from.
_READY: list = [None, None]


def _automaton(passages: list[tuple[str, list]]):
    if _READY[0] is not passages:
        import ahocorasick

        made = ahocorasick.Automaton()
        for passage, ids in passages:
            made.add_word(passage, (len(passage), ids))
        made.make_automaton()
        _READY[:] = [passages, made]
    return _READY[1]


def occurrences(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str, block: int = BLOCK_CHARS) -> DataFrame:
    """item_id, doc_id, s, e: every place (in characters, from 0) where an item's passage stands in a text.

    One automaton over a block of passages reads each text once, so nothing is joined and places that overlap all come
    out. Null keys, null texts and null or empty passages give nothing; repeated rows count for themselves, an item that
    stands twice in the table with one passage counts once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    asked = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).where("i is not null and p <> ''").distinct()
    kinds = rows.schema["k"].dataType.simpleString(), asked.schema["i"].dataType.simpleString()
    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}, s int, e int"

    def passed(held: dict[str, list]) -> DataFrame:
        shared = spark.sparkContext.broadcast([*held.items()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(shared.value)
            for batch in batches:
                out = []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for end, (size, ids) in found.iter(t):
                        out += [(i, k, end + 1 - size, end + 1) for i in ids]
                columns = [pa.array([r[c] for r in out], kind) for c, kind in enumerate((item_kind, batch.schema.field(0).type, pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "s", "e"])

        return spread(rows).mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    item_kind = to_arrow_type(asked.schema["i"].dataType)
    passes, held, chars = [], {}, 0
    for row in asked.toLocalIterator():  # one block of the stated set at a time is held here
        if row.p not in held:
            held[row.p] = []
            chars += len(row.p)
        held[row.p].append(row.i)
        if chars >= block:
            passes.append(passed(held))
            held, chars = {}, 0
    if held:
        passes.append(passed(held))
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], schema)
