r"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a random but repeatable order. A document's virtual finish time is the
number of words its source has sent with it, divided by the source's target: at virtual time 1 every source has sent
its target. Sources may be sent twice: the second pass follows the first in the same order. All sendings are sorted by
virtual finish time, over the whole cluster, and the running total of that order ends where the total budget is spent.
A document that its source would be sending at virtual time 1 is cut there, so that a long document does not keep its
source from its target: what it has sent by then, the word it is in the middle of, and the rest are sendings of their own.

Running totals come from a range partitioning: a sum within each partition and the sums of the partitions before it,
so a source that holds a third of all rows spreads over many partitions. They run over sizes; texts take no part.

Defined cases. A null or empty text has size 0 and takes 0; a very long one is one document as any other. A null source
is a source of its own and comes last. Ties in the order go by doc_id and size; rows that are equal in all of source,
doc_id and size (repeated rows) are served in any order: the words taken of them are the same set of numbers. A null
doc_id is kept. An empty table gives an empty result. Columns other than doc_id, source and text are not read; those of
mixed_rows are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillflow.llm.common import partitions, running, scratch, written

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target, source_before of sizes (source, size): weights repeat over the sources by code point
    (null last); targets sum to share of all sizes, stop at most times their source's size, and the excess is shared anew by weight."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one"))
    named = running(total, [F.col("source").isNull().cast("int"), F.col("source")], ["one", "source_size"], "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    named = named.select("source", "source_size", F.col("before_source_size").alias("source_before"), "before_one", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap"))
    # Level at which a source is full; sources fill up in this order, so the full ones are those for which the budget lasts.
    filled = running(named.withColumn("level", F.col("cap") / F.col("weight")), [F.col("level"), F.col("before_one")], ["cap", "weight"], "mix-levels")
    sums = filled.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight")).first()
    budget, all_weight = share * (sums["all"] or 0), sums["weight"] or 0.0
    full = F.col("before_cap") + F.col("level") * (F.lit(all_weight) - F.col("before_weight")) <= budget
    spent = filled.filter(full).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    rest = all_weight - (spent["weight"] or 0.0)
    level = (budget - (spent["cap"] or 0.0)) / rest if rest > 0 else float("inf")
    target = F.when(full, F.col("cap")).otherwise(F.least(F.col("weight") * level, F.col("cap")))
    return filled.select("source", "source_size", target.alias("target"), "source_before")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) of docs, as a table."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted), finish (virtual finish time of
    the first pass) of each row of docs (doc_id, source, text)."""
    with scratch(docs.sparkSession):
        return written(mix_sized(sizes(docs), weights, share, most, seed), "mix-result", stays=True)


def mix_sized(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 9) -> DataFrame:
    """As mix(), for rows of doc_id, source and size."""
    shuffled = sized.select("doc_id", "source", "size").withColumn("_at", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"), F.col("size").cast("string"))))
    queue = running(shuffled, [F.col("source").isNull().cast("int"), F.col("source"), F.col("_at"), F.col("doc_id"), F.col("size")], ["size"], "mix-queues")
    of_source = targets(queue.select("source", "size"), weights, share, most)
    joined = queue.join(of_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_at")
    # What a source has sent before a document, in the first pass.
    placed = written(joined.withColumn("begin", F.col("before_size") - F.col("source_before")).drop("source_before"), "mix-places")
    budget = int(share * (placed.agg(F.sum("size")).first()[0] or 0))
    served = _served(placed, budget)
    # Of rows without words several may share a place; nothing is taken of them.
    both = placed.join(served.withColumnRenamed("before_size", "_place"), (F.col("before_size") == F.col("_place")) & (F.col("size") > 0), "left")
    finish = F.when(F.col("target") > 0, (F.col("begin") + F.col("size")) / F.col("target"))
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), finish.alias("finish"))


def _served(placed: DataFrame, budget: int) -> DataFrame:
    """before_size (the place of a document in the order of all queues), taken: what is sent of it before the budget is spent."""
    passes = placed.filter("size > 0").select("before_size", "size", "target", F.explode(F.array(F.col("begin"), F.col("begin") + F.col("source_size"))).alias("begin"))
    # Sendings that begin at virtual time 1 or later are never reached: what begins before it holds the budget.
    begun = passes.filter("begin < target")
    until = F.least(F.col("size"), F.floor(F.col("target") - F.col("begin")))
    word = F.least(F.col("size") - until, F.lit(1))
    parts = F.array(*(F.struct(n.alias("words"), (F.col("begin") + end).alias("end")) for n, end in ((until, until), (word, until + word), (F.col("size") - until - word, F.col("size")))))
    sendings = begun.select("before_size", "target", F.explode(parts).alias("p")).filter("p.words > 0").select("before_size", (F.col("p.end") / F.col("target")).alias("finish"), F.col("p.words").alias("words"))
    order = running(sendings, [F.col("finish"), F.col("before_size")], ["words"], "mix-order")
    sent = F.least(F.col("words"), F.greatest(F.lit(0), F.lit(budget) - F.col("before_words")))
    return order.filter(F.col("before_words") < budget).groupBy("before_size").agg(F.sum(sent).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of docs for each pass over it, in the order of virtual finish times, texts cut where the mix ends.

    Queues are run on sizes alone; texts join them by doc_id, source, size and a number among rows that are equal in these.
    """
    columns = docs.columns
    key = ["_id", "_source", "_size"]
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    named = docs.select(F.struct(*columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.to_json(F.struct(F.col("source").cast("string").alias("source"))).alias("_source"), size.alias("_size"))
    slim = sizes(docs)
    done = mix_sized(slim, **options).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), F.to_json(F.struct("source")).alias("_source"), F.col("size").alias("_size"), "taken", "source_size", "target", "finish"
    )
    served = done.withColumn("_number", F.row_number().over(Window.partitionBy(*key).orderBy("taken", "finish")))
    numbered = named.withColumn("_number", F.row_number().over(Window.partitionBy(*key).orderBy("_row.text")))
    both = numbered.join(served, [*key, "_number"])
    passes = both.withColumn("_pass", F.explode(F.when(F.col("taken") > F.col("_size"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    words = F.least(F.col("_size"), F.col("taken") - F.col("_pass") * F.col("_size")).alias("_words")
    at = F.coalesce(F.col("finish"), F.lit(0.0)) + F.col("_pass") * F.coalesce(F.try_divide(F.col("source_size").cast("double"), F.col("target")), F.lit(0.0))
    # A document without words costs nothing and stays.
    rows = passes.select("_row", "_size", words, at.alias("_finish"), "_id").filter("_words > 0 or _size = 0")
    ordered = rows.repartitionByRange(partitions(docs), "_finish", "_id").sortWithinPartitions("_finish", "_id")
    flat = ordered.select(*[F.col("_row")[c].alias(c) for c in columns], "_words", "_size")
    return flat.mapInArrow(_cut, docs.schema)


def _cut(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from stillflow.llm.words import split_words

    for batch in rows:
        names = batch.schema.names
        part = np.flatnonzero(batch.column("_words").to_numpy() < batch.column("_size").to_numpy())
        columns = [batch.column(i) for i, n in enumerate(names) if n not in ("_words", "_size")]
        kept = [n for n in names if n not in ("_words", "_size")]
        if len(part):
            text, want = batch.column("text").to_pylist(), batch.column("_words").to_numpy()
            for i in part:
                words = split_words(pa.array([text[i]]))
                text[i] = bytes(words.data[: words.end[want[i] - 1]]).decode()
            columns[kept.index("text")] = pa.array(text, batch.schema.field("text").type)
        yield pa.RecordBatch.from_arrays(columns, kept)
