r"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its words, A-Z lower-cased, with weight 1 + ln(count): each term is an element of weight 1 and, if it
is repeated, another of weight ln(count). For each of SAMPLES samples an element gets a time that is exponential with its
weight as rate, and the first is the sample. The order of the times of weight 1 is that of hashes of the term and the
sample's number, so words that occur once, which most do, take a hash and a minimum. The other elements draw, from hashes
of the term and the sample's number, r and c of the gamma distribution (shape 2) and b of the uniform one; with
t = floor(ln(weight) / r + b), the logarithm of the time is ln(c) - r (t - b) - r. The least hash, or the least value (a
function of the term and t), stands for the sample: two texts agree in it with the probability that is the generalised
Jaccard similarity of their weights (sum of minima over sum of maxima), which the split leaves as it is.

Neighbours by doc_id are found without a global window: rows are dealt to ranges of doc_id (and, of an id that fills more
than one range, of a hash of the text), a copy of each range's first row closes the range before it, and one window over
ranges sees every pair. Texts are shuffled once, by range; terms, samples and the results are made where the texts are.

Likeness is a share of SAMPLES samples: its standard error is at most 0.5 / sqrt(SAMPLES), 0.072.

Defined cases. A null or empty text has no terms: its samples are empty, two such texts are alike (1) and unlike any
other (0). A very long text has all its terms. Rows that repeat a doc_id follow each other in the order of a hash of their
texts (ties: of the texts; equal rows are alike in all); a null doc_id comes before all. Columns other than doc_id and
text are not read. An empty table gives an empty result; a single row is its own next.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 48
#: Ranges of doc_id for each shuffle partition, and partitions of texts for each.
RANGES, SPREAD = 8, 4
_BITS = 21
_WORD_SPLIT = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _uniform(bits: Column, at: int, width: int) -> Column:
    """A number between 0 and 1 of width bits of a hash."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND((1 << width) - 1) + 0.5) * 2.0**-width


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """The logarithm of the time of a term with a weight of its own in sample k; the least one is the sample."""
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(first, 0, _BITS) * _uniform(first, _BITS, _BITS))
    b = _uniform(first, 2 * _BITS, _BITS)
    c = -F.ln(_uniform(second, 0, 32) * _uniform(second, 32, 32))
    return F.ln(c) - r * (F.floor(log_weight / r + b) - b + 1.0)


def unit_sample(term: Column, k: int) -> Column:
    """What orders terms of weight 1 in sample k as their times do."""
    return F.xxhash64(term, F.lit(-1 - k))


def _log_time(least: Column) -> Column:
    """The logarithm of the time that a value of unit_sample stands for, of 52 of its bits."""
    return F.ln(-F.log1p(-(F.shiftrightunsigned(least.bitwiseXOR(F.lit(-(2**63))), 12) + 0.5) * 2.0**-52))


def _ranges(rows: DataFrame, n: int) -> list[tuple[int, int]]:
    """Where about n ranges of equal numbers of rows begin, but for the first: an id, and a hash among the rows of that id."""
    if n < 2:
        return []
    cuts = rows.agg(F.percentile_approx("_id", F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(20 * n)).alias("at")).first()["at"] or []
    times = Counter(cuts)
    # An id at several cuts fills ranges of its own: they part its hashes evenly.
    return sorted((i, -(2**63) + 2**64 * k // m) for i, m in times.items() for k in range(m))


def _range_of(value: Column, begins: list[tuple[int, int]]) -> Column:
    """The number of begins at or below value: found in two steps, each over about the square root of them all."""
    step = max(1, math.isqrt(len(begins)))
    groups = [begins[i : i + step] for i in range(0, len(begins), step)]
    if not groups:
        return F.lit(0)
    pair = lambda p: F.struct(F.lit(p[0]).cast("long").alias("_id"), F.lit(p[1]).cast("long").alias("_hash"))
    count = lambda arr: F.size(F.filter(arr, lambda x: x <= value))
    group = count(F.array(*(pair(g[0]) for g in groups)))
    inner = F.array(*(F.array(*(pair(x) for x in g)) for g in groups))
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(F.element_at(inner, F.greatest(group, F.lit(1)))))


def _signature(words: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys, samples: the least values of the terms of rows keys, text."""
    terms = F.filter(F.split(F.translate("text", _UPPER, _LOWER), _WORD_SPLIT), lambda w: w != "")
    # A text without words has one row without a term.
    counted = words.select(*keys, F.explode_outer(terms).alias("word")).groupBy(*keys, F.xxhash64("word").alias("term"), F.col("word").isNull().alias("none")).agg(F.count("*").alias("n"))
    term = F.when(~F.col("none"), F.col("term")).alias("term")
    weighed = counted.select(*keys, term, F.when(F.col("n") > 1, F.ln(F.ln(F.col("n").cast("double")))).alias("lw"))
    units = (F.min(F.when(F.col("term").isNotNull(), unit_sample(F.col("term"), k))).alias(f"u{k}") for k in range(samples))
    others = (F.min(F.when(F.col("term").isNotNull() & F.col("lw").isNotNull(), sample(F.col("term"), F.col("lw"), k))).alias(f"s{k}") for k in range(samples))
    least = weighed.groupBy(*keys).agg(*units, *others)
    # 32 bits of a hash of what stands for each sample.
    first = [F.when(F.col(f"s{k}") < _log_time(F.col(f"u{k}")), F.xxhash64(f"s{k}")).otherwise(F.xxhash64(f"u{k}")) for k in range(samples)]
    bits = [F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0")) for x in first]
    return least.select(*keys, F.when(F.col("u0").isNotNull(), F.concat(*bits)).otherwise("").alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree."""
    same = [F.when(F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8), 1).otherwise(0) for k in range(samples)]
    share = sum(same[1:], same[0]) / F.lit(float(samples))
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(share)


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Null ids sort first.
    keyed = slim.withColumns({"_id": F.coalesce("doc_id", F.lit(-(2**63))), "_hash": F.xxhash64("text")})
    begins = _ranges(keyed.select("_id"), RANGES * parts)
    placed = keyed.withColumn("range", _range_of(F.struct("_id", "_hash"), begins))
    first_of = placed.groupBy("range").agg(F.min(F.struct("_id", "_hash", "text", "doc_id")).alias("first"))
    numbers = sorted(r["range"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect())
    if not numbers:
        before = F.lit(None).cast("int")
    else:
        pairs = dict(zip(numbers[1:] + numbers[:1], numbers, strict=True))
        before = F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.col("range"))
    # Both uses of the rows below need all of these columns and no others: so the one shuffle of texts serves both.
    columns = ["doc_id", "text", "_hash"]
    closing = first_of.select(*(f"first.{c}" for c in columns), before.alias("range"), F.lit(1).alias("closes"))
    rows = placed.select(*columns, "range", F.lit(0).alias("closes")).unionByName(closing).repartition(SPREAD * parts, "range")
    in_range = Window.partitionBy("range").orderBy("closes", F.coalesce("doc_id", F.lit(-(2**63))), "_hash", "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = rows.withColumns({"at": F.row_number().over(in_range), "next": F.lead("text").over(in_range)})
    edited = F.concat(F.substring("text", 1, n - half), F.substring("next", 1, half))
    edited = F.when(half > 0, edited).otherwise(F.col("text"))
    kept = paired.select("range", "at", "closes", "doc_id", n.cast("long").alias("n_chars"), "text", F.when(F.col("closes") == 0, edited).alias("edited"))
    facts = kept.select("range", "at", "closes", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    both = kept.select("range", "at", F.explode(F.array(F.struct(F.lit(0).alias("v"), "text"), F.struct(F.lit(1).alias("v"), F.coalesce("edited", F.lit("")).alias("text")))).alias("x")).select("range", "at", "x.v", "x.text")
    signed = _signature(both, ["range", "at", "v"], samples)
    one = signed.groupBy("range", "at").agg(F.max(F.when(F.col("v") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("v") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    joined = facts.join(one, ["range", "at"])
    with_next = joined.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("range").orderBy("at"))).filter("closes = 0")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other), samples)
    return with_next.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
