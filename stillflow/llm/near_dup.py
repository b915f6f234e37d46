r"""Near-duplicates by b-bit MinHash.

Texts with the same word sequence form one class. Each class has minima of its distinct five-word shingles; bands of
minima give candidates; the low bits of all minima, packed plane by plane, estimate similarity by bit counts, corrected
for bits that agree by chance; full shingle sets confirm what the estimate leaves. Components are found over confirmed
links. A pair at the threshold shares no band with probability 5e-6, and is estimated below LEAST_ESTIMATE with 3e-7.

Hot buckets: a bucket (a band's value) may hold thousands of near copies. Links of a bucket are first sought with its
best-connected member alone, so such a group costs one pair a member. Only pairs that are still in different
components after that are compared with each other: in blocks of bounded size and like numbers of shingles, by bit
counts first and by full sets after, in the same place, so that only links that join components leave a block. No pair is
dropped for the size of its bucket; sets too unlike in size to be linked do not meet.

Defined cases. A null or word-less text has n_shingles 0 and its own component. A very long text has all its shingles; of
blocks it may be one alone. Rows that repeat a doc_id are one document and link their texts. A row with a null doc_id
takes part in links but never names a component; where none of a component's rows has an id, component_id is null and
the rows are kept. Ties, of members as well connected, go to the larger hash. An empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import batches, scratch, written
from stillflow.llm.words import mix, sequence_hash, shingles, split_words

SHINGLE_WORDS = 5
ROWS, BANDS = 4, 32
#: Low bits of each minimum that the packed signature keeps: a plane of bits for each.
B_BITS = 4
#: Pairs whose estimate is below are not confirmed: five standard errors of 128 minima under 0.75.
LEAST_ESTIMATE = 0.55
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: And shingles of such members, at most (but for a single member with more).
BLOCK_SHINGLES = 1 << 18

_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SIGNATURE = "doc_id long, text_hash long, id long, n_shingles long, bands array<long>, bits binary"


def minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit minima of each set under each hash function; sets must not be empty."""
    out = np.empty((len(first) - 1, len(_SEEDS)), np.uint32)
    with np.errstate(over="ignore"):
        for k, seed in enumerate(_SEEDS):
            hashed = values * seed
            hashed ^= hashed >> np.uint64(29)
            out[:, k] = np.minimum.reduceat((hashed * _SEEDS[-1 - k] >> np.uint64(32)).astype(np.uint32), first[:-1])
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """The B_BITS low bits of each signature's minima: 64-bit words by signature, bit and minimum."""
    planes = np.stack([np.packbits((low >> np.uint32(j)) & np.uint32(1), axis=1) for j in range(B_BITS)], 1)
    return np.ascontiguousarray(planes).view(np.uint64)


def unpacked(signatures: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, B_BITS, ROWS * BANDS // 64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    with np.errstate(over="ignore"):
        key = np.zeros((len(low), BANDS), np.uint64)
        for r in range(ROWS):
            key = mix(key + low[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
        return mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signatures(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, "text"):
        words = split_words(batch.column("text"))
        values, first = shingles(words, SHINGLE_WORDS)
        count = np.diff(first)
        full = np.flatnonzero(count > 0)
        n = len(count)
        bands: list = [None] * n
        bits: list = [None] * n
        if len(full):
            starts = np.append(first[:-1][full], first[-1])
            low = minima(values, starts)
            key, planes = band_keys(low).view(np.int64), packed(low)
            for i, at in enumerate(full):
                bands[at], bits[at] = key[i], planes[i].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array(sequence_hash(words, 11).view(np.int64)),
                pa.array(count, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(bits, pa.binary()),
            ],
            ["doc_id", "text_hash", "id", "n_shingles", "bands", "bits"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, id (a 64-bit hash of the word sequence: one node for each), n_shingles, bands, bits (the packed low bits) of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(_signatures, _SIGNATURE)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: minima agree where no plane differs, which bits counts tell; corrected for those that agree by chance."""
    apart = np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=-2)).sum(-1, dtype=np.int64)
    chance = 2.0**-B_BITS
    return (1 - apart / (ROWS * BANDS) - chance) / (1 - chance)


def _promising(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if batch.num_rows:
            a, b = (unpacked(batch.column(c).to_pylist()) for c in ("bits_a", "bits_b"))
            yield batch.filter(pa.array(estimate(a, b) >= LEAST_ESTIMATE)).select(["a", "b"])


def _sets(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(rows, "text"):
        words = split_words(batch.column("text"))
        values, first = shingles(words, SHINGLE_WORDS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sequence_hash(words, 11).view(np.int64)), pa.LargeListArray.from_arrays(first, values.view(np.int64)).cast(pa.list_(pa.int64()))], ["id", "shingles"]
        )


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id (as signatures() gives it), shingles (distinct, as 64-bit hashes) of rows with a text."""
    return texts.mapInArrow(_sets, "id long, shingles array<long>")


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, shingles of wanted nodes (id), from the texts of the documents that stand for them."""
    rows = nodes.join(wanted, "id", "left_semi").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(rows, texts.doc_id.eqNullSafe(rows.doc_id), "left_semi").select("text")
    return written(shingle_sets(texts), "near-sets").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold (hundredths). nodes: id, n_shingles, bits, doc_id of each class."""
    sized = nodes.select("id", "n_shingles", "bits")
    sides = pairs.join(sized.toDF("a", "n_a", "bits_a"), "a").join(sized.toDF("b", "n_b", "bits_b"), "b")
    sides = sides.filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    near = written(sides.select("a", "b", "bits_a", "bits_b").mapInArrow(_promising, "a long, b long"), "near-promising")
    sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), nodes, docs)
    both = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * common >= threshold * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable) of nodes (id) under links (a, b), by least neighbouring labels and pointer jumps."""
    edges = written(links.union(links.select("b", "a")).filter("a <> b").distinct(), "near-edges")
    linked = written(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "near-labels")
    while True:
        around = edges.join(linked.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = linked.join(around, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = lower.join(jump, "label", "left").select("id", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        step = written(step, "near-labels")
        if step.filter("label <> was").isEmpty():
            break
        linked = step.select("id", "label")
    return nodes.select("id").join(linked, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _fits(a: dict, b: dict, i: int, threshold: int) -> np.ndarray:
    """Which rows of b may link row i of a to another component, by size and estimate."""
    fits = (b["label"] != a["label"][i]) & (100 * np.minimum(b["n"], a["n"][i]) >= threshold * np.maximum(b["n"], a["n"][i]))
    at = np.flatnonzero(fits)
    return at[estimate(b["bits"][at], a["bits"][i]) >= LEAST_ESTIMATE]


def _block_candidates(threshold: int):
    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The members of one pair of a bucket's blocks that have a candidate in it which no earlier band has."""
        sides = []
        for side in (0, 1):
            t = rows.filter(pc.equal(rows.column("side"), side))
            sides.append(
                {c: t.column(c).to_numpy() for c in ("id", "label", "n")}
                | {"bits": unpacked(t.column("bits").to_pylist()), "bands": np.array(t.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)}
            )
        a, b = (sides[0], sides[0]) if key[1].as_py() == key[2].as_py() else sides
        found: set[int] = set()
        for i in range(len(a["id"])):
            at = _fits(a, b, i, threshold)
            same = b["bands"][at] == a["bands"][i]
            at = at[b["bands"][at, same.argmax(1)] == key[0].as_py()] if len(at) else at
            if len(at):
                found.add(int(a["id"][i]))
                found.update(b["id"][at].tolist())
        ids = pa.array(sorted(found), pa.int64())
        return pa.table({"key": pa.array([key[0].as_py()] * len(ids), pa.int64()), "x": pa.array([key[1].as_py()] * len(ids), pa.int64()), "y": pa.array([key[2].as_py()] * len(ids), pa.int64()), "id": ids})

    return compare


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from products of incidence matrices over elements that sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(at, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], at[lo:hi] - low] = 1
        out += part @ part.T
    return out.round().astype(np.int64)


def _block_links(threshold: int):
    def link(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Links between components within one pair of blocks, no more than it takes to join them."""
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        sets = [np.asarray(x, np.int64) for x in rows.column("shingles").to_pylist()]
        sizes, common = np.array([len(x) for x in sets]), common_counts(sets)
        linked = (100 * common >= threshold * (sizes[:, None] + sizes - common)) & (labels[:, None] != labels)
        root = {x: x for x in labels.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            p, q = find(int(labels[i])), find(int(labels[j]))
            if p != q:
                root[p] = q
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return link


def rest_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links across components within each bucket (members: key, id, label), found and confirmed block by block."""
    # Sets of two classes that are not neighbours differ more in size than links allow.
    size_class = F.floor(F.ln("n") / math.log(100.1 / threshold)).cast("int")
    sized = members.join(nodes.select("id", F.col("n_shingles").alias("n"), "bits", "bands"), "id").withColumn("class", size_class)
    # A member's block, among those of its class in the bucket, is a hash of its id; blocks are as many as keep members and shingles of a block few.
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    counted = written(sized.groupBy("key", "class").agg(blocks), "near-blocks")
    number = lambda c, b: F.shiftleft(F.col(c).cast("long"), 32) + F.col(b)
    dealt = sized.join(counted, ["key", "class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("blocks")
    around = counted.select("key", F.col("class").alias("near"), "blocks", F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class"))
    with_all = dealt.join(around, ["key", "class"]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    with_all = with_all.withColumns({"own": number("class", "block"), "other": number("near", "b")})
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    sided = with_all.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side, "id", "label", "n", "bits", "bands")
    candidates = written(sided.groupBy("key", "x", "y").applyInArrow(_block_candidates(threshold), "key long, x long, y long, id long"), "near-candidates")
    sets = sets_of(candidates.select("id").distinct(), nodes, docs)
    labels = members.select("id", "label").distinct()
    return candidates.join(labels, "id").join(sets, "id").groupBy("key", "x", "y").applyInArrow(_block_links(threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 75, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group_id, text_hash for every row of docs (doc_id, text): links are pairs with
    100 * intersection >= threshold * union of their distinct shingles; component_id is the smallest doc_id reachable, group_id
    a number of the component that rows without ids have, too (null without words), text_hash xxhash64 of the text.

    rounds: how often a bucket's best-connected member is compared before what remains is compared in blocks. The work
    is done at once; the result is a table of its own, and the tables that led to it are removed.
    """
    with scratch(docs.sparkSession):
        return written(_near_duplicates(docs, threshold, rounds), "near-result", stays=True)


def _near_duplicates(docs: DataFrame, threshold: int, rounds: int) -> DataFrame:
    signed = written(signatures(docs), "near-signatures")
    worded = signed.filter("n_shingles > 0")
    same = [F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")]
    nodes = written(worded.groupBy("id").agg(F.min("doc_id").alias("doc_id"), *same), "near-nodes")
    banded = nodes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = written(banded.join(shared, "key"), "near-buckets")
    degree = buckets.groupBy("id").agg(F.sum("n").alias("degree"))
    buckets = written(buckets.join(degree, "id").select("key", "id", "degree"), "near-buckets")
    # Rows that repeat a doc_id link the nodes of their texts.
    repeated = worded.filter("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b")
    links = written(worded.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("id").alias("b")).filter("a <> b").distinct(), "near-links")
    labels = nodes.select("id", F.col("id").alias("label")) if links.isEmpty() else written(components(nodes, links), "near-components")
    for turn in range(rounds + 1):
        placed = buckets.join(labels, "id")
        top = F.max(F.struct("degree", "id", "label")).alias("top")
        split = written(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), top).filter("lo < hi").select("key", "top.*"), "near-split")
        if split.isEmpty():
            break
        hubs = split.select("key", F.col("id").alias("hub"), F.col("label").alias("hub_label"))
        if turn < rounds:
            star = placed.join(hubs, "key").filter("label <> hub_label")
            pairs = star.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
            found = confirmed(pairs, nodes, docs, threshold)
        else:
            found = rest_links(placed.join(hubs.select("key"), "key").select("key", "id", "label"), nodes, docs, threshold)
        links = links.union(written(found, "near-links"))
        labels = written(components(nodes, links), "near-components")
        # The next hub of a bucket is another member: one that was hub steps back.
        was = hubs.select("key", F.col("hub").alias("id"), F.lit(1).alias("was"))
        buckets = buckets.join(was, ["key", "id"], "left").select("key", "id", F.when(F.col("was").isNull(), F.col("degree")).otherwise(0).alias("degree"))
    named = nodes.select("id", "doc_id").join(labels, "id")
    component = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    of_node = named.join(component, "label").select("id", "least", F.col("label").alias("group_id"))
    joined = signed.join(of_node, "id", "left")
    component_id = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, component_id.isNull()).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("group_id")).alias("group_id"), "text_hash")
