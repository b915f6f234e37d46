r"""Best-fit packing by exact-complement hashing.

Packing works on the histogram of lengths, which has at most capacity entries however large the corpus is. From the
longest length down, the gap that it leaves is looked up among the sums of one, two and three available lengths; a
combination that fills the gap exactly is consumed as often as the counts allow. Where none exists, the longest length
that fits goes in (best fit) and the rest of the gap is looked up again. The result is a short list of patterns; pieces
are then dealt to patterns by their rank among the pieces of their length, a running count over a range partitioning,
with no data on the driver but the histogram and the patterns.

Defined cases. A null text is empty: its document is its end token alone. Repeated rows are packed as often as they
occur. A null doc_id is kept. A very long text is cut into full pieces and one shorter; it is tokenised whole, in the
memory that its tokens need. Pieces of one length (ties) are dealt by a hash of what they are; which of equal pieces
takes which place is left open. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc
import os
import threading
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import batches, running, scratch, widened, written
from stillflow.llm.token_counts import Memory, Pieces, is_plain, vocabulary_path

#: Pieces that the library is given as one text.
TOGETHER = 500
#: Seconds that a worker keeps its encoder without a task that asks for it.
IDLE = 3.0


class Encoder:
    """The library's ids of whole texts as little-endian 32-bit integers; pieces between single spaces are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.first, self.later = Memory(), Memory()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces, each with a space before it: many in one text, whose tokens that begin with a space begin the pieces."""
        out: list[bytes] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        for group, ids in zip(groups, self._ids([" " + " ".join(g) for g in groups]), strict=True):
            begins = (4 * np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])).tolist()
            parts = [ids[a:b] for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]
            out += parts if len(parts) == len(group) else self._ids([f" {p}" for p in group])
        return out

    def _learn(self, known: Memory, new: list[str], spaced: bool) -> None:
        plain = [p for p in new if is_plain(p)]
        known.learn(dict.fromkeys(new) | dict(zip(plain, (self._spaced_ids if spaced else self._ids)(plain), strict=True)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        self.first.age()
        self.later.age()
        pieces = Pieces.of(texts)
        opening = pieces.opening()
        self._learn(self.first, self.first.unknown(set(opening)), False)
        self._learn(self.later, self.later.unknown(set(pieces.distinct)), True)
        known = list(map(self.later.__getitem__, pieces.distinct))
        ids = np.frombuffer(b"".join(k or b"" for k in known), "<u4")
        size = np.array([0 if k is None else len(k) // 4 for k in known], np.int64)
        # Ids of all pieces but the opening ones, one after another.
        later = np.ones(len(pieces.index), bool)
        later[pieces.first[:-1]] = False
        each = np.where(later, size[pieces.index], 0)
        until = np.cumsum(each)
        begin = (np.cumsum(size) - size)[pieces.index]
        flat = ids[np.repeat(begin - (until - each), each) + np.arange(until[-1] if len(until) else 0)].tobytes()
        at = 4 * np.concatenate([[0], until])[pieces.first]
        # Texts with a piece whose neighbours matter go to the library whole.
        unfit = np.array([k is None for k in known], bool)[pieces.index] & later
        odd = np.add.reduceat(unfit, pieces.first[:-1], dtype=np.int64) > 0 if len(texts) else np.zeros(0, bool)
        out = []
        for i, piece in enumerate(opening):
            start = self.first[piece]
            odd[i] |= start is None
            out.append(b"" if odd[i] else start + flat[at[i] : at[i + 1]])
        which = np.flatnonzero(odd)
        for i, own in zip(which, self._ids(texts.take(pa.array(which)).to_pylist()), strict=True):
            out[i] = own
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    # Workers fill the cores: threads of the library's own would only wait for one another.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_ending: threading.Timer | None = None


def _forget() -> None:
    """Gives the encoder's memory, and what Arrow and the C library hold free, back to the machine."""
    _encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextmanager
def _held(path: str) -> Iterator[Encoder]:
    """The worker's encoder. Workers outlive the stage, so the encoder goes when no task of it has followed for IDLE seconds."""
    global _ending
    if _ending:
        _ending.cancel()
    try:
        yield _encoder(path)
    finally:
        _ending = threading.Timer(IDLE, _forget)
        _ending.daemon = True
        _ending.start()


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit, if kept) of each row's tokens and end_id.

    Only sequences over capacity are cut: the first piece takes the remainder, all others are full.
    """
    path = path or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _held(path) as encoder:
            for batch in batches(rows, "text"):
                which, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(pc.fill_null(batch.column("text"), ""))):
                    ids += end
                    n = len(ids) // 4
                    at, to = 0, n % capacity or min(n, capacity)
                    while at < n:
                        part = ids[4 * at : 4 * to]
                        which.append(i)
                        piece.append((at + capacity - 1) // capacity)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            kept.append(part)
                        at, to = to, to + capacity
                columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if keep_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class _Available:
    """Counts by length, with an index of the sums of one, two and three available lengths: in how many orders each comes about."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.count[length] = n
        self.lengths = np.flatnonzero(self.count)
        self.single, self.pair, self.triple = (np.zeros(capacity + 1, np.int64) for _ in range(3))
        self.single[self.lengths] = 1
        for a in self.lengths:
            self.pair[a:] += self.single[: capacity + 1 - a]
        for a in self.lengths:
            self.triple[a:] += self.pair[: capacity + 1 - a]

    def _remove(self, length: int) -> None:
        """Takes a length that is used up out of the index."""
        size = len(self.count)
        # Sums of two and three without it, by inclusion and exclusion of the orders in which it takes part.
        self.triple[length:] -= 3 * self.pair[: size - length]
        self.triple[2 * length :] += 3 * self.single[: max(0, size - 2 * length)]
        self.pair[length:] -= 2 * self.single[: size - length]
        if 2 * length < size:
            self.pair[2 * length] += 1
        if 3 * length < size:
            self.triple[3 * length] -= 1
        self.single[length] = 0
        self.lengths = self.lengths[self.lengths != length]

    def take(self, parts: list[int], times: int) -> None:
        for p in parts:
            self.count[p] -= times
        for p in {p for p in parts if self.count[p] == 0}:
            self._remove(p)

    def times(self, parts: list[int]) -> int:
        """How often parts can be consumed at once."""
        return min(int(self.count[p]) // parts.count(p) for p in set(parts))

    def exact(self, gap: int, used: list[int]) -> list[int] | None:
        """One, two or three available lengths that sum to gap, the longest first; used: what the pattern has consumed."""

        def fits(parts: list[int]) -> bool:
            return self.times(used + parts) > 0

        if self.single[gap] and fits([gap]):
            return [gap]
        below = self.lengths[self.lengths < gap][::-1]
        if self.pair[gap]:
            for a in below[self.single[gap - below] > 0]:
                if 2 * a < gap:
                    break
                if fits([int(a), int(gap - a)]):
                    return [int(a), int(gap - a)]
        if self.triple[gap]:
            for a in below[self.pair[gap - below] > 0]:
                if 3 * a < gap:
                    break
                rest = int(gap - a)
                second = self.lengths[(self.lengths < rest) & (self.lengths <= a)][::-1]
                for b in second[self.single[rest - second] > 0]:
                    if 2 * b < rest:
                        break
                    if fits([int(a), int(b), rest - int(b)]):
                        return [int(a), int(b), rest - int(b)]
        return None


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a sequence) and how often each is used; all counts are consumed."""
    left, plan = _Available(counts, capacity), []
    while len(left.lengths):
        pattern = [int(left.lengths[-1])]
        gap = capacity - pattern[0]
        while gap:
            if more := left.exact(gap, pattern):
                pattern += more
                break
            best = next((int(b) for b in left.lengths[left.lengths <= gap][::-1] if left.times([*pattern, int(b)])), 0)
            if not best:
                break
            pattern.append(best)
            gap -= best
        times = left.times(pattern)
        left.take(pattern, times)
        plan.append((pattern, times))
    return plan


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (with doc_id, piece, length, ids_crc32) and sequence_id, offset: every piece has its place in a sequence of at most capacity."""
    with scratch(pieces.sparkSession):
        return written(_pack(written(pieces, "packing-pieces"), capacity), "packing-result", stays=True)


def _pack(pieces: DataFrame, capacity: int) -> DataFrame:
    # At most capacity rows.
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan_patterns(counts, capacity):
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    # Sorted by (length, first rank): a piece belongs to the last row at or before it. Ranks run on from length to length.
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    begin = np.zeros(capacity + 2, np.int64)
    for length, n in counts.items():
        begin[length + 1] = n
    begin = np.cumsum(begin)
    firsts, kept = begin[table[:, 0]] + table[:, 1], pieces.columns

    def place(batches_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rank = batch.column("before__one").to_numpy()
            at = np.searchsorted(firsts, rank, "right") - 1
            columns = [batch.column(name) for name in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(table[at, 2] + rank - firsts[at]), pa.array(table[at, 3])], [*kept, "sequence_id", "offset"])

    keys = [F.col("length"), F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = running(pieces.withColumn("_one", F.lit(1).cast("long")), keys, ["_one"], "packing-ranks")
    return ranked.select(*pieces.columns, F.col("before__one").cast("long").alias("before__one")).mapInArrow(place, widened(pieces.schema, sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Tokens of docs (doc_id, text) as packed pieces: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(token_pieces(docs, capacity, end_id, path, keep_ids), capacity)
