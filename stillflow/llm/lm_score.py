r"""Language-model scores by Brown class-based n-grams.

Words are counted over all training texts. Every word that they hold LEAST times or more is put into a class by exchange
clustering: it moves to the class that raises the likelihood of the corpus' class bigrams most, sweep after sweep, until
sweeps raise it no further. Words that they hold less often stand for those that they do not hold: these and unseen
words are one class. A token's probability is the class transition from its predecessor's class times its emission in its
class, its share of the class' tokens; the class of rare words is discounted, which leaves room for as many unseen words
as it has seen. It is interpolated with the add-one unigram base.

The most frequent words are exchanged one after another on the driver first, which starts the classes. Then all clustered
words move against the class totals: each range of words holds its words' neighbours and their counts, and a sweep is a
pass over the ranges for the totals and one for the moves of every other word. Pairs with a most frequent word are kept
with their other word, so that no range holds the neighbours of a word that is everywhere.

The corpus is kept as columns: a task holds a slice of texts as one sorted array of distinct word hashes and one array
of places in it. Only the distinct hashes of a slice travel, dealt by ranges of hashes, as many as keep a range small; and
only their counts come back. The driver sees the bigrams of the most frequent words and a few sums, whose sizes are fixed
by parameters, and one byte for each clustered word, its class, which goes to the tasks. The least count is the same at
every size of the input; only a caller who names a largest number of clustered words has it rise until they fit. Beyond
2^31 clustered words, which their numbers cannot tell apart, the operator fails.

Defined cases. A null or empty text is its end token alone. A very long text is one slice, whole. A null doc_id counts as
the empty text in the fold. Repeated rows are separate texts. Of classes that raise the likelihood alike (ties) the first
counts; of words as frequent, those of smaller hashes start the classes. Without training texts (or rows) all words are
unknown and N and V are 0. An empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import batches, partitions, scratch, written
from stillflow.llm.words import split_words

FOLDS, HELD_OUT = 7, 2
#: Words that start the classes, classes, sweeps of exchanges of these words.
FREQUENT, CLASSES, SWEEPS = 500, 32, 6
#: Times that training texts hold a word that is clustered, at least; nats a token that two passes of moves must gain.
LEAST, GAIN = 2, 1e-4
#: Symbols and classes of their own: rare and unseen words, the end token.
RARE, STOP, FIXED = 0, 1, 2
DISCOUNT, BY_CLASS = 0.75, 0.9
#: Ranges of hashes for each shuffle partition, at least; distinct words of slices in a range, about.
RANGES, RANGE_WORDS = 2, 500_000
_SLICE = 4_000_000
#: Pairs that a task takes at once, and distinct ones that it gathers before it sends them: about 60 bytes each.
_PAIRS = 2_000_000
#: Counts that are told apart where the least one must rise.
_TOLD = 256

END = np.uint64(2**64 - 1)
_SLICES = "docs array<long>, lengths array<int>, words binary, trained binary, tokens binary"


def is_training(doc_id: int | None, folds: int = FOLDS, fold: int = HELD_OUT) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != fold


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token keys of the texts, one after another, and the number of each text's."""
    words = split_words(texts)
    return np.insert(np.minimum(words.hash, END - np.uint64(1)), words.first[1:], END), words.count + 1


def _slices(folds: int, fold: int):
    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "text", _SLICE):
            keys, lengths = tokens_of(batch.column("text"))
            words, tokens = np.unique(keys, return_inverse=True)
            docs = batch.column("doc_id").to_pylist()
            train = np.repeat([is_training(d, folds, fold) for d in docs], lengths)
            trained = np.bincount(tokens[train], minlength=len(words))
            blobs = [words.astype("<u8"), trained.astype("<u4"), tokens.astype("<u4")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([docs], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int32())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                ["docs", "lengths", "words", "trained", "tokens"],
            )

    return run


def _range_edges(n: int) -> np.ndarray:
    return np.array([(1 << 64) * i // n for i in range(n)], np.uint64)


def _deal(n: int):
    """A slice's distinct words and counts, by ranges of hashes."""
    edges = _range_edges(n)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                words, trained = np.frombuffer(batch.column("words")[k].as_py(), "<u8"), np.frombuffer(batch.column("trained")[k].as_py(), "<u4")
                at = np.append(np.searchsorted(words, edges), len(words))
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([batch.column("slice")[k].as_py()] * len(full), pa.int64()), *(pa.array([x[at[i] : at[i + 1]].tobytes() for i in full], pa.binary()) for x in (words, trained))],
                    ["range", "slice", "words", "trained"],
                )

    return run


def _count(frequent: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """For each slice the counts of its words and their numbers among the range's words, the most frequent first, or -1 for
        those held less than twice; and one row with the range's sums, its most frequent words, and how many words are held how often."""
        parts = [np.frombuffer(b, "<u8") for b in rows.column("words").to_pylist()]
        words, place = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(place, np.concatenate([np.frombuffer(b, "<u4") for b in rows.column("trained").to_pylist()]), len(words)).astype(np.int64)
        held = np.where(words == END, 0, counts)
        order = np.argsort(-held, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        number[held < 2] = -1
        of_slices = [np.split(x[place], np.cumsum([len(p) for p in parts])[:-1]) for x in (counts, number)]
        # Sum and number of known words, the end token's count, then the numbers of words by count.
        sums = np.concatenate([[counts.sum(), (counts > 0).sum(), counts[words == END].sum()], np.bincount(np.minimum(held, _TOLD), minlength=_TOLD + 1)]).astype("<i8")
        top = order[:frequent]
        top = top[held[top] > 0]
        n = len(parts)
        return pa.table(
            {
                "slice": pa.array([*rows.column("slice").to_pylist(), None], pa.int64()),
                "range": pa.array([key[0].as_py()] * (n + 1), pa.int32()),
                "counts": pa.array([*(c.astype("<i8").tobytes() for c in of_slices[0]), sums.tobytes()], pa.binary()),
                "numbers": pa.array([*(c.astype("<i4").tobytes() for c in of_slices[1]), None], pa.binary()),
                "top": pa.array([None] * n + [words[top].astype("<u8").tobytes() + counts[top].astype("<i8").tobytes()], pa.binary()),
            }
        )

    return run


class Symbols:
    """Frequent words as numbers: FIXED and on; all others are rare, but for the end token."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.words = words[self.order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.where(keys == END, STOP, RARE)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
            hit = self.words[at] == keys
            out[hit] = FIXED + self.order[at[hit]]
        return out


def _bigrams(symbols: Symbols, n: int, folds: int, fold: int):
    """Bigrams of symbols in training texts, row by row of the matrix; a text's first token follows an end token."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), np.int64)
        for batch in rows:
            for k in range(batch.num_rows):
                words, tokens = np.frombuffer(batch.column("words")[k].as_py(), "<u8"), np.frombuffer(batch.column("tokens")[k].as_py(), "<u4")
                docs, lengths = batch.column("docs")[k].as_py(), batch.column("lengths")[k].as_py()
                now = symbols.of(words)[tokens]
                before = np.concatenate([[STOP], now[:-1]])
                train = np.repeat([is_training(d, folds, fold) for d in docs], lengths)
                total += np.bincount((before * n + now)[train], minlength=n * n).reshape(n, n)
        full = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([total[i].astype("<i8").tobytes() for i in full], pa.binary())], ["row", "counts"])

    return run


def _add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, "<i8") for b in rows.column("counts").to_pylist())
    return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, fixed: int, classes: int, sweeps: int) -> np.ndarray:
    """Class of each symbol: the first fixed ones keep a class of their own, the others start spread over the next classes
    and move, one after another, to the class with the largest likelihood of class bigrams, until a sweep moves none or all
    sweeps are done."""
    n = len(bigrams)
    free = n - fixed
    of = np.concatenate([np.arange(fixed), fixed + np.arange(free) % max(1, min(classes, free))])
    size = fixed + min(classes, free)
    member = np.zeros((n, size))
    member[np.arange(n), of] = 1
    between = member.T @ bigrams @ member
    after, before = bigrams @ member, bigrams.T @ member  # of each symbol, counts by class
    for _ in range(sweeps):
        moved = 0
        for w in range(fixed, n):
            own, self_ = of[w], bigrams[w, w]
            r, c = after[w].copy(), before[w].copy()
            r[own] -= self_
            c[own] -= self_
            if not r.any() and not c.any() and not self_:
                continue
            between[own] -= r
            between[:, own] -= c
            between[own, own] -= self_
            # Totals of the classes with w counted as a neighbour, wherever it goes.
            rows, cols = between.sum(1) + c, between.sum(0) + r
            k = np.arange(fixed, size)
            gain = (_xlogx(between[k] + r) - _xlogx(between[k])).sum(1) + (_xlogx(between[:, k].T + c) - _xlogx(between[:, k].T)).sum(1)
            both = between[k, k]
            gain += _xlogx(both + r[k] + c[k] + self_) - _xlogx(both + r[k]) - _xlogx(both + c[k]) + _xlogx(both)
            out_w, in_w = r.sum() + self_, c.sum() + self_
            gain -= _xlogx(rows[k] + out_w) - _xlogx(rows[k]) + _xlogx(cols[k] + in_w) - _xlogx(cols[k])
            best = int(k[gain.argmax()])
            if gain[best - fixed] <= gain[own - fixed] + 1e-9:
                best = int(own)
            between[best] += r
            between[:, best] += c
            between[best, best] += self_
            if best != own:
                moved += 1
                of[w] = best
                for side, matrix in ((after, bigrams[:, w]), (before, bigrams[w])):
                    side[:, own] -= matrix
                    side[:, best] += matrix
        if not moved:
            break
    return of


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, byte by byte of all, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(blob: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).reshape(-1).view("<u4").astype(np.int64)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their times."""
    key, time = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, time = key[order], time[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(time, first) if len(first) else time


_NEIGHBOURS = "range int, side int, n long, word binary, near binary, times binary"


def _neighbours(n: int, offsets: np.ndarray, total: int, folds: int, fold: int):
    """Pairs of symbols in training texts with their counts, dealt to the range of the first (side 0) and of the second (side 1).

    A range has the symbols from its offset on. Pairs of two of the first n symbols go to range -1 - the first.
    """

    def rows_of(keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, time = _summed(keys, times)
        keys.clear()
        times.clear()
        time = time.astype(np.uint32)
        one, two = ((key // total).astype(np.uint32), (key % total).astype(np.uint32))
        del key
        for side, word, near in ((0, one, two), (1, two, one)):
            kept = np.flatnonzero((word >= n) | ((near < n) & (side == 0)))
            if side:
                kept = kept[np.argsort(word[kept], kind="stable")]  # of a word, its neighbours stay in order
            word, near, t = word[kept], near[kept], time[kept]
            at = np.searchsorted(offsets, word, "right") - 1
            at[word < n] = -1 - word[word < n].astype(np.int64)
            cuts = np.flatnonzero(np.diff(at, prepend=-1 - total, append=-1 - total))
            out = [(int(at[a]), side, int(b - a), *(_planes(x[a:b]) for x in (word, near, t))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["range", "side", "n", "word", "near", "times"])

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = [], []
        for batch in rows:
            for k in range(batch.num_rows):
                symbols, tokens = np.frombuffer(batch.column("symbols")[k].as_py(), "<i4"), np.frombuffer(batch.column("tokens")[k].as_py(), "<u4")
                train = np.repeat([is_training(d, folds, fold) for d in batch.column("docs")[k].as_py()], batch.column("lengths")[k].as_py())
                for at in range(0, len(tokens), _PAIRS):
                    now = symbols[tokens[max(0, at - 1) : at + _PAIRS]].astype(np.int64)
                    now = now if at else np.concatenate([[STOP], now])
                    key = (now[:-1] * total + now[1:])[train[at : at + _PAIRS]]
                    if not len(key):
                        continue
                    key, time = _summed([key], [np.ones(len(key), np.int64)])
                    if keys and sum(map(len, keys)) + len(key) > _PAIRS:
                        yield from rows_of(keys, times)
                    keys.append(key)
                    times.append(time)
        if keys:
            yield from rows_of(keys, times)

    return run


def _gather(total: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The pairs of a range, one row a side."""
        out = []
        for side in (0, 1):
            keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in rows.filter(pc.equal(rows.column("side"), side)).to_pylist():
                keys.append(_numbers(r["word"], r["n"]) * total + _numbers(r["near"], r["n"]))
                times.append(_numbers(r["times"], r["n"]))
            pair, time = _summed(keys, times)
            out.append((len(pair), *(_planes(x) for x in (*np.divmod(pair, total), time))))
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32())} | {f"{c}{side}": pa.array([out[side][i]], pa.int64() if c == "n" else pa.binary()) for side in (0, 1) for i, c in enumerate(("n", "word", "near", "times"))})

    return run


_GATHERED = "range int, n0 long, word0 binary, near0 binary, times0 binary, n1 long, word1 binary, near1 binary, times1 binary"


def _sides(batch: pa.RecordBatch, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [tuple(_numbers(batch.column(f"{c}{side}")[k].as_py(), batch.column(f"n{side}")[k].as_py()) for c in ("word", "near", "times")) for side in (0, 1)]


def _totals(n: int, size: int, classes):
    """Rows 0 to n - 1: what follows each of the first n symbols, and what is before it, by class; then the class bigrams. Pairs of two of the first n are left out."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.frombuffer(classes.value, np.uint8)
        out = np.zeros((n + size, 2 * size), np.int64)
        for batch in rows:
            for k in range(batch.num_rows):
                for side, (word, near, times) in enumerate(_sides(batch, k)):
                    own, other, hot = of[word].astype(np.int64), of[near].astype(np.int64), near < n
                    by_hot = np.bincount(near[hot] * size + own[hot], times[hot], n * size).reshape(n, size).astype(np.int64)
                    if side == 0:
                        out[:n, size:] += by_hot
                        out[n:, :size] += np.bincount(own * size + other, times, size * size).reshape(size, size).astype(np.int64)
                    else:
                        out[:n, :size] += by_hot
                        out[n:, :size] += np.bincount(other[hot] * size + own[hot], times[hot], size * size).reshape(size, size).astype(np.int64)
        full = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([out[i].astype("<i8").tobytes() for i in full], pa.binary())], ["row", "counts"])

    return run


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, self_: np.ndarray, between: np.ndarray, fixed: int) -> np.ndarray:
    """For each word the class from fixed on with the largest likelihood of class bigrams between, were it alone to move.

    own: its class now; after, before: its neighbours' counts by class, without the self_ times that it follows itself.
    """
    k = np.arange(fixed, len(between))
    here = own[:, None] == k
    gain = np.zeros((len(own), len(k)))
    for side, other, matrix in ((after, before, between), (before, after, between.T)):
        w, j = np.nonzero(side)
        if not len(w):
            continue
        x = side[w, j][:, None]
        # The word's own counts are taken out of its class's row and column.
        cell = np.ascontiguousarray(matrix[fixed:].T)[j] - here[w] * x
        mine = np.flatnonzero(own[w] == j)
        cell[mine] -= other[w[mine]][:, fixed:] + here[w[mine]] * self_[w[mine]][:, None]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[first]] += np.add.reduceat(_xlogx(cell + x) - _xlogx(cell), first)
    r, c, s = after[:, fixed:], before[:, fixed:], self_[:, None]
    both = np.diag(between)[fixed:] - here * (r + c + s)
    gain += _xlogx(both + r + c + s) - _xlogx(both + r) - _xlogx(both + c) + _xlogx(both)
    for whole, part in ((between.sum(1), after), (between.sum(0), before)):
        mass = part.sum(1, keepdims=True) + s
        rest = whole[fixed:] - here * mass
        gain -= _xlogx(rest + mass) - _xlogx(rest)
    best = gain.argmax(1)
    at = np.arange(len(own))
    stays = (own >= fixed) & (gain[at, best] <= gain[at, np.maximum(own - fixed, 0)] + 1e-9)
    return np.where(stays, own, best + fixed)


def _moves(classes, between: np.ndarray, begins: np.ndarray, turn: int | None):
    """The classes of each range's words after the words whose turn it is (all, without one) have moved. A range has the symbols from begins to the next."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size = np.frombuffer(classes.value, np.uint8), len(between)
        for batch in rows:
            for k in range(batch.num_rows):
                number = batch.column("range")[k].as_py()
                if number < 0:
                    continue
                begin, end = int(begins[number]), int(begins[number + 1])
                new, sides = of[begin:end].copy(), _sides(batch, k)
                for at in range(begin, end, 4000):
                    to = min(at + 4000, end)
                    tables, self_ = [], np.zeros(to - at)
                    for word, near, times in sides:
                        a, b = np.searchsorted(word, (at, to))
                        w, x, t = word[a:b] - at, near[a:b], times[a:b]
                        same = w + at == x
                        self_[w[same]] = t[same]
                        tables.append(np.bincount(w[~same] * size + of[x[~same]], t[~same], (to - at) * size).reshape(to - at, size))
                    moving = tables[0].any(1) | tables[1].any(1)
                    if turn is not None:
                        moving &= np.arange(at, to) % 2 == turn
                    m = np.flatnonzero(moving)
                    if len(m):
                        new[at - begin + m] = best_classes(new[at - begin + m].astype(np.int64), tables[0][m], tables[1][m], self_[m], between, FIXED)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([new.tobytes()], pa.binary())], ["range", "classes"])

    return run


def _likelihood(between: np.ndarray) -> float:
    return float(_xlogx(between).sum() - _xlogx(between.sum(0)).sum() - _xlogx(between.sum(1)).sum())


def _cluster(gathered: DataFrame, start: np.ndarray, begins: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each symbol, and the class bigrams, from the classes that they start with (that of rare words, for all but the first n)."""
    spark = gathered.sparkSession
    hot = np.zeros((n, n))
    for r in gathered.filter("range < 0").select("range", "n0", "near0", "times0").toLocalIterator():
        hot[-1 - r["range"], _numbers(r["near0"], r["n0"])] = _numbers(r["times0"], r["n0"])
    words = gathered.filter("range >= 0")

    def measured(of: np.ndarray, sent) -> tuple[np.ndarray, np.ndarray]:
        member = np.eye(size)[of[:n]]
        out = np.zeros((n + size, 2 * size))
        for r in words.mapInArrow(_totals(n, size, sent), "row int, counts binary").groupBy("row").applyInArrow(_add, "row int, counts binary").collect():
            out[r["row"]] = np.frombuffer(r["counts"], "<i8")
        out[:n, :size] += hot @ member
        out[:n, size:] += hot.T @ member
        return out[:n], out[n:, :size] + member.T @ hot @ member

    of, best, turn, gained = start, None, None, np.inf
    while True:
        sent = spark.sparkContext.broadcast(of.tobytes())
        around, between = measured(of, sent)
        if size == FIXED:  # no word starts a class
            sent.destroy()
            return of, between
        now = _likelihood(between)
        # All but the first n begin as rare words, which the first pass of moves leaves.
        if turn is not None and best is not None:
            gain, before = (now - best[0]) / max(1.0, between.sum()), gained
            if gain <= 0:
                sent.destroy()
                return best[1:]
            gained = gain
            if before + gain < GAIN:
                sent.destroy()
                return of, between
        if turn is not None:
            best = (now, of, between)
        moved = of.copy()
        # A byte for each clustered word, from all ranges at once: a pass of one range after another would take as long as there are ranges.
        for r in words.mapInArrow(_moves(sent, between, begins, turn), "range int, classes binary").collect():
            moved[begins[r["range"]] : begins[r["range"] + 1]] = np.frombuffer(r["classes"], np.uint8)
        sent.destroy()
        if turn is not None and n > FIXED:
            mine = np.arange(FIXED, n)[np.arange(FIXED, n) % 2 == turn]
            self_ = np.diag(hot)[mine]
            after, prior = around[mine, :size].copy(), around[mine, size:].copy()
            after[np.arange(len(mine)), of[mine]] -= self_
            prior[np.arange(len(mine)), of[mine]] -= self_
            moved[mine] = best_classes(of[mine].astype(np.int64), after, prior, self_, between, FIXED)
        of, turn = moved, 0 if turn is None else 1 - turn


class Model:
    """Probabilities of tokens from their counts, classes and predecessors' classes."""

    def __init__(self, transitions: np.ndarray, total: int, vocabulary: int):
        self.total, self.vocabulary = total, vocabulary
        self.transition = (transitions + 0.1) / (transitions.sum(1, keepdims=True) + 0.1 * len(transitions))
        # Every training token is once the second of a pair.
        self.tokens = np.maximum(transitions.sum(0), 1).astype(float)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.vocabulary + 1)

    def probability(self, counts: np.ndarray, classes: np.ndarray, before: np.ndarray) -> np.ndarray:
        share = np.where(classes == RARE, np.where(counts > 0, counts - DISCOUNT, DISCOUNT), counts) / self.tokens[classes]
        return BY_CLASS * self.transition[before, classes] * share + (1 - BY_CLASS) * self.base(counts)


def score(docs: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, frequent: int = FREQUENT, classes: int = CLASSES, least: int = LEAST, most: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    most: of clustered words, where a caller wants fewer than all that are held least times.
    """
    with scratch(docs.sparkSession):
        return written(_score(docs, folds, fold, frequent, classes, least, most), "lm-result", stays=True)


def _score(docs: DataFrame, folds: int, fold: int, frequent: int, classes: int, least: int, most: int | None) -> DataFrame:
    with scratch(docs.sparkSession):
        placed, total, vocabulary, begins, seeds = _place(docs, folds, fold, frequent, classes, least, most)
    # Symbols: the fixed ones, the most frequent words, then all clustered words by range.
    n, size, symbols = len(seeds), int(seeds.max()) + 1, int(begins[-1])
    of = np.concatenate([seeds.astype(np.uint8), np.full(symbols - n, RARE, np.uint8)])
    with scratch(docs.sparkSession):
        pairs = placed.select("docs", "lengths", "tokens", "symbols").mapInArrow(_neighbours(n, begins[:-1], symbols, folds, fold), _NEIGHBOURS)
        gathered = written(pairs.groupBy("range").applyInArrow(_gather(symbols), _GATHERED), "lm-neighbours")
        of, between = _cluster(gathered, of, begins, n, size)
    model = Model(between, total, vocabulary)
    class_of = docs.sparkSession.sparkContext.broadcast(of.tobytes())

    def scored(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes_of = np.frombuffer(class_of.value, np.uint8)
        for batch in rows:
            for k in range(batch.num_rows):
                docs_, lengths = batch.column("docs")[k].as_py(), np.array(batch.column("lengths")[k].as_py(), np.int64)
                at = np.frombuffer(batch.column("tokens")[k].as_py(), "<u4")
                classes_ = classes_of[np.frombuffer(batch.column("symbols")[k].as_py(), "<i4")][at].astype(np.int64)
                count, first = np.frombuffer(batch.column("counts")[k].as_py(), "<i8")[at], np.concatenate([[0], np.cumsum(lengths)[:-1]])
                before = np.concatenate([[STOP], classes_[:-1]])
                base, ours = np.log10(model.base(count)), np.log10(model.probability(count, classes_, before))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs_, pa.int64()),
                        "held_out": pa.array([not is_training(d, folds, fold) for d in docs_]),
                        "n_tokens": lengths,
                        "n_known": np.add.reduceat((count > 0).astype(np.int64), first),
                        "train_tokens": pa.array([model.total] * len(docs_), pa.int64()),
                        "base_score": np.add.reduceat(base, first),
                        "score": np.add.reduceat(ours, first),
                    }
                )

    return placed.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _least_count(held: np.ndarray, least: int, most: int) -> int:
    """The least count of clustered words: least, or what it takes that they are most at most. held: the number of words by count (the last: or more)."""
    at_least = np.cumsum(held[::-1])[::-1]
    while least < len(held) - 1 and at_least[least] > most:
        least += 1
    return least


def _place(docs: DataFrame, folds: int, fold: int, frequent: int, classes: int, least: int, most: int | None) -> tuple[DataFrame, int, int, np.ndarray, np.ndarray]:
    """Texts as symbols (the fixed ones, the most frequent words, then all clustered words by range), numbers of training tokens
    and words, where the symbols of each range begin, and the classes of the fixed symbols and the most frequent words."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = written(source.mapInArrow(_slices(folds, fold), _SLICES).withColumn("slice", F.monotonically_increasing_id()), "lm-slices")
    spread = slices.agg(F.sum(F.length("words"))).first()[0] or 0
    ranges = max(RANGES * partitions(docs), -(-spread // (8 * RANGE_WORDS)))
    dealt = slices.select("slice", "words", "trained").mapInArrow(_deal(ranges), "range int, slice long, words binary, trained binary")
    counted = written(dealt.groupBy("range").applyInArrow(_count(frequent), "slice long, range int, counts binary, numbers binary, top binary"), "lm-counts")
    # One row a range, each with at most so many words as start the classes, and the numbers of its words by count.
    total, held, candidates = np.zeros(3, np.int64), np.zeros((ranges, _TOLD + 1), np.int64), []
    for r in counted.filter("slice is null").select("range", "counts", "top").toLocalIterator():
        sums = np.frombuffer(r["counts"], "<i8")
        total += sums[:3]
        held[r["range"]] = sums[3:]
        n = len(r["top"]) // 16
        candidates.append((np.frombuffer(r["top"][: 8 * n], "<u8"), np.frombuffer(r["top"][8 * n :], "<i8")))
        if len(candidates) > 64:
            candidates = [_most(candidates, frequent)]
    least = max(2, least) if most is None else _least_count(held.sum(0), max(2, least), most)
    words, _ = _most(candidates, frequent)
    symbols, n = Symbols(words), FIXED + len(words)
    rows = slices.select("docs", "lengths", "words", "tokens").mapInArrow(_bigrams(symbols, n, folds, fold), "row int, counts binary").groupBy("row").applyInArrow(_add, "row int, counts binary")
    bigrams = np.zeros((n, n))
    for r in rows.collect():  # the matrix of the symbols' bigrams
        bigrams[r["row"]] = np.frombuffer(r["counts"], "<i8")
    seeds = exchange(bigrams, FIXED, classes, SWEEPS)
    clustered = held[:, least:].sum(1)
    begins = n + np.concatenate([[0], np.cumsum(clustered)])
    if begins[-1] >= 1 << 31:
        raise OverflowError(f"{begins[-1]} clustered words are more than their numbers can tell apart")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("range").to_numpy())
        counts, numbers = right.column("counts").to_pylist(), right.column("numbers").to_pylist()
        of_range = right.column("range").to_numpy()
        # The most frequent words of a range have its first numbers.
        number = np.concatenate([np.where(((x := np.frombuffer(numbers[i], "<i4")) >= 0) & (x < clustered[of_range[i]]), x + begins[of_range[i]], RARE) for i in order])
        known = symbols.of(np.frombuffer(left.column("words")[0].as_py(), "<u8"))
        symbol = np.where(known == RARE, number, known)
        blobs = {"counts": b"".join(counts[i] for i in order), "symbols": symbol.astype("<i4").tobytes()}
        return left.select(["docs", "lengths", "tokens"]).append_column("counts", pa.array([blobs["counts"]], pa.binary())).append_column("symbols", pa.array([blobs["symbols"]], pa.binary()))

    left, right = slices.select("slice", "docs", "lengths", "words", "tokens"), counted.filter("slice is not null").select("slice", "range", "counts", "numbers")
    placed = left.groupBy("slice").cogroup(right.groupBy("slice")).applyInArrow(place, "docs array<long>, lengths array<int>, tokens binary, counts binary, symbols binary")
    return written(placed, "lm-texts", stays=True), int(total[0]), int(total[1]), begins, seeds


def _most(candidates: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    words, counts = (np.concatenate([c[i] for c in candidates]) if candidates else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
    top = np.lexsort((words, -counts))[:n]
    return words[top], counts[top]
