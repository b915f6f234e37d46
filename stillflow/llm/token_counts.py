r"""Token counts by rank-synchronous array merging.

Byte-level BPE without a tokenizer library in the hot path: a text is cut into pre-tokens, the pre-tokens that a worker
has not met are held as one ragged numpy array of symbols, and every sequence's lowest-rank pair is merged at the same
time, round after round, until no pair of any sequence has a rank. What survives is the token count.

Pre-tokens never cross a single space between two solid characters, so the text is first cut there and whole pieces
are remembered: most pieces of a corpus repeat. A text with other white space beside a space takes the slower cut.

Defined cases. A null text counts as empty: 0 bytes, 0 tokens. The vocabulary's special string inside a text is one
token, as the library does by default. A very long text is counted whole, in the memory that its symbols need. Of equal
lowest pairs (ties) that overlap, the left ones merge, as the library does. Repeated rows are counted each; an empty
table gives an empty result. Columns other than text are passed through; added columns replace those of their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import batches, widened

#: Pieces that a worker remembers, and their longest: when half as many are new, those not met since the last such time are
#: forgotten; longer ones are forgotten at once.
REMEMBERED, LONGEST = 1_000_000, 64
VOCABULARY = "byte_bpe_50k.json"
UNKNOWN = -(1 << 40)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: its own, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ArrayMerger:
    """Counts symbols that are left after all merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.first = np.zeros(256, np.int64)
        for byte, letter in _byte_letters().items():
            self.first[byte] = vocab[letter]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        from public_tokenizers import PATTERN

        self.cut = regex.compile(PATTERN)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], self.none)

    def survivors(self, pretokens: list[bytes]) -> np.ndarray:
        """The number of symbols left of each pre-token."""
        size = np.array([len(p) for p in pretokens], np.int64)
        symbols = self.first[np.frombuffer(b"".join(pretokens), np.uint8)]
        out = size.copy()
        alive = np.flatnonzero(size > 1)  # sequences that may still merge
        owner = np.repeat(np.arange(len(size)), size)
        keep = np.isin(owner, alive)
        symbols, size = symbols[keep], size[alive]
        while len(alive):
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            rank = np.full(len(symbols), self.none, np.int64)
            rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
            rank[begin + size - 1] = self.none  # a pair never spans two sequences
            lowest = np.minimum.reduceat(rank, begin)
            hit = (rank == np.repeat(lowest, size)) & (rank < self.none)
            at = np.flatnonzero(hit)
            # Of overlapping equal pairs (aaa) every second one merges, from the left.
            run = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            size = np.add.reduceat(stay, begin, dtype=np.int64)
            out[alive] = size
            going = (lowest < self.none) & (size > 1)
            stay &= np.repeat(going, np.diff(np.append(begin, len(symbols))))
            symbols, alive, size = symbols[stay], alive[going], size[going]
        return out


@dataclass
class Pieces:
    """Texts cut at their spaces, each distinct piece once. index: of each piece among them; first: of each text's first piece, with the number of pieces at the end."""

    distinct: list[str]
    index: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Pieces:
        cut = pc.split_pattern(texts.cast(pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        return cls(coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)]))

    def opening(self) -> list[str]:
        """Each text's first piece; all others stand for a space and the piece."""
        return [self.distinct[i] for i in self.index[self.first[:-1]]]


def is_plain(piece: str) -> bool:
    """Whether a piece can be tokenised without its neighbours: no white space at either end."""
    return piece != "" and piece.strip() == piece


class Memory(dict):
    """What is known of pieces, in two generations: what is asked for moves to the younger one, which in time replaces the older.

    Between batches it holds at most about REMEMBERED pieces of at most LONGEST characters, so its bytes are bounded, too.
    """

    def __init__(self):
        self.older: dict = {}
        self.long: list[str] = []

    def __missing__(self, piece: str):
        self[piece] = value = self.older[piece]
        return value

    def learn(self, known: dict) -> None:
        self.update(known)
        self.long += [p for p in known if len(p) > LONGEST]

    def unknown(self, pieces: set[str]) -> list[str]:
        return list(pieces.difference(self).difference(self.older))

    def age(self) -> None:
        for piece in self.long:
            self.pop(piece, None)
        self.long.clear()
        if len(self) > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()


class Counter:
    def __init__(self, path: str):
        self.merger = ArrayMerger(path)
        self.first = Memory()  # of a text's first piece
        self.later = Memory()  # of others, with the space before them; None where neighbours matter

    def _learn(self, known: Memory, new: list[str], space: str) -> None:
        plain = [p for p in new if is_plain(p)]
        known.learn(dict.fromkeys(new) | dict(zip(plain, self.whole([space + p for p in plain]), strict=True)))

    def whole(self, texts: list[str]) -> list[int]:
        """Counts of texts with all their pre-tokens merged together."""
        m, seen, flat, owner, extra = self.merger, {}, [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = m.at_special.split(text) if m.at_special else [text]
            extra[i] = len(parts) - 1
            for part in parts:
                for token in m.cut.findall(part):
                    flat.append(seen.setdefault(token, len(seen)))
                    owner.append(i)
        if not flat:
            return extra.tolist()
        counts = m.survivors([t.encode() for t in seen])
        return (extra + np.bincount(owner, counts[flat], len(texts)).astype(np.int64)).tolist()

    def count(self, texts: pa.Array) -> np.ndarray:
        self.first.age()
        self.later.age()
        pieces = Pieces.of(texts)
        opening = pieces.opening()
        self._learn(self.first, self.first.unknown(set(opening)), "")
        self._learn(self.later, self.later.unknown(set(pieces.distinct)), " ")
        # Pieces whose neighbours matter count so much below 0 that their texts do, too.
        each = np.array([UNKNOWN if n is None else n for n in map(self.later.__getitem__, pieces.distinct)], np.int64)[pieces.index]
        each[pieces.first[:-1]] = [UNKNOWN if n is None else n for n in map(self.first.__getitem__, opening)]
        out = np.add.reduceat(each, pieces.first[:-1]) if len(texts) else np.zeros(0, np.int64)
        odd = np.flatnonzero(out < 0)
        out[odd] = self.whole(texts.take(pa.array(odd)).to_pylist())
        return out


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None) -> DataFrame:
    """docs without text, and n_bytes, n_tokens of it, over_limit (n_tokens > limit)."""
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    source = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches(rows, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(texts).cast(pa.int64())
            counts = pa.array(counter.count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sizes, counts], [*kept, "n_bytes", "n_tokens"])

    schema = widened(source.drop("text").schema, n_bytes="long", n_tokens="long")
    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
