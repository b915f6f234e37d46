r"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and digits or signs that stand for letters
become the letters they imitate, and all else becomes a space. The lexicon holds words and beginnings of words with
their log-odds, learned from labelled texts; exception phrases (given ones and word pairs that the labels show to be
harmless) mask the entries inside them. A text's evidence is the sum of the weights matched, divided by the logarithm
of its length; a logistic curve fitted on the same labelled texts makes it a score.

Labels are learned from a bounded sample (MAX_LABELLED rows, by a hash of doc_id) of the rows outside the held-out fold.
Features are counted where the texts are; only those that labels prove reach the driver.

Defined cases. A null or empty text has no evidence and gets the curve's lowest score. A very long text is matched whole,
in time that grows with its length. Labels that are null or other than 0 and 1, and labels of unknown documents, teach
nothing; where a doc_id has several, the largest counts, and where it has several texts, the first in code point order.
Features of equal weight (ties) are both entries; of matches that begin at one place the largest weight counts. Without
any labels of both kinds every score is 0. Rows are scored one by one, so repeated rows score alike; a null doc_id is
kept; an empty table gives an empty result. Columns other than text are passed through; added columns replace those of
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import batches, held_out, scratch, widened, written

FOLDS, HELD_OUT = 5, 0
#: Labelled rows that a model is learned from, at most.
MAX_LABELLED = 20_000
#: Beginnings of words that may be entries, by length.
STEMS = (4, 5, 6, 7)
#: How much likelier an entry is in a toxic text, at least.
LEAST_LIFT = 8.0

# Characters that imitate a Latin letter (Cyrillic, Greek, full-width forms follow from their code points).
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
# Digits, and signs between letters, that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Distinct features that a task gathers before it sends them.
_FEATURES = 1_000_000


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        char = chr(code).lower()
        if 0xFF01 <= code <= 0xFF5E:
            char = chr(code - 0xFEE0).lower()
        char = LOOKALIKES.get(char, SUBSTITUTES.get(char, char))
        self[code] = out = char if char.isalpha() else "" if char == "​" or char == "­" else " "
        return out


_FOLDING = _Folding()
_INNER_SIGN = re.compile(r"(?<=[^\W_])[@$!](?=[^\W_])")


def fold(text: str) -> str:
    """The text between single spaces at both ends, folded; words are set off by one or more spaces.

    Signs stand for letters between letters or digits only: elsewhere they are punctuation.
    """
    if any(sign in text for sign in SIGNS):
        text = _INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(_FOLDING)} "


def spaced(text: str) -> str:
    """The text folded, its words set off by single spaces: what evidence is learned and measured on."""
    return " ".join(["", *fold(text).split(), ""])


def features(folded: str) -> set[str]:
    """Possible entries of a folded text: ' word ' and ' stem'."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in STEMS if len(w) > k}


@dataclass(frozen=True)
class Model:
    """entries: (text with its leading space, weight); exceptions: phrases between spaces; score = 1 / (1 + exp(-(a + b * evidence)))."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    a: float = -math.inf
    b: float = 0.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if math.isinf(self.a):
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.a + self.b * evidence, -500, 500)))


class Matcher:
    def __init__(self, entries: Iterable[tuple[str, float]], exceptions: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None))
        for text, weight in entries:
            if text not in self.automaton:
                self.automaton.add_word(text, (len(text), weight))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Where words that match begin, and the largest weight of each; matches inside exception phrases are left out."""
        if not len(self.automaton):
            return []
        best: dict[int, float] = {}
        masked: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(folded):
            begin = end - length + 1
            if weight is None:
                masked.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        out, k, until = [], 0, -1
        masked.sort()
        for i, w in sorted(best.items()):
            while k < len(masked) and masked[k][0] <= i:
                until = max(until, masked[k][1])
                k += 1
            if i >= until:
                out.append((i, w))
        return out

    def evidence(self, folded: str) -> float:
        weight = sum(w for _, w in self.hits(folded))
        return weight / math.log(math.e + folded.count(" ")) if weight else 0.0


def _tally(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, pos, neg: in how many toxic and clean texts of a partition it is."""
    tally: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def sent() -> Iterator[pa.RecordBatch]:
        for side, counted in enumerate(tally):
            n = pa.array(list(counted.values()), pa.int64())
            none = pa.array([0] * len(counted), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), *((none, n) if side == 0 else (n, none))], ["feature", "pos", "neg"])
            counted.clear()

    for batch in rows:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            tally[toxic].update(features(fold(text or "")))
            if len(tally[0]) + len(tally[1]) > _FEATURES:
                yield from sent()
    yield from sent()


def surprise(pos: Column, neg: Column, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio of a feature's counts against the share of toxic texts."""
    share = toxic / (toxic + clean)
    part = lambda k, q: F.when(k > 0, k * F.ln(k / (pos + neg) / q)).otherwise(0.0)
    return 2 * (part(pos, share) + part(neg, 1 - share))


def _entries(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, float]]:
    """Features that labels prove beyond chance, heaviest first; one that extends a kept stem of like weight adds nothing."""
    # An entry needs so many toxic texts anyway.
    support = max(3, math.ceil(0.002 * toxic))
    counted = sample.mapInArrow(_tally, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= support)
    counted = written(counted, "toxicity-features")
    least = 2 * math.log(max(2, counted.count())) + 4
    pos, neg = F.col("pos"), F.col("neg")
    proven = counted.filter((pos / toxic / ((neg + 0.5) / clean) >= LEAST_LIFT) & (surprise(pos, neg, toxic, clean) >= least)).collect()
    weight = {r.feature: math.log(((r.pos + 0.5) / (toxic + 1)) / ((r.neg + 0.5) / (clean + 1))) for r in proven}
    kept: dict[str, float] = {}
    for f in sorted(weight, key=lambda f: (len(f), f)):
        word = f.rstrip()
        if not any(kept.get(word[: k + 1], 0.0) >= 0.5 * weight[f] for k in STEMS if k < len(f) - 1):
            kept[f] = weight[f]
    return sorted(kept.items(), key=lambda x: (-x[1], x[0]))


def _examine(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    """Of each text its label, its evidence, and the word pairs around its matches."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, exceptions)
        for batch in rows:
            evidence, pairs = [], []
            for text in batch.column("text").to_pylist():
                folded = spaced(text or "")
                found = set()
                for at, _ in matcher.hits(folded):
                    before, after = folded[:at].rsplit(" ", 1)[-1], folded[at + 1 :].split(" ", 2)
                    found |= {f" {before} {after[0]} ", f" {after[0]} {after[1]} " if len(after) > 2 else ""}
                evidence.append(matcher.evidence(folded))
                pairs.append(sorted(p for p in found if len(p.split()) == 2))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array(evidence, pa.float64()), pa.array(pairs, pa.list_(pa.string()))], ["toxic", "evidence", "pairs"])

    return run


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic fit by Newton steps, with a light pull of the slope to 0."""
    x, y = np.column_stack([np.ones(len(evidence)), evidence]), toxic.astype(float)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + [0, 0.01 * w[1]]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.01])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold_held_out: int = HELD_OUT, bound: int = MAX_LABELLED, exceptions: Sequence[str] = ()) -> Model:
    """A model of the labels (doc_id, toxic) of docs (doc_id, text) outside the held-out fold. exceptions: harmless phrases known beforehand."""
    with scratch(docs.sparkSession):
        return _train(docs, labels, folds, fold_held_out, bound, exceptions)


def _train(docs: DataFrame, labels: DataFrame, folds: int, fold_held_out: int, bound: int, exceptions: Sequence[str]) -> Model:
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out("doc_id", folds, fold_held_out))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # The bound holds for texts: ids that documents do not have are left out before it applies.
    known = usable.join(texts.select("_id"), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(bound)
    sample = written(texts.join(F.broadcast(known), "_id").groupBy("_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "toxicity-sample")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model()
    entries = tuple(_entries(sample, counts[1], counts[0]))
    given = tuple(f" {' '.join(fold(p).split())} " for p in exceptions)
    seen = sample.mapInArrow(_examine(entries, given), "toxic long, evidence double, pairs array<string>")
    pairs = seen.select("toxic", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    # Pairs that hold an entry, so often clean and never toxic: the sample's bound bounds them, too.
    harmless = pairs.filter("n >= 3 and pos = 0").orderBy("pair")
    phrases = given + tuple(r.pair for r in harmless.collect())
    rows = sample.mapInArrow(_examine(entries, phrases), "toxic long, evidence double, pairs array<string>").select("toxic", "evidence").collect()
    return Model(entries, phrases, *_curve(np.array([r.evidence for r in rows]), np.array([r.toxic for r in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, and score (0 to 1), predicted (1 if score >= 0.5) of it."""
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    source = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.entries, model.exceptions)
        for batch in batches(rows, "text"):
            evidence = np.array([matcher.evidence(spaced(t or "")) for t in batch.column("text").to_pylist()])
            scores = model.score(evidence)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    return source.mapInArrow(run, widened(source.drop("text").schema, score="double", predicted="integer"))
