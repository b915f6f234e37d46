r"""URL filters: gradient-boosted trees on lexical features, under explicit rules.

Everything that touches rows is DataFrame functions: host and path, the rules, the features (length, depth, digit
ratio, entropy, parameter counts, suffix statistics), their bins and the trees. Labelled URLs are those that a rule
judges; a bounded sample of them (MAX_LABELLED rows, by a hash of the URL) is counted by bins, and the counts, not the
rows, go to the driver, where the trees are grown. The trees are symmetric: every level of a tree asks one question, so
a tree is one array look-up by the bits of its answers and stays inside generated code.

Suffix statistics are those of every suffix in the sample, drawn to the base rate, so that a rare suffix tells little.

Defined cases. A null URL or one without :// has an empty host and path, fits no rule, and is judged by the trees on
its empty features. A very long URL is read whole. Without labels of both kinds the method allows all that no rule blocks;
of rules as long (ties) the last by name counts, of splits as good the first. Equal URLs are judged alike; repeated rows
are kept, and an empty table gives an empty result. Columns other than url are passed through; added columns replace
those of their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillflow.llm.common import scratch, written

#: Labelled URLs that trees are grown from, at most; suffix statistics have as many rows at most.
MAX_LABELLED = 200_000
#: URLs of the base rate that a suffix counts beside its own.
PRIOR = 10
TREES, LEVELS, RATE, BINS = 24, 3, 0.3, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "dashes", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    """host and all its subdomains, paths that start with path; verdict: block or allow."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(texts: Sequence[str]) -> list[Rule]:
    """Rules from texts like 'block example.net/de/8'."""
    out = []
    for text in texts:
        verdict, _, place = text.partition(" ")
        host, slash, path = place.partition("/")
        out.append(Rule(host, slash + path, verdict))
    return out


#: The rules of the registered query.
DEFAULT_RULES = parse_rules(["block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/"])


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """pages and host (A-Z lower-cased), path; both empty if the URL is null or has no ://."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest) + 1), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(raw, _UPPER, _LOWER), "path": path})


def rule_columns(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits host and path (ties: by name), or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def lexical_features(pages: DataFrame) -> DataFrame:
    """pages (with url, host, path) and the features of each URL, but for the suffix statistics: the column suffix."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    n = F.length(url)
    letters = F.split(url, "")
    entropy = F.aggregate(
        F.array_distinct(letters), F.lit(0.0), lambda sum_, c: sum_ - F.when(F.length(c) > 0, (n - F.length(F.replace(url, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(url, c, F.lit("")))) / n)).otherwise(0.0)
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": F.regexp_count("path", F.lit("[^/]+")).cast("double"),
            "digit_ratio": _ratio(F.regexp_count(url, F.lit("[0-9]")), n),
            "entropy": F.when(n > 0, entropy).otherwise(0.0),
            "parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("[^&;]+"))).otherwise(0).cast("double"),
            "labels": F.when(F.length("host") > 0, F.regexp_count("host", F.lit("[^.]+"))).otherwise(0).cast("double"),
            "dashes": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    )


@dataclass
class Forest:
    """suffixes: suffix, n, k (URLs and blocked ones of the sample); edges: of each feature's bins; trees: (questions, leaves),
    a question being (feature, bin): is the feature's bin beyond it?"""

    base_rate: float = 0.0
    suffixes: DataFrame | None = None
    edges: dict[str, list[float]] = field(default_factory=dict)
    base: float = -1.0
    trees: list[tuple[list[tuple[str, int]], list[float]]] = field(default_factory=list)

    def rated(self, seen: DataFrame) -> DataFrame:
        """seen (with suffix) and suffix_rate: the share of blocked URLs of the suffix."""
        if self.suffixes is None:
            return seen.withColumn("suffix_rate", F.lit(self.base_rate))
        rate = (F.col("k") + PRIOR * self.base_rate) / (F.col("n") + PRIOR)
        # The sample's bound is the table's.
        known = F.broadcast(self.suffixes.select("suffix", rate.alias("_rate")))
        return seen.join(known, "suffix", "left").withColumn("suffix_rate", F.coalesce("_rate", F.lit(self.base_rate))).drop("_rate")

    def score(self) -> Column:
        """Log-odds of block, of the features' columns."""
        out = F.lit(self.base)
        for questions, leaves in self.trees:
            at = F.lit(1)
            for bit, (name, b) in enumerate(questions):
                at = at + F.when(F.col(name) > self.edges[name][b], 1 << bit).otherwise(0)
            out = out + F.element_at(F.array(*(F.lit(x) for x in leaves)), at)
        return out


def grow(bins: np.ndarray, count: np.ndarray, blocked: np.ndarray, names: Sequence[str]) -> tuple[float, list[tuple[list[tuple[str, int]], list[float]]]]:
    """Symmetric trees by Newton boosting of the logistic loss. bins: of each distinct row; count, blocked: its URLs."""
    base = float(np.log((blocked.sum() + 0.5) / ((count - blocked).sum() + 0.5)))
    margin, trees = np.full(len(bins), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = count * p - blocked, count * p * (1 - p)
        leaf, questions = np.zeros(len(bins), np.int64), []
        for level in range(LEVELS):
            best = (0.0, None)
            for f in range(bins.shape[1]):
                for b in range(int(bins[:, f].max())):
                    cell = leaf + ((bins[:, f] > b) << level)
                    gs, hs = (np.bincount(cell, x, 2 << level) for x in (g, h))
                    gain = float((gs**2 / (hs + 1.0)).sum())
                    if best[1] is None or gain > best[0] + 1e-12:
                        best = (gain, (f, b))
            if best[1] is None:
                break
            f, b = best[1]
            leaf += (bins[:, f] > b) << level
            questions.append((names[f], b))
        size = 1 << len(questions)
        gs, hs = (np.bincount(leaf, x, size) for x in (g, h))
        leaves = -RATE * gs / (hs + 1.0)
        margin = margin + leaves[leaf]
        trees.append((questions, leaves.tolist()))
    return base, trees


def train(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, bound: int = MAX_LABELLED) -> Forest:
    """Trees from the URLs of pages that rules judge."""
    parts = with_host_and_path(pages.select("url"))
    labelled = parts.withColumn("verdict", rule_columns(rules)[1]).filter("verdict is not null")
    labelled = labelled.withColumn("blocked", (F.col("verdict") == "block").cast("long"))
    # A sample of at most about bound rows, by a hash of the URL: a share of the hashes' range.
    total = labelled.count()
    if total > bound:
        share = int(bound / total * 2**62)
        labelled = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(2**62)) < share)
    sample = lexical_features(labelled)
    suffixes = written(sample.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("k")), "url-suffixes")
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    if not n or not 0 < k < n:
        return Forest()
    forest = Forest(base_rate=k / n, suffixes=suffixes)
    rated = forest.rated(sample)
    steps = [i / BINS for i in range(1, BINS)]
    quantiles = rated.agg(*(F.percentile_approx(name, F.array(*(F.lit(x) for x in steps)), F.lit(1000)).alias(name) for name in FEATURES)).first()
    forest.edges = {name: sorted(set(quantiles[name])) for name in FEATURES}
    binned = rated.select("blocked", *(sum((F.when(F.col(name) > e, 1).otherwise(0) for e in forest.edges[name]), F.lit(0)).alias(name) for name in FEATURES))
    # At most as many rows as the sample has; as a rule far fewer.
    cells = binned.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("k")).orderBy(*FEATURES).collect()
    table = np.array([[r[name] for name in FEATURES] for r in cells], np.int64)
    forest.base, forest.trees = grow(table, np.array([r.n for r in cells], float), np.array([r.k for r in cells], float), FEATURES)
    return forest


def judge(pages: DataFrame, forest: Forest, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """pages and host, path, rule (its name, or null), verdict (the rule's, else the trees'), score (the trees' probability of block)."""
    added = [*FEATURES, "suffix"]
    source = pages.select(F.struct(*pages.columns).alias("_row"), F.col("url"))
    seen = forest.rated(lexical_features(with_host_and_path(source)))
    name, verdict = rule_columns(rules)
    scored = seen.withColumns({"_rule": name, "_verdict": verdict, "_margin": forest.score()}).drop(*added)
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    by_trees = F.when(F.col("_margin") >= 0, "block").otherwise("allow")
    return scored.select(*kept, "host", "path", F.col("_rule").alias("rule"), F.coalesce("_verdict", by_trees).alias("verdict"), (1 / (1 + F.exp(-F.col("_margin")))).alias("score"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, bound: int = MAX_LABELLED) -> DataFrame:
    """pages judged by the rules and by trees that are grown from what the rules say of them."""
    with scratch(pages.sparkSession):
        return written(judge(pages, train(pages, rules, bound), rules), "url-result", stays=True)
