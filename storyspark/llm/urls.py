"""URL filters: rules by host and path first, then gradient-boosted trees on lexical features.

A URL becomes some twenty numbers: lengths, depths, shares of digits, entropies, counts of parameters and hyphens,
and what the labelled URLs say of its suffix. Trees of bounded depth are grown one after another on the gradient of
the logistic loss, each split by the best gain over a histogram of quantiles. The labelled rows are bounded in
number, so the model doesn't grow with the data; every URL is judged where it lies.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .labelled_urls import ALLOWED, BLOCKED

#: Labelled URLs learned from, per verdict at most: the documented bound of the training sample.
SAMPLE_ROWS = 20_000
#: Parts of the labelled URLs that describe the suffixes of each other.
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path, as written)
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to a slash, question mark, hash sign or the end, A-Z lower-cased; path: from there up to a
    question mark, hash sign or the end. Both are empty for null and for a URL without ://."""
    after = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, r"(?s)\A.*?://", ""), "#", 1)).otherwise("")
    plain = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(plain, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(plain, F.length(host) + 1, F.length(plain))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (as written) and its verdict; both null where none does. A rule host/path fits
    its host and all subdomains where the URL's path starts with the rule's; of equally long ones the first by
    its letters counts. rules are a parameter of some hundreds at most: each is one test of a row."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own_host, slash, rest = text.partition("/")
        own_host = own_host.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == own_host) | F.endswith(host, F.lit(f".{own_host}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


SPLIT = re.compile(r"(?s)\A.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z")
FEATURES = (
    "url_length host_length path_length query_length host_labels path_depth longest_label longest_part host_digits path_digits query_digits host_hyphens "
    "path_hyphens host_entropy path_entropy host_vowels longest_consonants parameters marks_of_escape has_fragment secure suffix_blocked suffix_known"
).split()
CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]+")


def _share(text: str, which: str) -> float:
    return sum(map(text.count, which)) / len(text) if text else 0.0


def _entropy(text: str) -> float:
    """Bits a character."""
    if not text:
        return 0.0
    counts = np.array([text.count(c) for c in set(text)])
    share = counts / len(text)
    return float(-(share * np.log2(share)).sum()) + 0.0


def suffix_of(url: str | None) -> str:
    found = SPLIT.match(url or "")
    return found[1].lower().rpartition(".")[2] if found else ""


def lexical(url: str | None) -> list[float]:
    """All features but the suffix's two; a URL without :// has an empty host."""
    url = url or ""
    found = SPLIT.match(url)
    host, path, query, fragment = (x or "" for x in found.groups()) if found else ("", "", "", "")
    host = host.lower()
    labels, parts = [x for x in host.split(".") if x], [x for x in path.split("/") if x]
    digits = "0123456789"
    return [
        len(url), len(host), len(path), len(query), len(labels), len(parts), max(map(len, labels), default=0), max(map(len, parts), default=0), _share(host, digits),
        _share(path, digits), _share(query, digits), host.count("-"), path.count("-"), _entropy(host), _entropy(path), _share(host, "aeiouy"),
        max((len(x) for x in CONSONANTS.findall(host)), default=0), len([x for x in re.split("[&;]", query) if x]), url.count("%"), float(bool(fragment)), float(url[:6].lower() == "https:"),
    ]


class Suffixes:
    """How often labelled URLs of a suffix are blocked, drawn towards the share of all by PRIOR more of them."""

    PRIOR = 4.0

    def __init__(self, labelled: list[tuple[str, int]]):
        self.counts: dict[str, list[int]] = {}  # blocked, all
        for url, bad in labelled:
            own = self.counts.setdefault(suffix_of(url), [0, 0])
            own[0] += bad
            own[1] += 1
        self.share = sum(bad for _, bad in labelled) / max(1, len(labelled))

    def features(self, suffix: str) -> list[float]:
        bad, n = self.counts.get(suffix, (0, 0))
        return [(bad + self.PRIOR * self.share) / (n + self.PRIOR), float(np.log1p(n))]


@dataclass
class Trees:
    """Gradient-boosted trees of the logistic loss. A tree is complete: node i has the children 2i + 1 and 2i + 2."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    ridge: float = 1.0
    least: float = 1.0
    bins: int = 64
    start: float = 0.0
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [self._limits(c) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            self.grown.append(tree)
            margin += self._walk(tree, x)
        return self

    def _limits(self, column: np.ndarray) -> np.ndarray:
        """Where the column can be split: midway between neighbouring values, at most one for each bin's rows."""
        values = np.unique(column)
        middle = (values[:-1] + values[1:]) / 2
        if len(middle) >= self.bins:
            cut = np.unique(np.searchsorted(values, np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")))
            middle = middle[cut[cut < len(middle)]]
        return middle

    def _grow(self, binned, edges, gradient, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = (1 << self.depth) - 1
        which, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        value, node = np.zeros(inner + 1), np.zeros(len(gradient), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            g, h = gradient[own], weight[own]
            best, size = 1e-9, self.bins + 1
            for f in range(binned.shape[1]):
                gs, hs = (np.cumsum(np.bincount(binned[own, f], v, size)) for v in (g, h))
                gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge) - gs[-1] ** 2 / (hs[-1] + self.ridge)
                gain[(hs < self.least) | (hs[-1] - hs < self.least)] = 0
                gain = gain[: len(edges[f])]
                if len(gain) and gain.max() > best:
                    at = int(gain.argmax())
                    best, which[k], limit[k] = gain[at], f, edges[f][at]
            right = binned[own, which[k]] > (np.searchsorted(edges[which[k]], limit[k]) if np.isfinite(limit[k]) else self.bins)
            node[own] = 2 * k + 1 + right
        for leaf in range(inner + 1):
            own = node == inner + leaf
            value[leaf] = -self.rate * gradient[own].sum() / (weight[own].sum() + self.ridge)
        return which, limit, value

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        which, limit, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > limit[node])
        return value[node - len(which)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1."""
        margin = np.full(len(x), self.start)
        for tree in self.grown:
            margin += self._walk(tree, x)
        return 1 / (1 + np.exp(-margin))


class UrlModel:
    """Features and trees of labelled URLs (url, blocked 0 or 1)."""

    def __init__(self, labelled: list[tuple[str, int]], **options):
        self.suffixes = Suffixes(labelled)
        # in training a URL's suffix is described by the other folds only, so that no label speaks for itself
        fold = [zlib.crc32((u or "").encode("utf-8", "surrogatepass")) % FOLDS for u, _ in labelled]
        others = [Suffixes([x for x, f in zip(labelled, fold, strict=True) if f != k]) for k in range(FOLDS)]
        x = np.array([lexical(u) + others[f].features(suffix_of(u)) for (u, _), f in zip(labelled, fold, strict=True)], float)
        self.trees = Trees(**options).fit(x, np.array([bad for _, bad in labelled], float))

    def blocked(self, urls: list[str | None]) -> np.ndarray:
        """Probability that each is to be blocked."""
        if not urls:
            return np.zeros(0)
        known = {s: self.suffixes.features(s) for s in {suffix_of(u) for u in urls}}
        return self.trees.predict(np.array([lexical(u) + known[suffix_of(u)] for u in urls], float))


def train(labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS, **options) -> UrlModel:
    """A model of labelled (url, blocked 0 or 1); of the labelled URLs of this package where there is none.

    At most sample_rows rows of each label are learned from, those with the smallest hash of the URL. Rows without a URL
    or a label are left out, repeated rows count once. Labels of one kind only give a model that always says it."""
    if labelled is None:
        return UrlModel([(u, 0) for u in ALLOWED] + [(u, 1) for u in BLOCKED], **options)
    rows = labelled.select(F.col("url").cast("string").alias("url"), F.col("blocked").cast("int").alias("blocked")).where("url IS NOT NULL AND blocked IN (0, 1)").distinct()
    picked = []
    for label in (0, 1):
        own = rows.where(F.col("blocked") == label).orderBy(F.xxhash64("url"), "url").limit(sample_rows)
        picked += [(r["url"], label) for r in own.collect()]
    if not picked:
        raise ValueError("there are no labelled URLs")
    return UrlModel(sorted(picked), **options)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: UrlModel | None = None, key: str = "page_id", limit: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, score of every row of pages (key, url).

    A rule's verdict (allow or block) holds where one fits; rule is null elsewhere, and the verdict block where the
    model's score, the probability of being blocked, is over limit. Null URLs and those without :// have an empty host and
    path, which no rule fits, and are judged by the model like any other. Rows that repeat are judged alike, a null
    key stays, an empty table gives no rows; other columns are ignored. Urls of any length are read whole."""
    model = model or train()

    def run(batches):
        for b in batches:
            urls = b.column(1).to_pylist()
            scores = np.concatenate([model.blocked(urls[i : i + 4096]) for i in range(0, len(urls), 4096)]) if urls else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], ["key", "url", "score"])

    kind = pages.schema[key].dataType
    scored = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url")).mapInArrow(run, f"key {kind.simpleString()}, url string, score double")
    host, path = host_and_path(F.col("url"))
    placed = scored.select(F.col("key").alias(key), host.alias("host"), path.alias("path"), "score")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return placed.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"), "score")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
