"""URL filter: gradient-boosted trees on lexical features.

Features of a URL: its length, host length, host labels, hyphens and digits of
the host, path depth, path length, digit ratio, byte entropy of URL and host,
parameters, their bytes, fragment, scheme, and for the last two and the last
three labels of its host how many URLs of the table have them (logarithm) and
the smoothed share of bad ones among the labelled URLs that have them.

Labels come as a table (url, bad). `seeded` makes one of the pages themselves:
a URL is bad if its host has a word of a block list; it stands in where there
are no labels of URLs, and a filter trained on it learns that list again. The trees are fitted on
the driver to at most `labelled` rows, drawn by a hash of the URL (a documented
bound); the counts of suffixes cover every URL, their shares every labelled
one. In fitting, a row's shares are those of the other folds of the labelled
URLs: leaving out its own label alone would tell it. Trees of depth 3 split on at most 64
quantiles of a feature, by the gain of Newton's step on logistic loss.

Result: (page_id, score, blocked), a row for each row of pages.

Defined cases: NULL and empty URLs have score NULL and aren't blocked; a URL
without a scheme is a host and path; rows that repeat, or have no page_id, are
scored each; without labelled rows of both kinds every score is the share of
bad ones (0 without any), an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

LABELLED, THRESHOLD, FOLDS = 20_000, 0.5, 8
SEEDS = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "track", "viagra", "warez", "xxx")
NAMES = ("length", "host_length", "labels", "hyphens", "host_digits", "depth", "path_length", "digits", "entropy", "host_entropy", "params", "query_length", "fragment", "secure", "count2", "count3", "share2", "share3")
LEXICAL = len(NAMES) - 4


def host(url) -> F.Column:
    """The lower-case host of a URL column."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d*$|\.$", "")


def seeded(pages: DataFrame) -> DataFrame:
    """(url, bad) of every URL: whether a word of its host is in SEEDS."""
    words = F.split(host(F.col("url")), r"[^a-z0-9]+")
    return pages.select(F.col("url").cast("string").alias("url"), F.arrays_overlap(words, F.array(*map(F.lit, SEEDS))).cast("int").alias("bad"))


def _counts(hit: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(hit))
    return total[end] - total[start]


def _entropy(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bits per byte of the bytes of each span."""
    out = np.zeros(len(start))
    size = np.maximum(end - start, 1)
    row = np.repeat(np.arange(len(start)), end - start)
    at = np.repeat(start - np.append(0, np.cumsum(end - start))[:-1], end - start) + np.arange(len(row))
    key, n = np.unique(row * 256 + data[at], return_counts=True)
    p = n / size[key // 256]
    np.add.at(out, key // 256, -p * np.log2(p))
    return out


def lexical(column: pa.Array) -> np.ndarray:
    """(rows, LEXICAL) features; NULL is as ''."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    start, end = offsets[:-1], offsets[1:]
    at = np.arange(len(data))

    def first(hit: np.ndarray, since: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Where each span first has a hit; its end if nowhere."""
        spots = at[hit]
        k = np.searchsorted(spots, since)
        return np.minimum(np.append(spots, len(data))[k], until)

    colon = np.zeros(len(data), bool)
    if len(data) > 2:
        colon[:-2] = (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
    delimiter = (data == 47) | (data == 63) | (data == 35)
    scheme = first(colon, start, end)
    scheme = np.where((scheme < end) & (scheme < first(delimiter, start, end)), scheme, start)
    host0 = np.where(scheme > start, np.minimum(scheme + 3, end), start)
    host1 = first(delimiter, host0, end)
    fragment = first(data == 35, host1, end)
    query = first(data == 63, host1, fragment)
    digit = (data >= 48) & (data <= 57)
    size = np.maximum(end - start, 1)
    slashes = _counts(data == 47, host1, query)
    closing = (query > host1) & (np.append(data, 0)[np.maximum(query - 1, 0)] == 47)
    return np.stack(
        [
            end - start,
            host1 - host0,
            _counts(data == 46, host0, host1) + (host1 > host0),
            _counts(data == 45, host0, host1),
            _counts(digit, host0, host1),
            slashes - closing,
            query - host1,
            _counts(digit, start, end) / size,
            _entropy(data, start, end),
            _entropy(data, host0, host1),
            np.where(fragment > query, _counts(data == 38, query, fragment) + 1, 0),
            np.maximum(fragment - query - 1, 0),
            end > fragment,
            (scheme - start == 5),
        ],
        axis=1,
    ).astype(np.float64).reshape(n, LEXICAL)


class Boosted:
    """Gradient-boosted trees for a 0/1 target. `fit` is deterministic."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.penalty = trees, depth, rate, bins, penalty
        self.base, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = float(y.mean()) if len(y) else 0.0
        self.share = share
        if not 0 < share < 1:
            return self
        self.base = np.log(share / (1 - share))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                width = 1 << level
                best = np.zeros(width), np.full(width, -1), np.zeros(width)
                total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    flat = node * (len(e) + 1) + code[:, f]
                    left_g = np.bincount(flat, g, width * (len(e) + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                    left_h = np.bincount(flat, h, width * (len(e) + 1)).reshape(width, -1).cumsum(1)[:, :-1]
                    right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                    gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - (total_g**2 / (total_h + self.penalty))[:, None]
                    gain[(left_h < 0.1) | (right_h < 0.1)] = 0
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    more = value > best[0] + 1e-9
                    best[0][more], best[1][more], best[2][more] = value[more], f, e[at[more]]
                splits.append((best[1], best[2]))
                node = self._step(x, node, best[1], best[2])
            width = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, width) / (np.bincount(node, h, width) + self.penalty)
            self.forest.append((splits, leaf))
            score += leaf[node]
        return self

    @staticmethod
    def _step(x: np.ndarray, node: np.ndarray, feature: np.ndarray, edge: np.ndarray) -> np.ndarray:
        f = feature[node]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > edge[node])
        return node * 2 + right

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of 1."""
        if not self.forest:
            return np.full(len(x), self.share)
        score = np.full(len(x), self.base)
        for splits, leaf in self.forest:
            node = np.zeros(len(x), np.int64)
            for feature, edge in splits:
                node = self._step(x, node, feature, edge)
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


def _suffixes(df: DataFrame) -> DataFrame:
    labels = F.split(host(F.col("url")), r"\.")
    for n in (2, 3):
        df = df.withColumn(f"suffix{n}", F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))
    return df


def _stats(urls: DataFrame, labelled: DataFrame, n: int) -> DataFrame:
    """(suffix, count, bad, known) of the last n labels."""
    key = f"suffix{n}"
    every = urls.groupBy(key).agg(F.count("*").alias(f"count{n}"))
    known = labelled.groupBy(key).agg(F.sum("bad").alias(f"bad{n}"), F.count("*").alias(f"known{n}"))
    return every.join(known, key, "left").na.fill(0)


def _fold(url) -> F.Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS))


def _in_fold(labelled: DataFrame, n: int) -> DataFrame:
    """(suffix, fold, own_bad, own_known) of the last n labels."""
    return labelled.groupBy(f"suffix{n}", _fold(F.col("url")).alias("fold")).agg(F.sum("bad").alias(f"own_bad{n}"), F.count("*").alias(f"own_known{n}"))


def features(rows: pa.Table | pa.RecordBatch, prior: float, fitting: bool = False) -> np.ndarray:
    """The features of NAMES; in fitting, the shares are those of the other folds."""
    out = [lexical(rows.column("url") if isinstance(rows, pa.RecordBatch) else rows.column("url").combine_chunks())]
    number = lambda c: np.nan_to_num(rows.column(c).to_numpy(zero_copy_only=False).astype(float))
    counts = [np.log1p(number(f"count{n}")) for n in (2, 3)]
    shares = []
    for n in (2, 3):
        bad, known = number(f"bad{n}"), number(f"known{n}")
        if fitting:
            bad, known = bad - number(f"own_bad{n}"), known - number(f"own_known{n}")
        shares.append((bad + 2 * prior) / (known + 2))
    return np.concatenate([*out, np.stack([*counts, *shares], axis=1)], axis=1)


def _score(shared, prior: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "url"):
                score = shared.value.predict(features(part, prior))
                url = part.column("url")
                none = np.array([u is None or u == "" for u in url.to_pylist()], bool)
                yield pa.record_batch([part.column("page_id"), pa.array(score, mask=none), pa.array((score >= threshold) & ~none)], ["page_id", "score", "blocked"])

    return run


def filtered(pages: DataFrame, labels: DataFrame | None = None, labelled: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, score, blocked) of every page; see the module."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    labels = seeded(pages) if labels is None else labels.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad"))
    known = labels.where("url <> '' AND bad IS NOT NULL").distinct()
    sample = known.orderBy(F.xxhash64("url"), "url", "bad").limit(labelled)
    spark = pages.sparkSession
    held = sample.toArrow()
    sample = _suffixes(spark.createDataFrame(held)) if held.num_rows else _suffixes(spark.createDataFrame([], "url string, bad int"))
    urls = _suffixes(pages)
    known = _suffixes(known)
    stats = [_stats(urls.where("url <> ''"), known, n) for n in (2, 3)]
    train = sample.withColumn("fold", _fold(F.col("url")))
    for n, s in zip((2, 3), stats):
        train = train.join(s, f"suffix{n}", "left").join(_in_fold(known, n), [f"suffix{n}", "fold"], "left")
    train = train.drop("suffix2", "suffix3").orderBy("url", "bad").toArrow()
    bad = train.column("bad").to_numpy().astype(float)
    prior = float(bad.mean()) if len(bad) else 0.0
    model = Boosted().fit(features(train, prior, True) if len(bad) else np.zeros((0, len(NAMES))), bad)
    shared = spark.sparkContext.broadcast(model)
    for n, s in zip((2, 3), stats):
        urls = urls.join(s, f"suffix{n}", "left")
    return urls.drop("suffix2", "suffix3").mapInArrow(_score(shared, prior, threshold), "page_id bigint, score double, blocked boolean")
