"""Quality classifier by co-training of a text view and a metadata view.

Text view: which of the telling words and beginnings of words a document has, and the shape of its
text (shares of symbols, capitals, digits, spaces and line breaks, length of
words, share of distinct words, share of the most common one, size), in bins.
Words are those whose presence
tells of the label by more than chance among the labelled documents: a G-test
at 2 ln of the number of words tried, however many pass. Metadata view: source,
language and n_chars of the document's page. Each view is a logistic regression
with an L2 penalty.

Rounds: each view labels every unlabelled document of the corpus of which it is
confident; these labels join the other view's training rows, with at most the
weight of the labelled rows in all, so that the exchange is alike at every size. A step of
a fit is one pass over a staged table of the documents' features that adds up
the gradient; the labelled rows' curvature scales it. After the last round
each view is calibrated (Platt) on labelled documents that took no part in the
fits, and a logistic regression of both calibrated logits, fitted on the same,
combines them, drawn towards their sum less the prior's.

A document is bad if labels has quality 0 or toxic 1 for it, good if quality 1.
The first fit and the calibration take at most `labelled` labelled documents,
drawn by hashes of their ids, to the driver; the bound is a parameter. Every
document is scored, by its whole text, in one pass without a shuffle.

Result: (doc_id, text_score, meta_score, score, keep), scores being
probabilities of good.

Defined cases: a text that is NULL or has no token has score 0 and isn't kept;
NULL metadata are values of their own; rows without a doc_id are scored but not
reported, and kept by their score in `keep_good`; repeated rows are scored alike;
of repeated labels the worst counts, labels with NULLs in both columns don't;
without labels of both kinds every text with tokens has the share of good ones
(1 without any); missing metadata columns are as NULL, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLDED, bitmap_of, discard, member, mix, slices, staged, tokens, utf8

LABELLED, ROUNDS, STEPS, CONFIDENT, THRESHOLD = 10_000, 3, 3, 0.97, 0.5
LEAST_DOCS, BINS = 6, 16
SHAPES = 10
#: Longer words count by their first bytes too, so that inflected and compound ones are known.
PREFIXES = (6, 7, 8)
META = (("source", 256), ("lang", 64), ("n_chars", 32))


def _per_row(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(hit, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shapes, document row, word) of texts; rows and words, or beginnings of words, are distinct pairs, sorted by row."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    h, first, last, doc_of = tokens(data, offsets, fold=True)
    size = np.maximum(np.diff(offsets), 1)
    count = np.bincount(doc_of, minlength=n)
    some = np.maximum(count, 1)
    upper = _per_row((data >= 65) & (data <= 90), offsets)
    lower = _per_row((data >= 97) & (data <= 122), offsets)
    digit = _per_row((data >= 48) & (data <= 57), offsets)
    blank = _per_row(data <= 32, offsets)
    line = _per_row(data == 10, offsets)
    high = _per_row(data >= 128, offsets)
    word = (h >> np.uint64(32)).astype(np.uint64)
    by = np.argsort(doc_of.astype(np.uint64) << np.uint64(32) | word, kind="stable")
    d, w = doc_of[by], word[by]
    start = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (w[1:] != w[:-1]))) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(d)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[start], times)
    distinct = np.bincount(d[start], minlength=n)
    shapes = np.stack(
        [
            (size - upper - lower - digit - blank - high) / size,
            upper / np.maximum(upper + lower, 1),
            digit / size,
            blank / size,
            line / some,
            np.bincount(doc_of, last - first, n) / some,
            distinct / some,
            top / some,
            np.log2(size),
            np.where(count > 0, 1.0, 0.0),
        ],
        axis=1,
    )
    doc, word = [d[start]], [w[start]]
    code = FOLDED[data]
    for size in PREFIXES:
        longer = np.flatnonzero(last - first > size)
        h = np.full(len(longer), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[first[longer] + k]
        both = np.unique(doc_of[longer].astype(np.uint64) << np.uint64(32) | mix(h) >> np.uint64(32))
        doc.append((both >> np.uint64(32)).astype(np.int64))
        word.append(both & np.uint64(0xFFFFFFFF))
    doc, word = np.concatenate(doc), np.concatenate(word)
    by = np.argsort(doc, kind="stable")
    return shapes, doc[by], word[by]


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, 3) codes of source, language and binned n_chars."""
    out = []
    for name, size in META:
        if name not in batch.schema.names:
            out.append(np.zeros(batch.num_rows, np.int64))
            continue
        column = batch.column(name)
        if name == "n_chars":
            value = np.nan_to_num(np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float), nan=-1)
            out.append(np.where(value < 0, 0, np.minimum(1 + np.log2(np.maximum(value, 1)), size - 1)).astype(np.int64))
            continue
        coded = column.dictionary_encode()
        known = np.array([1 + zlib.crc32(str(x).encode()) % (size - 1) for x in coded.dictionary.to_pylist()] + [0], np.int64)
        code = coded.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(known[code])
    return np.stack(out, axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last being the intercept, by Newton's method; L2 penalty on
    the distance of all but the intercept from `start`, or from 0."""
    start = np.zeros(x.shape[1] + 1) if start is None else start
    w = start.copy()
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        curve, slope = np.diag(ridge), -ridge * (w - start)
        for at in range(0, len(x), 2000):
            part = x[at : at + 2000].astype(np.float64)
            part = np.hstack([part, np.ones((len(part), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            slope = slope + part.T @ (y[at : at + 2000] - p)
            curve += (part * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ part
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Rows of 0/1 features, as (row, feature) pairs."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int, width: int):
        self.row, self.feature, self.n, self.width = row, feature, n, width

    def logit(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.feature], self.n) + w[-1]

    def back(self, u: np.ndarray) -> np.ndarray:
        """The sum of u over the rows of each feature, and over all."""
        return np.append(np.bincount(self.feature, u[self.row], self.width), u.sum())

    def some(self, use: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[use] = np.arange(len(use))
        own = place[self.row] >= 0
        return Rows(place[self.row[own]], self.feature[own], len(use), self.width)

    def step(self, w: np.ndarray, slope: np.ndarray, ridge: np.ndarray, times: float = 1.0) -> np.ndarray:
        """Newton's step for a slope, with `times` the curvature of these rows, by conjugate gradients."""
        p = _sigmoid(self.logit(w))
        p = times * np.maximum(p * (1 - p), 1e-6)
        scale = 1 / (self.back(p) + ridge)
        x, r = np.zeros(len(w)), slope.copy()
        z = scale * r
        d, rz = z.copy(), float(r @ z)
        for _ in range(200):
            if rz < 1e-12:
                break
            curved = self.back(p * self.logit(d)) + ridge * d
            a = rz / float(d @ curved)
            x, r = x + a * d, r - a * curved
            z = scale * r
            d, rz = z + float(r @ z) / rz * d, float(r @ z)
        return x

    def fitted(self, y: np.ndarray, penalty: float, rounds: int = 30) -> np.ndarray:
        """Weights, the last being the intercept, of a logistic regression."""
        w, ridge = np.zeros(self.width + 1), _ridge(self.width, penalty)
        for _ in range(rounds):
            step = self.step(w, self.back(y - _sigmoid(self.logit(w))) - ridge * w, ridge)
            w = w + step
            if np.abs(step).max() < 1e-5:
                break
        return w


def _ridge(width: int, penalty: float) -> np.ndarray:
    return np.append(np.full(width, penalty), 1e-6)


class TextView:
    """Logistic regression on words and binned shapes."""

    penalty = 1.0

    def choose(self, shapes: np.ndarray, row: np.ndarray, word: np.ndarray, n: int, y: np.ndarray, use: np.ndarray) -> TextView:
        """The words and bins, from the rows `use` and their labels y."""
        place = np.full(n, -1)
        place[use] = np.arange(len(use))
        own = place[row] >= 0
        r, w = place[row[own]], word[own]
        kinds, at = np.unique(w, return_inverse=True)
        good = np.bincount(at, y[r], len(kinds))
        met = np.bincount(at, minlength=len(kinds)).astype(float)
        total, total_good = float(len(use)), float(y.sum())
        cells = ((good, met, total_good), (met - good, met, total - total_good), (total_good - good, total - met, total_good), (total - met - total_good + good, total - met, total - total_good))
        g = sum(2 * np.where(c > 0, c * np.log(np.maximum(c, 1e-9) * total / np.maximum(a * b, 1e-9)), 0) for c, a, b in cells)
        tried = met >= LEAST_DOCS
        self.words = kinds[tried & (g >= 2 * np.log(max(int(tried.sum()), 2)))].astype(np.uint64)
        self.bitmap = bitmap_of(self.words)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in shapes[use].T]
        self.base = len(self.words) + np.append(0, np.cumsum([len(e) + 1 for e in self.edges]))
        return self

    def rows(self, shapes: np.ndarray, row: np.ndarray, word: np.ndarray) -> Rows:
        known = member(word.astype(np.uint64, copy=False), self.words, self.bitmap)
        every = np.arange(len(shapes))
        bins = [self.base[i] + np.searchsorted(e, shapes[:, i], "left") for i, e in enumerate(self.edges)]
        r = np.concatenate([row[known], *[every] * len(bins)])
        f = np.concatenate([np.searchsorted(self.words, word[known]), *bins])
        return Rows(r, f, len(shapes), int(self.base[-1]))


class MetaView:
    """Logistic regression on metadata codes."""

    penalty = 4.0

    @staticmethod
    def rows(meta: np.ndarray) -> Rows:
        base = np.cumsum([0] + [size for _, size in META])
        return Rows(np.repeat(np.arange(len(meta)), len(META)), (meta + base[:-1]).ravel(), len(meta), int(base[-1]))


class Classifier:
    """Both views, their calibrations and the combination. `exchanged` has the
    confident labels of each round, those given to the text and to the metadata view."""

    share: float | None = None

    def __init__(self):
        self.exchanged: list[tuple[int, int]] = []

    def scores(self, shapes, row, word, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good: by text, by metadata, by both."""
        empty = shapes[:, -1] == 0
        if self.share is not None:
            out = np.where(empty, 0.0, self.share)
            return out, out, out
        t = self.text_scale[0] * self.text.rows(shapes, row, word).logit(self.text_weights) + self.text_scale[1]
        m = self.meta_scale[0] * MetaView.rows(meta).logit(self.meta_weights) + self.meta_scale[1]
        both = self.mix[0] * t + self.mix[1] * m + self.mix[2]
        return tuple(np.where(empty, 0.0, _sigmoid(z)) for z in (t, m, both))


def _confident(logit: np.ndarray, level: float) -> np.ndarray:
    """1 or 0 where sure, else -1."""
    p = _sigmoid(logit)
    return np.where(p >= level, 1, np.where(p <= 1 - level, 0, -1))


def slopes(rows: tuple[Rows, Rows], before: tuple, now: tuple, confident: float) -> list[tuple[np.ndarray, int]]:
    """(gradient, rows) of the text and of the metadata view, on the labels that
    the other one is confident of by its weights of before."""
    given = [_confident(r.logit(w), confident) for r, w in zip(rows, before)][::-1]
    out = []
    for r, w, y in zip(rows, now, given):
        u = np.where(y >= 0, y - _sigmoid(r.logit(w)), 0.0)
        out.append((r.back(u), int((y >= 0).sum())))
    return out


def cotrained(shapes: np.ndarray, row: np.ndarray, word: np.ndarray, meta: np.ndarray, label: np.ndarray, aside: np.ndarray, unlabelled=None, rounds: int = ROUNDS, steps: int = STEPS) -> Classifier:
    """label: 1 good, 0 bad; aside: rows for calibration only. unlabelled: a
    function of the text view that gives one of (weights before, weights now)
    which gives the `slopes` over all unlabelled documents."""
    out = Classifier()
    fit, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    if len(set(label[fit])) < 2 or len(set(label[held])) < 2:
        out.share = float(label.mean()) if len(label) else 1.0
        return out
    y = label[fit].astype(float)
    out.text = TextView().choose(shapes, row, word, len(label), y, fit)
    every = (out.text.rows(shapes, row, word), MetaView.rows(meta))
    own = [r.some(fit) for r in every]
    penalties = (TextView.penalty, MetaView.penalty)
    weights = [r.fitted(y, p) for r, p in zip(own, penalties)]
    ask = unlabelled(out.text) if unlabelled else None
    for _ in range(rounds if ask else 0):
        before, count = list(weights), (0, 0)
        for _ in range(steps):
            found = ask(before, weights)
            count = tuple(n for _, n in found)
            moved = 0.0
            for i, (slope, n) in enumerate(found):
                if n:
                    ridge = _ridge(own[i].width, penalties[i])
                    total = own[i].back(y - _sigmoid(own[i].logit(weights[i]))) + np.round(slope * min(1.0, len(y) / n), 9) - ridge * weights[i]
                    step = own[i].step(weights[i], total, ridge, 2.0)
                    weights[i], moved = weights[i] + step, max(moved, float(np.abs(step).max()))
            if moved < 1e-3:
                break
        out.exchanged.append(count)
        if not any(count):
            break
    out.text_weights, out.meta_weights = weights
    t, m = (r.logit(w) for r, w in zip(every, weights))
    y = label[held].astype(float)
    out.text_scale, out.meta_scale = (logistic(x[held][:, None], y) for x in (t, m))
    pair = np.stack([out.text_scale[0] * t[held] + out.text_scale[1], out.meta_scale[0] * m[held] + out.meta_scale[1]], axis=1)
    # Of views that are independent given the label, the logits less one prior add up.
    prior = np.log(y.mean() / (1 - y.mean()))
    out.mix = logistic(pair, y, start=np.array([1.0, 1.0, -prior]))
    return out


def _lists(rows: Rows) -> pa.Array:
    by = np.argsort(rows.row, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(rows.row, minlength=rows.n)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows.feature[by].astype(np.int32)))


def _rows_of(column: pa.Array, width: int) -> Rows:
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return Rows(np.repeat(np.arange(len(column)), size), column.flatten().to_numpy(), len(column), width)


def _coded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                found = text_features(part.column("text"))
                some = np.flatnonzero(found[0][:, -1])
                rows = pa.record_batch([part.column("doc_id"), _lists(shared.value.rows(*found)), _lists(MetaView.rows(meta_features(part)))], ["doc_id", "text", "meta"])
                yield rows.take(pa.array(some))

    return run


def _sloped(shared, confident: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = shared.value
        total = [(np.zeros(len(w)), 0) for w in now]
        for b in batches:
            rows = tuple(_rows_of(b.column(c), len(w) - 1) for c, w in zip(("text", "meta"), now))
            total = [(g + more, n + k) for (g, n), (more, k) in zip(total, slopes(rows, before, now, confident))]
        view = np.concatenate([np.full(len(g) + 1, i, np.int32) for i, (g, _) in enumerate(total)])
        feature = np.concatenate([np.arange(len(g) + 1, dtype=np.int32) for g, _ in total])
        value = np.concatenate([np.append(g, n) for g, n in total])
        some = np.flatnonzero(value)
        yield pa.record_batch([pa.array(view[some]), pa.array(feature[some]), pa.array(value[some])], ["view", "feature", "value"])

    return run


class Unlabelled:
    """The features of all documents without a label, as a staged table."""

    def __init__(self, docs: DataFrame, ids: DataFrame, text: TextView, confident: float):
        self.spark, self.confident = docs.sparkSession, confident
        every = docs.mapInArrow(_coded(self.spark.sparkContext.broadcast(text)), "doc_id bigint, text array<int>, meta array<int>")
        every = staged(every, "cotraining-features")
        self.rows = staged(every.join(ids, "doc_id", "left_anti").select("text", "meta"), "cotraining-unlabelled")
        discard(every)

    def __call__(self, before: list, now: list) -> list[tuple[np.ndarray, int]]:
        shared = self.spark.sparkContext.broadcast((before, now))
        found = self.rows.mapInArrow(_sloped(shared, self.confident), "view int, feature int, value double")
        found = found.groupBy("view", "feature").agg(F.sum("value").alias("value")).toPandas()
        out = []
        for i, w in enumerate(now):
            value = np.zeros(len(w) + 1)
            own = found[found["view"] == i]
            value[own["feature"].to_numpy()] = own["value"].to_numpy()
            out.append((value[:-1], int(value[-1])))
        shared.destroy()
        return out


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in slices(whole):
            shapes, row, word = text_features(part.column("text"))
            words = np.split(word.astype("<u4"), np.searchsorted(row, np.arange(1, part.num_rows)))
            yield pa.record_batch(
                [part.column("doc_id"), part.column("label"), pa.array([x.tobytes() for x in shapes.astype("<f8")], pa.binary()), pa.array([x.tobytes() for x in words], pa.binary()), pa.array([x.tobytes() for x in meta_features(part).astype("<i8")], pa.binary())],
                ["doc_id", "label", "shapes", "words", "meta"],
            )


def _view(docs: DataFrame) -> DataFrame:
    """The columns that count, with their types; missing metadata as NULL."""
    kinds = {"doc_id": "bigint", "text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.select(*((F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Classifier:
    """The classifier; its first fit takes a bounded sample by hash of doc_id."""
    ids = labels.select(*(F.col(c).cast("bigint").alias(c) for c in ("doc_id", "quality", "toxic"))).where("doc_id IS NOT NULL")
    ids = ids.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    bad, good = (F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 1
    ids = ids.withColumn("label", F.when(bad, 0).when(good, 1)).where("label IS NOT NULL")
    drawn = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id", "label")
    plain = _view(docs)
    # `labelled` bounds what is broadcast.
    chosen = plain.join(F.broadcast(drawn), "doc_id")
    got = chosen.mapInArrow(_sample_features, "doc_id bigint, label int, shapes binary, words binary, meta binary").toArrow()
    by = np.lexsort((np.array([zlib.crc32(x) for x in got.column("words").to_pylist()], np.int64), got.column("doc_id").to_numpy()))
    got = got.take(pa.array(by))
    n = got.num_rows
    read = lambda c, kind: np.frombuffer(b"".join(got.column(c).to_pylist()), kind)
    word = read("words", "<u4")
    row = np.repeat(np.arange(n, dtype=np.int32), np.array([len(x) // 4 for x in got.column("words").to_pylist()], np.int64))
    doc_id = got.column("doc_id").to_numpy()
    aside = (doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(4) == 0
    shapes, meta, label = read("shapes", "<f8").reshape(n, SHAPES), read("meta", "<i8").reshape(n, len(META)), got.column("label").to_numpy()
    del got
    held: list[Unlabelled] = []

    def unlabelled(text: TextView) -> Unlabelled:
        held.append(Unlabelled(plain.where("doc_id IS NOT NULL"), ids.select("doc_id"), text, confident))
        return held[0]

    out = cotrained(shapes, row, word, meta, label, aside, unlabelled, rounds)
    for x in held:
        discard(x.rows)
    return out


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                t, m, both = shared.value.scores(*text_features(part.column("text")), meta_features(part))
                yield pa.record_batch([part.column("doc_id"), pa.array(t), pa.array(m), pa.array(both), pa.array(both >= threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return run


def _keep(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                score = shared.value.scores(*text_features(part.column("text")), meta_features(part))[2]
                yield part.filter(pa.array(score >= threshold))

    return run


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row with a doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled, rounds))
    return _view(docs).where("doc_id IS NOT NULL").mapInArrow(_score(shared, threshold), "doc_id bigint, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled, rounds))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)
