"""MinHash near-dedup with HyperMinHash registers.

Each document's set of folded word 3-grams is spread over 256 buckets by the
top bits of one 64-bit hash. A bucket's register keeps, of its smallest hash,
the count of leading zeros (6 bits) and the 10 bits that follow the leading
one: 16 bits a bucket. Four registers make one 64-bit band key; 64 bands.

Steps:
1. one pass over the texts writes (doc_id, set digest, size, registers, keys of
   the bands);
2. documents of one set (digest and size) collapse into their least doc_id;
3. all documents that share a band key with the least doc_id of that key are
   candidates; their Jaccard estimate, corrected for the register collisions
   expected of disjoint sets, discards those that are `SIGMAS` standard errors
   below the threshold (one true pair in a billion; the fewer registers two
   short documents use, the wider the error, and at 36 none is discarded); the
   exact Jaccard of the shingle sets decides;
4. connected components; then the pairs of every band key whose documents
   are still in different components are tested in the same way, so that the
   result is that of testing all pairs of every band key, without the
   quadratic work inside large groups of copies;
5. the least doc_id of each component stays.

A set, a band key or a node that a third of all rows share is aggregated before
the shuffle; its rows get the result by a join, whose skewed side Spark splits.

Defined cases: NULL text is ''; documents without a token and rows without a
doc_id form no group; rows that repeat a doc_id are one document, the first of
them by all columns as JSON; any other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD_BREAK_SQL, discard, mix, slices, spans_hash, staged, tokens, utf8

BUCKETS, SHIFT, LOW, MANTISSA, ROWS = 256, 8, 44, 10, 4
EMPTY = np.uint16(65535)
THRESHOLD, SHINGLE, SIGMAS = 0.5, 3, 6

_rng = np.random.default_rng(20240229)
_PROBES = [_rng.integers(0, BUCKETS, BUCKETS) for _ in range(24)]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int):
    """(document row, 52-bit shingle hash), sorted and distinct. A document of
    fewer than `size` tokens has one shingle, all its tokens."""
    h, _, _, doc = tokens(data, offsets, fold=True)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    start = np.cumsum(count) - count
    first = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :]) if len(doc) >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    value = np.concatenate([spans_hash(h, first, size), spans_hash(h, start[short], count[short])]) >> np.uint64(12)
    row = np.concatenate([doc[first], short])
    out = []
    for lo in range(0, len(offsets) - 1, 4096):
        own = (row >= lo) & (row < lo + 4096) if len(offsets) > 4097 else slice(None)
        key = np.sort((row[own] - lo).astype(np.uint64) << np.uint64(52) | value[own])
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        out.append(((key >> np.uint64(52)).astype(np.int64) + lo, key & np.uint64((1 << 52) - 1)))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def registers(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """(n, 256) registers of sorted (row, 52-bit hash) pairs."""
    sig = np.full((n, BUCKETS), EMPTY, np.uint16)
    if len(row):
        bucket = (value >> np.uint64(LOW)).astype(np.int64)
        slot = row * BUCKETS + bucket
        least = np.append(True, slot[1:] != slot[:-1])
        v = (value[least] & np.uint64((1 << LOW) - 1)).astype(np.float64)
        part, exponent = np.frexp(v)
        zeros = np.where(v > 0, LOW - exponent, LOW)
        bits = np.where(v > 0, (part * 2 - 1) * (1 << MANTISSA), 0).astype(np.int64)
        sig.reshape(-1)[slot[least]] = (zeros << MANTISSA | bits).astype(np.uint16)
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """(n, 64) keys of the bands, unlike for unlike bands. An empty register borrows that of another bucket, in
    an order of buckets drawn once for each bucket, so that bands of short
    documents don't hang on one shingle."""
    full = sig.copy()
    for probe in _PROBES:
        rows, cols = np.nonzero(full == EMPTY)
        if not len(rows):
            break
        full[rows, cols] = sig[rows, probe[cols]]
    for _ in range(BUCKETS):
        rows, cols = np.nonzero(full == EMPTY)
        if not len(rows):
            break
        full[rows, cols] = full[rows, (cols + 1) % BUCKETS]
        if (sig[np.unique(rows)] == EMPTY).all():
            break
    keys = np.ascontiguousarray(full).view("<u8")
    return mix(mix(keys) + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows: equal registers, less the equal ones
    that disjoint sets of these sizes are expected to have, over the used; and
    how many are used."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(1)
    la, lb = na / BUCKETS, nb / BUCKETS
    s = la + lb
    chance = 0.68 * 2.0**-MANTISSA * la * lb / np.maximum(s, 1e-12) ** 2 * (1 - np.exp(-s) * (1 + s))
    expected = BUCKETS * chance
    total = used.sum(1)
    return np.clip((same - expected) / np.maximum(total - expected, 1e-9), 0, 1), total


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                row, value = shingles(*utf8(part.column("text")), size)
                n = part.num_rows
                sig = registers(row, value, n)
                count = np.bincount(row, minlength=n)
                total = np.zeros(len(value) + 1, np.uint64)
                np.cumsum(mix(value), out=total[1:], dtype=np.uint64)
                end = np.cumsum(count)
                digest = (total[end] - total[end - count]).view(np.int64)
                keep = np.flatnonzero(count)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(keep)),
                        pa.array(digest[keep]),
                        pa.array(count[keep].astype(np.int32)),
                        pa.array([x.tobytes() for x in sig[keep]], pa.binary()),
                        pa.array(list(bands(sig[keep])), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "digest", "size", "sig", "keys"],
                )

    return run


def _hopeful(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                part = b.slice(at, 4000)
                n = part.num_rows
                if not n:
                    continue
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(n, BUCKETS) for c in ("sa", "sb"))
                na, nb = (part.column(c).to_numpy().astype(float) for c in ("na", "nb"))
                found, used = estimate(x, y, na, nb)
                error = np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
                good = (found >= threshold - SIGMAS * error) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb))
                yield part.select(["a", "b"]).filter(pa.array(good))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                row, value = shingles(*utf8(part.column("text")), size)
                count = np.bincount(row, minlength=part.num_rows)
                parts = np.split(value.astype(np.int64), np.cumsum(count)[:-1])
                yield pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "items"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_id, b_id, good = b.column("a"), b.column("b"), []
            known: tuple[object, np.ndarray] = (None, np.zeros(0, np.int64))
            for i in range(b.num_rows):
                if known[0] != a_id[i]:
                    known = (a_id[i], np.frombuffer(b.column("ia")[i].as_buffer(), np.int64))
                x, y = known[1], np.frombuffer(b.column("ib")[i].as_buffer(), np.int64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(shared >= threshold * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _exact(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, sets: DataFrame | None, threshold: float, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose shingle sets have at least the Jaccard threshold,
    and the sets (id, items) read for it; `sets` are known already.

    The hub side `a`, where keys repeat, is joined before `b`, so that the wide
    rows are shuffled by the side that is spread. The texts' side always takes
    the shuffle, whatever its size, and just once for each document."""
    s = sketches.select("doc_id", "size", "sig")
    hopeful = staged(
        pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b").mapInArrow(_hopeful(threshold), "a bigint, b bigint"),
        f"{name}-hopeful",
    )
    ids = hopeful.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if sets is not None:
        ids = ids.join(sets.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    read = staged(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(size), "id bigint, items binary"), f"{name}-sets")
    known = read if sets is None else read.union(sets)
    both = hopeful.join(known.toDF("a", "ia"), "a").join(known.toDF("b", "ib"), "b")
    out = staged(both.mapInArrow(_verified(threshold), "a bigint, b bigint"), f"{name}-edges")
    discard(hopeful)
    return out, read


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(doc_id, group_id) for every node of the edges (a, b); group_id is the
    least node of the component. Alternates large-star and small-star steps
    until the edges are stars; each step is a table in the shared folder."""

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            around = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        near = around.join(around.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "a")
        if large:
            out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    now = staged(edges.where("a <> b").select("a", "b").distinct(), name)
    mark = None
    while True:
        step = staged(star(star(now, True), False), name)
        row = step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = step
        if row == mark:
            break
        mark = row
    return now.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id")).union(now.select(F.col("b").alias("doc_id"), F.col("b").alias("group_id")).distinct())


def _single(docs: DataFrame) -> DataFrame:
    """One row a doc_id, the first by all columns as JSON; rows without one stay."""
    twice = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        discard(twice)
        return docs
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(every, F.to_json(every)).alias("row")).select("row.*")
    return docs.join(twice, "doc_id", "left_anti").select(docs.columns).union(first.select(docs.columns))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id, kept) of every document that has a near copy."""
    docs = _single(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
    return _near(docs, threshold, size)


def _near(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """near_duplicates of documents whose ids don't repeat."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    raw = docs.mapInArrow(_sketches(size), "doc_id bigint, digest bigint, size int, sig binary, keys array<bigint>")
    sketches = staged(raw, "sketches")
    sets_of = sketches.groupBy("digest", "size").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep <> top").drop("top")
    exact = staged(sketches.select("doc_id", "digest", "size").join(sets_of, ["digest", "size"]).where("doc_id <> rep").select("doc_id", "rep"), "exact")
    reps = sketches.join(exact, "doc_id", "left_anti")
    keyed = reps.select("doc_id", "size", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub <> top").drop("top")
    buckets = staged(keyed.join(hubs, "key").select("doc_id", "size", "key", "hub"), "buckets")
    tested = staged(buckets.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "tested")
    edges, sets = _exact(docs, tested, sketches, None, threshold, size, "star")
    groups = staged(components(edges), "groups")

    label = groups.select("doc_id", F.col("group_id").alias("g"))
    left = buckets.where("doc_id <> hub").join(label, "doc_id", "left").select("key", "size", "doc_id", F.coalesce("g", "doc_id").alias("g"))
    mixed = left.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    left = staged(left.join(mixed, "key", "left_semi"), "mixed")
    x, y = left.toDF("key", "na", "a", "ga"), left.toDF("key", "nb", "b", "gb")
    alike = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb"))
    rest = x.join(y, "key").where(alike).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    rest = staged(rest, "rest")
    more, others = _exact(docs, rest, sketches, sets, threshold, size, "rest")
    links = groups.select(F.col("doc_id").alias("a"), F.col("group_id").alias("b")).union(more).union(exact.toDF("a", "b"))
    out = components(links)
    discard(sketches, exact, buckets, tested, edges, sets, groups, left, rest, more, others)
    return out.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The documents, all columns, less every near copy of a kept one. Of rows
    that repeat a doc_id one stays: the first by all columns as JSON."""
    docs = _single(docs)
    gone = _near(docs, threshold, size).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


#: Every pair that shares a shingle, by its exact Jaccard, and the components.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{FOLD_BREAK_SQL}'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {SHINGLE} + 1, 1))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= {THRESHOLD} * (na.n + nb.n - c)),
linked AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS doc_id, a AS top FROM linked UNION SELECT linked.b, reach.top FROM reach JOIN linked ON linked.a = reach.doc_id WHERE reach.top < linked.b)
SELECT doc_id, min(top) AS group_id, min(top) = doc_id AS kept FROM reach GROUP BY doc_id
"""
