"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, each at the node of its already known leading
bits. Every such node has a tree of contexts, the preceding 0 to `depth` bytes;
bytes before the text's first count as zero bytes. A context holds how often a
0 and a 1 followed it in the whole corpus; Pe is its Krichevsky-Trofimov block
probability, and from the deepest context upwards

    Pw = Pe                                   at the deepest context
    Pw = Pe / 2 + product of the children's Pw / 2      elsewhere.

The next bit's probability mixes the estimates (n1 + 1/2) / (n + 1) of all
depths, a context's weight against its longer ones being Pe / 2 / Pw. A text's
score is the sum of -log2 of its bits' probabilities over its bytes.

Steps:
1. each map task counts its (context, byte) grams and sends every distinct one
   with its count; Spark adds them up. These counts hold all shallower ones;
2. grams of one (2 bytes of) context meet in a task that builds their trees up
   to depth 2; depths 1 and 0 have at most 65,280 nodes, made on the driver;
3. the same groups mix the depths and yield each gram's bits;
4. the bits of the grams are broadcast in shards of at most `shard` grams, one
   pass over the texts for each; a text's sums over the shards add up, so that
   a large model costs passes and not memory.

Result: (doc_id, n_bytes, bits, bits_per_byte).

Defined cases: NULL and empty texts have 0 bytes, 0 bits and NULL a byte; rows
without a doc_id count in the corpus but aren't reported; repeated rows count
and are reported each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, runs, slices, staged, utf8

DEPTH, SHARD = 5, 1 << 25
HELD = 1 << 22
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series beyond a shift by 8."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """For each byte, the `depth` bytes before it and itself as one number."""
    kind = np.uint32 if depth <= 3 else np.uint64
    out = data.astype(kind)
    for d in range(1, depth + 1):
        back = np.zeros(len(data), kind)
        back[d:] = data[:-d] if len(data) > d else 0
        for k in range(d):
            at = offsets[:-1] + k
            back[at[at < offsets[1:]]] = 0
        out |= back << kind(8 * d)
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values for each."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return (keys[start], *(np.add.reduceat(v[by], start) if len(start) else v[:0] for v in values))


def _count(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32 if depth <= 3 else np.uint64), np.zeros(0, np.int64)

        def rows():
            key = keys.astype(np.int64) if depth < 7 else keys.view(np.int64)
            return pa.record_batch([pa.array(key), pa.array(counts), pa.array(((keys >> keys.dtype.type(8)) & keys.dtype.type(0xFFFF)).astype(np.int32))], ["gram", "n", "tail"])

        for whole in batches:
            for part in slices(whole):
                g = np.sort(grams(*utf8(part.column("text")), depth))
                if not len(g):
                    continue
                start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                keys, counts = _summed(np.concatenate([keys, g[start]]), np.concatenate([counts, np.diff(np.append(start, len(g)))]))
                if len(keys) > HELD:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield rows()

    return run


class Level:
    """The nodes of one depth: sorted keys (context << 8 | leading bits), counts and probabilities."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1 = key, n0, n1
        pe = log_kt(n0, n1)
        self.log_pw = pe if below is None else np.logaddexp(_HALF + pe, _HALF + below)
        self.weight = np.ones(len(key)) if below is None else np.exp(_HALF + pe - self.log_pw)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def up(self, depth: int) -> Level:
        """The nodes one byte of context higher, of `depth` bytes."""
        mask = np.uint64((1 << 8 * depth) - 1)
        parent = ((self.key >> np.uint64(8)) & mask) << np.uint64(8) | self.key & np.uint64(255)
        key, n0, n1, below = _summed(parent, self.n0, self.n1, self.log_pw)
        return Level(key, n0, n1, below)


def _bits(gram: np.ndarray, k: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(node key at `depth`, the bit there) of the grams' k-th bits."""
    x = gram & np.uint64(255)
    node = np.uint64(1 << k) | x >> np.uint64(8 - k)
    context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return context << np.uint64(8) | node, (x >> np.uint64(7 - k)) & np.uint64(1)


def deepest(gram: np.ndarray, n: np.ndarray, depth: int) -> Level:
    parts = [_bits(gram, k, depth) for k in range(8)]
    key = np.concatenate([p[0] for p in parts])
    bit = np.concatenate([p[1] for p in parts]).astype(float)
    n = np.tile(n.astype(float), 8)
    return Level(*_summed(key, n * (1 - bit), n * bit), None)


def levels(gram: np.ndarray, n: np.ndarray, depth: int, least: int) -> list[Level]:
    """From `depth` up to `least` bytes of context."""
    out = [deepest(gram, n, depth)]
    for d in range(depth - 1, least - 1, -1):
        out.append(out[-1].up(d))
    return out


def costs(gram: np.ndarray, found: list[Level], depth: int) -> np.ndarray:
    """Bits of each gram's last byte, mixing the levels found (deepest first)."""
    total = np.zeros(len(gram))
    for k in range(8):
        p = np.full(len(gram), 0.5)
        for i, level in enumerate(found):
            key, bit = _bits(gram, k, depth - i)
            if not len(level.key):
                continue
            at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
            met = level.key[at] == key
            w = np.where(met, level.weight[at], 0.5)
            p = w * np.where(met, level.one[at], 0.5) + (1 - w) * p
        total -= np.log2(np.where(bit == 1, p, 1 - p))
    return total


def _numbers(gram: pd.Series) -> np.ndarray:
    return gram.to_numpy().astype(np.int64).view(np.uint64)


def _upper(depth: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top = levels(_numbers(pdf["gram"]), pdf["n"].to_numpy(), depth, 2)[-1]
        node = (top.key & np.uint64(0xFFFF)).astype(np.int32)
        return pd.DataFrame({"node": node, "n0": top.n0, "n1": top.n1, "log_pw": top.log_pw})

    return run


def _priced(depth: int, shared):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = _numbers(pdf["gram"])
        found = levels(gram, pdf["n"].to_numpy(), depth, 2) + shared.value
        return pd.DataFrame({"gram": pdf["gram"].to_numpy(), "bits": costs(gram, found, depth)})

    return run


def model(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The corpus model as a staged table (gram, bits) of every gram in it."""
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text <> ''")
    counted = texts.mapInArrow(_count(depth), "gram bigint, n bigint, tail int").groupBy("tail", "gram").agg(F.sum("n").alias("n"))
    counted = staged(counted, "ctw-counts")
    part = counted.groupBy("tail").applyInPandas(_upper(depth), "node int, n0 double, n1 double, log_pw double")
    # A node here has one byte of context and 8 bits of position: 65,280 rows at most.
    rows = part.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log_pw"))).orderBy("node").toPandas()
    one = Level(rows["node"].to_numpy().astype(np.uint64), rows["n0"].to_numpy(float), rows["n1"].to_numpy(float), rows["log_pw"].to_numpy(float))
    shared = docs.sparkSession.sparkContext.broadcast([one, one.up(0)])
    out = staged(counted.groupBy("tail").applyInPandas(_priced(depth, shared), "gram bigint, bits double"), "ctw-model")
    discard(counted)
    return out


class Prices:
    """Bits by gram, in the order of the grams. Lookups are sorted too, and made
    once for each distinct gram, so that they run through memory in order."""

    def __init__(self, gram: np.ndarray, bits: np.ndarray):
        by = np.argsort(gram)
        self.gram, self.bits = gram[by], bits[by].astype(np.float64)

    def of(self, g: np.ndarray) -> np.ndarray:
        """The bits of each gram, 0 where another shard has it."""
        if not len(self.gram):
            return np.zeros(len(g))
        by = np.argsort(g)
        s = g[by]
        start, size = runs(s)
        wanted = s[start]
        at = np.minimum(np.searchsorted(self.gram, wanted), len(self.gram) - 1)
        out = np.empty(len(g))
        out[by] = np.repeat(np.where(self.gram[at] == wanted, self.bits[at], 0.0), size)
        return out


def _score(depth: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices = shared.value
        for whole in batches:
            for part in slices(whole):
                data, offsets = utf8(part.column("text"))
                total = np.zeros(len(data) + 1)
                np.cumsum(prices.of(grams(data, offsets, depth)), out=total[1:])
                yield pa.record_batch([part.column("doc_id"), part.column("nth"), pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]])], ["doc_id", "nth", "n_bytes", "bits"])

    return run


def code_lengths(docs: DataFrame, depth: int = DEPTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) of every row; see the module."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prices = model(docs, depth)
    texts = docs.where("doc_id IS NOT NULL").withColumn("nth", F.lit(0).cast("bigint"))
    shards = max(1, -(-prices.count() // shard))
    if shards > 1:
        texts = docs.withColumn("nth", F.xxhash64("text")).where("doc_id IS NOT NULL")
    kind = np.uint32 if depth <= 3 else np.uint64
    sums = []
    for i in range(shards):
        rows = prices.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == i).toArrow() if shards > 1 else prices.toArrow()
        held = Prices(rows.column("gram").to_numpy().view(np.uint64).astype(kind), rows.column("bits").to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(held)
        sums.append(texts.mapInArrow(_score(depth, shared), "doc_id bigint, nth bigint, n_bytes bigint, bits double"))
    if shards > 1:
        # Rows that repeat are scored in each shard: they are numbered alike, as equal texts have equal sums.
        total = reduce(DataFrame.union, sums).groupBy("doc_id", "nth", "n_bytes").agg(F.sum("bits").alias("bits"), (F.count("*") / shards).cast("int").alias("n"))
        out = total.withColumn("bits", F.col("bits") / F.col("n")).withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
    else:
        out = sums[0]
    return out.select("doc_id", "n_bytes", "bits", F.try_divide("bits", "n_bytes").alias("bits_per_byte"))
