"""Benchmark decontamination with a generalised suffix automaton.

Test items and training texts are normalised alike: lower case, tokens as
common.tokens(fold=True). The automaton over the items' tokens is streamed
over each document; at every token it holds the longest run ending there that
occurs in some item. A run is removed if it has at least `length` tokens, or at
least `coverage` of the tokens of an item that it occurs in (never fewer than
`least` tokens). Removed runs of a document merge into maximal spans.

Streaming every token through Python would be slow: a run of m tokens has m-1
consecutive token pairs that occur in items, so a vectorised pass finds the
stretches of such pairs that are long enough, and the automaton reads just
these. This loses no run.

The automaton is broadcast, as flat arrays of some 80 bytes a token. Its size is
bounded: items are taken in shards of `shard_tokens` tokens, one pass over the documents for each, so that a large
benchmark costs passes and not memory. `decontaminate` makes these passes over
each batch in one Python worker a task, with one shard in memory at a time.

Defined cases: NULL text is ''; items of NULL or fewer than `least` tokens match
nothing; rows of NULL doc_id have no reported spans, but their texts are cut
in `decontaminate`; repeated rows are treated each on its own and reported
once; other columns are carried along unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD_BREAK, FOLD_BREAK_SQL, bitmap_of, member, runs, slices, spans_hash, tokens, utf8

LENGTH, COVERAGE, LEAST, SHARD_TOKENS = 13, 0.8, 5, 500_000
_TOKEN = regex.compile("[^" + FOLD_BREAK[1:-2] + "]+")


class Automaton:
    """Generalised suffix automaton of token sequences (any hashable tokens)."""

    def __init__(self, items: list[list[int]], coverage: float, least: int):
        self.next: list[dict] = [{}]
        self.link, self.len, self.shortest = [-1], [0], [math.inf]
        for item in items:
            self._add(item)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)
        for v in order:
            u = self.link[v]
            self.shortest[u] = min(self.shortest[u], self.shortest[v])
        self.need = [max(least, math.ceil(coverage * x - 1e-9)) if x < math.inf else math.inf for x in self.shortest]
        #: The longest suffix of a state's longest run that is long enough for an item of its own.
        self.enough = [0] * len(self.len)
        for v in reversed(order):
            self.enough[v] = self.len[v] if self.len[v] >= self.need[v] else self.enough[self.link[v]]
        self._flatten()

    def _flatten(self) -> None:
        """Flat arrays for the states, and for the transitions of a state its tokens
        in order: some 80 bytes an item's token, where dicts take 400."""
        count = np.array([len(x) for x in self.next])
        self.base = np.append(0, np.cumsum(count)).astype(np.int32)
        state = np.repeat(np.arange(len(count)), count)
        token = np.fromiter((t for x in self.next for t in x), np.uint64, int(count.sum()))
        to = np.fromiter((v for x in self.next for v in x.values()), np.int32, int(count.sum()))
        by = np.lexsort((token, state))
        self.token, self.to = token[by], to[by]
        most = np.iinfo(np.int32).max
        self.next, self.shortest = None, None
        self.link, self.len, self.enough = (np.array(x, np.int32) for x in (self.link, self.len, self.enough))
        self.need = np.minimum(self.need, most).astype(np.int32)

    def step(self, state: int, token: np.uint64) -> int:
        """The state after one more token, -1 if there is none."""
        a, b = self.base[state], self.base[state + 1]
        if b - a == 1:
            return int(self.to[a]) if self.token[a] == token else -1
        at = a + np.searchsorted(self.token[a:b], token)
        return int(self.to[at]) if at < b and self.token[at] == token else -1

    def _add(self, item: list[int]) -> None:
        last = 0
        for token in item:
            if token in self.next[last]:
                q = self.next[last][token]
                last = q if self.len[q] == self.len[last] + 1 else self._split(last, q, token)
            else:
                new, p = len(self.len), last
                self.next.append({})
                self.len.append(self.len[last] + 1)
                self.link.append(0)
                self.shortest.append(math.inf)
                while p >= 0 and token not in self.next[p]:
                    self.next[p][token] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][token]
                    self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, token)
                last = new
            self.shortest[last] = min(self.shortest[last], len(item))

    def _split(self, p: int, q: int, token: int) -> int:
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.shortest.append(math.inf)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def removed(self, stream: np.ndarray, length: int) -> list[tuple[int, int]]:
        """Half-open runs to remove, one for each end where there is one."""
        link, lens, need, enough = self.link, self.len, self.need, self.enough
        state = size = 0
        out = []
        for i, token in enumerate(stream):
            to = self.step(state, token)
            while state and to < 0:
                state = int(link[state])
                size = int(lens[state])
                to = self.step(state, token)
            if to >= 0:
                state = to
                size += 1
                if size >= length or size >= need[state]:
                    out.append((i + 1 - size, i + 1))
                elif enough[link[state]]:
                    out.append((i + 1 - int(enough[link[state]]), i + 1))
        return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, merged."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, _, _, doc = tokens(*utf8(pc.utf8_lower(texts)), fold=True)
    return h, doc


class Matcher:
    """The automaton of one shard of items, with its prefilter."""

    def __init__(self, texts: list[str], length: int, coverage: float, least: int):
        h, doc = _hashed(pa.array(texts, pa.string()))
        items = [x.tolist() for x in np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))]
        items = [x for x in items if len(x) >= least]
        self.automaton = Automaton(items, coverage, least)
        self.length = length
        self.pairs = min([min(length, max(least, math.ceil(coverage * len(x) - 1e-9))) for x in items], default=1 << 40) - 1
        flat = np.array([t for x in items for t in x], np.uint64)
        end = np.cumsum([len(x) for x in items]).astype(np.int64)
        first = np.setdiff1d(np.arange(len(flat) - 1), end - 1) if len(flat) > 1 else np.zeros(0, np.int64)
        self.known = np.unique(spans_hash(flat, first, 2))
        self.bitmap = bitmap_of(self.known)

    def spans(self, texts: pa.Array) -> dict[int, list[tuple[int, int]]]:
        """Row -> maximal token spans to remove."""
        h, doc = _hashed(texts)
        if len(h) < 2 or not len(self.known):
            return {}
        first = np.flatnonzero(doc[1:] == doc[:-1])
        hit = np.zeros(len(h), bool)
        hit[first] = member(spans_hash(h, first, 2), self.known, self.bitmap)
        start, size = runs(hit)
        good = hit[start] & (size >= self.pairs)
        found: dict[int, list[tuple[int, int]]] = {}
        for s, n in zip(start[good].tolist(), size[good].tolist()):
            row = int(doc[s])
            base = s - int(np.searchsorted(doc, row))
            for a, b in self.automaton.removed(h[s : s + n + 1], self.length):
                found.setdefault(row, []).append((base + a, base + b))
        return {row: union(x) for row, x in found.items()}


def _matchers(benchmark: DataFrame, length: int, coverage: float, least: int, shard_tokens: int) -> Iterator[Matcher]:
    held, size = [], 0
    for (text,) in benchmark.select(F.col("text").cast("string")).where("text IS NOT NULL").distinct().toLocalIterator():
        held.append(text)
        size += len(text) // 4 + 1
        if size >= shard_tokens:
            yield Matcher(held, length, coverage, least)
            held, size = [], 0
    if held:
        yield Matcher(held, length, coverage, least)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                ids, starts, ends = [], [], []
                for row, spans in shared.value.spans(part.column("text")).items():
                    for s, e in spans:
                        ids.append(part.column("doc_id")[row].as_py()), starts.append(s), ends.append(e)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_token", "end_token"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [{"doc_id": d, "start_token": s, "end_token": e} for d, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()) for s, e in union([(x["start_token"], x["end_token"]) for x in spans])]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("doc_id", "start_token", "end_token")]))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start_token, end_token): the maximal spans to remove."""
    schema = "doc_id bigint, start_token bigint, end_token bigint"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    out = None
    for matcher in _matchers(benchmark, length, coverage, least, shard_tokens):
        own = docs.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(matcher)), schema)
        out = own if out is None else out.union(own)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id").agg(F.collect_list(F.struct("start_token", "end_token")).alias("spans")).mapInArrow(_merge, schema)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the token spans."""
    where = [m.span() for m in _TOKEN.finditer("".join(_lower(c) for c in text))]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : where[s][0]])
        at = where[e - 1][1]
    return "".join([*out, text[at:]])


def _lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def _cut(shared: list, chars: bool):
    """Cuts what the shards' matchers find, all of it found in the texts as they
    come. One worker takes shard after shard and keeps one of them in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            noted: dict[int, list[tuple[int, int]]] = {}
            for matcher in shared:
                at = 0
                for part in slices(whole):
                    for row, spans in matcher.value.spans(part.column("text")).items():
                        noted.setdefault(at + row, []).extend(spans)
                    at += part.num_rows
                if len(shared) > 1:
                    matcher.__dict__.pop("_value", None)  # read again from the executor's disk
            at = 0
            for part in slices(whole):
                rows = [row for row in range(part.num_rows) if at + row in noted]
                if rows:
                    texts = part.column("text").to_pylist()
                    for row in rows:
                        texts[row] = cut(texts[row], union(noted[at + row]))
                    part = put(part, "text", texts)
                    if chars:
                        sizes = part.column("n_chars").to_pylist()
                        for row in rows:
                            sizes[row] = len(texts[row])
                        part = put(part, "n_chars", sizes)
                at += part.num_rows
                yield part

    return run


def put(part: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    """The batch with new values in a column."""
    i = part.schema.get_field_index(name)
    return part.set_column(i, part.schema.field(i), pa.array(values, part.schema.field(i).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: float = COVERAGE, least: int = LEAST, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The documents, all columns and rows, with the spans cut from text and
    n_chars, if there is such an integer column, the new length of changed texts."""
    chars = any(f.name == "n_chars" and isinstance(f.dataType, (T.IntegerType, T.LongType)) for f in docs.schema)
    spark = docs.sparkSession.sparkContext
    shared = [spark.broadcast(x) for x in _matchers(benchmark, length, coverage, least, shard_tokens)]
    return docs.mapInArrow(_cut(shared, chars), docs.schema)


SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{FOLD_BREAK_SQL}'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (
  SELECT DISTINCT list_filter(regexp_split_to_array(lower(text), '{FOLD_BREAK_SQL}'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
m AS (
  SELECT w, CAST(least({LENGTH}, greatest({LEAST}, ceil({COVERAGE} * len(w) - 1e-9))) AS BIGINT) AS m FROM i WHERE len(w) >= {LEAST}),
want AS (
  SELECT DISTINCT m, md5(array_to_string(w[p + 1 : p + m], ' ')) AS g FROM (SELECT w, m, unnest(range(0, len(w) - m + 1)) AS p FROM m)),
have AS (
  SELECT doc_id, p, m, md5(array_to_string(w[p + 1 : p + m], ' ')) AS g
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS p FROM d, (SELECT DISTINCT m FROM m) WHERE len(w) >= m)),
hits AS (
  SELECT doc_id, p, max(p + h.m) AS e FROM have h JOIN want USING (m, g) GROUP BY doc_id, p),
steps AS (
  SELECT *, CASE WHEN p <= max(e) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM steps)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_token, CAST(max(e) AS BIGINT) AS end_token FROM islands GROUP BY doc_id, island
"""
