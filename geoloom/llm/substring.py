"""Substring dedup: Rabin-Karp hashes of every fixed-length token window,
counted over the corpus; repeated windows merge into maximal intervals.

A token is a run of bytes above 0x20. Every window of `window` tokens inside a
document has a 64-bit Rabin-Karp hash. Steps:

1. a map task sorts the hashes of a piece of the corpus. Of a hash that occurs
   again in the piece, all but the first by (doc_id, position) are known to be
   repeats and leave as such; the first goes on with a mark. So one hash has one
   entry a piece, however many documents share the passage;
2. the entries are packed by hash range: 6-byte gaps (8 where a gap is larger),
   document ids and positions in as many bytes as they need. There are as many
   ranges as make one about PART_BYTES, so that no task grows with the corpus;
   beyond MOST_PARTS ranges, coarse ranges are made first, and merged pieces of
   them are deduplicated again and cut into the fine ones;
3. a range's task finds the hashes with two entries or a mark; only these
   windows go on, to be merged by document.

Result: (doc_id, start_token, end_token, action), half-open maximal runs of
tokens. 'keep' covers the windows that occur here first (by doc_id, then
position), 'remove' those that occurred before. A window repeated inside one
document counts as repeated.

Defined cases: NULL text is ''; documents of fewer tokens than the window have
no rows; rows without a doc_id are left out; rows that repeat a doc_id are
copies of one another, so their windows are repeated and have both actions;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, runs, slices, spans_hash, tokens, utf8

WINDOW = 50
PIECE, PART_BYTES, MOST_PARTS = 6 << 20, 12 << 20, 8192
#: Bytes of entries for a byte of a table's files.
ENTRY_SHARE = 2.5


def order(h: np.ndarray) -> np.ndarray:
    """argsort of 64-bit hashes, by one sort of values: the top bits with the
    positions below them, then a repair of the few ties of the top bits."""
    n = len(h)
    bits = max(1, int(n - 1).bit_length()) if n else 1
    low = np.uint64((1 << bits) - 1)
    at = (np.sort(h & ~low | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    s = h[at]
    if n > 1 and (s[1:] < s[:-1]).any():
        at = at[np.argsort(s, kind="stable")]
    return at


def packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: memoryview | bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").reshape(-1)


_SCHEMA = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("least", pa.int64()), ("widths", pa.int32()), ("gaps", pa.binary()), ("docs", pa.binary()), ("codes", pa.binary())])
_COLUMNS = "part int, n int, first bigint, least bigint, widths int, gaps binary, docs binary, codes binary"


def _width(values: np.ndarray) -> int:
    return max(1, -(-int(values.max()).bit_length() // 8))


def _blob(part: int, h: np.ndarray | None, doc: np.ndarray, code: np.ndarray) -> dict:
    """Entries of sorted hashes, or without hashes windows known to be repeats."""
    least = int(doc.min())
    away = (doc - least).view(np.uint64)
    gaps, gap_width, first = b"", 0, 0
    if h is not None:
        step = np.diff(h, prepend=h[:1])
        gap_width = 6 if int(step.max()) < 1 << 48 else 8
        gaps, first = packed(step, gap_width), int(h[:1].view(np.int64)[0])
    widths = (_width(away), _width(code))
    return {"part": part, "n": len(doc), "first": first, "least": least, "widths": gap_width * 100 + widths[0] * 10 + widths[1], "gaps": gaps, "docs": packed(away, widths[0]), "codes": packed(code, widths[1])}


def _read(blob: dict) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    gap, doc, code = blob["widths"] // 100, blob["widths"] // 10 % 10, blob["widths"] % 10
    h = None
    if gap:
        step = unpacked(blob["gaps"], gap)
        step[0] = np.array([blob["first"]], np.int64).view(np.uint64)[0]
        h = np.cumsum(step, dtype=np.uint64)
    return h, unpacked(blob["docs"], doc).view(np.int64) + blob["least"], unpacked(blob["codes"], code)


def distinct(h: np.ndarray, doc: np.ndarray, code: np.ndarray):
    """(hashes, documents, codes) with one entry a hash, the first by document
    and position, in order of the hashes, and (documents, codes) of the others.
    A code is twice a position, plus 1 if the window is known to occur again."""
    by = order(h)
    h, doc, code = h[by], doc[by], code[by]
    start, size = runs(h)
    if len(start) == len(h):
        return (h, doc, code), (doc[:0], code[:0])
    many = np.flatnonzero(size > 1)
    at = ranges(start[many], size[many])
    group = np.repeat(many, size[many])
    by = np.lexsort((code[at], doc[at], group))
    at, group = at[by], group[by]
    lead = np.append(True, group[1:] != group[:-1])
    top, rest = start.copy(), at[~lead]
    top[group[lead]] = at[lead]
    out = code[top]
    out[size > 1] |= np.uint64(1)
    return (h[start], doc[top], out), (doc[rest], code[rest] & ~np.uint64(1))


def _blobs(h: np.ndarray, doc: np.ndarray, code: np.ndarray, parts: int, every: int) -> pa.RecordBatch:
    """The entries as blobs of `parts` ranges, each `every` fine ones."""
    (h, doc, code), (doc2, code2) = distinct(h, doc, code)
    edges = (np.arange(every, parts, every, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    cut = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
    rows = [_blob(i * every, h[a:b], doc[a:b], code[a:b]) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
    if len(doc2):
        rows.append(_blob(int(h[0]) % parts // every * every, None, doc2, code2))
    return pa.RecordBatch.from_pylist(rows, _SCHEMA)


def _map(window: int, parts: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for whole in batches:
            for part in slices(whole):
                h, _, _, doc = tokens(*utf8(part.column("text")))
                first = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
                if not len(first):
                    continue
                base = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = doc[first]
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((spans_hash(h, first, window), ids[own], ((first - base[own]) << 1).astype(np.uint64)))
                size += part.nbytes
                if size >= PIECE:
                    yield _blobs(*map(np.concatenate, zip(*held)), parts, every)
                    held, size = [], 0
        if held:
            yield _blobs(*map(np.concatenate, zip(*held)), parts, every)

    return run


def _refine(parts: int):
    """Blobs of coarse ranges to blobs of fine ones, by pieces of a few million entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for blob in b.to_pylist():
                if blob["widths"] < 100:  # repeats go on as they are
                    yield pa.RecordBatch.from_pylist([blob | {"part": (blob["first"] + blob["least"] + blob["n"]) % parts}], _SCHEMA)
                    continue
                held.append(_read(blob))
                n += blob["n"]
                if n >= PIECE // 4:
                    yield _blobs(*map(np.concatenate, zip(*held)), parts, 1)
                    held, n = [], 0
        if held:
            yield _blobs(*map(np.concatenate, zip(*held)), parts, 1)

    return run


def _by_document(doc: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """Codes here: twice a position, plus 1 for the first window of its hash."""
    by = np.lexsort((code, doc))
    doc, code = doc[by], code[by].astype(np.int64)
    start, _ = runs(doc)
    cut = np.split(code.astype("<i4" if not len(code) or code.max() < 1 << 31 else "<i8"), start[1:]) if len(start) else []
    return pa.record_batch([pa.array(doc[start], pa.int64()), pa.array([x.itemsize == 8 for x in cut], pa.bool_()), pa.array([x.tobytes() for x in cut], pa.binary())], ["doc_id", "wide", "windows"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition holds one range, or more of them where Spark joins partitions."""
    held: dict[int, list] = {}
    for b in batches:
        for blob in b.to_pylist():
            h, doc, code = _read(blob)
            if h is None:
                yield _by_document(doc, code)
            else:
                held.setdefault(blob["part"], []).append((h, doc, code))
    while held:
        _, blobs = held.popitem()
        (h, doc, code), (doc2, code2) = distinct(*map(np.concatenate, zip(*blobs)))
        again = (code & np.uint64(1)) == 1
        yield _by_document(np.concatenate([doc[again], doc2]), np.concatenate([code[again], code2]))


def merged(pos: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal token intervals of sorted window positions."""
    if not len(pos):
        return []
    new = np.append(True, pos[1:] > pos[:-1] + window)
    start = pos[new]
    end = pos[np.append(np.flatnonzero(new)[1:] - 1, len(pos) - 1)] + window
    return list(zip(start.tolist(), end.tolist()))


def _merge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, starts, ends, actions = [], [], [], []
            for doc, blobs in zip(b.column("doc_id").to_pylist(), b.column("all").to_pylist()):
                code = np.unique(np.concatenate([np.frombuffer(x["windows"], "<i8" if x["wide"] else "<i4").astype(np.int64) for x in blobs]))
                for action, bit in (("keep", 1), ("remove", 0)):
                    for s, e in merged(code[code & 1 == bit] >> 1, window):
                        ids.append(doc), starts.append(s), ends.append(e), actions.append(action)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(actions, pa.string())], ["doc_id", "start_token", "end_token", "action"])

    return run


def _size(docs: DataFrame) -> int:
    """Bytes of the input: what Spark knows of its files, or else its texts' length."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return known if known < 1 << 52 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def repeated_spans(docs: DataFrame, window: int = WINDOW, parts: int | None = None, most: int = MOST_PARTS) -> DataFrame:
    """The maximal intervals of repeated windows; see the module. `parts` ranges
    are made, by default as many as the input's size needs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    parts = parts or max(1, math.ceil(_size(docs) * ENTRY_SHARE / PART_BYTES))
    every = math.ceil(parts / most) * 16 if parts > most else 1
    blobs = docs.mapInArrow(_map(window, parts, every), _COLUMNS)
    if every > 1:
        coarse = math.ceil(parts / every)
        blobs = blobs.repartitionById(coarse, (F.col("part") / every).cast("int")).mapInArrow(_refine(parts), _COLUMNS)
    hits = blobs.repartitionById(parts, F.col("part")).mapInArrow(_count, "doc_id bigint, wide boolean, windows binary")
    by_doc = hits.groupBy("doc_id").agg(F.collect_list(F.struct("wide", "windows")).alias("all"))
    return by_doc.mapInArrow(_merge(window), "doc_id bigint, start_token bigint, end_token bigint, action string")


SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x00-\\x20]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
spots AS (
  SELECT doc_id, unnest(range(0, len(w) - 49)) AS p, w FROM words WHERE len(w) >= 50),
grams AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 50], ' ')) AS g FROM spots),
again AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth, count(*) OVER (PARTITION BY g) AS n FROM grams),
marked AS (
  SELECT DISTINCT doc_id, p, CASE WHEN nth = 1 THEN 'keep' ELSE 'remove' END AS action FROM again WHERE n > 1),
steps AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id, action ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM marked),
islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, action ORDER BY p) AS island FROM steps)
SELECT doc_id, CAST(min(p) AS BIGINT) AS start_token, CAST(max(p) + 50 AS BIGINT) AS end_token, action
FROM islands GROUP BY doc_id, action, island
"""
