"""SentencePiece encoding and decoding by suffix-array matching.

For each batch of texts:

1. a text becomes the model's input: a dummy space before it if the model adds
   one, white space as U+2581; it's cut between characters that stand side by
   side in no piece, where no merge can happen. What is left are units, mostly
   words, of which a batch has few distinct ones;
2. the batch's distinct units that weren't met before stand for its text: they
   are concatenated and a suffix array of them is built (sorted by as many characters as the longest piece has);
3. every piece is binary-searched in the suffix array: its range is its
   occurrences. A range that leaves its unit is cut by the units' separators;
4. occurrences are edges; sorted by end position they are relaxed from left to
   right, all units side by side.

Relaxing differs by model. In a unigram model the best score wins. In a BPE
model the greedy merges, not the sum of scores, define the result; there the
encoding of each prefix is unique, its last piece is the only one that ends
there and is compatible with the last piece of the rest's encoding, so an edge
is taken if the two pieces, encoded together, stay two pieces. This gives the
same ids as the public library.

Characters that no piece covers become their UTF-8 bytes' pieces, or unknown in
a model without those. Decoding concatenates the pieces' bytes, turns U+2581
into spaces and drops the dummy space.

Defined cases: NULL text has NULL ids; '' has no ids; rows of any doc_id are
encoded as they come, repeated ones too; other columns are ignored. A literal
U+2581 in a text decodes as a space, as in the public library; round_trip is
then false.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, runs, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Units, and pairs of pieces, that a process remembers; then it forgets and learns anew.
KEEP, KEEP_PAIRS = 100_000, 800_000
#: Characters of units that are matched at once; a longer unit is matched alone.
LEARN = 1 << 17


class Model:
    """A SentencePiece model file with the matching state of one process."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        self.bpe = proto.trainer_spec.model_type == BPE
        if not self.bpe and proto.trainer_spec.model_type != UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models of identity normalisation are supported")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = np.array([p.score for p in proto.pieces])
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        plain = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.value = {p: float(self.scores[i]) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.out = [b"" if k not in (NORMAL, USER, BYTE) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.out[self.unknown] = " ⁇ ".encode()
        self.out_size = np.array([len(x) for x in self.out])
        self.out_base = np.cumsum(self.out_size) - self.out_size
        self.out_data = np.frombuffer(b"".join(self.out), np.uint8)
        order = sorted(plain, key=lambda i: self.pieces[i])
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(self.pieces[i]) for i in order}):
            own = [i for i in order if len(self.pieces[i]) == size]
            codes = np.array([[ord(c) for c in self.pieces[i]] for i in own], np.uint64)
            self.by_size[size] = (np.array(own), codes)
        self.split = self._splitter()
        self.compatible: dict[int, bool] = {}
        self.pairs, self.pairs_good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.base, self.size, self.all = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _splitter(self) -> re.Pattern:
        """Units: no piece holds a mark after another character, so a unit may
        begin at each mark that follows another character; if some piece does,
        all of a text is one unit."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return re.compile(r"(?s).+")
        within = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        alone = "" if any("\n" in x for x in within) else r"\n"
        word = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else "")
        return re.compile(word)

    # units -> ids

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """`_pair` of distinct keys (left << 32 | right): those met in earlier
        batches by one search, the others one by one."""
        at = np.searchsorted(self.pairs, keys)
        good = np.zeros(len(keys), bool)
        met = at < len(self.pairs)
        met[met] = self.pairs[at[met]] == keys[met]
        good[met] = self.pairs_good[at[met]]
        new = np.flatnonzero(~met)
        good[new] = [self._pair(k >> 32, k & 0xFFFFFFFF) for k in keys[new].tolist()]
        return good

    def _settle(self) -> None:
        """Put the pairs met in this batch among those to be searched."""
        new = {k: v for k, v in self.compatible.items() if k >= 0}
        if len(self.pairs) + len(new) > KEEP_PAIRS:
            self.pairs, self.pairs_good = np.zeros(0, np.int64), np.zeros(0, bool)
        keys = np.append(self.pairs, np.fromiter(new.keys(), np.int64, len(new)))
        good = np.append(self.pairs_good, np.fromiter(new.values(), bool, len(new)))
        by = np.argsort(keys)
        self.pairs, self.pairs_good = keys[by], good[by]
        self.compatible = {k: v for k, v in self.compatible.items() if k < 0}

    def _pair(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two pieces, side by side, as they are."""
        key = left << 32 | right
        found = self.compatible.get(key)
        if found is None:
            found = self.compatible[key] = self._merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return found

    def _merge(self, text: str) -> list[int]:
        """Greedy BPE of a short text, the definition."""
        parts, value = list(text), self.value.get
        pairs = [value(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > -np.inf:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = value(parts[at - 1] + parts[at], -np.inf)
            if at < len(pairs):
                pairs[at] = value(parts[at] + parts[at + 1], -np.inf)
        return [self.ids.get(p, -1) for p in parts]

    def _edges(self, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, piece) of each occurrence of a piece in the code points
        `text`; room: characters to the end of the unit at each position."""
        n = len(text)
        width = -(-self.longest // 3)
        padded = np.zeros(n + 3 * width, np.uint64)
        padded[:n] = text + np.uint64(1)
        three = lambda k: padded[3 * k : 3 * k + n] << np.uint64(42) | padded[3 * k + 1 : 3 * k + 1 + n] << np.uint64(21) | padded[3 * k + 2 : 3 * k + 2 + n]
        at = suffixes(three(0), 3, self.longest)
        starts, sizes, pieces = [], [], []
        #: Characters 1 to 3, 4 to 6, .. of the suffixes in their order, for the searches.
        levels = [three(k)[at] for k in range(width)]
        for size, (own, codes) in self.by_size.items():
            lo, hi = np.zeros(len(own), np.int64), np.full(len(own), n)
            for level in range(-(-size // 3)):
                k = levels[level]
                part = np.zeros((len(own), 3), np.uint64)
                part[:, : min(3, size - 3 * level)] = codes[:, 3 * level : 3 * level + 3] + np.uint64(1)
                low = part[:, 0] << np.uint64(42) | part[:, 1] << np.uint64(21) | part[:, 2]
                free = 3 - min(3, size - 3 * level)
                high = low | np.uint64((1 << (21 * free)) - 1)
                lo, hi = _search(k, low, lo, hi, False), _search(k, high, lo, hi, True)
                some = lo < hi
                own, codes, lo, hi = own[some], codes[some], lo[some], hi[some]
            where = at[ranges(lo, hi - lo)]
            what = np.repeat(own, hi - lo)
            fits = room[where] >= size
            starts.append(where[fits])
            pieces.append(what[fits])
            sizes.append(np.full(int(fits.sum()), size))
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(pieces)

    def learn(self, units: list[str]) -> None:
        """Encode distinct units, and keep their ids."""
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.array([len(u) for u in units])
        base = np.cumsum(size) - size
        n = len(text)
        room = np.repeat(base + size, size) - np.arange(n)
        start, length, piece = self._edges(text, room)
        covered = np.zeros(n, bool)
        covered[start[length == 1]] = True
        bare = np.flatnonzero(~covered)
        start, length, piece = np.append(start, bare), np.append(length, np.ones(len(bare), np.int64)), np.append(piece, np.full(len(bare), -1))
        back, last = (self._relax_bpe if self.bpe else self._relax)(start, length, piece, base, size, n)
        order, chosen = [], []
        live, at = np.arange(len(units)), base + size
        while len(live):
            order.append(live)
            chosen.append(at.copy())
            at = back[at - 1]
            go = at > base[live]
            live, at = live[go], at[go]
        order, ends = np.concatenate(order[::-1]), np.concatenate(chosen[::-1])
        by = np.argsort(order, kind="stable")
        order, ends = order[by], ends[by]
        ids = last[ends - 1]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in text[ends[bare] - 1].tolist()]
            own = [[self.bytes[b] for b in x] if self.bytes else [self.unknown] for x in raw]
            times = np.ones(len(ids), np.int64)
            times[bare] = [len(x) for x in own]
            spot, ids, order = np.repeat(ids < 0, times), np.repeat(ids, times), np.repeat(order, times)
            ids[spot] = [i for x in own for i in x]
        count = np.bincount(order, minlength=len(units))
        self.known.update(zip(units, range(len(self.size), len(self.size) + len(units))))
        self.base = np.append(self.base, len(self.all) + np.cumsum(count) - count)
        self.size = np.append(self.size, count)
        self.all = np.append(self.all, ids.astype(np.int32))

    def _relax(self, start, length, piece, base, size, n):
        """Best sums of scores, by end position inside the unit."""
        score = np.where(piece >= 0, self.scores[piece], self.scores.min() - 10)
        unit_base = np.repeat(base, size)[start]
        depth = start + length - unit_base
        order = _by_depth(depth)
        best, back, last = np.full(n, -np.inf), np.zeros(n, np.int64), np.full(n, -1)
        at, many = runs(depth[order])
        for a, m in zip(at.tolist(), many.tolist()):
            e = order[a : a + m]
            s, end = start[e], start[e] + length[e] - 1
            total = score[e] + np.where(s == unit_base[e], 0, best[s - 1])
            by = np.lexsort((length[e], total, end))
            top = by[np.append(end[by][1:] != end[by][:-1], True)]
            best[end[top]], back[end[top]], last[end[top]] = total[top], s[top], piece[e[top]]
        return back, last

    def _relax_bpe(self, start, length, piece, base, size, n):
        """The one compatible last piece of every prefix, by end position."""
        unit_base = np.repeat(base, size)[start]
        depth = start + length - unit_base
        order = _by_depth(depth)
        back, last, done = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool)
        at, many = runs(depth[order])
        for a, m in zip(at.tolist(), many.tolist()):
            e = order[a : a + m]
            s, end, own = start[e], start[e] + length[e] - 1, piece[e]
            inner = s > unit_base[e]
            before = last[np.maximum(s - 1, 0)]
            good = ~inner | (own < 0) | (before < 0)
            ask = np.flatnonzero(~good & done[np.maximum(s - 1, 0)])
            if len(ask):
                key = before[ask].astype(np.int64) << 32 | own[ask]
                kinds, inverse = np.unique(key, return_inverse=True)
                good[ask] = self._pairs(kinds)[inverse]
            good &= ~inner | done[np.maximum(s - 1, 0)]
            alone = good & ~inner
            if alone.any():  # a first piece is right if BPE of its own text gives it
                kinds, inverse = np.unique(own[alone], return_inverse=True)
                good[alone] = np.array([k < 0 or self._whole(k) for k in kinds.tolist()])[inverse]
            e, s, end, own = e[good], s[good], end[good], own[good]
            back[end], last[end], done[end] = s, own, True
        return back, last

    def _whole(self, piece: int) -> bool:
        key = -1 - piece
        found = self.compatible.get(key)
        if found is None:
            found = self.compatible[key] = self._merge(self.pieces[piece]) == [piece]
        return found

    # texts -> ids -> texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, count of each)."""
        units: list[str] = []
        counts = []
        split, head = self.split.findall, SPACE if self.prefix else ""
        for t in texts:
            found = split(head + t.replace(" ", SPACE)) if t else []
            counts.append(len(found))
            units += found
        if len(self.known) > KEEP:
            self.forget()
        fresh = list(set(units) - self.known.keys())
        if fresh:
            ends = np.cumsum([len(u) for u in fresh])
            at = 0
            while at < len(fresh):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEARN, "right")))
                self.learn(fresh[at:to])
                at = to
            self._settle()
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        which = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        size = self.size[which]
        ids = self.all[ranges(self.base[which], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, bytes of each)."""
        size = self.out_size[ids]
        data = self.out_data[ranges(self.out_base[ids], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        each = np.diff(ends, prepend=0)
        if self.prefix and len(data):
            first = (ends - each)[each > 0]
            drop = first[data[first] == 0x20]
            data = np.delete(data, drop)
            each = each - np.bincount(np.searchsorted(ends, drop, "right"), minlength=len(each))
        return data.tobytes(), each


def _by_depth(depth: np.ndarray) -> np.ndarray:
    """A stable order; small numbers are sorted by radix."""
    return np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")


def suffixes(first: np.ndarray, known: int, enough: int) -> np.ndarray:
    """Suffixes in the order of their first `enough` characters, by doubling:
    `first` orders `known` of them; ranks of a suffix and of the one that begins
    where these end order twice as many."""
    n = len(first)
    at = np.argsort(first)
    key = first
    while known < enough and n:
        s = key[at]
        rank = np.empty(n, np.int64)
        rank[at] = np.cumsum(np.append(True, s[1:] != s[:-1]))
        after = np.zeros(n, np.int64)
        more = max(n - known, 0)
        after[:more] = rank[known : known + more]
        key = rank * (n + 1) + after
        at = np.argsort(key)
        known *= 2
    return at


def _search(k: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each value in its own range of k."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = k[np.minimum(mid, len(k) - 1)]
        up = open_ & ((v <= values) if right else (v < values))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


_models: dict[int, Model] = {}


def loaded(data: bytes) -> Model:
    """The model of a file; its units stay known for a process's later tasks."""
    key = zlib.crc32(data)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data)
    return _models[key]


def _encode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(data)
        for whole in batches:
            for part in slices(whole, limit=1 << 20):
                texts = part.column("text")
                ids, counts = model.encode(texts.to_pylist())
                back, size = model.decode(ids, counts)
                ends = np.cumsum(size)
                binary = texts.cast(pa.binary())
                same = [x.is_valid and x.as_buffer() == back[e - n : e] for x, e, n in zip(binary, ends.tolist(), size.tolist())]
                null = np.asarray(texts.is_null())
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.append(null, False))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(counts.astype(np.int32), mask=null), pa.array(same, mask=null)],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )

    return run


def _decode(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(data)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                lists = [x or [] for x in part.column("ids").to_pylist()]
                ids = np.array([i for x in lists for i in x], np.int64)
                back, size = model.decode(ids, np.array([len(x) for x in lists]))
                ends = np.cumsum(size)
                texts = [back[e - n : e].decode("utf-8", "replace") for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.record_batch([part.column("doc_id"), pa.array(texts, pa.string(), mask=np.asarray(part.column("ids").is_null()))], ["doc_id", "text"])

    return run


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip): the ids of each text, and whether
    they decode to the very same text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with open(model, "rb") as f:
        return docs.mapInArrow(_encode(f.read()), "doc_id bigint, ids array<int>, n_tokens int, round_trip boolean")


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    with open(model, "rb") as f:
        return tokens.select("doc_id", "ids").mapInArrow(_decode(f.read()), "doc_id bigint, text string")
