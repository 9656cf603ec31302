"""Near copies, repeated passages, benchmark passages and licenses."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, hyperminhash, license, substring
from geoloom.llm import queries
from tests.helpers import compare
from tests.llm.fixtures import frame, prose, row


def folded(text):
    import re

    from geoloom.llm.common import FOLD_BREAK

    return [w for w in re.split(FOLD_BREAK, (text or "").lower()) if w]


def sets(docs):
    out = {}
    for d, t in docs:
        w = folded(t)
        if d is not None and w and d not in out:
            out[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}
    return out


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_copies_against_brute_force(spark):
    docs = []
    for g in range(12):
        base = prose(100 + g, 60).split()
        docs.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            changed = list(base)
            for i in range(k):
                changed[(i * 17 + k) % 60] = f"new{g}{k}{i}"
            docs.append((g * 10 + k, " ".join(changed)))
    docs += [(900 + i, prose(900 + i, 60)) for i in range(20)]
    s = sets(docs)
    ids = sorted(s)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) >= 0.5 * len(s[a] | s[b])]
    want = {n: g for n, g in components(pairs, ids).items() if sum(v == g for v in components(pairs, ids).values()) > 1}
    got = hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_near_copies_edge_cases(spark):
    got = {r.doc_id: r.group_id for r in hyperminhash.near_duplicates(frame(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    kept = hyperminhash.deduplicate(frame(spark))
    assert kept.columns == frame(spark).columns
    counts = Counter(r.doc_id for r in kept.collect())
    assert counts[9] == 1 and counts[None] == 2 and counts[1] == 1 and 2 not in counts and 8 not in counts and counts[4] == 1
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0 and hyperminhash.deduplicate(frame(spark, [])).count() == 0


def test_repeated_ids_keep_their_first_row_and_lose_no_other_text(spark):
    one, two = prose(50, 40), prose(51, 40)
    first, second = sorted([one, two])
    for rows, kept in (
        ([(3, second), (5, first), (5, second)], {3: second, 5: first}),  # 5 is its first text, no copy of 3
        ([(3, first), (5, first), (5, second)], {3: first}),  # 5 is its first text, a copy of 3
    ):
        docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, row int")
        assert {r.doc_id: r.text for r in hyperminhash.deduplicate(docs).collect()} == kept
        assert {r.doc_id for r in hyperminhash.near_duplicates(docs).collect()} == (set() if 5 in kept else {3, 5})
    many = spark.createDataFrame([(7, one)] * 300 + [(8, two)] * 2, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in hyperminhash.deduplicate(many).collect()) == [(7, one), (8, two)]


def test_short_documents_are_not_judged_by_few_registers(spark):
    docs = []
    for g in range(150):
        w = prose(2000 + g, 8).split()
        docs += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[:6] + ["other" + str(g)] * 2))]
    s = sets(docs)
    near = {(a, a + 1) for a in range(0, 300, 2) if len(s[a] & s[a + 1]) >= 0.5 * len(s[a] | s[a + 1])}
    got = {r.doc_id: r.group_id for r in hyperminhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(near) == 150 and sum(got.get(b) == a for a, b in near) >= 0.99 * len(near)


def test_register_estimate_is_near_the_jaccard():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 1 << 52, 3000, dtype=np.uint64), rng.integers(0, 1 << 52, 2000, dtype=np.uint64)
    rows = np.concatenate([np.zeros(4000, np.int64), np.ones(4000, np.int64)])
    values = np.concatenate([np.sort(np.concatenate([common, own[:1000]])), np.sort(np.concatenate([common, own[1000:]]))])
    sig = hyperminhash.registers(rows, values, 2)
    n = np.array([4000.0])
    assert abs(hyperminhash.estimate(sig[:1], sig[1:], n, n)[0][0] - 0.6) < 0.1


def brute_windows(docs, window):
    seen, spots = defaultdict(list), defaultdict(lambda: defaultdict(set))
    for d, t in sorted((d, t or "") for d, t in docs if d is not None):
        w = [x for x in "".join(c if c > " " else " " for c in t).split(" ") if x]
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])].append((d, i))
    for where in seen.values():
        if len(where) > 1:
            where.sort()
            for k, (d, i) in enumerate(where):
                spots[d]["remove" if k else "keep"].add(i)
    out = set()
    for d, kinds in spots.items():
        for action, at in kinds.items():
            at = sorted(at)
            start = prev = at[0]
            for i in at[1:] + [None]:
                if i is None or i > prev + window:
                    out.add((d, start, prev + window, action))
                    start = i
                prev = i
    return out


def test_repeated_windows_against_brute_force(spark):
    shared = prose(5, 60)
    docs = [(1, prose(6, 40) + " " + shared), (2, shared + " " + prose(7, 10)), (3, prose(8, 30)), (4, shared + " x " + shared), (5, None), (6, "")]
    got = substring.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string"), window=20)
    assert {tuple(r) for r in got.collect()} == brute_windows(docs, 20)


@pytest.mark.parametrize("parts,most", [(1, 8192), (40, 8192), (40, 3)])
def test_ranges_of_any_number_and_hot_passages_give_the_same(spark, monkeypatch, parts, most):
    hot = prose(9, 25)
    docs = [(i * 7 % 300, (hot + " " + prose(1000 + i, 30)) if i % 3 else prose(1000 + i % 5, 60)) for i in range(300)] + [(7, hot + " " + hot)]
    monkeypatch.setattr(substring, "PIECE", 4000)  # many pieces
    got = substring.repeated_spans(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), 20, parts, most)
    assert {tuple(r) for r in got.collect()} == brute_windows(docs, 20)


def test_a_hash_has_one_entry_a_piece():
    h = np.repeat(np.arange(3, dtype=np.uint64), [1, 500, 2])
    rng = np.random.default_rng(0)
    by = rng.permutation(len(h))
    doc, code = np.arange(503)[::-1].copy(), np.zeros(503, np.uint64)
    (one, first, mark), (others, _) = substring.distinct(h[by], doc[by], code[by])
    assert one.tolist() == [0, 1, 2] and first.tolist() == [502, 2, 0] and mark.tolist() == [0, 1, 1] and len(others) == 500


def test_repeated_windows_edge_cases(spark):
    got = defaultdict(set)
    for r in substring.repeated_spans(frame(spark)).collect():
        got[r.doc_id].add((r.action, r.start_token, r.end_token))
    assert got[7] == {("keep", 0, 60000)} and got[8] == {("remove", 0, 60000)}
    assert got[9] == {("keep", 0, 80), ("remove", 0, 80)} and None not in got and 4 not in got and 12 not in got
    assert substring.repeated_spans(frame(spark, [])).count() == 0


def brute_contaminated(docs, items, length, coverage, least):
    import math

    want = set()
    for t in items:
        w = folded(t)
        if len(w) >= least:
            m = int(min(length, max(least, math.ceil(coverage * len(w) - 1e-9))))
            want |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    out = set()
    for d, t in docs:
        w, hit = folded(t), []
        for m in {len(x) for x in want}:
            hit += [(i, i + m) for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in want]
        for s, e in decontaminate.union(hit):
            out.add((d, s, e))
    return out


def test_contamination_against_brute_force(spark):
    items = [prose(20, 40), prose(21, 8), "a b c", None, "", prose(22, 15)]
    docs = [(1, prose(23, 20) + " " + items[0].upper() + " " + prose(24, 5)), (2, items[1]), (3, " ".join(items[0].split()[5:17])), (4, " ".join(items[0].split()[5:18])), (5, "a b c"), (6, items[5] + ", " + items[1]), (7, None), (8, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    want = brute_contaminated(docs, items, 13, 0.8, 5)
    assert {tuple(r) for r in decontaminate.contaminated_spans(d, b).collect()} == want
    assert {tuple(r) for r in decontaminate.contaminated_spans(d, b, shard_tokens=10).collect()} == want
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b).collect()}
    assert left[2] == "" and left[5] == "a b c" and left[7] is None and left[1].split() == (prose(23, 20) + " " + prose(24, 5)).split()


def test_shards_cut_what_one_shard_cuts(spark):
    context, ask, other = prose(30, 15), prose(31, 10), prose(32, 10)
    docs = [(1, f"{prose(33, 6)} {context} {ask} {prose(34, 6)}", 7), (2, f"{context} {other}", 7), (3, prose(35, 9), 7), (4, None, 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, spans int")
    b = spark.createDataFrame([(0, f"{context} {ask}"), (1, f"{context} {other}")], "item_id bigint, text string")
    left = [sorted((tuple(r) for r in decontaminate.decontaminate(d, b, shard_tokens=n).collect())) for n in (1_000_000, 10)]
    assert left[0] == left[1] and (2, "", 7) in left[0]
    assert {r.doc_id for r in decontaminate.contaminated_spans(d, b, shard_tokens=10).collect()} == {1, 2}


def test_shards_take_one_python_worker_a_task(spark):
    d = spark.createDataFrame([(i, prose(40 + i, 30)) for i in range(6)], "doc_id bigint, text string")
    for items in (1, 4):
        b = spark.createDataFrame([(i, prose(40 + i, 20)) for i in range(items)], "item_id bigint, text string")
        out = decontaminate.decontaminate(d, b, shard_tokens=10)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert [len(r.text.split()) for r in out.orderBy("doc_id").collect()] == [10] * items + [30] * (6 - items)


def test_a_worker_holds_one_shard():
    class Shared:
        most = 0

        def __init__(self, texts):
            self.texts = texts

        @property
        def value(self):
            if "_value" not in self.__dict__:
                self._value = decontaminate.Matcher(self.texts, 13, 0.8, 5)
            Shared.most = max(Shared.most, sum("_value" in x.__dict__ for x in shared))
            return self._value

    shared = [Shared([prose(40 + i, 20)]) for i in range(3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1, 2, 3], "text": [prose(40 + i, 30) for i in range(4)]})
    for _ in range(2):
        out = list(decontaminate._cut(shared, False)(iter([batch, batch])))
        assert [len(t.split()) for x in out for t in x.column("text").to_pylist()] == [10, 10, 10, 30] * 2
    assert Shared.most == 1


def test_automaton_is_flat_and_finds_longest_matches():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 6, rng.integers(5, 30)).tolist() for _ in range(40)]
    a = decontaminate.Automaton([list(x) for x in items], 1.0, 1)
    grams = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    stream = rng.integers(0, 7, 300).astype(np.uint64)
    got = dict((e, s) for s, e in a.removed(stream, 4))
    for e in range(1, 301):
        longest = max((n for n in range(0, min(e, 30) + 1) if tuple(stream[e - n : e].tolist()) in grams or n == 0))
        assert (longest >= 4) == (e in got and e - got[e] >= 4) and (longest < 4 or got[e] == e - longest)
    assert a.token.nbytes + a.to.nbytes + a.link.nbytes * 5 < 110 * sum(map(len, items))


def test_contamination_edge_cases(spark):
    docs, bench = frame(spark), spark.createDataFrame([(1, prose(3, 80), 0), (None, None, 1), (2, "", 2)], "item_id bigint, text string, doc_id bigint")
    assert {r.doc_id for r in decontaminate.contaminated_spans(docs, bench).collect()} == {9}
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert [(r.text, r.n_chars) for r in out.where("doc_id = 9").collect()] == [("", 0)] * 2
    assert decontaminate.contaminated_spans(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_licenses_and_edge_cases(spark):
    mit = license.TEMPLATES["MIT-grant"]
    docs = frame(spark, [row(20, prose(1, 200) + "\n" + mit.upper() + "\n" + prose(2, 300)), row(21, " ".join(mit.split()[:20])), row(22, None), row(None, mit), row(23, ""), row(20, prose(1, 200) + "\n" + mit.upper() + "\n" + prose(2, 300))])
    got = {(r.doc_id, r.license): r.containment for r in license.licenses(docs).collect()}
    assert got == {(20, "MIT-grant"): 1.0}
    assert license.licenses(frame(spark)).count() == 0 and license.licenses(frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    compare(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])
