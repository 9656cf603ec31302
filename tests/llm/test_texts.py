"""Personal data, token ids, URLs, neighbours."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import permutation, pii, sentencepiece, urlfilter
from tests.llm.fixtures import frame, prose, row

CASES = [
    ("mail jo.doe+x@mail.example.org now", "email", "jo.doe+x@mail.example.org"),
    ("see https://example.com/a?b=c today", "url", "https://example.com/a?b=c"),
    ("host 192.168.10.254 is up", "ip", "192.168.10.254"),
    ("id 123-45-6789 given", "ssn", "123-45-6789"),
    ("card 4111 1111 1111 1111 ok", "card", "4111 1111 1111 1111"),
    ("pay to DE89370400440532013000 please", "iban", "DE89370400440532013000"),
    ("call +44 20 7946 0958 soon", "phone", "+44 20 7946 0958"),
    ("mail jo@bücher.example now", "email", "jo@bücher.example"),
    ("host 2001:db8:85a3::8a2e:370:7334 is up", "ip", "2001:db8:85a3::8a2e:370:7334"),
    ("host 2001:0db8:85a3:0000:0000:8a2e:0370:7334, up", "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    ('apiKey: "abcd1234abcd1234"', "secret", "abcd1234abcd1234"),
    ("Api_Key = " + "q7" * 300, "secret", "q7" * 300),
    ("tokens token " + "token9" * 20_000, "secret", "token9" * 20_000),
    ("account number 12345678 given", "account", "12345678"),
    ("ACCT: 1234-567-890.", "account", "1234-567-890"),
]
CLEAN = ["an @ sign alone", "version 1.2.3.4.5 of 300.1.1.1", "at 10-20-30 we met", "DE00370400440532013000 is no account", "chapter 12, page 1999, 3.14159", "a@b", "std::vector of 12:34:56 at 00:1A:2B:3C:4D:5E", "on account of 2024-01-01", "İ token of nothing here"]


@pytest.mark.parametrize("text,kind,value", CASES)
def test_finds(text, kind, value):
    anchors = pii.automaton()
    assert [(text[s:e], k) for s, e, k in pii.findings(text, anchors)] == [(value, kind)]


@pytest.mark.parametrize("text", CLEAN)
def test_leaves_clean_text_alone(text):
    assert pii.findings(text, pii.automaton()) == []


def brute_findings(text):
    """Every parser's pattern at every position of the text, without anchors, windows or skips."""
    found = set()
    low = pii.lowered(text)
    for i in range(len(text)):
        if text[i] == "@":
            found.update(pii._email(text, i))
        if text.startswith("://", i) and (m := pii._SCHEME.match(text, max(0, i - 16), i)):
            found.update(pii._url(text, m.start(), i + 3))
        if low.startswith("www.", i) and not (i and (text[i - 1].isalnum() or text[i - 1] in "/.@")):
            found.update(pii._url(text, i, i))
        if (m := pii._IP.match(text, i)) and all(int(x) < 256 for x in m.groups()):
            found.add((i, m.end(), "ip"))
        if (m := pii._HEX.match(text, i)) and (i == 0 or text[i - 1] not in "0123456789abcdefABCDEF:"):
            found.update(pii._ipv6(text, i))
        for kind, pattern in (("ssn", pii._SSN), ("phone", pii._NATIONAL)):
            if m := pattern.match(text, i):
                found.add((i, m.end(), kind))
        if (m := pii._PLUS.match(text, i)) and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.add((i, m.end(), "phone"))
        if m := pii._DIGITS.match(text, i):
            digits = [c for c in m.group() if c.isdigit()]
            if 12 <= len(digits) <= 19:
                found.add((i, m.end(), "card" if len(digits) > 12 and pii.luhn("".join(digits)) else "account"))
        if (m := pii._IBAN.match(text, i)) and pii.mod97(m.group()):
            found.add((i, m.end(), "iban"))
        for cues, pattern, kind in ((pii.CUES, pii._SECRET, "secret"), (pii.ACCOUNTS, pii._ACCOUNT, "account")):
            for cue in cues:
                if low.startswith(cue, i) and (m := pattern.match(text, i + len(cue))) and any(c.isdigit() for c in m.group(1)):
                    found.add((m.start(1), m.end(1), kind))
    out = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or s >= out[-1][1]:
            out.append((s, e, kind))
    return out


PARTS = ["jo.doe@mail.example.org", "a@b", "https://example.com/a?b=1", "www.x.example", "192.168.1.2", "1.2.3.4.5", "300.1.1.1", "123-45-6789", "(212) 555-0199", "212 555 0199", "+44 20 7946 0958", "4111 1111 1111 1111", "4111111111111112", "123456789012", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "token = abcdef0123456789abcdef", "API-KEY:", "secret", "account no. 123456", "acct", "2001:db8::1", "::", "12:34:56", "é", "İ", "9", "77", "-", ".", ":", "@", "+", "x" * 20, "\n"]


@pytest.mark.parametrize("glue", [" ", ""])
def test_findings_equal_brute_force_on_mixed_strings(glue):
    import random

    r, anchors = random.Random(len(glue)), pii.automaton()
    for _ in range(400):
        text = glue.join(r.choice(PARTS) for _ in range(r.randrange(1, 9)))
        assert pii.findings(text, anchors) == brute_findings(text), text


def test_query_equals_brute_force(spark, sf):
    from geoloom.llm import queries

    got = {}
    for r in queries.find_pii(spark, sf).collect():
        got.setdefault(r.doc_id, set()).add((r.start_char, r.end_char, r.kind))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {r.doc_id: set(f) for r in docs if (f := brute_findings(r.text))} == got


def test_pii_edge_cases(spark):
    mail = "write to a.b@example.com"
    rows = [row(1, mail), row(1, mail), row(2, None), row(3, ""), row(None, mail), row(4, "x" * 300_000 + " a@example.org " + "9" * 50_000)]
    docs = frame(spark, rows)
    assert sorted((r.doc_id, r.kind) for r in pii.pii(docs).collect()) == [(1, "email"), (4, "email")]
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == 6
    assert {(r.text, r.n_chars) for r in out.where("doc_id = 1 OR doc_id IS NULL").collect()} == {("write to <EMAIL>", 16)}
    assert out.where("doc_id = 2").first().text is None
    assert pii.pii(frame(spark, [])).count() == 0 and pii.redact(frame(spark, [])).count() == 0 and pii.redact(frame(spark)).count() == 16


def test_ids_equal_the_public_library(spark):
    import sentencepiece as public

    known = public.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in sentencepiece.encoded(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == known.encode(r.text)


def test_round_trip_and_edge_cases(spark):
    docs = frame(spark)
    out = sentencepiece.encoded(docs)
    rows = out.collect()
    assert len(rows) == 16
    assert all(r.round_trip for r in rows if r.doc_id not in (4, 13, None))
    assert [r.ids for r in rows if r.doc_id == 4] == [None] and [r.ids for r in rows if r.doc_id == 5] == [[]]
    back = {r.doc_id: r.text for r in sentencepiece.decoded(out.where("doc_id IS NOT NULL")).collect()}
    want = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    assert all(back[k] == want[k] for k in want if k != 13)
    assert sentencepiece.encoded(frame(spark, [])).count() == 0


def test_short_texts_of_every_length_and_second_batches():
    import sentencepiece as public

    known = public.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    with open(sentencepiece.MODEL, "rb") as f:
        data = f.read()
    line = "a good dog runs over the old stone bridge"
    for n in range(1, len(line) + 1):
        model = sentencepiece.Model(data)
        assert model.encode([line[:n]])[0].tolist() == known.encode(line[:n])
        for word in ("cat", "I", "a good dog", "x" * (n % 12 + 1)):  # a second batch brings one new short unit
            assert model.encode([line[:n], word])[0].tolist() == known.encode(line[:n]) + known.encode(word)


def test_forgetting_changes_nothing(monkeypatch):
    with open(sentencepiece.MODEL, "rb") as f:
        data = f.read()
    texts = [prose(i, 50) for i in range(20)]
    whole = sentencepiece.Model(data).encode(texts)[0].tolist()
    monkeypatch.setattr(sentencepiece, "KEEP", 5)
    monkeypatch.setattr(sentencepiece, "KEEP_PAIRS", 5)
    model = sentencepiece.Model(data)
    assert [i for t in texts for i in model.encode([t])[0].tolist()] == whole


def test_memory_of_a_batch_of_new_units():
    import sentencepiece as public

    with open(sentencepiece.MODEL, "rb") as f:
        model = sentencepiece.Model(f.read())
    rng = np.random.default_rng(6)
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (60_000, 7))
    text = " ".join("".join(x) for x in letters.tolist())
    tracemalloc.start()
    ids = model.encode([text])[0].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak
    assert ids == public.SentencePieceProcessor(model_file=sentencepiece.MODEL).encode(text)


def test_url_filter_on_urls_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    seeds = urlfilter.seeded(pages)
    some = seeds.where(F.pmod(F.xxhash64("url"), F.lit(3)) > 0)
    out = urlfilter.filtered(pages, some).join(pages.select("page_id", "url"), "page_id").join(seeds.distinct(), "url")
    rest = out.where(F.pmod(F.xxhash64("url"), F.lit(3)) == 0).groupBy("bad").agg(F.avg(F.col("blocked").cast("int")).alias("b")).collect()
    got = {r.bad: r.b for r in rest}
    assert got[1] > 0.9 and got[0] < 0.02


def test_url_filter_learns_lexical_labels_on_hosts_not_seen(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        bad = int(rng.random() < 0.3)
        digits = "".join(map(str, rng.integers(0, 10, 14 if bad else 3)))
        query = "?" + "&".join(f"k{j}=v" for j in range(6)) if bad and rng.random() < 0.8 else ""
        rows.append((i, f"http://h{i % 100}.example.com/{'x/' * int(rng.integers(1, 4))}{digits}{query}", bad if rng.random() < 0.95 else 1 - bad, bad))
    df = spark.createDataFrame(rows, "page_id bigint, url string, bad int, truth int")
    out = urlfilter.filtered(df.drop("bad", "truth"), df.where("page_id % 100 < 70").select("url", "bad")).join(df, "page_id").where("page_id % 100 >= 70")
    good = out.agg(F.avg((F.col("blocked").cast("int") == F.col("truth")).cast("int"))).first()[0]
    assert good > 0.97


def test_url_edge_cases(spark):
    urls = ["http://casino-win.example.com/a", None, "", "casino-win.example.com", "http://", "x" * 100_000, "http://a.example.org/é?b=1&c=2#d", "http://a.example.org/é?b=1&c=2#d"]
    pages = spark.createDataFrame([(i if i != 3 else None, u, 1, 2.0) for i, u in enumerate(urls)], "page_id bigint, url string, bad int, count2 double")
    out = urlfilter.filtered(pages)
    rows = out.collect()
    assert len(rows) == 8 and out.columns == ["page_id", "score", "blocked"]
    assert all(r.score is None and not r.blocked for r in rows if r.page_id in (1, 2))
    assert len({r.score for r in rows if r.page_id in (6, 7)}) == 1
    assert urlfilter.filtered(pages.limit(0)).count() == 0
    good = spark.createDataFrame([("http://b.example.org", 0)], "url string, bad int")
    assert {r.score for r in urlfilter.filtered(pages, good).where("score IS NOT NULL").collect()} == {0.0}
    assert {r.score for r in urlfilter.filtered(pages, good.limit(0)).where("score IS NOT NULL").collect()} == {0.0}


def test_suffix_shares_cover_labels_beyond_the_sample(spark):
    hosts = [("spam" if i % 3 == 0 else "maps", i) for i in range(900)]
    pages = spark.createDataFrame([(i * 10 + k, f"http://{w}.h{i:03d}.com/p{k}") for w, i in hosts for k in range(3)], "page_id bigint, url string")
    out = urlfilter.filtered(pages, labelled=200).collect()
    assert len(out) == 2700 and sum(r.blocked == (r.page_id // 10 % 3 == 0) for r in out) > 0.97 * 2700


def brute(ids, x, k):
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[n, j], ids[j]))[:k] if ids[j] != i] for n, i in enumerate(ids)}


def test_queries_are_the_ids_that_fifty_divides(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.toPandas()
    ids, x = pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"]).astype(float)
    some = ids % 50 == 0
    want = {}
    for i, q in zip(ids[some], x[some]):
        s = np.round(x @ q, 6)
        s[ids == i] = -9
        want[i] = set(ids[np.lexsort((ids, -s))[:10]])
    got = permutation.neighbours(df).toPandas().groupby("vec_id")["neighbour_id"].apply(set)
    assert set(got.index) <= set(want)
    assert sum(len(want[i] & got.get(i, set())) for i in want) >= 0.96 * 10 * len(want)


def test_closeness_is_the_footrule_distance():
    rng = np.random.default_rng(1)
    posted = 5
    ranks = np.stack([rng.permutation(9)[:posted] for _ in range(40)]).astype(np.int32)
    files, q = permutation.Files(ranks), rng.permutation(9)[:posted].astype(np.int32)
    place = lambda order: {int(p): i for i, p in enumerate(order)}
    for pivot in q:
        close = files.close(q, pivot)
        for i, row in enumerate(ranks):
            a, b = place(q), place(row)
            foot = sum(abs(a.get(p, posted) - b.get(p, posted)) for p in range(9))
            earlier = any(p in b for p in q[: a[int(pivot)]])
            assert close[i] == (0 if earlier else (posted * (posted + 1) - foot) / 2)


@pytest.mark.parametrize("tile", [8192, 60])
def test_recall_of_neighbours(spark, tile):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    pdf = df.toPandas()
    want = brute(pdf["vec_id"].tolist(), np.stack(pdf["embedding"]).astype(float), 10)
    got = permutation.neighbours(df, tile=tile, every=1).toPandas().sort_values(["vec_id", "rank"]).groupby("vec_id")["neighbour_id"].apply(list)
    hits = sum(len(set(want[i]) & set(got.get(i, []))) for i in want)
    assert hits >= 0.95 * 10 * len(want)


def test_posted_pivots_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(permutation, "LEAST_PIVOTS", 2048)  # as many as millions of vectors have
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    some = np.arange(0, 4000, 20)
    cosines = unit[some] @ unit.T
    cosines[np.arange(len(some)), some] = -2
    want = {int(q): set(np.argsort(-c)[:10].tolist()) for q, c in zip(some, cosines)}
    got = {}
    for r in permutation.neighbours(df, every=20).where(F.col("vec_id").isin(list(want))).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert sum(len(want[q] & got.get(q, set())) for q in want) >= 0.97 * 10 * len(want)


def test_neighbour_edge_cases(spark):
    e = [1.0, 0.0]
    rows = [(1, e, "a"), (2, e, "a"), (3, [0.5, 0.0], "a"), (3, [0.5, 0.0], "a"), (4, None, "a"), (5, [], None), (6, [0.0, 0.0], "a"), (7, [float("nan"), 1.0], "a"), (8, [1.0, 2.0, 3.0], "a"), (None, e, "a"), (9, [0.0, 1.0], "a"), (10, [1.0, None], "a"), (11, [1e-300, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, v string").withColumn("pivot", F.lit(1))
    out = permutation.neighbours(df, every=1)
    got = {}
    for r in out.orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbour_id, r.cosine))
    assert set(got) == {1, 2, 3, 9, 11}
    assert got[1][:3] == [(2, 1.0), (3, 1.0), (11, 1.0)] and got[1][3] == (9, 0.0)
    assert permutation.neighbours(df.limit(0)).count() == 0 and permutation.neighbours(df.where("vec_id = 1")).count() == 0
