"""Queries of composite indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import correlation
from geoloom.operators import composite as C

from .registry import query
from .roles import table

NAMES = ("accounts", "balance", "orders", "volume", "suppliers", "stock")
INVERT = ("balance", "stock")
WEIGHTS = {"accounts": 3.0, "balance": 2.0, "orders": 3.0, "volume": 2.0, "suppliers": 1.0, "stock": 1.0}


def indicators(spark: SparkSession, d: str) -> DataFrame:
    """Nations by six indicators."""
    c, o, s = (table(spark, d, t) for t in ("customer", "orders", "supplier"))
    by = c.groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("accounts"), F.round(F.avg("c_acctbal"), 6).alias("balance"))
    sales = o.join(c.select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")).groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("volume"))
    sup = s.groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("stock"))
    return by.join(sales, "id").join(sup, "id")


_IND = """a AS (SELECT c_nationkey AS id, count(*) AS accounts, round(avg(c_acctbal), 6) AS balance FROM customer GROUP BY 1), b AS (SELECT c_nationkey AS id, count(*) AS orders, round(avg(o_totalprice), 6) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
c AS (SELECT s_nationkey AS id, count(*) AS suppliers, round(avg(s_acctbal), 6) AS stock FROM supplier GROUP BY 1), wide AS (SELECT * FROM a JOIN b USING (id) JOIN c USING (id)),
long AS (""" + " UNION ALL ".join(f"SELECT id, '{n}' AS indicator, CAST({n} AS DOUBLE) AS value, {WEIGHTS[n] / sum(WEIGHTS.values())!r} AS weight, {n in INVERT} AS flip FROM wide" for n in NAMES) + ")"
_SCORE = {
    "minmax": "CASE WHEN max(value) OVER w - min(value) OVER w >= 1e-12 THEN (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) ELSE 0.5 END",
    "zscore": "CASE WHEN stddev_pop(value) OVER w >= 1e-12 THEN (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) ELSE 0 END",
    "rank": "(rank() OVER (PARTITION BY indicator ORDER BY value) + (count(*) OVER (PARTITION BY indicator, value) - 1) / 2.0) / count(*) OVER w",
}


def _scored(method: str) -> str:
    return f"{_IND}, raw AS (SELECT *, {_SCORE[method]} AS s FROM long WINDOW w AS (PARTITION BY indicator)), scored AS (SELECT id, indicator, weight, CASE WHEN flip THEN 1 - s ELSE s END AS score FROM raw)"


_RANK = "CAST(rank() OVER ({p} ORDER BY composite DESC) + (count(*) OVER (PARTITION BY {q} composite) - 1) / 2.0 - 0.25 AS INT)"


def _composite(method: str) -> str:
    rank = _RANK.format(p="", q="")
    return f"WITH {_scored(method)}, t AS (SELECT id, round(sum(score * weight), 12) AS composite FROM scored GROUP BY id) SELECT id, round(composite, 6) AS composite, {rank} AS rank FROM t"


def _run(spark, d, method) -> DataFrame:
    return C.composite(indicators(spark, d), "id", NAMES, WEIGHTS, method, INVERT).withColumn("composite", F.round("composite", 6))


@query(_composite("minmax"))
def composite_minmax(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "minmax")


@query(_composite("zscore"))
def composite_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "zscore")


@query(_composite("rank"))
def composite_rank(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "rank")


@query(f"""WITH {_IND}, ref AS (SELECT indicator, avg(value) AS mu, stddev_pop(value) AS sd FROM long JOIN nation ON n_nationkey = id WHERE n_regionkey = 0 GROUP BY 1),
s AS (SELECT id, weight, flip, CASE WHEN sd >= 1e-12 THEN (value - mu) / nullif(sd, 0) ELSE 0 END AS s FROM long JOIN ref USING (indicator)),
t AS (SELECT id, round(sum(CASE WHEN flip THEN 1 - s ELSE s END * weight), 12) AS composite FROM s GROUP BY id) SELECT id, round(composite, 6) AS composite, {_RANK.format(p='', q='')} AS rank FROM t""")
def composite_against_reference(spark: SparkSession, d: str) -> DataFrame:
    """All nations by the spread of one region's: the reference set."""
    wide = indicators(spark, d)
    own = wide.join(table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("id")), "id")
    return C.composite(wide, "id", NAMES, WEIGHTS, "zscore", INVERT, reference=own).withColumn("composite", F.round("composite", 6))


@query("WITH " + ", ".join(f"{m} AS ({_composite(m)})" for m in C.METHODS) + """
SELECT minmax.id, minmax.rank AS minmax, zscore.rank AS zscore, rank.rank AS "rank", greatest(minmax.rank, zscore.rank, rank.rank) - least(minmax.rank, zscore.rank, rank.rank) AS spread FROM minmax JOIN zscore USING (id) JOIN rank USING (id)""")
def normalisation_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by all three methods side by side: a pivot."""
    parts = [_run(spark, d, m).select("id", "rank", F.lit(m).alias("method")) for m in C.METHODS]
    wide = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").pivot("method", list(C.METHODS)).agg(F.first("rank"))
    return wide.withColumn("spread", F.greatest(*C.METHODS) - F.least(*C.METHODS))


@query(f"""WITH {_scored('zscore')}, t AS (SELECT d.indicator AS dropped, s.id, round(sum(s.score * s.weight) / sum(s.weight), 12) AS composite FROM scored s JOIN (SELECT DISTINCT indicator FROM scored) d ON d.indicator <> s.indicator GROUP BY 1, 2)
SELECT dropped, id, round(composite, 6) AS composite, {_RANK.format(p='PARTITION BY dropped', q='dropped,')} AS rank FROM t""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    out = C.leave_one_out(indicators(spark, d), "id", NAMES, WEIGHTS, "zscore", INVERT)
    return out.withColumn("composite", F.round("composite", 6))


#: Weights of 64 draws as literal rows, from a linear recurrence, so that SQL can have them too.
def _draws() -> list[tuple[int, str, float]]:
    out, state = [], 12345
    for k in range(64):
        raw = []
        for _ in NAMES:
            state = (1103515245 * state + 12345) % (1 << 31)
            raw.append(state / (1 << 31) + 0.01)
        out += [(k, n, round(x / sum(raw), 9)) for n, x in zip(NAMES, raw)]
    return out


_SENS = f"""WITH {_scored('zscore')}, d AS (SELECT * FROM (VALUES {', '.join(map(str, _draws()))}) t(draw, indicator, w)), e AS (SELECT draw, id, round(sum(score * w), 12) AS s FROM scored JOIN d USING (indicator) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY s DESC, id) AS rank FROM e),
m AS (SELECT id, avg(s) AS mean_score, quantile_cont(s, 0.05) AS score_p05, quantile_cont(s, 0.95) AS score_p95 FROM k GROUP BY id),
p AS (SELECT id, CAST(rank AS INT) AS rank, count(*) / 64.0 AS probability FROM k GROUP BY 1, 2)"""


def _sensitivity(spark, d, digits=None) -> DataFrame:
    draws = spark.createDataFrame(_draws(), "draw int, indicator string, weight double")
    long = C.normalized(C.melted(indicators(spark, d), "id", NAMES), "id", "zscore", INVERT)
    return C.weight_sensitivity(long, "id", draws, digits)


@query(_SENS + " SELECT id, rank, round(probability, 6) AS probability, round(mean_score, 6) AS mean_score, round(score_p05, 6) AS score_p05, round(score_p95, 6) AS score_p95 FROM p JOIN m USING (id)")
def weight_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return _sensitivity(spark, d, 6)


@query(_SENS + " SELECT round(avg(m), 6) AS stability FROM (SELECT id, max(probability) AS m FROM p GROUP BY id)")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    return C.rank_stability(_sensitivity(spark, d), "id").withColumn("stability", F.round("stability", 6))


@query(f"""WITH {_IND}, pairs AS (SELECT a.indicator AS first, b.indicator AS second, corr(a.value, b.value) AS r FROM long a JOIN long b ON a.id = b.id AND a.indicator < b.indicator GROUP BY 1, 2) SELECT first, second, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS r FROM pairs""")
def indicator_correlations(spark: SparkSession, d: str) -> DataFrame:
    wide = indicators(spark, d)
    pairs = [(a, b) for a in sorted(NAMES) for b in sorted(NAMES) if a < b]
    one = wide.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])))


@query(f"""WITH {_IND} SELECT id, CASE WHEN concat_ws('; ', CASE WHEN accounts < 60 THEN 'few accounts' END, CASE WHEN stock < 4500 THEN 'low stock' END) = '' THEN 'none'
  ELSE concat_ws('; ', CASE WHEN accounts < 60 THEN 'few accounts' END, CASE WHEN stock < 4500 THEN 'low stock' END) END AS caveats, round(accounts * (1 - least(greatest(balance / 10000, 0), 1)), 6) AS priority FROM wide""")
def decision_summary(spark: SparkSession, d: str) -> DataFrame:
    w = indicators(spark, d).withColumn("recovery", F.col("balance") / 10_000)
    notes = C.caveats({"few accounts": F.col("accounts") < 60, "low stock": F.col("stock") < 4500})
    return w.select("id", notes.alias("caveats"), F.round(C.priority("accounts", "recovery"), 6).alias("priority"))
