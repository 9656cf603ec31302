"""Queries of governance, nested sources and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom import governance as G
from geoloom.functions.sizes import small
from geoloom.sources import parse
from geoloom.sources.files import soil_properties

from .registry import query
from .roles import table

_TIERS = "(VALUES ('AFRICA', 2), ('AMERICA', 0), ('ASIA', 1), ('EUROPE', 0), ('MIDDLE EAST', 1)) t(name, tier_rank)"


@query(f"SELECT n_nationkey AS id, n_name AS nation, tier_rank FROM nation JOIN region ON n_regionkey = r_regionkey JOIN {_TIERS} ON r_name = name WHERE tier_rank <= 1")
def tier_filter(spark: SparkSession, d: str) -> DataFrame:
    policy = spark.sql(f"SELECT * FROM {_TIERS}")
    n = table(spark, d, "nation").join(small(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey")).join(F.broadcast(policy), F.expr("r_name = name"))
    return G.visible(n, G.Access.COMMUNITY).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation"), "tier_rank")


@query("SELECT * FROM (VALUES ('PUBLIC', 'perimeters', 'permitted'), ('COMMUNITY', 'land status', 'permitted'), ('COMMUNITY', 'wells', 'denied'), ('RESTRICTED', 'sites', 'denied')) t(tier, dataset, result)")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    day = date(2024, 6, 1)
    deal = G.Agreement("N", "U", "study", date(2024, 1, 1), date(2024, 12, 31), "council", (G.Tier.PARTNER, G.Tier.COMMUNITY), ("land status",))
    keeper = G.Gatekeeper("N", deal)
    for tier, name in ((G.Tier.PUBLIC, "perimeters"), (G.Tier.COMMUNITY, "land status"), (G.Tier.COMMUNITY, "wells"), (G.Tier.RESTRICTED, "sites")):
        try:
            keeper.check(tier, name, on=day)
        except G.AccessDenied:
            pass
    return keeper.audit(spark).select("tier", "dataset", F.element_at(F.split("result", ":"), 1).alias("result"))


@query("SELECT p.principle, p.n AS questions, p.met, p.un AS unaddressed FROM (VALUES ('Collective benefit', 2, 1, 1), ('Authority to control', 3, 2, 1), ('Responsibility', 2, 0, 1), ('Ethics', 2, 1, 1), (NULL, 9, 4, 4)) p(principle, n, met, un)")
def care_report(spark: SparkSession, d: str) -> DataFrame:
    q = [x for qs in G.CARE.values() for x in qs]
    return G.care_assessment(spark, {q[0]: True, q[2]: True, q[3]: True, q[5]: False, q[7]: True})


_SCAN = " UNION ALL ".join(f"SELECT DISTINCT '{c}=' || {c} AS found FROM documents WHERE regexp_matches(lower({c}), 'src1|lang') AND (SELECT count(DISTINCT {c}) FROM documents) <= 200" for c in ("text", "lang", "source"))


@query(f"SELECT 'lang' AS found UNION ALL {_SCAN}")
def sensitive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Names and values of all columns with one of two hints."""
    found = G.suspicious(table(spark, d, "documents"), ("src1", "lang"))
    return spark.createDataFrame([(x,) for x in found], "found string")


@query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return parse.flattened(table(spark, d, "events"), "props", "k bigint").select(F.col("event_id").alias("id"), "k")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM (SELECT DISTINCT user_id, ts, value FROM events) GROUP BY 1, 2")
def dedup_union(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of a feed, put together and freed of repeats."""
    e = table(spark, d, "events").select("user_id", "ts", "value")
    parts = parse.windows(e, "ts", days=10, overlap=2)
    return parse.merged(parts, ["user_id", "ts", "value"]).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS site, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem l JOIN part ON p_partkey = l_partkey WHERE p_size = 1 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def component_join(spark: SparkSession, d: str) -> DataFrame:
    """The soil survey's joins, with suppliers as map units, lines as components
    and parts as horizons."""
    supplier = table(spark, d, "supplier")
    component = table(spark, d, "lineitem").selectExpr("l_suppkey AS mukey", "l_partkey AS cokey", "l_quantity")
    horizon = table(spark, d, "part").selectExpr("p_partkey AS cokey", "p_size - 1 AS hzdept_r")
    units = supplier.where("s_acctbal > 0").selectExpr("s_suppkey AS mukey")
    out = soil_properties(supplier.selectExpr("s_suppkey AS mukey"), component, horizon, units)
    return out.groupBy(F.col("mukey").alias("site")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("total"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("SELECT c_mktsegment AS segment, " + ", ".join(f"""round(avg(CASE WHEN r_name = '{r}' THEN c_acctbal END), 4) AS "{r}\"""" for r in REGIONS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def pivoted(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(small(table(spark, d, "nation")), F.expr("c_nationkey = n_nationkey")).join(small(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    return j.groupBy(F.col("c_mktsegment").alias("segment")).pivot("r_name", REGIONS).agg(F.round(F.avg("c_acctbal"), 4))
