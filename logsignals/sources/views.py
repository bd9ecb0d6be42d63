"""Log views over the given tables, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.operators.batching import ranked
from logsignals.tables import table

WINDOW = 500
ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

#: Columns of the planted view by engine-neutral SQL; {div} is integer division. b is the batch, i the place in it, m = b % 10 its scenario; in `rush` one client calls a service that is
#: quiet otherwise, in `crowd` one client is busy beside four bots.
_FLAGS = {"rush": "b%40=39 AND i>=100 AND i<400", "crowd": "b%40=31 AND i%10 IN (1,2,3,4,6,7)", "bots": "b%40=31 AND i%10 IN (8,9)"}
_PLANTED = {
    "tenant": "CASE WHEN (b {div} 10)%3=0 THEN 'south' ELSE 'north' END",
    "ip": """CASE WHEN m=1 AND i%10=0 THEN '203.0.113.1' WHEN m=1 AND i%10=5 THEN '203.0.113.11' WHEN m=2 AND i<150 THEN '203.0.113.2' WHEN m=3 AND i<10 THEN '203.0.113.3'
 WHEN m=4 AND i<475 THEN '203.0.113.4' WHEN m=5 AND i%2=0 THEN '198.51.100.1' WHEN m=5 THEN '198.51.100.'||cast(2+i%13 AS {text}) WHEN m=6 AND i<100 THEN '203.0.113.6' WHEN m=7 AND i<200 THEN '203.0.113.7'
 WHEN m=8 AND i<400 THEN '203.0.113.8' WHEN m=9 AND i<60 THEN '203.0.113.9' WHEN rush OR crowd THEN '203.0.113.12' WHEN bots THEN '203.0.113.'||cast(5+i%10 AS {text}) ELSE '10.0.'||cast(l_suppkey {div} 256 AS {text})||'.'||cast(l_suppkey%256 AS {text}) END""",
    "endpoint": """CASE WHEN m=3 AND i<10 AND i%2=0 THEN '/search?q=%3Cscript%3Ealert(1)' WHEN m=3 AND i<10 THEN '/item?id=1%27%20or%201' WHEN m=2 AND i<150 OR m=4 AND i<475 OR m=5 THEN '/port_80'
 WHEN m=6 AND i<100 THEN '/port_22' WHEN m=7 AND i<200 THEN '/port_443' WHEN m=8 AND i<400 THEN '/port_'||cast(20+7*i AS {text}) WHEN m=9 AND i<60 THEN '/port_'||cast(100+i AS {text}) WHEN rush OR i>=480 AND (i%5=0 OR b%3=0 AND i%7=0) THEN '/port_9100' WHEN crowd THEN '/port_443'
 ELSE '/port_'||cast((l_partkey*37)%60000 AS {text}) END""",
    "status": "CASE WHEN m=6 AND i<100 THEN 401 WHEN m=7 AND i<200 AND i%33<>0 THEN 401 ELSE 200 END",
    "latency": "CASE WHEN m=2 AND i<150 THEN cast(10000 AS double) WHEN m=4 AND i<475 THEN cast(5 AS double) ELSE cast(round(l_quantity*10,1) AS double) END",
    "attack_category": """CASE WHEN m=1 AND i%5=0 OR bots THEN 'Botnet' WHEN m=2 AND i<150 OR m=4 AND i<475 OR rush OR crowd THEN 'DoS' WHEN m=3 AND i<10 THEN 'Web Attack' WHEN m=5 THEN 'DDoS'
 WHEN m=6 AND i<100 OR m=7 AND i<200 THEN 'Brute Force' WHEN m=8 AND i<400 OR m=9 AND i<60 THEN 'Port Scan' ELSE 'Benign' END""",
}
START = 1704088800  # 2024-01-01 06:00:00 UTC


#: Batches after which the scenarios start anew: a multiple of 40, 10 and 3 times 10.
PERIOD = 120


def scenarios(spark: SparkSession, size: int = WINDOW) -> DataFrame:
    """What the planted view says of each place of a period: (_at, tenant, ip, endpoint, status, latency, attack_category). Null where a record speaks for itself."""
    at = spark.range(PERIOD * size).withColumns({"b": F.expr(f"id div {size}"), "i": F.expr(f"id % {size}"), "m": F.expr(f"(id div {size}) % 10"), **{c: F.lit(None).cast("long") for c in ("l_suppkey", "l_partkey", "l_quantity")}})
    at = at.withColumns({k: F.expr(e) for k, e in _FLAGS.items()})
    return at.select(F.col("id").alias("_at"), *(F.expr(e.format(div="div", text="string")).alias(c) for c, e in _PLANTED.items()))


def planted(spark: SparkSession, sf_dir: str, size: int = WINDOW) -> DataFrame:
    """One scenario of abuse per batch, over lineitem: rec_id, batch_id, sec, ts, tenant, ip, endpoint, status, latency, attack_category. Ten batches in thirty are those of a second tenant.

    A scenario depends on the place in a period alone, so the long expressions run once a place and are looked up; records add what is their own (the ends of the expressions).
    """
    n = ranked(table(spark, sf_dir, "lineitem").select(*ORDER, "l_quantity"), ORDER, kept=["l_suppkey", "l_partkey", "l_quantity"])
    rows = n.withColumn("_at", F.col("n") % (PERIOD * size)).join(F.broadcast(scenarios(spark, size)), "_at")  # rows of one period
    own = {c: F.expr(_PLANTED[c].rsplit("ELSE", 1)[1].removesuffix("END").format(div="div", text="string")) for c in ("ip", "endpoint", "latency")}
    return rows.select(
        F.col("n").alias("rec_id"), F.expr(f"n div {size}").alias("batch_id"), (F.lit(START) + 2 * F.col("n")).alias("sec"), F.timestamp_seconds(F.lit(START) + 2 * F.col("n")).alias("ts"),
        *((F.coalesce(c, own[c]) if c in own else F.col(c)).alias(c) for c in _PLANTED),
    )


PLANTED = f"""logs AS (SELECT n AS rec_id, batch_id, {START} + 2 * n AS sec, {', '.join(e.format(div='//', text='varchar') + ' AS ' + c for c, e in _PLANTED.items())}
FROM (SELECT *, n // {WINDOW} AS batch_id, n // {WINDOW} AS b, n % {WINDOW} AS i, (n // {WINDOW}) % 10 AS m, {', '.join(f'{e} AS {k}' for k, e in _FLAGS.items())} FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS n FROM lineitem)))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records over events: rec_id, sec, us, ts, ip, endpoint, status, latency, attack_category."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("long").alias("rec_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr("'10.0.' || cast(user_id div 256 AS string) || '.' || cast(user_id % 256 AS string)").alias("ip"), F.concat(F.lit("/port_"), F.get_json_object("props", "$.k")).alias("endpoint"),
        F.when(F.col("event_type") == "error", 401).otherwise(200).alias("status"), F.least(F.col("value").cast("double") * 100, F.lit(10000.0)).alias("latency"),
        F.when(F.col("event_type") == "error", "Brute Force").otherwise("Benign").alias("attack_category"),
    )


EVENTS = """ev AS (SELECT event_id::BIGINT AS rec_id, epoch_us(ts::TIMESTAMP) // 1000000 AS sec, epoch_us(ts::TIMESTAMP) AS us, ts::TIMESTAMP AS ts, '10.0.' || cast(user_id // 256 AS varchar) || '.' || cast(user_id % 256 AS varchar) AS ip,
'/port_' || json_extract_string(props, '$.k') AS endpoint, CASE WHEN event_type = 'error' THEN 401 ELSE 200 END AS status, least(value::DOUBLE * 100, 10000.0::DOUBLE) AS latency, CASE WHEN event_type = 'error' THEN 'Brute Force' ELSE 'Benign' END AS attack_category FROM events)"""


def country_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lo, hi, country) of addresses: those of the planted view's ordinary clients, which are suppliers, in the nation of each."""
    number = F.lit(10 << 24) + F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(number.alias("lo"), number.alias("hi"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country"))


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping ranges of addresses (lo, hi, country): a /8, a /16 within it, some /24, ranges that aren't aligned, and single addresses."""
    keys, regions = table(spark, sf_dir, "supplier").withColumn("at", F.lit(10 << 24) + F.col("s_suppkey").cast("long")), table(spark, sf_dir, "region")
    whole = lambda region, size, name: regions.filter(F.col("r_regionkey") == region).select(F.lit(10 << 24).cast("long").alias("lo"), F.lit((10 << 24) + size - 1).cast("long").alias("hi"), F.concat(F.lit(name), F.col("r_regionkey").cast("string")).alias("country"))
    some = lambda every, low, high, name: keys.filter(F.col("s_suppkey") % every == 0).select((F.col("at") - low).alias("lo"), (F.col("at") + high).alias("hi"), F.concat(F.lit(name), F.col("s_nationkey").cast("string")).alias("country"))
    parts = [whole(0, 1 << 24, "W"), whole(1, 1 << 16, "X"), some(512, 0, 255, "Y"), some(20, 3, 9, "Z"), some(3, 0, 0, "C")]
    return reduce(DataFrame.unionByName, parts)


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that order from many countries: rec_id-free view of session, country, day."""
    line, orders, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier"))
    j = line.select("l_orderkey", "l_suppkey", "l_shipdate").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("o_custkey").cast("long").alias("session"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("country"), F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("day"))


GEO = """geo AS (SELECT o_custkey::BIGINT AS session, 'C' || s_nationkey::VARCHAR AS country, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
