"""Queries over the event trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.stats import medians, nearest_rank, ranked_values
from ledgerline.operators.keys import gap_sessions, latest_per_key, ranked

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RANK = "list_sort(list(value) FILTER (value IS NOT NULL))[greatest(1, least(count(value), round_even({q} / 100.0::DOUBLE * count(value) + 0.5, 0)::BIGINT))]"


@query(f"""SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, {RANK.format(q=50)} AS p50,
  {RANK.format(q=90)} AS p90, round(sum(value), 2) AS total FROM events GROUP BY event_type""")
def metrics_by_kind(spark, d):
    e = table(spark, d, "events")
    ranks = ranked_values(e, ["event_type"], "value", {"p50": nearest_rank(50), "p90": nearest_rank(90)}).drop("n")
    sums = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 2).alias("total"))
    ranks = ranks.withColumnRenamed("event_type", "of")
    return sums.join(ranks, F.col("event_type").eqNullSafe(F.col("of")), "left").select("event_type", "n", "failed", "p50", "p90", "total")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15")
def failures_top15(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)


@query("SELECT date_trunc('hour', ts + INTERVAL 7 HOUR)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 48")
def throughput_hourly_local(spark, d):
    local = table(spark, d, "events").select((F.col("ts") + F.expr("interval 7 hours")).alias("ts"))
    return local.groupBy(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n")).orderBy(F.desc("hour")).limit(48)


@query("""WITH s AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events),
w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS seen FROM s)
SELECT event_id, user_id, (epoch_us(ts) - epoch_us(seen))::BIGINT AS wait_us FROM w WHERE event_type = 'purchase'""")
def queue_wait_asof(spark, d):
    """The wait of each purchase since the user's last view, if no purchase used that view up."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("g", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id"))
    return e.withColumn("seen", seen).filter("event_type = 'purchase'").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, seen, ts)").alias("wait_us"))


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (event_type = 'view') AS views,
  count(*) FILTER (event_type = 'purchase') AS purchases, round(sum(value) FILTER (event_type = 'purchase'), 2) AS spent FROM events GROUP BY user_id""")
def page_rollup(spark, d):
    bought = F.col("event_type") == "purchase"
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(bought).alias("purchases"), F.round(F.sum(F.when(bought, F.col("value"))), 2).alias("spent"),
    )


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(e, ["user_id"], F.desc("ts"), F.desc("event_id"))


@query("""SELECT event_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) - 1 AS ahead,
  strftime(ts, 'BATCH-%Y%m%d-') || lpad((row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id))::VARCHAR, 6, '0') AS code FROM events""")
def queue_position(spark, d):
    """Place in the day's queue, and a code a day with it; a day is in as many tasks as it needs."""
    e = table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    n = F.col("place")
    code = F.concat(F.date_format("ts", "'BATCH-'yyyyMMdd'-'"), F.lpad(n.cast("string"), 6, "0"))
    return ranked(e, ["day"], ["ts", "event_id"], "place").select("event_id", (n - 1).cast("long").alias("ahead"), code.alias("code"))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 10 MINUTE, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY ALL""")
def gap_sessions_per_user(spark, d):
    s = gap_sessions(table(spark, d, "events"), "user_id", "ts", 600, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 10 MINUTE, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS start_at, max(ts) + INTERVAL 10 MINUTE AS end_at, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window_batch(spark, d):
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_at"), F.col("w.end").cast("timestamp_ntz").alias("end_at"), "n")


@query("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, d):
    w = F.window("ts", "15 minutes")["start"].cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(w.alias("start_at"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INT) AS start_at, count(*) AS n FROM events, range(2) t(k) GROUP BY 1""")
def sliding_windows(spark, d):
    w = F.window("ts", "2 hours", "1 hour")["start"].cast("timestamp_ntz")
    return table(spark, d, "events").groupBy(w.alias("start_at")).agg(F.count("*").alias("n"))


@query("""WITH spans AS (SELECT event_id AS span_id, user_id, ts AS a, ts + INTERVAL 1 HOUR AS b FROM events WHERE event_type = 'signup'),
c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id, arg_max(span_id, (a, span_id)) AS span_id FROM c JOIN spans s ON c.user_id = s.user_id AND c.ts BETWEEN a AND b GROUP BY c.event_id""")
def span_containment(spark, d):
    """The span that a call lies in: the last one to start. Hours are equality keys, so the range join has one."""
    e = table(spark, d, "events")
    hour = lambda c: F.date_trunc("hour", c.cast("timestamp"))
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("span_id"), "user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("interval 1 hour")).alias("b"))
    spans = spans.withColumn("h", F.explode(F.array_distinct(F.array(hour(F.col("a")), hour(F.col("b"))))))
    calls = e.filter("event_type = 'click'").select("event_id", "user_id", "ts", hour(F.col("ts")).alias("h"))
    met = calls.join(spans, ["user_id", "h"]).filter("ts between a and b")
    return met.groupBy("event_id").agg(F.max(F.struct("a", "span_id"))["span_id"].alias("span_id"))


@query("""WITH w AS (SELECT event_id, user_id, epoch_us(ts) - epoch_us(min(ts) OVER u) AS since, epoch_us(max(ts) OVER u) - epoch_us(min(ts) OVER u) AS span FROM events WINDOW u AS (PARTITION BY user_id))
SELECT event_id, round(100.0::DOUBLE * since / nullif(span, 0), 4) AS left_pct FROM w""")
def events_timeline_share(spark, d):
    u = Window.partitionBy("user_id")
    since, span = "timestampdiff(MICROSECOND, lo, ts)", "nullif(timestampdiff(MICROSECOND, lo, hi), 0)"
    e = table(spark, d, "events").withColumn("lo", F.min("ts").over(u)).withColumn("hi", F.max("ts").over(u))
    return e.select("event_id", F.round(F.expr(f"try_divide(100.0D * {since}, {span})"), 4).alias("left_pct"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type || ':' || coalesce(json_extract_string(props, '$.k'), '?') AS label FROM events")
def json_props_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.try_cast("long").alias("k"), F.concat_ws(":", "event_type", F.coalesce(k, F.lit("?"))).alias("label"))


@query("""(SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 20)
UNION ALL (SELECT event_id, ts, event_type FROM events WHERE event_type = 'signup' AND ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 20)""")
def explore_window(spark, d):
    """The newest of two kinds in a time window; the filter reaches the scan."""
    inside = table(spark, d, "events").select("event_id", "ts", "event_type").filter("ts between timestamp_ntz'2024-01-10 00:00:00' and timestamp_ntz'2024-01-12 00:00:00'")
    newest = lambda kind: inside.filter(F.col("event_type") == kind).orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return newest("error").union(newest("signup"))


@query("""WITH price(event_type, usd) AS (VALUES ('view', 0.5), ('click', 1.25), ('purchase', 3.0))
SELECT event_type, count(*) AS n, round(sum(value * usd::DOUBLE / 1000000.0::DOUBLE), 6) AS cost FROM events LEFT JOIN price USING (event_type) GROUP BY event_type""")
def price_table_cost(spark, d):
    """Unknown kinds have no price, and their cost stays null."""
    price = spark.sql("SELECT * FROM VALUES ('view', 0.5D), ('click', 1.25D), ('purchase', 3.0D) AS t(event_type, usd)")
    e = table(spark, d, "events").join(F.broadcast(price), "event_type", "left")  # three rows
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("usd") / 1000000.0), 6).alias("cost"))


@query("""WITH d AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type, count(*) FILTER (nxt IS NULL) AS running, count(*) FILTER (nxt IS NOT NULL) AS done,
  CASE WHEN count(nxt) < 3 THEN 90.0 ELSE round(median((epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE), 3) END AS pace_s,
  ceil(count(*) / 3.0)::BIGINT AS rounds FROM d GROUP BY event_type""")
def activity_eta(spark, d):
    """Pace as the median of finished spans, 90 s below three of them, and rounds for three workers."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = table(spark, d, "events").withColumn("nxt", nxt).withColumn("sec", F.expr("timestampdiff(MICROSECOND, ts, nxt) / 1000000.0D"))
    middle = medians(s, ["event_type"], "sec").select(F.col("event_type").alias("of"), "median")
    sums = s.groupBy("event_type").agg(F.count_if(F.col("nxt").isNull()).alias("running"), F.count("nxt").alias("done"), F.ceil(F.count("*") / 3.0).alias("rounds"))
    both = sums.join(middle, F.col("event_type").eqNullSafe(F.col("of")), "left")
    pace = F.when(F.col("done") < 3, F.lit(90.0)).otherwise(F.round("median", 3))
    return both.select("event_type", "running", "done", pace.alias("pace_s"), "rounds")


@query("""WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS print, ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS fresh FROM events)
SELECT DISTINCT user_id, event_type, print FROM e WHERE fresh AND NOT EXISTS (SELECT 1 FROM e o WHERE NOT o.fresh AND o.user_id = e.user_id AND o.event_type = e.event_type AND o.print = e.print)""")
def new_items_antijoin(spark, d):
    """Items of the last day that no earlier notice had with the same print."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("print"), "ts")
    last = e.agg(F.max("ts").alias("last"))  # one row
    marked = e.join(F.broadcast(last)).withColumn("fresh", F.col("ts") >= F.col("last") - F.expr("interval 24 hours"))
    keys = ["user_id", "event_type", "print"]
    return marked.filter("fresh").select(*keys).join(marked.filter("not fresh").select(*keys), keys, "left_anti").distinct()


@query("""SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type IN ('view', 'click')) AS reads, count(DISTINCT user_id) AS users,
  count(DISTINCT user_id) FILTER (event_type = 'purchase') AS buyers FROM events GROUP BY 1""")
def daily_filtered_counts(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type").isin("view", "click")).alias("reads"), F.count_distinct("user_id").alias("users"),
        F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"),
    )


@query("""WITH w AS (SELECT *, ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AS today, CASE event_type WHEN 'view' THEN 0.5 WHEN 'click' THEN 1.25 WHEN 'purchase' THEN 3.0 END AS usd FROM events)
SELECT event_type, count(*) AS calls, count(*) FILTER (today) AS calls_today, min(ts)::DATE AS first_day, round(sum(value), 2) AS tokens, round(sum(value) FILTER (today), 2) AS tokens_today, round(sum(value * usd::DOUBLE / 1000000), 6) AS usd FROM w GROUP BY 1""")
def usage_by_kind(spark, d):
    """Calls and tokens of the last day and of all days; a kind without a price has no cost."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    today = F.col("ts") >= F.col("last") - F.expr("interval 24 hours")
    usd = F.when(F.col("event_type") == "view", 0.5).when(F.col("event_type") == "click", 1.25).when(F.col("event_type") == "purchase", 3.0)
    return e.join(F.broadcast(last)).groupBy("event_type").agg(
        F.count("*").alias("calls"), F.count_if(today).alias("calls_today"), F.to_date(F.min("ts")).alias("first_day"), F.round(F.sum("value"), 2).alias("tokens"),
        F.round(F.sum(F.when(today, F.col("value"))), 2).alias("tokens_today"), F.round(F.sum(F.col("value") * usd / 1000000), 6).alias("usd"),
    )


@query(f"""SELECT user_id % 7 AS lane, event_type, count(*) AS n, count(*) FILTER (value < 5) AS failed, {RANK.format(q=50)} AS p50, {RANK.format(q=90)} AS p90 FROM events GROUP BY 1, 2""")
def calls_panel(spark, d):
    """Calls of each lane and kind with failures and percentiles."""
    e = table(spark, d, "events").withColumn("lane", F.col("user_id") % 7)
    keys = ["lane", "event_type"]
    ranks = ranked_values(e, keys, "value", {"p50": nearest_rank(50), "p90": nearest_rank(90)}).drop("n")
    sums = e.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("failed"))
    ranks = ranks.withColumnsRenamed({"lane": "l", "event_type": "of"})
    return sums.join(ranks, F.col("lane").eqNullSafe(F.col("l")) & F.col("event_type").eqNullSafe(F.col("of")), "left").select("lane", "event_type", "n", "failed", "p50", "p90")


@query(f"""WITH s AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM events),
w AS (SELECT *, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS seen FROM s),
q AS (SELECT dayofweek(ts)::INT AS weekday, (epoch_us(ts) - epoch_us(seen)) AS value FROM w WHERE event_type = 'purchase')
SELECT weekday, count(value) AS n, {RANK.format(q=50)}::BIGINT AS p50, {RANK.format(q=90)}::BIGINT AS p90 FROM q WHERE value IS NOT NULL GROUP BY 1""")
def queue_panel(spark, d):
    """Waits in the queue by weekday."""
    q = queue_wait_asof(spark, d).join(table(spark, d, "events").select("event_id", "ts"), "event_id").withColumn("weekday", F.dayofweek("ts") - 1)
    return ranked_values(q, ["weekday"], "wait_us", {"p50": nearest_rank(50), "p90": nearest_rank(90)})


@query("""WITH r AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, user_id FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id) AS place FROM r WHERE nxt IS NOT NULL AND ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR)
SELECT event_type, count(*) AS n, CASE WHEN count(*) < 3 THEN 90.0::DOUBLE ELSE round(median((epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE), 3) END AS pace_s, count(DISTINCT user_id) AS workers FROM t WHERE place <= 200 GROUP BY 1""")
def recent_pace(spark, d):
    """The median of the newest 200 spans of the last day, 90 s below three, and who worked them. At most 200 rows a kind are kept."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    recent = e.withColumn("nxt", nxt).filter("nxt is not null").join(F.broadcast(last)).filter("ts > last - interval 24 hours")
    newest = recent.withColumn("place", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), "user_id"))).filter("place <= 200")
    sec = F.expr("timestampdiff(MICROSECOND, ts, nxt) / 1000000.0D")
    pace = F.when(F.count("*") < 3, F.lit(90.0)).otherwise(F.round(F.median(sec), 3))
    return newest.groupBy("event_type").agg(F.count("*").alias("n"), pace.alias("pace_s"), F.count_distinct("user_id").alias("workers"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS attempts, min(ts) AS first_at, min(ts) FILTER (event_type IN ('click', 'purchase')) AS first_done, max(ts) AS last_at, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS wall_us,
  round(sum(value) FILTER (event_type = 'view'), 2) AS view_ms, round(sum(value) FILTER (event_type = 'click'), 2) AS click_ms, round(sum(value) FILTER (event_type = 'error'), 2) AS error_ms FROM events GROUP BY 1""")
def attempt_summary(spark, d):
    """Attempts, first and last times, and time by stage, of each unit of work."""
    k = F.col("event_type")
    of = lambda kind: F.round(F.sum(F.when(k == kind, F.col("value"))), 2)
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(k == "view").alias("attempts"), F.min("ts").alias("first_at"), F.min(F.when(k.isin("click", "purchase"), F.col("ts"))).alias("first_done"), F.max("ts").alias("last_at"),
        F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("wall_us"), of("view").alias("view_ms"), of("click").alias("click_ms"), of("error").alias("error_ms"),
    )


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ahead FROM events")
def global_queue_position(spark, d):
    """Place in the whole queue. Rows are placed within ranges of time, and the sums of the ranges before are added: no task has them all."""
    return ranked(table(spark, d, "events").select("ts", "event_id"), [], ["ts", "event_id"], "place").select("event_id", (F.col("place") - 1).alias("ahead"))


@query("""SELECT c.event_id, p.event_id AS parent, coalesce(c.event_type, p.event_type) AS kind, (epoch_us(c.ts) - epoch_us(p.ts))::BIGINT AS after_us FROM events c JOIN events p ON p.event_id = c.event_id // 10 * 10 WHERE c.event_id % 10 <> 0""")
def child_spans(spark, d):
    """Spans with the span that opened them."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    p = e.select(F.col("event_id").alias("parent"), F.col("event_type").alias("of"), F.col("ts").alias("opened"))
    c = e.filter("event_id % 10 <> 0").withColumn("parent", F.expr("event_id div 10 * 10"))
    return c.join(p, "parent").select("event_id", "parent", F.coalesce("event_type", "of").alias("kind"), F.timestamp_diff("MICROSECOND", "opened", "ts").alias("after_us"))


@query("""SELECT o_orderkey, event_id FROM orders JOIN events ON user_id = o_custkey OR event_id = o_orderkey""")
def events_of_order(spark, d):
    """The trace of an order by either of two keys: two joins on equality, and their distinct rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    e = table(spark, d, "events").select("event_id", "user_id")
    by_user = o.join(e, F.col("user_id") == F.col("o_custkey")).select("o_orderkey", "event_id")
    by_id = o.join(e, F.col("event_id") == F.col("o_orderkey")).select("o_orderkey", "event_id")
    return by_user.union(by_id).distinct()


@query("""WITH b AS (SELECT o_orderkey, o_orderkey::VARCHAR || ',' || (o_orderkey + 1) || ',x' AS sources FROM orders), u AS (SELECT o_orderkey, unnest(string_split(sources, ',')) AS source FROM b)
SELECT u.o_orderkey, count(o.o_orderkey) AS found, bool_or(u.source = 'x') AS odd FROM u LEFT JOIN orders o ON o.o_orderkey::VARCHAR = u.source GROUP BY 1""")
def listed_sources(spark, d):
    """Keys listed in one text column, taken apart and joined."""
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    u = o.select("o_orderkey", F.explode(F.split(F.concat_ws(",", k.cast("string"), (k + 1).cast("string"), F.lit("x")), ",")).alias("source"))
    # a text that is no number is no order's key: it meets nothing and isn't shuffled by itself, however many rows list it
    asked = u.withColumn("key", F.col("source").try_cast("long")).filter((F.col("key").cast("string") == F.col("source"))).select("o_orderkey", "key")
    met = asked.join(o.select(k.alias("key")).hint("merge"), "key").select("o_orderkey", F.lit(1).alias("one"), F.lit(None).cast("boolean").alias("odd"))
    listed = u.select("o_orderkey", F.lit(None).cast("int").alias("one"), (F.col("source") == "x").alias("odd"))
    return met.unionByName(listed).groupBy("o_orderkey").agg(F.count("one").alias("found"), F.bool_or("odd").alias("odd"))


@query("""SELECT s_nationkey, arg_min(s_name, (-s_acctbal, s_suppkey)) AS best, round(max(s_acctbal) - coalesce(max(s_acctbal) FILTER (r = 2), -1e9), 2) AS lead, coalesce(max(s_acctbal) FILTER (r = 1) - max(s_acctbal) FILTER (r = 2) >= 500, true) AS clear
FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) GROUP BY 1""")
def best_with_margin(spark, d):
    """The best of each group and whether it leads the second by enough."""
    best = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    top = table(spark, d, "supplier").withColumn("r", best).filter("r <= 2").groupBy("s_nationkey").agg(
        F.max(F.when(F.col("r") == 1, F.col("s_name"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("s_acctbal"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("s_acctbal"))).alias("b"))
    return top.select("s_nationkey", "best", F.round(F.col("a") - F.coalesce("b", F.lit(-1e9)), 2).alias("lead"), F.coalesce(F.col("a") - F.col("b") >= 500, F.lit(True)).alias("clear"))


@query("""SELECT event_id, (epoch_us(ts) // 1000 * 1048576 + event_id % 1048576)::BIGINT AS id, epoch_us(ts) // 1000 AS at_ms FROM events""")
def sortable_ids(spark, d):
    """Ids that sort by time: milliseconds and twenty bits; the time is read back from them."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    ids = table(spark, d, "events").select("event_id", F.shiftleft(ms, 20).bitwiseOR(F.col("event_id") % 1048576).alias("id"))
    return ids.select("event_id", "id", F.shiftright("id", 20).alias("at_ms"))
