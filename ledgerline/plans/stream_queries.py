"""Queries that run as streams over the tables' files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.streaming.run import finished, rounds, stream, timed_events

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT start, event_type, n FROM h WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_hourly(spark, d):
    """Events of each hour and type, once the hour is over and late events have had ten minutes."""
    counts = timed_events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return finished(counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 10 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
t AS (SELECT user_id, min(ts) AS first_at, count(*) AS n, max(ts) + INTERVAL 10 MINUTE AS ends FROM s GROUP BY user_id, session)
SELECT user_id, first_at, n FROM t WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_sessions(spark, d):
    """A user's sessions, each once no event can extend it."""
    found = timed_events(spark, d).groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    return finished(found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_at"), "n"))


#: Pages of a batch.
COMPLETE = 5


@query(f"SELECT user_id, {COMPLETE}::BIGINT AS pages FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT event_id % 8) >= {COMPLETE}")
def stream_complete_once(spark, d):
    """Batches of which enough different pages have come, each told once. A page that comes again does not count; the state of a batch is at most
    COMPLETE page numbers."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        if len(seen) >= COMPLETE:
            return
        for batch in batches:
            seen.update(batch["page"].tolist())
        state.update((sorted(seen)[:COMPLETE],))
        if len(seen) >= COMPLETE:
            yield pd.DataFrame({"user_id": [key[0]], "pages": [COMPLETE]})

    pages = stream(spark, d, "events").select("user_id", (F.col("event_id") % 8).alias("page")).filter("user_id is not null").groupBy("user_id")
    return finished(pages.applyInPandasWithState(count, "user_id long, pages long", "seen array<long>", "append", GroupStateTimeout.NoTimeout))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_notice(spark, d):
    """A notice for each user and type, the first time it comes within forty days; the state of older ones goes."""
    return finished(timed_events(spark, d, "40 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"))


@query("""SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM events GROUP BY 1""")
def stream_coalesced_wakeups(spark, d):
    """Many messages of one batch give one wake-up a round: each round's counts are written, and their sums are what was asked for."""
    parts = rounds(stream(spark, d, "events"), lambda batch: batch.groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")))
    return parts.groupBy("user_id").agg(F.min("first_event").alias("first_event"), F.sum("n").alias("n"))


@query("""SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id WHERE event_id % 5 <= c_nationkey % 5""")
def stream_current_runs(spark, d):
    """Messages of a batch's current run; those of runs before it are late and go. The current runs are a table."""
    runs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).alias("run"))
    return finished(stream(spark, d, "events").join(runs, "user_id").filter("event_id % 5 <= run").select("event_id", "user_id"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'dead' WHEN event_id % 7 = 0 THEN 'again' ELSE 'done' END AS fate FROM events""")
def stream_redelivery(spark, d):
    """A first failure is delivered again, a second one goes to the dead letters: tries and failures of a message are its own columns."""
    e = stream(spark, d, "events")
    tries = F.when(F.col("event_id") % 11 == 0, 2).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return finished(e.select("event_id", F.when(tries >= 2, "dead").when(tries == 1, "again").otherwise("done").alias("fate")))


SPANS = """s AS (SELECT event_id // 2 AS span, event_id % 2 = 0 AS opens, CASE WHEN event_id % 2 = 1 AND event_id // 2 % 4 = 1 THEN ts + INTERVAL 3 HOUR ELSE ts END AS moment FROM events WHERE event_id % 8 <> 1),
o AS (SELECT span, moment AS opened FROM s WHERE opens), c AS (SELECT span, moment AS closed FROM s WHERE NOT opens)"""

#: Spans that share a state, neighbours by number, as a state a span costs more than what is done with it.
SPANS_A_KEY = 1024


@query(f"""WITH {SPANS}, b AS (SELECT span, opened, closed, coalesce(closed - opened <= INTERVAL 2 HOUR, false) AS fine FROM o LEFT JOIN c USING (span))
SELECT span, opened, CASE WHEN fine THEN closed ELSE opened + INTERVAL 2 HOUR END AS ended, CASE WHEN fine THEN 'ok' ELSE 'cut' END AS status FROM b
WHERE closed IS NOT NULL OR opened + INTERVAL 2 HOUR < (SELECT max(moment) FROM s) - INTERVAL 10 MINUTE""")
def stream_spans(spark, d):
    """Spans that open and close; one that has not closed two hours after it opened is cut off then, by a timer on the events' own time. A close that comes later, or without an open, changes nothing.
    Neighbouring spans share a state of at most SPANS_A_KEY open spans, and its timer is that of the span that ends first."""
    half = F.expr("event_id div 2")
    at = F.when((F.col("event_id") % 2 == 1) & (half % 4 == 1), F.expr("ts + interval 3 hours")).otherwise(F.col("ts")).cast("timestamp")
    e = stream(spark, d, "events").filter("event_id % 8 <> 1").select(F.expr(f"event_id div 2 div {SPANS_A_KEY}").alias("spans"), half.alias("span"), (F.col("event_id") % 2 == 0).alias("opens"), at.alias("at")).withWatermark("at", "10 minutes")
    e = e.withColumn("us", F.unix_micros("at"))
    limit = 2 * 3600 * 1_000_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        span, opened, closed = state.get if state.exists else ([], [], [])
        held = pd.DataFrame({"opened": pd.array(opened, "Int64"), "closed": pd.array(closed, "Int64")}, index=pd.Index(span, dtype="int64"))
        for batch in [] if state.hasTimedOut else batches:
            for opens, name in ((True, "opened"), (False, "closed")):  # the last that came stands
                last = batch[batch["opens"] == opens].drop_duplicates("span", keep="last").set_index("span")["us"].astype("Int64")
                held = held.reindex(held.index.union(last.index))
                held.loc[last.index, name] = last
        whole = held["opened"].notna() & held["closed"].notna()
        end = held["opened"].fillna(held["closed"]) + limit
        over = ~whole & (end // 1000 < state.getCurrentWatermarkMs())
        told, left = held[whole | (over & held["opened"].notna())], held[~whole & ~over]
        if len(left):
            some = lambda c: [None if pd.isna(x) else int(x) for x in left[c]]
            state.update((left.index.tolist(), some("opened"), some("closed")))
            state.setTimeoutTimestamp(max(int(end[left.index].min() // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if len(told):
            fine = (told["closed"] - told["opened"] <= limit).fillna(False).astype(bool)
            ended = told["closed"].where(fine, told["opened"] + limit)
            yield pd.DataFrame({"span": told.index, "opened": told["opened"].astype("int64"), "ended": ended.astype("int64"), "status": fine.map({True: "ok", False: "cut"})}).reset_index(drop=True)

    told = e.groupBy("spans").applyInPandasWithState(follow, "span long, opened long, ended long, status string", "span array<long>, opened array<long>, closed array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return finished(told).select("span", moment("opened"), moment("ended"), "status")
