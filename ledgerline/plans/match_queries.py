"""Queries that match rows to lines, read printed dates and score answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.text import day_of, dots, long_date
from ledgerline.plans.trace_queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""WITH r AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT l_suppkey, l_partkey, max(l_orderkey) AS by_code FROM r GROUP BY 1, 2), b AS (SELECT l_partkey, max(l_orderkey) AS by_barcode FROM r GROUP BY 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, coalesce(by_code, by_barcode) AS known_from,
  CASE WHEN by_code IS NOT NULL THEN 'code' WHEN by_barcode IS NOT NULL THEN 'barcode' ELSE 'none' END AS way
FROM lineitem l LEFT JOIN c ON c.l_suppkey = l.l_suppkey AND c.l_partkey = l.l_partkey LEFT JOIN b ON b.l_partkey = l.l_partkey WHERE l.l_returnflag = 'N'""")
def map_code_or_barcode(spark, d):
    """Where a line's product is known from: its own supplier's code, else the part's barcode at any supplier."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    by_code = lines.filter("l_returnflag = 'R'").groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("by_code"))
    by_barcode = by_code.groupBy("l_partkey").agg(F.max("by_code").alias("by_barcode"))
    found = lines.filter("l_returnflag = 'N'").join(by_code, ["l_suppkey", "l_partkey"], "left").join(by_barcode, "l_partkey", "left")
    way = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_barcode").isNotNull(), "barcode").otherwise("none")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("by_code", "by_barcode").alias("known_from"), way.alias("way"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'only'
  WHEN count(*) OVER (PARTITION BY l_orderkey, l_quantity) = 1 THEN 'numbers' ELSE 'none' END AS stage FROM lineitem""")
def only_line_match(spark, d):
    """The stage that settles a printed row: the order's only line, else the only line of as many pieces. Windows
    are over the lines of one order."""
    n = lambda *keys: F.count("*").over(Window.partitionBy(*keys))
    stage = F.when(n("l_orderkey") == 1, "only").when(n("l_orderkey", "l_quantity") == 1, "numbers").otherwise("none")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", stage.alias("stage"))


@query("""WITH c AS (SELECT l_partkey, l_quantity, count(*) FILTER (l_returnflag = 'R') AS w, count(*) FILTER (l_returnflag <> 'R') AS p FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, sum(w)::BIGINT AS wanted, sum(p)::BIGINT AS printed, sum(least(w, p))::BIGINT AS matched FROM c GROUP BY 1""")
def bag_match(spark, d):
    """Wanted amounts that each take one equal printed amount: of equal amounts as many match as both sides have."""
    returned = F.col("l_returnflag") == "R"
    bags = table(spark, d, "lineitem").groupBy("l_partkey", "l_quantity").agg(F.count_if(returned).alias("w"), F.count_if(~returned).alias("p"))
    return bags.groupBy("l_partkey").agg(F.sum("w").alias("wanted"), F.sum("p").alias("printed"), F.sum(F.least("w", "p")).alias("matched"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS products, count(*) AS n, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1")
def product_map_rollup(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_seen"))
    return lines.groupBy("l_suppkey").agg(F.count("l_partkey").alias("products"), F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS copies, max(l_quantity) - min(l_quantity) <= 0.5 AS same_pieces,
  max(l_extendedprice) - min(l_extendedprice) <= 0.01 * max(l_extendedprice) AS same_amount FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def copies_agree(spark, d):
    """Whether the copies of a line agree: pieces within a half, amounts within one in a hundred."""
    spread = lambda c: F.max(c) - F.min(c)
    found = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("copies"), (spread("l_quantity") <= 0.5).alias("same_pieces"), (spread("l_extendedprice") <= F.max("l_extendedprice") * 0.01).alias("same_amount")
    )
    return found.filter("copies > 1")


@query("""WITH p AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS printed FROM orders)
SELECT o_orderkey, printed, CASE o_orderkey % 3 WHEN 0 THEN strptime(printed, '%d/%m/%Y') WHEN 1 THEN strptime(printed, '%d.%m.%Y') ELSE strptime(printed, '%Y-%m-%d') END::DATE AS day FROM p""")
def date_parse(spark, d):
    """Printed days read back: year first or day first, whatever the mark."""
    style = F.col("o_orderkey") % 3
    day = lambda f: F.date_format("o_orderdate", f)
    printed = F.when(style == 0, day("dd/MM/yyyy")).when(style == 1, day("dd.MM.yyyy")).otherwise(day("yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", printed.alias("printed")).withColumn("day", day_of(F.col("printed")))


@query("""SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS total,
  day(o_orderdate) || ' ' || ['Januari','Februari','Maret','April','Mei','Juni','Juli','Agustus','September','Oktober','November','Desember'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders""")
def printed_forms(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dots(F.col("o_totalprice")).alias("total"), long_date(F.col("o_orderdate")).alias("day"))


@query("""SELECT source, count(quality) AS read, count(*) FILTER (quality = 1) AS backed, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 3) AS confidence
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def confidence_share(spark, d):
    """Backed answers as a share of those read; none read: null."""
    both = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    found = both.groupBy("source").agg(F.count("quality").alias("read"), F.count_if(F.col("quality") == 1).alias("backed"))
    return found.withColumn("confidence", F.round(F.try_divide("backed", "read"), 3))


@query("""WITH s AS (SELECT source, quality = 1 AS before, n_chars >= 200 AND quality = 1 OR n_chars >= 2000 AS after FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) FILTER (before) AS right_before, count(*) FILTER (after) AS right_after, count(*) FILTER (after AND NOT before) AS gained, count(*) FILTER (before AND NOT after) AS lost,
  count(*) FILTER (after AND NOT before) > count(*) FILTER (before AND NOT after) AS better FROM s GROUP BY 1""")
def label_piles(spark, d):
    """A rule scored before and after a change: what it gains and loses, source by source."""
    both = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    before, after = F.col("quality") == 1, ((F.col("n_chars") >= 200) & (F.col("quality") == 1)) | (F.col("n_chars") >= 2000)
    found = both.groupBy("source").agg(
        F.count_if(before).alias("right_before"), F.count_if(after).alias("right_after"), F.count_if(after & ~before).alias("gained"), F.count_if(before & ~after).alias("lost")
    )
    return found.withColumn("better", F.col("gained") > F.col("lost"))


@query("""WITH w AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM documents)
SELECT word, min(source) AS source, count(*) AS n FROM w GROUP BY 1 HAVING min(source) = max(source)""")
def store_own_words(spark, d):
    """Words that the texts of one source have and no other source's, with the texts that have them."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)")))
    each = table(spark, d, "documents").select("source", F.explode(words).alias("word"))
    found = each.groupBy("word").agg(F.min("source").alias("source"), F.max("source").alias("last"), F.count("*").alias("n"))
    return found.filter("source = last").drop("last")
