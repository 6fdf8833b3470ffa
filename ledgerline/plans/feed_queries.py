"""Queries that write and read exchange files, and keep stored rows up to date with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators.keys import latest_per_key
from ledgerline.plans.trace_queries import table
from ledgerline.sources import feed
from ledgerline.streaming.run import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _export(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An export's three files, as text, from the given tables: headers, number file (some orders twice, some unknown), lines (some of unknown orders, some twice)."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda c: F.col(c).cast("string")
    head = o.select(k.cast("string").alias("order_id"), F.concat(F.lit(" SO"), k.cast("string"), F.lit(" ")).alias("order_no"), text("o_custkey").alias("customer_id"),
                    F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 07:00:00")).alias("created_at"), text("o_totalprice").alias("total"), F.when(k % 4 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("status"))
    n = F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    numbers = o.filter("o_orderkey % 3 > 0").select(F.concat(F.lit("SO"), F.when(k % 50 == 1, -k).otherwise(k).cast("string")).alias("order_no"), n.alias("n"), k.alias("k"))
    po = numbers.select("order_no", F.concat(F.lit("PO"), F.col("k").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("po_number"), F.col("n").cast("string").alias("row_no"))
    l = table(spark, d, "lineitem")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = l.select(F.concat(F.when(F.col("l_orderkey") % 25 == 0, "x").otherwise(""), F.col("l_orderkey").cast("string")).alias("order_id"), text("l_linenumber").alias("line_no"), F.row_number().over(own).cast("string").alias("row_no"),
                    text("l_quantity").alias("qty"), text("l_discount").alias("disc_reg"), F.when(F.col("l_tax") > 0.04, text("l_tax")).otherwise("").alias("disc_dc"), F.lit("0").alias("disc_b2b"))
    return head, po, rows


def _read(spark, d, *names):
    """The files asked for, written and read."""
    made = dict(zip(("head", "po", "rows"), _export(spark, d), strict=True))
    return [feed.through_csv(made[name], _file(spark, name)) for name in names]


CTE = """WITH h AS (SELECT o_orderkey AS k, 'SO' || o_orderkey AS sor_no, o_custkey::VARCHAR AS customer_code, o_orderdate::DATE AS tgl_so, o_totalprice AS total, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 50 <> 1 THEN 'PO' || o_orderkey || CASE WHEN o_orderkey % 10 = 0 THEN '-2' ELSE '-1' END END AS cpo_no FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS row_no FROM lineitem),
f AS (SELECT * FROM r WHERE l_orderkey % 25 <> 0), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY row_no DESC) = 1)"""


@query(CTE + " SELECT sor_no, customer_code, tgl_so, total, status, cpo_no FROM h")
def feed_orders(spark, d):
    """Orders of an export: all columns come as text; blanks are nothing, and the number file's last row of an order counts."""
    return feed.orders(*_read(spark, d, "head", "po"))


@query(CTE + """ SELECT 'SO' || l_orderkey AS sor_no, l_linenumber AS line_no, l_quantity AS qty, (l_discount <> 0)::INT + (l_tax > 0.04)::INT AS n_discounts, CASE WHEN l_discount <> 0 THEN l_discount END AS reg, CASE WHEN l_tax > 0.04 THEN l_tax END AS dc FROM g""")
def feed_lines(spark, d):
    """Lines of known orders, a repeated one as its last row; discounts that are not zero, by kind."""
    l = feed.lines(*_read(spark, d, "rows", "head"))
    return l.select("sor_no", "line_no", "qty", F.size("discounts").alias("n_discounts"), F.col("discounts")["reg"].alias("reg"), F.col("discounts")["dc"].alias("dc"))


@query(CTE + """ SELECT (SELECT count(*) FROM h) AS orders, (SELECT count(cpo_no) FROM h) AS with_po_number, (SELECT count(*) FROM g) AS lines, (SELECT count(*) FROM r WHERE l_orderkey % 25 = 0) AS lines_without_order,
  (SELECT count(*) FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 50 = 1) AS only_in_po_file""")
def feed_counts(spark, d):
    head, po, rows = _read(spark, d, "head", "po", "rows")
    return feed.counts(feed.orders(head, po), feed.lines(rows, head), head, po, rows)


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey % 3 = 1 GROUP BY 1, 2")
def product_map_csv(spark, d):
    """The product map of some chains as CSV, read back."""
    found = table(spark, d, "lineitem").filter("l_suppkey % 3 = 1").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    path = _file(spark, "product-map")
    found.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(found.schema).csv(path)


@query("SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def seed_json(spark, d):
    """Seed rows as JSON lines, read back with their types."""
    found = table(spark, d, "supplier").filter("s_acctbal > 0").withColumn("s_acctbal", F.round("s_acctbal", 2))
    path = _file(spark, "seed")
    found.write.json(path)
    return spark.read.schema(found.schema).json(path)


@query("""WITH old AS (SELECT o_orderkey, o_orderkey % 4 AS version FROM orders WHERE o_orderkey % 3 = 0)
SELECT o.o_orderkey, coalesce(version, 0) + 1 AS version, count(l_orderkey) AS n_lines FROM orders o LEFT JOIN old ON old.o_orderkey = o.o_orderkey LEFT JOIN lineitem ON l_orderkey = o.o_orderkey WHERE o.o_orderkey % 2 = 0 GROUP BY ALL""")
def published_versions(spark, d):
    """Documents written again get the next version, new ones the first; each with its lines, written apart by key."""
    o = table(spark, d, "orders").select("o_orderkey")
    old = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_orderkey") % 4).alias("version"))
    head = o.filter("o_orderkey % 2 = 0").join(old, "o_orderkey", "left").select("o_orderkey", (F.coalesce("version", F.lit(0)) + 1).alias("version"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(head, "o_orderkey", "left_semi")
    heads, lines = _file(spark, "heads"), _file(spark, "lines")
    head.write.parquet(heads)
    rows.write.parquet(lines)
    n = spark.read.parquet(lines).groupBy("o_orderkey").agg(F.count("*").alias("n"))
    return spark.read.parquet(heads).join(n, "o_orderkey", "left").select("o_orderkey", "version", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("""WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0), new AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, round(coalesce(o.c_acctbal, n.c_acctbal), 2) AS c_acctbal FROM old o FULL JOIN new n ON n.c_custkey = o.c_custkey""")
def upsert_fields(spark, d):
    """An upsert by field: the name is the new one if there is one, the balance stays as first stored."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    old, k = c.filter("c_custkey % 2 = 0"), F.col("c_custkey")
    new = c.filter("c_custkey % 3 = 0").select(k, F.when(k % 6 != 0, F.upper("c_name")).alias("new_name"), (F.col("c_acctbal") + 1).alias("new_bal"))
    return old.join(new, "c_custkey", "full").select("c_custkey", F.coalesce("new_name", "c_name").alias("c_name"), F.round(F.coalesce("c_acctbal", "new_bal"), 2).alias("c_acctbal"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def insert_if_absent(spark, d):
    """Do nothing on conflict: the first row of each key stays."""
    return latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P') AND o_orderstatus = 'P'")
def point_scan(spark, d):
    """One row by key: the filter reaches the scan, which skips all other row groups."""
    o = table(spark, d, "orders")
    key = o.filter("o_orderstatus = 'P'").agg(F.max("o_orderkey")).first()[0]
    return o.filter((F.col("o_orderkey") == key) & (F.col("o_orderstatus") == "P")).select("o_orderkey", "o_custkey")
