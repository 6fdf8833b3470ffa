"""Order headers, order lines and scanned pages in the shape the operators take, derived from the given tables by Spark.

``SQL`` has the same tables as common table expressions: so (headers), ln (lines) and pg (pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = """so AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 7 THEN 'SOF' ELSE 'SOR' END || lpad(o_orderkey::VARCHAR, 11, '0') AS sor_no,
  'C' || lpad(o_custkey::VARCHAR, 6, '0') AS customer_code, c_name AS customer_name, CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE 'N' || lpad(c_nationkey::VARCHAR, 2, '0') END AS customer_parent,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN lpad((o_orderkey - 1)::VARCHAR, 9, '0') ELSE lpad(o_orderkey::VARCHAR, 9, '0') END AS cpo_no, o_orderdate::DATE AS tgl_so,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS order_dpp, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice::DECIMAL(18,2) * 0.11::DECIMAL(3,2), 2)::DECIMAL(18,2) END AS order_ppn,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS dpp, CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice::DECIMAL(18,2) * 0.11::DECIMAL(3,2), 2)::DECIMAL(18,2) ELSE 0::DECIMAL(18,2) END AS ppn,
  CASE o_orderstatus WHEN 'F' THEN 'INVOICE_GENERATED' WHEN 'P' THEN 'SO_CANCELLED' ELSE 'SO_OPEN' END AS status,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'G' || o_orderkey END AS cgr_no, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE + 3 END AS cgr_date,
  CASE WHEN o_orderstatus = 'F' THEN lpad(o_orderkey::VARCHAR, 10, '0') END AS billing_no FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
ln AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 40 = 7 THEN 'SOF' ELSE 'SOR' END || lpad(l_orderkey::VARCHAR, 11, '0') AS sor_no,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate)::INT AS line_no,
  lpad(l_partkey::VARCHAR, 8, '0') AS item_code, l_quantity AS qty_pcs, l_extendedprice::DECIMAL(18,2) AS line_amount,
  CASE WHEN l_partkey % 17 <> 0 THEN round(l_extendedprice::DECIMAL(18,2) * 0.11::DECIMAL(3,2), 2)::DECIMAL(18,2) END AS vat, CASE WHEN l_returnflag = 'R' THEN l_quantity - 1 ELSE l_quantity END AS invoice_qty,
  CASE WHEN l_partkey % 60 <> 0 THEN CASE WHEN l_returnflag = 'R' THEN l_quantity - 1 ELSE l_quantity END END AS cgr_qty,
  CASE WHEN l_returnflag = 'R' AND l_partkey % 5 <> 0 THEN 1.0 ELSE 0.0 END AS rejected_qty FROM lineitem),
raw AS (SELECT *, k // 16 AS batch_id, 'B' || (k // 16) AS batch, o.j FROM so, range(3) o(j)),
pg AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY k, j)::INT AS page_no, k, j::INT AS j, sor_no AS own,
  CASE WHEN j = 0 THEN CASE WHEN k % 13 = 0 THEN 'CONTINUATION' ELSE 'FP' END WHEN j = 1 THEN CASE WHEN k % 7 = 0 THEN 'CONTINUATION' ELSE 'PO' END
    WHEN k % 6 = 0 THEN 'FPJ' WHEN k % 6 = 1 THEN 'PEL' ELSE 'TTG' END AS doc_type,
  CASE WHEN k % 29 = 0 AND j = 1 THEN NULL WHEN k % 31 = 0 AND j = 2 THEN 'unsure' WHEN k % 2 = 0 THEN 'labelled' ELSE 'decided' END AS type_status,
  CASE WHEN j = 0 AND k % 19 <> 0 THEN CASE WHEN k % 23 = 0 THEN 'SOR' || lpad((k + 1)::VARCHAR, 11, '0') ELSE sor_no END WHEN j = 2 AND k % 4 = 0 THEN sor_no END AS sor,
  CASE WHEN (j > 0 OR k % 18 = 0) AND k % 17 <> 0 THEN coalesce(cpo_no, CASE WHEN k % 2 = 0 THEN lpad((k + 500000000)::VARCHAR, 9, '0') ELSE '000000000' END) END AS po_no,
  CASE WHEN j = 2 THEN CASE k % 5 WHEN 0 THEN coalesce(billing_no, '7000000000') || '/' || sor_no WHEN 1 THEN NULL WHEN 2 THEN '7' || lpad(k::VARCHAR, 9, '0') ELSE billing_no END END AS bill, CASE WHEN k % 8 = 3 THEN NULL WHEN k % 2 = 0 THEN 'qr' ELSE 'print' END AS key_by,
  (CASE k % 10 WHEN 0 THEN order_dpp + order_ppn + 500 WHEN 1 THEN order_dpp WHEN 2 THEN order_dpp + order_ppn + 5000 ELSE order_dpp + order_ppn END)::DECIMAL(18,2) AS total,
  k % 3 = 1 AS printed, k % 14 = 0 AS cut, k % 4 < 2 AS asked, CASE WHEN k % 20 = 2 THEN order_dpp + order_ppn END AS second,
  tgl_so + (k % 12 - 2)::INT AS day, tgl_so + 8 AS scan_day, cgr_date, tgl_so,
  CASE WHEN k % 21 = 0 THEN 'failed' WHEN k % 22 = 0 THEN 'dead_letter' ELSE 'read' END AS status, CASE WHEN k % 15 = 0 THEN 'failed' ELSE 'ok' END AS extract_status,
  CASE k % 9 WHEN 0 THEN 'HTTP 401 from the model' WHEN 1 THEN 'read timed out' WHEN 2 THEN 'JSONDecodeError: line 1' WHEN 3 THEN 'Stopped on purpose' WHEN 4 THEN 'something long that has no colon in it and goes on and on' END AS error,
  CASE k % 12 WHEN 0 THEN 'waiting_ai' WHEN 5 THEN 'needs_person' WHEN 6 THEN 'held_unsure' ELSE 'ok' END AS outcome
  FROM raw)"""


def _padded(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def sor_of(k: Column) -> Column:
    return F.concat(F.when(k % 40 == 7, "SOF").otherwise("SOR"), _padded(k, 11))


def _tax(c: Column) -> Column:
    return F.round(c * F.lit("0.11").cast("decimal(3,2)"), 2).cast("decimal(18,2)")


def headers(spark: SparkSession, d: str) -> DataFrame:
    """One row an order: numbers, customer, chain, the amounts as ordered and as invoiced, state and goods receipt."""
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    o = spark.read.parquet(f"{d}/orders.parquet").join(customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, money = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    ordered, billed, zero, got = k % 3 != 0, F.col("o_orderstatus") == "F", F.lit(0).cast("decimal(18,2)"), k % 5 != 0
    day = F.to_date("o_orderdate")
    return o.select(
        k.alias("k"), sor_of(k).alias("sor_no"), F.concat(F.lit("C"), _padded(F.col("o_custkey"), 6)).alias("customer_code"), F.col("c_name").alias("customer_name"),
        F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("N"), _padded(F.col("c_nationkey"), 2))).alias("customer_parent"),
        F.when(k % 9 == 0, None).when(k % 11 == 0, _padded(k - 1, 9)).otherwise(_padded(k, 9)).alias("cpo_no"), day.alias("tgl_so"),
        F.when(ordered, money).alias("order_dpp"), F.when(ordered, _tax(money)).alias("order_ppn"), F.when(billed, money).otherwise(zero).alias("dpp"),
        F.when(billed, _tax(money)).otherwise(zero).alias("ppn"),
        F.when(billed, "INVOICE_GENERATED").when(F.col("o_orderstatus") == "P", "SO_CANCELLED").otherwise("SO_OPEN").alias("status"),
        F.when(got, F.concat(F.lit("G"), k.cast("string"))).alias("cgr_no"), F.when(got, F.date_add(day, 3)).alias("cgr_date"), F.when(billed, _padded(k, 10)).alias("billing_no"),
    )


def lines(spark: SparkSession, d: str, finer: int = 1) -> DataFrame:
    """One row an order line: numbered within its order, with ordered, invoiced, received and refused pieces. Orders are dealt to ``finer`` times the parts that the session shuffles into, for work that sorts them again where they lie."""
    l = spark.read.parquet(f"{d}/lineitem.parquet").drop("l_discount", "l_tax").withColumnRenamed("l_orderkey", "k")
    own = Window.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    l = l.repartition(finer * int(spark.conf.get("spark.sql.shuffle.partitions")), "k") if finer > 1 else l
    l = l.withColumn("line_no", F.row_number().over(own))  # before any other column is made, so that the table's own columns are all that is dealt
    money, qty, back = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity"), F.col("l_returnflag") == "R"
    kept = F.when(back, qty - 1).otherwise(qty)
    return l.select(
        "k", sor_of(F.col("k")).alias("sor_no"), "line_no", _padded(F.col("l_partkey"), 8).alias("item_code"),
        qty.alias("qty_pcs"), money.alias("line_amount"), F.when(F.col("l_partkey") % 17 != 0, _tax(money)).alias("vat"), kept.alias("invoice_qty"),
        F.when(F.col("l_partkey") % 60 != 0, kept).alias("cgr_qty"), F.when(back & (F.col("l_partkey") % 5 != 0), 1.0).otherwise(0.0).alias("rejected_qty"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pages an order, numbered within their scan: what was read on each, how it was backed, and how its work ended."""
    # a scan's orders are dealt and numbered before they become three pages each, to as many tasks as the session shuffles into
    so = headers(spark, d).withColumn("batch_id", F.floor(F.col("k") / 16)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    scan = Window.partitionBy("batch_id").orderBy("k")
    so = so.withColumn("before", F.rank().over(scan) - 1).withColumn("copy", F.row_number().over(scan) - F.rank().over(scan)).withColumn("copies", F.count("*").over(Window.partitionBy("batch_id", "k")).cast("int"))
    so = so.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k, j, money = F.col("k"), F.col("j"), F.col("order_dpp") + F.col("order_ppn")
    number = F.col("before") * 3 + j * F.col("copies") + F.col("copy") + 1
    first = F.when(k % 13 == 0, "CONTINUATION").otherwise("FP")
    third = F.when(k % 6 == 0, "FPJ").when(k % 6 == 1, "PEL").otherwise("TTG")
    errors = F.when(k % 9 == 0, "HTTP 401 from the model").when(k % 9 == 1, "read timed out").when(k % 9 == 2, "JSONDecodeError: line 1").when(k % 9 == 3, "Stopped on purpose")
    return so.select(
        "batch_id", number.alias("page_no"), "k", "j", F.col("sor_no").alias("own"),
        F.when(j == 0, first).when(j == 1, F.when(k % 7 == 0, "CONTINUATION").otherwise("PO")).otherwise(third).alias("doc_type"),
        F.when((k % 29 == 0) & (j == 1), None).when((k % 31 == 0) & (j == 2), "unsure").when(k % 2 == 0, "labelled").otherwise("decided").alias("type_status"),
        F.when((j == 0) & (k % 19 != 0), F.when(k % 23 == 0, F.concat(F.lit("SOR"), _padded(k + 1, 11))).otherwise(F.col("sor_no"))).when((j == 2) & (k % 4 == 0), F.col("sor_no")).alias("sor"),
        F.when(((j > 0) | (k % 18 == 0)) & (k % 17 != 0), F.coalesce("cpo_no", F.when(k % 2 == 0, _padded(k + 500000000, 9)).otherwise("000000000"))).alias("po_no"),
        F.when(j == 2, F.when(k % 5 == 0, F.concat(F.coalesce("billing_no", F.lit("7000000000")), F.lit("/"), F.col("sor_no"))).when(k % 5 == 1, None).when(k % 5 == 2, F.concat(F.lit("7"), _padded(k, 9))).otherwise(F.col("billing_no"))).alias("bill"), F.when(k % 8 == 3, None).when(k % 2 == 0, "qr").otherwise("print").alias("key_by"),
        F.when(k % 10 == 0, money + 500).when(k % 10 == 1, F.col("order_dpp")).when(k % 10 == 2, money + 5000).otherwise(money).cast("decimal(18,2)").alias("total"),
        (k % 3 == 1).alias("printed"), (k % 14 == 0).alias("cut"), (k % 4 < 2).alias("asked"), F.when(k % 20 == 2, money).alias("second"),
        F.date_add("tgl_so", (k % 12 - 2).cast("int")).alias("day"), F.date_add("tgl_so", 8).alias("scan_day"), "cgr_date", "tgl_so",
        F.when(k % 21 == 0, "failed").when(k % 22 == 0, "dead_letter").otherwise("read").alias("status"), F.when(k % 15 == 0, "failed").otherwise("ok").alias("extract_status"),
        errors.when(k % 9 == 4, "something long that has no colon in it and goes on and on").alias("error"),
        F.when(k % 12 == 0, "waiting_ai").when(k % 12 == 5, "needs_person").when(k % 12 == 6, "held_unsure").otherwise("ok").alias("outcome"),
    )


#: Order lines with names and prices (il), printed rows of purchase orders and receipts (pr) after the tables of SQL.
ROWS_SQL = """il AS (SELECT ln.k, ln.sor_no, ln.line_no, ln.item_code, p_name || ' ' || p_type AS name, p_partkey, p_size, qty_pcs, p_size::DOUBLE AS pcs_per_uom, line_amount, vat, cgr_qty,
  floor(line_amount::DOUBLE * 100 / qty_pcs + 0.5::DOUBLE) / 100 AS price_pcs, CASE WHEN p_partkey % 3 <> 0 THEN floor(floor(line_amount::DOUBLE * 100 / qty_pcs + 0.5::DOUBLE) * p_size) / 100 END AS price_uom,
  floor(line_amount::DOUBLE * 100 * invoice_qty / qty_pcs + 0.5::DOUBLE) / 100 AS invoice_amount FROM ln JOIN part ON p_partkey = item_code::BIGINT),
pr AS (SELECT k, sor_no, 1 + j AS page_no, CASE j WHEN 0 THEN 'PO' ELSE 'TTG' END AS doc_type, line_no AS row_no, CASE WHEN line_no % 4 = 0 THEN '' ELSE 'P-' || p_partkey END AS code,
  CASE (p_partkey + line_no) % 4 WHEN 0 THEN name WHEN 1 THEN left(name, 4) || substr(name, 6) WHEN 2 THEN upper(name) ELSE '' END AS name,
  CASE WHEN (p_partkey + line_no) % 6 = 1 THEN '1 x ' || qty_pcs::INT WHEN (p_partkey + line_no) % 6 < 4 AND qty_pcs % p_size = 0 THEN (qty_pcs / p_size)::INT || ' CTN' ELSE qty_pcs::INT || ' PCS' END AS qty,
  printf('%.2f', floor(CASE (p_partkey + line_no) % 7 WHEN 0 THEN NULL WHEN 1 THEN price_pcs * 1.11::DOUBLE WHEN 2 THEN coalesce(price_uom, price_pcs * p_size) ELSE price_pcs END * 100 + 0.5::DOUBLE) / 100) AS price,
  CASE (p_partkey + line_no) % 5 WHEN 0 THEN NULL WHEN 1 THEN line_amount::DOUBLE + coalesce(vat::DOUBLE, 0) WHEN 2 THEN line_amount::DOUBLE * 1.01::DOUBLE ELSE line_amount::DOUBLE END AS amount,
  (p_partkey + line_no) % 31 = 0 AS bonus, p_partkey, line_no FROM il, range(2) x(j))"""


def item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines with the product's name and pack, prices by piece and, for some, by the outer unit, and what was invoiced and received."""
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")
    l = lines(spark, d).join(part, F.col("item_code").cast("long") == F.col("p_partkey"))
    money = F.col("line_amount").cast("double")
    cents = lambda x: F.floor(x + 0.5).cast("double")  # noqa: E731  the same in all engines, which round halves unlike
    piece = cents(money * 100 / F.col("qty_pcs")) / 100
    return l.select(
        "k", "sor_no", "line_no", "item_code", F.concat_ws(" ", "p_name", "p_type").alias("name"), "p_partkey", "p_size", "qty_pcs", F.col("p_size").cast("double").alias("pcs_per_uom"), "line_amount", "vat", "cgr_qty",
        piece.alias("price_pcs"), F.when(F.col("p_partkey") % 3 != 0, F.floor(cents(money * 100 / F.col("qty_pcs")) * F.col("p_size")).cast("double") / 100).alias("price_uom"), (cents(money * 100 * F.col("invoice_qty") / F.col("qty_pcs")) / 100).alias("invoice_amount"),
    )


def printed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of an order's purchase order (page 1) and receipt (page 2): some codes missing, names cut or left out, quantities by carton or as pack sizes, prices with tax or by carton, amounts with tax or a little off."""
    l = item_lines(spark, d).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    h, q, money = F.col("p_partkey") + F.col("line_no"), F.col("qty_pcs"), F.col("line_amount").cast("double")
    cents = lambda x: F.format_string("%.2f", F.floor(x * 100 + 0.5).cast("double") / 100)
    whole = lambda x: x.cast("int").cast("string")
    name = F.when(h % 4 == 0, F.col("name")).when(h % 4 == 1, F.concat(F.left("name", F.lit(4)), F.expr("substr(name, 6)"))).when(h % 4 == 2, F.upper("name")).otherwise("")
    qty = F.when(h % 6 == 1, F.concat(F.lit("1 x "), whole(q))).when((h % 6 < 4) & (q % F.col("p_size") == 0), F.concat(whole(q / F.col("p_size")), F.lit(" CTN"))).otherwise(F.concat(whole(q), F.lit(" PCS")))
    price = F.when(h % 7 == 0, None).when(h % 7 == 1, cents(F.col("price_pcs") * 1.11)).when(h % 7 == 2, cents(F.coalesce("price_uom", F.col("price_pcs") * F.col("p_size")))).otherwise(cents(F.col("price_pcs")))
    paid = F.when(h % 5 == 0, None).when(h % 5 == 1, money + F.coalesce(F.col("vat").cast("double"), F.lit(0.0))).when(h % 5 == 2, money * 1.01).otherwise(money)
    bars = F.when(h % 9 == 2, F.array(F.concat(F.lit("899"), _padded(F.col("p_partkey"), 10)))).otherwise(F.array().cast("array<string>"))
    return l.select(
        "k", "sor_no", (F.col("j") + 1).alias("page_no"), F.when(F.col("j") == 0, "PO").otherwise("TTG").alias("doc_type"), F.col("line_no").alias("row_no"),
        F.when(F.col("line_no") % 4 == 0, "").otherwise(F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))).alias("code"), bars.alias("barcodes"), name.alias("name"), qty.alias("qty"), F.lit(None).cast("string").alias("uom"),
        price.alias("price"), paid.alias("amount"), (h % 31 == 0).alias("bonus"), (F.col("k") % 5).alias("chain"),
    )


def known_codes(spark: SparkSession, d: str) -> DataFrame:
    """A product map: every third product's code at three of five chains, and every seventh's barcode."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    k, item = F.col("p_partkey"), _padded(F.col("p_partkey"), 8).alias("item_code")
    by_code = p.filter(k % 3 == 0).select(F.explode(F.array(*[F.lit(c).cast("long") for c in range(3)])).alias("chain"), F.concat(F.lit("P"), k.cast("string")).alias("code"), F.lit(None).cast("string").alias("barcode"), item)
    by_bar = p.filter(k % 7 == 0).select(F.lit(None).cast("long").alias("chain"), F.lit(None).cast("string").alias("code"), F.concat(F.lit("899"), _padded(k, 10)).alias("barcode"), item)
    return by_code.unionByName(by_bar)


def line_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a person or a model said of some rows."""
    r = printed_rows(spark, d)
    k = F.col("k") + F.col("row_no")
    how = F.when(k % 17 == 0, "person").otherwise("ai")
    status = F.when(how == "ai", "proposed").when(k % 34 == 0, "refused").otherwise("matched")
    return r.filter((k % 17 == 0) | (k % 13 == 0)).select("sor_no", "page_no", "row_no", (F.col("row_no") % 3 + 1).cast("int").alias("line_no"), how.alias("how"), status.alias("status"))


def flat_sql(c: str) -> str:
    """``functions.text.flat`` in SQL."""
    return f"regexp_replace(upper(coalesce({c}, '')), '[^0-9A-Z]', '', 'g')"
