"""Queries on what a delete takes along, what changed, and how readings differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import grouping, upkeep
from ledgerline.operators.written import written
from ledgerline.plans.evidence_queries import PAPER_TEXT
from ledgerline.plans.paper_queries import LINKED
from ledgerline.sources import paperwork
from ledgerline.sources.paperwork import headers, lines, pages, printed_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, *more: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = "WITH " + ",\n".join([paperwork.SQL, *more]) + "\n" + sql
        return f

    return add


FILES = """fi AS (SELECT DISTINCT batch_id // 3 AS upload, batch_id FROM pg), od AS (SELECT order_no, CASE WHEN substr(order_no, 4)::BIGINT % 4 = 0 THEN 'reviewed' ELSE 'auto_ok' END AS status FROM ld WHERE order_no IS NOT NULL GROUP BY 1)"""


def _filed(spark, d):
    p = pages(spark, d)
    docs = written(grouping.linked(grouping.documents(p), headers(spark, d)).select("batch_id", "page_from", "order_no"), "links")
    files = p.select(F.floor(F.col("batch_id") / 3).alias("upload"), "batch_id").distinct()
    status = F.when(F.expr("substr(order_no, 4)").cast("long") % 4 == 0, "reviewed").otherwise("auto_ok")
    orders = docs.filter("order_no is not null").select("order_no").distinct().withColumn("status", status)
    return p, docs, files, orders


@query(
    """SELECT fi.upload, count(DISTINCT fi.batch_id) AS files, (SELECT count(*) FROM pg JOIN fi f USING (batch_id) WHERE f.upload = fi.upload) AS pages, (SELECT count(*) FROM us WHERE us.upload = fi.upload AND n = 1) AS orders, (SELECT count(*) FROM us WHERE us.upload = fi.upload AND n > 1) AS shared,
  (SELECT count(*) FROM us JOIN od USING (order_no) WHERE us.upload = fi.upload AND status = 'reviewed') AS approved, (SELECT count(*) FROM pg JOIN fi f USING (batch_id) WHERE f.upload = fi.upload AND type_status = 'labelled') AS labels,
  (SELECT count(*) FROM pg JOIN fi f USING (batch_id) WHERE f.upload = fi.upload AND k % 37 = 3) AS confirmations FROM fi GROUP BY 1""",
    LINKED, FILES, "us AS (SELECT DISTINCT upload, order_no, count(DISTINCT upload) OVER (PARTITION BY order_no) AS n FROM ld JOIN fi USING (batch_id) WHERE order_no IS NOT NULL)",
)
def delete_impact(spark, d):
    """What deleting each upload would take away."""
    p, docs, files, orders = _filed(spark, d)
    return upkeep.impact(files, p.select("batch_id"), docs, orders, p.filter("type_status = 'labelled'").select("batch_id"), p.filter("k % 37 = 3").select("batch_id"))


@query("""SELECT order_no, CASE WHEN order_no IN (SELECT order_no FROM ld JOIN fi USING (batch_id) WHERE upload % 5 = 1 AND order_no IS NOT NULL) THEN 'grouping' ELSE status END AS status FROM od
  WHERE order_no IN (SELECT order_no FROM ld JOIN fi USING (batch_id) WHERE upload % 5 <> 1 AND order_no IS NOT NULL)""", LINKED, FILES)
def orders_after_delete(spark, d):
    """The orders that are left, and which are open again, when every fifth upload is deleted."""
    _, docs, files, orders = _filed(spark, d)
    return upkeep.without(docs, orders, files.filter("upload % 5 = 1").select("batch_id"))[1]


@query(
    """SELECT sor_no, p AS print, p <> q AS changed FROM (SELECT sor_no, sha1(string_agg(t, chr(10) ORDER BY t)) AS p, sha1(string_agg(t, chr(10) ORDER BY t) FILTER (NOT new)) AS q FROM fp GROUP BY 1)""",
    """fp AS (SELECT sor_no, 'lines:' || '=' || line_no || '|=' || item_code || '|=' || line_amount AS t, false AS new FROM ln
  UNION ALL SELECT own, 'pages:' || '=' || batch_id || '|=' || page_no || '|' || coalesce('=' || sor, '-') || '|' || coalesce('=' || po_no, '-') || '|' || coalesce('=' || total, '-'), j = 2 AND k % 13 = 0 FROM pg
  UNION ALL SELECT sor_no, 'record:' || coalesce('=' || customer_code, '-') || '|' || coalesce('=' || cpo_no, '-') || '|=' || tgl_so || '|=' || status, false FROM so)""",
)
def order_fingerprints(spark, d):
    """A print of all that an order's checks look at, and whether it changed since some receipts came."""
    p, o = pages(spark, d), headers(spark, d)
    parts = {"record": o.select("sor_no", "customer_code", "cpo_no", "tgl_so", "status"), "lines": lines(spark, d).select("sor_no", "line_no", "item_code", "line_amount")}
    seen = lambda df: df.select(F.col("own").alias("sor_no"), "batch_id", "page_no", "sor", "po_no", "total")
    new, old = (upkeep.fingerprints(parts | {"pages": seen(df)}, "sor_no") for df in (p, p.filter("not (j = 2 and k % 13 = 0)")))
    return new.join(old.withColumnRenamed("print", "old"), "sor_no").select("sor_no", "print", (F.col("print") != F.col("old")).alias("changed"))


CELLS = """ce AS (SELECT k, page_no, row_no, n.name AS name, n.value AS value FROM (SELECT k, page_no, row_no, unnest([{'name': 'code', 'value': CASE WHEN page_no = 2 AND k % 5 = 0 THEN upper(code) || 'x' ELSE code END}, {'name': 'name', 'value': name}, {'name': 'price', 'value': CASE WHEN page_no = 1 OR k % 3 > 0 THEN price END}]) AS n
  FROM pr WHERE page_no = 1 AND (k + row_no) % 11 > 0 OR page_no = 2 AND (k + row_no) % 9 > 0))"""


def _cells(spark, d):
    r, k = printed_rows(spark, d), F.col("k")
    two = F.col("page_no") == 2
    r = r.filter((~two & ((k + F.col("row_no")) % 11 > 0)) | (two & ((k + F.col("row_no")) % 9 > 0)))
    code = F.when(two & (k % 5 == 0), F.concat(F.upper("code"), F.lit("x"))).otherwise(F.col("code"))
    price = F.when(~two | (k % 3 > 0), F.col("price"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("code", code), ("name", F.col("name")), ("price", price))])).alias("c")
    return r.select("k", "page_no", "row_no", each).select("k", "page_no", "row_no", "c.*")


@query(
    """SELECT k, count(*) FILTER (a.value IS DISTINCT FROM b.value) AS cells, abs(count(DISTINCT a.row_no) - count(DISTINCT b.row_no)) AS rows FROM (SELECT * FROM ce WHERE page_no = 1) a FULL JOIN (SELECT * FROM ce WHERE page_no = 2) b USING (k, row_no, name) GROUP BY 1""",
    paperwork.ROWS_SQL, CELLS,
)
def reading_flips(spark, d):
    """How many cells and rows differ between two readings of an order's rows."""
    c = _cells(spark, d)
    return upkeep.flips(c.filter("page_no = 1"), c.filter("page_no = 2"), ["k"], "row_no")


@query(
    """SELECT k, row_no, a.value AS a, b.value AS b, row_number() OVER (PARTITION BY k ORDER BY a.at IS NULL, a.at, b.at, row_no)::INTEGER AS place FROM (SELECT k, row_no, 100 - row_no AS at, value FROM ce WHERE page_no = 1 AND name = 'name') a
  FULL JOIN (SELECT k, row_no, row_no AS at, value FROM ce WHERE page_no = 2 AND name = 'name') b USING (k, row_no)""",
    paperwork.ROWS_SQL, CELLS,
)
def readings_side_by_side(spark, d):
    """Two readings of an order's rows, paired by the block they stand in; the first reading's order leads."""
    c = _cells(spark, d).filter("name = 'name'")
    return upkeep.paired(c.filter("page_no = 1").withColumn("at", 100 - F.col("row_no")), c.filter("page_no = 2").withColumn("at", F.col("row_no")), ["k"], "row_no", "at")


@query(
    """SELECT page_id, name, CASE WHEN new IS NOT NULL THEN new ELSE value END AS value, CASE WHEN new IS NOT NULL AND new IS DISTINCT FROM value THEN value END AS read FROM (SELECT *, CASE WHEN kind = 'amount' AND source <> '' THEN printf('%.2f', replace(replace(source, '.', ''), ',', '.')::DOUBLE) END AS new
  FROM (SELECT page_id, name, kind, CASE WHEN page_id % 4 = 1 AND kind = 'amount' THEN '1' ELSE value END AS value, source FROM fd))""",
    PAPER_TEXT,
)
def amounts_as_printed(spark, d):
    """Amounts put as their printed source says, with what was read before."""
    from ledgerline.plans.evidence_queries import paper_fields

    f = paper_fields(spark, d).withColumn("value", F.when((F.col("page_id") % 4 == 1) & (F.col("kind") == "amount"), "1").otherwise(F.col("value"))).withColumn("read", F.lit(None).cast("string"))
    return upkeep.normal_amounts(f).select("page_id", "name", "value", "read")
