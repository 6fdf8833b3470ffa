"""Queries over order headers, lines and pages (``sources.paperwork``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.text import flat
from ledgerline.operators import grouping, settle, totals
from ledgerline.operators.written import written
from ledgerline.sources import paperwork
from ledgerline.sources.paperwork import headers, lines, pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str, *more: str, recursive: bool = False):
    """Registers a query; its SQL may use so, ln and pg, and the further common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([paperwork.SQL, *more]) + "\n" + sql
        return f

    return add


@query(
    """SELECT sor_no, CASE WHEN order_dpp IS NOT NULL THEN order_dpp WHEN coalesce(unchanged, true) THEN dpp WHEN priced THEN ld END::DOUBLE AS paper_dpp,
  CASE WHEN order_dpp IS NOT NULL THEN order_ppn WHEN coalesce(unchanged, true) THEN ppn WHEN priced THEN lp END::DOUBLE AS paper_ppn,
  CASE WHEN order_dpp IS NOT NULL THEN 'order' WHEN coalesce(unchanged, true) THEN 'invoice' WHEN priced THEN 'lines' ELSE 'none' END AS paper_origin FROM so LEFT JOIN l USING (sor_no)""",
    """l AS (SELECT sor_no, bool_and(invoice_qty IS NOT DISTINCT FROM qty_pcs) AS unchanged, bool_and(line_amount <> 0 AND vat IS NOT NULL) AS priced, sum(line_amount) AS ld, sum(vat) AS lp FROM ln GROUP BY 1)""",
)
def paper_amounts(spark, d):
    found = settle.as_ordered(headers(spark, d), lines(spark, d))
    return found.select("sor_no", F.col("paper_dpp").cast("double").alias("paper_dpp"), F.col("paper_ppn").cast("double").alias("paper_ppn"), "paper_origin")


@query(
    """SELECT sor_no, state, CASE state WHEN 'invoiced' THEN dpp::DOUBLE WHEN 'reconstructed' THEN floor((net + 50) / 100) / 100.0::DOUBLE END AS net FROM s""",
    """l AS (SELECT sor_no, bool_and(coalesce(abs(cgr_qty + rejected_qty - qty_pcs) < 0.001, false)) AS complete, sum(floor(line_amount::DOUBLE * cgr_qty / CASE WHEN qty_pcs = 0 THEN 1 ELSE qty_pcs END * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT) AS net FROM ln GROUP BY 1)""",
    """s AS (SELECT *, CASE WHEN status = 'SO_CANCELLED' OR sor_no LIKE 'SOF%' THEN 'unknown' WHEN dpp + ppn > 0 AND (status IN ('INVOICE_GENERATED', 'INVOICE_REQUESTED') OR cgr_no IS NOT NULL) THEN 'invoiced'
  WHEN cgr_no IS NOT NULL AND complete THEN 'reconstructed' ELSE 'waiting' END AS state FROM so LEFT JOIN l USING (sor_no))""",
)
def received_state(spark, d):
    return settle.received(headers(spark, d), lines(spark, d))


DOCS = """st AS (SELECT *, coalesce(type_status IN ('decided', 'labelled'), false) AS ok, lag(page_no) OVER (PARTITION BY batch_id ORDER BY page_no) AS prev FROM pg),
pt AS (SELECT *, sum((NOT (ok AND doc_type = 'CONTINUATION' AND coalesce(prev = page_no - 1, false)))::INT) OVER (PARTITION BY batch_id ORDER BY page_no) AS part FROM st),
dc AS (SELECT batch_id, min(page_no) AS page_from, max(page_no) AS page_to, arg_min(doc_type, page_no) AS doc_type, arg_min(struct_pack(v := sor), page_no).v AS sor, arg_min(struct_pack(v := po_no), page_no).v AS po_no,
  arg_min(struct_pack(v := key_by), page_no).v AS key_by, arg_min(struct_pack(v := bill), page_no).v AS bill, arg_min(struct_pack(v := CASE WHEN type_status IS NULL THEN 'not_read' WHEN NOT ok THEN 'type_unknown' WHEN doc_type = 'CONTINUATION' THEN 'continuation_without_start'
  WHEN doc_type IN ('FP', 'PO', 'TTG', 'FPJ') THEN NULL WHEN doc_type = 'PEL' THEN 'later_stage' ELSE 'not_grouped' END), page_no).v AS hold FROM pt GROUP BY batch_id, part)"""


@query("SELECT batch_id, page_from, page_to, doc_type, sor, po_no, key_by, hold FROM dc", DOCS)
def page_documents(spark, d):
    return grouping.documents(pages(spark, d)).drop("bill")


@query("SELECT pg.batch_id, pg.page_no, page_from, dc.doc_type FROM pg JOIN dc ON dc.batch_id = pg.batch_id AND pg.page_no BETWEEN page_from AND page_to", DOCS)
def pages_in_documents(spark, d):
    p = pages(spark, d)
    docs = grouping.documents(p).select("batch_id", "page_from", "page_to", "doc_type")
    return grouping.pages_of(docs, p.select("batch_id", "page_no")).select("batch_id", "page_no", "page_from", "doc_type")


LINKED = DOCS + f""",
ke AS (SELECT *, CASE WHEN key_by IS NOT NULL THEN sor END AS own, CASE WHEN key_by IS NOT NULL THEN po_no END AS po, CASE WHEN key_by IS NOT NULL THEN bill END AS own_bill FROM dc),
kp AS (SELECT *, list_distinct(list_filter([nullif(regexp_extract(coalesce(own, ''), 'SO[RF][0-9]{{11}}'), ''), nullif(regexp_extract({paperwork.flat_sql('own_bill')}, 'SO[RF][0-9]{{11}}'), '')], lambda x: x IS NOT NULL)) AS os,
  list_distinct(list_filter([nullif(regexp_extract(regexp_replace({paperwork.flat_sql('own')}, 'SO[RF][0-9]{{11}}', '|'), '(^|[^0-9])([0-9]{{10}})([^0-9]|$)', 2), ''), nullif(regexp_extract(regexp_replace({paperwork.flat_sql('own_bill')}, 'SO[RF][0-9]{{11}}', '|'), '(^|[^0-9])([0-9]{{10}})([^0-9]|$)', 2), '')], lambda x: x IS NOT NULL)) AS bs FROM ke),
fp AS (SELECT batch_id, own, count(*) AS n_fp, min(po) AS hub FROM ke WHERE hold IS NULL AND doc_type = 'FP' AND own IS NOT NULL GROUP BY ALL),
nb AS (SELECT NULL::BIGINT AS batch_id, cpo_no AS po, sor_no FROM so WHERE cpo_no IS NOT NULL UNION ALL SELECT batch_id, hub, own FROM fp WHERE n_fp = 1 AND hub IS NOT NULL),
hi AS (SELECT ke.batch_id, page_from, count(DISTINCT sor_no) AS n_so, min(sor_no) AS by_po FROM ke JOIN nb ON nb.po = ke.po AND (nb.batch_id IS NULL OR nb.batch_id = ke.batch_id) WHERE hold IS NULL AND doc_type IN ('PO', 'TTG') GROUP BY ALL),
li AS (SELECT kp.*, n_fp, n_so, by_po, CASE WHEN hold IS NOT NULL THEN hold WHEN doc_type = 'FP' THEN CASE WHEN kp.own IS NULL THEN 'fp_sor_unresolved' WHEN n_fp > 1 THEN 'two_fps_one_sor' END
  WHEN doc_type = 'FPJ' THEN CASE WHEN kp.own IS NULL AND own_bill IS NULL THEN 'no_resolved_key' WHEN len(os) > 1 OR len(bs) > 1 THEN 'keys_disagree' WHEN len(os) = 0 OR len(bs) = 0 THEN 'fpj_needs_both' WHEN r.sor_no IS NULL THEN 'so_unknown'
    WHEN r.billing_no IS NULL THEN 'needs_sap_billing' WHEN r.billing_no <> bs[1] THEN 'billing_disagrees' END
  WHEN n_so > 1 THEN 'po_matches_several_sos' WHEN kp.own IS NULL AND po IS NULL THEN 'no_resolved_key' WHEN kp.own IS NULL AND by_po IS NULL THEN 'so_unknown' WHEN kp.own <> by_po THEN 'keys_disagree' END AS why
  FROM kp LEFT JOIN fp ON fp.batch_id = kp.batch_id AND fp.own = kp.own LEFT JOIN hi ON hi.batch_id = kp.batch_id AND hi.page_from = kp.page_from LEFT JOIN so r ON r.sor_no = os[1] AND len(os) = 1),
ld AS (SELECT batch_id, page_from, page_to, doc_type, CASE WHEN why IS NULL THEN CASE WHEN doc_type = 'FPJ' THEN os[1] ELSE coalesce(own, by_po) END END AS order_no,
  CASE WHEN why IS NULL THEN CASE WHEN doc_type = 'FPJ' THEN 'billing_no' WHEN own IS NOT NULL THEN 'sor' ELSE 'po_no' END END AS linked_by, why AS hold, sor, po_no FROM li)"""


@query("SELECT * EXCLUDE (sor, po_no) FROM ld", LINKED)
def grouping_plan(spark, d):
    return grouping.linked(grouping.documents(pages(spark, d)), headers(spark, d))


@query(
    """SELECT a.batch_id, a.page_from, s.order_no AS suggest, s.edits FROM a LEFT JOIN s ON s.batch_id = a.batch_id AND s.page_from = a.page_from""",
    LINKED,
    """a AS (SELECT batch_id, page_from, coalesce(sor, '') AS sor, coalesce(po_no, '') AS po FROM ld WHERE hold = 'fp_sor_unresolved'), orph AS (SELECT batch_id, order_no FROM ld WHERE order_no IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (doc_type = 'FP') = 0)""",
    """di AS (SELECT a.batch_id, a.page_from, order_no, least(CASE WHEN length(a.sor) > 3 THEN levenshtein(a.sor, order_no) ELSE 99 END, CASE WHEN length(a.po) > 3 AND cpo_no IS NOT NULL THEN levenshtein(a.po, cpo_no) ELSE 99 END)::INTEGER AS edits
  FROM a JOIN orph USING (batch_id) LEFT JOIN so ON so.sor_no = order_no)""",
    """s AS (SELECT batch_id, page_from, min(order_no) AS order_no, min(edits) AS edits FROM (SELECT *, min(edits) OVER (PARTITION BY batch_id, page_from) AS least FROM di WHERE edits <= 3) WHERE edits = least GROUP BY 1, 2 HAVING count(*) = 1)""",
)
def suggested_orders(spark, d):
    """For invoices whose order number isn't resolved: the order of the scan that has papers but no invoice and is nearest to what was read."""
    so = headers(spark, d)
    links = written(grouping.linked(grouping.documents(pages(spark, d)), so, keep=("sor", "po_no")), "links")
    return grouping.suggested(links, links, so)


@query(
    """SELECT order_no, count(*) AS n_documents, count(DISTINCT batch_id) AS n_scans,
  CASE WHEN count(*) FILTER (doc_type = 'FP') = 0 THEN 'fp_missing' WHEN count(*) FILTER (doc_type = 'FP') > 1 THEN 'two_fps_one_sor' END AS hold FROM ld WHERE order_no IS NOT NULL GROUP BY 1""",
    LINKED,
)
def bundle_holds(spark, d):
    return grouping.bundles(grouping.linked(grouping.documents(pages(spark, d)), headers(spark, d)))


@query(
    """SELECT batch_id, page_no, po_no FROM pg WHERE doc_type = 'PO' QUALIFY coalesce(po_no, '') = '' OR row_number() OVER (PARTITION BY batch_id, po_no ORDER BY page_no) = 1""",
)
def distinct_po_documents(spark, d):
    p = pages(spark, d).filter("doc_type = 'PO'").select("batch_id", "page_no", "po_no")
    return settle.distinct_documents(p, "po_no", ["batch_id"], F.col("page_no"))


MARKS = "CASE k % 5 WHEN 0 THEN [k // 7 * 10.0, 5.5] WHEN 1 THEN [5.0, k // 7 * 10.0 + 0.5] WHEN 2 THEN [k // 7 * 10.0] END::DOUBLE[]"


@query(
    """SELECT batch_id, po_no AS number, count(*) AS n, CASE WHEN bool_or(CASE WHEN own_total IS NOT NULL AND head IS NOT NULL THEN abs(own_total - head) > 1
    ELSE coalesce(len(marks) <> len(head_marks) OR len(list_filter(range(1, len(marks) + 1), lambda i: abs(marks[i] - head_marks[i]) > 1)) > 0, false) END) THEN 'fail' ELSE 'pass' END AS verdict FROM f GROUP BY 1, 2 HAVING count(*) > 1""",
    f"""t AS (SELECT batch_id, page_no, po_no, CASE WHEN NOT cut THEN total END AS own_total, list_sort({MARKS}) AS marks FROM pg WHERE po_no IS NOT NULL),
f AS (SELECT *, first_value(own_total) OVER w AS head, first_value(marks) OVER w AS head_marks FROM t WINDOW w AS (PARTITION BY batch_id, po_no ORDER BY page_no))""",
)
def same_number_copies(spark, d):
    """Documents of one number in a scan: totals decide whether they are copies, or their rows' amounts."""
    k, ten = F.col("k"), F.floor(F.col("k") / 7) * 10.0
    marks = F.when(k % 5 == 0, F.array(ten, F.lit(5.5))).when(k % 5 == 1, F.array(F.lit(5.0), ten + 0.5)).when(k % 5 == 2, F.array(ten))
    return settle.copies(pages(spark, d).select("batch_id", "page_no", "po_no", "cut", "total", marks.alias("marks")), "po_no", ["batch_id"], marks="marks")


def _nearest(got: str, refs: dict[str, str]) -> str:
    """The name of the nearest reference within the papers' allowance, in SQL."""
    gaps = ", ".join(f"abs({got} - {v})" for v in refs.values())
    whens = " ".join(f"WHEN abs({got} - {v}) = least({gaps}) THEN '{k}'" for k, v in refs.items())
    return f"CASE WHEN least({gaps})::DOUBLE <= n * 1000 + 0.005 THEN CASE {whens} END END"


def _settled(name: str, source: str, num: str, printed: str, asked: str, second: str, refs: dict[str, str]) -> tuple[str, str]:
    sums = f"""{name}_r AS (SELECT sor_no, count(*) AS n, sum({num}) AS got, sum(CASE WHEN NOT {printed} AND {second} IS NOT NULL THEN {second} ELSE {num} END) AS again, bool_and({printed}) AS backed,
  bool_or(NOT {printed} AND NOT {asked}) AS pending, {', '.join(f'max({v}) AS {v}' for v in refs.values())} FROM {source} GROUP BY 1),
{name}_h AS (SELECT *, {_nearest('got', refs)} AS h1, {_nearest('again', refs)} AS h2 FROM {name}_r)"""
    return sums, f"""{name} AS (SELECT sor_no, CASE WHEN h1 IS NOT NULL THEN 'pass' WHEN backed THEN 'fail' WHEN pending THEN 'ask' WHEN h2 IS NOT NULL THEN 'pass' ELSE 'unknown' END AS status,
  (CASE WHEN h1 IS NULL AND NOT backed AND NOT pending AND h2 IS NOT NULL THEN again ELSE got END)::DOUBLE AS got, CASE WHEN h1 IS NOT NULL THEN h1 WHEN NOT backed AND NOT pending THEN h2 END AS ref FROM {name}_h)"""


PAPERS = """pa AS (SELECT own AS sor_no, pg.k, total, cut, printed, asked, second, order_dpp, order_ppn, (order_dpp + order_ppn)::DECIMAL(18,2) AS order_total,
  (CASE pg.k % 10 WHEN 3 THEN order_ppn + 3000 WHEN 4 THEN NULL ELSE order_ppn END)::DECIMAL(18,2) AS ppn, pg.k % 33 = 1 AS ppn_cut FROM pg JOIN so ON so.k = pg.k WHERE doc_type = 'PO' OR doc_type = 'TTG' AND pg.k % 10 = 3),
fl AS (SELECT sor_no, bool_and(total IS NOT NULL AND NOT cut) AS usable, bool_and(ppn IS NOT NULL AND NOT ppn_cut) AS taxed, bool_or(total IS NULL AND NOT asked) AS open FROM pa GROUP BY 1),
us AS (SELECT pa.* FROM pa JOIN fl USING (sor_no) WHERE usable), ux AS (SELECT pa.* FROM pa JOIN fl USING (sor_no) WHERE usable AND taxed),
pl AS (SELECT sor_no, row_number() OVER (PARTITION BY sor_no ORDER BY page_no, row_no, pos) - 1 AS k, a FROM
  (SELECT sor_no, page_no, row_no, pos, CASE pos WHEN 0 THEN round(price::DOUBLE, 2) ELSE amount END AS a FROM pr JOIN fl USING (sor_no), range(2) AS y(pos) WHERE NOT usable AND doc_type = 'PO') WHERE a IS NOT NULL),
wn AS (SELECT sor_no, row_number() OVER (PARTITION BY sor_no ORDER BY line_no) AS i, line_no, line_amount::DOUBLE AS net, round(line_amount::DOUBLE + coalesce(vat::DOUBLE, 0), 2) AS gross FROM ln JOIN fl USING (sor_no) WHERE NOT usable AND line_amount > 0),
pool AS (SELECT sor_no, list({'k': k, 'a': a} ORDER BY k) AS p FROM pl GROUP BY 1),
g AS (SELECT DISTINCT wn.sor_no, 0::BIGINT AS i, coalesce(p, []) AS p, 0::BIGINT AS missing, NULL::DOUBLE AS gap FROM wn LEFT JOIN pool USING (sor_no)
  UNION ALL SELECT sor_no, i, CASE WHEN b.d <= 1000.005::DOUBLE THEN list_filter(p, lambda x: x.k <> b.k) ELSE p END, missing + CASE WHEN coalesce(b.d <= 1000.005::DOUBLE, false) THEN 0 ELSE 1 END, CASE WHEN b IS NULL THEN gap ELSE greatest(gap, b.d) END
  FROM (SELECT g.sor_no, wn.i, g.p, g.missing, g.gap, list_min(list_transform(g.p, lambda x: {'d': least(abs(x.a - wn.net), abs(x.a - wn.gross)), 'k': x.k})) AS b FROM g JOIN wn ON wn.sor_no = g.sor_no AND wn.i = g.i + 1)),
lm AS (SELECT sor_no, max(missing) AS missing, floor(max(gap) * 100 + 0.5::DOUBLE) / 100 AS gap FROM g GROUP BY 1)"""
_TOTAL, _TAX = _settled("st", "us", "total", "printed", "asked", "second", {"order_dpp": "order_dpp", "order_total": "order_total"}), _settled("tx", "ux", "ppn", "printed", "asked", "NULL::DECIMAL(18,2)", {"order_ppn": "order_ppn"})


@query(
    """SELECT sor_no, CASE WHEN st.status = 'pass' AND coalesce(tx.status <> 'pass', false) THEN tx.status ELSE st.status END AS status, CASE WHEN st.status = 'pass' AND coalesce(tx.status <> 'pass', false) THEN 'tax' ELSE 'total' END AS by,
  st.got, st.ref, NULL::INTEGER AS n_missing, NULL::DOUBLE AS gap FROM st LEFT JOIN tx USING (sor_no)
UNION ALL SELECT sor_no, CASE WHEN coalesce(missing, 0) = 0 THEN 'pass' WHEN open THEN 'ask' ELSE 'unknown' END, 'rows', NULL, NULL, coalesce(missing, 0)::INTEGER, gap FROM fl LEFT JOIN lm USING (sor_no) WHERE NOT usable""",
    paperwork.ROWS_SQL, PAPERS, *_TOTAL, *_TAX, recursive=True,
)
def order_side_totals(spark, d):
    """Purchase papers against the order: totals and tax where every paper's total can be used, else the rows' amounts."""
    so = headers(spark, d).select("k", "sor_no", "order_dpp", "order_ppn", (F.col("order_dpp") + F.col("order_ppn")).cast("decimal(18,2)").alias("order_total"))
    k = F.col("k")
    docs = pages(spark, d).filter((F.col("doc_type") == "PO") | ((F.col("doc_type") == "TTG") & (k % 10 == 3))).join(so.select("k", "order_ppn"), "k")
    tax = F.when(k % 10 == 3, F.col("order_ppn") + 3000).when(k % 10 == 4, None).otherwise(F.col("order_ppn")).cast("decimal(18,2)")
    docs = docs.select(F.col("own").alias("sor_no"), "total", "cut", "printed", "asked", "second", tax.alias("ppn"), (k % 33 == 1).alias("ppn_cut"), F.col("printed").alias("ppn_printed"), F.col("asked").alias("ppn_asked"), F.lit(None).cast("decimal(18,2)").alias("ppn_second"))
    rows = paperwork.printed_rows(spark, d).filter("doc_type = 'PO'").select("sor_no", "page_no", "row_no", F.array(F.col("price").cast("double"), "amount").alias("amounts"))
    return totals.order_side(docs, rows, so, lines(spark, d))


@query(
    """SELECT own AS sor_no, CASE max(CASE WHEN day IS NOT NULL AND (coalesce(day = cgr_date, false) OR tgl_so <= day AND day <= scan_day) THEN 0 WHEN day IS NOT NULL AND printed THEN 2 ELSE 1 END)
  WHEN 0 THEN 'pass' WHEN 1 THEN 'unknown' ELSE 'fail' END AS status FROM pg WHERE doc_type = 'TTG' GROUP BY 1"""
)
def receipt_dates(spark, d):
    return settle.dates_in_order(pages(spark, d).filter("doc_type = 'TTG'").withColumnRenamed("own", "sor_no"), ["sor_no"])


CHECKS = """qt AS (SELECT sor_no, CASE WHEN bool_or(cgr_qty IS NULL) THEN 'waiting' WHEN bool_or(cgr_qty <> qty_pcs) THEN 'fail' ELSE 'pass' END AS status FROM ln GROUP BY 1),
am AS (SELECT sor_no, CASE WHEN order_dpp IS NULL THEN 'unknown' ELSE 'pass' END AS status FROM so),
ck AS (SELECT sor_no, 'quantity' AS name, status FROM qt UNION ALL SELECT sor_no, 'amount', status FROM am)"""


def _checks(spark, d):
    """(sor_no, name, status): a quantity and an amount check of each order."""
    refused, open_ = F.bool_or(F.col("cgr_qty") != F.col("qty_pcs")), F.bool_or(F.col("cgr_qty").isNull())
    quantity = lines(spark, d).groupBy("sor_no").agg(F.when(open_, "waiting").when(refused, "fail").otherwise("pass").alias("status")).select("sor_no", F.lit("quantity").alias("name"), "status")
    amount = headers(spark, d).select("sor_no", F.lit("amount").alias("name"), F.when(F.col("order_dpp").isNull(), "unknown").otherwise("pass").alias("status"))
    return quantity.unionByName(amount)


@query(
    """SELECT sor_no, CASE WHEN old_status = 'reviewed' AND NOT changed THEN 'reviewed' WHEN coalesce(waits, false) OR coalesce(later, 0) > 0 THEN 'grouping' WHEN n = 0 THEN 'auto_ok' ELSE 'needs_review' END AS status, n::BIGINT AS n_reasons FROM a""",
    CHECKS,
    """c AS (SELECT sor_no, count(*) FILTER (status IN ('fail', 'unknown')) AS bad, count(*) FILTER (status = 'waiting') AS later FROM ck GROUP BY 1),
p AS (SELECT own AS sor_no, bool_or(outcome = 'waiting_ai') AS waits, bool_or(outcome IN ('needs_person', 'held_unsure')) AS person FROM pg GROUP BY 1),
o AS (SELECT sor_no, CASE WHEN k % 7 < 2 THEN 'reviewed' ELSE 'needs_review' END AS old_status, k % 7 = 1 AS changed FROM so),
a AS (SELECT *, coalesce(bad, 0) + coalesce(person, false)::INT + coalesce(old_status = 'reviewed' AND changed, false)::INT AS n FROM c FULL JOIN p USING (sor_no) LEFT JOIN o USING (sor_no))""",
)
def order_decisions(spark, d):
    old = headers(spark, d).select("sor_no", F.when(F.col("k") % 7 < 2, "reviewed").otherwise("needs_review").alias("old_status"), (F.col("k") % 7 == 1).alias("changed"))
    return settle.decide(_checks(spark, d), pages(spark, d).select(F.col("own").alias("sor_no"), "outcome"), old, "sor_no")


@query(
    """SELECT sor_no, name, CASE WHEN status IN ('fail', 'unknown') AND given = print AND name <> 'calibration' THEN 'accepted' ELSE status END AS status, print FROM
  (SELECT ck.*, left(sha1('["' || status || '"]'), 16) AS print, CASE WHEN substr(sor_no, 14, 1) IN ('1', '2') THEN left(sha1('["fail"]'), 16) END AS given FROM ck)""",
    CHECKS,
)
def accepted_checks(spark, d):
    """A person's acceptance holds while the check still says what was accepted: its print is the same."""
    print_ = lambda c: F.left(F.sha1(F.to_json(F.array(c))), F.lit(16))
    c = _checks(spark, d).withColumn("print", print_(F.col("status")))
    given = F.when(F.substring("sor_no", 14, 1).isin("1", "2"), print_(F.lit("fail")))
    held = F.col("status").isin("fail", "unknown") & (given == F.col("print")) & (F.col("name") != "calibration")
    return c.select("sor_no", "name", F.when(held, "accepted").otherwise(F.col("status")).alias("status"), "print")


@query(
    """SELECT coalesce(a.sor_no, b.sor_no) AS sor_no, a.status AS stored, b.status AS fresh FROM (SELECT * FROM qt WHERE sor_no NOT LIKE '%9') a
  FULL JOIN (SELECT sor_no, CASE WHEN sor_no LIKE '%3' THEN 'pass' ELSE status END AS status FROM qt WHERE sor_no NOT LIKE '%8') b ON a.sor_no = b.sor_no WHERE a.status IS DISTINCT FROM b.status""",
    CHECKS,
)
def shadow_diff(spark, d):
    """Checks whose new result differs from the stored one, or that only one side has."""
    q = _checks(spark, d).filter("name = 'quantity'").select("sor_no", "status")
    stored = q.filter("sor_no not like '%9'").withColumnRenamed("status", "stored")
    fresh = q.filter("sor_no not like '%8'").select("sor_no", F.when(F.endswith("sor_no", F.lit("3")), "pass").otherwise(F.col("status")).alias("fresh"))
    return stored.join(fresh, "sor_no", "full").filter(~F.col("stored").eqNullSafe(F.col("fresh")))


@query("SELECT batch_id, page_no FROM pg WHERE EXISTS (SELECT 1 FROM ln WHERE ln.k = pg.k AND rejected_qty > 0)")
def pages_with_refused_lines(spark, d):
    refused = lines(spark, d).filter("rejected_qty > 0").select("k")
    return pages(spark, d).select("batch_id", "page_no", "k").join(refused, "k", "left_semi").select("batch_id", "page_no")


@query("SELECT so.sor_no, customer_code, tgl_so FROM so WHERE cpo_no IN (SELECT po_no FROM pg WHERE key_by = 'qr' AND doc_type = 'PO')")
def orders_by_numbers(spark, d):
    """The orders of a set of purchase numbers: a semi join, so the set may be of any size."""
    wanted = pages(spark, d).filter("key_by = 'qr' and doc_type = 'PO'").select(F.col("po_no").alias("cpo_no"))
    return headers(spark, d).join(wanted, "cpo_no", "left_semi").select("sor_no", "customer_code", "tgl_so")


#: What an error says, by cause, in the order in which causes are told; a text of STOPPED at its start is of no cause.
STOPPED = "Stopped on purpose"
CAUSES = {
    "setting": [r"HTTP 400\b", r"HTTP 401\b", r"HTTP 403\b", r"HTTP 404\b", "refused the API key", "no API key", "NotSet", "isn't set", "no model"],
    "connection": ["(?i)connect", "(?i)ssl", "(?i)timeout", "(?i)timed out", "(?i)eof", r"(?i)HTTP 5\d\d", "(?i)unavailable after retries"],
    "answer": ["JSONDecodeError", "no JSON", "not an option number", "garbled"],
}
_quoted = lambda p: p.replace("'", "''")
CAUSE_SQL = f"CASE WHEN starts_with(coalesce(e, ''), '{STOPPED}') THEN 'other' " + " ".join(f"WHEN regexp_matches(coalesce(e, ''), '{_quoted(p)}') THEN '{cause}'" for cause, ps in CAUSES.items() for p in ps) + " ELSE 'other' END"


@query(
    f"""SELECT batch_id, page_no, CASE WHEN status IN ('dead_letter', 'failed') THEN 'crashed' WHEN status = 'read' AND (extract_status = 'failed' OR contains(coalesce(waits, ''), 'the call failed')) THEN 'call_failed' END AS stuck,
  batch_id % 12 = 5 AS stopped, {CAUSE_SQL} AS cause, CASE WHEN strpos(e, ':') BETWEEN 1 AND 41 THEN split_part(e, ':', 1) WHEN strpos(e, ':') = 0 AND length(e) <= 40 THEN e ELSE left(e, 40) END AS short FROM ew""",
    """er AS (SELECT *, CASE k % 27 WHEN 9 THEN 'the provider refused the API key' WHEN 10 THEN 'unavailable after retries' WHEN 11 THEN 'not an option number: 7' WHEN 12 THEN 'NotSet: no model' WHEN 13 THEN NULL ELSE error END AS err,
  CASE k % 5 WHEN 0 THEN 'the call failed (HTTP 503)' WHEN 1 THEN 'later' END AS waits FROM pg)""",
    """ew AS (SELECT *, coalesce(err, CASE WHEN extract_status = 'failed' THEN 'garbled answer' END, waits) AS e FROM er)""",
)
def stuck_pages(spark, d):
    """Pages that crashed, or whose call, or call to look again, failed; whether their file was stopped on purpose, in which case they aren't stuck; and the cause that the error tells, other if none."""
    k = F.col("k")
    err = F.when(k % 27 == 9, "the provider refused the API key").when(k % 27 == 10, "unavailable after retries").when(k % 27 == 11, "not an option number: 7").when(k % 27 == 12, "NotSet: no model").when(k % 27 == 13, None).otherwise(F.col("error"))
    p = pages(spark, d).withColumn("waits", F.when(k % 5 == 0, "the call failed (HTTP 503)").when(k % 5 == 1, "later")).withColumn("err", err)
    p = p.withColumn("e", F.coalesce("err", F.when(F.col("extract_status") == "failed", "garbled answer"), "waits"))
    e, s = F.coalesce("e", F.lit("")), F.col("status")
    call = (F.col("extract_status") == "failed") | F.contains(F.coalesce("waits", F.lit("")), F.lit("the call failed"))
    stuck = F.when(s.isin("dead_letter", "failed"), "crashed").when((s == "read") & call, "call_failed")
    cause = F.when(F.startswith(e, F.lit(STOPPED)), "other")
    for name, phrases in CAUSES.items():
        for phrase in phrases:
            cause = cause.when(e.rlike(phrase), name)
    head = F.substring_index("e", ":", 1)
    short = F.when(F.length(head) <= 40, head).otherwise(F.left("e", F.lit(40)))
    return p.select("batch_id", "page_no", stuck.alias("stuck"), (F.col("batch_id") % 12 == 5).alias("stopped"), cause.otherwise("other").alias("cause"), short.alias("short"))


@query(
    """SELECT order_no, doc_type, hold, CASE WHEN hold IN ('not_read', 'fp_missing') THEN 'wait' WHEN doc_type IN ('FP', 'PO', 'TTG') THEN 'block' ELSE 'later' END AS held, count(*) AS n FROM ld WHERE hold IS NOT NULL GROUP BY ALL""",
    LINKED,
)
def held_groups(spark, d):
    """Where held documents belong: the system settles them, a person must, or they never block."""
    docs = grouping.linked(grouping.documents(pages(spark, d)), headers(spark, d)).filter("hold is not null")
    held = F.when(F.col("hold").isin("not_read", "fp_missing"), "wait").when(F.col("doc_type").isin("FP", "PO", "TTG"), "block").otherwise("later")
    return docs.groupBy("order_no", "doc_type", "hold", held.alias("held")).agg(F.count("*").alias("n"))


@query(
    """SELECT sor_no, CASE WHEN customer_parent <> '' THEN customer_parent ELSE customer_code END AS chain, sor_no LIKE 'SOF%' AS free_goods,
  CASE WHEN billing_no IS NULL THEN 'not billed' WHEN cgr_no IS NULL THEN 'no receipt' WHEN status = 'SO_CANCELLED' THEN 'cancelled' END AS refusal FROM so"""
)
def order_refusals(spark, d):
    """Why an order can't be sent yet, the first reason that holds; its chain, or the store itself where the chain is empty."""
    refusal = F.when(F.col("billing_no").isNull(), "not billed").when(F.col("cgr_no").isNull(), "no receipt").when(F.col("status") == "SO_CANCELLED", "cancelled")
    chain = F.coalesce(F.nullif("customer_parent", F.lit("")), "customer_code")
    return headers(spark, d).select("sor_no", chain.alias("chain"), F.startswith("sor_no", F.lit("SOF")).alias("free_goods"), refusal.alias("refusal"))


@query(
    """SELECT sor_no, line_no, item_code, CASE WHEN count(*) OVER w > 1 AND row_number() OVER (PARTITION BY sor_no, item_code ORDER BY line_no) > 1
  THEN item_code || '#' || row_number() OVER (PARTITION BY sor_no, item_code ORDER BY line_no) ELSE item_code END AS row_key FROM ln WINDOW w AS (PARTITION BY sor_no, item_code)"""
)
def row_keys(spark, d):
    """A line's code, and from its second line on the code and which one it is."""
    n = F.row_number().over(Window.partitionBy("sor_no", "item_code").orderBy("line_no"))
    l = lines(spark, d).select("sor_no", "line_no", "item_code").withColumn("n", n)
    return l.select("sor_no", "line_no", "item_code", F.when(F.col("n") > 1, F.concat_ws("#", "item_code", F.col("n").cast("string"))).otherwise(F.col("item_code")).alias("row_key"))


@query(
    """SELECT own AS sor_no, batch_id * 1 AS batch_id, (dense_rank() OVER (PARTITION BY own ORDER BY (NOT fp)::INT, batch_id) - 1) * 10000 + page_no AS page_key FROM
  (SELECT *, bool_or(doc_type = 'FP') OVER (PARTITION BY own, batch_id) AS fp FROM pg)"""
)
def pages_across_scans(spark, d):
    """Page keys of an order over its scans: the scan with its FP first, then by arrival, ten thousand apart."""
    fp = F.max((F.col("doc_type") == "FP").cast("int")).over(Window.partitionBy("own", "batch_id"))
    rank = F.dense_rank().over(Window.partitionBy("own").orderBy(F.desc("fp"), "batch_id"))
    p = pages(spark, d).select("own", "batch_id", "page_no", "doc_type").withColumn("fp", fp)
    return p.select(F.col("own").alias("sor_no"), "batch_id", ((rank - 1) * 10000 + F.col("page_no")).cast("long").alias("page_key"))


@query(
    """SELECT doc_type, count(*) FILTER (v = 'ok') AS ok, count(*) FILTER (v = 'check') AS "check", count(*) FILTER (v = 'empty') AS empty,
  round(count(*) FILTER (v = 'ok') / nullif(count(*) FILTER (v <> 'empty'), 0)::DOUBLE, 3) AS confidence FROM
  (SELECT doc_type, CASE WHEN total IS NULL THEN 'empty' WHEN printed AND NOT cut THEN 'ok' ELSE 'check' END AS v FROM pg) GROUP BY 1"""
)
def verdict_counts(spark, d):
    v = F.when(F.col("total").isNull(), "empty").when(F.col("printed") & ~F.col("cut"), "ok").otherwise("check")
    wide = pages(spark, d).select("doc_type", v.alias("v")).groupBy("doc_type").pivot("v", ["ok", "check", "empty"]).count().fillna(0)
    share = F.round(F.try_divide(F.col("ok").cast("double"), F.col("ok") + F.col("check")), 3)
    return wide.select("doc_type", "ok", "check", "empty", share.alias("confidence"))


@query(
    """SELECT own AS sor_no, max(coalesce(CASE WHEN k % 3 = 0 THEN scan_day END, day)) AS last_scan, list(DISTINCT doc_type ORDER BY doc_type)::VARCHAR AS types,
  string_agg(batch_id || ':' || page_no, ',' ORDER BY batch_id, page_no) AS at FROM pg GROUP BY 1"""
)
def order_scan_days(spark, d):
    """The last day an order was scanned, what it consists of, and where."""
    p = pages(spark, d)
    at = F.transform(F.array_sort(F.collect_list(F.struct("batch_id", "page_no"))), lambda x: F.concat_ws(":", x["batch_id"].cast("string"), x["page_no"].cast("string")))
    types = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("doc_type")), ", "), F.lit("]"))
    return p.groupBy(F.col("own").alias("sor_no")).agg(F.max(F.coalesce(F.when(F.col("k") % 3 == 0, F.col("scan_day")), F.col("day"))).alias("last_scan"), types.alias("types"), F.array_join(at, ",").alias("at"))


@query(
    """SELECT sor_no, cgr_qty_total, status, why FROM (SELECT sor_no, sum(cgr_qty) AS cgr_qty_total, CASE WHEN count(*) FILTER (cgr_qty IS NULL) > 0 THEN 'unknown' WHEN bool_and(abs(cgr_qty - qty_pcs) < 0.001) THEN 'pass'
  WHEN bool_and(abs(cgr_qty + rejected_qty - qty_pcs) < 0.001) THEN 'pass' ELSE 'fail' END AS status, CASE WHEN count(*) FILTER (cgr_qty IS NULL) > 0 THEN 'missing' WHEN sum(rejected_qty) > 0 THEN 'refused' ELSE 'full' END AS why FROM ln GROUP BY 1)"""
)
def delivery_side(spark, d):
    """Received pieces of each order's lines, with what was refused, against the ordered ones."""
    whole, with_refused = (F.bool_and(F.abs(c - F.col("qty_pcs")) < 0.001) for c in (F.col("cgr_qty"), F.col("cgr_qty") + F.col("rejected_qty")))
    missing = F.count_if(F.col("cgr_qty").isNull()) > 0
    status = F.when(missing, "unknown").when(whole | with_refused, "pass").otherwise("fail")
    why = F.when(missing, "missing").when(F.sum("rejected_qty") > 0, "refused").otherwise("full")
    return lines(spark, d).groupBy("sor_no").agg(F.sum("cgr_qty").alias("cgr_qty_total"), status.alias("status"), why.alias("why"))


CUTS = "list_distinct(list_append([left(s, i - 1) || substr(s, i + 1) for i in range(1, length(s) + 1)], s))"


@query(
    """SELECT so.sor_no, so.cpo_no, CASE WHEN n > 1 THEN 'several' WHEN near > 0 THEN 'one character away' ELSE 'unique' END AS verdict FROM so JOIN u ON u.s = so.cpo_no LEFT JOIN m ON m.s = so.cpo_no""",
    "u AS (SELECT cpo_no AS s, count(*) AS n FROM so WHERE cpo_no IS NOT NULL GROUP BY 1)",
    f"v AS (SELECT s, unnest({CUTS}) AS v FROM u)",
    "m AS (SELECT s, count(*) AS near FROM (SELECT DISTINCT a.s AS s, b.s AS t FROM v a JOIN v b ON a.v = b.v AND a.s <> b.s AND levenshtein(a.s, b.s) = 1) GROUP BY 1)",
)
def unique_numbers(spark, d):
    """Whether a purchase number names one order: others that share it, or differ by one character, leave it open. Keys
    are compared once each, by equality of what is left when one character is taken out."""
    from ledgerline.operators.keys import near_sums

    so = headers(spark, d).filter("cpo_no is not null").select("sor_no", "cpo_no")
    known = so.select(F.col("cpo_no").alias("v"), F.lit(None).cast("string").alias("x"))
    sums = near_sums(known.select("v"), known, [])
    verdict = F.when(F.col("exact") > 1, "several").when(F.col("near"), "one character away").otherwise("unique")
    return so.join(sums.withColumnRenamed("v", "cpo_no"), "cpo_no").select("sor_no", "cpo_no", verdict.alias("verdict"))


@query(
    """SELECT batch_id, page_no, CASE WHEN key_by = 'qr' THEN 'qr' WHEN sor IS NOT NULL OR po_no IS NOT NULL THEN CASE WHEN printed THEN 'ocr_text' END END AS confirmed_by,
  CASE WHEN sor IS NOT NULL AND NOT regexp_full_match(sor, 'SO[RF][0-9]{11}') THEN 'not an order number' WHEN sor IS NOT NULL AND key_by = 'qr' AND sor <> own THEN 'code and text disagree' END AS problem FROM pg"""
)
def page_keys(spark, d):
    """What confirms a page's keys, the code before the text, and what is wrong with them."""
    read = F.col("sor").isNotNull() | F.col("po_no").isNotNull()
    by = F.when(F.col("key_by") == "qr", "qr").when(read & F.col("printed"), "ocr_text")
    problem = F.when(~F.rlike("sor", F.lit("^SO[RF][0-9]{11}$")), "not an order number").when((F.col("key_by") == "qr") & (F.col("sor") != F.col("own")), "code and text disagree")
    return pages(spark, d).select("batch_id", "page_no", by.alias("confirmed_by"), problem.alias("problem"))


@query(
    """SELECT own AS sor_no, doc_type, batch_id, page_no, coalesce(sum(1) OVER (PARTITION BY own ORDER BY r, batch_id, page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_ref FROM
  (SELECT *, CASE doc_type WHEN 'FP' THEN 0 WHEN 'PO' THEN 1 WHEN 'TTG' THEN 2 ELSE 3 END AS r FROM pg WHERE doc_type IN ('FP', 'PO', 'TTG', 'FPJ'))"""
)
def publish_order(spark, d):
    """Pages of an order's file: invoice, purchase orders, receipts, tax invoice, each with its place."""
    r = F.when(F.col("doc_type") == "FP", 0).when(F.col("doc_type") == "PO", 1).when(F.col("doc_type") == "TTG", 2).otherwise(3)
    p = pages(spark, d).filter(F.col("doc_type").isin("FP", "PO", "TTG", "FPJ")).select(F.col("own").alias("sor_no"), "doc_type", "batch_id", "page_no", r.alias("r"))
    n = F.row_number().over(Window.partitionBy("sor_no").orderBy("r", "batch_id", "page_no"))
    return p.select("sor_no", "doc_type", "batch_id", "page_no", (n - 1).cast("long").alias("page_ref"))


@query(
    """SELECT chain, name, count(DISTINCT sor_no) AS n, count(*) OVER (PARTITION BY chain) AS names FROM (SELECT CASE WHEN customer_parent <> '' THEN customer_parent ELSE customer_code END AS chain,
  regexp_replace(upper(customer_name), '[^A-Z0-9]', '', 'g') AS name, sor_no FROM so WHERE coalesce(customer_name, '') <> '') GROUP BY 1, 2"""
)
def chain_store_names(spark, d):
    """Each chain's store names in letters and digits, a row a name, with its orders and how many names the chain has; orders without a name left out."""
    chain = F.coalesce(F.nullif("customer_parent", F.lit("")), "customer_code")
    so = headers(spark, d).filter("coalesce(customer_name, '') <> ''").select(chain.alias("chain"), flat(F.col("customer_name")).alias("name"), "sor_no")
    each = so.groupBy("chain", "name").agg(F.count_distinct("sor_no").alias("n"))
    return each.join(each.groupBy("chain").agg(F.count("*").alias("names")), "chain").select("chain", "name", "n", "names")


@query(
    """SELECT sor_no, name, x.value AS value, x.page_no AS page_no, x.own AS own, asked FROM (SELECT sor_no, name, max({'page_no': page_no, 'own': v.own, 'value': v.value}) FILTER (NOT none AND v IS NOT NULL) AS x, bool_or(asked) AS asked FROM vp GROUP BY 1, 2) WHERE x IS NOT NULL""",
    """fd AS (SELECT k, sor_no, k AS batch_id, p AS page_no, name, CASE name WHEN 'total' THEN CASE WHEN (k + p) % 4 = 0 THEN NULL WHEN (k + p) % 4 = 1 THEN '' WHEN (k + p) % 9 = 2 THEN '(not printed)' ELSE (k * 10 + p)::VARCHAR END ELSE CASE WHEN (k + p) % 3 = 0 THEN 'n' || (k + p) END END AS value,
  p = 1 OR k % 5 = 0 AS own, (k + p) % 7 < 3 AS asked FROM so, range(1, 4) AS x(p), (VALUES ('total'), ('number')) AS y(name))""",
    """vp AS (SELECT sor_no, name, page_no, bool_or(own AND value = '(not printed)') FILTER (value <> '') AS none, max({'own': own, 'value': value}) FILTER (value <> '') AS v, bool_or(page_no = 1 AND asked) AS asked FROM fd WHERE page_no <= 2 + k % 2 GROUP BY 1, 2, 3)""",
)
def paper_values(spark, d):
    """Each paper's total and number as read, from its last page that has one; a page that prints none, as a person said, is passed over."""
    so = headers(spark, d).select("k", "sor_no")
    spans = so.select("sor_no", F.col("k").alias("batch_id"), F.lit(1).alias("page_from"), (F.col("k") % 2 + 2).cast("int").alias("page_to"))
    f = so.withColumn("page_no", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("name", F.explode(F.array(F.lit("total"), F.lit("number"))))
    at = F.col("k") + F.col("page_no")
    total = F.when(at % 4 == 0, None).when(at % 4 == 1, "").when(at % 9 == 2, "(not printed)").otherwise((F.col("k") * 10 + F.col("page_no")).cast("string"))
    value = F.when(F.col("name") == "total", total).when(at % 3 == 0, F.concat(F.lit("n"), at.cast("string")))
    fields = f.select(F.col("k").alias("batch_id"), "page_no", "name", value.alias("value"), ((F.col("page_no") == 1) | (F.col("k") % 5 == 0)).alias("own"), (at % 7 < 3).alias("asked"))
    return totals.last_read(spans, fields, ["sor_no"])
