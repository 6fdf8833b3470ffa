"""What purchase orders print against the order as placed: totals, tax, and rows where a total can't be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.printed import NOT_PRINTED
from ledgerline.operators.settle import ROUNDING, SLACK, readings, told
from ledgerline.operators.written import written


def last_read(spans: DataFrame, fields: DataFrame, key: list[str]) -> DataFrame:
    """(key, name, value, page_no, own, asked): each document's value as read, from the last of its pages that has one.

    ``spans`` (key, batch_id, page_from, page_to), ``fields`` (batch_id, page_no, name, value, own, asked): own says that the page is of the document's own type; asked, taken from the
    document's first page, that it was looked at again. On one page the type's own field comes first; NOT_PRINTED means that the page has none. A document without any value of a name has no row for it.
    A page belongs to one document of a scan, so documents meet their pages by scan and number.
    """
    pages = spans.select(*key, "batch_id", "page_from", F.explode(F.sequence("page_from", "page_to")).alias("page_no"))
    asked, read = F.coalesce("asked", F.lit(False)), F.coalesce(F.col("value") != "", F.lit(False))
    some = fields.select("batch_id", "page_no", "name", F.when(read, F.col("value")).alias("value"), F.coalesce("own", F.lit(False)).alias("own"), asked.alias("asked")).filter("value is not null or asked")  # others say nothing
    met = pages.join(some, ["batch_id", "page_no"]).withColumn("asked", F.col("asked") & (F.col("page_no") == F.col("page_from"))).filter("value is not null or asked")
    met = met.select(*key, "name", "page_no", "own", "value", "asked").repartition(*key)  # a page's and a document's values are told by one sort
    page = met.groupBy(*key, "name", "page_no").agg(F.bool_or(F.col("own") & (F.col("value") == NOT_PRINTED)).alias("none"), F.max(F.when(F.col("value").isNotNull(), F.struct("own", "value"))).alias("v"), F.bool_or("asked").alias("asked"))
    shown = F.when(~F.coalesce("none", F.lit(False)) & F.col("v").isNotNull(), F.struct("page_no", "v"))
    last = page.groupBy(*key, "name").agg(F.max(shown).alias("l"), F.bool_or("asked").alias("asked")).filter("l is not null")
    return last.select(*key, "name", F.col("l.v.value").alias("value"), F.col("l.page_no").alias("page_no"), F.col("l.v.own").alias("own"), "asked")


def rows_hold_lines(rows: DataFrame, lines: DataFrame, allow: float = ROUNDING) -> DataFrame:
    """(sor_no, missing, gap): the order's lines that no printed amount of the papers' rows is, within ``allow``, and the largest distance of a line to the nearest amount still free.

    ``rows`` (sor_no, page_no, row_no, amounts), ``lines`` (sor_no, line_no, line_amount, vat). Lines take amounts one after another, each the nearest, net or with tax, that none before took; so two equal lines need
    an amount printed twice. Lines without an amount need none. gap is null where nothing is printed. An order's amounts and lines are folded in one row: they are one order's papers. Orders without such lines give no row.
    """
    pool = rows.select("sor_no", F.posexplode("amounts").alias("at", "a"), "page_no", "row_no").filter("a is not null")
    pools = pool.groupBy("sor_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "row_no", "at", F.col("a").cast("double").alias("a")))).alias("pool"))
    net = F.col("line_amount").cast("double")
    wants = lines.filter(net > 0).groupBy("sor_no").agg(F.array_sort(F.collect_list(F.struct("line_no", net.alias("net"), F.round(net + F.coalesce(F.col("vat").cast("double"), F.lit(0.0)), 2).alias("gross")))).alias("wants"))
    kind = "array<struct<k:int,a:double>>"
    both = wants.join(pools, "sor_no", "left").withColumn("pool", F.coalesce(F.transform("pool", lambda x, i: F.struct(i.alias("k"), x["a"].alias("a"))), F.array().cast(kind)))

    def step(state: Column, line: Column) -> Column:
        near = lambda x: F.least(F.abs(x["a"] - line["net"]), F.abs(x["a"] - line["gross"]))
        nearest = F.array_min(F.transform(state["pool"], lambda x: F.struct(near(x).alias("gap"), x["k"].alias("k"))))

        def taken(best: Column) -> Column:
            hit = F.coalesce(best["gap"] <= allow + SLACK, F.lit(False))
            return F.struct(
                F.when(hit, F.filter(state["pool"], lambda x: x["k"] != best["k"])).otherwise(state["pool"]).alias("pool"),
                F.when(hit, state["missing"]).otherwise(F.array_append(state["missing"], line["line_no"])).alias("missing"),
                F.when(best.isNotNull(), F.greatest(state["gap"], best["gap"])).otherwise(state["gap"]).alias("gap"),
            )

        return F.get(F.transform(F.array(nearest), taken), F.lit(0))  # looked for once a line, not for each amount that is left

    start = F.struct(F.col("pool").alias("pool"), F.array().cast("array<int>").alias("missing"), F.lit(None).cast("double").alias("gap"))
    return both.select("sor_no", F.aggregate("wants", start, step).alias("s")).select("sor_no", "s.missing", (F.floor(F.col("s.gap") * 100 + 0.5) / 100.0).alias("gap"))


def order_side(docs: DataFrame, rows: DataFrame, orders: DataFrame, lines: DataFrame, allow: float = ROUNDING) -> DataFrame:
    """(sor_no, status, by, got, ref, n_missing, gap): an order's purchase papers against the order as placed.

    ``docs`` (sor_no, total, cut, printed, asked, second, ppn, ppn_cut, ppn_printed, ppn_asked, ppn_second), a row a paper; ``orders`` (sor_no, order_dpp, order_ppn, order_total). If every paper has a total, read in full, their sum decides against the order's
    total or its base before tax, and, where every paper has a tax, that sum against the order's tax too (by = total, or tax if that is what fails). Else, one paper without a total or with a cut one
    being enough, the rows decide (by = rows): pass if every line is among their amounts; if not, ask while a paper that has no total has not been looked at again, else unknown.
    """
    full = lambda c, cut: F.bool_and(F.col(c).isNotNull() & ~F.coalesce(cut, F.lit(False)))
    refs = ["order_dpp", "order_total", "order_ppn"]
    known = orders.select("sor_no", *refs, F.lit(True).alias("known"))  # papers and their order go where the order's sums are taken, once
    papers = docs.select("sor_no", "total", "cut", "printed", "asked", "second", "ppn", "ppn_cut", "ppn_printed", "ppn_asked", "ppn_second").join(known, "sor_no")
    sums = papers.groupBy("sor_no").agg(
        *readings("total"), *readings("ppn", "ppn_printed", "ppn_asked", "ppn_second", "tax "), *[F.max(r).alias(r) for r in refs],
        full("total", "cut").alias("usable"), full("ppn", "ppn_cut").alias("taxed"), F.bool_or(F.col("total").isNull() & ~F.coalesce("asked", F.lit(False))).alias("open"),
    )
    one = told(told(sums, ["order_dpp", "order_total"], allow), ["order_ppn"], allow, "tax ")
    tax_fails = (F.col("status") == "pass") & F.coalesce(F.col("taxed") & (F.col("tax status") != "pass"), F.lit(False))
    status = F.when(tax_fails, F.col("tax status")).otherwise(F.col("status")).alias("status")
    one = written(one.select("sor_no", "usable", "open", status, F.when(tax_fails, "tax").otherwise("total").alias("by"), "got", "ref"), "order-sums")  # read where rows, lines and the result ask for it
    rest = one.filter("not usable").select("sor_no")
    held = rows_hold_lines(rows.join(rest, "sor_no", "left_semi"), lines.join(rest, "sor_no", "left_semi"), allow)
    n = F.coalesce(F.size("missing"), F.lit(0))
    by_rows = F.when(n == 0, "pass").when(F.col("open"), "ask").otherwise("unknown")
    summed = lambda c: F.when(F.col("usable"), F.col(c))
    return one.join(held, "sor_no", "left").select("sor_no", summed("status").otherwise(by_rows).alias("status"), summed("by").otherwise("rows").alias("by"), summed("got").alias("got"), summed("ref").alias("ref"), F.when(~F.col("usable"), n).alias("n_missing"), "gap")
