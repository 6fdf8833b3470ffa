"""From pages in scan order to documents, and from documents to the orders they belong to.

The functions take the columns of ``sources.paperwork.pages`` and keep a page or document that fits nowhere, with the reason as its hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.printed import sor_key
from ledgerline.functions.text import flat
from ledgerline.operators.written import written


def documents(pages: DataFrame) -> DataFrame:
    """(batch_id, page_from, page_to, doc_type, sor, po_no, key_by, hold), and bill where pages have it: a document a start page with the pages that continue it.

    A page continues the one before it if its type is settled and CONTINUATION and that page is there, whatever that one is. Holds: not_read (no type state), type_unknown
    (not decided or labelled), continuation_without_start, later_stage (PEL), not_grouped (any other type). Page numbers repeat in no scan.
    """
    order = Window.partitionBy("batch_id").orderBy("page_no")
    settled = F.coalesce(F.col("type_status").isin("decided", "labelled"), F.lit(False))
    follows = settled & (F.col("doc_type") == "CONTINUATION")
    joined = follows & F.coalesce(F.lag("page_no").over(order) == F.col("page_no") - 1, F.lit(False))
    hold = (
        F.when(F.col("type_status").isNull(), "not_read").when(~settled, "type_unknown").when(F.col("doc_type") == "CONTINUATION", "continuation_without_start")
        .when(F.col("doc_type").isin("FP", "PO", "TTG", "FPJ"), None).when(F.col("doc_type") == "PEL", "later_stage").otherwise("not_grouped")
    )
    more = [c for c in ("bill",) if c in pages.columns]
    # a document ends at the page before the next start, the last one with its scan: one sort serves all
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = pages.select("batch_id", "page_no", "doc_type", "sor", "po_no", "key_by", hold.alias("hold"), *more, joined.alias("joined"), F.struct(F.lag("page_no").over(order).alias("no")).alias("before"), F.max("page_no").over(whole).alias("last"))
    starts = p.filter("not joined").withColumn("next", F.lead("before").over(order))
    return starts.select("batch_id", F.col("page_no").alias("page_from"), F.when(F.col("next").isNull(), F.col("last")).otherwise(F.col("next.no")).alias("page_to"), "doc_type", "sor", "po_no", "key_by", "hold", *more)


#: An order number, and a billing number that stands alone, in what a tax invoice prints.
ORDER, BILL = r"(SO[RF]\d{11})", r"(?:^|[^0-9])([0-9]{10})(?:[^0-9]|$)"
#: Edits within which an order is suggested for a paper whose number was misread.
NEAR = 3


def _parts(*flats: Column) -> tuple[Column, Column]:
    """The distinct order numbers and billing numbers in what a tax invoice prints, letters and digits only, whichever field they were read into."""
    some = lambda *c: F.array_distinct(F.filter(F.array(*c), lambda x: x != ""))
    return some(*(F.regexp_extract(f, ORDER, 1) for f in flats)), some(*(F.regexp_extract(F.regexp_replace(f, ORDER, "|"), BILL, 1) for f in flats))


def linked(docs: DataFrame, so: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with order_no, linked_by and hold: the order each document belongs to; ``keep``: columns of docs that come along.

    A key counts if it was read and confirmed (key_by). An FP is its order's hub by its own number: without one fp_sor_unresolved, two of one order in a scan two_fps_one_sor. A PO or
    TTG goes by the order number it prints and by the orders whose purchase number it prints, in the record or on a hub of its scan: several of these po_matches_several_sos, no confirmed key
    no_resolved_key, none found so_unknown, two that differ keys_disagree. An FPJ needs its order's number and its billing number (column bill, if there is one), and the record must have the
    two together: no_resolved_key, keys_disagree, fpj_needs_both, so_unknown, needs_sap_billing, billing_disagrees. Order numbers count without regard to how they are spelt. Documents held before stay so.
    """
    kept = docs if "bill" in docs.columns else docs.withColumn("bill", F.lit(None).cast("string"))
    kept = kept.select("*", *(F.when(F.col("key_by").isNotNull(), flat(F.col(c))).otherwise("").alias(f"flat {c}") for c in ("sor", "po_no", "bill")))  # once each, and not where no key counts
    sor, bill, tax = F.col("flat sor"), F.col("flat bill"), F.col("doc_type") == "FPJ"
    bare = F.when((F.length(sor) == 11) & sor.rlike("^[0-9]{11}$"), F.concat(F.lit("SOR"), sor)).otherwise(sor)  # sor_key of what is flat already
    orders, bills = (F.when(tax, c).otherwise(F.array().cast("array<string>")) for c in _parts(sor, bill))
    d = kept.withColumn("own", F.when(sor != "", bare)).withColumn("po", F.nullif("flat po_no", F.lit(""))).withColumn("orders", orders).withColumn("bills", bills)
    d = d.withColumn("billed too", bill != "").drop("flat sor", "flat po_no", "flat bill", *(c for c in ("sor", "po_no", "bill", "key_by") if c not in keep))
    d = written(d, "documents")  # several joins read it
    free = F.col("hold").isNull()
    at = ["batch_id", "page_from"]
    fps = d.filter(free & (F.col("doc_type") == "FP") & F.col("own").isNotNull()).select(*at, "own", "po").withColumn("n_fp", F.count("*").over(Window.partitionBy("batch_id", "own")))
    ends = lambda df, *by: df.groupBy(*by).agg(F.min("to").alias("lo"), F.max("to").alias("hi"))  # noqa: E731  several orders differ in these
    numbers = ends(so.filter("cpo_no is not null").select(flat(F.col("cpo_no")).alias("po"), sor_key(F.col("sor_no")).alias("to")), "po")
    asked = d.filter(free & F.col("doc_type").isin("PO", "TTG") & F.col("po").isNotNull()).select(*at, "po")
    printed = ends(fps.filter("n_fp = 1 and po is not null").select("batch_id", "po", F.col("own").alias("to")), "batch_id", "po")
    met = asked.join(numbers, "po").select(*at, "lo", "hi").unionByName(asked.join(printed, ["batch_id", "po"]).select(*at, "lo", "hi"))
    told = met.withColumn("n_fp", F.lit(None).cast("long")).unionByName(fps.filter("n_fp > 1").select(*at, F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"), "n_fp"))
    hits = told.groupBy(*at).agg(F.max("n_fp").alias("n_fp"), (F.min("lo") < F.max("hi")).alias("several"), F.min("lo").alias("by_po"))
    billed = F.nullif(flat(F.col("billing_no")), F.lit("")) if "billing_no" in so.columns else F.lit(None).cast("string")
    record = so.select(sor_key(F.col("sor_no")).alias("of"), billed.alias("billed"), F.lit(True).alias("there"))
    invoices = d.filter(free & (F.col("doc_type") == "FPJ") & (F.size("orders") == 1)).select("batch_id", "page_from", F.col("orders")[0].alias("of")).join(record, "of").drop("of")
    all_ = d.join(hits, ["batch_id", "page_from"], "left").join(invoices, ["batch_id", "page_from"], "left")
    fp, other, tax = F.col("doc_type") == "FP", F.col("doc_type").isin("PO", "TTG"), F.col("doc_type") == "FPJ"
    n_orders, n_bills = F.size("orders"), F.size("bills")
    why = (
        F.when(~free, F.col("hold")).when(fp & F.col("own").isNull(), "fp_sor_unresolved").when(fp & (F.col("n_fp") > 1), "two_fps_one_sor").when(other & F.col("several"), "po_matches_several_sos")
        .when(other & F.col("own").isNull() & F.col("po").isNull(), "no_resolved_key").when(other & F.col("own").isNull() & F.col("by_po").isNull(), "so_unknown").when(other & (F.col("own") != F.col("by_po")), "keys_disagree")
        .when(tax & F.col("own").isNull() & ~F.col("billed too"), "no_resolved_key").when(tax & ((n_orders > 1) | (n_bills > 1)), "keys_disagree").when(tax & ((n_orders == 0) | (n_bills == 0)), "fpj_needs_both")
        .when(tax & F.col("there").isNull(), "so_unknown").when(tax & F.col("billed").isNull(), "needs_sap_billing").when(tax & (F.col("billed") != F.col("bills")[0]), "billing_disagrees")
    )
    by = F.when(tax, "billing_no").when(F.col("own").isNotNull(), "sor").otherwise("po_no")
    order_no = F.when(F.col("why").isNull(), F.when(tax, F.col("orders")[0]).otherwise(F.coalesce("own", "by_po")))
    return all_.withColumn("why", why).select("batch_id", "page_from", "page_to", "doc_type", order_no.alias("order_no"), F.when(F.col("why").isNull(), by).alias("linked_by"), F.col("why").alias("hold"), *keep)


def suggested(docs: DataFrame, links: DataFrame, so: DataFrame) -> DataFrame:
    """(batch_id, page_from, suggest, edits): for each FP whose number isn't resolved, the one order of its scan that has papers but no FP and is nearest to what was read, its order number or its purchase number, within NEAR edits; null if none or two are.

    Within so few edits one of four pieces of what was read stands unchanged in the order's number: papers and orders of a scan meet by such pieces.
    """
    orphans = links.filter("order_no is not null").groupBy("batch_id", "order_no").agg(F.count_if(F.col("doc_type") == "FP").alias("fps")).filter("fps = 0").select("batch_id", "order_no")
    asked = links.filter("hold = 'fp_sor_unresolved'")
    if "sor" not in links.columns:  # not kept by ``linked``
        asked = asked.select("batch_id", "page_from").join(docs.select("batch_id", "page_from", "sor", "po_no"), ["batch_id", "page_from"])
    cpo = so.select(sor_key(F.col("sor_no")).alias("order_no"), flat(F.col("cpo_no")).alias("cpo"))
    known = orphans.join(cpo, "order_no", "left")

    def pieces(c: Column) -> Column:
        """Up to four letters at the start of each quarter."""
        n = F.length(c)
        cut = lambda i: F.floor(n * i / (NEAR + 1)).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(NEAR)), lambda i: F.substring(c, cut(i) + 1, F.least(F.lit(4), cut(i + 1) - cut(i)))))

    def substrings(c: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.substring(c, i, k)))))

    near = []
    for mine, theirs in ((F.coalesce(sor_key(F.col("sor")), F.lit("")), F.col("order_no")), (flat(F.col("po_no")), F.coalesce("cpo", F.lit("")))):
        left = asked.withColumn("mine", mine).filter(F.length("mine") > NEAR).select("batch_id", "page_from", "mine", F.explode(pieces(F.col("mine"))).alias("piece"))
        right = known.withColumn("theirs", theirs).filter("theirs <> ''").select("batch_id", "order_no", "theirs", F.explode(substrings(F.col("theirs"))).alias("piece"))
        near.append(left.join(right, ["batch_id", "piece"]).select("batch_id", "page_from", "order_no", F.levenshtein("mine", "theirs").alias("edits")).filter(F.col("edits") <= NEAR))
    best = near[0].union(near[1]).groupBy("batch_id", "page_from", "order_no").agg(F.min("edits").alias("edits"))
    least = best.withColumn("least", F.min("edits").over(Window.partitionBy("batch_id", "page_from"))).filter("edits = least")
    one = least.groupBy("batch_id", "page_from").agg(F.count("*").alias("n"), F.min("order_no").alias("suggest"), F.min("edits").alias("edits")).filter("n = 1").drop("n")
    return asked.select("batch_id", "page_from").join(one, ["batch_id", "page_from"], "left")


def bundles(docs: DataFrame) -> DataFrame:
    """(order_no, n_documents, n_scans, hold): an order's documents over all scans. Without an FP fp_missing, with several two_fps_one_sor."""
    fps = F.count_if(F.col("doc_type") == "FP")
    b = docs.filter("order_no is not null").groupBy("order_no").agg(F.count("*").alias("n_documents"), F.count_distinct("batch_id").alias("n_scans"), fps.alias("fps"))
    return b.select("order_no", "n_documents", "n_scans", F.when(F.col("fps") == 0, "fp_missing").when(F.col("fps") > 1, "two_fps_one_sor").alias("hold"))


def pages_of(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page with the document that spans it: the spans become page numbers, so the join is on equality."""
    spans = docs.select("*", F.explode(F.sequence("page_from", "page_to")).alias("page_no"))
    return pages.join(spans, ["batch_id", "page_no"])
