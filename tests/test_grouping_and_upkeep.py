"""Linking by invoices and billing numbers, suggestions, order prints, deletes and readings on small made cases."""

from pyspark.sql import functions as F

from ledgerline.operators import grouping, keys, upkeep

DOCS = "batch_id long, page_from int, page_to int, doc_type string, sor string, po_no string, key_by string, hold string, bill string"
A, B, C = "SOR00000000001", "SOR00000000002", "SOR00000000003"


def test_links(spark):
    docs = [
        (1, 1, 1, "FP", "sor 0000-0000001", "PO 9", "qr", None, None), (1, 2, 2, "PO", None, "po9", "text", None, None), (1, 3, 3, "TTG", "00000000002", "po9", "text", None, None), (2, 1, 1, "PO", None, "PO9", "text", None, None),
        (1, 4, 4, "FPJ", None, None, "text", None, f"7000000001/{A}"), (1, 5, 5, "FPJ", A, None, "text", None, "7000000002"), (1, 6, 6, "FPJ", A, None, "text", None, None), (1, 7, 7, "FPJ", A, None, None, None, "7000000001"),
        (1, 8, 8, "FPJ", B, None, "text", None, f"{A} 7000000001"), (1, 9, 9, "FPJ", B, None, "text", None, "7000000001"), (1, 10, 10, "FPJ", "SOR00000000009", None, "text", None, "7000000001"), (3, 1, 1, "PO", None, "555", "text", None, None), (3, 2, 2, "TTG", None, None, None, "not_read", None),
    ]
    so = spark.createDataFrame([(A, None, "7000000001"), (B, "555", None), (C, "555", "")], "sor_no string, cpo_no string, billing_no string")
    found = {(r.batch_id, r.page_from): (r.order_no, r.linked_by, r.hold) for r in grouping.linked(spark.createDataFrame(docs, DOCS), so).collect()}
    assert found == {
        (1, 1): (A, "sor", None), (1, 2): (A, "po_no", None), (1, 3): (None, None, "keys_disagree"), (2, 1): (None, None, "so_unknown"), (1, 4): (A, "billing_no", None), (1, 5): (None, None, "billing_disagrees"), (1, 6): (None, None, "fpj_needs_both"),
        (1, 7): (None, None, "no_resolved_key"), (1, 8): (None, None, "keys_disagree"), (1, 9): (None, None, "needs_sap_billing"), (1, 10): (None, None, "so_unknown"), (3, 1): (None, None, "po_matches_several_sos"), (3, 2): (None, None, "not_read"),
    }
    assert grouping.linked(spark.createDataFrame([], DOCS), so).count() == 0


def test_suggestions(spark):
    docs = [(1, 1, 1, "FP", "SOR00000010011", None, None, None, None), (1, 2, 2, "FP", None, "4411", None, None, None), (1, 3, 3, "FP", "SOR99999999999", None, None, None, None), (1, 4, 4, "TTG", A, None, "text", None, None), (1, 5, 5, "TTG", B, None, "text", None, None), (1, 6, 6, "FP", C, None, "text", None, None)]
    so = spark.createDataFrame([(A, None, None), (B, "4412", None), (C, None, None)], "sor_no string, cpo_no string, billing_no string")
    d = spark.createDataFrame(docs, DOCS)
    found = {r.page_from: (r.suggest, r.edits) for r in grouping.suggested(d, grouping.linked(d, so), so).collect()}
    assert found == {1: (A, 2), 2: (B, 1), 3: (None, None)}


def test_prints_notice_any_change(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, ""), ("b", 2, "x")], "k string, n int, v string")
    of = lambda df: {r.k: r["print"] for r in upkeep.fingerprints({"rows": df}, "k").collect()}
    assert of(rows) == of(rows.orderBy(F.desc("n"))) != of(rows.withColumn("v", F.coalesce("v", F.lit(""))))


def test_deletes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, None)], "batch_id long, order_no string")
    orders = spark.createDataFrame([("a", "reviewed"), ("b", "reviewed"), ("c", "auto_ok")], "order_no string, status string")
    files = spark.createDataFrame([("u", 1), ("v", 2), ("w", 3)], "upload string, batch_id long")
    none = docs.select("batch_id").filter("false")
    found = {r.upload: tuple(r)[1:] for r in upkeep.impact(files, docs.select("batch_id"), docs, orders, none, none).collect()}
    assert found == {"u": (1, 2, 1, 1, 2, 0, 0), "v": (1, 2, 0, 1, 1, 0, 0), "w": (1, 0, 0, 0, 0, 0, 0)}
    left, after = upkeep.without(docs, orders, files.filter("upload = 'u'").select("batch_id"))
    assert left.count() == 2 and {tuple(r) for r in after.collect()} == {("a", "grouping"), ("c", "auto_ok")}


def test_readings_and_amounts(spark):
    cells = "p int, row int, name string, value string"
    a, b = spark.createDataFrame([(1, 1, "x", "1"), (1, 2, "x", None)], cells), spark.createDataFrame([(1, 1, "x", "2"), (2, 1, "x", "3")], cells)
    assert {tuple(r) for r in upkeep.flips(a, b, ["p"], "row").collect()} == {(1, 1, 1), (2, 1, 1)}
    f = spark.createDataFrame([("amount", "1", "2.000,5", None), ("amount", "2000.50", "2.000,5", "1"), ("amount", "1", "x", None), ("id", "1", "2", None)], "kind string, value string, source string, read string")
    once = upkeep.normal_amounts(f)
    assert [tuple(r) for r in once.collect()] == [tuple(r) for r in upkeep.normal_amounts(once).collect()] == [("amount", "2000.50", "2.000,5", "1"), ("amount", "2000.50", "2.000,5", "1"), ("amount", "1", "x", None), ("id", "1", "2", None)]


def test_places_of_a_key_over_many_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 3 % 2).alias("k"), (F.col("id") * 37 % 500).alias("n"), F.col("id"))
    found = keys.ranked(rows.withColumn("k", F.when(F.col("k") > 0, 1)), ["k"], ["n"], "place").collect()
    for k in (None, 1):
        assert [r.n for r in sorted((r for r in found if r.k == k), key=lambda r: r.place)] == sorted(r.n for r in found if r.k == k)
        assert sorted(r.place for r in found if r.k == k) == list(range(1, sum(r.k == k for r in found) + 1))
    assert sorted(r.place for r in keys.ranked(rows, [], ["n"], "place").collect()) == list(range(1, 501))


def test_readings_are_dealt_once(spark):
    from ledgerline.operators import upkeep

    a = [(1, 1, "x", "p"), (1, 1, "y", "q"), (1, 2, "x", None), (2, 1, "x", "p"), (2, None, "x", "p"), (None, 1, "x", "p")]
    b = [(1, 1, "x", "p"), (1, 1, "y", "r"), (2, 1, "x", "p"), (2, 3, "x", "p"), (2, None, "x", "p"), (3, 1, "x", None), (3, 1, "y", "s"), (None, 1, "x", "p")]
    df = lambda rows: spark.createDataFrame(rows, "k int, row int, name string, value string")
    out = upkeep.flips(df(a), df(b), ["k"], "row")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: (r.cells, r.rows) for r in out.collect()} == {1: (1, 1), 2: (3, 1), 3: (1, 1), None: (2, 0)}
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_take_one_sort_and_no_sums(spark):
    kind = "batch_id long, page_no int, doc_type string, type_status string, sor string, po_no string, key_by string"
    pages = [(1, 1, "FP"), (1, 2, "CONTINUATION"), (1, 3, "CONTINUATION"), (1, 5, "CONTINUATION"), (1, 6, "PO"), (2, 4, "CONTINUATION"), (3, None, "FP"), (3, 1, "PO"), (3, 2, "CONTINUATION")]
    p = spark.createDataFrame([(b, n, t, "decided", None, None, None) for b, n, t in pages], kind)
    docs = grouping.documents(p)
    plan = plan_of(docs)  # before it runs, when it has the final plan as well
    assert sorted((tuple(r)[:4] for r in docs.collect()), key=str) == sorted([(1, 1, 3, "FP"), (1, 5, 5, "CONTINUATION"), (1, 6, 6, "PO"), (2, 4, 4, "CONTINUATION"), (3, None, None, "FP"), (3, 1, 2, "PO")], key=str)
    assert "Aggregate" not in plan and plan.count("Sort [") == 1


def test_links_keep_what_suggestions_ask(spark):
    docs = spark.createDataFrame([(1, 1, 1, "FP", None, "P1234567", "qr", None), (1, 2, 2, "PO", "S1", "P1234568", "qr", None)], "batch_id long, page_from int, page_to int, doc_type string, sor string, po_no string, key_by string, hold string")
    so = spark.createDataFrame([("S1", "P1234568")], "sor_no string, cpo_no string")
    links = grouping.linked(docs, so, keep=("sor", "po_no"))
    assert [tuple(r) for r in grouping.suggested(links, links, so).collect()] == [tuple(r) for r in grouping.suggested(docs, grouping.linked(docs, so), so).collect()] == [(1, 1, "S1", 1)]


def test_an_upload_is_counted_without_meeting_every_page(spark):
    docs = spark.createDataFrame([(1, "A"), (1, "A"), (2, "A"), (3, "B"), (3, None)], "batch_id long, order_no string")
    files = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 4)], "upload long, batch_id long")
    pages = spark.createDataFrame([(1,), (1,), (2,), (3,)], "batch_id long")
    orders = spark.createDataFrame([("A", "reviewed"), ("B", "auto_ok")], "order_no string, status string")
    got = upkeep.impact(files, pages, docs, orders, pages.limit(1), pages.filter("batch_id = 3"))
    assert plan_of(got).count("Join") == 4  # files meet what is counted once, not once a kind
    assert sorted(tuple(r) for r in got.collect()) == [(7, 2, 3, 1, 0, 1, 1, 0), (8, 1, 1, 1, 0, 0, 0, 1), (9, 1, 0, 0, 0, 0, 0, 0)]
    left, kept = upkeep.without(docs, orders, files.filter("upload = 8").select("batch_id"))
    assert sorted(tuple(r) for r in kept.collect()) == [("A", "reviewed")] and left.count() == 3


def test_amounts_as_printed_are_dealt_and_keep_their_text(spark):
    from ledgerline.functions.text import to_hundredth
    from ledgerline.plans import catalogue

    numbers = [0.0, 0.005, 0.015, 1.005, 2.675, 1234567.125, 0.0004, 99999999999.995, 9e14, 1e15, 1.5e22, None]
    both = spark.createDataFrame([(x,) for x in numbers], "x double").select(to_hundredth(F.col("x")), F.format_string("%.2f", "x"))
    assert all(a == b for (a, b), x in zip([tuple(r) for r in both.collect()], numbers, strict=True) if x is not None)
    plan = catalogue.QUERIES["amounts_as_printed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1 and plan.count("FORMAT_STRING") + plan.count("format_string") <= 1
