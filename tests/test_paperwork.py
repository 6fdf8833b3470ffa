"""Edge cases of reading and settling paper, with invented values."""

import datetime
import itertools

from pyspark.sql import functions as F

from ledgerline.functions import printed
from ledgerline.functions.stats import medians, nearest_rank, ranked_values
from ledgerline.operators import grouping, settle
from ledgerline.operators.keys import global_rank


def answers(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column(F.col("t")).alias("got"))
    return [r.got for r in sorted(df.collect())]


def test_packs_and_numbers(spark):
    assert answers(spark, ["CTN/72", "24 / EA", "1x6", "2 X 12 pcs", "(not printed)", "none", "", None], lambda t: printed.pack(t).cast("double")) == [72, 24, 6, 12, None, None, None, None]
    assert answers(spark, ["Rp 1.234,5", "5 of 6", None], lambda t: printed.typed_number(t).cast("double")) == [1234.5, 5, None]


def test_pieces(spark):
    df = spark.createDataFrame([("3 CTN", "PCS", 36.0), ("3", "karton", 36.0), ("3 PCS", "CTN", 3.0), ("1 x 48", "", None), ("2 3", "", None), (None, None, None)], "q string, u string, want double")
    for r in df.withColumn("got", printed.pieces(df.q, df.u, F.lit(12.0))).collect():
        assert r.got == r.want, r


def test_misreadings_are_one_change(spark):
    found = answers(spark, ["157", "", None], printed.alternatives)
    assert set(found[0]) == {"757", "167", "187", "1S7", "1$7", "1R7", "151", "57", "17", "15", "1157", "1557", "1577"} and found[1] == [] and found[2] == []


def test_days(spark):
    assert answers(spark, ["17 Agustus 26", "5-Oct-2026", "31 Feb 2026", "x", None], printed.named_day) == [datetime.date(2026, 8, 17), datetime.date(2026, 10, 5), None, None, None]


def test_fits(spark):
    df = spark.createDataFrame([(100000.0, 100000.0, 11000.0, True), (111020.0, 100000.0, 11000.0, True), (100180.0, 100000.0, 11000.0, False), (0.0, 0.0, None, False), (None, 5.0, None, False)], "p double, net double, vat double, want boolean")
    for r in df.withColumn("got", printed.amount_fits(df.p, df.net, df.vat)).collect():
        assert r.got == r.want, r


READ = "k string, num decimal(18,2), printed boolean, asked boolean, second decimal(18,2), total decimal(18,2), dpp decimal(18,2)"


def reads(spark, rows):
    from decimal import Decimal as D

    rows = [(k, D(n), p, a, None if s is None else D(s), D(t), None if b is None else D(b)) for k, n, p, a, s, t, b in rows]
    return {r.k: (r.status, r.ref) for r in settle.settle(spark.createDataFrame(rows, READ), ["k"], ["total", "dpp"]).collect()}


def test_settle(spark):
    got = reads(spark, [
        ("near", 111500, True, False, None, 111000, 100000), ("base", 100000, True, False, None, 111000, 100000), ("off", 120000, True, False, None, 111000, None),
        ("ask", 120000, False, False, None, 111000, None), ("second", 120000, False, True, 111000, 111000, None), ("still", 120000, False, True, 130000, 111000, None),
        ("two", 60000, True, False, None, 113500, None), ("two", 52000, True, False, None, 113500, None), ("edge", 112000, True, False, None, 111000, None),
    ])
    assert got == {"near": ("pass", "total"), "base": ("pass", "dpp"), "off": ("fail", None), "ask": ("ask", None), "second": ("pass", "total"), "still": ("unknown", None), "two": ("pass", "total"), "edge": ("pass", "total")}


def test_unread_numbers_stay_apart(spark):
    docs = spark.createDataFrame([(1, "PO-1"), (2, "po 1"), (3, None), (4, ""), (5, None)], "page_no int, number string").withColumn("b", F.lit(1))
    assert sorted(r.page_no for r in settle.distinct_documents(docs, "number", ["b"], F.col("page_no")).collect()) == [1, 3, 4, 5]


PAGE = "batch_id long, page_no int, doc_type string, type_status string, sor string, po_no string, key_by string"


def test_documents_and_links(spark):
    pages = [
        (1, 1, "FP", "decided", "SOR1", None, "print"), (1, 2, "CONTINUATION", "decided", None, None, None), (1, 4, "CONTINUATION", "decided", None, None, None), (1, 5, "PO", "decided", None, "7", "print"),
        (1, 6, "TTG", "decided", "SOR2", "7", "qr"), (1, 7, "PEL", "decided", None, None, None), (1, 8, "PO", None, None, None, None), (1, 9, "PO", "decided", None, "9", None), (1, 10, "PO", "decided", None, "8", "print"),
        (2, 1, "FP", "labelled", "SOR3", None, "qr"), (2, 2, "FP", "decided", "SOR3", None, "qr"), (2, 3, "TTG", "decided", "SOR1", None, "qr"), (2, 4, "PO", "decided", None, "6", "print"),
    ]
    so = spark.createDataFrame([("SOR1", "7"), ("SOR4", "8"), ("SOR5", "8")], "sor_no string, cpo_no string")
    docs = grouping.documents(spark.createDataFrame(pages, PAGE))
    assert {(r.batch_id, r.page_from, r.page_to) for r in docs.collect()} >= {(1, 1, 2), (1, 4, 4), (2, 3, 3)}
    linked = grouping.linked(docs, so).cache()
    got = {(r.batch_id, r.page_from): (r.order_no, r.hold) for r in linked.collect()}
    assert got == {
        (1, 1): ("SOR1", None), (1, 4): (None, "continuation_without_start"), (1, 5): ("SOR1", None), (1, 6): (None, "keys_disagree"), (1, 7): (None, "later_stage"), (1, 8): (None, "not_read"),
        (1, 9): (None, "no_resolved_key"), (1, 10): (None, "po_matches_several_sos"), (2, 1): (None, "two_fps_one_sor"), (2, 2): (None, "two_fps_one_sor"), (2, 3): ("SOR1", None), (2, 4): (None, "so_unknown"),
    }
    assert [(r.order_no, r.n_documents, r.n_scans, r.hold) for r in grouping.bundles(linked).collect()] == [("SOR1", 3, 2, None)]


def test_dates_and_receipts(spark):
    day = datetime.date
    rows = [("a", day(2026, 5, 2), None, day(2026, 5, 1), day(2026, 5, 9), True), ("b", day(2026, 4, 2), None, day(2026, 5, 1), day(2026, 5, 9), True), ("c", None, None, day(2026, 5, 1), None, False), ("d", day(2026, 4, 2), day(2026, 4, 2), day(2026, 5, 1), None, True)]
    docs = spark.createDataFrame(rows, "k string, day date, cgr_date date, tgl_so date, scan_day date, printed boolean")
    assert {r.k: r.status for r in settle.dates_in_order(docs, ["k"]).collect()} == {"a": "pass", "b": "fail", "c": "unknown", "d": "pass"}


def test_ranked_values_of_any_group(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 30), ("c", 1000)) for v in itertools.islice(itertools.cycle([5, 1, 3, 3, 900, -2]), n)] + [("d", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranked_values(df, ["g"], "v", {"p50": nearest_rank(50), "p90": nearest_rank(90)}).collect()}
    for g in ("a", "b", "c", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        at = lambda q: values[max(1, min(len(values), round(q / 100 * len(values) + 0.5))) - 1]  # noqa: E731, B023
        assert (got[g].n, got[g].p50, got[g].p90) == (len(values), at(50), at(90))
    assert "d" not in got
    middle = {r.g: r.median for r in medians(df, ["g"], "v").collect()}
    assert middle["b"] == 3.0 and middle["a"] == 5.0
    assert ranked_values(df.filter("false"), ["g"], "v", {"p": nearest_rank(50)}).count() == 0


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(500)], "a int, b int")
    got = sorted((r.place, r.a, r.b) for r in global_rank(df, ["a", "b"], F.col("a"), "place").collect())
    assert [(a, b) for _, a, b in got] == sorted((i * 37 % 101, i) for i in range(500)) and [p for p, _, _ in got] == list(range(1, 501))
