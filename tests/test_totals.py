"""Purchase papers against orders, and values as read, held against going through them one by one."""

import io
import random
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from ledgerline.operators import totals


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def greedy(lines, pool, allow=1000):
    missing, gap = [], None
    for line_no, net, vat in sorted(lines):
        gross = round(net + (vat or 0), 2)
        near = [(min(abs(a - net), abs(a - gross)), i) for i, a in enumerate(pool) if a is not None]
        if near:
            gap = min(near)[0] if gap is None else max(gap, min(near)[0])
        if near and min(near)[0] <= allow + 0.005:
            pool[min(near)[1]] = None
        else:
            missing.append(line_no)
    return missing, gap


def test_lines_among_amounts(spark):
    rng = random.Random(3)
    rows, lines = [], []
    for k in range(60):
        net = [float(rng.randrange(1, 40) * 700) for _ in range(rng.randrange(1, 7))]
        lines += [(f"S{k}", i + 1, x, rng.choice([None, round(x * 0.11, 2)])) for i, x in enumerate(net)]
        rows += [(f"S{k}", 1, i, [rng.choice([None, x]), x + rng.choice([0.0, 900.0, 1500.0])]) for i, x in enumerate(net) if rng.random() < 0.8]
    found = totals.rows_hold_lines(spark.createDataFrame(rows, "sor_no string, page_no int, row_no int, amounts array<double>"), spark.createDataFrame(lines, "sor_no string, line_no int, line_amount double, vat double"))
    got = {r.sor_no: (r.missing, r.gap) for r in found.collect()}
    for k in range(60):
        pool = [a for s, _, _, amounts in sorted(rows, key=lambda r: (r[0], r[1], r[2])) if s == f"S{k}" for a in amounts if a is not None]
        missing, gap = greedy([x[1:] for x in lines if x[0] == f"S{k}"], pool)
        assert got[f"S{k}"][0] == missing and (gap is None) == (got[f"S{k}"][1] is None) and (gap is None or abs(got[f"S{k}"][1] - gap) < 0.006)


def test_an_orders_papers_are_summed_once(spark):
    """A line looks for its nearest amount once, and an order's papers are read by one sum, whatever the result asks of them."""
    held = plan_of(totals.rows_hold_lines(spark.createDataFrame([], "sor_no string, page_no int, row_no int, amounts array<double>"), spark.createDataFrame([], "sor_no string, line_no int, line_amount double, vat double")))
    assert max(line.count("array_min") for line in held.splitlines()) <= 2
    docs = "sor_no string, total decimal(18,2), cut boolean, printed boolean, asked boolean, second decimal(18,2), ppn decimal(18,2), ppn_cut boolean, ppn_printed boolean, ppn_asked boolean, ppn_second decimal(18,2)"
    no = spark.createDataFrame([], "sor_no string, page_no int, row_no int, amounts array<double>"), spark.createDataFrame([("S1", 100, 11, 111)], "sor_no string, order_dpp int, order_ppn int, order_total int"), spark.createDataFrame([], "sor_no string, line_no int, line_amount double, vat double")
    orders = no[1].select("sor_no", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("order_dpp", "order_ppn", "order_total")])
    papers = spark.createDataFrame([("S1", None, False, True, False, None, None, False, True, False, None), ("S2", None, False, True, False, None, None, False, True, False, None)], docs).filter("total is null")
    out = totals.order_side(papers, no[0], orders, no[2])
    assert len(re.findall("ppn_second", plan_of(out))) == 0  # the sums were taken before
    assert [tuple(r) for r in out.collect()] == [("S1", "pass", "rows", None, None, 0, None)]


def test_last_read_equals_going_through_pages(spark):
    rng = random.Random(8)
    spans = [(f"D{b}-{i}", b, lo, hi) for b in range(40) for i, (lo, hi) in enumerate([(1, 3), (4, 4), (6, 8)])]
    fields = [(b, p, name, rng.choice([None, "", "(not printed)", "a", "b", "c"]), rng.choice([None, True, False]), rng.choice([None, True, False])) for b in range(41) for p in range(1, 9) for name in ("total", "number") for _ in range(rng.randrange(3))]
    want = {}
    for key, b, lo, hi in spans:
        for name in ("total", "number"):
            mine = [(p, bool(own), value, bool(asked)) for b_, p, n, value, own, asked in fields if b_ == b and n == name and lo <= p <= hi]
            for p in range(lo, hi + 1):
                at = [(own, value) for q, own, value, _ in mine if q == p and value]
                if at and (True, "(not printed)") not in at:
                    want[key, name] = (max(at)[1], p, max(at)[0], any(asked and q == lo for q, _, _, asked in mine))
    given = spark.createDataFrame(spans, "key string, batch_id int, page_from int, page_to int"), spark.createDataFrame(fields, "batch_id int, page_no int, name string, value string, own boolean, asked boolean")
    out = totals.last_read(*given, ["key"])
    assert plan_of(out).count("Join") == 1  # pages meet what was read on them once
    assert {(r.key, r.name): (r.value, r.page_no, r.own, r.asked) for r in out.collect()} == want
