"""Whether what was read from a page stands on it: values against what they say is printed, and that against the page's text, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import amount, flat

#: Letters and digits that a value must have to be looked for; rates of tax; what sums may differ by.
LEAST = 5
RATES, SUM_SLACK = [0.11, 0.12], 1.0
#: The first letters of months.
MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "MEI": 5, "JUN": 6, "JUL": 7, "AUG": 8, "AGU": 8, "AGT": 8, "SEP": 9, "OCT": 10, "OKT": 10, "NOV": 11, "DEC": 12, "DES": 12}


def numbers(text: Column) -> Column:
    """Every number that a printed one can be: with a decimal comma, with a decimal point, its digits alone."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,]", "")

    def read(decimal: str, thousands: str) -> Column:
        t = F.replace(kept, F.lit(thousands), F.lit(""))
        one = F.length(t) - F.length(F.replace(t, F.lit(decimal), F.lit(""))) <= 1
        return F.when(one, F.round(F.regexp_replace(F.replace(t, F.lit(decimal), F.lit(".")), r"\.+$", "").try_cast("double"), 2))

    digits = F.regexp_replace(kept, "[.,]", "").try_cast("double")
    return F.array_distinct(F.filter(F.array(read(",", "."), read(".", ","), digits), lambda x: x.isNotNull()))


def dates(text: Column) -> Column:
    """Every day, as yyyy-mm-dd, that a text can print: day or year first, months as numbers or by their first letters, years of two figures in this century."""
    t = F.upper(F.coalesce(text, F.lit("")))
    pattern = F.lit(r"(\d{1,4})[-./ ]([A-Z]{3}|\d{1,2})[A-Z]*[-./ ](\d{2,4})")
    part = [F.regexp_extract_all(t, pattern, F.lit(i)) for i in (1, 2, 3)]
    names = F.create_map(*[x for s, n in MONTHS.items() for x in (F.lit(s), F.lit(n))])

    def day(year: Column, month: Column, d: Column) -> Column:
        y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(F.lpad(year, 4, "0"))
        m = F.when(month.rlike("^[0-9]+$"), month.cast("int")).otherwise(names[month])
        return F.when((y != "0000") & (F.length(d) <= 2), F.concat_ws("-", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")).try_cast("date").cast("string"))

    both = F.transform(F.arrays_zip(part[0].alias("a"), part[1].alias("b"), part[2].alias("c")), lambda x: F.array(day(x["c"], x["b"], x["a"]), day(x["a"], x["b"], x["c"])))
    return F.array_distinct(F.filter(F.flatten(both), lambda x: x.isNotNull()))


def agrees(kind: Column, value: Column, source: Column) -> Column:
    """Whether a value says what its printed source does, by the field's kind: amount, qty, date or other."""
    v = F.round(value.try_cast("double"), 2)
    as_amount = F.abs(v - amount(source)) < 0.005
    as_count = F.exists(numbers(source), lambda n: F.abs(v - n) < 0.005)
    as_date = F.array_contains(dates(source), value)
    return F.coalesce(F.when(kind == "amount", as_amount).when(kind == "qty", as_count).when(kind == "date", as_date).otherwise(flat(value) == flat(source)), F.lit(False))


def spaced(text: Column) -> Column:
    """Upper case, letters and digits only, one blank where white space stood between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r"[^0-9A-Z\s]+", ""), r"\s+", " "))


def places(value: Column) -> Column:
    """A pattern that finds a flat value in a ``spaced`` text, whatever blanks stand in it, and not as a part of a longer number."""
    inner = F.array_join(F.filter(F.split(value, ""), lambda c: c != ""), " ?")
    return F.concat(F.when(value.rlike("^[0-9]"), "(^|[^0-9])").otherwise(""), inner, F.when(value.rlike("[0-9]$"), "([^0-9]|$)").otherwise(""))


def windows(text: Column) -> Column:
    """Each line of a page that has letters or digits with the one after it, ``spaced``, and the same without blanks."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda l: flat(l) != "")
    both = F.transform(F.arrays_zip(lines.alias("a"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("b")), lambda x: spaced(F.concat_ws("\n", x["a"], x["b"])))
    return F.transform(both, lambda w: F.struct(w.alias("spaced"), F.replace(w, F.lit(" "), F.lit("")).alias("bare")))


def stands(on: Column, value: Column) -> Column:
    """Whether a flat value of LEAST letters or more stands in one of a page's ``windows``. Only one whose letters hold it is held against the pattern."""
    return F.coalesce((F.length(value) >= LEAST) & F.exists(on, lambda w: F.contains(w["bare"], value) & F.rlike(w["spaced"], places(value))), F.lit(False))


def found(values: DataFrame, pages: DataFrame, value: str) -> DataFrame:
    """(page_id, value), each once: the values that stand on their page, in one of its lines or over two that follow each other. ``values`` (page_id, value as flat text), ``pages`` (page_id, text).

    Values of fewer than LEAST letters are not looked for. A page's lines stay in one row, bounded by the paper.
    """
    asked = values.select("page_id", F.col(value).alias(value)).filter(F.length(value) >= LEAST).distinct()
    return asked.join(pages.select("page_id", windows(F.col("text")).alias("on")), "page_id").filter(stands(F.col("on"), F.col(value))).select("page_id", value).distinct()


def check_values(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, name, verdict, by, why): each value of ``fields`` (page_id, doc_type, name, kind, value, source) against its page (page_id, text, qr).

    empty: no value. check: no source, a value that isn't what its source says, an amount whose last figures are cut, an order number that its code contradicts, a source that is short or not on the page. ok: by qr, text, or, for an FP's three amounts that
    were usable and make sense together, adds_up. A page has a name once.
    """
    bare = flat(F.col("source"))
    met = fields.join(pages.select("page_id", F.when(F.rlike("qr", F.lit(r"^SOR\d{11}$")), F.col("qr")).alias("qr"), windows(F.col("text")).alias("on")), "page_id", "left")
    met = met.withColumn("flat source", bare).withColumn("on page", stands(F.col("on"), F.col("flat source")))
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    cut = (F.col("kind") == "amount") & F.rlike("source", F.lit(r"[.,][0-9]?\s*$"))
    coded = (F.col("name") == "sor") & F.col("qr").isNotNull()
    cases = [
        (~some("value"), "empty", None, None), (~some("source"), "check", None, "no source"), (~agrees(F.col("kind"), F.col("value"), F.col("source")), "check", None, "value and source differ"), (cut, "check", None, "cut"),
        (coded & (flat(F.col("value")) == flat(F.col("qr"))), "ok", "qr", None), (coded, "check", None, "code differs"), (F.col("on page"), "ok", "text", None), (F.length("flat source") < LEAST, "check", None, "short"),
    ]
    out = F.struct(F.lit("check").alias("verdict"), F.lit(None).cast("string").alias("by"), F.lit("not on the page").alias("why"))
    for when, verdict, by, why in reversed(cases):
        out = F.when(when, F.struct(F.lit(verdict).alias("verdict"), F.lit(by).cast("string").alias("by"), F.lit(why).cast("string").alias("why"))).otherwise(out)
    told = met.withColumn("x", out).select("page_id", "doc_type", "name", "value", "x.*")
    usable = ~F.coalesce(F.col("why").isin("no source", "value and source differ", "cut"), F.lit(False)) & (F.col("verdict") != "empty")
    page = Window.partitionBy("page_id")  # a page's values are together since they met its text
    sums = {"d": "dpp", "p": "ppn", "t": "total"}
    both = told.withColumns({c: F.max(F.when((F.col("doc_type") == "FP") & (F.col("name") == name) & usable, F.col("value").try_cast("double"))).over(page) for c, name in sums.items()})
    rate = F.greatest(*[(F.abs(F.col("d") * r - F.col("p")) <= SUM_SLACK).cast("int") for r in RATES]) == 1
    adds = F.col("page_id").isNotNull() & (F.col("d") > 0) & (F.abs(F.col("d") + F.col("p") - F.col("t")) <= SUM_SLACK) & rate
    saved_by_sum = F.coalesce(adds, F.lit(False)) & F.col("name").isin("dpp", "ppn", "total") & (F.col("verdict") == "check")
    pick = lambda c, instead: F.when(saved_by_sum, F.lit(instead)).otherwise(F.col(c)).alias(c)
    return both.select("page_id", "name", pick("verdict", "ok"), pick("by", "adds_up"), pick("why", None))
