"""An order export of three text files: headers, purchase numbers and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Kinds of discount, a column disc_<kind> each.
DISCOUNTS = ["reg", "dc", "b2b"]


def through_csv(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as CSV with a header and read again, every column as text; blanks at the ends of values stay, empty values are null."""
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    schema = StructType([StructField(c, StringType()) for c in df.columns])
    return df.sparkSession.read.option("header", True).schema(schema).csv(path)


def text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def number(c: str) -> Column:
    return text(c).try_cast("double")


def day(c: str) -> Column:
    return F.left(text(c), F.lit(10)).try_cast("date")


def _last(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(by).cast("long").desc()))
    return df.withColumn("last no", n).filter("`last no` = 1").drop("last no")


def orders(head: DataFrame, po: DataFrame) -> DataFrame:
    """Orders with their purchase number, of the number file's last row (row_no) of the order; orders without one keep null. Number rows of other orders are left out."""
    numbers = _last(po, ["order_no"], "row_no").select(F.trim("order_no").alias("sor_no"), text("po_number").alias("cpo_no"))
    o = head.select(F.trim("order_no").alias("sor_no"), F.trim("customer_id").alias("customer_code"), day("created_at").alias("tgl_so"), number("total").alias("total"), text("status").alias("status"))
    return o.join(numbers, "sor_no", "left")


def lines(rows: DataFrame, head: DataFrame) -> DataFrame:
    """Lines of the headers' orders; of rows with the same order and line number the last (row_no) stays. discounts: a map of the kinds that are not zero."""
    known = rows.join(head.select("order_id", F.trim("order_no").alias("sor_no")), "order_id")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), number(f"disc_{k}").alias("value")) for k in DISCOUNTS])
    some = F.filter(kinds, lambda x: F.coalesce(x["value"], F.lit(0.0)) != 0)
    last = _last(known, ["sor_no", "line_no"], "row_no")
    return last.select("sor_no", F.col("line_no").cast("int").alias("line_no"), number("qty").alias("qty"), F.map_from_entries(some).alias("discounts"))


def counts(orders_: DataFrame, lines_: DataFrame, head: DataFrame, po: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: orders, those with a number, lines kept, line rows of no order, numbers of no order."""
    lost = rows.join(head, "order_id", "left_anti").agg(F.count("*").alias("lines_without_order"))
    only = po.select(F.trim("order_no").alias("sor_no")).distinct().join(orders_, "sor_no", "left_anti").agg(F.count("*").alias("only_in_po_file"))
    kept = orders_.agg(F.count("*").alias("orders"), F.count("cpo_no").alias("with_po_number"))
    return kept.join(lines_.agg(F.count("*").alias("lines"))).join(lost).join(only)
