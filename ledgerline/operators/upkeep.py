"""What a delete takes along, what changed since an order was looked at, and how two readings of a page differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import amount, to_hundredth


def impact(files: DataFrame, pages: DataFrame, documents: DataFrame, orders: DataFrame, labels: DataFrame, confirmations: DataFrame) -> DataFrame:
    """(upload, files, pages, orders, shared, approved, labels, confirmations): for every upload what would go with it.

    ``files`` (upload, batch_id), ``pages``, ``labels`` and ``confirmations`` (batch_id), ``documents`` (batch_id, order_no), ``orders`` (order_no, status). orders: those that have documents of this upload only; shared: those that would lose
    documents and stay; approved: of either, those that were reviewed. How many uploads an order draws on is counted once, so the sums cost one pass for all uploads together. An upload without anything has zeros.
    """
    held = documents.filter("order_no is not null").join(files, "batch_id").select("upload", "order_no").repartition("order_no").distinct()
    of = held.withColumn("uploads", F.count("*").over(Window.partitionBy("order_no"))).join(orders.select("order_no", "status"), "order_no", "left")
    by_order = of.groupBy("upload").agg(F.count_if(F.col("uploads") == 1).alias("orders"), F.count_if(F.col("uploads") > 1).alias("shared"), F.count_if(F.col("status") == "reviewed").alias("approved"))
    kinds = {"pages": pages, "labels": labels, "confirmations": confirmations}
    each = reduce(DataFrame.unionByName, [df.select("batch_id", F.lit(name).alias("kind")) for name, df in kinds.items()])
    batches = each.groupBy("batch_id").agg(*(F.count_if(F.col("kind") == name).alias(name) for name in kinds))  # a scan is counted before it meets its files
    counted = files.join(batches, "batch_id", "left").groupBy("upload").agg(F.count("*").alias("files"), *(F.sum(name).alias(name) for name in kinds))
    out = counted.join(by_order, "upload", "left")
    return out.select("upload", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "pages", "orders", "shared", "approved", "labels", "confirmations")))


def without(documents: DataFrame, orders: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``documents`` and ``orders`` after the files of ``gone`` (batch_id) are deleted: their documents go; an order that has none left goes; one that lost some is open again (grouping), whatever was said of it; others stay as they are, also those that never had any."""
    left = documents.join(gone, "batch_id", "left_anti")
    marked = documents.filter("order_no is not null").join(gone.select("batch_id").distinct().withColumn("gone", F.lit(True)), "batch_id", "left")
    told = marked.groupBy("order_no").agg(F.bool_or(F.coalesce("gone", F.lit(False))).alias("lost"), F.bool_or(F.col("gone").isNull()).alias("still"))
    met = orders.join(told, "order_no", "left").filter("lost is null or not lost or still")
    return left, met.withColumn("status", F.when(F.col("lost"), "grouping").otherwise(F.col("status"))).drop("lost", "still")


def fingerprints(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, print): the SHA-1 of all rows that the frames of ``parts`` have of a key, whatever their order; any change of a value changes it, a null is not an empty text.

    A frame's rows become texts and are summed up frame by frame, so that no join multiplies them; a key's rows are its papers and lines, which are kept in one row here.
    """
    text = lambda df: F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in df.columns if c != key])
    rows = [df.select(key, F.concat(F.lit(f"{name}:"), text(df)).alias("t")) for name, df in sorted(parts.items())]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy(key).agg(F.sha1(F.array_join(F.array_sort(F.collect_list("t")), "\n")).alias("print"))


def flips(a: DataFrame, b: DataFrame, key: list[str], row: str) -> DataFrame:
    """(key, cells, rows): how many cells two readings of a page read differently, and by how many rows they differ. ``a`` and ``b`` (key, row, name, value); a cell that one of them lacks counts, null and missing are the same."""
    side = lambda df, a: df.select(*key, row, "name", "value", F.lit(a).alias("in a"))
    both = side(a, True).unionByName(side(b, False)).repartition(*key)  # the three sums below are taken where a page's cells are
    null = lambda *names: F.greatest(*(F.col(c).isNull() for c in names), F.lit(False))  # noqa: E731  such cells are like no other
    value = lambda of: F.max(F.when(F.col("in a") == of, F.col("value")))
    each = both.withColumn("apart", F.when(null(*key, row, "name"), F.col("in a"))).groupBy(*key, row, "name", "apart").agg(value(True).alias("a"), value(False).alias("b"), F.bool_or("in a").alias("in a"), F.bool_or(~F.col("in a")).alias("in b"))
    rows = each.groupBy(*key, row).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("cells"), F.bool_or("in a").alias("in a"), F.bool_or("in b").alias("in b"))
    there = lambda c: F.count_if(F.col(c) & ~null(*key, row))
    return rows.groupBy(*key).agg(F.sum("cells").alias("cells"), F.abs(there("in a") - there("in b")).alias("rows"))


def paired(a: DataFrame, b: DataFrame, key: list[str], block: str, at: str) -> DataFrame:
    """(key, block, a, b, place): two readings of a page side by side by the block that each row stands in: first the rows of ``a`` in its order, then what only ``b`` has, in its own. ``a`` and ``b`` (key, block, at, value); a block is on a page once in a reading."""
    one, two = a.select(*key, block, F.col(at).alias("at a"), F.col("value").alias("a"), F.lit(True).alias("in a")), b.select(*key, block, F.col(at).alias("at b"), F.col("value").alias("b"))
    both = one.join(two, [*key, block], "full")
    order = Window.partitionBy(*key).orderBy(F.col("in a").isNull(), "at a", "at b", block)
    return both.select(*key, block, "a", "b", F.row_number().over(order).alias("place"))


def normal_amounts(fields: DataFrame) -> DataFrame:
    """``fields`` (kind, value, source, read) with amounts as what their source says, to the hundredth; the value before is kept as read where it differs and nothing was kept yet. Doing it again changes nothing; other kinds and sources without a number stay."""
    says = F.when(F.col("kind") == "amount", amount(F.col("source")))  # a source is read once, and only an amount's
    new = F.when(F.col("says").isNotNull(), to_hundredth(F.col("says")))
    changed = F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("value"))
    told = fields.withColumn("says", says).withColumn("new", new)
    return told.withColumn("read", F.when(changed, F.coalesce("read", "value")).otherwise(F.col("read"))).withColumn("value", F.coalesce("new", "value")).drop("says", "new")
