"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, saved, table, word_count

SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: falls with the share of characters that are symbols. Empty and null: 1."""
    size = F.length(text)
    symbols = size - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(size, F.lit(1))), F.lit(1.0))


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_plan(sources: DataFrame, shares: tuple[int, ...], most: int) -> DataFrame:
    """Targets: (skey, source, source_size) with target, epochs and rest.

    Sources take ``shares`` in turn, by code point, null last. The total of all sizes is shared by
    weight; a target stops at ``most`` times its source and the excess goes to the others. That is
    the level L with sum(min(weight * L, cap)) = total, found with running sums over the sources
    in the order of cap / weight. One row a source goes through these windows, never a document.
    """
    everything = Window.partitionBy()
    named = (
        sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("w", F.element_at(F.array(*map(F.lit, shares)), (F.col("n") - 1) % len(shares) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    order = Window.orderBy("ratio", "n")
    level = (
        named.withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("lam", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("lam"), F.col("lam"))).over(everything))
    )
    target = F.least(F.col("w") * F.col("level"), F.col("cap").cast("double"))
    return (
        level.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.floor(F.col("target") + 0.5) - F.col("epochs") * F.col("source_size"), F.lit(0)).cast("long"))
        .select("skey", "source_size", "target", "epochs", "rest")
    )


#: Rates at which key ranges are spread.
SCALES = (1.0, 0.5, 0.25, 0.12, 0.05)


@dataclass
class Mix:
    """``plan``: a row a source with its target, whole epochs and the key where its selection ends."""

    plan: DataFrame
    with_keys: object  # DataFrame -> DataFrame with skey, size and key

    def taken(self, rows: DataFrame) -> DataFrame:
        """Rows with skey, size and key get target and taken; decided row by row, without a shuffle
        of rows as long as Spark finds the plan small enough to broadcast."""
        part = (
            F.when(F.col("key") < F.col("cut_key"), F.col("size"))
            .when(F.col("key") == F.col("cut_key"), F.expr("size * cut_words div cut_size"))
            .otherwise(F.lit(0))
        )
        return rows.join(self.plan, "skey").withColumn("taken", (F.col("epochs") * F.col("size") + F.coalesce(part, F.lit(0))).cast("long"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weight=quality_weight, shares=(1, 2, 3), most=3) -> tuple[Mix, DataFrame]:
    """Plans the mix; also returns the small table (id, skey, size, key) it was planned on.

    A document's key is -ln(u) / weight, u from its id's hash (of the text where the id is null), so
    reruns agree; the least keys of a source go first. Whole epochs of a source come first; what is
    left of its budget goes to documents in the order of their keys. The document at the edge gives
    only the words that are left, so a source takes its target rounded to words. Prefix sums run over key ranges of each
    source (their sums, then the one range that holds the edge), so no task sees a whole source.

    Null text: size 0. Null source: a source of its own, last. Repeated rows and equal keys share
    what is left by size, rounded down. Empty table: no rows. Extra columns are left alone.
    """

    def with_keys(df: DataFrame) -> DataFrame:
        text = F.col(text_col)
        seed = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))
        return (
            df.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
            .withColumn("size", word_count(text))
            .withColumn("key", -F.ln(uniform(seed)) / weight(text))
        )

    sized = saved(with_keys(docs.select(id_col, text_col, source_col)).select(id_col, source_col, "skey", "size", "key"), "mix-sized")
    ranges = int(max(64, min(65536, sized.count() // 256)))
    # A key of weight w is exponential of mean 1 / w, so 1 - exp(-key * w) spreads evenly. The mean over SCALES rises with the key and gives no
    # weight from 0.05 to 1 more than about a few times its even part of any range.
    spread = sum((1 - F.exp(-F.col("key") * s) for s in SCALES), F.lit(0.0)) / len(SCALES)
    ranged = sized.withColumn("range", F.floor(spread * ranges))
    sums = saved(ranged.groupBy("skey", "range").agg(F.first(source_col).alias("source"), F.sum("size").alias("size")), "mix-sums")
    sources = sums.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = saved(source_plan(sources, shares, most), "mix-plan")

    along = Window.partitionBy("skey").orderBy("range")
    edge = (
        sums.join(plan.select("skey", "rest"), "skey")
        .withColumn("before", F.sum("size").over(along) - F.col("size"))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .select("skey", "range", F.col("rest") - F.col("before"))
        .toDF("skey", "range", "rest")
    )
    edge = saved(edge, "mix-edge")
    by_key = Window.partitionBy("skey").orderBy("key")
    cut = (
        ranged.join(edge, ["skey", "range"])
        .groupBy("skey", "key", "rest")
        .agg(F.sum("size").alias("size"))
        .withColumn("before", F.sum("size").over(by_key) - F.col("size"))
        .filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("size")))
        .select("skey", F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("cut_words"), F.col("size").alias("cut_size"))
    )
    return Mix(saved(plan.join(cut, "skey", "left"), "mix-cut"), with_keys), sized


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last copy at a source's edge cut to
    the words that are left. The columns are those of ``docs``."""
    text = options.get("text_col", "text")
    chosen, _ = mix(docs, **options)
    prefix = "mixing "
    rows = docs.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in docs.columns], *[F.col(f"`{c}`") for c in dict.fromkeys([options.get("id_col", "doc_id"), text, options.get("source_col", "source")])])
    rows = chosen.taken(chosen.with_keys(rows)).filter("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.when(left >= F.col("size"), F.col(text)).otherwise(F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), ""))
    out = [cut.alias(c) if c == text else F.col(f"`{prefix}{c}`").alias(c) for c in docs.columns]
    return rows.select(*out)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, sized = mix(table(spark, sf_dir, "documents"))
    return chosen.taken(sized).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE
                      / greatest(length(text), 1)::DOUBLE), 1.0::DOUBLE) AS key
  FROM documents),
sources AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, sum(source_size) OVER () AS total FROM sources),
weighed AS (SELECT *, (n - 1) % 3 + 1 AS w, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((n - 1) % 3 + 1)::DOUBLE AS ratio FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY ratio, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lam FROM weighed),
targets AS (SELECT *, least(w::DOUBLE * max(lam) FILTER (ratio >= lam) OVER (), cap::DOUBLE) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS epochs FROM targets),
rests AS (SELECT *, greatest(floor(target + 0.5)::BIGINT - epochs * source_size, 0) AS rest FROM plan),
keys AS (
  SELECT skey, key, sum(size) AS ksize FROM sized GROUP BY skey, key),
cum AS (SELECT *, sum(ksize) OVER (PARTITION BY skey ORDER BY key) - ksize AS before FROM keys)
SELECT s.doc_id, s.size::BIGINT AS size, r.source_size, r.target,
       (r.epochs * s.size + CASE WHEN c.before + c.ksize <= r.rest THEN s.size
             WHEN c.before < r.rest THEN s.size * (r.rest - c.before) // c.ksize ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN rests r USING (skey) JOIN cum c ON c.skey = s.skey AND c.key = s.key
"""
