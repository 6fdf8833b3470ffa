"""The trie of conversations' prefixes, built by halving: every round names the cut in the middle of all known stretches at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, walked

ROOT = b"root".ljust(32, b"\0")
#: Ids a row when those of a node are joined: a node's ids are written in stretches of so many numbers.
STRETCH_BITS = 12


def named(*parts: Column) -> Column:
    """A 32-byte name, the same for the same parts; other parts of a known length never get it."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, name, chars) a row, in the order of turns: null first, ties by role and text. Null role or text: empty. A null id is no conversation."""
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    name = named(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("role").cast("binary"), F.col("text").cast("binary"))
    return walked(rows, "conv", ["turn", "role", "text"], name="trie-turns").select("conv", "place", name.alias("name"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations, and (conv, d, name, chars) of their turns from d = 1, when each conversation c
    begins with the first crc32(c) % 6 turns of conversation c - c % 100 in place of as many of its own."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("h")
    lengths = saved(turns.groupBy("conv").agg((F.max("place") + 1).alias("n")), "trie-lengths")
    base = lengths.filter(F.col("conv") % 100 == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = lengths.select("conv", h, (F.col("conv") - F.col("conv") % 100).alias("base")).join(base, "base", "left")
    convs = saved(convs.select("conv", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head")), "trie-convs")
    first = turns.filter((F.col("conv") % 100 == 0) & (F.col("place") < 5)).withColumnRenamed("conv", "base")
    heads = convs.join(first, "base").filter(F.col("place") < F.col("head")).select("conv", (F.col("place") + 1).alias("d"), "name", "chars")
    # a conversation with very many turns is split here, as convs is a written table
    tails = turns.withColumn("h0", h).filter("place >= h0").join(convs.select("conv", "head"), "conv").select("conv", (F.col("head") + F.col("place") - F.col("h0") + 1).alias("d"), "name", "chars")
    return convs.select("conv"), saved(heads.unionByName(tails), "trie-places")


def prefix_names(convs: DataFrame, places: DataFrame) -> DataFrame:
    """(conv, d, name) for each prefix of d turns, d = 0 included; equal prefixes of one length have one name.

    Upwards, two neighbouring stretches of turns become one of twice the length, for all conversations at once. Then the whole range is cut at half its depth,
    the prefix that ends at the cut is named by its start and the stretch between, and both halves are cut in the next round:
    as many rounds as the greatest depth has binary digits. Joins are on (conv, stretch), each once.
    """
    deepest = places.agg(F.max("d")).first()[0] or 0
    stretches = [places.select("conv", (F.col("d") - 1).alias("b"), "name")]
    for _ in range(1, deepest.bit_length()):
        half = F.col("b") % 2
        pair = stretches[-1].groupBy("conv", F.expr("shiftright(b, 1)").alias("b")).agg(F.max(F.when(half == 0, F.col("name"))).alias("l"), F.max(F.when(half == 1, F.col("name"))).alias("r"))
        stretches.append(saved(pair.filter("r is not null and l is not null").select("conv", "b", named(F.col("l"), F.col("r")).alias("name")), "trie-stretches"))
    cuts = [convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("name"))]
    for k in reversed(range(len(stretches) if deepest else 0)):
        between = stretches[k].filter("b % 2 = 0").select("conv", F.expr(f"shiftleft(b, {k})").alias("d"), F.col("name").alias("between"))
        known = reduce(DataFrame.unionByName, cuts)
        cuts.append(saved(known.join(between, ["conv", "d"]).select("conv", (F.col("d") + 2**k).alias("d"), named(F.col("name"), F.col("between")).alias("name")), "trie-cuts"))
    return reduce(DataFrame.unionByName, cuts)


def id_digests(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) from rows (d, name, conv): the digest of a node's ids, ascending and joined by commas.
    Ids are joined by stretches of numbers first; a node's stretches then stream through one task, as a digest must."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    parts = ends.groupBy("d", "name", F.expr(f"shiftright(conv, {STRETCH_BITS})").alias("stretch")).agg(ids.alias("ids"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for d, name, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, name) != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (d, name), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield frame(out)
        if last is not None:
            yield frame([(*last, digest.hexdigest())])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], names=["d", "name", "ends_sha256"])

    return parts.repartition("d", "name").sortWithinPartitions("d", "name", "stretch").select("d", "name", "ids").mapInArrow(read, "d long, name binary, ends_sha256 string")


def grafted(nodes: DataFrame, prefixes: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """(d, name) with ``sums``, each summed over the node's subtree, from ``nodes`` (d, name, conv_id, sums).

    Depths are taken in bands of 1, 2, 4, ... Each round joins an upper band with the forest under it: the total of every tree of the forest,
    which is that of its top by now, is added to the nodes of the upper band on the way to that top, found by the prefixes of one member. A top has as many such nodes
    as the band has depths, each join on (conv, d) once.
    """
    totals = nodes.select("d", "name", "conv_id", *sums)
    for k in range(deepest.bit_length()):
        width = 2**k
        tops = totals.filter(f"d % {width} = 0 and shiftright(d, {k}) % 2 = 1")
        way = tops.select(F.col("conv_id").alias("conv"), F.explode(F.sequence(F.col("d") - width, F.col("d") - 1)).alias("d"), *sums)
        added = way.join(prefixes, ["conv", "d"]).groupBy("d", "name").agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
        totals = saved(totals.join(added, ["d", "name"], "left").select("d", "name", "conv_id", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums)), "trie-totals")
    return totals.drop("conv_id")


def prefix_trie(convs: DataFrame, places: DataFrame) -> DataFrame:
    """A row a node: conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` has each conversation once, ``places`` (conv, d, name, chars) its turns from d = 1, one a depth without gaps. Repeated conversations share all their nodes.
    No conversations: no nodes, not even a root. One node may hold any share of all rows: members are counted before they move, and joins are on rows of conversations or against written tables.
    """
    prefixes = saved(prefix_names(convs, places), "trie-prefixes")
    nothing = F.lit(None)
    own = prefixes.select("conv", "d", F.col("name"), nothing.cast("binary").alias("up"), nothing.cast("long").alias("chars"))
    above = prefixes.select("conv", (F.col("d") + 1).alias("d"), nothing.cast("binary").alias("name"), F.col("name").alias("up"), nothing.cast("long").alias("chars"))
    texts = places.select("conv", "d", nothing.cast("binary").alias("name"), nothing.cast("binary").alias("up"), "chars")
    met = saved(own.unionByName(above).unionByName(texts).groupBy("conv", "d").agg(F.max("name").alias("name"), F.max("up").alias("up"), F.max("chars").alias("chars")), "trie-met")
    plain = saved(met.filter("name is not null").groupBy("d", "name").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("up").alias("up"), F.max("chars").alias("chars")), "trie-plain")
    children = plain.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    ends = id_digests(met.filter("name is null").select((F.col("d") - 1).alias("d"), F.col("up").alias("name"), "conv"))  # no further turn
    more = F.coalesce("n_children", F.lit(0)).alias("n_children")
    nodes = plain.join(children, ["d", "name"], "left").join(ends, ["d", "name"], "left")
    nodes = saved(nodes.select("d", "name", "conv_id", "n_convs", "up", more, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
                               (more == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("saved_tokens")), "trie-nodes")
    totals = grafted(nodes, prefixes, nodes.agg(F.max("d")).first()[0] or 0, ["n_leaves", "saved_tokens"])
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, ["d", "name"]).join(parents, ["d", "up"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


def crc32_sql(text: str) -> str:
    """CRC-32 (polynomial edb88320) of a text's bytes, bit by bit, as DuckDB has no function for it."""
    step = "CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, ch: list_reduce(list_prepend(xor(c, ch), range(8)::BIGINT[]), lambda x, i: {step})), 4294967295)"


SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, n, h, c - c % 100 AS base FROM (SELECT c, count(*) AS n, {crc32_sql('c::VARCHAR')} % 6 AS h FROM t GROUP BY c)),
cb AS (SELECT cs.*, least(h, coalesce((SELECT count(*) FROM t WHERE t.c = cs.base), 0)) AS head FROM cs),
p AS (SELECT cb.c, i + 1 AS d, role, text FROM cb JOIN t ON t.c = base WHERE i < head
      UNION ALL SELECT cb.c, head + i - h + 1, role, text FROM cb JOIN t ON t.c = cb.c WHERE i >= h),
k AS (SELECT c, d, length(text) AS chars, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '|') OVER (PARTITION BY c ORDER BY d)) AS name FROM p
      UNION ALL SELECT c, 0, 0, '' FROM cs),
l AS (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM k),
n AS (SELECT d, name, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends FROM l GROUP BY d, name),
u AS (SELECT n.*, k.name AS up FROM n LEFT JOIN k ON k.c = n.conv_id AND k.d = n.d - 1),
ch AS (SELECT d - 1 AS d, up AS name, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN ch USING (d, name)),
s AS (SELECT k.d, k.name, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM v JOIN k ON k.c = v.conv_id AND k.d <= v.d GROUP BY k.d, k.name)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends AS ends_sha256
FROM v JOIN s USING (d, name) LEFT JOIN n o ON o.d = v.d - 1 AND o.name = v.up
"""
