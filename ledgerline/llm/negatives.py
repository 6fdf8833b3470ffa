"""Hard negatives by exact integer scores: matrices multiplied modulo small primes in float32, put together by Chinese remainders, then windows of scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows a block, anchors a block; a cell is one of each, 16 MB of scores.
ROWS, ANCHORS = 2048, 1024
#: A row's uid is its block's number and, in so many bits, its place there.
BITS = 12
#: Rows of one pile, which meets a block of anchors in one task.
PILE = 2**20
#: Primes under 256, greatest first: residues are at most 125 in size, so float32 sums of 1024 products are exact (1024 * 125**2 < 2**24).
PRIMES = [p for p in range(255, 2, -1) if all(p % q for q in range(2, 16))]
INNER = 1024
#: Scores times 100 must fit in 64 bits.
GREATEST = 2**56
POSITIVES, NEGATIVES = 5, 3
LEAST = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all scores of at most ``bound`` in size apart."""
    if bound >= GREATEST:
        raise ValueError(f"scores of {bound} may come up; they must stay under 2**56")
    out = []
    while math.prod(out) <= 2 * bound:
        out.append(PRIMES[len(out)])
    return out


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Of integers held as float64, in float32, each between -(p-1)/2 and (p-1)/2."""
    r = np.fmod(values, p)
    r -= p * (r > p // 2)
    r += p * (r < -(p // 2))
    return r.astype(np.float32)


def product(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The exact product a b^T as int64 from the residues of both for each prime."""
    total, weight = None, 1
    for p, x, y in zip(primes, a, b, strict=True):
        r = np.zeros((len(x), len(y)), np.int64)
        for at in range(0, x.shape[1], INNER):
            r += (x[:, at : at + INNER] @ y[:, at : at + INNER].T).astype(np.int64)
        if total is None:
            total = np.mod(r, p)
        else:  # the next digit in the mixed radix of the primes
            r -= total
            np.mod(r, p, out=r)
            r *= pow(weight, -1, p)
            np.mod(r, p, out=r)
            r *= weight
            total += r
        weight *= p
    total[total > weight // 2] -= weight
    return total


def to_blocks(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows (block, n, ids, labels, width, vectors, longest): at most ROWS rows together, by id, with floor(256 x) of their components as float64.

    Left out are rows with a null id, label or vector, and those with a null or non-finite component. Shorter vectors of a block end in zeros.
    """
    fit = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = fit.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~F.coalesce(bad, F.lit(True)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
            flat, at = batch.column(2).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(2).value_lengths().to_numpy()))
            order = np.argsort(ids, kind="stable")
            for lo in range(0, len(ids), ROWS):
                own = order[lo : lo + ROWS]
                m = np.zeros((len(own), int((at[own + 1] - at[own]).max())))
                for i, j in enumerate(own):
                    m[i, : at[j + 1] - at[j]] = np.floor(256 * flat[at[j] : at[j + 1]])
                longest = float(np.sqrt((m * m).sum(1)).max()) if m.size else 0.0
                small = np.abs(m).max(initial=0) < 2**15
                yield pa.RecordBatch.from_pydict({"block": [first], "n": [len(own)], "ids": [ids[own].tobytes()], "labels": [labels[own].tobytes()], "width": [m.shape[1]], "small": [bool(small)], "vectors": [m.astype(np.int16 if small else np.float64).tobytes()], "longest": [longest]}, schema=BLOCK_ARROW)
                first += 1

    return saved(fit.mapInArrow(write, BLOCK), "negatives-blocks")


BLOCK = "block long, n int, ids binary, labels binary, width int, small boolean, vectors binary, longest double"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("small", pa.bool_()), ("vectors", pa.binary()), ("longest", pa.float64())])


def matrix(vectors: bytes, n: int, small: bool) -> np.ndarray:
    return np.frombuffer(vectors, np.int16 if small else np.float64).astype(np.float64).reshape(n, -1)


def anchors_of(blocks: DataFrame, every: int) -> DataFrame:
    """(g, n, uids, ids, labels, width, vectors): the rows whose id ``every`` divides, ANCHORS a block. A row's uid is its place in the blocks."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids, labels, m = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64), matrix(r.vectors, r.n, r.small)
                own = np.flatnonzero(ids % every == 0)
                yield pd.DataFrame({"uid": (r.block << BITS) + own, "id": ids[own], "label": labels[own], "v": pd.Series(list(m[own]), dtype=object)})

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 24
        for f in frames:
            for lo in range(0, len(f), ANCHORS):
                x = f.iloc[lo : lo + ANCHORS]
                m = np.zeros((len(x), max(map(len, x.v))))
                for i, v in enumerate(x.v):
                    m[i, : len(v)] = v
                yield pd.DataFrame({"g": [first], "a_n": [len(x)], "a_uids": [x.uid.to_numpy(np.int64).tobytes()], "a_ids": [x.id.to_numpy(np.int64).tobytes()], "a_labels": [x.label.to_numpy(np.int64).tobytes()], "a_vectors": [m.tobytes()]})
                first += 1

    rows = saved(blocks.mapInPandas(pick, "uid long, id long, label long, v array<double>"), "negatives-anchors", batch_rows=16)
    count = rows.count()
    packed = rows.repartition(max(1, math.ceil(count / (8 * ANCHORS)))).mapInPandas(pack, "g long, a_n int, a_uids binary, a_ids binary, a_labels binary, a_vectors binary")
    return saved(packed, "negatives-anchor-blocks")


def cells(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows. Rows go in piles of about PILE; a pile and a block of anchors meet by key, as often as there are such blocks."""
    groups, n = anchors.count(), blocks.agg(F.sum("n")).first()[0] or 0
    piles = max(1, math.ceil(n / PILE), math.ceil(2 * blocks.sparkSession.sparkContext.defaultParallelism / max(1, groups)))
    pile, numbers = F.pmod(F.xxhash64("block"), F.lit(piles)), lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    number = anchors.select("g", (F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("number"))  # a row for every 1024 anchors
    dealt = blocks.filter(F.lit(groups > 0)).withColumn("pile", pile).withColumn("number", numbers(max(1, groups)))
    spread = anchors.join(number, "g").withColumn("pile", numbers(piles))
    return dealt.join(spread, ["number", "pile"]).drop("number")


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``k`` greatest allowed scores of each line, greatest first and the earlier column first among equals: (line, column) of the lines that have one, k times."""
    left = np.where(allowed, scores, LEAST)
    lines = np.arange(len(left))
    for _ in range(min(k, left.shape[1])):
        column = left.argmax(1)
        there = left[lines, column] > LEAST
        if not there.any():
            return
        yield lines[there], column[there]
        left[lines, column] = LEAST


def scored(frames: Iterator[pd.DataFrame], primes: list[int]) -> Iterator[tuple]:
    """Each cell with its anchors' and rows' ids, labels and uids, and all exact scores between them."""
    held: tuple = (None, None)
    for f in frames:
        for r in f.itertuples():
            b = matrix(r.vectors, r.n, r.small)
            a = np.frombuffer(r.a_vectors, np.float64).reshape(r.a_n, -1)
            width = min(a.shape[1], b.shape[1])
            if held[0] != (r.g, width):
                held = ((r.g, width), [residues(a[:, :width], p) for p in primes])
            s = product(held[1], [residues(b[:, :width], p) for p in primes], primes)
            yield (r, *(np.frombuffer(x, np.int64) for x in (r.a_uids, r.a_ids, r.a_labels, r.ids, r.labels)), (r.block << BITS) + np.arange(r.n), s)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row whose id ``every`` divides, against all rows.

    An anchor's positives are the ``positives`` best other rows of its label; the negatives of each are the best rows of another label whose score lies between
    ``low`` and ``high`` per cent of the positive's, bounds included. Scores are exact inner products of floor(256 x); ties go to the smaller id.
    Ids and labels are integers. Rows with a null id, label or vector, or a null or non-finite component, take no part; a shorter vector counts as ending in zeros.
    Repeated rows are rows of their own, so an anchor's copy may be its positive, and a repeated anchor is answered twice. Empty table, no anchors or no negatives: no rows.
    Extra columns are left out. Scores of 2**56 or more are an error.

    Anchors times rows is the work by definition; it is done in cells of a block of each, of which only the best few a line leave a task, and a label of any size is in as many cells as its rows need.
    """
    blocks = to_blocks(df, id_col, vector_col, label_col)
    longest = blocks.agg(F.max("longest")).first()[0] or 0.0
    primes = primes_for(math.ceil(longest * longest * (1 + 1e-9)) + 1)  # no product of two vectors exceeds those of their lengths
    anchors = anchors_of(blocks, every)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, uids, ids, labels, other, other_labels, other_uids, s in scored(frames, primes):
            same = (labels[:, None] == other_labels[None]) & (uids[:, None] != other_uids[None])
            for i, j in best(s, same, positives):
                yield pd.DataFrame({"g": r.g, "line": i, "uid": uids[i], "positive_id": other[j], "positive_uid": other_uids[j], "score": s[i, j]})

    found = cells(blocks, anchors).mapInPandas(near, "g long, line int, uid long, positive_id long, positive_uid long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "positive_id", "positive_uid")
    found = saved(found, "negatives-near", batch_rows=8).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= positives)
    lists = found.groupBy("g").agg(F.collect_list(F.struct("line", "k", "positive_id", "score")).alias("p"))  # at most 1024 times positives
    lists = saved(lists.select("g", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("line", "k", "positive_id", "score"))), "negatives-positives")

    def window(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, uids, ids, labels, other, other_labels, _, s in scored(frames, primes):
            differs, scores = labels[:, None] != other_labels[None], 100 * s
            for k in range(1, positives + 1):
                at = np.flatnonzero(r.p_k == k)
                line, score = r.p_line[at], r.p_score[at].astype(np.int64)
                within = differs[line] & (scores[line] >= low * score[:, None]) & (scores[line] <= high * score[:, None])
                for i, j in best(s[line], within, negatives):
                    yield pd.DataFrame({"uid": uids[line[i]], "anchor_id": ids[line[i]], "k": k, "positive_id": r.p_positive_id[at[i]], "positive_score": score[i], "negative_id": other[j], "negative_score": s[line[i], j]})

    out = cells(blocks, anchors.join(lists, "g")).mapInPandas(window, "uid long, anchor_id long, k int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("uid", "k").orderBy(F.desc("negative_score"), "negative_id")
    out = saved(out, "negatives-window", batch_rows=8).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.uid <> b.uid WHERE a.vec_id % 50 = 0),
p AS (SELECT uid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id, other) AS k
      FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.uid, k ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
