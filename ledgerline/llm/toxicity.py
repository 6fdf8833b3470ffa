"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

#: The model is fitted on at most so many labelled documents of each label, taken by their ids' hash,
#: and on none of more characters than FIT_CHARS. Scoring reads all documents whole.
FIT_ROWS = {1: 1500, 0: 3000}
FIT_CHARS = 20_000
LEXICON = 2000
BUCKETS = 8
BLOCK = 256

_tokens = re.compile(r"[^\W\d_]+")


def lowered(text: str | None) -> str:
    """The text in lower case, character by character: one whose lower case is longer stays, so offsets hold."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def tokens_of(text: str | None) -> list[str]:
    return _tokens.findall(lowered(text))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text is 0 mod 5. Null ids are kept from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


# --- the chain: two states, 0 ordinary and 1 toxic -------------------------------------------------


def _prefix_ratios(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log r[t], where r[t] = (a r[t-1] + b) / (c r[t-1] + d) and r[-1] = 1.

    A step is the 2x2 matrix (a b; c d). Blocks of steps are multiplied side by side, their products
    are chained, and the blocks are then gone through side by side again from their own starts.
    """
    n = len(a)
    blocks = -(-n // BLOCK)
    a, b, c, d = (np.ascontiguousarray(np.concatenate([x, np.full(blocks * BLOCK - n, fill)]).reshape(blocks, BLOCK).T) for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    pa, pb, pc, pd_ = a[0], b[0], c[0], d[0]
    for t in range(1, BLOCK):
        na, nb = a[t] * pa + b[t] * pc, a[t] * pb + b[t] * pd_
        nc, nd = c[t] * pa + d[t] * pc, c[t] * pb + d[t] * pd_
        scale = 1.0 / (na + nb + nc + nd)
        pa, pb, pc, pd_ = na * scale, nb * scale, nc * scale, nd * scale
    starts, r = np.empty(blocks), 1.0
    for k, (w, x, y, z) in enumerate(zip(pa.tolist(), pb.tolist(), pc.tolist(), pd_.tolist(), strict=True)):
        starts[k] = r
        r = (w * r + x) / (y * r + z)
    out, r = np.empty((BLOCK, blocks)), starts
    for t in range(BLOCK):
        out[t] = r = (a[t] * r + b[t]) / (c[t] * r + d[t])
    return np.log(out).T.reshape(-1)[:n]


@dataclass
class Chain:
    """Weights: a start, transitions [from, to] and, for the toxic state, a word's bucket, the bucket before
    it and the one after it."""

    start: np.ndarray  # 2
    move: np.ndarray  # 2 x 2
    own: np.ndarray  # BUCKETS + 1
    before: np.ndarray
    after: np.ndarray

    def scores(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        last = np.append(first[1:], True)
        previous = np.where(first, 0, np.append(0, codes[:-1]))
        following = np.where(last, 0, np.append(codes[1:], 0))
        return self.own[codes] + self.before[previous] + self.after[following]

    def marginals(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of the toxic state at each word, and the forward and backward log ratios. Many
        documents are one chain: at a first word both states come from the start."""
        if not len(codes):
            return np.zeros(0), np.zeros(0), np.zeros(0)
        e = np.exp(np.clip(self.scores(codes, first), -30, 30))
        m = [[np.where(first, np.exp(self.start[j]), np.exp(self.move[i, j])) for j in (0, 1)] for i in (0, 1)]
        ahead = _prefix_ratios(e * m[1][1], e * m[0][1], m[1][0], m[0][0])
        # Backward ratio of t from the step into t+1; equal rows at a document's start make it 1.
        flip, back = slice(None, 0, -1), np.zeros(len(e))
        if len(e) > 1:
            steps = (e[flip] * m[1][1][flip], m[1][0][flip], e[flip] * m[0][1][flip], m[0][0][flip])
            back[:-1] = _prefix_ratios(*steps)[::-1]
        return ahead + back, ahead, back


def fit_chain(codes: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 60, l2: float = 1e-2) -> Chain:
    """Maximises the likelihood of the labels given the words by gradient steps of adapted size (Adam)."""
    size = BUCKETS + 1
    x = np.zeros(2 + 4 + 3 * size)
    x[6] = -4.0

    def unpack(x: np.ndarray) -> Chain:
        return Chain(x[:2], x[2:6].reshape(2, 2), x[6 : 6 + size], x[6 + size : 6 + 2 * size], x[6 + 2 * size :])

    previous = np.where(first, 0, np.append(0, codes[:-1]))
    following = np.where(np.append(first[1:], True), 0, np.append(codes[1:], 0))
    y, inner = labels.astype(float), ~first
    real = np.zeros_like(x)
    real[:2] = np.bincount(labels[first], minlength=2)
    real[2:6] = np.bincount(2 * labels[:-1][inner[1:]] + labels[1:][inner[1:]], minlength=4)
    for at, c in enumerate((codes, previous, following)):
        real[6 + at * size : 6 + (at + 1) * size] = np.bincount(c, weights=y, minlength=size)
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        chain = unpack(x)
        odds, ahead, back = chain.marginals(codes, first)
        p = 1 / (1 + np.exp(-odds))
        e = chain.scores(codes, first)
        # Pairs: forward of t-1, move, score of t, backward of t; normalised over the four.
        pair = np.stack([i * ahead[:-1] + chain.move[i, j] + j * (e[1:] + back[1:]) for i in (0, 1) for j in (0, 1)])[:, inner[1:]]
        pair = np.exp(pair - pair.max(0))
        pair /= pair.sum(0)
        want = np.zeros_like(x)
        want[:2] = [(1 - p[first]).sum(), p[first].sum()]
        want[2:6] = pair.sum(1)
        for at, c in enumerate((codes, previous, following)):
            want[6 + at * size : 6 + (at + 1) * size] = np.bincount(c, weights=p, minlength=size)
        gradient = (real - want) / max(first.sum(), 1) - l2 * x / max(first.sum(), 1)
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        x = x + 0.3 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return unpack(x)


@dataclass
class Model:
    lexicon: dict[str, int]  # word -> bucket, 1..BUCKETS; at most LEXICON words
    chain: Chain
    weights: np.ndarray  # of a document's features

    def document_features(self, odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each document (its words from starts[i] to starts[i + 1]): 1, the expected number of toxic words
        as log(1 + n), its share of the words, and the highest marginal."""
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        sizes = np.diff(starts)
        full = np.flatnonzero(sizes)
        total, most = np.zeros(len(sizes)), np.zeros(len(sizes))
        if len(full):
            total[full] = np.add.reduceat(p, starts[full])
            most[full] = np.maximum.reduceat(p, starts[full])
        return np.stack([np.ones(len(sizes)), np.log1p(total), np.sqrt(total / np.maximum(sizes, 1)), most], axis=1)

    def codes_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = [tokens_of(t) for t in texts]
        starts = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
        get = self.lexicon.get
        codes = np.fromiter((get(x, 0) for w in words for x in w), dtype=np.int64, count=int(starts[-1]))
        first = np.zeros(len(codes), dtype=bool)
        first[starts[:-1][starts[:-1] < len(codes)]] = True
        return codes, first, starts

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """A score from 0 to 1 a text, and the offsets (start, end, marginal) of words likelier toxic than not."""
        codes, first, starts = self.codes_of(texts)
        odds = self.chain.marginals(codes, first)[0]
        scores = 1 / (1 + np.exp(-self.document_features(odds, starts) @ self.weights))
        spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        hits = np.flatnonzero(odds > 0)
        for i in np.unique(np.searchsorted(starts, hits, side="right") - 1):
            places = [m.span() for m in _tokens.finditer(lowered(texts[i]))]
            mine = hits[(hits >= starts[i]) & (hits < starts[i + 1])]
            spans[i] = [(*places[h - starts[i]], float(1 / (1 + np.exp(-odds[h])))) for h in mine]
        return scores, spans


    def fitted(self, y: np.ndarray, parts: list[np.ndarray]) -> Model:
        """The model with its chain and document weights fitted on documents' labels and codes."""
        if not self.lexicon or not y.any():
            prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -4.0
            return Model(self.lexicon, self.chain, np.array([prior, 0, 0, 0]))
        starts = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        codes = np.concatenate(parts)
        first = np.zeros(len(codes), dtype=bool)
        first[starts[:-1][starts[:-1] < len(codes)]] = True
        toxic = np.repeat(y, np.diff(starts)) * (codes > 0)
        chain = fit_chain(codes, toxic, first)
        features = self.document_features(chain.marginals(codes, first)[0], starts)
        return Model(self.lexicon, chain, _logistic(features, y.astype(float)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", fit_rows: dict[int, int] = FIT_ROWS) -> Model:
    """The model, from a bounded sample of the labelled rows that are not held out.

    Spark counts in how many toxic and ordinary documents of one half of the sample a word stands (equal texts
    once). Words that are much likelier in toxic ones are listed by that odds ratio; in toxic documents of the other half they
    are the labelled toxic words. The chain and the document weights are fitted on that half, so a word
    that was listed by chance weighs little. Labels that are null are left out. Without toxic rows all
    scores are the same.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    picks = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in fit_rows.items()]
    chosen = picks[0]
    for more in picks[1:]:
        chosen = chosen.union(more)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= FIT_CHARS)
    sample = saved(texts.join(F.broadcast(chosen), "id"), "toxicity-sample")  # at most sum(fit_rows) ids
    sample = sample.withColumn("half", F.crc32(F.col("text").cast("binary")) % 2)

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    listed = sample.filter("half = 0").dropDuplicates(["text"])
    sizes = {row["y"]: row["count"] for row in listed.groupBy("y").count().collect()}
    counts = listed.select("y", F.explode(words).alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ratio = F.log(((F.col("a") + 0.5) / (sizes.get(1, 0) + 1.0)) / ((F.col("b") + 0.5) / (sizes.get(0, 0) + 1.0)))
    strong = counts.filter("a >= 3").withColumn("ratio", ratio).filter(F.col("ratio") > 1.5)
    top = strong.orderBy((F.col("ratio") * F.sqrt("a")).desc(), "word").limit(LEXICON).collect()
    # Buckets by the lower end of the ratio, which is near the ratio only where there are many documents.
    sure = {row["word"]: row["ratio"] - 1.5 * np.sqrt(1 / (row["a"] + 0.5) + 1 / (row["b"] + 0.5)) for row in top}
    lexicon = {w: int(np.clip(np.ceil(v * 1.5), 1, BUCKETS)) for w, v in sure.items() if v > 0}
    blank = Model(lexicon, Chain(np.zeros(2), np.zeros((2, 2)), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)), np.zeros(4))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for y, text in zip(batch["y"], batch["text"], strict=True):
                codes = blank.codes_of([text])[0].astype(np.int8)
                yield pd.DataFrame({"y": [int(y)], "codes": [codes.tobytes()]})

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ys, parts = [], []
        for batch in batches:  # a byte a word of the bounded sample
            ys += batch["y"].tolist()
            parts += [np.frombuffer(c, dtype=np.int8).astype(np.int64) for c in batch["codes"]]
        yield pd.DataFrame({"model": [pickle.dumps(blank.fitted(np.array(ys, dtype=np.int64), parts))]})

    # One task fits the bounded sample, in an order that is the same each time.
    train = sample.filter("half = 1").select("y", "text").mapInPandas(coded, "y int, codes binary")
    models = train.repartition(1).sortWithinPartitions("y", "codes").mapInPandas(fitted, "model binary").collect()
    return pickle.loads(models[0].model) if models else blank.fitted(np.zeros(0, dtype=np.int64), [])


OUT = "score double, predicted int, spans array<struct<start:int,end:int,p:double>>"


def tag(docs: DataFrame, model: Model, *, text_col="text", score_col="score", predicted_col="predicted", spans_col="spans") -> DataFrame:
    """``docs`` with a score, 1 or 0 for a score of at least 0.5, and toxic spans (code points, end exclusive).

    Null and empty texts: the score of a text without words. Repeated rows: the same score. Empty
    table: no rows. Columns of these names in ``docs`` are replaced, others kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON words and a few dozen weights
    own = [score_col, predicted_col, spans_col]
    keep = [c for c in docs.columns if c not in own]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100].copy()
                scores, spans = held.value.score([t if isinstance(t, str) else None for t in part[text_col]])
                part[own[0]], part[own[1]] = scores, (scores >= 0.5).astype(np.int32)
                part[own[2]] = [[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans]
                yield part

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInPandas(rows, f"{schema}, `{own[0]}` double, `{own[1]}` int, `{own[2]}` array<struct<start:int,end:int,p:double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = tag(docs, fit(docs, table(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), offsets.alias("spans"))
