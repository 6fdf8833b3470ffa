"""Near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, saved, table

K = 5
#: Sketches a text, and minima in each. Texts that share a part J of their five-word shingles agree in one
#: sketch with about J**2. Of pairs with as many scattered substitutions as a similarity of 0.80 allows, 0.94 to
#: 0.97 share a sketch at 64 to 1500 words (tests/llm asks for 0.9 at each length).
SKETCHES = 84
MINIMA = 2
#: A few edits can take every five-word shingle of a short text: texts of fewer words than the first number have
#: sketches of shingles of as many words as the second says besides, as many as the third.
SHORT = [(128, 3, 8), (64, 2, 16), (12, 1, 8)]
SLOTS = SKETCHES + sum(n for _, _, n in SHORT)
#: Bits of a bucket's key that are its slot.
SLOT_BITS = 7
#: Bins of the word counts that rule out pairs.
BINS = 256
#: Texts of a bucket that are compared in one place, with each other or with as many more. 0.01 GB at 2 kB a text.
BLOCK = 2048
#: Rows with texts or their codes that a Python worker holds at once.
ROWS = 1000
#: Least edit similarity: 1 - edits / words of the longer text.
SIMILARITY = 0.8

_normal = re.compile(r"[^\W_]+").findall
_seeds = np.random.default_rng(20240101).integers(0, 2**31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


class _Codes(dict):
    """64-bit hashes of words; keeps at most ``limit``."""

    limit = 100_000

    def __missing__(self, word: str) -> int:
        code = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = code
        return code


_codes = _Codes()


def word_codes(text: str | None) -> np.ndarray:
    """Hashes of the text's words, lower case, letters and digits only; of the characters that are
    left if it has no such word."""
    words = _normal((text or "").lower()) or (text or "").split()
    return np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def occurrence_kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its number among its equals, so that no two are equal.
    A text of fewer than k words is one k-mer."""
    if len(codes) < k:
        codes = np.concatenate([codes, np.zeros(k - len(codes), dtype=np.uint64)])
    grams = np.zeros(len(codes) - k + 1, dtype=np.uint64)
    for i in range(k):
        grams = _mix(grams + codes[i : i + len(grams)])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if new.all():
        return grams
    first = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    number = np.empty(len(grams), dtype=np.uint64)
    number[order] = np.arange(len(grams)) - first
    # A first one keeps its hash, so that texts with and without repeats share it.
    return np.where(number == 0, grams, _mix(grams + number))


def order_minhash(codes: np.ndarray, sketches: int = SKETCHES, minima: int = MINIMA, k: int = K) -> np.ndarray:
    """For each hash function, the ``minima`` least k-mers in the order they have in the text, as one number."""
    kmers = occurrence_kmers(codes, k)
    high = (kmers >> np.uint64(32)).astype(np.uint32)
    out = []
    step = max(1, 2_000_000 // len(kmers))
    for at in range(0, sketches, step):
        hashed = high[None, :] * _seeds[at : min(at + step, sketches), None]
        rows = np.arange(len(hashed))
        places = []
        for _ in range(min(minima, len(kmers))):
            places.append(least := hashed.argmin(1))
            hashed[rows, least] = np.uint32(2**32 - 1)
        sketch = np.zeros(len(hashed), dtype=np.uint64)
        for column in np.sort(np.stack(places), axis=0):
            sketch = _mix(sketch + kmers[column])
        out.append(sketch)
    return np.concatenate(out).view(np.int64)


def sketches_of(codes: np.ndarray) -> np.ndarray:
    """The sketches of a text by slot; a short one has further slots."""
    more = [order_minhash(codes, n, k=k) for words, k, n in SHORT if len(codes) < words]
    return np.concatenate([order_minhash(codes), *more])


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits from a to b, if no more than ``most``.

    Alignment within a band around the diagonal that starts narrow and is widened until the distance
    lies in it.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    both, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    bags = np.bincount(ids[: len(a)], minlength=len(both)) - np.bincount(ids[len(a) :], minlength=len(both))
    if max(bags[bags > 0].sum(), -bags[bags < 0].sum()) > most:  # words without a partner
        return None
    x, y = ids[: len(a)].tolist(), ids[len(a) :].tolist()
    band = min(most, max(24, len(x) - len(y)))
    while (found := _within(x, y, band)) is None and band < most:
        band = min(most, band * 4)
    return found


def _within(x: list[int], y: list[int], band: int) -> int | None:
    """The distance if it is at most ``band``, which is at least len(x) - len(y), and that at least 0.

    Columns of the edit table as bits: bit b of column j is row j - band + b, so that a diagonal keeps
    its bit. vp and vn hold where the table rises and falls down a column, d0 where a diagonal step
    costs nothing; the score is followed along the diagonal that ends in the last cell.
    """
    width = 2 * band + 1
    mask, score = (1 << width) - 1, len(x) - len(y)
    goal = 1 << (band + score)
    vp, vn = mask ^ ((1 << band) - 1), 0
    block = max(1024, width)
    for start in range(0, len(y), block):
        base, places = start - band, {}
        for row in range(max(0, base), min(len(x), start + block + band)):
            places[x[row]] = places.get(x[row], 0) | 1 << (row - base)
        for n, item in enumerate(y[start : start + block]):
            equal = (places.get(item, 0) >> n) & mask
            d0 = ((((equal & vp) + vp) ^ vp) | equal | vn) & mask
            hp, hn = vn | (mask ^ (d0 | vp)), d0 & vp
            if not d0 & goal:
                score += 1
                if score > band:
                    return None
            down = d0 >> 1
            vp, vn = hn | (mask ^ (down | hp)), down & hp
    return score


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """1 - edits / words of the longer one, if it is at least ``least``."""
    longer = max(len(a), len(b))
    edits = edit_distance(a, b, int((1 - least) * longer + 1e-9))
    return None if edits is None else 1.0 - edits / max(longer, 1)


def fingerprint(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _codes_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint32)


def links_across(cell: pd.DataFrame, least: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """(a, b, similarity): links between texts of a bucket, enough to connect those of the cell that are alike and have this
    bucket's slot as the first one that they share.

    ``cell`` has uid, root, block, slot, words, codes, sketch. Texts of one root are connected already. If the cell has two
    blocks, only pairs across them are looked at. Word counts in BINS bins rule out a pair if they differ by more than the
    edits allowed; what is left is aligned, unless links of this cell have connected it by then.
    """
    cell = cell.sort_values("words", kind="stable")
    n, slot = len(cell), int(cell["slot"].iloc[0])
    uid, root, block, words = (cell[c].to_numpy() for c in ("uid", "root", "block", "words"))
    across = cell["i"].iloc[0] != cell["j"].iloc[0]
    codes = [_codes_of(x) for x in cell["codes"]]
    fine = np.stack([np.bincount(c % BINS, minlength=BINS) for c in codes]).astype(np.int32)
    coarse = fine.reshape(n, 16, -1).sum(2, dtype=np.int32)
    sketch = np.zeros((n, SLOTS), dtype=np.int64)
    size = np.array([len(x) for x in cell["sketch"]])
    for i, x in enumerate(cell["sketch"]):
        sketch[i, : size[i]] = x
    found, parent = [], {}

    def head(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for far in range(1, n):
        p = np.arange(n - far)
        p = p[words[p + far] - words[p] <= np.floor(words[p + far] * (1 - least) + 1e-9)]
        if not len(p):  # texts are in the order of their words
            break
        p = p[(root[p] != root[p + far]) & ~(across & (block[p] == block[p + far]))]
        for at in range(0, len(p), 10_000):
            x = p[at : at + 10_000]
            y = x + far
            for bags in (coarse, fine):
                allowed = np.floor(words[y] * (1 - least) + 1e-9)
                more = np.maximum(bags[y] - bags[x], 0).sum(1)  # the longer text has words[y] - words[x] more at least
                fits = more <= allowed
                x, y = x[fits], y[fits]
            # A slot that one of the two lacks is no slot that they share.
            both = (sketch[x] == sketch[y]) & (np.arange(sketch.shape[1]) < np.minimum(size[x], size[y])[:, None])
            first = both.argmax(1) == slot
            for u, v in zip(x[first].tolist(), y[first].tolist(), strict=True):
                ru, rv = head(int(root[u])), head(int(root[v]))
                if ru != rv and (alike := similarity(codes[u], codes[v], least)) is not None:
                    parent[max(ru, rv)] = min(ru, rv)
                    found.append((int(uid[u]), int(uid[v]), alike))
    return found


def cells_of(rows: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(key, slot, uid, root, block, i, j): the cells, pairs of blocks (i, j) of a bucket, in which each text of it is compared.

    ``rows`` has key, n (the bucket's texts), slot, uid, root. A bucket of BLOCK texts or fewer is one block. In others a block is one of a class of word counts that
    alike texts leave by one step at most, and meets blocks of its own class and the next ones only; a block's number is that of its class and, in the lower half, its own.
    """
    one = rows.filter(F.col("n") <= BLOCK).select("key", "slot", "uid", "root", *(F.lit(0).cast("long").alias(c) for c in ("block", "i", "j")))
    step = -np.log(least) * 1.001
    many = rows.filter(F.col("n") > BLOCK).join(words, "uid").withColumn("class", F.floor(F.log(F.greatest("words", F.lit(1))) / step).cast("long"))
    sizes = many.groupBy("key", "class").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    near = sizes.select("key", F.explode(F.array(*(F.struct((F.col("class") + by).alias("class"), F.lit(by).alias("by")) for by in (-1, 0, 1)))).alias("to"), "blocks")
    near = near.groupBy("key", F.col("to.class").alias("class")).agg(*(F.max(F.when(F.col("to.by") == by, F.col("blocks"))).alias(name) for by, name in ((1, "lower"), (0, "own"), (-1, "upper"))))
    near = saved(near.filter("own is not null"), "dedup-classes")  # so that the join on a large bucket can be split
    number = lambda c, b: F.shiftleft(c, 32) + b

    def others_of(name: str, by: int) -> Column:
        blocks = F.when(F.col(name).isNotNull(), F.sequence(F.lit(0).cast("long"), F.col(name) - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(blocks, lambda b: number(F.col("class") + by, b))

    others = F.concat(others_of("lower", -1), others_of("own", 0), others_of("upper", 1))
    many = many.join(near, ["key", "class"]).withColumn("block", number(F.col("class"), F.pmod(F.xxhash64("uid"), "own")))
    many = many.select("key", "slot", "uid", "root", "block", F.explode(others).alias("other"))
    return one.union(many.select("key", "slot", "uid", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))


def near_links(slots: DataFrame, held_of: Callable[[DataFrame], DataFrame], least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity): verified links between distinct texts, enough to connect all that share a sketch and are alike;
    and (node, root): the component of each text that has a link.

    ``slots`` has (key, uid), a row a text and sketch, the key's last SLOT_BITS being the slot; ``held_of`` takes uids to (uid, words, codes, sketch).

    First each text is compared with the least and the greatest uid of each of its buckets, and what is alike is one
    component. Then, in every bucket that still holds several components, all pairs of texts of different components are
    compared where they meet, in cells of two blocks of the bucket at most; a pair that shares several buckets is looked at in
    the first of them only. So each pair that shares a sketch is in one component or has been ruled out, and no partner is left
    out, however large a bucket. Only links leave a cell. A bucket's cells grow with the square of the texts in it that are
    *not* alike and of about one length, divided by BLOCK squared.
    """
    ends = slots.groupBy("key").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).filter("lo <> hi")
    ends = saved(ends, "dedup-ends")  # so that the join on a large bucket can be split
    met = saved(slots.join(ends, "key"), "dedup-met")
    discard(ends)
    held = saved(held_of(met.select("uid").distinct()), "dedup-held", ROWS)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["similarity"] = pd.array([similarity(_codes_of(x), _codes_of(y), least) for x, y in zip(batch["x"], batch["y"], strict=True)], dtype="Float64")
            yield batch.loc[batch["similarity"].notna(), ["a", "b", "similarity"]]

    to = lambda end: met.filter(F.col("uid") != F.col(end)).select(F.least("uid", end).alias("a"), F.greatest("uid", end).alias("b"))
    pairs = saved(to("lo").union(to("hi")).distinct(), "dedup-pairs")
    with_b = pairs.join(held.select(F.col("uid").alias("b"), F.col("codes").alias("y")), "b")
    both = with_b.join(held.select(F.col("uid").alias("a"), F.col("codes").alias("x")), "a").select("a", "b", "x", "y")
    near = saved(both.mapInPandas(verify, "a long, b long, similarity double"), "dedup-near", ROWS)
    discard(pairs)

    roots = components(near, "a", "b", "dedup-rooted")
    placed = saved(met.select("key", "uid").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")), "dedup-placed")
    discard(met)
    mixed = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "n")
    mixed = saved(mixed, "dedup-mixed")
    slot = F.col("key").bitwiseAND(F.lit(2**SLOT_BITS - 1)).cast("int")
    cells = cells_of(placed.join(mixed, "key").withColumn("slot", slot), held.select("uid", "words"), least).join(held, "uid")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # a cell that the next batch may go on with
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            *done, (_, rest) = rest.groupby(["key", "i", "j"], sort=False)
            for _, cell in done:
                yield pd.DataFrame(links_across(cell, least), columns=["a", "b", "similarity"])
        if rest is not None:
            yield pd.DataFrame(links_across(rest, least), columns=["a", "b", "similarity"])

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    far = dealt.mapInPandas(whole, "a long, b long, similarity double")
    far = saved(far.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), "dedup-far", ROWS)
    discard(placed, held, mixed)
    joined = components(roots.union(far.select("a", "b")), "node", "root", "dedup-components")
    discard(roots)
    return near.union(far), joined


def classes(docs: DataFrame, *, id_col="doc_id", text_col="text", least: float = SIMILARITY) -> DataFrame:
    """(id, fp, class_id, n_links, first): each row's class of near duplicates.

    Equal texts are one text (of the least id) before anything is compared. class_id is the least id of
    the class, n_links the verified links of the row's text, first whether the text stands for its class
    with that id. Null text counts as empty; rows with empty texts are one class. Null ids: last; a class of
    null ids only has a null class_id. Repeated rows share their class, and ``first`` too. Empty table:
    no rows. Extra columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sketch"] = [sketches_of(word_codes(t)) for t in batch["text"]]
            yield batch[["id", "fp", "sketch"]]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [word_codes(t) for t in batch["text"]]
            batch["words"] = [len(c) for c in codes]
            batch["codes"] = [(c >> np.uint64(32)).astype(np.uint32).tobytes() for c in codes]
            yield batch[["uid", "words", "codes", "sketch"]]

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    rows = saved(picked.mapInPandas(sketch, f"id {kind}, fp binary, sketch array<bigint>"), "dedup-rows", ROWS)
    texts = rows.groupBy("fp").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"))
    texts = saved(texts.withColumn("uid", F.monotonically_increasing_id()), "dedup-texts")
    discard(rows)

    def held_of(uids: DataFrame) -> DataFrame:
        """One row of each text: one with its least id."""
        wanted = texts.join(uids, "uid").select(F.col("fp").alias("want fp"), F.col("id").alias("want id"), "uid", "sketch")
        found = picked.join(wanted, (F.col("fp") == F.col("want fp")) & F.col("id").eqNullSafe(F.col("want id")))
        once = found.groupBy("uid").agg(F.first("text").alias("text"), F.first("sketch").alias("sketch"))
        return once.mapInPandas(packed, "uid long, words long, codes binary, sketch array<bigint>")

    key = F.xxhash64("slot", "h").bitwiseAND(F.lit(-(2**SLOT_BITS))).bitwiseOR(F.col("slot").cast("long"))
    slots = texts.select("uid", F.posexplode("sketch").alias("slot", "h")).select(key.alias("key"), "uid")
    links, roots = near_links(slots, held_of, least)
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    labelled = (
        texts.select("uid", "fp", "id")
        .join(roots.withColumnRenamed("node", "uid"), "uid", "left")
        .join(degree, "uid", "left")
        .select("fp", "id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    labelled = saved(labelled, "dedup-labelled")
    discard(texts, links, roots)
    # Heads are written, so that the join on a large class can be split.
    heads = saved(labelled.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "fp")).alias("head")), "dedup-heads")
    classed = labelled.join(heads, "root").select("fp", "n_links", F.col("head.id").alias("class_id"), (F.col("head.fp") == F.col("fp")).alias("chosen"))
    return picked.select("id", "fp").join(classed, "fp").select(
        F.col("id").alias(id_col), "fp", "class_id", "n_links", (F.col("chosen") & F.col("id").eqNullSafe(F.col("class_id"))).alias("first")
    )


def one_of_each(docs: DataFrame, *, id_col="doc_id", text_col="text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their class, one a class, with all their columns."""
    first = classes(docs, id_col=id_col, text_col=text_col, least=least).filter("first").select("fp", F.col(id_col).alias("id")).distinct()
    held = docs.select(fingerprint(F.col(f"`{text_col}`")).alias("fp"), F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = held.join(first.select(F.col("fp").alias("first fp"), F.col("id").alias("first id")), (F.col("fp") == F.col("first fp")) & F.col("id").eqNullSafe(F.col("first id")), "left_semi")
    # Of rows that repeat an id and a text, the least by their other columns as text stays.
    others = F.to_json(F.array(*[F.coalesce(F.col("row").getField(c).cast("string"), F.lit("")) for c in docs.columns if c not in (id_col, text_col)], F.lit("")))
    return kept.groupBy("fp", "id").agg(F.min_by("row", others).alias("row")).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", F.col("first").alias("is_kept"))
