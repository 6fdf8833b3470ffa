"""Packing documents into as few fixed-length sequences as possible."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

CAPACITY = 4096
END = 1
#: Size classes of the linear program, of about as many pieces each; with no more lengths than that, each length is a class.
CLASSES = 64
#: The program leaves out pieces of less than this part of a sequence, which fit into what others leave.
SMALL = 32
#: Proven distance from the program's optimum at which the search ends.
GAP = 0.02


# --- tokens ---------------------------------------------------------------------------------------


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    White space always ends a token and is dropped, so a text's ids are those of the pieces between
    blanks, and frequent pieces come from a table of at most ``limit`` entries. Pieces of plain
    Latin letters, digits and punctuation are split by the tokenizer's own pattern and go to its
    model directly; any other piece goes through the whole tokenizer.
    """

    plain = re.compile(r"(?!.*<\|)[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]{1,64}").fullmatch
    split = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^a-z\xdf-\xf6\xf8-ſ0-9]+").findall

    def __init__(self, file: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(file), limit
        self.letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            seen = part if part.isascii() else self.letters.pre_tokenize_str(part)[0][0]
            found = np.array([t.id for t in self.tokenizer.model.tokenize(seen)], dtype="<u4").tobytes()
            if len(self.parts) < self.limit // 2:
                self.parts[part] = found
        return found

    def piece(self, piece: str) -> bytes:
        if self.plain(piece):
            found = b"".join(map(self.part, self.split(piece.lower())))
        else:
            found = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.pieces) < self.limit and len(piece) <= 64:
            self.pieces[piece] = found
        return found

    def __call__(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        found = list(map(self.pieces.get, pieces))
        if None in found:
            found = [self.piece(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)


@lru_cache(1)
def encoder(file: str) -> Encoder:
    return Encoder(file)


def token_pieces(docs: DataFrame, *, id_col="doc_id", text_col="text", capacity=CAPACITY, end=END, file: str | None = None, keep_ids=False) -> DataFrame:
    """(id, piece, start, length, ids_crc32), and ids as array<int> if asked for: each text's ids and
    the end id, cut only where they are more than ``capacity``. Null and empty texts: the end id alone.
    Repeated rows give repeated pieces. Empty table: no rows. Extra columns are left out."""
    file, kind = file or tokenizer_file(), docs.schema[id_col].dataType.simpleString()
    last, size = np.array([end], dtype="<u4").tobytes(), capacity * 4

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = encoder(file)
        for batch in batches:
            out, which = [], []
            for i, text in enumerate(batch["text"]):
                ids = ids_of(text or "") + last
                for n, at in enumerate(range(0, len(ids), size)):
                    cut = ids[at : at + size]
                    which.append(i)
                    out.append((n, at // 4, len(cut) // 4, zlib.crc32(cut), *([np.frombuffer(cut, dtype="<i4")] if keep_ids else [])))
            frame = pd.DataFrame(out, columns=["piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
            frame.insert(0, "id", batch["id"].iloc[which].to_numpy())
            yield frame

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(rows, schema).withColumnRenamed("id", id_col)


# --- the plan: all that follows works on counts of lengths, whatever the number of documents -------


def size_classes(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, demand): the greatest length of each class, ascending, and its pieces. Small pieces are left out."""
    lengths = np.nonzero(counts)[0]
    lengths = lengths[lengths >= max(1, capacity // SMALL)]
    if len(lengths) > CLASSES:
        upto = np.cumsum(counts[lengths])
        cut = np.searchsorted(upto, np.linspace(0, upto[-1], CLASSES + 1)[1:])
        sizes = lengths[np.unique(np.minimum(cut, len(lengths) - 1))]
    else:
        sizes = lengths
    return sizes, np.bincount(np.searchsorted(sizes, lengths), weights=counts[lengths], minlength=len(sizes))


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each class that fit in ``capacity`` and are worth most: an unbounded knapsack by dynamic programming."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if n := fitting[room]:
            offers = value[room - sizes[:n]] + prices[:n]
            best = int(offers.argmax())
            if offers[best] > value[room]:
                value[room], take[room] = offers[best], best
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            counts[take[room]] += 1
            room -= sizes[take[room]]
    return counts


def fractional_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """([(configuration, how many)], bound): configurations that cover ``demand`` with at most 1 + ``gap`` times as many bins as any
    fractional covering needs; bound is what it needs at least, as prices prove.

    Multiplicative weights on the covering program, as a game of class prices against the configurations found so far: a class's price falls
    with its cover, a configuration's weight rises with its worth, each step looking ahead by the last one's change. Dynamic programming finds the configuration worth
    most at the prices, among all there are: it joins the game, and by duality the demand's worth over its own is a bound. Every class has a configuration
    of its own from the start, so all is covered. Rounds go on until the gap is proven; where no new configuration turns up, they are made longer.
    """
    m = len(sizes)
    found = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    seen = {c.tobytes() for c in found}
    weights = demand / (capacity // sizes)
    weights, prices = weights / weights.sum(), np.full(m, 1.0 / m)
    best, bound, steps = (np.inf, weights), 0.0, 200
    while True:
        cover = np.stack(found, 1) / demand[:, None]
        log_p, log_w = np.log(np.maximum(prices, 1e-12)), np.log(np.maximum(weights, 1e-12))
        mean_p, mean_w, last = np.zeros(m), np.zeros(len(found)), None
        for step in range(steps):
            prices, weights = np.exp(log_p - log_p.max()), np.exp(log_w - log_w.max())
            prices, weights = prices / prices.sum(), weights / weights.sum()
            covered, worth = cover @ weights, prices @ cover
            value = max(float(prices @ covered), 1e-300)
            covered, worth = covered / value, worth / value
            size = 0.5 / max(1.0, covered.max(), worth.max())
            was_covered, was_worth = last or (covered, worth)
            log_p -= size * (2 * covered - was_covered)
            log_w += size * (2 * worth - was_worth)
            last = covered, worth
            if step >= steps // 2:
                mean_p, mean_w = mean_p + prices, mean_w + weights
        mean_p, mean_w = mean_p / mean_p.sum(), mean_w / mean_w.sum()
        for w in (mean_w, weights):
            if (least := float((cover @ w).min())) > 0 and 1 / least < best[0]:
                best = 1 / least, w / least
        new = 0
        for p in (mean_p, prices):
            config = best_configuration(p / demand, sizes, capacity)
            bound = max(bound, 1.0 / float(p / demand @ config))
            if config.tobytes() not in seen:
                seen.add(config.tobytes())
                found.append(config)
                new += 1
        if best[0] <= (1 + gap) * bound:
            return [(c, float(n)) for c, n in zip(found, best[1], strict=False) if n > 0], bound
        steps, prices = steps if new else steps * 2, mean_p
        weights = np.concatenate([mean_w * (1 - 0.02 * new), np.full(new, 0.02)])


class _Left:
    """Counts of the lengths left, and the largest one left that is no more than a given size."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.down = counts.astype(np.int64).copy(), np.arange(len(counts))

    def most(self, size: int) -> int:
        root = size
        while root > 0 and self.counts[root] <= 0:
            root = self.down[root] if self.down[root] != root else root - 1
        while size > root:  # shorten the way
            self.down[size], size = root, (self.down[size] if self.down[size] != size else size - 1)
        return int(root)


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY, share: float = 1.0) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: pieces in each}) that hold every piece exactly once; counts[l] pieces
    are l long.

    ``share`` of each fractional configuration is rounded down, largest multiple first. A configuration
    becomes a bin by giving each of its classes the longest piece left in that class, the last one the
    longest piece that fits; one that the pieces left no longer fill is given up. Pieces that no rounded configuration took go, longest first, to the open bin
    with the least room, or to new ones. Bins that are alike are one row throughout, so rows and time
    grow with the number of lengths, not of pieces.
    """
    sizes, demand = size_classes(counts, capacity)
    configs = fractional_configurations(sizes, demand, capacity)[0] if len(sizes) else []
    left = _Left(counts)
    rooms: list[int] = []  # sorted; those that have open bins
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}

    def keep(room: int, times: int, bin_: dict[int, int]) -> None:
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((times, bin_))

    for config, times in sorted(configs, key=lambda x: (-x[1], x[0].tobytes())):
        bins, classes = int(times * share), np.repeat(sizes, config)[::-1].tolist()
        while bins > 0:
            room, bin_ = capacity, {}
            for n, size in enumerate(classes, 1):
                l = room if n == len(classes) else min(size, room)
                while (l := left.most(l)) and left.counts[l] <= bin_.get(l, 0):
                    l -= 1
                if l:
                    bin_[l] = bin_.get(l, 0) + 1
                    room -= l
            if not bin_ or room > capacity // 64:  # the pieces left no longer make this configuration
                break
            alike = min(bins, *(int(left.counts[l]) // n for l, n in bin_.items()))
            for l, n in bin_.items():
                left.counts[l] -= alike * n
            keep(room, alike, bin_)
            bins -= alike
    for l in np.nonzero(left.counts)[0][::-1].tolist():
        n = int(left.counts[l])
        while n:
            if (at := bisect_left(rooms, l)) < len(rooms):
                room = rooms[at]
                times, bin_ = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, times, bin_ = capacity, n, {}
            each = min(room // l, n)
            used = min(times, n // each)
            if bin_ and used < times:
                keep(room, times - used, bin_)
            keep(room - each * l, used, bin_ | {l: bin_.get(l, 0) + each})
            n -= used * each
    return [x for room in rooms for x in open_[room]]


def places(plan: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """A row a bin row and length: pieces of that length with ranks from ``first`` go to sequences from
    ``sequence``, ``each`` to a sequence, from ``offset`` on."""
    out, first, sequence = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for l, n in sorted(bin_.items(), reverse=True):
            out.append((l, first.get(l, 0), sequence, n, offset))
            first[l] = first.get(l, 0) + times * n
            offset += l * n
        sequence += times
    return pd.DataFrame(out, columns=["length", "first", "sequence", "each", "offset"]).astype("int64").sort_values(["length", "first"], kind="stable")


def pack(pieces: DataFrame, *, id_col="doc_id", capacity=CAPACITY) -> DataFrame:
    """The pieces (saved rows with piece, length and ids_crc32) with sequence_id and offset.

    Only the histogram of lengths, ``capacity`` numbers at most, goes to the driver, and the plan made
    from it, which grows with the number of lengths and not of documents, goes to the tasks. Pieces get
    a rank among those of their length in two steps, so no task ranks all of a frequent length.
    """
    spark = pieces.sparkSession
    lengths = saved(pieces.groupBy("length").count(), "packing-lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in lengths.collect():
        counts[row["length"]] = row["count"]
    plan = places(pack_counts(counts, capacity))
    names = ["length", "first", "sequence", "each", "offset"]
    table_of = spark.sparkContext.broadcast([plan[c].to_numpy() for c in names])

    parts = lengths.select("length", F.ceil(F.col("count") / 128).alias("parts"))
    dealt = pieces.join(F.broadcast(parts), "length")  # at most ``capacity`` rows
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    before = dealt.groupBy("length", "part").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy(id_col, "piece", "ids_crc32"))
    ranked = dealt.withColumn("rank", inside).join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before") - 1).drop("part", "before")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, sequence, each, offset = table_of.value
        big = 1 << 45
        keys = length * big + first
        for batch in batches:
            l, rank = batch["length"].to_numpy("int64"), batch["rank"].to_numpy("int64")
            k = np.searchsorted(keys, l * big + rank, side="right") - 1
            ahead = rank - first[k]
            batch["sequence_id"] = sequence[k] + ahead // each[k]
            batch["offset"] = offset[k] + ahead % each[k] * l
            yield batch.drop(columns="rank")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(rows, schema + ", sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def packed(docs: DataFrame, **options) -> DataFrame:
    return pack(saved(token_pieces(docs, **options), "packing-pieces"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
