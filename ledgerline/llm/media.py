"""Copies of images, cropped or edited, by local descriptors and geometric consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, saved, table

#: The strongest corners of each scale of an image, and the least number of matches that agree on one shift.
CORNERS = 20
SCALES = (1, 2)
AGREE = 4
PATCH = 7
BITS = 128
ANGLES = 16
#: Hamming tables: descriptors that differ in fewer bits than there are tables agree in one.
TABLES = 4

_rng = np.random.default_rng(4096)
_tests = np.clip(np.rint(_rng.normal(0, PATCH / 2.2, (BITS, 2, 2))), -PATCH + 2, PATCH - 2)


def _rotated() -> np.ndarray:
    """The tests' points for each angle: (angle, bit, point, y or x)."""
    out = []
    for k in range(ANGLES):
        c, s = np.cos(2 * np.pi * k / ANGLES), np.sin(2 * np.pi * k / ANGLES)
        out.append(np.clip(np.rint(_tests @ np.array([[c, -s], [s, c]]).T), -PATCH, PATCH))
    return np.array(out, dtype=np.int64)


_points = _rotated()
_disc = np.array([(y, x) for y in range(-PATCH, PATCH + 1) for x in range(-PATCH, PATCH + 1) if x * x + y * y <= PATCH * PATCH])


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """The pixels, or None for anything but a binary greyscale PGM of one byte a pixel."""
    try:
        head, pixels = bytes(data).split(b"\n", 1)
        kind, width, height, top = head.split()
        if kind != b"P5" or top != b"255" or len(pixels) != int(width) * int(height):
            return None
        return np.frombuffer(pixels, dtype=np.uint8).reshape(int(height), int(width))
    except (ValueError, TypeError):
        return None


def _smooth(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
    p = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]) / 16


def descriptors(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """For images of one size (n, height, width): image number, scale, y and x in full size, angle, and the
    descriptor as TABLES keys of BITS / TABLES bits, for the strongest Harris corners of each scale."""
    parts = []
    for scale in SCALES:
        n, h, w = images.shape
        x = images[:, : h // scale * scale, : w // scale * scale].astype(np.float32)
        x = x.reshape(n, h // scale, scale, w // scale, scale).mean((2, 4))
        n, h, w = x.shape
        edge = PATCH + 1
        if h <= 2 * edge or w <= 2 * edge:
            continue
        x = _smooth(x)
        gy, gx = np.gradient(x, axis=1), np.gradient(x, axis=2)
        a, b, c = _smooth(gy * gy), _smooth(gx * gx), _smooth(gy * gx)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        p = np.pad(r, ((0, 0), (2, 2), (2, 2)), constant_values=-np.inf)
        near = np.max([p[:, i : i + h] for i in range(5)], axis=0)
        near = np.max([near[:, :, i : i + w] for i in range(5)], axis=0)
        r = np.where((r == near) & (r > 1e-3), r, 0)[:, edge:-edge, edge:-edge]
        flat = r.reshape(n, -1)
        k = min(CORNERS, flat.shape[1])
        top = np.argpartition(-flat, k - 1, axis=1)[:, :k]
        at = np.repeat(np.arange(n), k)
        top = top.reshape(-1)
        real = flat[at, top] > 0
        at, top = at[real], top[real]
        ys, xs = top // r.shape[2] + edge, top % r.shape[2] + edge
        disc = x[at[:, None], ys[:, None] + _disc[:, 0], xs[:, None] + _disc[:, 1]]
        angle = np.arctan2(disc @ _disc[:, 0].astype(np.float32), disc @ _disc[:, 1].astype(np.float32))
        turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(np.int64) % ANGLES
        points = _points[turn]
        values = x[at[:, None, None], ys[:, None, None] + points[..., 0], xs[:, None, None] + points[..., 1]]
        bits = values[:, :, 0] < values[:, :, 1]
        keys = np.packbits(bits.reshape(len(at), TABLES, BITS // TABLES), axis=2).view(">u4")[:, :, 0].astype(np.int64)
        parts.append((at, np.full(len(at), scale), ys * scale, xs * scale, turn, keys))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, np.zeros((0, TABLES), dtype=np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


CORNER = "struct<scale:int,y:int,x:int,angle:int,tables:array<bigint>>"


def local_descriptors(images: DataFrame) -> DataFrame:
    """(id, image, corners) of (id, content): the content's hash and its corners; what can't be decoded has none."""
    kind = images.schema["id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            corners: list[list[dict]] = [[] for _ in range(len(batch))]
            by_shape: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
            for i, content in enumerate(batch["content"]):
                if (pixels := decode_pgm(content)) is not None and pixels.size:
                    by_shape.setdefault(pixels.shape, []).append((i, pixels))
            for group in by_shape.values():
                for i in range(0, len(group), 64):
                    where = [n for n, _ in group[i : i + 64]]
                    at, scale, y, x, angle, keys = descriptors(np.stack([p for _, p in group[i : i + 64]]))
                    for n, *rest in zip(at.tolist(), scale.tolist(), y.tolist(), x.tolist(), angle.tolist(), keys.tolist(), strict=True):
                        corners[where[n]].append(dict(zip(("scale", "y", "x", "angle", "tables"), rest, strict=True)))
            batch["corners"] = corners
            yield batch[["id", "image", "corners"]]

    hashed = images.select("id", "content", F.unhex(F.coalesce(F.sha1("content"), F.lit(""))).alias("image"))
    return hashed.mapInPandas(rows, f"id {kind}, image binary, corners array<{CORNER}>")


#: Bits of a coordinate. Coordinates, and so shifts, are kept modulo 2 ** SIDE_BITS.
SIDE_BITS = 14
_SPOT_BITS = 2 * SIDE_BITS + 1


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows, saved, with uid from 0 without gaps; what the driver holds is one count for each partition."""
    df = saved(df.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))), name)
    counts = sorted(df.groupBy("part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(starts, "part int, start long")
    return df.join(F.broadcast(start), "part").withColumn("uid", F.col("start") + F.col("at")).drop("part", "at", "start")


def _agreed(met: DataFrame) -> DataFrame:
    """(a, b): the images of matched corners (p, q) that have AGREE votes for one shift. A match votes for the shift that
    takes one corner to the other, in both of two overlapping grids; matches are dealt once, by their two
    images, and all counting happens where they land."""
    low = 2**SIDE_BITS - 1
    uid = lambda c: F.shiftright(c, _SPOT_BITS)
    met = met.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    shift = lambda bits: (F.shiftright("p", bits) - F.shiftright("q", bits)).bitwiseAND(F.lit(low))
    spot = F.col("p").bitwiseAND(F.lit(2**_SPOT_BITS - 1))
    match = F.shiftleft(spot, 2 * SIDE_BITS) + F.shiftleft(shift(SIDE_BITS), SIDE_BITS) + shift(0)
    pairs = met.select(uid("p").alias("a"), uid("q").alias("b"), match.alias("m")).repartition("a", "b").distinct()
    votes = pairs.select("a", "b", "m", F.explode(F.array(F.lit(0), F.lit(2))).alias("g"))
    cell = lambda bits: F.shiftright((F.shiftright("m", bits) + F.col("g")).bitwiseAND(F.lit(low)), 2)
    votes = votes.select("a", "b", "g", cell(SIDE_BITS).alias("cy"), cell(0).alias("cx"), F.shiftright("m", 2 * SIDE_BITS).alias("spot")).distinct()
    agree = votes.groupBy("a", "b", "g", "cy", "cx").count()
    return agree.filter(F.col("count") >= AGREE).select("a", "b").distinct()


#: Corners of a bucket that are matched with each other in one place, at least, and the most blocks of a bucket: its blocks grow with it, so that a corner is copied at most FAN times.
BLOCK = 2048
FAN = 16


def dealt(rooted: DataFrame) -> DataFrame:
    """(key, s, i, j, block, p, root, bits): the corners (key, s, p, root, bits) of buckets (key, s) that hold several components, in cells (i, j) where any two of a bucket's blocks meet."""
    mixed = rooted.groupBy("key", "s").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    mixed = mixed.select("key", "s", F.least(F.ceil(F.col("n") / BLOCK), F.lit(FAN).cast("long")).alias("blocks"))
    left = rooted.join(mixed, ["key", "s"]).withColumn("block", F.pmod(F.xxhash64("p"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return left.withColumn("other", other).select("key", "s", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "p", "root", "bits")


def seen(rooted: DataFrame) -> DataFrame:
    """(key, s, p, root, bits): the corners (key, s, p, root) that may make a link, under buckets of two components each: key is (key, the two). bits holds 1 for those whose image has AGREE corners or more that
    share a bucket with the other component, of which AGREE may agree; others are there to be met. A link's votes are counted on the corners of the lesser image, so these alone must be so many."""
    roots = rooted.select("key", "s", "root").distinct()
    several = roots.groupBy("key", "s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "s")
    others = roots.join(several, ["key", "s"]).withColumnRenamed("root", "other")
    faces = saved(rooted.join(others, ["key", "s"]).filter("root <> other"), "media-faces").withColumn("uid", F.shiftright("p", _SPOT_BITS))
    lit = saved(faces.groupBy("uid", "root", "other").agg(F.count_distinct("p").alias("n")).filter(F.col("n") >= AGREE).select("uid", "root", "other"), "media-lit")
    pair = lambda: (F.least("root", "other").alias("one"), F.greatest("root", "other").alias("two"))
    near = faces.withColumns({"one": F.least("root", "other"), "two": F.greatest("root", "other")}).join(lit.select(*pair()).distinct(), ["one", "two"])
    told = near.join(lit.select("uid", "other", F.lit(1).alias("lit")), ["uid", "other"], "left")
    return told.select(F.struct("key", "one", "two").alias("key"), "s", "p", "root", F.array(F.coalesce("lit", F.lit(0))).alias("bits"))


def copy_links(found: DataFrame) -> DataFrame:
    """(a, b): of images (uid, corners), those of which at least AGREE corners match at one scale and shift, enough
    to connect all that do.

    A corner travels as one long, its image's gapless uid above its scale, y and x. Each Hamming table is a
    join on a quarter of the bits. First every descriptor of a bucket is matched with the bucket's least and
    greatest image, so a bucket of n descriptors gives at most 2n matches, and the images that agree are one component.
    Then every corner looks at the other components that its buckets hold at its scale, one row a component however many images that has. An image that sees a component with fewer
    than AGREE of its corners has no link to it; of the others all corners are matched with the component's where they meet, in blocks (``dealt``). A match is the same in both steps: one table's key.
    """
    low = 2**SIDE_BITS - 1
    side = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(low))
    corner = F.shiftleft(F.col("uid"), _SPOT_BITS) + F.shiftleft((F.col("c.scale") - 1).cast("long"), 2 * SIDE_BITS) + F.shiftleft(side("c.y"), SIDE_BITS) + side("c.x")
    slots = found.select("uid", F.explode("corners").alias("c")).select(corner.alias("p"), F.posexplode("c.tables").alias("t", "key"))
    slots = slots.select("p", (F.col("key") * TABLES + F.col("t")).alias("key"))  # a key has 32 bits
    uid = lambda c: F.shiftright(c, _SPOT_BITS)
    scale = lambda c: F.shiftright(c, 2 * SIDE_BITS).bitwiseAND(F.lit(1))
    ends = slots.groupBy("key").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).filter(uid("lo") != uid("hi"))
    met = slots.join(ends, "key").select("p", F.explode(F.array("lo", "hi")).alias("q"))
    first = saved(_agreed(met.filter((uid("p") != uid("q")) & (scale("p") == scale("q")))), "media-first")

    roots = components(first, "a", "b", "media-rooted").select(F.col("node").alias("uid"), "root")
    images = found.join(roots, "uid", "left").select("uid", F.coalesce("root", "uid").alias("root"), F.explode("corners").alias("c"))
    rooted = images.select(corner.alias("p"), "root", F.posexplode("c.tables").alias("t", "key"))
    rooted = rooted.select((F.col("key") * TABLES + F.col("t")).alias("key"), scale("p").alias("s"), "p", "root")
    cells = saved(dealt(seen(rooted)), "media-cells")
    across = cells.select("key", "s", "i", "j", F.col("block").alias("block q"), F.col("p").alias("q"), F.col("root").alias("root q"))
    met = cells.filter("bits[0] = 1").join(across, ["key", "s", "i", "j"]).filter("p < q and root <> `root q` and (i = j or block <> `block q`)")
    return first.union(_agreed(met.select("p", "q")))


def classes(images: DataFrame, *, id_col="id", content_col="content") -> DataFrame:
    """(id, class_id, n_links): each image's class of copies, class_id its least id.

    Equal contents are one image before anything is compared. Content that is null or can't be decoded is
    like nothing but its equals. Null ids: last. Repeated rows share their class. Empty table: no rows.
    """
    rows = saved(local_descriptors(images.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))), "media-images")
    once = rows.groupBy("image").agg(F.min("id").alias("id"), F.first("corners").alias("corners"))
    once = numbered(once, "media-once")
    links = saved(copy_links(once.select("uid", "corners")), "media-links")
    roots = components(links, "a", "b", "media-components")
    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_links"))
    joined = once.select("uid", "image", "id").join(roots.withColumnRenamed("node", "uid"), "uid", "left").join(degree, "uid", "left")
    joined = saved(joined.select("image", "id", F.coalesce("root", "uid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "media-labelled")
    heads = joined.groupBy("root").agg(F.min("id").alias("class_id"))
    named = joined.join(heads, "root").select("image", "class_id", "n_links")
    return rows.select(F.col("id").alias(id_col), "image").join(named, "image").select(id_col, "class_id", "n_links")


SIDE = 64


def site_pictures(pages: DataFrame) -> DataFrame:
    """(id, host, content): the picture a page shows is its host's, cut to 48 x 48 at a place of its own, with
    its own brightness and contrast and a small stamp. The tables hold no images; these are made from
    the pages' hosts and ids, so their number and their groups of copies are the pages'."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept: dict[int, np.ndarray] = {}
            contents = []
            for seed, own in zip(batch["seed"], batch["own"], strict=True):
                if seed not in kept:
                    if len(kept) > 2000:
                        kept.clear()
                    rng = np.random.default_rng(int(seed) % 2**63)
                    coarse = rng.random((SIDE // 4 + 1, SIDE // 4 + 1))
                    fine = np.repeat(np.repeat(rng.random((SIDE // 2, SIDE // 2)), 2, 0), 2, 1)
                    kept[seed] = 150 * np.repeat(np.repeat(coarse, 4, 0), 4, 1)[:SIDE, :SIDE] + 70 * fine
                own = int(own) % 2**63
                y, x = own % 17, own // 17 % 17
                cut = kept[seed][y : y + 48, x : x + 48] * (0.8 + own // 289 % 5 * 0.08) + own // 1445 % 20
                corner = own // 28900 % 4
                cut[-6:, -6:] = 0 if corner else cut[-6:, -6:]
                contents.append(encode_pgm(np.clip(cut, 0, 255)))
            yield pd.DataFrame({"id": batch["id"], "host": batch["host"], "content": contents})

    host = F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))
    keyed = pages.select(F.col("page_id").alias("id"), host.alias("host"))
    keyed = keyed.select("id", "host", F.xxhash64("host").alias("seed"), F.xxhash64("id", F.lit("cut")).alias("own"))
    return keyed.mapInPandas(rows, "id long, host string, content binary")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = site_pictures(table(spark, sf_dir, "pages"))
    return classes(images).withColumnRenamed("id", "page_id")
