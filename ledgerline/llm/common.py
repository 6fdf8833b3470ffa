"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: A word, the same in Java, Python and RE2.
WORD = r"[^\x20\x09-\x0D]+"
words_of = re.compile(r"[^ \t-\r]+").findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:  # tests and single machines; the setting itself is fixed once a session runs
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: lineage ends here, and a
    lost executor costs no more than the tasks it was running. ``batch_rows``: rows that a Python worker gets at once, where those are large."""
    path, key = shared_path(df.sparkSession, name), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(key)
    df.sparkSession.conf.set(key, batch_rows or before)
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``saved`` wrote of frames that nothing reads any more."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected edges a-b; root is the least node of its component.

    Each round merges a node into the neighbour that comes first in the round's order, and what is left of the edges,
    between merged nodes and without repeats, goes into the next. Even rounds take the order of the nodes, in which a star
    around its least node is done at once; odd ones an order drawn for the round, in which a part of the nodes goes
    whatever the edges, so rounds grow with the logarithm of a chain's length and edges shrink. Every join is on a node's own key between written
    tables and can be split where one node has many edges. An edge with a null end counts for nothing.
    """
    left = saved(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter((F.col(a) != F.col(b)) & F.col("u").isNotNull()).distinct(), f"{name}-edges")
    merged: list[DataFrame] = []
    while not left.isEmpty() or not merged:
        place = lambda c: F.xxhash64(c, F.lit(len(merged))) if len(merged) % 2 else F.col(c)
        both = left.union(left.select("v", "u"))
        first = both.groupBy("u").agg(F.min_by("v", place("v")).alias("m"))
        merged.append(saved(first.select(F.col("u").alias("node"), F.when(place("m") < place("u"), F.col("m")).otherwise(F.col("u")).alias("to")), f"{name}-merged"))
        u, v = (merged[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("u", "v"))
        met = left.join(u, "u").join(v, "v").filter("u2 <> v2")
        fewer = saved(met.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct(), f"{name}-edges")
        discard(left)
        left = fewer
    roots = merged[-1]
    for step in reversed(merged[:-1]):
        further = roots.select(F.col("node").alias("to"), F.col("to").alias("far"))
        roots = step.join(further, "to", "left").select("node", F.coalesce("far", "to").alias("to"))
    roots = saved(roots, f"{name}-roots")
    heads = saved(roots.groupBy("to").agg(F.min("node").alias("root")), f"{name}-heads")
    out = saved(roots.join(heads, "to").select("node", "root"), name)
    discard(left, roots, heads, *merged)
    return out


def walked(df: DataFrame, key: str, order: list[str], moves: list[list[int]] = ((0,),), move: Column | None = None, name: str = "walked") -> DataFrame:
    """The rows with ``place`` (long, 0 for a key's first row in order) and ``state`` (int), that of a machine which starts each key in state 0
    and goes from s to ``moves[m][s]`` at a row whose ``move`` is m. Null is a key like others; rows that are equal in key and order may take each other's places.

    Rows are dealt by ranges of key and order, so a key of any size lies in as many tasks as its rows need. A task doesn't know the state in which it
    begins: it composes the moves since its key's start there, for every state at once. What a task leaves to the next is one row, and one such row a task
    goes to the driver and back, which chains them.
    """
    identity = tuple(range(len(moves[0])))
    tables = [tuple(m) for m in moves]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, spot, last, place, so_far, known = TaskContext.get().partitionId(), 0, None, -1, identity, {}
        for batch in batches:
            places, composed = [], []
            for k, m in zip(batch.column(batch.schema.names.index(key)).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != last or not spot:
                    last, place, so_far = k, -1, identity
                if (so_far, m) not in known:
                    known[so_far, m] = tuple(tables[m][s] for s in so_far)
                place, so_far, spot = place + 1, known[so_far, m], spot + 1
                places.append(place)
                composed.append(so_far)
            columns = [*batch.columns[:-1], pa.array([part] * len(places), pa.int32()), pa.array(range(spot - len(places), spot), pa.int64()), pa.array(places, pa.int64()), pa.array(composed, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *OWN])

    OWN = ["walk part", "walk spot", "walk place", "walk states"]  # noqa: N806
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("walk move", F.lit(0) if move is None else move)
    schema = StructType([*df.schema.fields, *StructType.fromDDL("`walk part` int, `walk spot` long, `walk place` long, `walk states` array<int>").fields])
    rows = saved(ranged.mapInArrow(walk, schema), name)
    edge = F.struct(F.col(key).alias("k"), F.col("walk place").alias("n"), F.col("walk states").alias("f"))
    ends = sorted(rows.groupBy("walk part").agg(F.min_by(edge, "walk spot").alias("first"), F.max_by(edge, "walk spot").alias("last")).collect())
    carried, before, state, left = [], 0, 0, None
    for i, (part, first, last) in enumerate(ends):
        goes_on = i > 0 and first.k == left
        before, state = (before, state) if goes_on else (0, 0)
        if goes_on:
            carried.append((part, first.k, before, state))
        whole = first.k == last.k
        before, state, left = (last.n + 1 + (before if whole else 0), last.f[state if whole else 0], last.k)
    key_type = StructType([StructField("carried part", IntegerType()), StructField("carried key", df.schema[key].dataType), StructField("carried rows", LongType()), StructField("carried state", IntegerType())])
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, key_type))  # at most one row a task
    on = (F.col("walk part") == F.col("carried part")) & F.col(key).eqNullSafe(F.col("carried key"))
    out = rows.join(carry, on, "left")
    place, state = F.col("walk place") + F.coalesce("carried rows", F.lit(0)), F.element_at("walk states", F.coalesce("carried state", F.lit(0)) + 1)
    return out.select(*df.columns, place.alias("place"), state.alias("state"))
