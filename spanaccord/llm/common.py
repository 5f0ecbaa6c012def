"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanaccord.settings import cut

__all__ = ["bounded_sample", "components", "cut", "likely", "map_rows", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Map Arrow batches given as dicts of lists.

    ``make`` runs once per task and returns the function for one batch, so that
    models and automata are built once and not shipped as rows.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for b in batches:
            if b.num_rows:
                fn = fn or make()
                out = fn(b.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=kinds[n]) for n in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.type for f in to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)}
    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, by: str, per_class: int, order: Column, max_chars: int, text: str = "text", classes: int = 64) -> DataFrame:
    """At most ``per_class`` rows and ``max_chars`` characters of text for each of the ``classes`` most frequent values of ``by``.

    Rows come in the order of a hash, so every run draws the same ones; equal
    texts of a class count once.  Classes are counted first and thinned by a hash,
    so that few texts are moved; their number is bounded, and so is what is broadcast.
    """
    from pyspark.sql import Window

    # one row per class: thin every class to a few times what is wanted before texts are moved
    sizes = df.groupBy(by).agg(F.count("*").alias("_size")).orderBy(F.desc("_size"), by).limit(classes).withColumnRenamed(by, "_class")
    span = 1 << 30
    thin = df.join(F.broadcast(sizes), F.col(by) == F.col("_class")).where(F.pmod(F.xxhash64(order, F.lit(1)), F.lit(span)).cast("double") * F.col("_size") <= float(6 * per_class * span)).drop("_class", "_size")
    w = Window.partitionBy(by).orderBy(order, F.xxhash64(text))
    ranked = thin.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 4 * per_class).drop("_rank")
    once = ranked.withColumn("_same", F.row_number().over(Window.partitionBy(by, text).orderBy(order))).where("_same = 1").drop("_same")
    run = once.withColumn("_rank", F.row_number().over(w)).withColumn("_sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("_rank") <= per_class) & ((F.col("_sum") <= max_chars) | (F.col("_rank") == 1))).drop("_rank", "_sum")


#: edges in one partition of ``components``
EDGES = 100_000


def _few(df: DataFrame, edges: int) -> DataFrame:
    """As many partitions as that many edges fill, if there are more: few edges make few files in every round."""
    return df.coalesce(max(1, -(-edges // EDGES)))


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between long numbers, and (node, id): every node gets its number once."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    names = cut(nodes.select("node", F.monotonically_increasing_id().alias("id")))
    for c in ("a", "b"):
        edges = edges.join(names.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    return edges, names


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): one row (node, root) per node; root is a long, the same for all nodes of a component only.

    Nodes of any type are numbered once, so that all rounds aggregate longs.  A round is a large-star and a small-star
    step of Kiveris et al.  Edges point from the greater to the smaller node; only nodes that have a smaller
    neighbour of their own pass it on, so the root of a finished component takes part in no match, and adaptive
    execution splits the edges of a node with many.  It ends when a large-star step moves no edge and no node
    has two smaller neighbours.
    """
    names = None
    if edges.schema["a"].dataType.typeName() != "long":
        # read three times
        edges = cut(edges.select("a", "b").where("a <> b").distinct())
        edges, names = _numbered(_few(edges, edges.count()))
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n = e.count()
    e = _few(e, n)
    while True:
        down = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        met = e.join(down, "b", "left")
        large = cut(_few(met.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")), n))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"), F.bool_or("moved").alias("moved"))
        if not _few(low, n).agg(F.bool_or(F.col("moved") | (F.col("m") < F.col("most")))).first()[0]:
            break
        small = large.join(low.where("m < most"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(_few(_few(small.union(low.select("a", F.col("m").alias("b"))), n).distinct(), n))
    # the grouped star: every edge is (node, root)
    found = _few(large.select(F.col("a").alias("node"), F.col("b").alias("root")).union(large.select(F.col("b").alias("node"), F.col("b").alias("root"))), n).distinct()
    return found if names is None else found.withColumnRenamed("node", "id").join(names, "id").select("node", "root")


#: bits of the filter that ``likely`` broadcasts: 131,072 words, whatever the number of keys
FILTER_BITS = 23


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted`` (one column, also called ``key``); none that is goes missing.

    The wanted keys set bits of a table of fixed size, which every task gets.  With many more keys than bits
    all rows pass; an exact join has to follow.
    """
    at = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = wanted.select(F.shiftright(at, 6).alias("_part"), bit.alias("_bit")).groupBy("_part").agg(F.bit_or("_bit").alias("_word"))
    met = df.join(F.broadcast(words), F.shiftright(at, 6) == F.col("_part")).where(F.getbit("_word", (at % 64).cast("int")) == 1)
    return met.drop("_part", "_word")
