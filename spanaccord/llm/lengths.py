"""Operator 4: the exact histogram of encoded lengths and what follows from it for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanaccord.llm.common import cut, text_of
from spanaccord.llm.tokens import encoder

#: lengths that share one window partition of the running sums
SPAN = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(n_tokens): the number of ids of each whole text; null and empty texts have 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(e.ids(t)) // 4 for t in b.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): exact counts, added up inside every task first."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For every occurring length taken as a context limit, what holds at that limit.

    n_docs has that length; n_over, tokens_over: documents longer than the limit and all their tokens (suffix
    sums); n_within, tokens_within: the others; truncated_total: tokens left when every document is cut at the
    limit; lost: those cut off; quantile: share of documents within the limit.  Between two rows the answers
    follow from the row below: ``at_limits``.  An empty table gives no row.
    """
    t = F.col("n_tokens") * F.col("n_docs")
    hist = cut(hist)   # read twice below; without the cut every text is encoded twice
    rows = hist.withColumn("t", t).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    after = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.select("*", F.coalesce(F.sum("n_docs").over(after), F.lit(0)).alias("d1"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t1"))
    # one row per span of lengths: few, so that a single task may hold them
    spans = rows.groupBy("span").agg(F.sum("n_docs").alias("sd"), F.sum("t").alias("st"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("span", F.coalesce(F.sum("sd").over(later), F.lit(0)).alias("d2"), F.coalesce(F.sum("st").over(later), F.lit(0)).alias("t2"), F.sum("sd").over(Window.partitionBy()).alias("all_d"), F.sum("st").over(Window.partitionBy()).alias("all_t"))
    n = inner.join(spans, "span").select("*", (F.col("d1") + F.col("d2")).alias("n_over"), (F.col("t1") + F.col("t2")).alias("tokens_over"))
    cutoff = F.col("all_t") - F.col("tokens_over") + F.col("n_tokens") * F.col("n_over")
    return n.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("all_d") - F.col("n_over")).alias("n_within"), "n_over", (F.col("all_t") - F.col("tokens_over")).alias("tokens_within"), "tokens_over",
        cutoff.alias("truncated_total"), (F.col("all_t") - cutoff).alias("lost"), ((F.col("all_d") - F.col("n_over")) / F.col("all_d")).alias("quantile"),
    )


def at_limits(table: DataFrame, wanted: list[int]) -> list[tuple[int, int]]:
    """(limit, truncated total) for any limits, from the rows of ``limits``: one grouped pass."""
    aggs = []
    for w in wanted:
        over = F.coalesce(F.sum(F.when(F.col("context_limit") > w, F.col("n_docs"))), F.lit(0))
        within = F.coalesce(F.sum(F.when(F.col("context_limit") <= w, F.col("context_limit") * F.col("n_docs"))), F.lit(0))
        aggs.append((within + over * w).alias(f"l{w}"))
    row = table.agg(*aggs).first()
    return [(w, row[f"l{w}"]) for w in wanted]


def quantiles(table: DataFrame, wanted: list[float]) -> list[tuple[float, int | None]]:
    """(q, length): the least length within which a share q of the documents lies; null for an empty table."""
    row = table.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("context_limit"))).alias(f"q{i}") for i, q in enumerate(wanted)]).first()
    return [(q, row[f"q{i}"]) for i, q in enumerate(wanted)]
