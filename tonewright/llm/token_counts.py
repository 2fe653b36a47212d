"""Exact histogram of encoded lengths, with suffix sums that answer for every context limit.

Documents are counted by length inside each Arrow batch, so that only (length, count) pairs are
shuffled. The histogram has at most as many rows as there are different lengths; its running
sums are taken in blocks of ``BLOCK`` lengths and then over the blocks' totals.

Null and empty texts have length ``end_tokens``. Repeated rows count each. An empty table has
an empty histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewright.llm.common import arrow_map, raw, slices
from tonewright.llm.tokens import BYTE_BPE, encoder, vocabulary

BLOCK = 4096


def length_histogram(docs: DataFrame, tokenizer: str | None = None, end_tokens: int = 1) -> DataFrame:
    """(n_tokens, documents): how many documents have each encoded length, with the end id."""
    path = tokenizer or vocabulary(BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n = Counter(len(ids) // 4 + end_tokens for part in slices(batch) for ids in own.encode_all(raw(part)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["n_tokens", "documents"])

    return arrow_map(docs, run, "n_tokens long, documents long").groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    docs_upto, tokens_upto: documents of at most L tokens and their tokens;
    docs_longer, tokens_longer: the suffix sums beyond L;
    truncated_tokens: tokens left when every document is cut to L; lost_tokens: those cut off;
    quantile: share of documents of at most L tokens.
    """
    h = histogram.select("n_tokens", "documents", F.expr("n_tokens * documents").alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    last = Window.orderBy(F.desc("block"))
    beyond = last.rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    # as many rows as blocks: a few thousand lengths share one
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(beyond), F.lit(0)).alias("d_beyond"),
        F.coalesce(F.sum("t").over(beyond), F.lit(0)).alias("t_beyond"),
        F.sum("d").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_d"),
        F.sum("t").over(last.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_t"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = h.join(totals, "block").select(
        "n_tokens",
        "documents",
        (F.coalesce(F.sum("documents").over(inside), F.lit(0)) + F.col("d_beyond")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t_beyond")).alias("tokens_longer"),
        "all_d",
        "all_t",
    )
    return sums.select(
        "n_tokens",
        "documents",
        (F.col("all_d") - F.col("docs_longer")).alias("docs_upto"),
        (F.col("all_t") - F.col("tokens_longer")).alias("tokens_upto"),
        "docs_longer",
        "tokens_longer",
        F.expr("all_t - tokens_longer + n_tokens * docs_longer").alias("truncated_tokens"),
        F.expr("tokens_longer - n_tokens * docs_longer").alias("lost_tokens"),
        F.expr("(all_d - docs_longer) / CAST(all_d AS DOUBLE)").alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, documents_cut, tokens) for any limits, whether or not they occur as lengths."""
    cut = [
        F.struct(
            F.lit(int(x)).alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > int(x), F.col("documents"))), F.lit(0)).alias("documents_cut"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("documents")), F.lit(0)).alias("tokens"),
        )
        for x in limits
    ]
    return histogram.agg(F.array(*cut).alias("rows")).select(F.inline("rows"))


def quantiles(contexts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents doesn't exceed."""
    least = [
        F.struct(F.lit(float(x)).alias("share"), F.min(F.when(F.col("quantile") >= float(x), F.col("n_tokens"))).alias("n_tokens"))
        for x in shares
    ]
    return contexts.agg(F.array(*least).alias("rows")).select(F.inline("rows"))
