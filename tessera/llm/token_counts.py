"""Token counts for every context limit, from an exact histogram of encoded lengths.

Documents are counted by encoded length in the task that encodes them; tasks' counts are summed by
length. Suffix sums over the histogram then answer, for each length as a context limit, how many
documents and ids lie at or under it, how many documents are longer and what is left of all ids if
longer documents are cut there. They are made in two steps, within blocks of lengths and over the
blocks, so that no task needs the histogram as a whole.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .word_tokens import TOOL, loaded

BLOCK = 512


def histogram(docs: DataFrame, tokenizer: str, extra: int = 0, text_col: str = "text") -> DataFrame:
    """n_tokens and n_docs: documents by encoded length, plus `extra` end ids each.

    Null and empty texts have `extra` ids; every row counts, repeated ones too; whole texts count, a long one
    in parts; an empty table gives an empty histogram; other columns are not read.
    """

    def run(batches):
        tokens = loaded(tokenizer)
        found: Counter[int] = Counter()
        for batch in batches:
            for part in common.chunks(batch):
                found.update(len(ids) + extra for ids in tokens.encode_batch(part.column("text").to_pylist()))
        if found:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(found), pa.int64()), "n_docs": pa.array(list(found.values()), pa.int64())})

    common.small_batches(docs.sparkSession)
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(common.tidy(run, TOOL), "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, as a context limit.

    docs_within and tokens_within: documents of at most that length and their ids; docs_over: longer
    ones; tokens_over: the ids of those; truncated_tokens: ids that remain when longer documents are cut
    at the limit; share_within: docs_within of all documents, so the smallest limit with a share of q
    is the q-quantile. Any other limit l lies between two rows: with the next greater row, its total is
    tokens_within + docs_over * l of the row below. An empty histogram gives an empty table.
    """
    rows = common.settle(lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long")), "lengths")
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of lengths
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"))
    total = rows.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")).first()
    all_docs, all_tokens = F.lit(total["docs"]).cast("long"), F.lit(total["tokens"]).cast("long")
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)

    def over(own: Column, base: str) -> Column:
        return F.col(base) + F.coalesce(F.sum(own).over(longer), F.lit(0))

    out = rows.join(blocks, "block").withColumn("docs_over", over(F.col("n_docs"), "d_above")).withColumn("tokens_over", over(tokens, "t_above"))
    return out.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (all_docs - F.col("docs_over")).alias("docs_within"),
        (all_tokens - F.col("tokens_over")).alias("tokens_within"),
        "docs_over",
        "tokens_over",
        (all_tokens - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
        ((all_docs - F.col("docs_over")) / all_docs).alias("share_within"),
    )


def total_at(limits_df: DataFrame, limit: int) -> int:
    """Ids of all documents when each is cut at `limit`: any limit, from the row below or the first row."""
    below = limits_df.filter(F.col("context_limit") <= limit).agg(F.max(F.struct("context_limit", "tokens_within", "docs_over")).alias("r")).first()["r"]
    if below is not None:
        return below["tokens_within"] + below["docs_over"] * limit
    return limit * (limits_df.agg(F.sum("n_docs")).first()[0] or 0)


def quantile(limits_df: DataFrame, share: float) -> int | None:
    """The least length that a share of all documents (over 0, up to 1) doesn't exceed; none of an empty histogram."""
    return limits_df.filter(F.col("share_within") >= share).agg(F.min("context_limit")).first()[0]


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return limits(histogram(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
