"""Token counts from a cache that is keyed by digests of content and tokenizer version.

Documents are joined to stored counts by the digest of their normalised content and of the tokenizer. Only
distinct contents without a count are encoded, and their counts are appended to the cache, which is a
Parquet folder with one part per tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid.llm import tokenizers
from pulsegrid.llm.common import spread_join, with_text_columns
from pulsegrid.session import cut_lineage

CACHE = "content binary, n_tokens long, tokenizer string"
#: So many missing digests go to every task to pick out their texts.
FEW = 50_000


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Counts of one tokenizer version, ``(content, n_tokens)``, one row a content; a folder that isn't there is empty."""
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_column(texts: DataFrame, path: str, text: str, out: str) -> DataFrame:
    """``texts`` plus the number of ids of each; the text itself goes."""
    def make():
        model = tokenizers.load(path)

        def work(column: pa.Array) -> list:
            return [pa.array(model.chunks.count(column) if model.chunks else model.encode_whole(column.to_pylist())[1])]

        return work

    return with_text_columns(texts, text, [T.StructField(out, T.LongType())], make, keep=False)


def count_tokens(docs: DataFrame, path: str, cache: str, text: str = "text",
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The columns of ``docs`` but the text, plus ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    Null texts count as empty. ``normalise`` may map contents that surely have the same count to one (whitespace
    runs, for a vocabulary that drops whitespace); without it contents must be equal. Repeated texts are encoded
    once; repeated rows, null ids and an empty table are fine; columns of ``docs`` named ``n_bytes`` or ``n_tokens`` are replaced.

    Digests meet the cache first, and without a miss no text moves. Texts of up to ``FEW`` misses are picked out where they lie; with
    more, texts move once, after each task has dropped its own repeats, so a hot content is one row a task. The counts return to the rows on
    the digest, hot digests on several tasks.
    """
    spark, tokenizer = docs.sparkSession, tokenizers.version(path)
    whole = F.coalesce(F.col(text), F.lit(""))
    content = normalise(whole) if normalise else whole
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    others = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    keyed = cut_lineage(docs.select(*others, F.octet_length(whole).cast("long").alias("n_bytes"), digest.alias("__content")), "keyed-documents")
    missing = cut_lineage(keyed.select(F.col("__content").alias("content")).distinct().join(stored(spark, cache, tokenizer), "content", "left_anti"), "missing-counts")
    n_missing = missing.count()
    if n_missing:
        texts = docs.select(digest.alias("content"), content.alias("text"))
        if n_missing <= FEW:  # at most 32 bytes each
            texts = texts.join(F.broadcast(missing), "content", "left_semi")
        misses = texts.groupBy("content").agg(F.first("text").alias("text"))
        if n_missing > FEW:
            misses = misses.join(missing, "content", "left_semi")
        (count_column(misses, path, "text", "n_tokens").select("content", "n_tokens", F.lit(tokenizer).alias("tokenizer"))
         .write.mode("append").partitionBy("tokenizer").parquet(cache))
    counts = stored(spark, cache, tokenizer).withColumnRenamed("content", "__content")
    spread = F.struct(*others) if others else F.col("n_bytes")
    return spread_join(keyed, counts, "__content", spread).drop("__content")
