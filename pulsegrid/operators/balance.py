"""Class balance, augmented copies, resampling with replacement, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions.keyed import digest, pick
from pulsegrid.functions.numeric import half_even
from pulsegrid.operators.ranking import hash_bucket, split_rank

# Label vocabularies, in index order.
VOCABULARIES: dict[str, tuple] = {
    "training-a": (-1, 1),
    "training-a-extended": ("Normal", "Benign", "MVP", "MPC", "AD"),
    "ticking-heart-multi": (-1, 1),
    "ticking-heart-extended": (
        "C1X2N", "C1X2A", "C1X3N", "C1X3A", "C1X4N", "C1X4A", "C1X5N", "C1X5A", "C1X6N", "C1X6A",
        "C2X1N", "C2X1A", "C2X3N", "C2X3A", "C2X4N", "C2X4A", "C2X5N", "C2X5A", "C2X6N", "C2X6A",
        "C3X1N", "C3X1A", "C3X2N", "C3X2A", "C3X4N", "C3X4A", "C3X5N", "C3X5A", "C3X6N", "C3X6A",
        "C4X1N", "C4X1A", "C4X2N", "C4X2A", "C4X3N", "C4X3A", "C4X5N", "C4X5A", "C4X6N", "C4X6A",
        "C5X1N", "C5X1A", "C5X2N", "C5X2A", "C5X3N", "C5X3A", "C5X4N", "C5X4A", "C5X6N", "C5X6A",
        "C6X1N", "C6X1A", "C6X2N", "C6X2A", "C6X3N", "C6X3A", "C6X4N", "C6X4A", "C6X5N", "C6X5A",
    ),
    "cinc-channels": ("2N", "2A", "3N", "3A", "4N", "4A", "5N", "5A", "6N", "6A"),
    "multichannel-mixed": (0, 1, 2),
}


def vocabulary(name: str) -> tuple:
    if name not in VOCABULARIES:
        raise NotImplementedError(f"unknown label vocabulary {name!r}; known: {sorted(VOCABULARIES)}")
    return VOCABULARIES[name]


def vocabulary_table(spark: SparkSession) -> DataFrame:
    """Fixed dimension table ``(vocab, idx, label)``, under 100 rows."""
    rows = [(v, i, str(x)) for v, xs in VOCABULARIES.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "vocab STRING, idx INT, label STRING")


def encode_labels(df: DataFrame, vocab: str = "vocab", label: str = "label", out: str = "idx"
                  ) -> DataFrame:
    """Label name to index; ``known`` is false where the vocabulary or the label is unknown."""
    dim = vocabulary_table(df.sparkSession).select(
        F.col("vocab").alias(vocab), F.col("label").alias(label), F.col("idx").alias(out))
    # The dimension is a fixed list of under 100 rows.
    return df.join(F.broadcast(dim), [vocab, label], "left").withColumn(
        "known", F.col(out).isNotNull())


def decode_labels(df: DataFrame, vocab: str = "vocab", idx: str = "idx", out: str = "label"
                  ) -> DataFrame:
    """Index to label name; ``known`` is false for an index outside the vocabulary."""
    dim = vocabulary_table(df.sparkSession).select(
        F.col("vocab").alias(vocab), F.col("idx").alias(idx), F.col("label").alias(out))
    return df.join(F.broadcast(dim), [vocab, idx], "left").withColumn(
        "known", F.col(out).isNotNull())


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class and the largest class count; the window sees one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("max_n", F.max("n").over(Window.partitionBy(F.lit(1))))


def copy_counts(df: DataFrame, augment_num: int, balance: bool = True, label: str = "label"
                ) -> DataFrame:
    """Copies per row of each class: ``round(augment_num * largest / own)``."""
    own = half_even(F.lit(augment_num) * F.col("max_n") / F.col("n"))
    return class_counts(df, label).select(
        label, "n", (own if balance else F.lit(augment_num).cast("long")).alias("copies"))


def with_copies(rows: DataFrame, augment_num: int, row_id: str, balance: bool = True,
                counts_from: DataFrame | None = None, label: str = "label", chunk: int = 1000
                ) -> DataFrame:
    """Originals (copy 0) and their copies, as rows with ``copy_no``.

    Every original stays: a row without a label, or with one that ``counts_from`` doesn't have, has no copies
    (``uncounted`` lists those rows).

    ``counts_from`` is the table whose classes are balanced: the split rows of all listed records
    for balance by record, the fragments themselves for balance by fragment. The few per-class
    counts reach the rows as one map value, so no row is shuffled by its class. A row of a rare
    class may get very many copies: they are made in chunks that are spread over the tasks first.
    """
    counts = copy_counts(rows if counts_from is None else counts_from, augment_num, balance, label)
    per_class = counts.agg(F.map_from_entries(
        F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(label).cast("string"), "copies")))).alias("m")).scalar()
    known = F.try_element_at(per_class, F.coalesce(F.col(label).cast("string"), F.lit("")))
    sized = (rows.withColumn("__copies", F.when(F.col(label).isNotNull(), known))
             .withColumn("__copies", F.coalesce("__copies", F.lit(0).cast("long")))
             .withColumn("__chunk", F.explode(F.expr(f"sequence(0, __copies div {chunk})")))
             .repartition(row_id, "__chunk"))
    first = F.col("__chunk") * chunk
    last = F.least(first + chunk - 1, F.col("__copies"))
    return (sized.withColumn("copy_no", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
            .drop("__copies", "__chunk"))


def uncounted(rows: DataFrame, counts_from: DataFrame, label: str = "label") -> DataFrame:
    """Rows that ``with_copies`` gives no copies because their label is null or absent from ``counts_from``."""
    return rows.join(counts_from.select(label).distinct(), label, "left_anti")


def copy_patient(patient: str = "patient", copy_no: str = "copy_no"):
    """Output form of the patient id of an augmented copy."""
    return F.when(F.col(copy_no) > 0, F.concat(F.col(patient).cast("string"), F.lit("#aug"),
                                               F.col(copy_no).cast("string"))
                  ).otherwise(F.col(patient).cast("string"))


def balanced_resample(rows: DataFrame, row_id: str, label: str = "label", seed: int = 0) -> DataFrame:
    """As many draws as rows, with replacement, every class equally likely.

    The draw table is the row ids themselves, so no count has to reach the driver. Each draw names
    a class and a position in it; positions are unique, so the join has no hot key even when one
    class holds most rows.
    """
    ids = rows.select(F.col(row_id).alias("__id"), F.col(label).alias("__label"))
    hashed = ids.withColumn("__h", digest(seed, "rank", F.col("__id")))
    ranked = split_rank(hashed, ["__label"], ["__h", "__id"], hash_bucket(F.col("__h")), "__r")
    sizes = ids.groupBy("__label").agg(F.count(F.lit(1)).alias("n"))
    classes = sizes.agg(F.sort_array(F.collect_list(F.struct("__label", "n"))).alias("c"))
    drawn = ids.select(F.col("__id").alias("draw_id"), classes.scalar().alias("c"))
    cls = drawn.withColumn("k", F.get("c", pick(F.size("c"), seed, "class", F.col("draw_id")).cast("int")))
    wanted = cls.select("draw_id", F.col("k.__label").alias("__label"),
                        (pick(F.col("k.n"), seed, "row", F.col("draw_id")) + 1).alias("__r"))
    return wanted.join(ranked, ["__label", "__r"]).select(
        "draw_id", F.col("__id").alias(row_id), F.col("__label").alias(label))


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union by column name with the name of the source in ``source``."""
    out = None
    for name, part in parts:
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
