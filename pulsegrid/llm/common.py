"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Work arrays are built for this much text at a time, whatever the Arrow batch holds.
SLICE_BYTES = 8 << 20


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first longer form of it that is no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without(df: DataFrame, added: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``df`` without columns named like those that an operator adds, in any case; they are replaced. ``keep`` names columns that it reads."""
    gone = {a.lower() for a in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone or c in keep])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole rows with about ``most`` bytes of ``column`` each."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n + 16
    yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column; null counts as empty."""
    return batch.column(column).fill_null("")


def text_pass(df: DataFrame, text: str, added: Sequence[T.StructField],
              make: Callable[[], Callable[[pa.Array], list]], keep: bool = True) -> tuple[Callable, T.StructType]:
    """A function over Arrow batches that adds columns worked out from texts, and its schema.

    ``make`` runs once per task and returns a function from an array of texts to one Arrow array (or
    list) per added column. ``keep=False`` leaves the text itself out of the result. A column of ``df`` whose name (in any
    case) is that of an added one is replaced, even if it is the text.
    """
    new = {f.name.lower() for f in added}
    own = [f for f in df.schema.fields if (keep or f.name != text) and f.name.lower() not in new]
    schema = T.StructType([*own, *added])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                new = work(texts_of(part, text))
                arrays = [part.column(n) for n in names]
                arrays += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, arrow.field(len(names) + i).type)
                           for i, x in enumerate(new)]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)
                del arrays, new
                pa.default_memory_pool().release_unused()

    return run, schema


def with_text_columns(df: DataFrame, text: str, added: Sequence[T.StructField],
                      make: Callable[[], Callable[[pa.Array], list]], keep: bool = True) -> DataFrame:
    """``df`` with columns worked out from its texts, in one narrow pass without a shuffle (see ``text_pass``)."""
    return df.mapInArrow(*text_pass(df, text, added, make, keep))


def hot_keys(rows: DataFrame, key: str, most: int = 1000) -> list:
    """Keys that hold more than one in ``most`` of all rows: fewer than ``most`` keys, by arithmetic."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    return [r[0] for r in counts.where(F.col("__n") * most > total).select(key).collect()]


def spread_join(rows: DataFrame, side: DataFrame, key: str, spread: Column, how: str = "inner",
                salts: int = 32, most: int = 1000) -> DataFrame:
    """``rows`` joined to the unique keys of ``side``; rows of a hot key go to ``salts`` tasks.

    Only the hot keys (fewer than ``most``, see ``hot_keys``) are repeated on the side, so the side
    grows by at most ``most * salts`` rows. Null keys match null keys.
    """
    hot = hot_keys(rows, key, most)
    salt, there = free_name(rows, "__salt"), free_name(rows, f"__{key}")
    is_hot = lambda c: c.isin([k for k in hot if k is not None]) | (c.isNull() if None in hot else F.lit(False))
    salted = rows.withColumn(salt, F.when(is_hot(F.col(key)), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0).cast("int"))
    copies = (side.withColumn(salt, F.explode(F.when(is_hot(F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1)))
                                              .otherwise(F.array(F.lit(0)))))
              .withColumnRenamed(key, there).withColumnRenamed(salt, f"{salt}_"))
    joined = salted.join(copies, F.col(key).eqNullSafe(F.col(there)) & (F.col(salt) == F.col(f"{salt}_")), how)
    return joined.drop(salt, f"{salt}_", there)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table of this library's own that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
