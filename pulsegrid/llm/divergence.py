"""How far the sources of a language part from each other and from the language, term by term, in integers.

Texts are cut into terms and counted per slice in Arrow; the counts meet per (language, source, term) first, so a
frequent term or a large source is many small sums. What follows looks at *cells*: the pairs of counts that terms have.
All terms of a cell have one value, so values are worked out per cell, cells are ranked by how many terms they hold, and only
the cells that reach into the report are expanded to terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pulsegrid.llm.common import slices, texts_of
from pulsegrid.session import cut_lineage

#: What stands between terms: control characters, space, and ASCII that is no letter.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000

COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()),
                        T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (language, source, term) of a slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = pc.split_pattern_regex(pc.ascii_lower(texts_of(part, "text")), BETWEEN)
            ends = words.offsets.to_numpy().astype(np.int64)
            coded = words.flatten().dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            group = (pa.table({"lang": part.column("lang"), "source": part.column("source")})
                     .append_column("row", pa.array(np.arange(part.num_rows))))
            group = group.group_by(["lang", "source"]).aggregate([("row", "list")])
            of_row = np.empty(part.num_rows, np.int64)
            of_row[group.column("row_list").combine_chunks().flatten().to_numpy()] = np.repeat(
                np.arange(len(group)), pc.list_value_length(group.column("row_list")).to_numpy())
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            # One key per (row, term), sorted by row's group and term: runs are documents, sums are occurrences.
            wide = max(1, len(terms))
            in_row, n = np.unique(row * wide + code, return_counts=True)
            in_group, at = np.unique(of_row[in_row // wide] * wide + in_row % wide, return_inverse=True)
            count = np.bincount(at, weights=n, minlength=len(in_group)).astype(np.int64)
            docs = np.bincount(at, minlength=len(in_group)).astype(np.int64)
            where, term = pa.array(in_group // wide), terms.take(pa.array(in_group % wide))
            out = pa.RecordBatch.from_arrays(
                [group.column("lang").combine_chunks().take(where), group.column("source").combine_chunks().take(where), term, pa.array(count), pa.array(docs)],
                names=["lang", "source", "term", "n", "docs"])
            yield out.filter(pc.not_equal(out.column("term"), ""))
            del words, coded, code, row, in_row, n, in_group, at, out
            pa.default_memory_pool().release_unused()


def _share(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a count in billionths, as an exact integer."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 2)).cast("decimal(32,0)")
    under = (wide(total) + wide(terms) * 2).cast("decimal(32,0)")
    return F.call_function("div", top, under) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, term, n, in_lang, first)`` for terms in at least ``least_docs`` documents of their language.

    ``first`` marks one row of each (language, term). A term has one row per source that holds it.
    """
    counts = docs.select("lang", "source", "text").mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumns({"in_lang": F.sum("n").over(term), "in_docs": F.sum("docs").over(term),
                                "first": F.row_number().over(term.orderBy("source")) == 1})
            .where(F.col("in_docs") >= least_docs).drop("docs", "in_docs"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Ranked distances of each (language, source) from the other sources (part ``pair``) and its telling terms (part ``term``).

    Null texts, languages and sources count as ''; every row is a document, repeats included. Other columns play no part.
    Terms are lower-cased in A-Z only and kept per language from ``least_docs`` documents on. Groups without terms have counts
    of 0, a language without kept terms has distances of 0 and no terms. Equal values rank by item in UTF-8 order.
    Without rows there is no result.

    A pair's distance sums the gaps of all kept terms: those that one of the two holds, cell by cell against a count of 0; those
    that neither holds, as one cell; and for those that both hold a correction. Only terms that two sources share meet in a join.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept = cut_lineage(kept_counts(named, least_docs), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count_if("first").alias("terms"))
    groups = cut_lineage(
        named.select("lang", "source").distinct()
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"), F.count(F.lit(1)).alias("own_terms")), ["lang", "source"], "left")
        .join(sizes, "lang", "left").na.fill(0, ["own_n", "own_terms", "all_n", "terms"])
        .withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("own_n"), F.col("terms")))), "groups")
    cells = kept.groupBy("lang", "source", "n", "in_lang").agg(F.count(F.lit(1)).alias("many"))
    return _pairs(kept, cells, groups).unionByName(_telling_terms(kept, cells, groups, top))


def _pairs(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources with its distance; each unordered pair is worked out once."""
    side = lambda df, s: df.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "lang"])
    own = groups.select("lang", "source", "none", "own_terms", "terms", "own_n")
    a, b = side(own, "a"), side(own.drop("terms", "own_n"), "b")
    pairs = a.join(b, "lang").where(F.col("source_a") < F.col("source_b"))
    # Terms that one side holds, against the other side's count of 0.
    alone = (cells.groupBy("lang", "source", "n").agg(F.sum("many").alias("many")).join(own, ["lang", "source"])
             .select("lang", "source", "many", _share(F.col("n"), F.col("own_n"), F.col("terms")).alias("p")))
    other = own.select("lang", F.col("source").alias("other"), "none")
    one_sided = (alone.join(other, "lang").where(F.col("source") != F.col("other"))
                 .groupBy("lang", F.least("source", "other").alias("source_a"), F.greatest("source", "other").alias("source_b"))
                 .agg(F.sum(F.col("many") * _gap(F.col("p"), F.col("none"))).alias("one_sided")))
    # Terms that both hold: the true gap in place of the two one-sided ones.
    shares = cut_lineage(kept.join(own, ["lang", "source"]).select(
        "lang", "term", "source", "none", _share(F.col("n"), F.col("own_n"), F.col("terms")).alias("p")), "term-shares")
    held = lambda s: shares.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "none", "p")])
    in_both = held("a").join(held("b"), ["lang", "term"]).where(F.col("source_a") < F.col("source_b"))
    p, q, p0, q0 = (F.col(c) for c in ("p_a", "p_b", "none_a", "none_b"))
    shared = in_both.groupBy("lang", "source_a", "source_b").agg(
        F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)).alias("shared"))
    by_pair = ["lang", "source_a", "source_b"]
    neither = (F.col("terms_a") - F.col("own_terms_a") - F.col("own_terms_b")) * _gap(p0, q0)
    value = F.coalesce(neither, F.lit(0)) + F.coalesce("one_sided", F.lit(0)) + F.coalesce("shared", F.lit(0))
    done = pairs.join(one_sided, by_pair, "left").join(shared, by_pair, "left").withColumn("value", value)
    both = F.explode(F.array(*[F.struct(F.col(f"source_{s}").alias("source"), F.col(f"source_{o}").alias("item")) for s, o in ("ab", "ba")]))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (done.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
            .withColumn("rank", rank))


def _telling_terms(kept: DataFrame, cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The first ``top`` terms of each group, expanded from the cells whose values reach that far."""
    p, q = _share(F.col("n"), F.col("own_n"), F.col("terms")), _share(F.col("in_lang"), F.col("all_n"), F.col("terms"))
    valued = (cells.join(groups.where("terms > 0"), ["lang", "source"]).select("lang", "source", "n", "in_lang", "many", p.alias("p"), q.alias("q"))
              .where("p > q").withColumn("value", _gap(F.col("p"), F.col("q"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # Each value stands for a term at least, so what is beyond the first values can't be reported; the rest is counted.
    near = valued.withColumn("place", F.dense_rank().over(by_value)).where(F.col("place") <= top)
    values = near.groupBy("lang", "source", "value").agg(F.sum("many").alias("many"))
    before = F.coalesce(F.sum("many").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = values.withColumn("before", before).where(F.col("before") < top).select("lang", "source", "value", "before")
    cells_in = near.join(reached, ["lang", "source", "value"]).select("lang", "source", "n", "in_lang", "value", "before")
    named = kept.select("lang", "source", "term", "n", "in_lang").join(cells_in, ["lang", "source", "n", "in_lang"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return (named.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
