"""WAV recordings and record headers."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.pieces import PIECE_ROWS

SAMPLE_SCHEMA = "path string, fs int, channel int, block long, values array<double>"
COLUMNS = ["path", "fs", "channel", "block", "values"]
FLUSH_SAMPLES = 1_000_000  # decoded samples held before they are handed on; or PIECE_ROWS blocks, where these are short


def read_files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Recording files as ``(path, content)``; one file is one row."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(path).select("path", "content"))


def _decode(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples ``[T, C]``; integer PCM is divided by the type's largest value."""
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at:at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", content, body)
            if fmt[0] == 0xFFFE:  # the extensible form names the real format further on
                fmt = (struct.unpack_from("<H", content, body + 24)[0], *fmt[1:])
        elif name == b"data":
            kind, channels, fs, _, _, bits = fmt
            raw = content[body:body + size]
            if kind == 3:
                x = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
            elif bits == 8:
                x = np.frombuffer(raw, np.uint8) / 255.0
            elif bits == 24:
                wide = np.zeros((len(raw) // 3, 4), np.uint8)
                wide[:, 1:] = np.frombuffer(raw, np.uint8)[:len(raw) // 3 * 3].reshape(-1, 3)
                x = wide.view("<i4").ravel() / float(2 ** 31 - 1)
            else:
                x = np.frombuffer(raw, f"<i{bits // 8}") / float(2 ** (bits - 1) - 1)
            return fs, x[:len(x) // channels * channels].reshape(-1, channels)
        at = body + size + size % 2
    raise ValueError("no data chunk")


def decode(files: DataFrame, block: int = 4096) -> DataFrame:
    """``(path, content)`` to blocks per channel; unreadable files give no rows (``unreadable`` lists them)."""

    def run(batches):
        rows, held = [], 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    fs, x = _decode(bytes(content))
                except (ValueError, TypeError, struct.error):
                    continue
                rows += [(path, fs, c, s // block, x[s:s + block, c])
                         for c in range(x.shape[1]) for s in range(0, len(x), block)]
                held += x.size
                if held >= FLUSH_SAMPLES or len(rows) >= PIECE_ROWS:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return files.select("path", "content").mapInPandas(run, SAMPLE_SCHEMA)


def unreadable(files: DataFrame) -> DataFrame:
    """``(path, problem)`` for the files that ``decode`` gives no rows for."""

    def run(batches):
        for pdf in batches:
            found = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    _decode(bytes(content))
                except (ValueError, TypeError, struct.error) as e:
                    found.append((path, str(e) or type(e).__name__))
            yield pd.DataFrame(found, columns=["path", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, problem string")


def ingest(spark: SparkSession, path: str, out: str, block: int = 4096) -> DataFrame:
    """Decode all recordings below ``path`` into a Parquet table of blocks."""
    blocks = decode(read_files(spark, path), block).withColumn(
        "record_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    blocks.write.parquet(out)
    return spark.read.parquet(out)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of the ``.hea`` headers below ``path``."""
    files = (spark.read.option("pathGlobFilter", "*.hea").option("recursiveFileLookup", True)
             .text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))
    return parse_headers(files)


def parse_headers(files: DataFrame) -> DataFrame:
    """``(path, value)`` header texts to ``record_id, n_channels, fs, n_samples, channels``."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    rows = files.withColumn("__l", lines).withColumn("__h", F.split(F.trim(F.get("__l", F.lit(0))), r"\s+"))
    part = lambda i: F.get("__h", F.lit(i))
    n = part(1).cast("int")
    names = F.transform(F.slice("__l", F.lit(2), n),
                        lambda s: F.element_at(F.split(F.trim(s), r"\s+"), -1))
    return rows.select(F.split(part(0), "/")[0].alias("record_id"), n.alias("n_channels"),
                       F.regexp_extract(part(2), r"^[0-9.]+", 0).cast("double").alias("fs"),
                       part(3).cast("long").alias("n_samples"), names.alias("channels"))


def match_files(patients: DataFrame, files: DataFrame, patient: str = "patient", name: str = "file"
                ) -> DataFrame:
    """All ``(patient, file)`` pairs where the file name contains the patient id.

    File names are short: each is cut into its distinct pieces of the lengths that patient ids
    have, and pieces are joined with ids by equality. No pair is formed that does not match.
    """
    lengths = patients.select(F.length(patient).alias("n")).distinct().agg(
        F.collect_list("n").alias("l")).scalar()
    sized = files.select(name, F.explode(lengths).alias("__n")).where(F.length(name) >= F.col("__n"))
    pieces = sized.select(name, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(name) - F.col("__n") + 1),
        lambda i: F.substring(F.col(name), i, F.col("__n"))))).alias(patient))
    return pieces.join(patients.select(patient).distinct(), patient).select(patient, name)


def ambiguous_files(matches: DataFrame, patient: str = "patient", name: str = "file") -> DataFrame:
    """Files that more than one patient id matches."""
    return matches.groupBy(name).agg(F.count(F.lit(1)).alias("patients"),
                                     F.min(patient).alias("first_patient")).where("patients > 1")
