"""Line dedup over overlapping three-line windows.

Every three consecutive lines of a document form a window; windows are hashed
(128 bits), repeated hashes are found over all documents, and every occurrence
but the first (lowest document, then lowest line) is removed.  The lines that
later occurrences cover are merged per document.  Where a later occurrence
overlaps the first one of the same window in the same document, the lines of
the first one stay.

Windows are aggregated with a map-side partial step and joined back on their
hash, so a window that a third of all documents hold is a skewed join key
(split at run time), never one group in one task.

Defined results: a null text has no lines; an empty text has one empty line; a
document of fewer than three lines has no window and stays; repeated rows (same
id, same text) count as one document and all get its result; null ids come
last in order; other columns are ignored or kept."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadforge.llm.tables import fresh, materialize, row_id, shuffled

WINDOW = 3


def occurrences(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``w1, w2`` (the window's hash) and ``at`` (order of the occurrence:
    document, then first line), one row per window."""
    lines = F.split("text", "\n", -1)
    d = docs.select("doc_id", row_id("doc_id", "text").alias("row"),
                    F.transform(lines, lambda x: F.xxhash64(x)).alias("p"),
                    F.transform(lines, lambda x: F.xxhash64(F.lit(7), x)).alias("q")).where(F.size("p") >= window)
    starts = F.sequence(F.lit(0), F.size("p") - window)
    windows = F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get("p", i + k) for k in range(window)]).alias("w1"),
        F.xxhash64(*[F.get("q", i + k) for k in range(window)]).alias("w2"), i.alias("line")))
    d = d.select("doc_id", "row", F.explode(windows).alias("w"))
    return d.select("w.w1", "w.w2", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "w.line").alias("at"))


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row`` and ``spans`` (first and last line of each later occurrence)."""
    every = occurrences(docs, window)
    # a table of its own: a join whose two sides are plain shuffles can split a hot window
    repeated = materialize(every.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                           .where("first != last").select("w1", "w2", "first"))
    later = every.join(shuffled(repeated), ["w1", "w2"]).where("at != first")
    inside = F.col("at.row") == F.col("first.row")
    lo = F.when(inside, F.greatest(F.col("at.line"), F.col("first.line") + window)).otherwise(F.col("at.line"))
    return (later.select(F.col("at.row").alias("row"), F.struct(lo.alias("lo"), (F.col("at.line") + window - 1).alias("hi")).alias("s"))
            .groupBy("row").agg(F.collect_set("s").alias("spans")))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with ``n_lines, n_removed, n_spans`` (runs
    of removed lines) and ``kept`` (the text that is left)."""
    names = [fresh(docs, x) for x in ("n_lines", "n_removed", "n_spans", "kept")]
    a, b, sp = fresh(docs, "row_a"), fresh(docs, "row_b"), fresh(docs, "row_spans")
    spans = materialize(covered(docs.select("doc_id", "text"), window)
                        .select(F.col("row.a").alias(a), F.col("row.b").alias(b), F.col("spans").alias(sp)))
    row = row_id("doc_id", "text")
    joined = docs.withColumn(a, row["a"]).withColumn(b, row["b"]).join(shuffled(spans), [a, b], "left").select(*docs.columns, sp)
    text_at, span_at = docs.columns.index("text"), len(docs.columns)

    def cut(batches):
        for batch in batches:
            out = ([], [], [], [])
            for text, found in zip(batch.column(text_at).to_pylist(), batch.column(span_at).to_pylist()):
                if text is None:
                    row = (0, 0, 0, None)
                else:
                    lines = text.split("\n") if found else None
                    n = len(lines) if found else text.count("\n") + 1
                    if not found:
                        row = (n, 0, 0, text)
                    else:
                        cover = np.zeros(n + 1, np.int32)
                        np.add.at(cover, [s["lo"] for s in found], 1)
                        np.add.at(cover, [s["hi"] + 1 for s in found], -1)
                        gone = np.cumsum(cover)[:n] > 0
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        row = (n, int(gone.sum()), runs, "\n".join(x for x, g in zip(lines, gone.tolist()) if not g))
                for column, value in zip(out, row):
                    column.append(value)
            more = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            cols = batch.columns[:span_at] + more
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:span_at] + names)

    schema = joined.drop(sp).schema
    for name, kind in zip(names, ("long", "long", "long", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(cut, schema)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: ``doc_id, n_lines, n_removed, n_spans, kept_sha256``."""
    d = dedup_lines(docs.select("doc_id", "text"), window)
    return d.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the repeated windows taken out of their texts; a
    document that loses all its lines goes, all others stay."""
    d = dedup_lines(docs, window)
    n_lines, n_removed, _, kept = d.columns[len(docs.columns):]
    d = d.where((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    return d.select(*[F.col(kept).alias(c) if c == "text" else F.col(c) for c in docs.columns])
