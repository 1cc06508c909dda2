"""Quoted CSV files read in many tasks.

A quoted field may hold line ends, so where a record ends depends on all quotes before
it.  Only their parity matters: a line end is a record's end if the quotes before it
are even in number.  Every split of a file reports the parity of its quotes and how
many records begin in it, if it begins outside quotes and if inside; prefix sums over
the splits, one small row each, then tell each split how it begins and how many
records come before it.  In a second pass each split cuts out its own records.  Those
that reach over splits are put together from their pieces, one or two for each split.

The files must be well formed: quotes only around fields, and doubled inside of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REPORT = "file string, split long, odd long, begun_outside long, begun_inside long"
_PIECES = "file string, split long, record long, text string, whole boolean"


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """(file, split, quotes, blank, text): the lines in the order of their file, split by split."""
    reader = spark.read.option("lineSep", "\n")
    lines = (reader if glob is None else reader.option("pathGlobFilter", glob)).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
        F.col("value").isin("", "\r").alias("blank"), F.col("value").alias("text"))


def _runs(batch: pa.RecordBatch) -> list[tuple[str, int, pa.RecordBatch]]:
    """A batch in runs of one split."""
    split = batch["split"].to_numpy()
    file = batch["file"].dictionary_encode().indices.to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (split[1:] != split[:-1]) | (file[1:] != file[:-1])]))
    return [(batch["file"][a].as_py(), int(split[a]), batch.slice(a, b - a)) for a, b in zip(new.tolist(), [*new[1:].tolist(), len(split)])]


def _before(quotes: np.ndarray, odd: int) -> np.ndarray:
    """The parity of the quotes before each line, and after the last."""
    return np.concatenate([[odd], odd + np.cumsum(quotes)]) % 2


def _reporting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: (file, split, quotes, blank) to one row for each split."""
    def row(at: tuple[str, int], sums: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in _REPORT.split(", ")), (*at, *sums)))])

    at, sums = None, [0, 0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        for file, split, run in _runs(batch):
            if at != (file, split):
                if at is not None:
                    yield row(at, sums)
                at, sums = (file, split), [0, 0, 0]
            odd = _before(run["quotes"].to_numpy(), sums[0])
            blank = run["blank"].to_numpy(zero_copy_only=False)
            # A blank line between records is none.
            sums = [int(odd[-1]), sums[1] + int(((odd[:-1] == 0) & ~blank).sum()), sums[2] + int(((odd[:-1] == 1) & ~blank).sum())]
    if at is not None:
        yield row(at, sums)


def _cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow task: lines with what is known of their split to the records that begin in it, and to pieces of others."""
    at, odd, record, held = None, 0, -1, []
    out: list[tuple[str, int, int, str, bool]] = []

    def end(whole: bool) -> None:
        if held:
            out.append((*at, record, "\n".join(held), whole and begun))
            held.clear()

    begun = False
    for batch in batches:
        if not batch.num_rows:
            continue
        for file, split, run in _runs(batch):
            if at != (file, split):
                if at is not None:
                    end(odd == 0)
                at, odd, begun = (file, split), run["odd"][0].as_py(), False
                record = run["records"][0].as_py() - 1
            for text, before, blank in zip(run["text"].to_pylist(), _before(run["quotes"].to_numpy(), odd).tolist(),
                                           run["blank"].to_pylist()):
                if not before:
                    end(True)
                    if blank:
                        continue
                    record, begun = record + 1, True
                held.append(text)
            odd = int(_before(run["quotes"].to_numpy(), odd)[-1])
        if len(out) > 1000:
            yield _pieces(out)
            out = []
    if at is not None:
        end(odd == 0)
    yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _PIECES.split(", ")])


def split_starts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, split, odd, records): whether a split begins inside quotes, and the records before it."""
    report = _lines(spark, path, glob).select("file", "split", "quotes", "blank").mapInArrow(_reporting, _REPORT)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = report.withColumn("begins", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn(
        "begun", F.when(F.col("begins") == 0, F.col("begun_outside")).otherwise(F.col("begun_inside")))
    return known.select("file", "split", F.col("begins").alias("odd"), F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("records"))


def csv_records(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, record, text) of all records, headers too, numbered from 0 in each file.  Blank lines between records are none."""
    # One row for each split of the input, so the table is small however large the files are.
    starts = F.broadcast(split_starts(spark, path, glob))
    pieces = _lines(spark, path, glob).join(starts, ["file", "split"]).mapInArrow(_cutting, _PIECES)
    apart = pieces.filter(~F.col("whole")).groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "\n").alias("text"))
    records = pieces.filter("whole").select("file", "record", "text").union(apart)
    return records.withColumn("text", F.regexp_replace("text", "\r$", ""))


def parsed(records: DataFrame, columns: list[str]) -> DataFrame:
    """The records but the headers, as columns of strings beside ``file`` and ``record``."""
    ddl = ", ".join(f"`{c}` string" for c in columns)
    fields = F.from_csv("text", ddl, {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.filter("record > 0").select("file", "record", fields.alias("fields")).select("file", "record", "fields.*")
