"""CSV records that hold line breaks, cut out in parallel.

A quoted cell may hold line breaks, so a line of the file need not be a record,
and a reader that starts in the middle of a file cannot know whether it is
inside quotes. Here every split counts its quotes; the parities, xor-ed over the
splits of a file in order, tell each split whether it starts inside quotes; each
split then cuts its own lines into records, and only the first and last piece of
a split, which a neighbour may have to complete, are put together by a shuffle.
No file is read by one task and no whole line is sorted.

A quote between two ordinary characters (5"6) is text; one that touches a
separator, a line end or another quote opens or closes a cell (RFC 4180: a quote
inside a quoted cell is doubled).
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellar.session import materialize

WHOLE, HEAD, TAIL = 0, 1, 2
#: how a cell with quotes, separators or line breaks is written and read
RFC4180 = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(split, file, start, line, quotes) of every line, in the order of its split.

    ``split`` names a piece of a file that one task reads, ``file`` the file.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    where, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    d = raw.select(F.xxhash64(where, start).alias("split"), F.xxhash64(where).alias("file"), start.alias("start"), line.alias("line"))
    counting = F.regexp_replace("line", '(?<=[^,"])"(?=[^,"\\r])', "")
    quotes = F.when(F.contains("line", F.lit('"')), F.length(counting) - F.length(F.replace(counting, F.lit('"'), F.lit("")))).otherwise(0)
    return d.withColumn("quotes", quotes)


def split_states(all_lines: DataFrame) -> DataFrame:
    """(split, odd, inside): whether a split has a line with an odd number of quotes, and whether it starts inside quotes."""
    per = all_lines.groupBy("split", "file", "start").agg((F.sum("quotes") % 2).alias("parity"), F.max(F.col("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("split", (F.col("odd") > 0).alias("odd"), (F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class _Cutter:
    """Cuts the lines of one split after another into records."""

    def __init__(self, inside: np.ndarray):
        self.inside, self.split, self.out = inside, None, []

    def _begin(self, split: int, file: int, start: int):
        self.split, self.file, self.start = split, file, start
        i = np.searchsorted(self.inside, split)
        self.odd = int(i < len(self.inside) and self.inside[i] == split)
        # until a record starts, lines complete one that an earlier split began
        self.kind, self.open, self.first = (HEAD if self.odd else TAIL), [], True

    def _emit(self, kind: int, first, text: pa.Array):
        n = len(text)
        fixed = [pa.array([v] * n, t) for v, t in ((self.file, pa.int64()), (self.start, pa.int64()), (kind, pa.int32()))]
        flags = np.zeros(n, bool)
        flags[:1] = first
        self.out.append(pa.RecordBatch.from_arrays([*fixed, pa.array(flags), text.cast(pa.string())], names=["file", "start", "kind", "first", "text"]))

    def finish(self):
        """The split's last piece; whether a later split completes it is not known here."""
        if self.split is not None and self.open:
            self._emit(self.kind, self.first and self.kind == TAIL, pa.array(["\n".join(self.open)]))
        self.split = None

    def add(self, split: int, file: int, start: int, text: pa.Array, quotes: np.ndarray):
        if split != self.split:
            self.finish()
            self._begin(split, file, start)
        seen = np.cumsum(quotes)
        begins = np.flatnonzero((self.odd + seen - quotes) % 2 == 0)
        self.odd = int((self.odd + seen[-1]) % 2)
        if not len(begins):
            self.open += text.to_pylist()
            return
        self.open += text.slice(0, begins[0]).to_pylist()
        if self.open:
            self._emit(WHOLE if self.kind == TAIL else HEAD, self.first and self.kind == TAIL, pa.array(["\n".join(self.open)]))
            self.first &= self.kind == HEAD
        self.kind = TAIL
        if len(begins) > 1:
            rows = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), text.slice(0, begins[-1]))
            self._emit(WHOLE, self.first, pc.binary_join(rows, "\n"))
            self.first = False
        self.open = text.slice(begins[-1]).to_pylist()


def _cut_task(inside):
    def task(batches):
        cutter = _Cutter(inside.value)
        for b in batches:
            split, file, start, quotes = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("split", "file", "start", "quotes"))
            text = b.column(b.schema.get_field_index("line"))
            edges = np.flatnonzero(np.diff(split)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi > lo:
                    cutter.add(int(split[lo]), int(file[lo]), int(start[lo]), text.slice(lo, hi - lo), quotes[lo:hi].astype(np.int64))
            yield from cutter.out
            cutter.out = []
        cutter.finish()
        yield from cutter.out

    return task


def records(all_lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, header, text): the records of all files; ``header`` marks the first of a file.

    The splits that start inside quotes are broadcast: eight bytes for each,
    under a ten-millionth of the input at the usual split size.
    """
    spark = all_lines.sparkSession
    inside = np.sort(states.where("inside").select("split").toArrow()["split"].to_numpy())
    task = _cut_task(spark.sparkContext.broadcast(inside))
    cut = all_lines.select("split", "file", "start", "line", F.col("quotes").cast("long").alias("quotes")).mapInArrow(task, "file long, start long, kind int, first boolean, text string")
    cut = materialize(cut)
    # at most two pieces a split: a tail begins a record, the heads after it complete it
    ends = cut.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    ends = ends.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    piece = F.struct("start", "kind", "first", "text")
    stitched = ends.groupBy("file", "record").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    stitched = stitched.select("file", (F.col("p")[0]["first"] & (F.col("p")[0]["start"] == 0)).alias("header"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    whole = cut.where(F.col("kind") == WHOLE).select("file", (F.col("first") & (F.col("start") == 0)).alias("header"), "text")
    return materialize(whole.unionAll(stitched))


def read_records(spark: SparkSession, path: str, encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """A CSV table with a header line in each file, whose quoted cells may hold line breaks.

    Where no line of any file has an odd number of quotes no cell goes over a
    line's end, and Spark's own reader, which splits files at lines, is used.
    Blank lines are no records. A file that ends lines with CR LF loses the CR.
    """
    reader = spark.read.options(**RFC4180)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    every = lines(spark, path, encoding)
    states = materialize(split_states(every))
    if states.where("odd").isEmpty():
        return reader.option("header", True).option("encoding", encoding).csv(path)
    rec = records(every, states)
    head = rec.where("header").agg(F.min_by("text", "file").alias("text")).first()["text"]
    names = next(csv.reader(io.StringIO(head.removeprefix("﻿"))))
    text = F.col("text")
    if head.endswith("\r"):
        text = F.when(F.endswith(text, F.lit("\r")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    body = rec.where(~F.col("header") & (F.trim(text) != "")).select(text.alias("value"))
    # Spark's reader of single records has no Python name for a DataFrame, only for an RDD
    rows = getattr(body._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    out = DataFrame(reader.option("header", False)._jreader.csv(rows), spark)
    return out if schema else out.toDF(*names[: len(out.columns)], *[f"_c{i}" for i in range(len(names), len(out.columns))])
