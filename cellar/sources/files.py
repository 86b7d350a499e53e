"""File sources and sinks."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cellar.operators.cleaning import clean_pipeline
from cellar.session import discard, materialize, scratch_path
from cellar.sources.csvtext import RFC4180, read_records

# what Spark escapes in the names of partition folders
_ESCAPES = {ord(c): f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]}
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"
#: what a folder's id reads as, OTHER: it is no folder of documents
NULL, INT, LONG, TEXT, UNCLEAR, OTHER = range(6)
#: as many files a task at most, and bytes of texts in a batch
TASK_FILES, BATCH_BYTES = 2000, 4 << 20


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the cluster's shared checkpoint folder, deleted when the driver ends."""
    return scratch_path(spark, name)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else ISO-8859-1 (which accepts any byte).

    Spark's CSV reader never fails on bad bytes, so the check is explicit:
    one distributed ``bool_and(is_valid_utf8(line))`` over the raw lines.
    """
    raw = spark.read.text(path)
    ok = raw.select(F.coalesce(F.bool_and(F.is_valid_utf8(F.col("value"))), F.lit(True))).first()[0]
    return "UTF-8" if ok else "ISO-8859-1"


def read_csv(
    spark: SparkSession,
    path: str,
    clean: bool = True,
    encoding: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """src_csv: header row, inferred (or given) types, then the cleaning pipeline.

    Quoted cells may hold separators, doubled quotes and line breaks; an empty
    cell, quoted or not, is missing.
    """
    df = read_records(spark, path, encoding or detect_encoding(spark, path), schema)
    if not clean:
        return df
    return clean_pipeline(df)


def _store_root(spark: SparkSession, path: str) -> str:
    """A folder as ``_opened`` takes it in any process: a path on a local disk, else a URI."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri()
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


def _opened(base: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), base) if base.startswith("/") else pafs.FileSystem.from_uri(base)


def _entries(fs: pafs.FileSystem, at: str) -> Iterator[tuple[str, bool]]:
    """(name, whether a folder); of a local folder, which may be long, one by one."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(at) as found:
            yield from ((e.name, e.is_dir()) for e in found)
    else:
        yield from ((x.base_name, x.type == pafs.FileType.Directory) for x in fs.get_file_info(pafs.FileSelector(at)))


def _hidden(name: str) -> bool:
    return name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")


def _unescape(name: str) -> str:
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def _kind(raw: str) -> int:
    """How Spark types the value of a partition folder; UNCLEAR if only Spark can tell."""
    if raw == _NO_KEY:
        return NULL
    if re.fullmatch("[+-]?[0-9]+", raw):
        v = int(raw)
        return INT if -(1 << 31) <= v < 1 << 31 else LONG if -(1 << 63) <= v < 1 << 63 else UNCLEAR
    # numbers, dates and times begin with a digit, a sign, a point, NaN, Infinity or T
    c = _unescape(raw)[:1]
    return TEXT if c.isprintable() and not c.isspace() and not c.isnumeric() and c not in "+-.NIT" else UNCLEAR


def _list_documents(spark: SparkSession, base: str, id_col: str) -> DataFrame:
    """(folder, file, id, size, kind) of the non-empty text files in the ``id_col=value`` folders; kind OTHER for what is neither."""

    def folders(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((name, is_folder and _unescape(name.split("=")[0]) == id_col and name[-1] != "=") for name, is_folder in _entries(*_opened(base)) if not _hidden(name))
        for rows in iter(lambda: [*itertools.islice(found, 10_000)], []):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["folder", "known"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _opened(base)
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        for b in batches:
            rows = []
            for folder, known in zip(b["folder"].to_pylist(), b["known"].to_pylist()):
                if not known:
                    rows.append((folder, None, None, 0, OTHER))
                    continue
                raw = folder.split("=", 1)[1]
                key, kind = None if raw == _NO_KEY else _unescape(raw), _kind(raw)
                for x in fs.get_file_info(pafs.FileSelector(f"{at}/{folder}")):
                    if _hidden(x.base_name) or x.is_file and not x.size:
                        continue
                    rows.append((folder, x.base_name, key, x.size or 0, kind if x.is_file and x.extension == "txt" else OTHER))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["folder", "file", "id", "size", "kind"])

    names = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string, known boolean")
    names = names.repartition(4 * spark.sparkContext.defaultParallelism, "folder")
    return materialize(names.mapInArrow(files, "folder string, file string, id string, size long, kind int"))


def _read_documents(spark: SparkSession, path: str, id_col: str) -> DataFrame | None:
    """(id_col, value) of the text files in ``id_col=value`` folders, listed and read by the tasks; None if there is more.

    Spark's reader keeps every file in the driver and reads a few of them a task. The id's type is the one Spark finds.
    """
    try:
        base = _store_root(spark, path)
        fs, at = _opened(base)
        if fs.get_file_info(at).type != pafs.FileType.Directory:
            return None
    except (pa.ArrowException, ImportError, OSError):  # a store that only Spark opens
        return None
    listed = _list_documents(spark, base, id_col)
    n, size, kinds = listed.agg(F.count(F.lit(1)), F.sum("size"), F.collect_set("kind")).first()
    unsure = {OTHER} if TEXT in kinds else {OTHER, UNCLEAR}
    if not {*kinds} - {NULL} or unsure & {*kinds}:
        discard(listed)
        return None
    infer = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"
    kind = "string" if TEXT in kinds or not infer else "bigint" if LONG in kinds else "int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _opened(base)
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["id", "value"])
        ids, texts, held = [], [], 0
        for b in batches:
            for folder, file, key in zip(*(b[c].to_pylist() for c in ("folder", "file", "id"))):
                with fs.open_input_stream(f"{at}/{folder}/{file}", compression=None) as f:
                    texts.append(f.read())
                ids.append(key)
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield batch()
                    ids, texts, held = [], [], 0
        if ids:
            yield batch()

    per = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    dealt = listed.select("folder", "file", "id").repartition(max(-(-size // per), -(-n // TASK_FILES)), "folder", "file")
    return dealt.mapInArrow(read, "id string, value binary").select(F.col("id").cast(kind).alias(id_col), F.col("value").cast("string").alias("value"))


def read_text_corpus(spark: SparkSession, path: str, id_col: str | None = None, record_end: bool = False) -> DataFrame:
    """src_text_corpus: each file is one document (``wholetext``); many files at once.

    The key is ``id_col`` when the folder layout provides it (``key=value``
    partition folders), else the file path from ``_metadata``. The text is the
    file's whole content; ``record_end`` takes off the one line break that
    ``write_documents`` puts after each text, and no other. Plain ``.txt`` files
    in folders of one key are listed and read without passing the driver.
    """
    df = _read_documents(spark, path, id_col) if id_col else None
    if df is None:
        df = spark.read.text(path, wholetext=True)
    text = F.col("value")
    if record_end:
        text = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    text = text.alias("text")
    if id_col and id_col in df.columns:
        return df.select(F.col(id_col), text)
    return df.select(F.col("_metadata.file_path").alias("path"), text)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """sink_csv: header, no index column, quotes doubled; one file per task (distributed write)."""
    df.write.mode(mode).option("header", True).options(**RFC4180).csv(path)
    return path


def write_all_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """sink_all_tables: one sub-folder, with its full name, per non-empty named table.

    Names that differ only in case would share a folder on some file systems: an error.
    """
    low = [n.lower() for n in tables]
    if len(set(low)) < len(low):
        raise ValueError(f"table names are not distinct: {sorted(tables)}")
    written = []
    for name, df in tables.items():
        if df.isEmpty():
            continue
        w = df.write.mode("overwrite")
        (w.option("header", True).options(**RFC4180).csv if fmt == "csv" else w.parquet)(f"{path.rstrip('/')}/{name}")
        written.append(name)
    return written


def write_report(report: DataFrame, path: str) -> str:
    """sink_report: the one-row report as a text file."""
    report.select(F.col(report.columns[0]).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> str:
    """One file per document under ``key=<value>`` folders (read_text_corpus with ``record_end`` reads them back).

    Meant for round-trip checks and modest corpora: a file per document is the
    semantics of a document folder, but billions of tiny files are not a good
    storage layout — keep large corpora as Parquet ``(doc_id, text)`` tables.
    """
    spark, escapes = df.sparkSession, _ESCAPES
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(root, True)
    store.mkdirs(root)
    base = _store_root(spark, path)

    def write(rows: Iterator[Row]) -> None:
        # Spark's own writer starts several processes a file on a local disk and moves each file in the driver
        fs, at = _opened(base)
        for k, texts in itertools.groupby(rows, lambda r: r[0]):
            folder = f"{at}/{key.translate(escapes)}={k.translate(escapes) if k else _NO_KEY}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/part.txt") as out:
                for r in texts:
                    out.write((r[1] or "").encode() + b"\n")

    named = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("v"))
    named.repartition("k").sortWithinPartitions("k").foreachPartition(write)
    return path
