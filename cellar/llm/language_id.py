"""Language identification by compression.

Each language has a zstandard raw-content dictionary of training text. A text
is encoded with every dictionary, in pieces short enough that the dictionary
matters throughout, and the language with the smallest code is chosen. A text
whose two smallest codes differ too little is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import chunks

DICT_BYTES = 110_000
EXTRACT_BYTES = 400
PIECE = 512
LEVEL = 6
MIN_MARGIN = 0.005
UND = "und"


def fit_dictionaries(docs: DataFrame, train: Column, text_col="text", lang_col="lang", dict_bytes=DICT_BYTES, extract=EXTRACT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language: ``extract`` characters out of the middle of many documents.

    The sample is bounded: about ``dict_bytes`` a language, from documents
    chosen by the hash of their text among the training rows of that language;
    every row takes part in the choice. Rows with a null language or without a
    letter teach nothing.
    """
    t = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    t = t.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    n = {r.lang: r.n for r in t.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return {}
    want = 4 * dict_bytes // extract
    rate = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, want / v)))])[F.col("lang")]
    u = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    start = F.greatest(F.lit(1), (F.length("text") - extract) / 2).cast("int")
    picked = t.where(u < rate).select("lang", F.substring("text", start, F.lit(extract)).alias("part"), u.alias("u")).distinct().toPandas()
    out = {}
    for lang, g in picked.groupby("lang"):
        parts, size = [], 0
        for p in g.sort_values(["u", "part"])["part"]:
            parts.append(_fold(p))
            size += len(parts[-1])
            if size >= dict_bytes:
                break
        out[str(lang)] = b"\n".join(parts)
    return out


def _fold(text: str) -> bytes:
    """Lower-cased letters with single blanks between words: digits and marks say little about a language."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace")


_LETTERS = regex.compile(r"\p{L}+")


def _judge_task(dicts: dict[str, bytes], text_col: str, min_margin: float, keep_all: bool):
    langs = sorted(dicts)

    def task(batches):
        fold = regex.compile(r"\p{L}+")
        coders = []
        for x in langs:
            d = zstandard.ZstdCompressionDict(dicts[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            for c in chunks(batch, text_col):
                pred, score, rejected = [], [], []
                for text in c.column(c.schema.get_field_index(text_col)).to_pylist():
                    raw = " ".join(fold.findall(text.lower())).encode("utf-8", "replace") if text else b""
                    if not raw or not langs:
                        pred.append(UND)
                        score.append(0.0)
                        rejected.append(True)
                        continue
                    pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]
                    size = [sum(len(z.compress(p)) for p in pieces) for z in coders]
                    by = sorted(range(len(langs)), key=lambda k: size[k])  # ties: the first language by name
                    best = size[by[0]]
                    margin = 1.0 if len(langs) == 1 else (size[by[1]] - best) / size[by[1]]
                    pred.append(langs[by[0]])
                    score.append(margin)
                    rejected.append(margin < min_margin)
                if keep_all:
                    yield pa.RecordBatch.from_arrays(
                        [*c.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                        names=[*c.schema.names, "lang_pred", "score", "rejected"],
                    )
                else:
                    yield c.filter(pa.array(np.logical_not(rejected)))

    return task


def identify(docs: DataFrame, dicts: dict[str, bytes], text_col="text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Every row and column of ``docs`` (but columns of the new names) with lang_pred, score and rejected.

    score is the margin, (second smallest - smallest) / second smallest code
    length, from 0 to 1. ``rejected``: the margin is below ``min_margin``, or
    the text is null, empty or has no letter (lang_pred ``und``, score 0).
    Equal codes go to the first language by name. Whole texts are encoded.
    """
    d = docs.drop("lang_pred", "score", "rejected")
    schema = d.withColumn(text_col, F.col(text_col).cast("string")).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    return d.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(_judge_task(dicts, text_col, min_margin, True), schema)


def accept(docs: DataFrame, dicts: dict[str, bytes], text_col="text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns unchanged."""
    return docs.mapInArrow(_judge_task(dicts, text_col, min_margin, False), docs.schema)


