"""Benchmark decontamination by winnowing.

Every run of ``k`` words is hashed; of each ``w`` consecutive hashes the least
(the rightmost of equals) is kept, with w + k - 1 = ``span``. Any ``span``
words that a document shares with a benchmark item therefore share a kept
fingerprint. Kept fingerprints of both sides are joined, and each match is
extended word by word to the left and right; a match whose shared stretch has
``span`` words or more is a hit. Items shorter than ``span`` words are matched
as one window of their own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import Words, as_long, chunks, grams, test_bits, words
from cellar.llm.support import bitmap, documents, join_key, with_text_key
from cellar.session import materialize

SPAN = 10
GRAM = 5
BITMAP_LOG2 = 24
_SCHEMA = "key long, doc_id {id}, th long, n_words long, len int, fp long, pos long, ctx binary"


def _winnow(w: Words, span: int, k: int) -> np.ndarray:
    """Word positions whose k-gram hash is kept; also the k-gram hashes."""
    g = grams(w.hash, k)
    width = span - k + 1
    m = len(g) - width + 1
    if m <= 0:
        return np.empty(0, np.int64), g
    best, arg = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, width):
        c = g[j : j + m]
        take = c <= best
        best = np.where(take, c, best)
        arg[take] = j
    whole = np.arange(m) + span <= w.text_end()[:m]
    kept = np.zeros(len(g), dtype=bool)
    kept[(np.arange(m) + arg)[whole]] = True
    return np.flatnonzero(kept), g


def _context(w: Words, at: np.ndarray, lead: int, width: int, pad: int) -> np.ndarray:
    """Hashes of the words at-lead .. at-lead+width-1; ``pad`` outside the text."""
    text = np.searchsorted(w.off, at, "right") - 1
    idx = at[:, None] - lead + np.arange(width)[None, :]
    inside = (idx >= w.off[text][:, None]) & (idx < w.off[text + 1][:, None])
    return np.where(inside, w.hash[np.clip(idx, 0, max(len(w.hash) - 1, 0))], np.uint64(pad))


def _fingerprints(span: int, k: int, lengths: list[int] | None, bits, pad: int):
    """Arrow task: a row per text (len null) and a row per kept fingerprint.

    ``lengths`` lists the window lengths below ``span`` to look for (None: the
    input holds the items, and a short item is one window of its length).
    """
    width = 2 * span - k

    def rows(w: Words):
        at, g = _winnow(w, span, k)
        h = g[at]
        if bits is not None:
            ok = test_bits(bits.value, h)
            at, h = at[ok], h[ok]
        yield span, at, h
        for n in range(1, span) if lengths is None else lengths:
            g = grams(w.hash, n)
            if lengths is None:
                at = w.off[:-1][w.counts == n]
            else:
                at = np.flatnonzero(np.arange(len(g)) + n <= w.text_end()[: len(g)])
            h = g[at]
            if bits is not None:
                ok = test_bits(bits.value, h)
                at, h = at[ok], h[ok]
            yield n, at, h

    def task(batches):
        nxt = (TaskContext.get().partitionId()) << 40
        for batch in batches:
            for c in chunks(batch):
                w = words(c.column(c.schema.get_field_index("text")))
                n = c.num_rows
                key = np.arange(nxt, nxt + n)
                nxt += n
                ids, th = c.column(c.schema.get_field_index("doc_id")), c.column(c.schema.get_field_index("th"))
                null = lambda t: pa.nulls(n, t)
                yield _batch(ids.type, [key, ids, th, w.counts, null(pa.int32()), null(pa.int64()), null(pa.int64()), null(pa.binary())])
                for ln, at, h in rows(w):
                    if not len(at):
                        continue
                    text = np.searchsorted(w.off, at, "right") - 1
                    ctx = _context(w, at, span - k, width, pad) if ln == span else _context(w, at, 0, width, pad)
                    raw = np.ascontiguousarray(ctx).tobytes()
                    off = np.arange(len(at) + 1, dtype=np.int32) * (width * 8)
                    ctx = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(raw)])
                    take = pa.array(text)
                    yield _batch(
                        ids.type,
                        [key[text], ids.take(take), th.take(take), pa.nulls(len(at), pa.int64()), np.full(len(at), ln, np.int32), as_long(h), at - w.off[text], ctx],
                    )

    return task


def _batch(id_type, cols) -> pa.RecordBatch:
    types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "doc_id", "th", "n_words", "len", "fp", "pos", "ctx"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _extend(span: int, k: int):
    """Arrow task: keep the matches whose shared stretch is long enough, with its words."""
    lead, width = span - k, 2 * span - k

    def task(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = lambda n: b.column(b.schema.get_field_index(n))
            block = lambda n: np.frombuffer(b"".join(col(n).to_pylist()), np.uint64).reshape(-1, width)
            same = block("ctx") == block("item_ctx")
            ln, pos = col("len").to_numpy(zero_copy_only=False), col("pos").to_numpy(zero_copy_only=False)
            left = np.cumprod(same[:, :lead][:, ::-1], axis=1).sum(axis=1)
            right = np.cumprod(same[:, lead + k :], axis=1).sum(axis=1)
            full = (ln == span) & same[:, lead : lead + k].all(axis=1) & (left + k + right >= span)
            short = (ln < span) & ((same | (np.arange(width)[None, :] >= ln[:, None])).all(axis=1))
            ok = full | short
            s = np.where(full, pos - left, pos)[ok]
            e = np.where(full, pos + k + right, pos + ln)[ok]
            sel = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([col("key").take(sel), pa.array(s, pa.int64()), pa.array(e, pa.int64()), col("item").take(sel)], names=["key", "s", "e", "item"])

    return task


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, th, n_words, n_hit, items (sorted item ids as text).

    A word is hit if it lies in an occurrence of ``span`` consecutive words of
    an item, or of a whole shorter item. Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased. A null or wordless text has no
    words and no hits; a wordless item matches nothing; a null item id counts
    as the empty text. Repeated rows each get their own row. Empty tables give
    zero hits or zero rows.

    Only documents' fingerprints that pass a fixed-size bitmap of the
    benchmark's travel; a bitmap hit is confirmed by the join and by comparing
    the words around it. Every occurrence of an item's window yields its own
    kept fingerprint, so extending by span - k words on each side is enough.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    spark = docs.sparkSession
    items = with_text_key(documents(benchmark, item_col, text_col))
    items = materialize(items.mapInArrow(_fingerprints(span, k, None, None, 1), _SCHEMA.format(id=dict(items.dtypes)["doc_id"])))
    prints = items.where("len IS NOT NULL").select(
        "len", "fp", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), F.col("ctx").alias("item_ctx")
    ).distinct()
    lengths = sorted(r[0] for r in prints.select("len").distinct().collect() if r[0] < span)
    bits = spark.sparkContext.broadcast(bitmap(prints, "fp", BITMAP_LOG2))
    d = with_text_key(documents(docs, id_col, text_col))
    d = materialize(d.mapInArrow(_fingerprints(span, k, lengths, bits, 0), _SCHEMA.format(id=dict(d.dtypes)["doc_id"])))
    pairs = d.where("len IS NOT NULL").select("key", "len", "fp", "pos", "ctx").join(prints, ["len", "fp"])
    hits = pairs.select("key", "len", "pos", "ctx", "item", "item_ctx").mapInArrow(_extend(span, k), "key long, s long, e long, item string")
    found = hits.groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    covered = F.expr(
        "aggregate(spans, struct(0L AS n, 0L AS upto), (a, x) -> "
        "struct(a.n + greatest(0L, x.e - greatest(x.s, a.upto)) AS n, greatest(a.upto, x.e) AS upto)).n"
    )
    found = found.select("key", covered.alias("n_hit"), "items")
    return (
        d.where("len IS NULL")
        .select("key", "doc_id", "th", "n_words")
        .join(found, "key", "left")
        .select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark."""
    bad = contamination(docs, benchmark, id_col, text_col, **kw).where("n_hit > 0").select("doc_id", "th").distinct()
    return join_key(docs, materialize(bad), "left_anti", id_col, text_col)
