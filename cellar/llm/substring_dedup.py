"""Substring deduplication over sliding spans of sentences and of words.

A sentence span is a run of consecutive sentences starting at any sentence and
holding at least ``sentences`` of them and ``min_words`` words. A word span
starts at any cut and ends at the first cut ``RUN_WORDS`` or more words on; the
cuts are the words of least hash in each ``WINDOW`` words, whatever stops and
line breaks stand between them. Spans are hashed, equal hashes are joined over
the whole corpus, and words covered by a span that is not the first of its kind
are removed.

Cuts at least ``WINDOW`` - 1 words inside a shared run depend on the run alone,
and no ``WINDOW`` words are without one. So a shared run of 4 * ``WINDOW`` - 3 +
``RUN_WORDS`` words, 49, has a common word span wherever it stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import Words, as_long, chunks, grouped_sum, mix, powers, test_bits, words
from cellar.llm.support import bitmap, documents, free, with_text_key
from cellar.session import materialize

SENTENCES = 3
MIN_WORDS = 12
LONG_SENTENCE = 16
WINDOW = 8
RUN_WORDS = 20
BITMAP_LOG2 = 24
_ODD = np.uint64(0x2545F4914F6CDD1D)
_INV = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))


def _sentences(w: Words, long_sentence: int) -> np.ndarray:
    """First word of each sentence of the chunk (texts never share one).

    A sentence ends at . ! ? before white space, at a line break, and at the
    text's end. One of more than ``long_sentence`` words is cut further after
    words chosen by their hash (one in eight), so that the same passage is cut
    alike wherever it stands.
    """
    n = len(w.hash)
    if n == 0:
        return np.empty(0, np.int64)
    d = w.data
    line = d == 0x0A
    space = line | (d == 0x20) | ((d >= 0x09) & (d <= 0x0D))
    stop = (d == 0x2E) | (d == 0x21) | (d == 0x3F)
    end = line.copy()
    end[:-1] |= stop[:-1] & space[1:]
    seen = np.cumsum(end, dtype=np.int32)
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = seen[w.start[1:]] != seen[w.end[:-1] - 1]
    first[w.off[:-1][w.counts > 0]] = True
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    long = np.repeat(size > long_sentence, size)
    first[1:] |= long[:-1] & ((w.hash[:-1] >> np.uint64(20)) & np.uint64(7) == 0)
    return np.flatnonzero(first)


def _cuts(w: Words) -> np.ndarray:
    """Words that have the least hash (the first of equals) of some ``WINDOW`` consecutive words of their text."""
    m = len(w.hash) - WINDOW + 1
    if m <= 0:
        return np.empty(0, np.int64)
    least, at = w.hash[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, WINDOW):
        c = w.hash[j : j + m]
        at[c < least] = j
        np.minimum(least, c, out=least)
    start = np.arange(m)
    cut = np.zeros(len(w.hash), bool)
    cut[(start + at)[start + WINDOW <= w.text_end()[:m]]] = True
    return np.flatnonzero(cut)


def _word_spans(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and hash of each word span."""
    cut = _cuts(w)
    k = np.searchsorted(cut, cut + RUN_WORDS)
    ok = k < len(cut)
    a, b = cut[ok], cut[k[ok]]
    inside = b <= w.text_end()[a]
    a, b = a[inside], b[inside]
    m = len(w.hash)
    prefix = np.zeros(m + 1, np.uint64)
    np.cumsum(mix(w.hash + _ODD) * powers(m, _ODD), out=prefix[1:])
    return a, b, mix((prefix[b] - prefix[a]) * powers(m, _INV)[a] + (b - a).astype(np.uint64) * _ODD)


def _spans(w: Words, sentences: int, min_words: int, long_sentence: int):
    """First word, word after the last, and hash of each span of either kind."""
    first, _, i, j, h = _sentence_spans(w, sentences, min_words, long_sentence)
    edge = np.append(first, len(w.hash))
    a, b, g = _word_spans(w)
    return np.concatenate([edge[i], a]), np.concatenate([edge[j + 1], b]), np.concatenate([h, g])


def _sentence_spans(w: Words, sentences: int, min_words: int, long_sentence: int):
    """Sentence starts, sentence offsets per text, and each span's first and last sentence and hash."""
    first = _sentences(w, long_sentence)
    m = len(first)
    edge = np.append(first, len(w.hash))
    soff = np.searchsorted(first, w.off)
    size = np.diff(edge)
    pos = (np.arange(len(w.hash)) - np.repeat(edge[:-1], size)).astype(np.uint64)
    sh = mix(grouped_sum(mix(w.hash + pos * _ODD), edge) + size.astype(np.uint64))
    last = np.maximum(np.arange(m) + sentences - 1, np.searchsorted(edge, edge[:-1] + min_words, "left") - 1)
    text_end = np.repeat(soff[1:], np.diff(soff))
    i = np.flatnonzero(last < text_end)
    j = last[i]
    prefix = np.zeros(m + 1, np.uint64)
    np.cumsum(sh * powers(m, _ODD), out=prefix[1:])
    h = mix((prefix[j + 1] - prefix[i]) * powers(m, _INV)[i] + (j - i).astype(np.uint64) * _INV)
    return first, soff, i, j, h


def _count_task(args):
    def task(batches):
        for batch in batches:
            for c in chunks(batch):
                h = _spans(words(c.column(0)), *args)[2]
                u, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(u)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return task


def _place_task(args, bits):
    def task(batches):
        for batch in batches:
            for c in chunks(batch):
                col = lambda n: c.column(c.schema.get_field_index(n))  # noqa: B023, E731
                w = words(col("text"))
                i, j, h = _spans(w, *args)
                ok = np.flatnonzero(test_bits(bits.value, h))
                i, j, h = i[ok], j[ok], h[ok]
                text = np.searchsorted(w.off, i, "right") - 1
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(h)), col("doc_id").take(take), col("th").take(take), pa.array((i - w.off[text]).astype(np.int32)), pa.array((j - w.off[text]).astype(np.int32))],
                    names=["h", "doc_id", "th", "i", "j"],
                )

    return task


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", sentences=SENTENCES, min_words=MIN_WORDS, long_sentence=LONG_SENTENCE) -> DataFrame:
    """(doc_id, th, spans): the word ranges i..j-1 of each document that repeat an earlier span.

    Spans are ordered by (doc_id, nulls last; text hash; position). Spans are
    first counted (a row per distinct span and chunk travels); only those that
    pass a fixed-size bitmap of the repeated ones are placed and joined, so a
    passage that a third of all documents share is a skewed join of narrow
    rows, split by adaptive execution.
    """
    args = (sentences, min_words, long_sentence)
    d = documents(docs, id_col, text_col)
    seen = d.select("text").mapInArrow(_count_task(args), "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    twice = materialize(seen.where("n > 1").select("h"))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(twice, "h", BITMAP_LOG2))
    keyed = with_text_key(d)
    id_type = dict(keyed.dtypes)["doc_id"]
    placed = materialize(keyed.mapInArrow(_place_task(args, bits), f"h long, doc_id {id_type}, th long, i int, j int"))
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th", "i")
    firsts = placed.groupBy("h").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialize(firsts.select("h", "first"))
    later = placed.join(firsts, "h").where(~order.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("i", "j"))).alias("spans"))


def _remove_task(text_col, spans_col, report, long_sentence):
    """Cut the covered words out of each text; a word runs up to the next one's first byte."""

    def task(batches):
        for batch in batches:
            for c in chunks(batch, text_col):
                k = c.schema.get_field_index(text_col)
                sp = c.column(c.schema.get_field_index(spans_col))
                w = words(c.column(k))
                first = _sentences(w, long_sentence)
                soff = np.searchsorted(first, w.off)
                out = c.column(k).to_pylist()
                gone = np.zeros(len(out), np.int64)
                lost = np.zeros(len(out), np.int64)
                for r in np.flatnonzero(sp.is_valid().to_numpy(zero_copy_only=False)):
                    a, b = w.off[r], w.off[r + 1]
                    cover = np.zeros(b - a + 1, np.int64)
                    for s in sp[int(r)].as_py():
                        cover[s["i"]] += 1
                        cover[s["j"]] -= 1
                    drop = np.cumsum(cover[:-1]) > 0
                    t0, t1 = w.text_off[r], w.text_off[r + 1]
                    starts = np.append(w.start[a:b], t1)
                    starts[0] = t0
                    # runs of kept words
                    turn = np.flatnonzero(np.diff(np.concatenate(([True], drop, [True]))))
                    raw = w.data
                    out[r] = b"".join(raw[starts[s] : starts[e]].tobytes() for s, e in zip(turn[::2], turn[1::2])).decode("utf-8", "replace")
                    gone[r] = np.logical_and.reduceat(drop, first[soff[r] : soff[r + 1]] - a).sum()
                    lost[r] = drop.sum()
                cols = [x for n, x in enumerate(c.columns) if c.schema.names[n] != spans_col]
                names = [x for x in c.schema.names if x != spans_col]
                cols[names.index(text_col)] = pa.array(out, pa.string())
                if report:
                    cols += [pa.array(np.diff(soff)), pa.array(gone), pa.array(lost)]
                    names += ["n_sentences", "n_removed", "words_removed"]
                yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in cols], names=names)

    return task


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", report: bool = False, sentences=SENTENCES, min_words=MIN_WORDS, long_sentence=LONG_SENTENCE) -> DataFrame:
    """Every row of ``docs`` with the repeated passages cut out of its text; all columns stay.

    The first place of a span keeps it; every other place, also in the same
    document, loses the words it covers. Rows that repeat both id and text
    are one document and are cut alike. A null text stays null, an empty text
    empty; a text may become empty but no row is dropped. Words and case, not
    punctuation, decide whether spans are equal (A-Z lower-cased).
    ``report`` adds n_sentences, n_removed (wholly removed) and words_removed.
    """
    (sp,) = free(docs.columns, "spans")
    spans = repeated_spans(docs, id_col, text_col, sentences, min_words, long_sentence).withColumnRenamed("spans", sp)
    from cellar.llm.support import join_key

    joined = join_key(docs.withColumn(text_col, F.col(text_col).cast("string")), materialize(spans), "left", id_col, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    schema = ", ".join(f"`{f.name}` " + ("string" if f.name == text_col else f.dataType.simpleString()) for f in docs.schema)
    del fields
    if report:
        schema += ", n_sentences long, n_removed long, words_removed long"
    return joined.mapInArrow(_remove_task(text_col, sp, report, long_sentence), schema)
