"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted in Spark. Words one edit apart are found by probing:
every deletion of a word, and every replacement of one of its characters by a
later one of the alphabet, is generated as a hash only and looked up in blocked
Bloom filters of the vocabulary, one shard per word length, which are broadcast.
(An insertion is the other word's deletion, a replacement by an earlier
character the other word's replacement, so each pair is probed once.) Only the
positive probes are shuffled: a join with the vocabulary on the hash, and a
comparison of the words themselves, leave exactly the pairs that are near.

The filters have at most ``max_bits`` bits whatever the vocabulary. Beyond
``max_bits / BITS_PER_WORD`` words more probes pass them by chance and the join
gets more to remove; the result does not change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import chunks, mix
from cellar.session import materialize

BITS_PER_WORD = 16
MAX_BITS = 1 << 28
#: a block of the filters is 8 words of 64 bits: one cache line, in which all bits of a key lie
BLOCK_WORDS, PROBES = 8, 5
MIN_LENGTH, MIN_COUNT = 5, 3
#: characters worked on at a time
SLICE = 1 << 20
_P = 0x5851F42D4C957F2D
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
RUN, NOT_RUN = "[a-zÀ-ÿ]", "[^a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every letter run of at least MIN_LENGTH characters, A-Z lower-cased (shorter ones make no word)."""
    text = F.translate("text", UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.split(text, NOT_RUN)).alias("run")).where(F.length("run") >= MIN_LENGTH)


def with_slips(run: Column, doc_id: Column, every: int = 97) -> Column:
    """The run, less one character where ``every`` divides the crc32 of ``<doc_id>:<run>`` (a null id counts as empty)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def _codes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one after the other, and each word's offset."""
    words = arr.to_pylist()
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


class _Hashes:
    """Polynomial hashes of words and, from prefix sums, of all their edits."""

    def __init__(self, codes: np.ndarray, off: np.ndarray):
        self.codes, self.off = codes, off
        self.length = np.diff(off)
        self.pos = np.arange(len(codes)) - np.repeat(off[:-1], self.length)
        power = np.full(int(self.length.max(initial=0)) + 1, np.uint64(_P))
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)[self.pos]
        c = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(self._letter(codes) * self.power, out=c[1:])
        self.total = c[off[1:]] - c[off[:-1]]
        self.before = c[:-1] - np.repeat(c[off[:-1]], self.length)

    @staticmethod
    def _letter(code):
        return mix(np.asarray(code, np.uint64) + _LENGTH)

    def words(self) -> np.ndarray:
        return mix(self.total + self.length.astype(np.uint64) * _LENGTH)

    def replaced(self, i: np.ndarray, word: np.ndarray, code: int) -> np.ndarray:
        """With character i (of word ``word[i]``) replaced."""
        new = self._letter(np.array([code], np.uint64)) - self._letter(self.codes[i])
        return mix(self.total[word] + new * self.power[i] + self.length[word].astype(np.uint64) * _LENGTH)

    def deleted(self, i: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Without character i; what follows moves up by one power."""
        rest = self.total[word] - self.before[i] - self._letter(self.codes[i]) * self.power[i]
        return mix(self.before[i] + rest * _INVERSE + (self.length[word] - 1).astype(np.uint64) * _LENGTH)


def _hash_task(batches):
    for batch in batches:
        for c in chunks(batch, "word", SLICE):
            h = _Hashes(*_codes(c.column(c.schema.get_field_index("word"))))
            yield pa.RecordBatch.from_arrays([*c.columns, pa.array(h.length, pa.int32()), pa.array(h.words().view(np.int64))], names=[*c.schema.names, "length", "hash"])


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """id, word, n, length, hash of the words (column ``word``, a row per occurrence) that are long and frequent enough. Written."""
    v = words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    v = v.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return materialize(v.mapInArrow(_hash_task, "id long, word string, n long, length int, hash long"))


# ------------------------------------------------------------------ filters


def _place(h: np.ndarray, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """First 64-bit word of each key's block, and (word in the block, bit) of each of its bits."""
    block = first + (h >> np.uint64(40)).astype(np.int64) % blocks
    bits = mix(h + _LENGTH)
    return block * BLOCK_WORDS, [((bits >> np.uint64(9 * k)) & np.uint64(7), (bits >> np.uint64(9 * k + 3)) & np.uint64(63)) for k in range(PROBES)]


class Filters:
    """Blocked Bloom filters, one shard of blocks per word length, in one array of bounded size."""

    def __init__(self, per_length: dict[int, int], max_bits: int = MAX_BITS):
        total = sum(per_length.values())
        room = min(BITS_PER_WORD * total, max_bits) / (64 * BLOCK_WORDS)
        self.lengths = np.array(sorted(per_length), np.int64)
        share = np.array([per_length[x] for x in self.lengths.tolist()], float)
        self.blocks = np.maximum(1, np.ceil(share / max(total, 1) * room)).astype(np.int64)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.bits = np.zeros(int(self.blocks.sum()) * BLOCK_WORDS, np.uint64)

    def shard(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each length's shard, and whether there is one."""
        i = np.minimum(np.searchsorted(self.lengths, length), len(self.lengths) - 1)
        return i, self.lengths[i] == length

    def slots(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit word, bits) to set for the keys, each word once."""
        i, _ = self.shard(length)
        base, marks = _place(h, self.blocks[i], self.first[i])
        at = np.concatenate([base + w.astype(np.int64) for w, _ in marks])
        bit = np.concatenate([np.uint64(1) << b for _, b in marks])
        order = np.argsort(at, kind="stable")
        at, start = np.unique(at[order], return_index=True)
        return at, np.bitwise_or.reduceat(bit[order], start) if len(at) else bit

    def may_hold(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether each key may be a word: never false for a word."""
        i, yes = self.shard(length)
        base, marks = _place(h, self.blocks[i], self.first[i])
        for w, b in marks:
            yes &= (self.bits[base + w.astype(np.int64)] >> b) & np.uint64(1) == 1
        return yes


def build_filters(vocab: DataFrame, max_bits: int = MAX_BITS) -> Filters:
    """Filters of all words: bits are OR-ed in the executors, at most ``max_bits / 64`` words reach the driver.

    The table of lengths has one row per distinct word length.
    """
    per_length = {r["length"]: r["count"] for r in vocab.groupBy("length").count().collect()}
    out = Filters(per_length, max_bits)
    shape = vocab.sparkSession.sparkContext.broadcast((out.lengths, out.blocks, out.first))

    def task(batches):
        own = Filters.__new__(Filters)
        own.lengths, own.blocks, own.first = shape.value
        for b in batches:
            at, bits = own.slots(b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], names=["at", "bits"])

    rows = vocab.select("length", "hash").mapInArrow(task, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


# ------------------------------------------------------------------ neighbours


def _probe_task(filters, alphabet: list[int]):
    def task(batches):
        f = filters.value
        for batch in batches:
            for c in chunks(batch, "word", SLICE):
                ids = c.column(c.schema.get_field_index("id")).to_numpy()
                codes, off = _codes(c.column(c.schema.get_field_index("word")))
                h = _Hashes(codes, off)
                owner = np.repeat(np.arange(len(ids)), h.length)
                # of equal characters in a row only the first is deleted
                fresh = np.ones(len(codes), bool)
                fresh[1:] = (codes[1:] != codes[:-1]) | (h.pos[1:] == 0)
                for start in range(0, len(codes), SLICE):
                    span = np.arange(start, min(start + SLICE, len(codes)))
                    i = span[fresh[span]]
                    asked = [(owner[i], h.deleted(i, owner[i]), h.length[owner[i]] - 1)]
                    for code in alphabet:
                        i = span[codes[span] < code]
                        asked.append((owner[i], h.replaced(i, owner[i], code), h.length[owner[i]]))
                    for word, key, length in asked:
                        hit = f.may_hold(key, length)
                        if hit.any():
                            yield pa.RecordBatch.from_arrays([pa.array(ids[word[hit]]), pa.array(key[hit].view(np.int64))], names=["id", "hash"])

    return task


def near_pairs(vocab: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The pairs of words one edit apart, once each: id, word, n and other_id, other, other_n."""
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(ord(r["c"]) for r in letters.collect())  # at most the 90 characters of a run
    if not alphabet:
        return vocab.select("id", "word", "n", F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    filters = vocab.sparkSession.sparkContext.broadcast(build_filters(vocab, max_bits))
    positives = vocab.select("id", "word").mapInArrow(_probe_task(filters, alphabet), "id long, hash long")
    other = vocab.select("hash", F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = positives.join(other, "hash").drop("hash").join(vocab.select("id", "word", "n"), "id")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).dropDuplicates(["id", "other_id"])


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root_id) of every word that has a form, ``forms(id, form_id)``.

    Each round doubles the steps taken. A form has at least twice the
    occurrences of its word, so a chain is at most log2 of the largest count
    long and the rounds are at most log2 of that.
    """
    r = materialize(forms.select("id", F.col("form_id").alias("root_id")))
    while True:
        ahead = r.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        r = materialize(r.join(ahead, "root_id", "left").select("id", F.coalesce("next_id", "root_id").alias("root_id"), F.col("next_id").isNotNull().alias("moved")))
        if r.where("moved").isEmpty():
            return r.select("id", "root_id")
        r = r.drop("moved")


def group_variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = 2, max_bits: int = MAX_BITS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words(word)``, a row per occurrence.

    A word's form is its near word of the largest n (of equals the least in
    code-point order) if that n is at least ``ratio`` (at least 2) times its own;
    its root is where following forms ends, itself if it has none.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could form a circle")
    v = vocabulary(words, min_length, min_count)
    p = near_pairs(v, max_bits)
    there = F.struct(F.col("id"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"), F.col("other_id").alias("id")).alias("near"))
    back = F.struct(F.col("other_id").alias("id"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("id").alias("id")).alias("near"))
    ends = p.select(F.explode(F.array(there, back)).alias("e")).select("e.*")
    best = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    j = v.select("id", "word", "n").join(best, "id", "left")
    has = -F.col("near.less") >= F.col("n") * ratio
    j = j.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has, F.col("near.word")).alias("form"), F.when(has, F.col("near.id")).alias("form_id"), F.when(has, -F.col("near.less")).alias("form_n"),
    )
    j = materialize(j)
    roots = _roots(j.where("form_id is not null").select("id", "form_id"))
    named = roots.join(v.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return j.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip_every: int = 97) -> DataFrame:
    """The variants among the words of whole texts, with the rule-made slips of ``with_slips``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF. Null, empty and
    letterless texts have none; repeated rows count each time; a null id makes
    slips as an empty one.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return group_variants(runs(d).select(with_slips(F.col("run"), F.col("doc_id"), slip_every).alias("word")))
