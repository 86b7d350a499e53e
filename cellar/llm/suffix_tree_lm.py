"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of 0 to ``order`` preceding words (any number; contexts
are lengthened until none is frequent). A context becomes a state if it occurs ``min_context`` times and if its next-word counts diverge
from its shorter suffix's by more than chance; each state lists the next words
seen ``min_next`` times in it, smoothed with its suffix's distribution, down to
add-one unigram counts of all training words. A word is scored in the longest
suffix state of the words before it.

The minimum counts are absolute, so a pattern that is modelled on a small
corpus is modelled on a large one, and the tree grows with the corpus. States
and listed next words are tables built by ``groupBy``; they are never gathered
or broadcast. The pairs that tasks counted go packed by ranges of both hashes and
are summed a range at a time. Texts are scored in blocks, each some rows of
compressed texts. A block asks for its distinct keys, but for the
``HEAD`` most used rows, which nearly every block needs: those are broadcast, a
number that does not grow. The keys go to the model by ranges and only values
come back, in the order of the keys, which the block works out again. Bitmaps of
bounded size (at most 32 MB) only leave out keys that cannot match; a join
always follows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import INK, Directory, as_long, chunks, distinct, find, grouped_sum, mix, sums, test_bits, words
from cellar.llm.support import bitmap
from cellar.session import discard, materialize

ORDER = 3
MIN_CONTEXT = 40
MIN_NEXT = 4
KAPPA = 20.0
BLOCK_WORDS = 1 << 21
BLOCK_BYTES = 16 << 20
PART_BYTES = 1 << 19
BITMAP_LOG2 = 24
LARGE_LOG2 = 28
BUCKET_BYTES = 4 << 20
BUCKET_TOKENS = 1 << 21
HEAD = 1 << 20
WORD, STATE, LISTED = range(3)
END = np.uint64(0x0E0D0E0D0E0D0E0D)
BEGIN = np.uint64(0x0B0E0B0E0B0E0B0E)
_ODD = np.uint64(0x2545F4914F6CDD1D)
_BASE = np.uint64(0x9E6C63D0876A9A63)
_MODEL = "key long, v double, n long, kind int"


def _log2_bits(rows: int) -> int:
    """Size of a bitmap with eight slots a row, within bounds."""
    return min(max(BITMAP_LOG2, (8 * rows).bit_length()), LARGE_LOG2)


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end token after each, and the texts' offsets."""
    w = words(col, INK)
    return np.insert(w.hash, w.off[1:], END), w.off + np.arange(len(w.off))


def _contexts(t: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the hash of its 1..order preceding tokens (a begin mark before the text; 0: none).

    The i-th word back weighs ``_BASE ** (i - 1)``: a context followed by a word
    is, as a context, its hash times ``_BASE`` plus the word's.
    """
    first = np.zeros(len(t), bool)
    first[off[:-1][off[:-1] < len(t)]] = True
    back = np.empty(len(t), np.uint64)
    back[1:] = t[:-1]
    back[first] = BEGIN
    out = [back]
    for k in range(2, order + 1):
        older = np.zeros(len(t), np.uint64)
        older[1:] = back[:-1]
        older[first] = 0
        back, power = older, np.uint64(pow(int(_BASE), k - 1, 1 << 64))
        out.append(np.where(back == 0, np.uint64(0), out[-1] + back * power))
    return out


def _state_key(c: np.ndarray, k: int) -> np.ndarray:
    """Key of a context of length k in the model table."""
    return mix(c + np.uint64(2 * k) * _ODD)


def _entry_key(c: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    """Key of a next word w listed in a context of length k."""
    return mix(mix(c + np.uint64(2 * k + 1)) + w * _ODD)


def _probes(tok: np.ndarray, ctx: list[np.ndarray], bits: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the tokens whose context may be a state (``bits`` rules out others), and the keys of context and next word."""
    out = []
    for k, c in enumerate(ctx, 1):
        state = _state_key(c, k)
        at = np.flatnonzero(c != 0 if bits is None else (c != 0) & test_bits(bits, state))
        out.append((at, state[at], _entry_key(c[at], tok[at], k)))
    return out


def _in_states(index: Directory, value: np.ndarray, probes, out: np.ndarray) -> np.ndarray:
    """log10 probabilities from model rows; ``out`` has each token's unigram value.

    From the longest context down, as a listed next word makes all shorter ones
    superfluous; the factors are then added from the shortest up.
    """
    out, unlisted, steps = out.copy(), np.ones(len(out), bool), []
    for at, state, entry in reversed(probes):
        on = unlisted[at]
        at, state, entry = at[on], state[on], entry[on]
        j, listed = index.find(entry)
        unlisted[at[listed]] = False
        i, there = index.find(state[~listed])
        steps.append((at[listed], value[j[listed]], at[~listed][there], value[i[there]]))
    for listed, p, others, factor in reversed(steps):
        out[listed] = p
        out[others] += factor
    return out


def _log_probabilities(key: np.ndarray, value: np.ndarray, ctx: list[np.ndarray], tok: np.ndarray, out: np.ndarray, bits: np.ndarray | None = None) -> np.ndarray:
    """log10 probabilities from sorted model keys; ``out`` has each token's unigram value, ``bits`` rules out contexts that are no states."""
    return _in_states(Directory(key), value, _probes(tok, ctx, bits), out)


@dataclass
class Level:
    """States of one context length: tables (c, total, unlisted) and (c, w, n, logp)."""

    states: DataFrame
    entries: DataFrame


@dataclass
class Tree:
    """``model(key, v, n, kind)``: count of a word, log10 factor on the suffix's probability in a state, log10 probability of a listed word; n: how often it was seen."""

    tokens: int  # N
    types: int  # V
    counts: DataFrame  # (h, n) of all training words
    levels: list[Level]

    @cached_property
    def model(self) -> DataFrame:
        out = self.counts.select(F.col("h").alias("key"), F.col("n").cast("double").alias("v"), "n", F.lit(WORD).alias("kind"))
        for k, lv in enumerate(self.levels, 1):
            states = lv.states.select("c", F.lit(None).cast("long").alias("w"), F.log10("unlisted").alias("v"), F.col("total").alias("n"))
            rows = states.unionAll(lv.entries.select("c", "w", F.col("logp").alias("v"), "n"))
            out = out.unionAll(rows.mapInArrow(_key_task(k), _MODEL))
        return materialize(out)

    def split(self, head: int = HEAD) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
        """The most used rows, at most ``head`` of them, as sorted arrays; and the table of all others."""
        step = F.floor(8 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
        # a row for each eighth of a power of two
        steps = self.model.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values("step", ascending=False)
        whole = steps["step"][steps["rows"].cumsum() <= head]
        least = int(whole.min()) if len(whole) else None
        if least is None:
            return (np.empty(0, np.uint64), np.empty(0)), self.model
        rows = self.model.where(step >= least).select("key", "v").toArrow()
        key = rows["key"].to_numpy().view(np.uint64)
        by = np.argsort(key)
        return (key[by], rows["v"].to_numpy()[by]), self.model.where(step < least)


def _key_task(k: int):
    """Model rows of the states (w null) and listed next words of one level."""

    def task(batches):
        for b in batches:
            c = b.column(0).to_numpy().view(np.uint64)
            state = b.column(1).is_null().to_numpy(zero_copy_only=False)
            w = b.column(1).fill_null(0).to_numpy().view(np.uint64)
            key = np.where(state, _state_key(c, k), _entry_key(c, w, k))
            kind = np.where(state, STATE, LISTED).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), b.column(2), b.column(3), pa.array(kind)], names=["key", "v", "n", "kind"])

    return task


def _count_task():
    def task(batches):
        held, size = [], 0
        for batch in batches:
            for c in chunks(batch):
                held.append(np.unique(_tokens(c.column(0))[0], return_counts=True))
                size += len(held[-1][0])
                if size >= 2 * BLOCK_WORDS:
                    yield _sums(held)
                    held, size = [], 0
        if held:
            yield _sums(held)

    return task


def _sums(held) -> pa.RecordBatch:
    h, n = (np.concatenate(x) for x in zip(*held))
    i, n = sums(h, n)
    return pa.RecordBatch.from_arrays([pa.array(as_long(h[i])), pa.array(n)], names=["h", "n"])


def _pair_task(k: int, log2_buckets: int, ctx, word, shorter=None):
    """Counts of (context of length k, next word), both maybe frequent enough, as their pair a word shorter (``shorter``)."""

    def task(batches):
        held, size = [], 0
        for batch in batches:
            for b in chunks(batch, limit=PART_BYTES):
                t, off = _tokens(b.column(0))
                ctxs = _contexts(t, off, k)
                c = ctxs[k - 1]
                ok = np.flatnonzero((c != 0) & test_bits(ctx.value, c) & test_bits(word.value, t))
                if shorter is not None:
                    ok = ok[test_bits(shorter.value, _entry_key(ctxs[k - 2][ok], t[ok], k - 1))]
                held.append((c[ok], t[ok]))
                size += len(ok)
                if size >= BLOCK_WORDS:
                    yield _pair_rows(held, log2_buckets)
                    held, size = [], 0
        if size:
            yield _pair_rows(held, log2_buckets)

    return task


def _pair_rows(held, log2_buckets: int) -> pa.RecordBatch:
    """The counted pairs packed, a row for each range of context and next word; a row names each context and each word once.

    A third of the bits are of the next word, so that the pairs of a context as
    frequent as a text's start go to many ranges.
    """
    c, w = (np.concatenate(x) for x in zip(*held))
    u64 = np.uint64
    of_w, bits = u64(log2_buckets // 3), u64(log2_buckets)
    of_c, rest = bits - of_w, u64(64) - bits
    bucket = (c >> (u64(64) - of_c) << of_w) | (w >> (u64(64) - of_w))
    # by range, context and word; where the bits kept of both agree by chance, a pair may get two rows
    half = rest // u64(2)
    order = (bucket << rest) | (c << of_c >> (u64(64) - half) << (rest - half)) | (w << of_w >> (u64(64) - rest + half))
    by = np.argsort(order)
    c, w = c[by], w[by]
    new = np.ones(len(c), bool)
    np.logical_or(c[1:] != c[:-1], w[1:] != w[:-1], out=new[1:])
    at = np.flatnonzero(new)
    bucket, c, w, n = bucket[by[at]], c[at], w[at], np.diff(at, append=len(c))
    first = np.flatnonzero(np.diff(bucket, prepend=~bucket[0]))
    cols = [[], [], [], [], []]
    for i, j in zip(first, [*first[1:], len(c)]):
        run = np.flatnonzero(np.append(True, c[i + 1 : j] != c[i : j - 1]))
        name, index = np.unique(w[i:j], return_inverse=True)
        for col, x in zip(cols, (c[i:j][run], np.diff(run, append=j - i), name, index, n[i:j])):
            col.append(_pack(x if x.dtype == np.uint64 else x.astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array(as_long(bucket[first])), *(pa.array(x, pa.binary()) for x in cols)], names=["bucket", "c", "runs", "words", "w", "n"])


_PAIRS = "bucket long, c binary, runs binary, words binary, w binary, n binary"


def _add_task(k: int, least: int):
    """The pairs of one range that are seen ``least`` times in all."""

    def task(packed: pa.Table) -> pa.Table:
        c, w, n = [], [], []
        for row in zip(*(packed.column(x) for x in ("c", "runs", "words", "w", "n"))):
            name, runs, words_, index, seen = (_unpack([x], kind) for x, kind in zip(row, (np.uint64, np.uint32, np.uint64, np.uint32, np.uint32)))
            c.append(np.repeat(name, runs))
            w.append(words_[index])
            n.append(seen.astype(np.int64))
        c, w, n = (np.concatenate(x) for x in (c, w, n))
        i, n = sums(_entry_key(c, w, k), n)
        i, n = i[n >= least], n[n >= least]
        return pa.table([pa.array(as_long(c[i])), pa.array(as_long(w[i])), pa.array(n)], names=["c", "w", "n"])

    return task


def _longer_task():
    """Contexts of one word more, from (c, suffix of c, next word w, n): their hash, their suffix and their count."""

    def task(batches):
        for b in batches:
            c, suffix, w = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(c * _BASE + w)), pa.array(as_long(suffix * _BASE + w)), b.column(3)], names=["c", "suffix", "total"])

    return task


def _level(pairs: DataFrame, kappa: float) -> tuple[Level, DataFrame]:
    """Divergence test and smoothing of one level, from rows (c, suffix, w, n, total, below).

    Also the rows (c, suffix, w, n, p) of all pairs with the tree's probability
    of w after c, be c a state or not.
    """
    total, rest, mass = F.col("total"), F.col("rest"), F.col("mass")
    sums = pairs.groupBy("c", "total").agg(
        F.sum("n").alias("seen"), F.least(F.sum("below"), F.lit(1 - 1e-9)).alias("mass"), F.count(F.lit(1)).alias("cells"),
        F.sum(F.col("n") * F.log(F.col("n") / total / F.col("below"))).alias("gain"),
    ).withColumn("rest", F.greatest(total - F.col("seen"), F.lit(0)))
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / total / (1 - mass))).otherwise(0.0)
    kept = sums.where(gain > (F.col("cells") + 1) / 2 * F.log(F.greatest(total, F.lit(2))) + 2)
    states = materialize(kept.select("c", "total", ((rest / (1 - mass) + kappa) / (total + kappa)).alias("unlisted")))
    state = F.col("unlisted").isNotNull()
    p = F.when(state, (F.col("n") + kappa * F.col("below")) / (total + kappa)).otherwise(F.col("below"))
    scored = materialize(pairs.join(states.select("c", "unlisted"), "c", "left").select("c", "suffix", "w", "n", state.alias("listed"), p.alias("p")))
    return Level(states, scored.where("listed").select("c", "w", "n", F.log10("p").alias("logp"))), scored


def fit(train: DataFrame, order=ORDER, min_context=MIN_CONTEXT, min_next=MIN_NEXT, kappa=KAPPA) -> Tree:
    """The tree of ``train(text)``, with contexts of at most ``order`` words."""
    if order < 1:
        raise ValueError("order must be at least 1")
    share = train.sparkSession.sparkContext.broadcast
    counts = materialize(train.mapInArrow(_count_task(), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    end, begin = F.lit(int(END)), F.lit(int(BEGIN))
    texts = F.sum(F.when(F.col("h") == end, F.col("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(texts, F.lit(0)).alias("texts")).first()
    tree = Tree(int(total.n), int(total.v), counts, [])
    if not total.n:
        return tree
    least = max(2, min_next)
    frequent = counts.where(F.col("n") >= least)
    word = share(bitmap(frequent, "h", BITMAP_LOG2))
    base = frequent.select(F.col("h").alias("w"), ((F.col("n") + 1.0) / (total.n + total.v + 1.0)).alias("below"))
    # a text's start is a context too; the suffix of one word is empty
    empty = F.lit(0).cast("long").alias("suffix")
    cand = counts.where((F.col("n") >= min_context) & (F.col("h") != end)).select(F.col("h").alias("c"), empty, F.col("n").alias("total"))
    cand = materialize(cand.unionAll(counts.where(F.col("h") == end).select(begin.alias("c"), empty, F.col("n").alias("total"))))
    shorter, log2_buckets = None, max(4, (int(total.n) // BUCKET_TOKENS).bit_length())
    for k in range(1, order + 1):
        task = _pair_task(k, log2_buckets, share(bitmap(cand, "c", BITMAP_LOG2)), word, shorter)
        pairs = train.mapInArrow(task, _PAIRS).groupBy("bucket").applyInArrow(_add_task(k, least), "c long, w long, n long")
        pairs = pairs.join(cand, "c")
        if k == 1:
            pairs = pairs.join(base, "w")
        else:
            # a pair is seen no more often than its suffix's, so that one was counted a level up
            pairs = pairs.join(scored.select(F.col("c").alias("suffix"), "w", F.col("p").alias("below")), ["suffix", "w"])
        pairs = materialize(pairs.select("c", "suffix", "w", "n", "total", "below"))
        level, scored = _level(pairs, kappa)
        discard(pairs, cand)
        tree.levels.append(level)
        # a frequent (context, next word) is a candidate context of one more word
        if k < order:
            long = scored.where((F.col("n") >= min_context) & (F.col("w") != end)).select("c", "suffix", "w", "n")
            cand = materialize(long.mapInArrow(_longer_task(), "c long, suffix long, total long"))
            if cand.isEmpty():
                discard(cand)
                break
            keys = scored.select("c", "w", F.col("p").alias("v"), "n").mapInArrow(_key_task(k), _MODEL).select("key")
            shorter = share(bitmap(keys, "key", _log2_bits(scored.count())))
    return tree


def _block_task():
    """The texts in numbered blocks of numbered parts, a row of compressed texts for each part."""

    def task(batches):
        block, part, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for c in chunks(batch, limit=PART_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, c.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(c)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "part", "texts"])
                part, size = part + 1, size + c.nbytes
                if size >= BLOCK_BYTES:
                    block, part, size = block + 1, 0, 0

    return task


def _texts(part: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(part.as_buffer()).read_next_batch()


def _ask_task(order: int, states, listed, head, log2_buckets: int):
    """What each block asks the model for: a row for each range of keys.

    Named by the block and the first part seen here; a block of which two tasks read parts asks twice.
    """

    def task(batches):
        asked = None
        for batch in batches:
            for block, part, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if asked and asked.block != block:
                    yield _requests(asked, log2_buckets)
                    asked = None
                asked = asked or _Asked(order, states.value, listed.value, head.value[0], block, part)
                asked.add(texts)
        if asked:
            yield _requests(asked, log2_buckets)

    return task


def _keys(tok: np.ndarray, probes, listed: np.ndarray) -> np.ndarray:
    """The distinct words, contexts that may be states, and next words that may be listed in them."""
    out = [tok]
    for _, state, entry in probes:
        out += [state, entry[test_bits(listed, entry)]]
    return distinct(np.concatenate(out))


class _Asked:
    """The keys of some parts outside the most used rows, sorted: the same list when asking and when the answers come."""

    def __init__(self, order: int, states: np.ndarray, listed: np.ndarray, head: np.ndarray, block: int = 0, part: int = 0):
        self.order, self.states, self.listed, self.head, self.block, self.part = order, states, listed, head, block, part
        self.held, self.size, self.most = [np.empty(0, np.uint64)], 0, BLOCK_WORDS

    def add(self, texts: pa.BinaryScalar) -> None:
        tok, off = _tokens(_texts(texts).column("text"))
        self.held.append(_keys(tok, _probes(tok, _contexts(tok, off, self.order) if self.order else [], self.states), self.listed))
        self.size += len(self.held[-1])
        if self.size > self.most:
            self.held = [distinct(np.concatenate(self.held))]
            self.size = len(self.held[0])
            self.most = max(BLOCK_WORDS, 2 * self.size)

    def keys(self) -> np.ndarray:
        key = distinct(np.concatenate(self.held))
        return key[~find(self.head, key)[1]]


def _requests(asked: _Asked, log2_buckets: int) -> pa.RecordBatch:
    key = asked.keys()
    bucket, first = np.unique(key >> np.uint64(64 - log2_buckets), return_index=True)
    packed = [_pack(x) for x in np.split(key, first[1:])] if len(key) else []
    block, part = (pa.array(np.full(len(bucket), x)) for x in (asked.block, asked.part))
    return pa.RecordBatch.from_arrays([pa.array(as_long(bucket)), block, part, pa.array(packed, pa.binary())], names=["bucket", "block", "part", "keys"])


def _pack(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: like bytes lie together and compress. Their length goes before."""
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(column, dtype) -> np.ndarray:
    parts = [np.empty(0, dtype)]
    for x in column:
        x = x.as_buffer()
        planes = pa.decompress(x[8:], int.from_bytes(x[:8].to_pybytes(), "little"), codec="zstd")
        parts.append(np.frombuffer(planes, np.uint8).reshape(parts[0].itemsize, -1).T.copy().view(dtype).ravel())
    return np.concatenate(parts)


def _look_up(requests: pa.Table, model: pa.Table) -> pa.Table:
    """A value for each key that a block asks for in one range of keys, in their order (NaN: not in the model)."""
    key = model.column("key").to_numpy().view(np.uint64)
    by = np.argsort(key)
    key, value = key[by], model.column("v").to_numpy()[by]
    out = []
    for packed in requests.column("keys"):
        i, there = find(key, _unpack([packed], np.uint64))
        out.append(_pack(np.where(there, value[i], np.nan) if len(key) else np.full(len(i), np.nan)))
    return pa.table([*(requests.column(x) for x in ("block", "part", "bucket")), pa.array(out, pa.binary())], names=["of", "part", "bucket", "v"])


def _finish(tokens: int, types: int, order: int, states, listed, head):
    """Scores a block's texts with the model rows found for the block and the most used ones."""

    def task(left, right):
        parts, texts = left.column("part").to_numpy(), left.column("texts")
        by = np.argsort(parts)
        texts, key = [texts[int(i)] for i in by], []
        for some in np.split(np.arange(len(by)), np.searchsorted(parts[by], np.unique(right.column("part").to_numpy()))):
            asked = _Asked(order, states.value, listed.value, head.value[0])
            for i in some:
                asked.add(texts[i])
            key.append(asked.keys())
        key = np.concatenate(key)
        value = _unpack(right.sort_by([("part", "ascending"), ("bucket", "ascending")]).column("v"), np.float64)
        if len(key) != len(value):
            raise ValueError(f"{len(value)} answers to {len(key)} keys")
        found = ~np.isnan(value)
        key, value = np.concatenate([head.value[0], key[found]]), np.concatenate([head.value[1], value[found]])
        by = np.argsort(key, kind="stable")
        index, value = Directory(key[by]), value[by]
        del key, by, found
        out = []
        for c in map(_texts, texts):
            tok, off = _tokens(c.column("text"))
            i, known = index.find(tok)
            n = np.where(known, value[i], 0.0) if len(value) else np.zeros(len(tok))
            uni = np.log10((n + 1.0) / (tokens + types + 1.0))
            lp = _in_states(index, value, _probes(tok, _contexts(tok, off, order) if order else [], states.value), uni)
            out.append(pa.table({
                "doc_id": c.column("doc_id"), "held_out": c.column("held_out"), "n_tokens": pa.array(np.diff(off)),
                "n_known": pa.array(grouped_sum(known.astype(np.int64), off)), "train_tokens": pa.array(np.full(c.num_rows, tokens)),
                "base_score": pa.array(grouped_sum(uni, off)), "score": pa.array(grouped_sum(lp, off)),
            }))
        return pa.concat_tables(out)

    return task


def score_texts(docs: DataFrame, held_out: Column, id_col="doc_id", text_col="text", head: int = HEAD, **model) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` marks the rows that nothing is learnt from (null: learnt
    from). Tokens are runs of anything but ASCII white space, A-Z lower-cased,
    and one end token for each text; a null text counts as empty, so its only
    token is the end. With no training rows every score is that of the empty
    model, log10(1) a token. Scores are log10 probabilities.

    Texts are scored in blocks of about ``BLOCK_BYTES``: the words,
    contexts and (context, next word) pairs of a block are joined once with the
    model table, each distinct one alone, but for the at most ``head`` most used
    rows of the model, which every task has.
    """
    id_type = docs.schema[id_col].dataType
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    tree = fit(d.where(~F.col("held_out")).select("text"), **model)
    order = len(tree.levels)
    share = docs.sparkSession.sparkContext.broadcast
    head, tail = tree.split(head)
    listed = tail.where(F.col("kind") == LISTED)
    states, listed = share(bitmap(tree.model.where(F.col("kind") == STATE), "key", BITMAP_LOG2)), share(bitmap(listed, "key", _log2_bits(listed.count())))
    head = share(head)
    # ranges of keys that a task can hold: about as many keys each, however many texts there are
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2_buckets = max(4, (size // BUCKET_BYTES).bit_length())
    discard(tree.counts, *(t for lv in tree.levels for t in (lv.states, lv.entries)))
    blocks = materialize(d.mapInArrow(_block_task(), "block long, part long, texts binary"))
    requests = blocks.mapInArrow(_ask_task(order, states, listed, head, log2_buckets), "bucket long, block long, part long, keys binary")
    rows = tail.select(F.shiftrightunsigned("key", 64 - log2_buckets).alias("bucket"), "key", "v")
    # written before the texts are dealt, so that the shuffles of both never lie on disk together; the requests are never written
    found = materialize(requests.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(_look_up, "of long, part long, bucket long, v binary"))
    discard(tree.model)
    out = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    finish = _finish(tree.tokens, tree.types, order, states, listed, head)
    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(finish, out)
