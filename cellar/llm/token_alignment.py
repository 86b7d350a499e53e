"""Alignment of two tokenizers over whole texts.

Both tokenizers encode the same bytes, a space and the text. The byte offsets at
which tokens of both end cut the text into groups. They are found by a galloping
intersection: each end of the shorter list is sought in the longer one from the
place of an earlier end, by steps that double until they pass it and a binary
search inside the last step. The ranks so found also give, as differences, the
range of tokens of the second list that each token of the first overlaps.

How often an id pair is linked over the corpus is counted from blocks of texts:
a block ships each of its distinct pairs once with its own count, and gets the
corpus count of each back, so no pair has more rows in a shuffle than there are
blocks, however common it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellar.llm.kernels import chunks, grouped_sum, ranges, text_bytes
from cellar.session import materialize

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: bytes of text in a block; a longer text is a block of its own
BLOCK_BYTES = 2 << 20
#: pieces of text whose tokens a task keeps, and bytes of pieces encoded in one call
KEPT_ATOMS, JOINED_BYTES = 400_000, 1 << 12
#: every so manieth end is sought from the text's start, those between from their neighbour's place
STRIDE = 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINK = "struct<index:array<int>,times:array<int>>"


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver to be broadcast (a megabyte or two)."""
    with open(path, "rb") as f:
        return f.read()


class ByteBpe:
    """A byte-level BPE of the ``tokenizers`` library."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_buffer(raw)
        self.lib.encode_special_tokens = True
        byte_of = {c: b for b, c in _byte_letters().items()}
        self.bytes = []
        for i in range(self.lib.get_vocab_size(with_added_tokens=True)):
            piece = self.lib.id_to_token(i) or ""
            self.bytes.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())

    def encode(self, spaced: str) -> list[int]:
        return self.lib.encode_batch_fast([spaced], add_special_tokens=False)[0].ids


class PieceBpe:
    """A BPE of the ``sentencepiece`` library with byte fallback; it puts a space before each text itself."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = []
        for i in range(self.lib.get_piece_size()):
            piece = self.lib.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.lib.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, spaced: str) -> list[int]:
        return self.lib.encode(spaced[1:], num_threads=1)

    def crosses_words(self) -> bool:
        """Whether a piece holds a space after another character (texts could then not be cut before spaces)."""
        return any(b" " in b.lstrip(b" ") for b in self.bytes)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut_atoms(data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Starts of the pieces in which the texts (each with its space in front) can be encoded on their own.

    A piece begins at a single space between two characters that are surely no
    white space: there both tokenizers always end a token and begin the next.
    """
    n = len(data)
    start = np.zeros(n, bool)
    if n > 2:
        # ASCII beyond the space, or U+00C0 to U+00FF (bytes C3 xx)
        after = ((data > 0x20) & (data < 0x7F)) | (data == 0xC3)
        before = (data > 0x20) & (data < 0x7F)
        before[1:] |= data[:-1] == 0xC3
        start[1:-1] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    start[text_start[text_start < n]] = True
    return np.flatnonzero(start)


def gallop(needles: np.ndarray, starts: np.ndarray, hay: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each needle the number of entries of ``hay`` below it, by galloping.

    Needles ascend within each list; ``starts[i]`` is the first needle of needle
    i's list and ``lo[i]:hi[i]`` the part of ``hay`` that belongs to it. All
    lists are worked at once: first every STRIDE-th needle, from the list's
    start, then those halfway between, from the place of the needle before.
    """
    found = np.zeros(len(needles), np.int64)
    own = np.arange(len(needles)) - starts
    step = STRIDE
    while step:
        now = np.flatnonzero(own % step == 0 if step == STRIDE else own % (2 * step) == step)
        base = lo[now] if step == STRIDE else found[now - step]
        found[now] = _seek(needles[now], hay, base, hi[now])
        step //= 2
    return found


def _seek(x: np.ndarray, hay: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Left ranks of x in ``hay``, known to be at least ``low``: doubling steps, then halving ones."""
    low, high, step = low.copy(), end.copy(), 1
    live = np.flatnonzero(low < end)
    while len(live):
        probe = np.minimum(low[live] + step - 1, end[live] - 1)
        less = hay[probe] < x[live]
        high[live[~less]] = probe[~less]
        low[live[less]] = probe[less] + 1
        live = live[less & (probe + 1 < end[live])]
        step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        less = hay[mid] < x[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
        live = live[low[live] < high[live]]
    return low


def common_ends(a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end in ``a``: its rank among the ends ``b``, and whether it is one of them.

    Text d owns ``a[a_off[d]:a_off[d+1]]`` and the like of b; ends ascend over
    all texts. The shorter list of each text drives the search.
    """
    n_a, n_b = np.diff(a_off), np.diff(b_off)
    rank, same = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    by_a = n_a <= n_b
    d = np.repeat(np.arange(len(n_a)), n_a)
    i = np.flatnonzero(by_a[d])
    d = d[i]
    # positions within the selected needles, text by text
    first = np.concatenate(([0], np.cumsum(np.where(by_a, n_a, 0))))
    rank[i] = gallop(a[i], first[d], b, b_off[d], b_off[d + 1])
    same[i] = b[np.minimum(rank[i], len(b) - 1)] == a[i]
    d = np.repeat(np.arange(len(n_b)), n_b)
    j = np.flatnonzero(~by_a[d])
    if len(j):
        d = d[j]
        first = np.concatenate(([0], np.cumsum(np.where(by_a, 0, n_b))))
        at = gallop(b[j], first[d], a, a_off[d], a_off[d + 1])
        equal = a[np.minimum(at, len(a) - 1)] == b[j]
        same[at[equal]] = True
        # b[j] lies below a[i] exactly if at[j] + equal[j] <= i
        below = np.cumsum(np.bincount(at + equal, minlength=len(a) + 1))[: len(a)]
        i = np.flatnonzero(~by_a[np.repeat(np.arange(len(n_a)), n_a)])
        skipped = np.cumsum(np.where(by_a, n_b, 0))  # ends of texts that were driven by a
        rank[i] = below[i] + skipped[np.repeat(np.arange(len(n_a)), n_a)[i]]
    return rank, same


def _ends_in_ink(atom: bytes) -> bool:
    """Whether the last character is surely no white space, so that another piece can follow."""
    return 0x20 < atom[-1] < 0x7F or atom[-2:-1] == b"\xc3"


class Aligner:
    """Both tokenizers, and the alignment of every piece of text met so far.

    Tokens of both end where a piece ends, so the alignment of a text is that of
    its pieces, one after the other. A piece is encoded and aligned once; pieces
    are kept while they are fewer than KEPT_ATOMS.
    """

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.a, self.b = ByteBpe(raw_a), PieceBpe(raw_b)
        if self.b.crosses_words():
            raise ValueError("a piece of the second vocabulary holds a space inside: texts cannot be cut at spaces")
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        most = max(len(self.len_a), len(self.len_b))
        # a token's id with what follows it: the next token, the other tokenizer's half, the next group
        self.written = pa.array([f"{i}{s}" for i in range(most) for s in (",", "|", ";")], pa.large_string())
        self._clear()

    def _clear(self):
        self.code: dict[str, int] = {}
        self.fine = np.zeros(0, bool)
        self.counts = np.zeros((len(COUNTS), 0), np.int64)
        self.pair, self.pair_off = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.groups: list[pa.Array] = []

    def codes(self, atoms: list[str]) -> np.ndarray:
        """Places of the (distinct) pieces in the kept arrays; new ones are encoded and aligned."""
        if len(self.code) + len(atoms) > max(KEPT_ATOMS, len(atoms)):
            self._clear()
        new = [a for a in atoms if a not in self.code]
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        if new:
            self._add(new)
        return np.fromiter(map(self.code.__getitem__, atoms), np.int64, len(atoms))

    def _add(self, new: list[str]):
        raw = [a.encode() for a in new]
        fine = np.ones(len(new), bool)
        a, a_off = _encode(self.a, self.len_a, new, raw, fine)
        b, b_off = _encode(self.b, self.len_b, new, raw, fine)
        a, a_off = _only(a, a_off, fine)
        b, b_off = _only(b, b_off, fine)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        rank, same = common_ends(end_a, a_off, end_b, b_off) if len(a) else (np.zeros(0, np.int64), np.zeros(0, bool))
        low = np.concatenate(([0], (rank + same)[:-1])) if len(a) else rank
        other, link_off = ranges(low, rank + 1)
        pair = np.repeat(a, rank + 1 - low) * len(self.len_b) + b[other]
        groups = np.concatenate(([0], np.cumsum(same)))[a_off]
        self.fine = np.concatenate([self.fine, fine])
        self.counts = np.concatenate([self.counts, np.diff([a_off, b_off, groups, link_off[a_off]])], axis=1)
        self.pair = np.concatenate([self.pair, pair])
        self.pair_off = np.concatenate([self.pair_off, self.pair_off[-1] + link_off[a_off[1:]]])
        self.groups = [pa.concat_arrays([*self.groups, self._groups(a, a_off, b, b_off, rank, same)])]

    def _groups(self, a, a_off, b, b_off, rank, same) -> pa.Array:
        """The groups of each piece written out, each ended by a semicolon."""
        last_a = np.flatnonzero(same)
        last_b = rank[last_a]
        follows = np.zeros(len(a) + len(b), np.int64)
        group_a = np.concatenate(([0], np.cumsum(same)[:-1])) if len(a) else rank
        ends = np.zeros(len(b), bool)
        ends[last_b] = True
        group_b = np.concatenate(([0], np.cumsum(ends)[:-1])) if len(b) else rank
        at_a = np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group_a]
        at_b = np.arange(len(b)) + (last_a + 1)[group_b]
        follows[at_a[last_a]] = 1
        follows[at_b[last_b]] = 2
        ids = np.empty(len(follows), np.int64)
        ids[at_a], ids[at_b] = a, b
        data, off = text_bytes(self.written.take(pa.array(ids * 3 + follows)))
        return pa.LargeStringArray.from_buffers(len(a_off) - 1, pa.py_buffer(off[a_off + b_off]), pa.py_buffer(data))

    def align(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Counts and group digests of each text, and with ``pair`` and ``text`` all linked id pairs."""
        nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        data, off = text_bytes(pc.binary_join_element_wise(nothing, texts.fill_null("").cast(pa.large_string()), space))
        starts = cut_atoms(data, off[:-1])
        bounds = np.append(starts, len(data))
        atoms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        code = self.codes(atoms.dictionary.to_pylist())[atoms.indices.to_numpy()]
        first = np.searchsorted(starts, off)
        ok = (grouped_sum((~self.fine[code]).astype(np.int64), first) == 0) & (np.diff(off) > 1)
        n = np.where(ok, np.diff(first), 0)
        code, first = code[np.repeat(ok, np.diff(first))], np.concatenate(([0], np.cumsum(n)))
        chars, char_off = text_bytes(self.groups[0].take(pa.array(code))) if self.groups else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        ends = char_off[first]
        out = {k: grouped_sum(self.counts[i][code], first) for i, k in enumerate(COUNTS)}
        out["groups_sha256"] = [hashlib.sha256(chars[x : y - 1]).hexdigest() if x < y else "" for x, y in zip(ends[:-1], ends[1:])]
        at, _ = ranges(self.pair_off[code], self.pair_off[code + 1])
        out["pair"] = self.pair[at]
        out["text"] = np.repeat(np.arange(len(texts)), out["n_links"])
        return out


def _only(ids: np.ndarray, n: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the fine pieces, and the offsets of all pieces (the others have none)."""
    kept = np.where(fine, n, 0)
    return ids[np.repeat(fine, n)], np.concatenate(([0], np.cumsum(kept)))


def _encode(tok, sizes: np.ndarray, atoms: list[str], raw: list[bytes], fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces and their numbers of tokens; clears ``fine`` where the bytes are not reproduced.

    Pieces that end in no white space are encoded joined, which gives the same
    tokens, and parted by their lengths in bytes.
    """
    ids, counts, start = [], [], 0
    while start < len(atoms):
        stop, size = start, 0
        while stop < len(atoms) and size < JOINED_BYTES:
            size += len(raw[stop])
            stop += 1
            if not _ends_in_ink(raw[stop - 1]):
                break
        got = tok.encode("".join(atoms[start:stop]))
        if b"".join(map(tok.bytes.__getitem__, got)) == b"".join(raw[start:stop]):
            now = np.array(got, np.int64)
            last = np.searchsorted(np.cumsum(sizes[now]), np.cumsum([len(r) for r in raw[start:stop]])) + 1
            ids.append(now)
            counts.append(np.diff(last, prepend=0))
        else:
            for i in range(start, stop):
                got = tok.encode(atoms[i])
                fine[i] &= b"".join(map(tok.bytes.__getitem__, got)) == raw[i]
                ids.append(np.array(got, np.int64))
                counts.append(np.array([len(got)]))
        start = stop
    return np.concatenate(ids), np.concatenate(counts)


def _block_task(raw_a, raw_b, block_bytes: int):
    def task(batches):
        aligner = Aligner(raw_a.value, raw_b.value)
        for batch in batches:
            for c in chunks(batch, limit=block_bytes):
                got = aligner.align(c.column(c.schema.get_field_index("text")))
                coded = pa.array(got["pair"]).dictionary_encode()
                pairs, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                tally = pa.array(got["text"] * max(len(pairs), 1) + index).value_counts()
                key, times = (tally.field(k).to_numpy() for k in ("values", "counts"))
                order = np.argsort(key)
                key, times = key[order], times[order]
                per_text = np.searchsorted(key // max(len(pairs), 1), np.arange(c.num_rows + 1))

                def lists(values, kind):
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

                links = pa.StructArray.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(v, pa.int32())) for v in (key % max(len(pairs), 1), times)], ["index", "times"]
                )
                docs = pa.StructArray.from_arrays(
                    [c.column(c.schema.get_field_index("doc_id")), *(pa.array(got[k], pa.int64()) for k in COUNTS), pa.array(got["groups_sha256"], pa.string()), links],
                    ["doc_id", *COUNTS, "groups_sha256", "links"],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, c.num_rows], pa.int32()), docs), lists(pairs, pa.int64()), lists(np.bincount(index, minlength=len(pairs)), pa.int64())],
                    names=["docs", "pair", "times"],
                )

    return task


def blocks(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Aligned blocks of ``docs(doc_id, text)``: block, docs, pair, times.

    ``docs`` has per text its counts, its groups' digest and, as links, places
    in the block's ``pair`` list with how often; ``times`` are the
    block's own counts. Written to the checkpoint folder, so that every later
    step sees the same blocks.
    """
    sc = docs.sparkSession.sparkContext
    raw_a, raw_b = sc.broadcast(read_file(byte_bpe)), sc.broadcast(read_file(pieces))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    doc = f"struct<doc_id:{id_type},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string,links:{LINK}>"
    rows = docs.mapInArrow(_block_task(raw_a, raw_b, block_bytes), f"docs array<{doc}>, pair array<bigint>, times array<bigint>")
    return materialize(rows.withColumn("block", F.monotonically_increasing_id()))


def pair_counts(found: DataFrame, n_pieces: int) -> DataFrame:
    """pair, count (links of the pair over all blocks) and best (no pair of its second id has more)."""
    at = found.select(F.explode(F.arrays_zip("pair", "times")).alias("p"))
    n = at.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.times").alias("count"))
    # a second id has at most one row per first id, so its window is bounded by the first vocabulary
    most = F.max("count").over(Window.partitionBy(F.col("pair") % n_pieces))
    return materialize(n.select("pair", "count", (F.col("count") == most).alias("best")))


def _sum_task(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            docs = one.column(one.schema.get_field_index("docs")).flatten()
            got = one.column(one.schema.get_field_index("found")).flatten()
            place = got.field("place").to_numpy()
            count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
            count[place], best[place] = got.field("count").to_numpy(), got.field("best").to_numpy(zero_copy_only=False)
            links = docs.field("links").flatten()
            off = links[0].offsets.to_numpy() - links[0].offsets[0].as_py()
            index, times = links[0].flatten().to_numpy(), links[1].flatten().to_numpy().astype(np.int64)

            def sums(v):
                return pa.array(np.diff(np.concatenate(([0], np.cumsum(times * v[index])))[off]), pa.int64())

            names = ["doc_id", *COUNTS, "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*(docs.field(n) for n in names), sums(best), sums(count)], names=[*names, "n_best", "count_sum"])


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A null or empty text, or one that a tokenizer does not reproduce byte for
    byte, has zeros and an empty digest. Repeated rows are repeated, and their
    links count each time; a null id is kept. A very long text is a block of
    its own and is encoded in pieces that end at spaces, which gives the tokens
    of the whole text.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    b = blocks(d, byte_bpe, pieces, block_bytes)
    counts = pair_counts(b.select("pair", "times"), len(PieceBpe(read_file(pieces)).bytes))
    asked = b.select("block", F.posexplode("pair").alias("place", "pair"))
    found = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("found"))
    full = b.select("block", "docs").join(found, "block", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<place:int,count:bigint,best:boolean>>)")))
    id_type = d.schema["doc_id"].dataType.simpleString()
    sums = full.select("docs", "found").mapInArrow(
        _sum_task, f"doc_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long"
    )
    return sums
