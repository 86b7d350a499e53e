"""N-gram Jaccard similarity join by MinHash banding.

Texts with the same words are one class. Each class has ``trees`` signatures of
``depth`` MinHash values over its word n-grams. One prefix length for all of
them, the longest at which two texts at the threshold agree in some signature
with the target probability, is computed from the parameters: by default 16
bands of 5 values. It is not adapted to the data, no tries are built, and a
pair at 0.8 that agrees in no band and is in no common group is lost. Texts
that share a band's values, a node, are gathered into connected groups, and
inside each group every pair is verified by its exact Jaccard similarity, in
blocks: the groups hold all pairs that share a node, so nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import Words, as_long, chunks, grams, sequence_hashes, words
from cellar.llm.support import connected_components, documents, matching_texts, with_text_key
from cellar.session import materialize

NGRAM = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.998
BLOCK = 256
SEED = 20240229


def forest_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold matches in some tree with the target probability."""
    d = depth
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of all texts, and offsets; a text of fewer words is one shingle."""
    g = grams(w.hash, n)
    inside = np.arange(len(g)) + n <= w.text_end()[: len(g)]
    count = np.maximum(w.counts - n + 1, 0)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    own = np.flatnonzero(inside)
    if len(short):
        h, _ = sequence_hashes(w)
        count[short] = 1
        off = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(off[-1], np.uint64)
        hole = np.zeros(off[-1], bool)
        hole[off[short]] = True
        out[hole] = h[short]
        out[~hole] = g[own]
        return out, off
    return g[own], np.concatenate(([0], np.cumsum(count)))


def _signatures(s: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash values (32 bits) of each text with shingles: rows for non-empty texts only."""
    rng = np.random.default_rng(SEED)
    mul = rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    full = np.flatnonzero(np.diff(off))
    sig = np.empty((len(full), size), np.uint32)
    if len(full):
        x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
        y = np.empty_like(x)
        for k in range(size):
            np.multiply(x, mul[k], out=y)
            y += add[k]
            y ^= y >> np.uint32(15)
            y *= mul[-1 - k]
            sig[:, k] = np.minimum.reduceat(y, off[full])
    return sig


def _sign_task(n: int, size: int):
    def task(batches):
        for batch in batches:
            for c in chunks(batch, limit=1 << 20):
                w = words(c.column(c.schema.get_field_index("text")))
                h1, h2 = sequence_hashes(w)
                has = w.counts > 0
                sig = _signatures(*_shingles(w, n), size)
                row = np.full(len(has), b"", dtype=object)
                row[has] = [r.tobytes() for r in sig]
                yield pa.RecordBatch.from_arrays(
                    [c.column(c.schema.get_field_index("doc_id")), c.column(c.schema.get_field_index("th")), pa.array(as_long(h1)), pa.array(as_long(h2)), pa.array(w.counts), pa.array([x or None for x in row], pa.binary())],
                    names=["doc_id", "th", "node", "h2", "n_words", "sig"],
                )

    return task


def _trie_task(trees: int, depth: int, prefix: int):
    """A row per class and tree: the hash of the trie node at the chosen prefix length."""

    def task(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, trees, depth)
            part = sig[:, :, :prefix].astype(np.uint64)
            key = grams(part.reshape(-1), prefix)[::prefix].reshape(b.num_rows, trees) + np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            node = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, trees)), pa.array(as_long(key.reshape(-1)))], names=["node", "key"])

    return task


def _similar(sa, sb, threshold, same):
    """Index pairs (i, j) of two lists of shingle sets whose Jaccard similarity reaches the threshold.

    Intersections are counted by products of 0/1 matrices over the shingles
    that occur in more than one set, a few thousand columns at a time.
    """
    sets = sa if same else sa + sb
    size = np.array([len(x) for x in sets])
    allv = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), size)
    vocab, col, cnt = np.unique(allv, return_inverse=True, return_counts=True)
    keep = cnt[col] > 1
    new = np.cumsum(cnt > 1) - 1
    col, who = new[col[keep]], who[keep]
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    na = len(sa)
    inter = np.zeros((na, na if same else len(sb)))
    step, top = 4096, int(col[-1]) + 1 if len(col) else 0
    for c0 in range(0, top, step):
        lo, hi = np.searchsorted(col, [c0, c0 + step])
        m = np.zeros((len(sets), min(step, top - c0)), np.float32)
        m[who[lo:hi], col[lo:hi] - c0] = 1
        inter += m[:na] @ (m if same else m[na:]).T
    sb_size = size if same else size[na:]
    # inter / (a + b - inter) >= t in float64, with room for rounding on exact ties
    both = size[:na, None] + sb_size[None, :]
    i, j = np.nonzero(inter * (1 + threshold) + 1e-9 * both >= threshold * both)
    ok = i < j if same else np.ones(len(i), bool)
    return i[ok], j[ok]


def _forest(i, j, n):
    """A spanning forest of the graph: pairs that first connect two parts."""
    parent = np.arange(n)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i, j):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _verify(n: int, threshold: float):
    """One pair of blocks of a candidate group: link counts of its texts and a spanning forest of its links."""

    def task(key, table):
        bi, bj = key[1].as_py(), key[2].as_py()
        sets = []
        for c in table.select(["text"]).combine_chunks().to_batches():
            for part in chunks(c):
                s, off = _shingles(words(part.column(0)), n)
                sets += [np.unique(s[a:b]) for a, b in zip(off[:-1], off[1:])]
        node = table.column("node").to_numpy()
        block = table.column("block").to_numpy()
        a = np.flatnonzero(block == bi)
        b = a if bi == bj else np.flatnonzero(block == bj)
        if len(a) and len(b):
            i, j = _similar([sets[x] for x in a], [sets[x] for x in b], threshold, bi == bj)
        else:
            i = j = np.empty(0, np.int64)
        i, j = a[i], b[j]
        links = np.bincount(np.concatenate([i, j]), minlength=len(node)) if len(i) else np.zeros(len(node), np.int64)
        pairs = _forest(i, j, len(node))
        has = np.flatnonzero(links)
        u = np.concatenate([node[has], node[[p[0] for p in pairs]] if pairs else np.empty(0, np.int64)])
        v = np.concatenate([node[has], node[[p[1] for p in pairs]] if pairs else np.empty(0, np.int64)])
        cnt = np.concatenate([links[has], np.zeros(len(pairs), np.int64)])
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64()), "links": pa.array(cnt, pa.int64())})

    return task


def jaccard_join(docs: DataFrame, id_col="doc_id", text_col="text", n: int = NGRAM, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, th, copy_id, n_copies, n_links, class_id, class_th.

    copy_id is the least doc_id with the same words (A-Z lower-cased) and
    n_copies the number of rows that have them; n_links counts the *different*
    texts whose word n-gram sets have Jaccard similarity >= ``threshold``;
    class_id is the least doc_id connected by copies or links, and class_th the
    least text hash that goes with it: together they name one text of the group,
    also where ids are null or repeat. A text of fewer
    than ``n`` words has one shingle, all its words; a null or wordless text
    has no links, is nobody's copy, and its class_id and class_th are its own. Rows
    that repeat an id and text count as copies. A null doc_id sorts last.

    Copies are collapsed before anything is compared; groups of more than
    ``block`` texts are verified as pairs of blocks, each its own task, which
    returns counts and a spanning forest, never the pairs themselves.
    """
    prefix = forest_depth(threshold, trees, depth, recall)
    d = with_text_key(documents(docs, id_col, text_col))
    id_type = dict(d.dtypes)["doc_id"]
    signed = materialize(
        d.mapInArrow(_sign_task(n, trees * depth), f"doc_id {id_type}, th long, node long, h2 long, n_words long, sig binary")
    )
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")
    copies = materialize(
        signed.where("n_words > 0").groupBy("node", "h2").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n_copies"), F.max("n_words").alias("n_words"))
    )
    reps = copies.select("node", "m.doc_id", "m.th", "n_words")
    sig = signed.join(
        reps.select(F.col("node").alias("rn"), F.col("doc_id").alias("rd"), F.col("th").alias("rt")),
        (F.col("node") == F.col("rn")) & F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt")),
    ).select("node", "sig")
    keys = materialize(sig.mapInArrow(_trie_task(trees, depth, prefix), "node long, key long"))
    # a repeated row signs twice: min <> max leaves nodes of the trie that hold different texts
    heads = materialize(keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("far")).where("head <> far").select("key", "head"))
    edges = keys.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = connected_components(edges)
    links = _links(d, reps, groups, n, threshold, block)
    counts = links.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    parts = connected_components(links.where("links = 0").select("a", "b"))
    named = (
        copies.join(counts, "node", "left").join(parts, "node", "left")
        .select("node", "h2", F.col("m.doc_id").alias("copy_id"), F.col("m.th").alias("copy_th"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "node").alias("label"))
    )
    named = materialize(named)
    first = materialize(
        named.groupBy("label").agg(F.min(F.struct(F.col("copy_id").isNull().alias("nil"), "copy_id", "copy_th")).alias("f"))
        .select("label", F.col("f.copy_id").alias("class_id"), F.col("f.copy_th").alias("class_th"))
    )
    named = materialize(named.join(first, "label").drop("label"))
    rows = signed.select("doc_id", "th", "n_words", "node", "h2")
    return rows.join(named, ["node", "h2"], "left").select(
        "doc_id",
        "th",
        F.when(F.col("n_words") > 0, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_th", "th").alias("class_th"),
    )


def _links(d: DataFrame, reps: DataFrame, groups: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Verified links of all candidate groups: rows (node, node, links) and forest edges (a, b, 0)."""
    member = groups.join(reps, "node")
    size = materialize(
        groups.join(reps.select("node", "n_words"), "node").groupBy("label").agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_words") / (block * 2000))).alias("blocks")
        )
    )
    member = member.join(size, "label").select(
        "label", "blocks", "node", F.col("doc_id").alias("rd"), F.col("th").alias("rt"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"),
    )
    member = materialize(member)
    texts = (
        matching_texts(d, member.select(F.col("rt").alias("th")))
        .join(member, F.col("doc_id").eqNullSafe(F.col("rd")) & (F.col("th") == F.col("rt")))
        .dropDuplicates(["node"])
        .select("label", "node", "block", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("label", "node", "block", "text", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    done = texts.groupBy("label", "bi", "bj").applyInArrow(_verify(n, threshold), "a long, b long, links long")
    return materialize(done)
