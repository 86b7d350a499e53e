"""Each corpus operator against brute force or held-out accuracy, and on awkward tables."""

from __future__ import annotations

import collections
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cellar.llm import decontaminate, jaccard_join, kernels, language_id, license_scan, mixing, substring_dedup, suffix_tree_lm, token_counts, topk_search, toxicity
from cellar.llm.support import connected_components, fold

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings benchmark labels".split()


def _norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_jaccard_join", "op8_license_scan", "op9_pivot_topk", "op10_decontaminate"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert _norm(tuple(r) for r in got.select(cols).collect()) == _norm(want)


# ------------------------------------------------------------------ awkward tables

ODD = [
    (None, "A text without an id. It has two sentences.", "en", "a", 1, 1),
    (1, None, "en", None, 1, 1),
    (2, "", None, "a", 1, 1),
    (3, " \n\t ", "en", "b", 1, 1),
    (4, "!!! ??? ...", "en", "b", 1, 1),
    (5, "the same row twice, all of it the very same", "en", "c", 1, 1),
    (5, "the same row twice, all of it the very same", "en", "c", 1, 1),
    (6, "THE SAME row twice - all of it the very same", "en", "c", 1, 1),
    (7, "word " * 30000, "de", "c", 1, 1),
    (8, "x" * 200000, "de", "c", 1, 1),
    (9, "ünïcödé ñandú 日本語 text " * 50, "es", "c", 1, 1),
]
#: extra columns with the names that operators use inside
CLASH = "doc_id long, text string, lang string, source string, size int, th int"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, CLASH)
    for c in ("copies", "spans", "node", "key_doc", "mix_key", "score", "label", "block", "target", "lang_pred"):
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_mixing_awkward(odd, empty):
    rows, name = mixing.plan(odd, mixing.cycling_weights())
    got = rows.collect()
    assert len(got) == len(ODD) and set(odd.columns) < set(rows.columns)
    for r in got:
        assert 0 <= r[name["copies"]] <= 3 and r[name["target"]] <= 3 * r[name["source_size"]] + 1e-6
    # weights 5, 2, 1 for a, b, c and 5 again for the null source: b has no more than its three times
    assert mixing.plan(empty, mixing.cycling_weights())[0].count() == 0
    mixed = mixing.mix_documents(odd, mixing.cycling_weights())
    assert mixed.columns[:-1] == odd.columns
    again, _ = mixing.plan(odd.repartition(5), mixing.cycling_weights())
    key = ["doc_id", name["size"], name["copies"]]
    assert _norm(map(tuple, rows.select(*key).collect())) == _norm(map(tuple, again.select(*key).collect()))


def test_mixing_meets_targets(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 < 2 THEN 'hot' ELSE 's' || id % 5 END").alias("source"), (F.pmod(F.xxhash64("id"), F.lit(500)) + 1).alias("w"))
    rows, _ = mixing.plan(d, mixing.cycling_weights(), size_of=F.col("w"))
    for r in rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("t"), F.max("size").alias("m")).collect():
        assert abs(r.taken - r.t) <= r.m


def test_jaccard_awkward(odd, empty, spark):
    got = collections.defaultdict(list)
    for r in jaccard_join.jaccard_join(odd).collect():
        got[r.doc_id].append(r)
    assert len(got[5]) == 2 and {(r.copy_id, r.n_copies, r.class_id) for r in (*got[5], *got[6])} == {(5, 3, 5)}
    for i in (1, 2, 3, 4):
        assert (got[i][0].n_links, got[i][0].class_id, got[i][0].n_copies) == (0, i, 1)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_jaccard_large_group_in_blocks(spark):
    """Near copies of one text, more than a block: link counts equal brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        t = list(base)
        for p in rng.integers(0, 120, 2):
            t[p] = f"z{i}x{p}"
        texts.append(" ".join(t))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    for i, a in enumerate(sets):
        want = sum(1 for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b))
        assert got[i].n_links == want
    assert jaccard_join.forest_depth(0.8, 16, 8, 0.998) == 5


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))


def test_substring_dedup_planted(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    sent = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sent(12) for _ in range(6))
    flat = " ".join(word() for _ in range(120))  # no sentence ends at all
    host = [" ".join(sent(9) for _ in range(5)) for _ in range(8)]
    texts = [f"{host[0]} {passage} {host[1]}", f"{host[2]}\n{passage}\n{host[3]}", f"{host[4]} {flat} {host[5]}", f"{host[6]} {flat} {host[7]}", host[0][::-1]]
    got = [r.text for r in substring_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[2] == texts[2] and got[4] == texts[4]
    assert passage not in got[1] and got[1].split() == (host[2] + " " + host[3]).split()
    left = set(got[3].split()) & set(flat.split())
    assert len(left) <= 24 and set(host[6].split()) - set(got[3].split()) == set()


def test_substring_dedup_leaves_no_long_repeat(spark):
    """Brute force: no run of 60 words of the result occurs in two documents (or twice)."""
    out = substring_dedup.remove_repeats(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    seen = collections.Counter()
    for r in out:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        seen.update({tuple(w[i : i + 60]) for i in range(len(w) - 59)})
    assert not seen or max(seen.values()) == 1


def test_substring_dedup_awkward(odd, empty):
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[1] is None and by[2] == "" and by[8] == ODD[9][1]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_toxicity_held_out(spark):
    lab = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = entry.queries()["op4_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    test = [(r.score, lab[r.doc_id]) for r in rows if r.held_out and r.doc_id in lab]
    pos, neg = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95
    assert np.mean([s >= 0.7 for s in neg]) < 0.02


def test_toxicity_awkward(spark, odd, empty):
    lab = spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    never = F.col("doc_id") < 0
    assert toxicity.toxicity(odd, lab, never).count() == len(ODD)
    assert {r.score for r in toxicity.toxicity(odd, lab.where("false"), never).collect()} == {0.5}
    assert toxicity.toxicity(empty, lab, never).count() == 0


def test_suffix_tree_base_scores(spark):
    rows = entry.queries()["op5_suffix_tree_lm"](spark, SMALL).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)})), "\0end"] for i, t in docs.items()}
    c = collections.Counter(w for i, ts in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ts)
    n, v = sum(c.values()), len(c)
    gain = 0
    for r in rows:
        t = toks[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        gain += (r.score - r.base_score) if r.held_out else 0
    assert gain > 0


class CountedTree:
    """A suffix tree from dictionaries of counts, for small corpora."""

    def __init__(self, texts, order, min_context, min_next, kappa):
        self.order, n, least = order, collections.Counter(w for t in texts for w in t), max(2, min_next)
        self.total, self.types, self.count, self.state = sum(n.values()), len(n), n, {}
        cand = {(w,): c for w, c in n.items() if c >= min_context and w != "\0end"}
        cand[("\0begin",)] = len(texts)
        for k in range(1, order + 1):
            following = collections.defaultdict(collections.Counter)
            for t in texts:
                t = ["\0begin", *t]
                for i in range(k, len(t)):
                    c = tuple(t[i - k : i])
                    if c in cand:
                        following[c][t[i]] += 1
            # what is listed one word shorter is settled before this level's states join the tree
            found, longer = {}, {}
            for c, nx in following.items():
                nx = {w: m for w, m in nx.items() if m >= least}
                below = {w: self.p(c[1:], w) for w in nx}
                if nx:
                    whole = cand[c]
                    rest, mass = max(whole - sum(nx.values()), 0), min(sum(below.values()), 1 - 1e-9)
                    gain = sum(m * math.log(m / whole / below[w]) for w, m in nx.items()) + (rest * math.log(rest / whole / (1 - mass)) if rest else 0)
                    if gain > (len(nx) + 1) / 2 * math.log(max(whole, 2)) + 2:
                        found[c] = ((rest / (1 - mass) + kappa) / (whole + kappa), {w: (m + kappa * below[w]) / (whole + kappa) for w, m in nx.items()})
                longer.update({(*c, w): m for w, m in nx.items() if m >= min_context and w != "\0end"})
            self.state.update(found)
            cand = longer

    def p(self, context, w):
        out = (self.count[w] + 1) / (self.total + self.types + 1)
        for k in range(1, len(context) + 1):
            if context[-k:] in self.state:
                unlisted, listed = self.state[context[-k:]]
                out = listed.get(w, out * unlisted)
        return out

    def score(self, tokens):
        t = ["\0begin", *tokens]
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order) : i]), t[i])) for i in range(1, len(t)))


@pytest.mark.parametrize("order,head", [(2, 0), (4, 500)])
def test_suffix_tree_scores_equal_a_dictionary_of_counts(spark, order, head):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kw = {"min_context": 12, "min_next": 3, "kappa": 5.0}
    held = fold(F.col("doc_id"), 7) == 2
    rows = suffix_tree_lm.score_texts(docs, held, order=order, head=head, **kw).collect()
    toks = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})), "\0end"] for r in docs.collect()}
    tree = CountedTree([t for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2], order, **kw)
    assert max(map(len, tree.state)) >= min(order, 3) and len(tree.state) > 100
    assert len(rows) == len(toks)
    for r in rows:
        assert r.score == pytest.approx(tree.score(toks[r.doc_id]), rel=1e-9)


def test_suffix_tree_is_a_distribution(spark):
    """In every state the probabilities of all words sum to at most one."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    tree = suffix_tree_lm.fit(docs.select("text"))
    (key, value), rest = tree.split()
    assert rest.count() == 0
    n = {np.int64(r.h): r.n for r in tree.counts.collect()}
    h = np.sort(np.array(list(n)).view(np.uint64))
    uni = np.log10((np.array([n[x] for x in h.view(np.int64)]) + 1.0) / (tree.tokens + tree.types + 1.0))
    ctx = sorted(r.c for r in tree.levels[0].states.collect())[:10]
    assert ctx
    for c in ctx:
        lp = suffix_tree_lm._log_probabilities(key, value, [np.full(len(h), np.int64(c)).view(np.uint64)], h, uni)
        assert 0.9 < (10**lp).sum() <= 1 + 1e-9


def test_suffix_tree_leaves_only_what_scoring_reads_on_disk(spark, monkeypatch):
    """The model's tables are deleted once every block has its answers, and the answers hold no keys."""
    docs, made, write = spark.read.parquet(f"{SMALL}/documents.parquet"), [], suffix_tree_lm.materialize

    def recorded(df):
        made.append(write(df))
        return made[-1]

    monkeypatch.setattr(suffix_tree_lm, "materialize", recorded)
    out = suffix_tree_lm.score_texts(docs, fold(F.col("doc_id"), 7) == 2, head=0, order=2, min_context=12, min_next=3)
    there = [df for df in made if any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert len(made) > 4 and len(there) <= 2
    assert out.count() == docs.count()


def test_suffix_tree_ships_pairs_packed():
    """Counted pairs take a few bytes each on their way to be summed, and come out as plain counts."""
    rng = np.random.default_rng(5)
    names = suffix_tree_lm.mix(np.arange(1, 3000, dtype=np.uint64))
    names[0] = suffix_tree_lm.BEGIN
    held = [(names[rng.zipf(1.3, n) % 300], names[rng.zipf(1.3, n) % len(names)]) for n in (60000, 1, 20000)]
    want = collections.Counter(zip(*(np.concatenate(x).tolist() for x in zip(*held))))
    for log2_buckets in (4, 7):
        rows = suffix_tree_lm._pair_rows(held, log2_buckets)
        assert rows.num_rows == len(set(rows.column(0).to_pylist())) <= 1 << log2_buckets
        if log2_buckets == 4:
            assert rows.nbytes < 8 * len(want)
        got = {}
        for i in range(rows.num_rows):
            twice = pa.Table.from_batches([rows.slice(i, 1)] * 2)
            out = suffix_tree_lm._add_task(1, 6)(twice).to_pydict()
            got.update({(c % 2**64, w % 2**64): n for c, w, n in zip(out["c"], out["w"], out["n"])})
        assert got == {p: 2 * n for p, n in want.items() if 2 * n >= 6}


def test_suffix_tree_writes_texts_once_as_blocks(spark, monkeypatch):
    """Scoring leaves few rows of compressed texts on disk, not the texts and the keys asked for row by row."""
    docs, made, write = spark.read.parquet(f"{SMALL}/documents.parquet"), [], suffix_tree_lm.materialize

    def recorded(df):
        made.append(write(df))
        return made[-1]

    monkeypatch.setattr(suffix_tree_lm, "materialize", recorded)
    out = suffix_tree_lm.score_texts(docs, fold(F.col("doc_id"), 7) == 2, head=0, order=2, min_context=12, min_next=3)
    blocks = [df for df in made if "texts" in df.columns]
    assert len(blocks) == 1 and blocks[0].count() < docs.count() / 4
    assert not any("keys" in df.columns for df in made)
    assert out.count() == docs.count()


@pytest.mark.parametrize("keys", [[], [7], [0, 1, 2**64 - 1], range(5000), None])
def test_directory_finds_what_a_search_finds(keys):
    rng = np.random.default_rng(6)
    key = np.unique(rng.integers(0, 2**64, 9000, dtype=np.uint64)) if keys is None else np.array(keys, np.uint64)
    x = np.concatenate([key, key + np.uint64(1), rng.integers(0, 2**64, 1000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    i, there = kernels.Directory(key).find(x)
    assert (there == np.isin(x, key)).all() and (key[i[there]] == x[there]).all()
    assert (kernels.distinct(x) == np.unique(x)).all()


def test_suffix_tree_awkward(odd, empty):
    held = fold(F.col("doc_id"), 7) == 2
    rows = suffix_tree_lm.score_texts(odd, held).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    none = suffix_tree_lm.score_texts(odd, F.lit(True)).collect()
    assert {(r.base_score, r.n_known) for r in none} == {(0.0, 0)}
    assert suffix_tree_lm.score_texts(empty, held).count() == 0


def test_language_id_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = [r for r in entry.queries()["op6_language_id"](spark, MID).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.05


def test_language_id_awkward(odd, empty):
    dicts = language_id.fit_dictionaries(odd, F.lit(True))
    got = {r.doc_id: r for r in language_id.identify(odd, dicts).collect()}
    assert len(got) == 10 and [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert language_id.accept(odd, dicts).columns == odd.columns
    assert language_id.fit_dictionaries(empty, F.lit(True)) == {}
    assert {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(empty, dicts).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_sum_to_the_whole_text(spark, odd, rule):
    import tiktoken  # noqa: F401

    enc, size = token_counts._encoder(token_counts.load_ranks(), token_counts.PATTERN)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = collections.defaultdict(list)
    for r in token_counts.section_tokens(spark.read.parquet(f"{SMALL}/documents.parquet"), rule=rule).collect():
        got[r.doc_id].append(r)
    for i, t in docs.items():
        rows = sorted(got[i], key=lambda r: r.section)
        ids = enc.encode_ordinary(t or "")
        assert sum(r.n_tokens for r in rows) == len(ids) and sum(r.n_chars for r in rows) == len(t or "")
        lines = (t or "").splitlines(keepends=False) if False else re.findall(r"[^\n]*\n|[^\n]+", t or "")
        assert [r.n_chars for r in rows] == [len(x) for x in lines]
        if rule == "first":  # brute force: the line that holds the token's first byte
            owner = [k for k, x in enumerate(lines) for _ in range(len(x.encode()))]
            at, want = 0, collections.Counter()
            for x in ids:
                want[owner[at]] += 1
                at += int(size[x])
            assert [r.n_tokens for r in rows] == [want[k] for k in range(len(lines))]
    out = token_counts.section_tokens(odd, rule=rule)
    assert {r.doc_id for r in out.collect()} == {None, 3, 4, 5, 6, 7, 8, 9}


def test_field_tokens(spark):
    df = spark.createDataFrame([(1, "hello wor", "ld again", None), (2, None, "", "x")], "id long, a string, b string, c string")
    got = {(r.id, r.field): (r.n_tokens, r.n_crossing) for r in token_counts.field_tokens(df, "id", ["a", "b", "c"]).collect()}
    assert set(got) == {("1", "a"), ("1", "b"), ("2", "c")} and got["1", "a"][1] == 1


def test_license_rules(spark, odd, empty):
    text = [
        "Released under the MIT License.",
        "All rights reserved. Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.",
        "ALL RIGHTS\tRESERVED!\nmore",
        "Not all rights reserved.",
    ]
    got = [r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "Apache-2.0", "proprietary", None]
    assert license_scan.scan(odd).count() == len(ODD) and license_scan.scan(empty).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (900, 12))
    v[300:600] = v[0]  # a third of the rows are one vector
    rows = [(i, [float(x) for x in a], 0, 0) for i, a in enumerate(v)]
    rows += [(1000, None, 0, 0), (1001, [1.0, None] * 6, 0, 0), (1002, [float("nan")] * 12, 0, 0), (1003, [float("inf")] * 12, 0, 0), (1004, [0.5] * 3, 0, 0), (None, [0.1] * 12, 0, 0), (7, [float(x) for x in v[7]], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dist int, piece int")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, 20, piece_rows=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.vstack([np.floor(64 * v), np.zeros((1, 12))]).astype(int)
    x[-1, :3] = 32
    ids = [*range(900), 1004]
    for q in range(0, 900, 20):
        want = sorted(((-int(x[q] @ x[k]), i) for k, i in enumerate(ids) if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == set(range(0, 900, 20))
    few = topk_search.top_k(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0, 20)
    assert few.count() == 2
    assert topk_search.top_k(df.where("false"), F.col("vec_id") == 0, 20).count() == 0


def test_topk_with_several_query_groups_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (600, 8))
    ids = [*range(500), *range(100)]  # a hundred ids have two vectors
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in zip(ids, v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 3 == 0, 7, piece_rows=40, query_group=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(64 * v).astype(int)
    for q in range(0, 500, 3):
        own = [k for k, i in enumerate(ids) if i == q]
        want = sorted((-int(x[a] @ x[b]), ids[b]) for a in own for b in range(600) if ids[b] != q)[:7]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == set(range(0, 500, 3))


def test_decontaminate_awkward(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same row twice all"), (2, None), (3, "..."), (None, "word " * 12), (1, "same row twice all")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, bench).collect()}
    assert got[5]["items"] == ["1"] and got[5].n_hit == 4 and got[7]["items"] == [""] and got[7].n_hit == 30000
    assert all(got[i].n_hit == 0 for i in (None, 1, 2, 3, 4, 8, 9))
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 4
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.where("false")).where("n_hit > 0").count() == 0


def test_pipeline_stages(spark, odd, empty):
    d = odd.withColumn("n_chars", F.length("text"))
    for docs in (d, d.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert last.columns[:-1] == docs.columns
        last.count()


def test_pipeline_decisions(spark):
    """Brute force over the stages: language, near copies, benchmark windows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], SMALL)
        steps.append(spark.createDataFrame(out.collect(), out.schema))
    assert steps[1].count() >= 0.97 * docs.count()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (words(r.text) for r in steps[2].collect())]
    for i, a in enumerate(sets):
        assert not any(len(a & b) >= 0.8 * len(a | b) for b in sets[:i])
    items = {tuple(w[k : k + 10]) for w in (words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()) for k in range(len(w) - 9)}
    hit = {r.doc_id for r in steps[3].collect() if any(tuple(w[k : k + 10]) in items for w in [words(r.text)] for k in range(len(w) - 9))}
    assert {r.doc_id for r in steps[3].collect()} - hit == {r.doc_id for r in steps[4].collect()}


def test_suffix_tree_models_the_same_pattern_on_a_larger_table(spark):
    """A pair that is rare among all tokens is modelled as on a table without the others."""
    pattern = [(i, "left right " * 3 + f"a{i}") for i in range(60)]
    other = [(1000 + i, " ".join(f"w{i * 200 + j}" for j in range(200))) for i in range(9000)]
    gain = []
    for rows in (pattern, pattern + other):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = suffix_tree_lm.score_texts(df, F.lit(False)).where("doc_id < 1000").agg(F.avg(F.col("score") - F.col("base_score"))).first()[0]
        gain.append(got)
    assert gain[0] > 1 and gain[1] > gain[0]


def test_suffix_tree_has_more_states_than_any_share_allows(spark):
    """12,000 contexts of 50 occurrences each: more than the 10,000 that a share of 1e-4 leaves."""
    df = spark.range(12000).select(F.expr("concat_ws(' ', array_repeat(concat('p', id, ' q', id), 50))").alias("text"))
    tree = suffix_tree_lm.fit(df)
    assert tree.levels[0].states.count() >= 24000


@pytest.mark.parametrize("inter, union", [(24, 30), (88, 110), (400, 500), (4 * 2999, 5 * 2999)])
def test_jaccard_exact_ties_are_links(inter, union):
    a = np.arange(inter + (union - inter) // 2, dtype=np.uint64)
    b = np.concatenate([a[:inter], np.arange(10**6, 10**6 + union - len(a), dtype=np.uint64)])
    assert len(np.union1d(a, b)) == union and len(np.intersect1d(a, b)) == inter
    for same in (True, False):
        i, j = jaccard_join._similar([a, b] if same else [a], [] if same else [b], 0.8, same)
        assert len(i) == 1
    less = np.append(b, np.uint64(10**7))
    assert len(jaccard_join._similar([a, less], [], 0.8, True)[0]) == 0


def test_near_duplicates_without_unique_ids_keep_one(spark):
    """Groups of different texts whose ids are all null, or all equal: one text stays of each."""
    base = {k: " ".join(f"{k}{i}" for i in range(200)) for k in "abc"}
    near = lambda k: [base[k], base[k].upper() + "!", base[k] + " end", base[k] + " other end"]
    rows = [(None, t) for t in near("a")] + [(7, t) for t in near("b")] + [(None, near("c")[0]), (9, near("c")[1]), (9, near("c")[2])]
    rows += [(None, base["a"]), (None, None), (7, "")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert len(out) == 5
    kind = collections.Counter((r.doc_id, (r.text or "-")[0].lower()) for r in out)
    assert kind == {(None, "a"): 1, (7, "b"): 1, (9, "c"): 1, (None, "-"): 1, (7, "-"): 1}


def test_substring_dedup_finds_every_run_of_50_words(spark):
    """Passages of 50 words inside other prose: no, few or re-wrapped stops, over many seeds."""
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 14))

    def prose(words, every, wrap):
        return " ".join(x + "." * (every > 0 and i % every == every - 1) + "\n" * (wrap > 0 and i % wrap == wrap - 1) for i, x in enumerate(words))

    rows, runs = [], []
    for seed in range(150):
        run = [word() for _ in range(50)]
        for k, (every, wrap) in enumerate([(0, 0), (16, 0), (40, 0), (0, 9), (0, 13)]):
            host = [word() for _ in range(60)]
            rows.append((seed * 5 + k, prose(host[: 20 + k] + run + host[20 + k :], every, wrap)))
            runs.append((run, host))
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), report=True).orderBy("doc_id").collect()
    for (i, text), (run, host), r in zip(rows, runs, out):
        left = re.findall("[a-h]+", r.text)
        if i % 5 == 0:
            assert r.text == text and r.words_removed == 0
        else:
            assert r.words_removed >= 20 and left == [x for x in host[: 20 + i % 5] + run + host[20 + i % 5 :] if x in set(left)]
            assert set(host) <= set(left)


def test_license_canonical_texts(spark):
    """Wrapped and commented headers and licences, as they stand in files."""
    import textwrap

    apache = [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ]
    mit = [
        "MIT License",
        "Copyright (c) 2020 Some One. All rights reserved.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
    ]
    bsd = [
        "Copyright (c) 2020, Some One. All rights reserved.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ]
    gpl = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    cases = [(apache, "Apache-2.0"), (mit, "MIT"), (bsd, "BSD-3-Clause"), (bsd[:-1], "BSD-2-Clause"), ([gpl.format(":", ",", 3)], "GPL-3.0"), ([gpl.format(";", ";", 2)], "GPL-2.0")]
    rows, want = [], []
    for paragraphs, name in cases:
        for width in (40, 72, 5000):
            for sign in ("", "# ", " * ", "// "):
                lines = [x for p in paragraphs for x in (*textwrap.wrap(p, width), "")]
                rows.append((len(rows), "\n".join((sign + x).rstrip() for x in lines)))
                want.append(name)
    rows.append((len(rows), "Nothing of the\nSoftware is licensed; not all\nrights reserved here."))
    got = [r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [*want, None]
