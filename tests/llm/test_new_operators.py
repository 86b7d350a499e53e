"""Quality rules, token alignment and spelling variants against brute force and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellar.llm import quality_rules, spelling, token_alignment

SMALL = "/root/testdata/sf0.001"


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_quality_rules", "op13_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = entry.queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert _rows(got, *cols) == sorted(want, key=repr)


ODD = [
    (None, "A text without an id. It has two sentences.", "en", "a", 1, 1),
    (1, None, "en", None, 1, 1),
    (2, "", None, "a", 1, 1),
    (3, " \n\t ", "en", "b", 1, 1),
    (4, "!!! ??? ...", "en", "b", 1, 1),
    (5, "the same row twice, all of it the very same", "en", "c", 1, 1),
    (5, "the same row twice, all of it the very same", "en", "c", 1, 1),
    (7, "word " * 30000, "de", "c", 1, 1),
    (8, "x" * 200000, "de", "c", 1, 1),
    (9, "ünïcödé ñandú 日本語 text " * 50, "es", "c", 1, 1),
    (10, "a▁b c  and\r\n  tabs\tx <|endoftext|> <s> </s> it's we'll 12 345,6 \x00\x01 × ÷ q　 w\n\n", "en", "c", 1, 1),
    (11, "a" + " " * 300000 + "b", "en", "c", 1, 1),
    (12, "a" + "\n" * 300000 + "b", "en", "c", 1, 1),
]
#: extra columns with the names that operators use inside
CLASH = "doc_id long, text string, lang string, word string, block int, stratum int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, CLASH)


# ------------------------------------------------------------------ quality rules


@pytest.mark.parametrize("x,n,p", [(0, 50, 0.05), (3, 200, 0.05), (20, 200, 0.05), (50, 50, 0.5), (0, 1, 0.9), (199, 200, 0.99)])
def test_binomial_tail_is_exact(x, n, p):
    q = Fraction(p)
    want = sum(math.comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(x + 1))
    assert quality_rules.binomial_tail(x, n, p) == pytest.approx(float(want), rel=1e-9)
    if x < n:
        assert quality_rules.binomial_tail(x, n, quality_rules.upper_bound(x, n, 0.01)) == pytest.approx(0.01, rel=1e-6)


def _naive_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    rep = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), len(lines), len(re.findall("[A-Z]", text))


def test_measures_of_awkward_texts(spark, odd):
    more = spark.createDataFrame([(20, "a a a a b\na a a a b\n\n \nA a a", "en", "", 1, 1), (21, "# * $ % & | < > x", "en", "", 1, 1)], CLASH)
    d = odd.unionAll(more)
    got = quality_rules.judge(d, spark.createDataFrame([], "doc_id long, quality int"))
    want = [(r["doc_id"], *_naive_measures(r["text"])) for r in d.collect()]
    assert _rows(got, "doc_id", *quality_rules.MEASURES) == sorted(want, key=repr)
    assert got.where("kept and base_failed").count() == 0
    assert got.where("size(rejected_by) > 0").count() == 0  # no labels, no cutoff


def test_empty_tables(spark):
    d, labels = spark.createDataFrame([], CLASH), spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(d, labels).count() == 0
    assert token_alignment.align_tokens(d).count() == 0
    assert spelling.spelling_variants(d).count() == 0


RULE = (quality_rules.Rule("symbols", "n_symbols", "n_words", (0.9, 0.8, 0.5, 0.2)),)


def _good(spark, values, stratum):
    rows = [(i, stratum, 100, int(v * 100)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, n_symbols long")


def test_cutoffs_hold_the_bound_and_stop_at_the_first_unsafe_one(spark):
    # in a: 1 in 1000 above 0.8, 100 above 0.5, none between 0.2 and 0.5 more; b has too few labels
    a = _good(spark, [0.85] + [0.6] * 99 + [0.0] * 900, "a")
    b = _good(spark, [0.0] * 10, "b")
    got = {r["stratum"]: r for r in quality_rules.select_cutoffs(a.unionAll(b), RULE, alpha=0.05, delta=0.05).collect()}
    assert (got["a"]["cutoff"], got["a"]["n_rejected"], got["a"]["n_good"]) == (0.8, 1, 1000)
    assert got["a"]["upper_bound"] <= 0.05
    assert got["b"]["cutoff"] is None
    # a repeated id counts once, with its worst value
    twice = quality_rules.select_cutoffs(a.unionAll(a), RULE).where("stratum = 'a'").first()
    assert twice["n_good"] == 1000 and twice["n_rejected"] == 1


def test_false_rejections_stay_below_alpha_over_many_draws(spark):
    """The share of truly good documents beyond the cutoff exceeds alpha in at most about delta of the draws."""
    rng = np.random.default_rng(5)
    over, draws = 0, 40
    cuts, alpha, delta = RULE[0].cutoffs, 0.1, 0.2
    truth = {0.9: 0.02, 0.8: 0.09, 0.5: 0.11, 0.2: 0.5}  # chance of a good document beyond each cutoff
    frames = []
    for k in range(draws):
        u = rng.random(400)
        v = np.select([u < truth[0.9], u < truth[0.8], u < truth[0.5], u < truth[0.2]], [0.95, 0.85, 0.6, 0.3], 0.0)
        frames += [(i, str(k), 100, int(x * 100)) for i, x in enumerate(v)]
    good = spark.createDataFrame(frames, "doc_id long, stratum string, n_words long, n_symbols long")
    for r in quality_rules.select_cutoffs(good, RULE, alpha, delta).collect():
        over += r["cutoff"] is not None and truth[r["cutoff"]] > alpha
    assert over <= 1 and cuts  # Bonferroni over 40 strata: 0.2 expected at most


def test_junk_is_rejected_and_good_kept(spark):
    mid = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{mid}/labels.parquet")
    out = quality_rules.judge(spark.read.parquet(f"{mid}/documents.parquet"), labels)
    r = {x["quality"]: x for x in out.where("not base_failed").join(labels, "doc_id").where("stratum = 'en'").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1]["kept"] >= 0.95 and r[0]["kept"] < r[1]["kept"] - 0.3


# ------------------------------------------------------------------ token alignment


def _naive_alignment(docs):
    a, b = token_alignment.ByteBpe(token_alignment.read_file(token_alignment.BYTE_BPE)), token_alignment.PieceBpe(token_alignment.read_file(token_alignment.PIECES))
    rows, count = [], collections.Counter()

    def spans(ids, tok):
        at = 0
        for i in ids:
            yield at, at + len(tok.bytes[i]), i
            at += len(tok.bytes[i])

    for doc_id, text in docs:
        raw = (" " + (text or "")).encode()
        ids = (a.lib.encode(" " + text, add_special_tokens=False).ids, b.lib.encode(text)) if text else ([], [])
        if not text or any(b"".join(t.bytes[i] for i in x) != raw for t, x in zip((a, b), ids)):
            rows.append((doc_id, [], [], [], []))
            continue
        sa, sb = list(spans(ids[0], a)), list(spans(ids[1], b))
        groups, start, links, j = [], 0, [], 0
        in_a, in_b = collections.defaultdict(list), collections.defaultdict(list)
        ends = sorted({s[1] for s in sa} & {s[1] for s in sb})
        for half, own in ((sa, in_a), (sb, in_b)):
            k = 0
            for s, e, i in half:
                while ends[k] < e:
                    k += 1
                own[k].append(str(i))
        groups = [f"{','.join(in_a[k])}|{','.join(in_b[k])}" for k in range(len(ends))]
        for s, e, i in sa:
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        count.update(links)
        rows.append((doc_id, sa, sb, groups, links))
    top = collections.Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        (
            (i, len(x), len(y), len(g), len(p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "", sum(count[q] == top[q[1]] for q in p), sum(count[q] for q in p))
            for i, x, y, g, p in rows
        ),
        key=repr,
    )


ALIGNED = "doc_id n_a n_b n_groups n_links groups_sha256 n_best count_sum".split()


def test_alignment_equals_brute_force(spark, odd):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    want = _naive_alignment([(r["doc_id"], r["text"]) for r in d.collect()])
    assert _rows(token_alignment.align_tokens(d), *ALIGNED) == want
    assert _rows(token_alignment.align_tokens(d.repartition(5), block_bytes=2000), *ALIGNED) == want


def test_alignment_keeps_no_more_pieces_than_told(monkeypatch):
    monkeypatch.setattr(token_alignment, "KEPT_ATOMS", 5)
    al = token_alignment.Aligner(*(token_alignment.read_file(p) for p in (token_alignment.BYTE_BPE, token_alignment.PIECES)))
    import pyarrow as pa

    for k in range(5):
        got = al.align(pa.array([f"one two three four {k}", None, f"{k} five six"]))
        assert got["n_groups"][1] == 0 and len(al.code) <= 12
        assert got["groups_sha256"] == token_alignment.Aligner(*(token_alignment.read_file(p) for p in (token_alignment.BYTE_BPE, token_alignment.PIECES))).align(pa.array([f"one two three four {k}", None, f"{k} five six"]))["groups_sha256"]


@pytest.mark.parametrize("seed", range(5))
def test_gallop_equals_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    n_lists = 30
    needles, hay = [], []
    for d in range(n_lists):
        needles.append(np.unique(rng.integers(0, 5000, rng.integers(0, 400))) + d * 10000)
        hay.append(np.unique(rng.integers(0, 5000, rng.integers(0, 3000))) + d * 10000)
    n_off, h_off = (np.concatenate(([0], np.cumsum([len(x) for x in v]))) for v in (needles, hay))
    x, h = np.concatenate(needles), np.concatenate(hay)
    d = np.repeat(np.arange(n_lists), np.diff(n_off))
    assert (token_alignment.gallop(x, n_off[d], h, h_off[d], h_off[d + 1]) == np.searchsorted(h, x)).all()
    # ends that cover the same bytes, either list the shorter one
    for v in (needles, hay):
        for i in range(n_lists):
            v[i] = np.append(v[i], i * 10000 + 6000)
    n_off, h_off = (np.concatenate(([0], np.cumsum([len(x) for x in v]))) for v in (needles, hay))
    x, h = np.concatenate(needles), np.concatenate(hay)
    rank, same = token_alignment.common_ends(x, n_off, h, h_off)
    assert (rank == np.searchsorted(h, x)).all() and (same == np.isin(x, h)).all()


# ------------------------------------------------------------------ spelling variants


def _naive_variants(docs):
    words = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    n = {w: c for w, c in words.items() if len(w) >= 5 and c >= 3}
    near = {}
    for w in n:
        letters = sorted({c for v in n for c in v})
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = sorted((-n[e], e) for e in edits - {w} if e in n)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


COLUMNS = "word form root n n_near form_n".split()


def test_variants_equal_brute_force(spark, odd):
    rows = [(i, "colour " * (3 if i % 2 else 5) + "color Color COLOR " + "colouur " * (i == 1) * 3 + "aabbcc aabcc abbcc xyzzy xyzzyy xyzzyyy " * 2) for i in range(3)]
    rows += [(None, "aaaaa aaaaaa aaaaaaa " * 4), (50, "ÉTÉSÉ étésé etese ÷×÷×÷ ×÷×÷× " * 3), (50, "ÉTÉSÉ étésé etese ÷×÷×÷ ×÷×÷× " * 3)]
    rows += [(60 + i, "z" * 3000 + " " + "z" * 2999 + "y" + " " + "z" * 2999) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionAll(odd.select("doc_id", "text")).unionAll(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 2000"))
    want = _naive_variants([(r["doc_id"], r["text"]) for r in d.collect() if not r["text"] or len(r["text"]) < 100000 or " " in r["text"]])
    got = spelling.spelling_variants(d)
    assert got.columns == COLUMNS
    assert _rows(got, *COLUMNS) == want


def test_filters_too_small_for_the_vocabulary_change_nothing(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = spelling.runs(d.select("doc_id", "text")).select(F.col("run").alias("word"))
    want = _rows(spelling.group_variants(words), *COLUMNS)
    assert _rows(spelling.group_variants(words, max_bits=512), *COLUMNS) == want
    assert any(r[1] for r in want)


def test_filters_never_miss_a_word(spark):
    v = spelling.vocabulary(spelling.runs(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).select(F.col("run").alias("word")))
    rows = v.toPandas()
    f = spelling.build_filters(v)
    keys, length = rows["hash"].to_numpy().view(np.uint64), rows["length"].to_numpy().astype(np.int64)
    assert f.may_hold(keys, length).all()
    rng = np.random.default_rng(1)
    assert f.may_hold(rng.integers(0, 2**63, 20000).astype(np.uint64), rng.choice(length, 20000)).mean() < 0.05


def test_ratio_below_two_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([], "word string"), ratio=1)
