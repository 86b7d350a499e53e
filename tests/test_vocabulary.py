"""Vocabulary search: the automaton equals the term by term form, at any size of the vocabulary."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellar.operators import jobmatch as JM
from cellar.operators import vocabulary as V

TEXTS = [
    "c++ and c# and node.js, not nodejs", "machine learning machine", "a.b a.b.c ab", "éclair ÉCLAIR _x x_ x", "日本語 text 日本", "data science; data-science",
    "", None, "aa aaa aaaa", "r and r&d", "x²y 2x ½ half", "\\Q odd \\E", "one two three four",
]
TERMS = ["c++", "c#", "node.js", "node", "machine learning", "learning machine", "a.b", "b.c", "éclair", "x", "日本", "日本語", "data science", "aa", "aaa", "r", "r&d", "½", "\\E", "two three", "", "x"]


def _naive(text, terms, whole):
    out = []
    for t in dict.fromkeys(x for x in terms if x):
        pattern = rf"(?<!\w){re.escape(t)}(?!\w)" if whole else re.escape(t)
        if text and re.search(pattern, text):
            out.append(t)
    return out


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("few", [0, 1000])
def test_equal_to_single_searches(spark, whole, few, monkeypatch):
    monkeypatch.setattr(V, "FEW_TERMS", few)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = df.select("id", V.find_terms(df, F.col("text"), TERMS, whole).alias("t")).orderBy("id").collect()
    for r in got:
        assert r["t"] == _naive(TEXTS[r["id"]], TERMS, whole), (few, TEXTS[r["id"]])


def test_ten_thousand_terms_cost_about_what_two_hundred_do(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 7))) for _ in range(20000)]
    texts = [(i, " ".join(r.choices(words, k=400))) for i in range(3000)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(8).cache()
    df.count()
    took = {}
    for n in (200, 10_000, 200, 10_000):
        start = time.time()
        V.vocabulary_totals(df, "text", words[:n]).count()
        took[n] = min(took.get(n, 1e9), time.time() - start)
    assert took[10_000] < 4 * took[200] + 1, took
    got = {x["id"]: set(x["t"]) for x in df.select("id", V.find_terms(df, F.col("text"), words[:10_000]).alias("t")).limit(50).collect()}
    vocab = set(words[:10_000])
    assert all(t == set(texts[i][1].split()) & vocab for i, t in got.items())


def test_limits(spark):
    df = spark.createDataFrame([("a",)], "text string")
    assert df.select(V.find_terms(df, F.col("text"), []).alias("t")).first()["t"] == []
    with pytest.raises(ValueError):
        V.check_terms(str(i) for i in range(V.MAX_TERMS + 1))


def test_job_table_with_a_large_vocabulary_equals_a_small_one(spark):
    jobs = spark.createDataFrame([(1, "Data Engineer", "Acme", "spark and kafka"), (2, "Nurse", "Care", "none"), (3, "Dev", "X", "Rust, SPARK")], "n int, `Job Title` string, `Company Name` string, text string")
    few = ["spark", "kafka", "rust"]
    many = few + [f"term{i}" for i in range(5000)]
    a, b = (JM.prepare_job_table(jobs, "n", v).select("job_order", "text_skills").orderBy("job_order").collect() for v in (few, many))
    assert a == b and a[0]["text_skills"] == ["spark", "kafka"]


def test_texts_of_a_batch_become_strings_a_slice_at_a_time():
    # whole batches of strings and of found terms were held at once
    class Texts:
        def __init__(self, texts):
            self.texts = texts

        def __len__(self):
            return len(self.texts)

        def slice(self, at, n):
            part = self.texts.slice(at, n)
            assert len(part) <= V.SLICE
            return part

    terms = ("a b", "b", "é")
    texts = pa.array((["a b", None, "", "xb b", "é"] * V.SLICE)[: 3 * V.SLICE + 1])
    out = V._found_names(V._automaton(terms), pa.array(terms), Texts(texts), True)
    assert out.type == pa.list_(pa.string())
    assert out.to_pylist() == ([["a b", "b"], [], [], ["b"], ["é"]] * V.SLICE)[: 3 * V.SLICE + 1]
