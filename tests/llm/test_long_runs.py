"""Very long runs of white space, line breaks and comment signs."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellar.llm import license_scan, token_counts

N = 1_000_000


@pytest.mark.parametrize("run", [" " * N, "\n" * N, "#\n" * (N // 2), " * \n" * (N // 4), "\n \t\r" * (N // 4)])
def test_license_scan_of_long_runs(spark, run):
    d = spark.createDataFrame([(1, f"All rights reserved.{run}Released under the MIT License{run}x"), (2, run), (3, f"a{run}b")], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    assert got[1]["sentence_ids"].split("|")[0] == "all-rights-reserved" and got[2]["license"] is None and got[3]["n_sentences"] == 0
    assert time.time() - start < 60


def test_wordless_lines_end_a_sentence_as_before(spark):
    texts = ["released under\nthe MIT License\n\n\nall rights\nreserved", "x\n # \n//\nreleased under the mit license\n --\n", "all rights reserved\n...\n!\nall rights reserved"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["sentence_ids"] for r in license_scan.scan(d).orderBy("doc_id").collect()]
    assert got == ["mit-notice|all-rights-reserved", "mit-notice", "all-rights-reserved|all-rights-reserved"]


def test_tokens_of_white_space_runs_equal_the_whole_text():
    enc, _ = token_counts._encoder(token_counts.load_ranks(), token_counts.PATTERN)
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, token_counts.load_ranks().splitlines()) if a}
    plain = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    marks = [" ", "\n", "\t", "　", " ", "\r\n"]
    for n in (10, 999, 1000, 1001, 5000, 100_000):
        for k in range(6):
            run = "".join(rng.choice(marks[: k + 1], n))
            for text in (f"a{run}b", run, f"{run}b it's", f"a.{run}", f"a{run}x{run}'s", f"1{run}!{run}"):
                assert (enc.encode_to_numpy(text) == plain.encode_to_numpy(text)).all()


@pytest.mark.parametrize("run", [" " * 2 * N, "\n" * 2 * N, "a" * N])
def test_section_tokens_of_long_runs(spark, run):
    d = spark.createDataFrame([(1, f"x {run}y z"), (2, run)], "doc_id long, text string")
    got = token_counts.section_tokens(d).groupBy("doc_id").agg(F.sum("n_chars").alias("n"), F.sum("n_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: len(run) + 5, 2: len(run)} and all(r["t"] > 0 for r in got)
