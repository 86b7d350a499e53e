"""Vocabularies of any size searched in one pass over each text.

The terms form one automaton (Aho-Corasick), which every task builds once from
the broadcast list. It reads a text once and meets every occurrence of every
term, overlapping ones too, so ten thousand terms cost about what a hundred do.
Few terms are tested one by one in the JVM instead, which is faster for them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import compact, has_substring, require_columns

#: up to so many terms are tested one by one; a vocabulary has at most MAX_TERMS terms
FEW_TERMS, MAX_TERMS = 100, 1_000_000
#: so many texts of a batch are held as Python strings at once
SLICE = 64
WORD = r"\p{L}\p{N}_"


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        a.add_word(t, (i, len(t)))
    a.make_automaton()
    return a


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _found(automaton, text: str, whole: bool) -> list[int]:
    """Numbers of the terms in a text, ascending."""
    seen, n = set(), len(text)
    for end, (i, size) in automaton.iter(text):
        if i in seen:
            continue
        start = end + 1 - size
        if whole and ((start > 0 and _in_word(text[start - 1])) or (end + 1 < n and _in_word(text[end + 1]))):
            continue
        seen.add(i)
    return sorted(seen)


def _found_names(automaton, names: pa.Array, texts: pa.Array, whole: bool) -> pa.Array:
    """The terms in each text of an Arrow batch; SLICE texts at a time are Python strings, found terms are numbers."""
    ends, found = array("i", [0]), array("i")
    for at in range(0, len(texts), SLICE):
        for t in texts.slice(at, SLICE).to_pylist():
            if t:
                found.extend(_found(automaton, t, whole))
            ends.append(len(found))
    return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), names.take(pa.array(np.array(found, np.int32))))


def check_terms(terms: Sequence[str]) -> list[str]:
    """The distinct non-empty terms in their order; more than MAX_TERMS are refused."""
    out = list(dict.fromkeys(t for t in terms if t))
    if len(out) > MAX_TERMS:
        raise ValueError(f"{len(out)} terms: a vocabulary has at most {MAX_TERMS}")
    return out


def find_terms(df: DataFrame, text: Column, terms: Sequence[str], whole_words: bool = True) -> Column:
    """array<string> of the terms that occur in ``text``, in the vocabulary's order.

    Text and terms are compared as they are (lower-case both for a search that
    ignores case). With ``whole_words`` a term counts where no letter, digit or
    underscore touches it. A null text has no terms.
    """
    terms = check_terms(terms)
    if len(terms) <= FEW_TERMS:
        tests = []
        for t in terms:
            lit = "\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            whole = text.rlike(f"(?<![{WORD}]){lit}(?![{WORD}])") if whole_words else F.lit(True)
            tests.append(F.when(has_substring(text, t) & whole, F.lit(t)))
        return compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    shared = df.sparkSession.sparkContext.broadcast(tuple(terms))

    @F.arrow_udf("array<string>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, names = _automaton(shared.value), pa.array(shared.value, pa.string())
        for texts in batches:
            yield _found_names(automaton, names, texts, whole_words)

    return search(text)


def vocabulary_rows(df: DataFrame, key: str, text: str, terms: Sequence[str], whole_words: bool = True) -> DataFrame:
    """(key, term) for every term of the vocabulary found in the lower-cased text of a row."""
    require_columns(df, [key, text])
    found = df.select(F.col(key), find_terms(df, F.lower(F.col(text)), [t.lower() for t in terms], whole_words).alias("__terms"))
    return found.select(key, F.explode("__terms").alias("term"))


def vocabulary_totals(df: DataFrame, text: str, terms: Sequence[str], whole_words: bool = True) -> DataFrame:
    """(term, n_texts): in how many rows each term of the vocabulary that occurs was found."""
    found = df.select(F.explode(find_terms(df, F.lower(F.col(text)), [t.lower() for t in terms], whole_words)).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_texts"))


def read_terms(table: DataFrame, column: str) -> list[str]:
    """The distinct non-null terms of a vocabulary table, sorted; more than MAX_TERMS are refused."""
    rows = table.select(F.col(column).cast("string").alias("t")).where("t <> ''").distinct().orderBy("t").limit(MAX_TERMS + 1).collect()
    return check_terms([r["t"] for r in rows])
