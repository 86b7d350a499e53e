"""Quality rules with risk-controlled cutoffs.

A rule rejects a document whose value lies beyond a cutoff. Cutoffs are chosen
per stratum on labelled documents: each rule walks a fixed list of cutoffs from
the mildest to the strictest and goes on while an exact binomial test shows, at
the level left for that (stratum, rule), that the rule rejects at most its share
of the stratum's good documents. The walk ends at the first cutoff that cannot
be shown safe (fixed-sequence testing, which needs no further correction), the
levels of all (stratum, rule) pairs add up to ``delta`` (Bonferroni), and the
shares of a stratum's rules add up to ``alpha``. So with probability at least
1 - ``delta``, in every stratum at once, at most ``alpha`` of the good documents
are rejected by rules. A stratum with too few labels to show that gets no
cutoff and loses nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.llm.kernels import INK, chunks, grams, mix, text_bytes, words
from cellar.session import materialize

#: share of a stratum's good documents that may be rejected, and the chance of any stratum exceeding it
ALPHA, DELTA = 0.05, 0.05
MEASURES = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_caps".split()
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
AS_IS = np.arange(256, dtype=np.uint8)


@dataclass(frozen=True)
class Rule:
    """Reject where ``numerator / denominator`` is above (or below) a cutoff; ``cutoffs`` run from mild to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]
    above: bool = True

    def value(self) -> Column:
        """The rule's value; null, which no cutoff rejects, where the denominator is 0."""
        return F.when(F.col(self.denominator) > 0, F.col(self.numerator) / F.col(self.denominator))

    def beyond(self, value: Column, cutoff) -> Column:
        return value > cutoff if self.above else value < cutoff


RULES = (
    Rule("symbols", "n_symbols", "n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("capitals", "n_caps", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("long_words", "word_chars", "n_words", (40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 9.0)),
    Rule("short_words", "word_chars", "n_words", (1.5, 2.0, 2.5, 3.0, 3.5, 4.0), above=False),
)


def _per_text(marks: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set marks in each ``off[d]:off[d+1]``."""
    at = np.flatnonzero(marks)
    return np.diff(np.searchsorted(at, off))


def _repeat_words(w) -> np.ndarray:
    """For each text, its words that lie in a window of 3 words found at least twice in it."""
    covered = np.zeros(len(w.hash), bool)
    g = grams(w.hash, 3)
    if len(g):
        text = w.text
        inside = np.flatnonzero(np.arange(len(g)) + 3 <= w.text_end()[: len(g)])
        key = mix(g[inside] + mix(text[inside].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for j in range(3):
            covered[at + j] = True
    return _per_text(covered, w.off)


def _line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text, its lines that hold a word, and those among them that equal an earlier line."""
    lines = pc.split_pattern(texts.fill_null("").cast(pa.large_string()), "\n")
    owner = pc.list_parent_indices(lines).to_numpy()
    codes = pc.list_flatten(lines).dictionary_encode()
    data, off = text_bytes(codes.dictionary)
    inked = _per_text(INK[data], off) > 0
    code = codes.indices.to_numpy()
    keep = inked[code]
    owner, code = owner[keep], code[keep].astype(np.int64)
    distinct = np.unique(owner * len(inked) + code) // max(len(inked), 1)
    n = np.bincount(owner, minlength=len(texts))
    return n, n - np.bincount(distinct, minlength=len(texts))


def _measure_task(batches):
    for batch in batches:
        for c in chunks(batch):
            col = c.column(c.schema.get_field_index("text"))
            w = words(col, INK, AS_IS)
            n_lines, n_dup = _line_counts(col)
            got = {
                "n_words": w.counts,
                "word_chars": _per_text(INK[w.data] & ((w.data & 0xC0) != 0x80), w.text_off),
                "n_symbols": _per_text(SYMBOLS[w.data], w.text_off),
                "n_dup_lines": n_dup,
                "n_repeat_words": _repeat_words(w),
                "n_lines": n_lines,
                "n_caps": _per_text((w.data >= 0x41) & (w.data <= 0x5A), w.text_off),
            }
            rest = [i for i, name in enumerate(c.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(c.column(i) for i in rest), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)],
                names=[*(c.schema.names[i] for i in rest), *MEASURES],
            )


def measures(docs: DataFrame) -> DataFrame:
    """The columns of ``docs(text, ...)`` but the text, and the measures of the whole text (zeros for null and empty)."""
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != "text")
    return docs.mapInArrow(_measure_task, f"{kept}, {', '.join(f'{m} long' for m in MEASURES)}")


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(at most x successes in n trials of chance p): summed downwards from x, the largest term below the mean."""
    if x >= n:
        return 1.0
    if p <= 0.0:
        return 1.0
    if x > n * p:  # sum the short upper tail instead
        return 1.0 - binomial_tail(n - x - 1, n, 1.0 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))
    total, i = term, x
    while i > 0 and term > total * 1e-17:
        term *= i * (1.0 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return min(1.0, total)


def upper_bound(x: int, n: int, level: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a chance of which x of n trials came true."""
    if x >= n:
        return 1.0
    lo, hi = x / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(x, n, mid) > level else (lo, mid)
    return hi


def _walk(steps: list[tuple[int, int]], n_cutoffs: int, n: int, share: float, level: float) -> tuple[int, int]:
    """(index of the strictest cutoff shown safe, or -1; good documents it rejects).

    ``steps`` has (first cutoff that rejects, number of good documents).
    """
    by_step = dict(steps)
    best, rejected, total = -1, 0, 0
    for k in range(n_cutoffs):
        total += by_step.get(k, 0)
        if binomial_tail(total, n, share) > level:
            break
        best, rejected = k, total
    return best, rejected


def select_cutoffs(good: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Cutoffs from the measures of good documents, ``good(doc_id, stratum, <measures>)``.

    Returns stratum, rule, cutoff (null: none is shown safe), n_good, n_rejected
    and upper_bound (of the share of good documents that the rule rejects). Rows
    of one doc_id in a stratum count once, with their worst value. Documents are
    only counted: a (stratum, rule) has at most one row per cutoff.
    """
    if not 0 < alpha < 1 or not 0 < delta < 1:
        raise ValueError("alpha and delta must lie between 0 and 1")
    once = good.select("doc_id", "stratum", *[r.value().alias(f"v{i}") for i, r in enumerate(rules)])
    once = once.groupBy("doc_id", "stratum").agg(*[(F.max if r.above else F.min)(f"v{i}").alias(f"v{i}") for i, r in enumerate(rules)])

    def first(i: int, r: Rule) -> Column:
        at = F.lit(len(r.cutoffs))
        for k in reversed(range(len(r.cutoffs))):
            at = F.when(r.beyond(F.col(f"v{i}"), F.lit(r.cutoffs[k])), k).otherwise(at)
        return F.struct(F.lit(i).alias("rule"), at.alias("step"))

    seen = once.select("stratum", F.explode(F.array(*[first(i, r) for i, r in enumerate(rules)])).alias("s"))
    counts = seen.groupBy("stratum", "s.rule", "s.step").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n_good"), F.collect_list(F.struct("step", "n")).alias("steps"))
    pairs = materialize(pairs)
    tests = pairs.count()
    share, level = alpha / len(rules), delta / max(tests, 1)

    def task(batches):
        for b in batches:
            got = {k: [] for k in ("rule", "cutoff", "n_good", "n_rejected", "upper_bound")}
            for row in b.select(["rule", "n_good", "steps"]).to_pylist():
                r, n = rules[row["rule"]], row["n_good"]
                k, x = _walk([(s["step"], s["n"]) for s in row["steps"]], len(r.cutoffs), n, share, level)
                for name, v in zip(got, (r.name, r.cutoffs[k] if k >= 0 else None, n, x, upper_bound(x, n, level))):
                    got[name].append(v)
            own = [b.column(b.schema.get_field_index("stratum")), pa.array(got["rule"], pa.string()), pa.array(got["cutoff"], pa.float64())]
            own += [pa.array(got[k], pa.int64()) for k in ("n_good", "n_rejected")] + [pa.array(got["upper_bound"], pa.float64())]
            yield pa.RecordBatch.from_arrays(own, names=["stratum", *got])

    return pairs.mapInArrow(task, f"stratum {pairs.schema['stratum'].dataType.simpleString()}, rule string, cutoff double, n_good long, n_rejected long, upper_bound double")


def apply_cutoffs(measured: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rejected_by``, the names of the rules that reject a row of ``measured(stratum, <measures>)``.

    One row of cutoffs per stratum is joined (a null stratum is a stratum);
    whether it is broadcast is left to Spark, which knows its written size.
    """
    names = [r.name for r in rules]
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == n, F.col("cutoff"))).alias(f"cut_{n}") for n in names])
    wide = materialize(wide.withColumnRenamed("stratum", "cut_stratum"))
    out = measured.join(wide, measured["stratum"].eqNullSafe(wide["cut_stratum"]), "left")
    tests = [F.when(r.beyond(r.value(), F.col(f"cut_{r.name}")), F.lit(r.name)) for r in rules]
    return out.withColumn("rejected_by", F.array_compact(F.array(*tests))).drop("cut_stratum", *[f"cut_{n}" for n in names])


def base_failed() -> Column:
    """Too short, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict for every row of ``docs``: doc_id, stratum, the measures, base_failed, rejected_by, kept.

    ``labels(doc_id, quality)`` name the good documents (quality 1; an id with
    several labels is good if none is less, null labels are left out). Good
    documents that fail the base test are no evidence for a cutoff and are left
    out. Null and empty texts have no words and fail the base test; a null id
    has no label; repeated rows are judged alike; without labels no rule rejects.
    """
    d = docs.select(docs[id_col].alias("doc_id"), docs[stratum].alias("stratum"), docs[text_col].cast("string").alias("text"))
    m = materialize(measures(d)).withColumn("base_failed", base_failed())
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    sample = m.where(~F.col("base_failed")).join(good.select("doc_id"), "doc_id", "left_semi")
    out = apply_cutoffs(m, select_cutoffs(sample, rules, alpha, delta), rules)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
