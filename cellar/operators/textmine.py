"""Skill, education, experience and contact mining over a document table.

Input is any DataFrame with a document key and a text column. Every extractor
is a JVM-side regular-expression Column over the whole text — no Python UDF —
so documents are mined where they are stored, one projection per table.

Word boundaries: the reference uses Python's Unicode ``\\b``. Here a boundary
is "not next to a letter, digit or underscore" written as look-arounds on
``[\\p{L}\\p{N}_]``; that also lets ``c++`` and ``c#`` match before a space or
punctuation (the Python pattern can never match them there).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import compact, has_substring

from cellar.functions.sheet import fn_title

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Technical skills by category, in the reference's order.
TECHNICAL_SKILLS = {
    "programming": ["python", "java", "javascript", "c++", "c#", "sql", "r", "matlab", "scala", "go", "rust", "php", "ruby", "swift", "kotlin"],
    "web_development": ["html", "css", "react", "angular", "vue", "node.js", "express", "django", "flask", "bootstrap", "jquery"],
    "data_science": ["pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "keras", "matplotlib", "seaborn", "plotly", "tableau"],
    "databases": ["mysql", "postgresql", "mongodb", "redis", "oracle", "sqlite", "cassandra", "elasticsearch"],
    "cloud_platforms": ["aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "terraform", "ansible"],
    "analytics": ["excel", "power bi", "qlik", "looker", "spark", "hadoop", "kafka", "airflow"],
}
# Soft skills, in the reference's order.
SOFT_SKILLS = [
    "leadership", "communication", "teamwork", "problem solving", "analytical",
    "creative", "organized", "detail-oriented", "adaptable", "collaborative",
    "project management", "strategic thinking", "innovation", "mentoring",
]
# Education levels and their keywords, highest level first.
EDUCATION_LEVELS = {
    "PhD": ["phd", "ph.d", "doctorate", "doctoral"],
    "Masters": ["master", "msc", "ms", "mba", "ma", "meng"],
    "Bachelors": ["bachelor", "bsc", "bs", "ba", "beng", "btch"],
    "Associates": ["associate", "aa", "as", "aas"],
    "Certification": ["certificate", "certification", "certified"],
}
# Institution patterns (\w written as a Unicode word class below).
INSTITUTION_PATTERNS = [r"university of {w}+", r"{w}+ university", r"{w}+ college", r"{w}+ institute"]
# "N years ..." patterns for a candidate; the captured group is the number.
EXPERIENCE_PATTERNS = [
    r"(\d+)\+?\s*years?\s*(?:of\s*)?experience",
    r"(\d+)\+?\s*years?\s*in",
    r"experience\s*:\s*(\d+)\+?\s*years?",
    r"(\d+)\+?\s*years?\s*professional",
]
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
# Date-range patterns counted when no explicit years are stated (2 years each, at most 15).
JOB_PERIOD_PATTERNS = [
    rf"(?:{_MONTHS})\s+\d{{4}}\s*-\s*(?:present|current|{_MONTHS})\s*\d{{4}}",
    r"\d{4}\s*-\s*(?:present|current|\d{4})",
]
# Contact patterns.
EMAIL_PATTERN = r"{b}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{e}"
PHONE_PATTERN = r"[\+]?[1-9]?[\-\.\s]?\(?[0-9]{3}\)?[\-\.\s]?[0-9]{3}[\-\.\s]?[0-9]{4}"
LINKEDIN_PATTERN = r"(?i)linkedin\.com/in/[\p{L}\p{N}_\-]+"
GITHUB_PATTERN = r"(?i)github\.com/[\p{L}\p{N}_\-]+"
# Certification phrase patterns (on lower-cased text).
CERT_PATTERNS = [
    r"certified\s+[{w}\s]+",
    r"[{w}\s]+\s+certified",
    r"certification\s+in\s+[{w}\s]+",
    r"[{w}\s]+\s+certification",
]
CERT_MAX_WORDS, CERT_MIN_CHARS = 5, 5
# ---------------------------------------------------------------------------

WORD = r"\p{L}\p{N}_"
_B = rf"(?<![{WORD}])"
_E = rf"(?![{WORD}])"
CATEGORY_LABELS = {c: c.replace("_", " ").title() for c in TECHNICAL_SKILLS}
SEP = "\u0003"  # joins array items into one text; never part of a matched phrase


def _title_each(items: Column) -> Column:
    """Title-case every item of a string array without a lambda (join, title, split)."""
    return F.split(fn_title(F.array_join(items, SEP)), SEP)


def word_pattern(term: str) -> str:
    """Whole-word pattern for a vocabulary term: the literal first (fast scan),
    then the boundary checks before and after it."""
    lit = "\\Q" + term + "\\E"
    return lit + rf"(?<![{WORD}]{lit})(?![{WORD}])"


def is_single_word(term: str) -> bool:
    return re.fullmatch(r"[a-z0-9_]+", term) is not None


def tokens(lower_text: Column) -> Column:
    """Distinct maximal runs of word characters (one regex split per text).

    A term made only of word characters occurs as a whole word exactly when it
    is one of these runs, so single-word vocabulary terms need no regex scan.
    """
    return F.array_distinct(F.split(lower_text, rf"[^{WORD}]+"))


SINGLE_WORD_TERMS = sorted(
    {t for ts in TECHNICAL_SKILLS.values() for t in ts if is_single_word(t)}
    | {t for t in SOFT_SKILLS if is_single_word(t)}
    | {k for ks in EDUCATION_LEVELS.values() for k in ks if is_single_word(k)}
)


def vocabulary_hits(toks: Column) -> Column:
    """The single-word vocabulary terms present in ``toks`` (hash-based intersection)."""
    return F.array_intersect(F.array(*[F.lit(t) for t in SINGLE_WORD_TERMS]), toks)


def _has_term(lower_text: Column, term: str, hits: Column | None = None) -> Column:
    if hits is not None and is_single_word(term):
        return F.array_contains(hits, F.lit(term))
    # the cheap substring test short-circuits the regex for absent terms
    return has_substring(lower_text, term) & lower_text.rlike(word_pattern(term))


def terms_found(lower_text: Column, terms: Sequence[str], hits: Column | None = None) -> Column:
    """array<string> of the terms present as whole words, in vocabulary order."""
    return compact(F.array(*[F.when(_has_term(lower_text, t, hits), F.lit(t)) for t in terms]))


def technical_skills(lower_text: Column, hits: Column | None = None) -> Column:
    """txt_tech_skills: map category -> array of skills found (lower-case keys)."""
    return F.create_map(*[x for cat, skills in TECHNICAL_SKILLS.items() for x in (F.lit(cat), terms_found(lower_text, skills, hits))])


def soft_skills(lower_text: Column, hits: Column | None = None) -> Column:
    """txt_soft_skills: array of soft skills found."""
    return terms_found(lower_text, SOFT_SKILLS, hits)


def education_degrees(lower_text: Column, hits: Column | None = None) -> Column:
    """One entry per keyword hit, labelled by its level (the reference's list)."""
    found = [F.when(_has_term(lower_text, kw, hits), F.lit(level)) for level, kws in EDUCATION_LEVELS.items() for kw in kws]
    # repeats stay: one keyword of a level more is one entry more
    return F.array_remove(F.split(F.concat_ws(SEP, *found), SEP), "")


def highest_level(degrees: Column) -> Column:
    out = None
    for level in EDUCATION_LEVELS:
        cond = F.array_contains(degrees, level)
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit("Unknown"))


def institutions(lower_text: Column) -> Column:
    """txt_institutions: distinct title-cased 'university of X', 'X university', ... (sorted)."""
    empty = F.array().cast("array<string>")
    found = []
    for p in INSTITUTION_PATTERNS:
        word = "university" if "university" in p else p.rsplit(" ", 1)[-1]
        extract = F.regexp_extract_all(lower_text, F.lit("(" + p.format(w=f"[{WORD}]") + ")"), 1)
        found.append(F.when(has_substring(lower_text, word), extract).otherwise(empty))
    return F.sort_array(F.array_distinct(_title_each(F.concat(*found))))


def experience_years(text: Column, toks: Column | None = None) -> Column:
    """txt_experience_years: max stated years; else 2 x date ranges (at most 15); else 0."""
    low = F.lower(text)
    has_year = has_substring(low, "year")
    empty = F.array().cast("array<string>")
    nums = F.when(has_year, F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p), 1) for p in EXPERIENCE_PATTERNS])).otherwise(empty)
    stated = F.array_max(nums.try_cast("array<bigint>"))
    month_range = F.regexp_count(text, F.lit("(?i)" + JOB_PERIOD_PATTERNS[0]))
    if toks is not None:  # a month range needs a month name as a word: test the token set first
        months = F.array(*[F.lit(m) for m in _MONTHS.split("|")])
        month_range = F.when(F.arrays_overlap(toks, months), month_range).otherwise(F.lit(0))
    periods = month_range + F.regexp_count(text, F.lit("(?i)" + JOB_PERIOD_PATTERNS[1]))
    fallback = F.when(periods > 0, F.least(periods * 2, F.lit(15))).otherwise(F.lit(0))
    return F.coalesce(stated, fallback).cast("bigint")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def contact_info(text: Column) -> Column:
    """txt_contact: first e-mail, phone, LinkedIn and GitHub match (null when absent)."""
    low = F.lower(text)
    return F.struct(
        F.when(has_substring(text, "@"), _first(text, EMAIL_PATTERN.format(b=_B, e=_E))).alias("email"),
        F.when(text.rlike("[0-9]{3}"), _first(text, PHONE_PATTERN)).alias("phone"),
        F.when(has_substring(low, "linkedin.com/in/"), _first(text, LINKEDIN_PATTERN)).alias("linkedin"),
        F.when(has_substring(low, "github.com/"), _first(text, GITHUB_PATTERN)).alias("github"),
    )


def certifications(lower_text: Column) -> Column:
    """txt_certifications: phrases around certified / certification.

    Distinct, stripped, title-cased, at most 5 words and more than 5 chars;
    sorted, all of them. A phrase that ends in the key word starts where its run
    of words starts (the look-behind; the greedy run reaches the last key word
    anyway). Of a run of white space 20 characters are searched, so that the
    patterns do not try every part of a long one and the search is linear.
    """
    pats = [p.format(w=WORD) for p in CERT_PATTERNS]
    lower_text = F.regexp_replace(lower_text, r"(\s{20})\s+", "$1")
    run_start = rf"(?<![{WORD}\s])"
    has_cd = has_substring(lower_text, "certified")
    has_cn = has_substring(lower_text, "certification")
    empty = F.array().cast("array<string>")
    found = F.concat(
        F.when(has_cd, F.regexp_extract_all(lower_text, F.lit("(" + pats[0] + ")"), 1)).otherwise(empty),
        F.when(has_cd, F.regexp_extract_all(lower_text, F.lit("(" + run_start + pats[1] + ")"), 1)).otherwise(empty),
        F.when(has_cn, F.regexp_extract_all(lower_text, F.lit("(" + pats[2] + ")"), 1)).otherwise(empty),
        F.when(has_cn, F.regexp_extract_all(lower_text, F.lit("(" + run_start + pats[3] + ")"), 1)).otherwise(empty),
    )
    # strip every phrase and title-case them all at once; then count the words of each
    joined = F.regexp_replace(F.array_join(found, SEP), rf"\s*{SEP}\s*", SEP)
    joined = F.btrim(joined, F.lit(" \t\n\x0b\f\r"))
    parts = F.array_distinct(F.split(fn_title(joined), SEP))
    kept = F.filter(parts, lambda p: (F.size(F.split(p, r"\s+")) <= CERT_MAX_WORDS) & (F.length(p) > CERT_MIN_CHARS))
    return F.when(F.size(found) > 0, F.sort_array(kept)).otherwise(F.array().cast("array<string>"))


def all_skills(tech_map: Column, soft: Column) -> Column:
    """Flat array of every skill found: technical (category order) then soft."""
    return F.concat(*[F.coalesce(tech_map[c], F.array().cast("array<string>")) for c in TECHNICAL_SKILLS], soft)


def analyze(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """txt_analyze: every extractor in one projection, plus summary counts.

    ``total_technical_skills`` counts skills (the reference counted categories
    and always reported 6); ``skills_diversity`` counts non-empty categories.
    """
    staged = df.select(*keep, F.col(text_col).alias("__text"), F.lower(F.col(text_col)).alias("__low"))
    staged = staged.withColumn("__toks", tokens(F.col("__low")))
    staged = staged.withColumn("__hits", vocabulary_hits(F.col("__toks")))
    low, hits, text, toks = F.col("__low"), F.col("__hits"), F.col("__text"), F.col("__toks")
    base = staged.select(
        *keep,
        technical_skills(low, hits).alias("technical_skills"),
        soft_skills(low, hits).alias("soft_skills"),
        education_degrees(low, hits).alias("degrees"),
        institutions(low).alias("institutions"),
        experience_years(text, toks).alias("experience_years"),
        contact_info(text).alias("contact"),
        certifications(low).alias("certifications"),
    )
    tech_sizes = [F.size(F.col("technical_skills")[c]) for c in TECHNICAL_SKILLS]
    return base.select(
        "*",
        highest_level(F.col("degrees")).alias("education_level"),
        sum(tech_sizes, F.lit(0)).alias("total_technical_skills"),
        F.size("soft_skills").alias("total_soft_skills"),
        sum((F.when(s > 0, 1).otherwise(0) for s in tech_sizes), F.lit(0)).alias("skills_diversity"),
        all_skills(F.col("technical_skills"), F.col("soft_skills")).alias("all_skills"),
    )


def skill_rows(analysis: DataFrame, key: str = "doc_id") -> DataFrame:
    """txt_skill_rows: long form (key, skill, category, type, count=1)."""
    tech = analysis.select(key, F.explode_outer("technical_skills").alias("category", "skills")).select(
        key,
        F.explode_outer("skills").alias("skill"),
        F.col("category"),
    ).filter(F.col("skill").isNotNull())
    labels = F.create_map(*[x for c, lab in CATEGORY_LABELS.items() for x in (F.lit(c), F.lit(lab))])
    tech = tech.select(key, "skill", labels[F.col("category")].alias("category"), F.lit("Technical").alias("type"))
    soft = analysis.select(key, F.explode_outer("soft_skills").alias("skill")).filter(F.col("skill").isNotNull()).select(
        key, "skill", F.lit("Soft Skills").alias("category"), F.lit("Soft").alias("type")
    )
    return tech.unionByName(soft).withColumn("count", F.lit(1)).withColumn("label", fn_title(F.col("skill")))


def skill_totals(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """txt_skill_totals: documents per (category, skill) across the corpus."""
    return rows.groupBy("category", "skill").agg(F.countDistinct(key).alias("n_docs"))


def skill_match(skills: Column, requirements: Column) -> Column:
    """txt_skill_match: % of requirements met, matched / missing lists, totals."""
    reqs = F.transform(requirements, lambda r: F.lower(r))
    matched = F.filter(reqs, lambda r: F.array_contains(skills, r))
    missing = F.filter(reqs, lambda r: ~F.array_contains(skills, r))
    n = F.size(reqs)
    score = F.when(n > 0, F.round(F.size(matched) * 100.0 / n, 1)).otherwise(F.lit(0.0))
    return F.struct(
        score.alias("match_score"),
        matched.alias("matched_skills"),
        missing.alias("missing_skills"),
        n.alias("total_requirements"),
        F.size(matched).alias("total_matches"),
    )


# ---------------------------------------------------------------- job text helpers

# Title keyword rules -> inferred skills (lower-case).
TITLE_RULES = [
    (("software", "developer", "programmer"), None, ["python", "javascript", "sql", "git"]),
    (("data",), ("scientist",), ["python", "machine learning", "statistics", "sql"]),
    (("frontend", "front-end"), None, ["javascript", "react", "css", "html"]),
    (("backend", "back-end"), None, ["python", "java", "sql", "api"]),
    (("devops",), None, ["aws", "docker", "kubernetes", "jenkins"]),
    (("manager",), None, ["leadership", "project management", "communication"]),
]
JOB_EXPERIENCE_PATTERNS = [
    r"(\d+)\+?\s*years?\s*(?:of\s*)?experience",
    r"(\d+)\+?\s*years?\s*minimum",
    r"minimum\s*(\d+)\+?\s*years?",
    r"(\d+)\+?\s*years?\s*required",
]
JOB_EDUCATION_RULES = [
    ("PhD", ["phd", "doctorate", "doctoral"]),
    ("Masters", ["masters", "master", "mba"]),
    ("Bachelors", ["bachelors", "bachelor", "degree"]),
    ("Associates", ["associates", "associate"]),
]
DEFAULT_JOB_EXPERIENCE, DEFAULT_JOB_EDUCATION = 2, "Bachelors"


def title_skills(title: Column) -> Column:
    """txt_title_skills: skills inferred from a job title (substring rules, in rule order)."""
    t = F.lower(title)
    parts = []
    for any_of, all_of, skills in TITLE_RULES:
        cond = None
        for w in any_of:
            c = has_substring(t, w)
            cond = c if cond is None else cond | c
        for w in all_of or ():
            cond = cond & has_substring(t, w)
        parts.append(F.when(cond, F.array(*[F.lit(s) for s in skills])).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def job_experience(text: Column) -> Column:
    """txt_job_experience: first match of the first pattern that matches; default 2."""
    low = F.lower(text)
    vals = [F.nullif(F.regexp_extract(low, p, 1), F.lit("")).try_cast("bigint") for p in JOB_EXPERIENCE_PATTERNS]
    return F.coalesce(*vals, F.lit(DEFAULT_JOB_EXPERIENCE).cast("bigint"))


def job_education(text: Column) -> Column:
    """txt_job_education: first level whose word occurs (substring); default Bachelors."""
    low = F.lower(text)
    out = None
    for level, words in JOB_EDUCATION_RULES:
        cond = None
        for w in words:
            c = has_substring(low, w)
            cond = c if cond is None else cond | c
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit(DEFAULT_JOB_EDUCATION))
