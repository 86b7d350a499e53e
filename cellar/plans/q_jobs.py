"""Query bindings: candidate x job matching.

Candidates are the mined ``pages`` (their markup holds the skill "html") and
``documents``; the loaded-job-table variant uses ``pages`` as the posting table.
The oracles evaluate every candidate x job pair by brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import jobmatch as JM
from cellar.operators import textmine as TM
from cellar.plans.q_text import _DOCS_SQL, _PAGES_SQL, _docs, _pages, _with_resume, sql_degrees, sql_experience, sql_highest, sql_terms, _job_edu_sql, _job_exp_sql, _title_sql
from cellar.plans.registry import register
from cellar.session import table
from cellar.sources.jobs import DEFAULT_JOBS


def _cand_sql(src: str) -> str:
    all_sk = " || ',' || ".join(
        [sql_terms("lower(text)", s) for s in TM.TECHNICAL_SKILLS.values()] + [sql_terms("lower(text)", TM.SOFT_SKILLS)]
    )
    return f"""SELECT doc_id, list_distinct(list_filter(string_split({all_sk}, ','), lambda x: x <> '')) AS skills,
                      {sql_experience('text')} AS cand_exp, {sql_highest(sql_degrees('lower(text)'))} AS edu FROM {src}"""


def _rank_sql(x: str, table_: dict, default: int) -> str:
    whens = " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in table_.items())
    return f"(CASE {whens} ELSE {default} END)"


def _jobs_values() -> str:
    rows = []
    for i, (t, c, reqs, y, e, s) in enumerate(DEFAULT_JOBS):
        arr = "[" + ", ".join(f"'{r}'" for r in reqs) + "]"
        rows.append(f"({i}, '{t}', '{c}', {arr}, {y}, '{e}', '{s}')")
    return "(VALUES " + ", ".join(rows) + ") AS j(job_id, title, company, requirements, experience_required, education_required, salary_range)"


def _default_match_sql(src: str, top: int = 5) -> str:
    cand_rank = _rank_sql("edu", JM.EDUCATION_RANK, JM.UNKNOWN_CANDIDATE_RANK)
    job_rank = _rank_sql("education_required", JM.EDUCATION_RANK, JM.UNKNOWN_JOB_RANK)
    return f"""
WITH cand AS ({_cand_sql(src)}),
pairs AS (
  SELECT cand.*, j.*, list_transform(requirements, lambda r: lower(r)) AS reqs FROM cand, {_jobs_values()}
  WHERE len(list_intersect(list_transform(requirements, lambda r: lower(r)), skills)) > 0),
s1 AS (
  SELECT *, list_filter(reqs, lambda r: list_contains(skills, r)) AS matched,
            list_filter(reqs, lambda r: NOT list_contains(skills, r)) AS missing,
            cand_exp >= experience_required AS exp_ok, {cand_rank} >= {job_rank} AS edu_ok FROM pairs),
s2 AS (SELECT *, len(matched) * 100.0 / len(reqs) AS pct FROM s1),
s3 AS (SELECT *, greatest(0.0, least(100.0, pct + CASE WHEN exp_ok THEN 10 ELSE -15 END + CASE WHEN edu_ok THEN 10 ELSE -20 END)) AS sc FROM s2),
s4 AS (SELECT *, round(sc, 1) AS match_score FROM s3 WHERE sc >= 30 OR (pct >= 50 AND (exp_ok OR edu_ok))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY match_score DESC, job_id) AS rank FROM s4)
SELECT doc_id, rank, job_id, title, company, array_to_string(requirements, ',') AS requirements, experience_required,
       education_required, salary_range, match_score, array_to_string(matched, ',') AS matched_skills,
       array_to_string(missing, ',') AS missing_skills,
       concat_ws(', ', CASE WHEN pct >= 70 THEN 'Strong skill alignment' WHEN pct >= 50 THEN 'Good skill match' ELSE 'Partial skill match' END,
                 CASE WHEN exp_ok THEN 'meets experience requirement' ELSE 'needs ' || CAST(experience_required - cand_exp AS VARCHAR) || ' more years experience' END,
                 CASE WHEN edu_ok THEN 'meets education requirement' ELSE 'consider pursuing ' || education_required || ' degree' END) AS match_reason
FROM r WHERE rank <= {top}"""


def _flat(df):
    return df.select(
        "doc_id",
        F.col("rank").cast("bigint").alias("rank"),
        "job_id",
        "title",
        "company",
        F.array_join("requirements", ",").alias("requirements"),
        "experience_required",
        "education_required",
        "salary_range",
        "match_score",
        F.array_join("matched_skills", ",").alias("matched_skills"),
        F.array_join("missing_skills", ",").alias("missing_skills"),
        "match_reason",
    )


# postings: the pages, each with a line that names a title, skills, years and a degree
_JOBS_SQL = f"(SELECT page_id, url, {_with_resume('html', 'page_id')} AS html FROM pages)"


@register("jn_job_match", _default_match_sql(_PAGES_SQL))
def q_job_match(spark, d):
    return _flat(JM.match_default_jobs(TM.analyze(_pages(spark, d))))


@register("jn_job_match_documents", _default_match_sql(_DOCS_SQL))
def q_job_match_docs(spark, d):
    return _flat(JM.match_default_jobs(TM.analyze(_docs(spark, d))))


def _vocab_gt2_sql() -> str:
    return "[" + ", ".join(f"'{s}'" for s in JM._vocab_len_gt2()) + "]"


def _table_match_sql(top: int = 8) -> str:
    # job table = pages(page_id order key; url, html): title = 2nd column (html), company = 1st (url)
    cand_rank = _rank_sql("edu", JM.TABLE_EDUCATION_RANK, JM.UNKNOWN_CANDIDATE_RANK)
    cells = "list_filter([url, html], lambda c: c IS NOT NULL)"
    text = f"array_to_string({cells}, ' ')"
    return f"""
WITH cand AS ({_cand_sql(_PAGES_SQL)}),
jobs AS (
  SELECT page_id AS job_order, trim(html) AS title, trim(url) AS company,
         list_filter({_vocab_gt2_sql()}, lambda s: len(list_filter({cells}, lambda c: contains(lower(c), s))) > 0) AS text_skills,
         list_sort(list_distinct({_title_sql('trim(html)')})) AS title_skills,
         {_job_exp_sql(text)} AS experience_required, {_job_edu_sql(text)} AS education_required,
         'Industry not specified | Location not specified' AS salary_range
  FROM {_JOBS_SQL} WHERE html IS NOT NULL AND url IS NOT NULL),
jr AS (SELECT *, {_rank_sql("education_required", JM.TABLE_EDUCATION_RANK, JM.UNKNOWN_JOB_RANK)} AS job_rank FROM jobs),
pairs AS (SELECT cand.*, jr.* FROM cand, jr
          WHERE len(list_intersect(skills, list_concat(text_skills, title_skills))) > 0),
s1 AS (SELECT *, list_filter(text_skills, lambda s: list_contains(skills, s)) AS text_hit FROM pairs),
s2 AS (SELECT *, CASE WHEN len(text_hit) > 0 THEN text_hit ELSE title_skills END AS job_skills FROM s1),
s3 AS (SELECT *, list_filter(job_skills, lambda s: list_contains(skills, s)) AS matched,
                 list_filter(job_skills, lambda s: NOT list_contains(skills, s)) AS missing,
                 CASE WHEN len(job_skills) > 0 THEN len(list_filter(job_skills, lambda s: list_contains(skills, s))) * 100.0 / len(job_skills) ELSE 0.0 END AS pct,
                 cand_exp >= experience_required AS exp_ok, {cand_rank} >= job_rank AS edu_ok FROM s2),
s4 AS (SELECT *, greatest(0.0, least(100.0, pct + CASE WHEN exp_ok THEN 10 ELSE -15 END + CASE WHEN edu_ok THEN 10 ELSE -10 END)) AS sc FROM s3),
s5 AS (SELECT *, round(sc, 1) AS match_score FROM s4 WHERE sc >= 25 OR (pct >= 40 AND exp_ok)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY match_score DESC, job_order) AS rank FROM s5)
SELECT doc_id, job_order, title, company, array_to_string(list_sort(job_skills), ',') AS requirements,
       experience_required, education_required, salary_range, match_score,
       array_to_string(list_sort(matched), ',') AS matched_skills, array_to_string(list_sort(missing), ',') AS missing_skills,
       concat_ws(', ', CASE WHEN pct >= 70 THEN 'Strong skill alignment' WHEN pct >= 40 THEN 'Good skill match' ELSE 'Partial skill match' END,
                 CASE WHEN exp_ok THEN 'meets experience requirement' ELSE 'needs ' || CAST(experience_required - cand_exp AS VARCHAR) || ' more years experience' END,
                 CASE WHEN edu_ok THEN 'meets education requirement' ELSE 'consider ' || education_required || ' degree' END) AS match_reason,
       rank
FROM r WHERE rank <= {top}"""


@register("jn_job_table_match", _table_match_sql())
def q_job_table(spark, d):
    cands = TM.analyze(_pages(spark, d))
    jobs = table(spark, d, "pages").select("page_id", "url", F.expr(_with_resume("html", "page_id")).alias("html"))
    m = JM.match_job_table(cands, jobs, order_by="page_id")
    return m.select(
        "doc_id",
        "job_order",
        "title",
        "company",
        F.array_join("requirements", ",").alias("requirements"),
        "experience_required",
        "education_required",
        "salary_range",
        "match_score",
        F.array_join("matched_skills", ",").alias("matched_skills"),
        F.array_join("missing_skills", ",").alias("missing_skills"),
        "match_reason",
        F.col("rank").cast("bigint").alias("rank"),
    )
