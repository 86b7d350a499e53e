"""Document mining and job matching on hand-written résumé rows (expected values worked out by hand)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cellar.functions.sheet import fn_title
from cellar.operators import jobmatch as JM
from cellar.operators import textmine as TM

RESUME_A = """Jordan Example
jordan.example@mail.test | +1 (555) 010-4477 | linkedin.com/in/jordan-example | github.com/jexample

Summary: Data engineer with 7+ years of experience building pipelines.
Skills: Python, SQL, C++, C#, Node.js, React, Docker, Kubernetes, AWS, Power BI, Spark, scikit-learn
Strengths: leadership, teamwork, problem solving, detail-oriented

Experience
Senior Engineer, Example Corp  March 2019 - Present
Engineer, Sample Ltd  2015 - 2019

Education
Master of Science, University of Somewhere, 2015
B.S. in Mathematics, Westfield College

Certifications
AWS Certified Solutions Architect
Certified Kubernetes Administrator"""

RESUME_B = "Recent graduate. Skills: Excel, HTML, CSS. Associate degree. 1 year in retail."

RESUME_C = "Analyst. Worked at Northwind 2016 - 2018 and January 2018 - March 2020, then 2020 - present. Ré-r and r."


@pytest.fixture(scope="module")
def analysis(spark):
    df = spark.createDataFrame([(1, RESUME_A), (2, RESUME_B), (3, RESUME_C)], "doc_id long, text string")
    return {r.doc_id: r for r in TM.analyze(df).collect()}


def test_technical_skills_repairs_cpp_and_csharp(analysis):
    t = analysis[1].technical_skills
    assert t["programming"] == ["python", "c++", "c#", "sql"]
    assert t["web_development"] == ["react", "node.js"]
    assert t["data_science"] == ["scikit-learn"]
    assert t["cloud_platforms"] == ["aws", "docker", "kubernetes"]
    assert t["analytics"] == ["power bi", "spark"]
    assert t["databases"] == []
    assert analysis[1].total_technical_skills == 12 and analysis[1].skills_diversity == 5


def test_soft_skills_in_vocabulary_order(analysis):
    assert analysis[1].soft_skills == ["leadership", "teamwork", "problem solving", "detail-oriented"]


def test_unicode_word_boundaries(analysis):
    # "Ré-r": the r after '-' is a word of its own, "ré" is not; "and r." counts too
    assert analysis[3].technical_skills["programming"] == ["r"]


def test_education(analysis):
    assert analysis[1].degrees == ["Masters", "Certification"]
    assert analysis[1].education_level == "Masters"
    assert analysis[2].education_level == "Associates"


def test_institutions_title_cased_and_sorted(analysis):
    assert analysis[1].institutions == ["University Of Somewhere", "Westfield College"]


def test_experience(analysis):
    assert analysis[1].experience_years == 7
    assert analysis[2].experience_years == 1
    # no stated years: 2 year ranges ("2018 - March" is not one) + 1 month range -> 3 * 2 = 6
    assert analysis[3].experience_years == 6


def test_contact(analysis):
    c = analysis[1].contact
    assert c.email == "jordan.example@mail.test"
    assert c.phone == "+1 (555) 010-4477"
    assert c.linkedin == "linkedin.com/in/jordan-example"
    assert c.github == "github.com/jexample"
    assert analysis[2].contact.email is None


def test_certifications_follow_greedy_patterns(analysis):
    # the greedy phrase patterns span lines; long phrases are dropped (> 5 words)
    assert analysis[1].certifications == ["Westfield College\n\nCertification"]


def test_title_case_like_python(spark):
    words = ["node.js", "scikit-learn", "power bi", "c++", "they're 3d"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(fn_title(F.col("w"))).collect()] == [w.title() for w in words]


def test_skill_rows_and_match(spark, analysis):
    df = spark.createDataFrame([(1, RESUME_A)], "doc_id long, text string")
    a = TM.analyze(df)
    rows = TM.skill_rows(a).collect()
    assert len(rows) == 16
    assert {(r.category, r.label) for r in rows if r.skill == "node.js"} == {("Web Development", "Node.Js")}
    m = a.select(TM.skill_match(F.col("all_skills"), F.array(F.lit("Python"), F.lit("Git"), F.lit("AWS"))).alias("m")).first().m
    assert (m.match_score, m.matched_skills, m.missing_skills, m.total_matches) == (66.7, ["python", "aws"], ["git"], 2)


def test_default_job_matching(spark):
    df = spark.createDataFrame([(1, RESUME_A), (2, RESUME_B)], "doc_id long, text string")
    out = JM.match_default_jobs(TM.analyze(df)).orderBy("doc_id", "rank").collect()
    assert [(r.doc_id, r.title, r.match_score) for r in out] == [
        (1, "Senior Software Engineer", 100.0),
        (1, "DevOps Engineer", 100.0),
        (1, "Software Engineer", 70.0),
        (1, "Data Scientist", 60.0),
        (1, "Full Stack Developer", 60.0),
    ]
    se = [r for r in out if r.title == "Software Engineer"][0]
    assert se.matched_skills == ["python", "sql"] and se.missing_skills == ["javascript", "git"]
    assert se.match_reason == "Good skill match, meets experience requirement, meets education requirement"


def test_job_table_pruning_is_exact(spark):
    # many postings share "python" (a hot skill); ties in score are broken by posting order
    jobs = []
    for i in range(60):
        kind = i % 4
        title = ["Backend Developer", "Data Scientist", "Office Manager", "Analyst"][kind]
        text = ["python and sql, 3 years experience", "python, 5+ years required, masters", "excel reports", "docker, minimum 1 year"][kind]
        jobs.append((i, title, f"Company {i % 7}", text, "Remote" if i % 2 else None))
    jdf = spark.createDataFrame(jobs, "job_no int, `Job Title` string, `Company Name` string, description string, Location string")
    docs = spark.createDataFrame([(1, RESUME_A), (2, RESUME_B), (3, "python developer, 2 years in backend")], "doc_id long, text string")
    a = TM.analyze(docs)
    cols = ["doc_id", "job_order", "match_score", "rank", "matched_skills", "missing_skills", "match_reason"]
    pruned = sorted(tuple(map(str, r)) for r in JM.match_job_table(a, jdf, "job_no").select(*cols).collect())
    full = sorted(tuple(map(str, r)) for r in JM.match_job_table(a, jdf, "job_no", prune=False).select(*cols).collect())
    assert pruned == full and len(pruned) > 0


def test_job_table_ranks_before_it_fetches_texts(spark):
    # the texts of a posting join the ranked rows alone: no window or de-duplication of pairs carries them
    jdf = spark.createDataFrame([(i, f"c{i}", f"python {i % 3}, 2 years required " + "x" * 500) for i in range(12)], "job_no int, company string, title string")
    a = TM.analyze(spark.createDataFrame([(1, RESUME_A), (2, RESUME_B)], "doc_id long, text string"))
    out = JM.match_job_table(a, jdf, "job_no")
    assert [(r.doc_id, r.job_order, r.rank, r.title[:6]) for r in out.where("doc_id = 1").orderBy("rank").collect()] == [(1, i, i + 1, "python") for i in range(8)]

    def nodes(p):
        yield p
        it = p.children().iterator()
        while it.hasNext():
            yield from nodes(it.next())

    def columns(p):
        it = p.output().iterator()
        while it.hasNext():
            yield it.next().name()

    pairs = [set(columns(p)) for p in nodes(out._jdf.queryExecution().optimizedPlan()) if p.nodeName() in ("Window", "Aggregate")]
    assert pairs and not any(c & {"title", "company", "salary_range"} for c in pairs)
