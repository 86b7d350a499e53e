"""Job postings: the built-in list and loading a job table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOB_SCHEMA = (
    "job_id int, title string, company string, requirements array<string>, "
    "experience_required int, education_required string, salary_range string"
)

# The built-in job list (title, company, requirements, years, education, salary text).
DEFAULT_JOBS = [
    ("Software Engineer", "Tech Corp", ["Python", "JavaScript", "SQL", "Git"], 2, "Bachelors", "$70,000 - $95,000"),
    ("Senior Software Engineer", "Innovation Labs", ["Python", "React", "Node.js", "AWS", "Leadership"], 5, "Bachelors", "$95,000 - $130,000"),
    ("Data Scientist", "Analytics Inc", ["Python", "Machine Learning", "SQL", "TensorFlow", "Statistics"], 3, "Masters", "$85,000 - $120,000"),
    ("Full Stack Developer", "StartupXYZ", ["JavaScript", "React", "Node.js", "MongoDB", "CSS"], 3, "Bachelors", "$75,000 - $100,000"),
    ("DevOps Engineer", "Cloud Solutions", ["AWS", "Docker", "Kubernetes", "Jenkins", "Python"], 4, "Bachelors", "$90,000 - $125,000"),
    ("Frontend Developer", "Design Studio", ["JavaScript", "React", "CSS", "HTML", "UI/UX"], 2, "Bachelors", "$65,000 - $85,000"),
    ("Product Manager", "Product Co", ["Leadership", "Project Management", "Analytics", "Communication"], 5, "Bachelors", "$100,000 - $140,000"),
    ("Backend Developer", "Server Solutions", ["Python", "Java", "SQL", "REST API", "Database Design"], 3, "Bachelors", "$80,000 - $110,000"),
]


def default_jobs(spark: SparkSession) -> DataFrame:
    """src_default_jobs: the 8 built-in postings (a fixed, 8-row table)."""
    rows = [(i,) + job for i, job in enumerate(DEFAULT_JOBS)]
    return spark.createDataFrame(rows, JOB_SCHEMA)


def default_jobs_column() -> F.Column:
    """The built-in postings as a literal array of structs, for map-side matching."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("job_id"),
                F.lit(t).alias("title"),
                F.lit(c).alias("company"),
                F.array(*[F.lit(r) for r in reqs]).alias("requirements"),
                F.lit(y).alias("experience_required"),
                F.lit(e).alias("education_required"),
                F.lit(s).alias("salary_range"),
            )
            for i, (t, c, reqs, y, e, s) in enumerate(DEFAULT_JOBS)
        ]
    )


def load_job_table(spark: SparkSession, path: str, fmt: str = "csv", heading: str = "Job Title") -> DataFrame:
    """src_job_table: read postings; if the second cell of a file's first row is the
    title heading, that row holds the real column names.

    Of each file exactly the first row, found by the file name and the row's
    place in the read order, is taken out, and only if it is a heading; other
    rows that hold the same word stay.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if len(df.columns) < 2:
        return df
    second = df.columns[1]
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    first = tagged.groupBy("__file").agg(F.min_by(F.struct(*df.columns, "__row"), F.struct("__block", "__row")).alias("r"))
    heads = first.where(F.col("r")[second] == heading).select("__file", "r").orderBy("__file").collect()  # a row for each file with a heading
    if heads:
        names = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(heads[0]["r"][:-1])]
        rows = [h["r"]["__row"] for h in heads]
        return tagged.where(~F.col("__row").isin(rows)).select(*df.columns).toDF(*names)
    return df
