"""Query bindings: document mining over documents, pages and conversations.

The DuckDB oracles are generated from the same vocabulary constants; RE2 has
no look-around, so a boundary is written ``(^|[^\\p{L}\\p{N}_])`` ... ``($|...)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import textmine as TM
from cellar.operators import vocabulary as V
from cellar.plans.registry import register
from cellar.session import table

NW = r"[^\p{L}\p{N}_]"


def sql_has(text_sql: str, term: str) -> str:
    return f"regexp_matches({text_sql}, '(^|{NW})\\Q{term}\\E($|{NW})')"


def sql_terms(text_sql: str, terms) -> str:
    parts = ", ".join(f"CASE WHEN {sql_has(text_sql, t)} THEN '{t}' END" for t in terms)
    return f"concat_ws(',', {parts})"


def sql_degrees(text_sql: str) -> str:
    parts = ", ".join(
        f"CASE WHEN {sql_has(text_sql, kw)} THEN '{lvl}' END" for lvl, kws in TM.EDUCATION_LEVELS.items() for kw in kws
    )
    return f"concat_ws(',', {parts})"


def sql_highest(degrees_sql: str) -> str:
    whens = " ".join(f"WHEN list_contains(string_split({degrees_sql}, ','), '{lvl}') THEN '{lvl}'" for lvl in TM.EDUCATION_LEVELS)
    return f"CASE {whens} ELSE 'Unknown' END"


SQL_TITLE = r"""array_to_string(list_transform(regexp_extract_all({x}, '(\p{{L}}+|\P{{L}}+)', 1),
    lambda w: CASE WHEN regexp_matches(w, '^\p{{L}}') THEN upper(w[1]) || lower(w[2:]) ELSE w END), '')"""


def sql_title(x: str) -> str:
    return SQL_TITLE.format(x=x)


def sql_institutions(low: str) -> str:
    w = r"[\p{L}\p{N}_]"
    lists = ", ".join(f"regexp_extract_all({low}, '({p.format(w=w)})', 1)" for p in TM.INSTITUTION_PATTERNS)
    return f"array_to_string(list_sort(list_distinct(list_transform(flatten([{lists}]), lambda m: {sql_title('m')}))), '|')"


def sql_experience(text: str) -> str:
    lists = ", ".join(f"regexp_extract_all({text}, '(?i){p}', 1)" for p in TM.EXPERIENCE_PATTERNS)
    stated = f"list_max(list_transform(flatten([{lists}]), lambda s: TRY_CAST(s AS BIGINT)))"
    periods = " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in TM.JOB_PERIOD_PATTERNS)
    return f"CAST(coalesce({stated}, CASE WHEN ({periods}) > 0 THEN least(({periods}) * 2, 15) ELSE 0 END) AS BIGINT)"


class _Email:
    @staticmethod
    def format(t: str) -> str:
        pat = f"(^|{NW})([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}})($|{NW})"
        return f"nullif(regexp_extract({t}, '{pat}', 2), '')"


SQL_EMAIL = _Email
SQL_PHONE = r"nullif(regexp_extract({t}, '[\+]?[1-9]?[\-\.\s]?\(?[0-9]{{3}}\)?[\-\.\s]?[0-9]{{3}}[\-\.\s]?[0-9]{{4}}', 0), '')"
SQL_LINKEDIN = r"nullif(regexp_extract({t}, '(?i)linkedin\.com/in/[\p{{L}}\p{{N}}_\-]+', 0), '')"
SQL_GITHUB = r"nullif(regexp_extract({t}, '(?i)github\.com/[\p{{L}}\p{{N}}_\-]+', 0), '')"


def sql_certs(low: str) -> str:
    w = r"\p{L}\p{N}_"
    pats = [p.format(w=w) for p in TM.CERT_PATTERNS]
    lists = ", ".join(
        f"CASE WHEN contains({low}, '{'certified' if i < 2 else 'certification'}') THEN regexp_extract_all({low}, '({p})', 1) ELSE [] END"
        for i, p in enumerate(pats)
    )
    stripped = r"regexp_replace(m, '^\s+|\s+$', '', 'g')"
    titled = f"list_distinct(list_transform(flatten([{lists}]), lambda m: {sql_title(stripped)}))"
    kept = f"list_filter({titled}, lambda c: len(regexp_split_to_array(c, '\\s+')) <= {TM.CERT_MAX_WORDS} AND length(c) > {TM.CERT_MIN_CHARS})"
    return f"array_to_string(list_sort({kept}), '|')"


def _resume_lines() -> list[str]:
    """Résumé lines that hold, between them, every term and form the extractors look for."""
    tech = [t for terms in TM.TECHNICAL_SKILLS.values() for t in terms]
    degrees = [k for kws in TM.EDUCATION_LEVELS.values() for k in kws]
    titles = [" ".join((*any_of[:1], *(all_of or ()))) for any_of, all_of, _ in TM.TITLE_RULES]
    tails = [
        "certified scrum master. University of Springfield. over 7 years of experience. linkedin.com/in/jane-doe",
        "certification in cloud security. MIT college. 12+ years experience in data. github.com/jdoe",
        "jan 2015 - mar 2018, 2019 - present. Springfield institute of technology. jane.doe@example.org",
        "project management certification. call (555) 123-4567. minimum 3 years, bachelor degree required",
        "five certified things in a row and more words than allowed certified. phd preferred, 10 years required",
        "years of experience: 4. Lake school of design. master degree, at least 6 years",
    ]
    n = max(len(tech), len(degrees), len(titles), len(TM.SOFT_SKILLS))
    at = lambda xs, i: xs[i % len(xs)]
    return [f"{at(titles, i)}: {at(tech, i)}, {at(tech, i * 7 + 3)} and {at(TM.SOFT_SKILLS, i)}. {at(degrees, i)}. {at(tails, i)}" for i in range(n)]


def _with_resume(text: str = "text", key: str = "doc_id") -> str:
    """Each text with the résumé line of its key (every eleventh has none): the same expression for both engines."""
    lines = _resume_lines()
    whens = " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(lines))
    return f"{text} || CASE WHEN {key} % 11 = 0 THEN '' ELSE ' ' || CASE {key} % {len(lines)} {whens} END END"


_DOCS_SQL = f"(SELECT doc_id, {_with_resume()} AS text FROM documents)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_with_resume()).alias("text"))


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.expr(_with_resume("html", "page_id")).alias("text"))


_PAGES_SQL = f"(SELECT page_id AS doc_id, {_with_resume('html', 'page_id')} AS text FROM pages)"


def _tech_cols(analysis):
    return [F.array_join(F.col("technical_skills")[c], ",").alias(c) for c in TM.TECHNICAL_SKILLS]


def _tech_sql(src: str) -> str:
    cols = ", ".join(f"{sql_terms('lower(text)', skills)} AS {c}" for c, skills in TM.TECHNICAL_SKILLS.items())
    return f"SELECT doc_id, {cols} FROM {src}"


@register("txt_tech_skills", _tech_sql(_DOCS_SQL))
def q_tech(spark, d):
    a = TM.analyze(_docs(spark, d))
    return a.select("doc_id", *_tech_cols(a))


@register("txt_tech_skills_pages", _tech_sql(_PAGES_SQL))
def q_tech_pages(spark, d):
    a = TM.analyze(_pages(spark, d))
    return a.select("doc_id", *_tech_cols(a))


@register("txt_soft_skills", f"SELECT doc_id, {sql_terms('lower(text)', TM.SOFT_SKILLS)} AS soft_skills FROM {_DOCS_SQL}")
def q_soft(spark, d):
    return TM.analyze(_docs(spark, d)).select("doc_id", F.array_join("soft_skills", ",").alias("soft_skills"))


@register(
    "txt_education",
    f"SELECT doc_id, {sql_degrees('lower(text)')} AS degrees, {sql_highest(sql_degrees('lower(text)'))} AS education_level FROM {_DOCS_SQL}",
)
def q_edu(spark, d):
    a = TM.analyze(_docs(spark, d))
    return a.select("doc_id", F.array_join("degrees", ",").alias("degrees"), "education_level")


@register("txt_institutions", f"SELECT doc_id, {sql_institutions('lower(text)')} AS institutions FROM {_DOCS_SQL}")
def q_inst(spark, d):
    return TM.analyze(_docs(spark, d)).select("doc_id", F.array_join("institutions", "|").alias("institutions"))


@register("txt_experience_years", f"SELECT doc_id, {sql_experience('text')} AS experience_years FROM {_DOCS_SQL}")
def q_exp(spark, d):
    return TM.analyze(_docs(spark, d)).select("doc_id", "experience_years")


@register(
    "txt_experience_years_conversations",
    f"SELECT conv_id, turn, {sql_experience('text')} AS experience_years FROM conversations",
)
def q_exp_conv(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", TM.experience_years(F.col("text")).alias("experience_years"))


@register(
    "txt_contact",
    f"""SELECT doc_id, {SQL_EMAIL.format(t='text')} AS email, {SQL_PHONE.format(t='text')} AS phone,
        {SQL_LINKEDIN.format(t='text')} AS linkedin, {SQL_GITHUB.format(t='text')} AS github FROM {_DOCS_SQL}""",
)
def q_contact(spark, d):
    return TM.analyze(_docs(spark, d)).select("doc_id", "contact.*")


@register("txt_certifications", f"SELECT doc_id, {sql_certs('lower(text)')} AS certifications FROM {_DOCS_SQL}")
def q_certs(spark, d):
    return TM.analyze(_docs(spark, d)).select("doc_id", F.array_join("certifications", "|").alias("certifications"))


def _analyze_sql(src: str) -> str:
    tech_counts = " + ".join(
        f"len(list_filter(string_split({sql_terms('lower(text)', s)}, ','), lambda x: x <> ''))" for s in TM.TECHNICAL_SKILLS.values()
    )
    diversity = " + ".join(
        f"CASE WHEN {sql_terms('lower(text)', s)} <> '' THEN 1 ELSE 0 END" for s in TM.TECHNICAL_SKILLS.values()
    )
    soft = f"len(list_filter(string_split({sql_terms('lower(text)', TM.SOFT_SKILLS)}, ','), lambda x: x <> ''))"
    all_sk = " || ',' || ".join([sql_terms("lower(text)", s) for s in TM.TECHNICAL_SKILLS.values()] + [sql_terms("lower(text)", TM.SOFT_SKILLS)])
    return f"""SELECT doc_id, CAST({tech_counts} AS INTEGER) AS total_technical_skills, CAST({soft} AS INTEGER) AS total_soft_skills,
               {sql_highest(sql_degrees('lower(text)'))} AS education_level, {sql_experience('text')} AS experience_years,
               CAST({diversity} AS INTEGER) AS skills_diversity, {SQL_EMAIL.format(t='text')} AS email,
               {SQL_PHONE.format(t='text')} AS phone, {SQL_LINKEDIN.format(t='text')} AS linkedin, {SQL_GITHUB.format(t='text')} AS github,
               {sql_degrees('lower(text)')} AS degrees, {sql_institutions('lower(text)')} AS institutions, {sql_certs('lower(text)')} AS certifications,
               {sql_terms('lower(text)', TM.SOFT_SKILLS)} AS soft_skills,
               array_to_string(list_filter(string_split({all_sk}, ','), lambda x: x <> ''), ',') AS all_skills FROM {src}"""


def _analyze_cols(a):
    return a.select(
        "doc_id",
        "total_technical_skills",
        "total_soft_skills",
        "education_level",
        "experience_years",
        "skills_diversity",
        *[F.col(f"contact.{c}").alias(c) for c in ("email", "phone", "linkedin", "github")],
        F.array_join("degrees", ",").alias("degrees"),
        F.array_join("institutions", "|").alias("institutions"),
        F.array_join("certifications", "|").alias("certifications"),
        F.array_join("soft_skills", ",").alias("soft_skills"),
        F.array_join("all_skills", ",").alias("all_skills"),
    )


@register("txt_analyze", _analyze_sql(_DOCS_SQL))
def q_analyze(spark, d):
    return _analyze_cols(TM.analyze(_docs(spark, d)))


@register("txt_analyze_pages", _analyze_sql(_PAGES_SQL))
def q_analyze_pages(spark, d):
    return _analyze_cols(TM.analyze(_pages(spark, d)))


def _skill_rows_sql(src: str) -> str:
    parts = []
    for cat, skills in TM.TECHNICAL_SKILLS.items():
        for s in skills:
            parts.append(
                f"SELECT doc_id, '{s}' AS skill, '{TM.CATEGORY_LABELS[cat]}' AS category, 'Technical' AS type, 1 AS count, {sql_title(repr(s))} AS label FROM {src} WHERE {sql_has('lower(text)', s)}"
            )
    for s in TM.SOFT_SKILLS:
        parts.append(
            f"SELECT doc_id, '{s}', 'Soft Skills', 'Soft', 1, {sql_title(repr(s))} FROM {src} WHERE {sql_has('lower(text)', s)}"
        )
    return "\nUNION ALL\n".join(parts)


@register("txt_skill_rows", _skill_rows_sql(_PAGES_SQL))
def q_skill_rows(spark, d):
    return TM.skill_rows(TM.analyze(_pages(spark, d)))


@register(
    "txt_skill_totals",
    f"SELECT category, skill, count(DISTINCT doc_id) AS n_docs FROM ({_skill_rows_sql(_PAGES_SQL)}) GROUP BY 1, 2",
)
def q_skill_totals(spark, d):
    return TM.skill_totals(TM.skill_rows(TM.analyze(_pages(spark, d))))


_REQS = ["HTML", "Python", "SQL", "r", "Teamwork"]


def _match_sql(src: str) -> str:
    all_sk = " || ',' || ".join(
        [sql_terms("lower(text)", s) for s in TM.TECHNICAL_SKILLS.values()] + [sql_terms("lower(text)", TM.SOFT_SKILLS)]
    )
    reqs = "[" + ", ".join(f"'{r.lower()}'" for r in _REQS) + "]"
    sk = f"string_split({all_sk}, ',')"
    matched = f"list_filter({reqs}, lambda r: list_contains({sk}, r))"
    return f"""SELECT doc_id, round(len({matched}) * 100.0 / {len(_REQS)}, 1) AS match_score,
               array_to_string({matched}, ',') AS matched_skills,
               array_to_string(list_filter({reqs}, lambda r: NOT list_contains({sk}, r)), ',') AS missing_skills,
               {len(_REQS)} AS total_requirements, CAST(len({matched}) AS INTEGER) AS total_matches FROM {src}"""


def _match_spark(a):
    m = TM.skill_match(F.col("all_skills"), F.array(*[F.lit(r) for r in _REQS]))
    return a.select(
        "doc_id",
        m["match_score"].alias("match_score"),
        F.array_join(m["matched_skills"], ",").alias("matched_skills"),
        F.array_join(m["missing_skills"], ",").alias("missing_skills"),
        m["total_requirements"].alias("total_requirements"),
        m["total_matches"].alias("total_matches"),
    )


@register("txt_skill_match", _match_sql(_PAGES_SQL))
def q_skill_match(spark, d):
    return _match_spark(TM.analyze(_pages(spark, d)))


def _title_sql(t: str) -> str:
    parts = []
    for any_of, all_of, skills in TM.TITLE_RULES:
        cond = " OR ".join(f"contains(lower({t}), '{w}')" for w in any_of)
        if all_of:
            cond = f"({cond}) AND " + " AND ".join(f"contains(lower({t}), '{w}')" for w in all_of)
        arr = "[" + ", ".join(f"'{s}'" for s in skills) + "]"
        parts.append(f"CASE WHEN {cond} THEN {arr} ELSE [] END")
    return f"flatten([{', '.join(parts)}])"


def _job_exp_sql(t: str) -> str:
    vals = ", ".join(f"TRY_CAST(nullif(regexp_extract(lower({t}), '{p}', 1), '') AS BIGINT)" for p in TM.JOB_EXPERIENCE_PATTERNS)
    return f"coalesce({vals}, {TM.DEFAULT_JOB_EXPERIENCE})"


def _job_edu_sql(t: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({t}), '{w}')" for w in words) + f" THEN '{lvl}'" for lvl, words in TM.JOB_EDUCATION_RULES
    )
    return f"CASE {whens} ELSE '{TM.DEFAULT_JOB_EDUCATION}' END"


@register(
    "txt_title_skills",
    f"SELECT doc_id, array_to_string({_title_sql('text')}, ',') AS title_skills FROM {_DOCS_SQL}",
)
def q_title_skills(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(TM.title_skills(F.col("text")), ",").alias("title_skills"))


@register(
    "txt_job_experience",
    f"SELECT doc_id, {_job_exp_sql('text')} AS experience_required FROM {_DOCS_SQL}",
)
def q_job_exp(spark, d):
    return _docs(spark, d).select("doc_id", TM.job_experience(F.col("text")).alias("experience_required"))


@register(
    "txt_job_education",
    f"SELECT doc_id, {_job_edu_sql('text')} AS education_required FROM {_DOCS_SQL}",
)
def q_job_edu(spark, d):
    return _docs(spark, d).select("doc_id", TM.job_education(F.col("text")).alias("education_required"))


# every pair of neighbouring words of the benchmark items, some thousand terms, sought in whole documents
_TERMS_SQL = f"""SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM (
        SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT list_filter(regexp_split_to_array(lower(text), '{NW}+'), lambda x: x <> '') AS w FROM benchmark))"""
# a pair occurs as whole words where exactly one blank parts two neighbouring words
_FOUND_SQL = f"""SELECT DISTINCT doc_id, term FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS term FROM (
          SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (
            SELECT doc_id, string_split(unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_ ]+| {{2,}}')), ' ') AS w FROM documents)))
        JOIN ({_TERMS_SQL}) USING (term)"""


def _terms(spark, d):
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return V.read_terms(table(spark, d, "benchmark").select(F.explode(pairs).alias("term")), "term")


@register("txt_vocabulary_rows", _FOUND_SQL)
def q_vocabulary_rows(spark, d):
    return V.vocabulary_rows(table(spark, d, "documents"), "doc_id", "text", _terms(spark, d))


@register("txt_vocabulary_totals", f"SELECT term, count(*) AS n_texts FROM ({_FOUND_SQL}) GROUP BY term")
def q_vocabulary_totals(spark, d):
    return V.vocabulary_totals(table(spark, d, "documents"), "text", _terms(spark, d))
