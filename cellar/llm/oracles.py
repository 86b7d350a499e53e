"""DuckDB SQL for the corpus queries that SQL can express.

Not here: toxicity (FTRL), the suffix tree, compression language ID, token
counts (a tokenizer) and substring dedup (content-defined cuts of long
sentences); their tests compare them with brute force or held-out accuracy.
"""

from __future__ import annotations

from cellar.llm.license_scan import RULES, SENTENCES

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k FROM documents
), s AS (SELECT k, sum(size)::BIGINT AS size FROM d GROUP BY k),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), p AS (
  SELECT *, (sum(size) OVER ())::DOUBLE AS total,
         coalesce(sum(size * 3) OVER (ORDER BY size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM w
), l AS (SELECT *, (total - capped) / open AS level FROM p),
water AS (SELECT level FROM l WHERE level * weight <= size * 3 ORDER BY size / weight, k LIMIT 1),
t AS (
  SELECT k, size AS source_size, least(water.level * weight, (size * 3)::DOUBLE) AS target,
         ('0x' || substr(md5('mix-1' || k), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS off
  FROM l, water
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY k ORDER BY size DESC, md5(coalesce(doc_id::VARCHAR, '')), doc_id) AS i FROM d
)
SELECT doc_id, size, source_size, target,
       size * least(3, (floor(i * x + off) - floor((i - 1) * x + off))::BIGINT) AS taken
FROM (SELECT r.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS x FROM r JOIN t USING (k))
"""

OP2 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({AZ.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), c AS (
  SELECT w, min(doc_id) AS copy_id, count(*) AS n_copies FROM t WHERE len(w) > 0 GROUP BY w
), s AS (
  SELECT DISTINCT copy_id, g FROM (
    SELECT copy_id, unnest(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(len(w) - 4), lambda i: w[i + 1 : i + 5]) END) AS g FROM c)
), n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.copy_id AS a, b.copy_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.copy_id <> b.copy_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.copy_id = a JOIN n y ON y.copy_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), reach AS (
  SELECT copy_id AS node, copy_id AS other FROM c
  UNION
  SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other
), cls AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node),
l AS (SELECT a AS node, count(*) AS n_links FROM e GROUP BY 1)
SELECT t.doc_id, coalesce(c.copy_id, t.doc_id) AS copy_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links,
       coalesce(class_id, t.doc_id) AS class_id
FROM t LEFT JOIN c ON c.w = t.w LEFT JOIN cls ON cls.node = c.copy_id LEFT JOIN l ON l.node = c.copy_id
"""


def _op8() -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    line = "'|' || ids || '|'"
    hit = [f"contains({line}, '|{'|'.join(seq)}|')" for _, seq in RULES]
    name = "CASE " + " ".join(f"WHEN {h} THEN '{lic}'" for h, (lic, _) in zip(hit, RULES)) + " END"
    number = "CASE " + " ".join(f"WHEN {h} THEN {i}" for i, h in enumerate(hit, 1)) + " END"
    # no look-ahead here: the white space after a stop is replaced by the sign too
    low = AZ.format(r"regexp_replace(coalesce(text, ''), '[.!?]([ \t\r\f\x0B\n]|$)|\n', chr(1), 'g')")
    return rf"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace({low}, '[^a-z0-9\x01\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'), chr(1)), lambda s: trim(s)),
    lambda s: map_contains({known}, s)) AS found FROM documents
), i AS (SELECT doc_id, list_transform(found, lambda s: {known}[s]) AS found FROM p),
j AS (SELECT doc_id, coalesce(array_to_string(found, '|'), '') AS ids, len(found) AS n FROM i)
SELECT doc_id, ids AS sentence_ids, n::INTEGER AS n_sentences, {name} AS license, {number}::INTEGER AS rule FROM j
"""


OP9 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({AZ.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({AZ.format("coalesce(text, '')")}, '{WORD}') AS w FROM benchmark
), x AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(len(w) - 9), lambda i: w[i + 1 : i + 10]) END) AS g
  FROM b WHERE len(w) > 0
), l AS (SELECT DISTINCT n FROM x),
y AS (
  SELECT r, n, unnest(range(len(w) - n + 1)) AS i, w FROM d, l WHERE len(w) >= n
), h AS (
  SELECT r, i, x.n, item FROM (SELECT r, n, i, w[i + 1 : i + n] AS g FROM y) z JOIN x ON x.n = z.n AND x.g = z.g
), n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
m AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

#: the rules, cutoffs and error levels of op11, written out anew: (rule, value, above, cutoffs from mild to strict)
OP11_RULES = [
    ("symbols", "n_symbols / n_words", ">", "2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05"),
    ("duplicate_lines", "n_dup_lines / n_lines", ">", "0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1"),
    ("repeats", "n_repeat_words / n_words", ">", "0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1"),
    ("capitals", "n_caps / word_chars", ">", "0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2"),
    ("long_words", "word_chars / n_words", ">", "40.0, 30.0, 25.0, 20.0, 15.0, 12.0, 10.0, 9.0"),
    ("short_words", "word_chars / n_words", "<", "1.5, 2.0, 2.5, 3.0, 3.5, 4.0"),
]


def _op11() -> str:
    rules = " UNION ALL ".join(f"SELECT '{n}' AS rule, '{op}' AS op, [{c}]::DOUBLE[] AS cuts" for n, _, op, c in OP11_RULES)
    values = ", ".join(f"{{'rule': '{n}', 'v': CASE WHEN {v.split(' / ')[1]} > 0 THEN ({v.split(' / ')[0]})::DOUBLE / {v.split(' / ')[1]} END}}" for n, v, _, _ in OP11_RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS times
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)
), r AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times >= 2) GROUP BY rid
), m AS (
  SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_caps
  FROM s LEFT JOIN r USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
rules AS ({rules}),
v AS (SELECT rid, doc_id, stratum, base_failed, x.rule AS rule, x.v AS v FROM (SELECT *, unnest([{values}]) AS x FROM b)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
once AS (
  SELECT v.doc_id, stratum, rule, CASE WHEN any_value(op) = '>' THEN max(v) ELSE min(v) END AS v
  FROM v JOIN rules USING (rule) WHERE NOT base_failed AND v.doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), pairs AS (SELECT stratum, rule, count(*) AS n FROM once GROUP BY ALL),
steps AS (
  SELECT p.stratum, p.rule, p.n, r.op, unnest(r.cuts) AS cut, generate_subscripts(r.cuts, 1) AS k FROM pairs p JOIN rules r USING (rule)
), x AS (
  SELECT s.stratum, s.rule, s.n, s.k, s.cut, count(CASE WHEN op = '>' THEN o.v > cut ELSE o.v < cut END OR NULL) AS x
  FROM steps s JOIN once o ON o.rule = s.rule AND o.stratum IS NOT DISTINCT FROM s.stratum GROUP BY ALL
), safe AS (
  SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END
           - CASE WHEN i < n THEN lgamma(n - i + 1) ELSE 0 END + i * ln(0.05 / 6) + (n - i) * ln(1 - 0.05 / 6)))) <= 0.05 / (SELECT count(*) FROM pairs) AS ok FROM x
), chosen AS (
  SELECT stratum, rule, max_by(cut, k) AS cut FROM (
    SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY k) AS go FROM safe) WHERE go GROUP BY ALL
), hit AS (
  SELECT v.rid, list(v.rule ORDER BY list_position([{", ".join(f"'{n}'" for n, *_ in OP11_RULES)}], v.rule)) AS rejected_by
  FROM v JOIN rules USING (rule) JOIN chosen c ON c.rule = v.rule AND c.stratum IS NOT DISTINCT FROM v.stratum
  WHERE CASE WHEN op = '>' THEN v.v > cut ELSE v.v < cut END GROUP BY v.rid
)
SELECT b.* EXCLUDE (rid), coalesce(rejected_by, []) AS rejected_by, NOT base_failed AND rejected_by IS NULL AS kept FROM b LEFT JOIN hit USING (rid)
"""


#: one bit of the crc32 (reflected, polynomial EDB88320), eight times for a byte
_CRC_BYTE = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"

OP13 = rf"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({AZ.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents
), dr AS (SELECT doc, run, count(*) AS times, hex(encode(doc || ':' || run)) AS hx FROM r WHERE len(run) >= 5 GROUP BY doc, run),
h AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(hx) // 2),
           lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT)), {_CRC_BYTE}), 4294967295::BIGINT) AS h FROM dr
), v AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word FROM h)
  WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
p AS (
  SELECT DISTINCT a, b FROM (
    SELECT x.word AS a, v.word AS b FROM x JOIN v ON x.less = v.word
    UNION ALL SELECT v.word, x.word FROM x JOIN v ON x.less = v.word
    UNION ALL SELECT x.word, y.word FROM x JOIN x y ON x.less = y.less AND x.i = y.i AND x.word <> y.word)
), f AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, first(b ORDER BY w.n DESC, b) AS near, max(w.n) AS near_n FROM p JOIN v w ON w.word = b GROUP BY a
), g AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM v LEFT JOIN f USING (word)
), walk AS (
  SELECT word, word AS at FROM g
  UNION ALL
  SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.at WHERE g.form IS NOT NULL
)
SELECT g.word, g.form, walk.at AS root, g.n, g.n_near, g.form_n
FROM g JOIN walk USING (word) JOIN g e ON e.word = walk.at WHERE e.form IS NULL
"""

ORACLES = {"op1_mix_sources": OP1, "op2_jaccard_join": OP2, "op8_license_scan": _op8(), "op9_pivot_topk": OP9, "op10_decontaminate": OP10, "op11_quality_rules": _op11(), "op13_spelling_variants": OP13}
