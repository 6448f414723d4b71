"""Text and parsing queries: sources, tokens, forms, gates, model output, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, text
from .base import query, rows, sql_list, sql_values, table

STOP = sql_list(text.STOP_WORDS)
ARABIC = "[\\x{0600}-\\x{06FF}]"
AR_ROWS = [(1, "الشمس"), (2, "شَمْس"), (3, "والشمس"), (4, "أُمّي"), (5, "كتابـــ "), (6, "بيت"), (7, "إلى"), (8, "Sun"), (9, "لليل"), (10, "كالماء"), (11, "ال")]
TERM_ROWS = [(1, " \"شمس\" "), (2, ""), (3, "شمس\nقمر"), (4, "شمس، قمر"), (5, "Sun"), (6, "شمس 1"), (7, "شمس كبيرة"), (8, "شمس or قمر"), (9, "شمس" * 25)]
LETTERS = [("ا", "alif"), ("ب", "ba"), ("ت", "ta"), ("س", "sin"), ("ش", "shin"), ("م", "mim"), ("ل", "lam"), ("ك", "kaf"), ("ي", "ya"), ("و", "waw"), ("ه", "ha")]
NORM_SQL = "lower(trim(translate(regexp_replace(t, '[\\x{0617}-\\x{061A}\\x{064B}-\\x{0652}\\x{0670}\\x{06D6}-\\x{06ED}\\x{0640}]', '', 'g'), 'أإآ', 'ااا')))"


@query("SELECT doc_id, CASE WHEN a = 0 AND l = 0 THEN 'unknown' WHEN a > l THEN 'ar' ELSE 'en' END AS detected FROM (SELECT doc_id, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]+', '', 'g')) a, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) l FROM documents)")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("detected"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS source_id FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_id(F.col("text")).alias("source_id"))


@query("""SELECT 'doc/' || doc_id || '.md' AS source_path, 'sha256:' || sha256(text) AS source_id,
CASE WHEN requested = 'auto' THEN CASE WHEN length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) = 0 THEN 'unknown' ELSE 'en' END ELSE requested END AS source_language,
CASE WHEN requested = 'auto' THEN 'auto-detected' ELSE 'user-declared' END AS source_language_mode
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'auto' ELSE lang END AS requested FROM documents)""")
def source_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("requested", F.when(F.col("doc_id") % 2 == 0, "auto").otherwise(F.col("lang")))
    c = F.col("text")
    return d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), text.content_id(c).alias("source_id"),
        F.when(F.col("requested") == "auto", text.detect_language(c)).otherwise(F.col("requested")).alias("source_language"), text.language_mode(F.col("requested")).alias("source_language_mode"),
    )


@query(f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x NOT IN ({STOP})) t FROM documents)")
def tokenize_en(spark, sf_dir):
    t = text.tokens_en(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: x NOT IN ({STOP}))) token FROM documents) GROUP BY token")
def token_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens_en(F.col("text"))).alias("token"))
    per = d.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS n_words FROM documents")
def unicode_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.unicode_words(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-')), ''), 'unnamed') AS slug FROM pages")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(split_part(url, '/', -1), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'source') AS file_name FROM pages")
def filename_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("file_name"))


_FORMS_SQL = """WITH t AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) w FROM documents) WHERE w IS NOT NULL),
f AS (
SELECT w, 'SAFE' tier, 0 prio, CASE WHEN ends_with(w, 'ies') AND length(w) > 4 THEN left(w, -3) || 'y' END form FROM t UNION ALL
SELECT w, 'SAFE', 1, CASE WHEN ends_with(w, 'es') AND length(w) > 3 THEN left(w, -2) END FROM t UNION ALL
SELECT w, 'SAFE', 2, CASE WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN left(w, -1) END FROM t UNION ALL
SELECT w, 'RISKY', 0, CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, -3) END FROM t UNION ALL
SELECT w, 'RISKY', 1, CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN left(w, -3) || 'e' END FROM t UNION ALL
SELECT w, 'RISKY', 2, CASE WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, -2) END FROM t UNION ALL
SELECT w, 'RISKY', 3, CASE WHEN ends_with(w, 'ed') AND length(w) > 4 THEN left(w, -1) END FROM t)
SELECT w AS token, tier, prio, form FROM f WHERE form IS NOT NULL"""


@query(_FORMS_SQL)
def suffix_forms(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.explode(text.plain_words(F.col("text"))).alias("token")).distinct()
    tiers = F.array(F.struct(F.lit("SAFE").alias("tier"), text.safe_forms(F.col("token")).alias("f")), F.struct(F.lit("RISKY").alias("tier"), text.risky_forms(F.col("token")).alias("f")))
    return t.select("token", F.explode(tiers).alias("x")).select("token", "x.tier", F.posexplode("x.f").alias("prio", "form")).where("form is not null")


@query(f"SELECT n_nationkey, id, {NORM_SQL} AS normalized, len(regexp_extract_all({NORM_SQL}, '{ARABIC}+')) AS n_tokens FROM ({sql_values(AR_ROWS)}) v(id, t) CROSS JOIN nation")
def ar_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(rows(spark, "id int, t string", AR_ROWS)))
    return d.select("n_nationkey", "id", text.normalize_ar(F.col("t")).alias("normalized"), F.size(text.tokens_ar(F.col("t"))).cast("long").alias("n_tokens"))


@query(f"""WITH v AS (SELECT id, {NORM_SQL} w FROM ({sql_values(AR_ROWS)}) v(id, t)), p AS (SELECT * FROM ({sql_values([(i, c) for i, c in enumerate(text.CLITICS)])}) p(o, c)),
f AS (SELECT id, o, substr(w, length(c) + 1) form FROM v, p WHERE starts_with(w, c) AND length(w) - length(c) >= 2)
SELECT n_nationkey, id, CAST(row_number() OVER (PARTITION BY n_nationkey, id ORDER BY o) - 1 AS INT) AS pos, form FROM f CROSS JOIN nation""")
def clitic_strip(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(rows(spark, "id int, t string", AR_ROWS)))
    return d.select("n_nationkey", "id", F.posexplode(text.clitic_forms(text.normalize_ar(F.col("t")))).alias("pos", "form"))


@query(f"""WITH v AS (SELECT id, translate(regexp_replace(t, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}} \\x{{200E}}\\x{{200F}}]', '', 'g'), 'أإآ', 'ااا') w FROM ({sql_values(AR_ROWS)}) v(id, t)),
l AS (SELECT id, unnest(range(1, length(w) + 1)) pos, w FROM v), m AS (SELECT * FROM ({sql_values(LETTERS)}) m(letter, name))
SELECT l.id, CAST(pos - 1 AS INT) AS pos, substr(w, pos, 1) AS letter, m.name AS letter_name, m.name IS NOT NULL AS resolved FROM l LEFT JOIN m ON m.letter = substr(w, pos, 1)""")
def fingerspell(spark, sf_dir):
    d = rows(spark, "id int, t string", AR_ROWS).select("id", F.posexplode(text.letters(F.col("t"))).alias("pos", "letter"))
    m = F.broadcast(rows(spark, "letter string, letter_name string", LETTERS))
    return d.join(m, "letter", "left").select("id", "pos", "letter", "letter_name", F.col("letter_name").isNotNull().alias("resolved"))


@query(f"""WITH v AS (SELECT id, trim(trim(trim(t), '"')) s FROM ({sql_values(TERM_ROWS)}) v(id, t) UNION ALL SELECT 100 + p_partkey, p_name FROM part)
SELECT id, CASE WHEN s = '' THEN 'empty' WHEN contains(s, chr(10)) OR length(s) > 60 THEN 'commentary' WHEN contains(s, 'or') OR contains(s, 'أو') OR contains(s, '/') OR contains(s, '،') OR contains(s, ',') OR contains(s, ';') OR contains(s, '(') OR contains(s, ')') THEN 'alternatives'
WHEN NOT regexp_matches(s, '{ARABIC}') THEN 'no Arabic script' WHEN NOT regexp_matches(s, '^[\\x{{0600}}-\\x{{06FF}}\\s]+$') THEN 'other characters' ELSE 'single clean term' END AS reason,
NOT contains(s, chr(10)) AND length(s) <= 40 AND NOT regexp_matches(s, '{ARABIC}') AND regexp_matches(s, '^[A-Za-z\\s\\-]+$') AS gloss_ok FROM v""")
def term_gate(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("id"), F.col("p_name").alias("t"))
    d = rows(spark, "id long, t string", TERM_ROWS).unionByName(parts)
    return d.select("id", text.term_gate(F.col("t"))["reason"].alias("reason"), text.gloss_gate(text.strip(F.btrim(text.strip(F.col("t")), F.lit('"')))).alias("gloss_ok"))


_RAW_SQL = """CASE event_id % 5 WHEN 0 THEN '[' || props || ']' WHEN 1 THEN 'noise [' || props || ', ' || props || '] tail' WHEN 2 THEN 'bad [' || props WHEN 3 THEN '<think>a [1]</think>[' || props || ']' ELSE props END"""


def _raw(c="props"):
    p = F.col(c)
    k = F.col("event_id") % 5
    return (
        F.when(k == 0, F.concat(F.lit("["), p, F.lit("]"))).when(k == 1, F.concat(F.lit("noise ["), p, F.lit(", "), p, F.lit("] tail")))
        .when(k == 2, F.concat(F.lit("bad ["), p)).when(k == 3, F.concat(F.lit("<think>a [1]</think>["), p, F.lit("]"))).otherwise(p)
    )


@query(f"""WITH r AS (SELECT event_id, trim(regexp_replace({_RAW_SQL}, '(?s)<think>.*?</think>', '', 'g')) raw FROM events WHERE props IS NOT NULL), s AS (SELECT *, regexp_extract(raw, '(?s)\\[.*\\]') inn FROM r),
k AS (SELECT *, json_valid(raw) AND starts_with(raw, '[') a, json_valid(inn) AND inn <> '' b FROM s)
SELECT event_id, CASE WHEN a THEN json_array_length(raw) WHEN b THEN json_array_length(inn) END::INT AS n_items, CASE WHEN a THEN false WHEN b THEN true END AS extraction_used FROM k""")
def json_parse_bounded(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("props is not null").select("event_id", parsing.bounded_array(_raw()).alias("j"))
    return d.select("event_id", F.json_array_length("j.json").alias("n_items"), F.col("j.used").alias("extraction_used"))


_CONCEPT_SQL = """CASE event_id % 4 WHEN 0 THEN '[{"concept": "' || event_type || '", "key_terms": ["a", "b"], "source_span": "u' || user_id || '"}]'
WHEN 1 THEN 'x {"concept": "' || event_type || '" ; "key_terms": ["a" ; "source_span": "u"} {"concept": "q", "key_terms": ["c"] "source_span": "s"'
WHEN 2 THEN '[{"concept": "' || event_type || '", "key_terms": "a", "source_span": "u"}]' ELSE '[]' END"""


def _concepts():
    k, e = F.col("event_id") % 4, F.col("event_type")
    return (
        F.when(k == 0, F.concat(F.lit('[{"concept": "'), e, F.lit('", "key_terms": ["a", "b"], "source_span": "u'), F.col("user_id").cast("string"), F.lit('"}]')))
        .when(k == 1, F.concat(F.lit('x {"concept": "'), e, F.lit('" ; "key_terms": ["a" ; "source_span": "u"} {"concept": "q", "key_terms": ["c"] "source_span": "s"')))
        .when(k == 2, F.concat(F.lit('[{"concept": "'), e, F.lit('", "key_terms": "a", "source_span": "u"}]'))).otherwise("[]")
    )


_FIELDS = r'(?s)"concept"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"key_terms"\s*:\s*(\[[^\]]*\])[^"]*?"source_span"\s*:\s*"((?:[^"\\]|\\.)*)"'
_TEXTS = lambda j: f"coalesce(list_bool_and(list_transform(CAST({j} AS JSON[]), lambda y: json_type(y) = 'VARCHAR')), true)"


def lenient_sql(c: str) -> str:
    """The concepts of a text as a list of {c, t, s}."""
    z = "list_zip(" + ", ".join(f"regexp_extract_all({c}, '{_FIELDS}', {g})" for g in (1, 2, 3)) + ")"
    return f"list_transform(list_filter({z}, lambda x: CASE WHEN json_valid(x[2]) THEN {_TEXTS('x[2]')} ELSE false END), lambda x: {{'c': x[1], 't': CAST(x[2] AS VARCHAR[]), 's': x[3]}})"


@query(f"""WITH r AS (SELECT event_id, {_CONCEPT_SQL} j FROM events), l AS (SELECT event_id, {lenient_sql("j")} l FROM r)
SELECT event_id, CAST(len(l) AS INT) AS n_concepts, l[1].c AS first_concept, CAST(len(l[1].t) AS INT) AS n_terms, l[1].s AS span FROM l""")
def json_lenient(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", parsing.lenient_concepts(_concepts()).alias("c"))
    first = F.get("c", F.lit(0))
    return d.select("event_id", F.size("c").alias("n_concepts"), first["concept"].alias("first_concept"), F.size(first["key_terms"]).alias("n_terms"), first["source_span"].alias("span"))


@query(f"""WITH r AS (SELECT event_id, {_CONCEPT_SQL} j FROM events)
SELECT event_id, CASE WHEN json_valid(j) AND starts_with(j, '[') THEN coalesce(list_bool_and(list_transform(CAST(j AS JSON[]), lambda x: coalesce(json_type(x, '$.concept') = 'VARCHAR' AND x ->> '$.concept' <> '' AND json_type(x, '$.key_terms') = 'ARRAY' AND json_type(x, '$.source_span') = 'VARCHAR' AND x ->> '$.source_span' <> '', false))), true) ELSE false END AS schema_ok FROM r""")
def schema_gate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", parsing.schema_valid(_concepts()).alias("schema_ok"))


@query("SELECT page_id, nullif(replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '') AS title, length(html) AS n_chars FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsing.html_title(F.col("html")).alias("title"), F.length("html").cast("long").alias("n_chars"))


@query("SELECT page_id, CASE WHEN list_position(p, 'Data') > 0 THEN p[list_position(p, 'Data') + 2] END AS category FROM (SELECT page_id, string_split(CASE WHEN page_id % 2 = 0 THEN replace(url, '//', '/Data/') ELSE url END, '/') p FROM pages)")
def url_category(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("//"), F.lit("/Data/"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.category_of_path(u).alias("category"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents )
SELECT doc_id, CAST(i - 1 AS INT) AS pos, '## ' || l[i] || chr(10) AS section FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) i FROM s) WHERE i < len(l)
UNION ALL SELECT doc_id, CAST(len(l) - 1 AS INT), '## ' || l[len(l)] FROM s""")
def section_split(spark, sf_dir):
    marked = F.concat(F.lit("intro\n## "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsing.sections(marked)).alias("pos", "section"))


@query("SELECT conv_id, turn, CAST(nullif(regexp_extract(text, '[1-4]'), '') AS INT) AS answer, CAST(length(text) // 60 AS VARCHAR) || ':' || lpad(CAST(length(text) % 60 AS VARCHAR), 2, '0') AS code FROM conversations")
def answer_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.answer_digit(F.col("text")).alias("answer"), text.timecode(F.length("text").cast("double")).alias("code"))


@query("""WITH s AS (SELECT item_id, trim(text) span FROM benchmark), m AS (SELECT s.item_id, count(*) n FROM s JOIN documents d ON contains(d.text, s.span) WHERE s.span <> '' GROUP BY 1)
SELECT b.item_id, coalesce(n, 0) AS n_sources, coalesce(n, 0) > 0 AS verified, coalesce(n, 0) = 0 AS review_required FROM benchmark b LEFT JOIN m USING (item_id)""")
def span_verify(spark, sf_dir):
    from ..operators.grounding import verify_spans

    return verify_spans(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) prev FROM conversations)
SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), regexp_extract_all(lower(prev), '[\\p{L}\\p{N}_]+'))) > 0 AS grounded FROM c WHERE prev IS NOT NULL""")
def grounding_overlap(spark, sf_dir):
    from ..operators.grounding import grounded
    from pyspark.sql import Window as W

    c = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("prev is not null")
    return c.select("conv_id", "turn", grounded(F.col("text"), F.col("prev")).alias("grounded"))
