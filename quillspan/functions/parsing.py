"""Parsing of model output and markup: bounded JSON extraction, lenient fields, schema checks, cards, sections, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

CONCEPTS = "array<struct<concept:string,key_terms:array<string>,source_span:string>>"


def without_thoughts(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<think>.*?</think>", "")


def bounded_array(c: Column) -> Column:
    """struct(json, used): the text if it is a JSON array, else its widest [...] part if that is one, else null."""
    raw = F.btrim(without_thoughts(c), F.lit(" \t\n\r"))
    inner = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return (
        F.when(F.json_array_length(raw).isNotNull(), F.struct(raw.alias("json"), F.lit(False).alias("used")))
        .when(F.json_array_length(inner).isNotNull(), F.struct(inner.alias("json"), F.lit(True).alias("used")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("json"), F.lit(None).cast("boolean").alias("used")))
    )


def bounded_object(c: Column) -> Column:
    raw = without_thoughts(c)
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def unescape(c: Column) -> Column:
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>"), 0), c)


#: The three fields must follow each other in this order with these separators for the same triples to be
#: found: a comma after the concept, and no quotation mark between the list of terms and the span. What stands between
#: quotation marks is taken without a way back, so a long text costs no stack.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
CONCEPT_FIELDS = rf'(?s)"concept"\s*:\s*{_QUOTED}\s*,\s*"key_terms"\s*:\s*(\[[^\]]*+\])[^"]*+"source_span"\s*:\s*{_QUOTED}'


def _kind(x: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit("NONE"))


def lenient_concepts(c: Column) -> Column:
    """Concepts found by their three fields in sequence, whatever brackets surround them; a list of terms that is no JSON list of texts drops the concept."""
    parts = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(CONCEPT_FIELDS), F.lit(g)).alias(n) for g, n in ((1, "concept"), (2, "terms"), (3, "span"))])
    terms = lambda x: F.when(_kind(F.try_parse_json(x["terms"]), "$").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(x["terms"], "array<string>"))
    rows = F.transform(parts, lambda x: F.struct(unescape(x["concept"]).alias("concept"), terms(x).alias("key_terms"), unescape(x["span"]).alias("source_span")))
    return F.filter(rows, lambda x: F.coalesce(F.forall(x["key_terms"], lambda t: t.isNotNull()), F.lit(False)))


def schema_valid(c: Column) -> Column:
    """An array whose items all have a non-empty text concept, a list of texts key_terms and a non-empty text source_span."""
    elements = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    text = lambda x, path: (_kind(x, path) == "STRING") & (F.coalesce(F.try_variant_get(x, path, "string"), F.lit("")) != "")
    listed = lambda x: _kind(x, "$.key_terms").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(F.forall(F.try_variant_get(x, "$.key_terms", "array<string>"), lambda t: t.isNotNull()), F.lit(False))
    good = F.forall(elements, lambda x: text(x, "$.concept") & listed(x) & text(x, "$.source_span"))
    return F.coalesce((F.substr(F.ltrim(c), F.lit(1), F.lit(1)) == "[") & good, F.lit(False))


def array_text(raw: Column) -> Column:
    """The reply without thoughts if it is JSON, else what stands from its first [ to its last ]."""
    bare = strip(without_thoughts(raw))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(F.regexp_extract(bare, r"(?s)\[.*\]", 0))


def plan_items(raw: Column) -> Column:
    """The items of a reply that should be a JSON array: as texts, stripped, without empty ones; null if it is none."""
    listed = F.try_variant_get(F.try_parse_json(array_text(raw)), "$", "array<string>")
    return F.filter(F.transform(F.when(F.substr(array_text(raw), F.lit(1), F.lit(1)) == "[", listed), strip), lambda x: x != "")


def plan(raw: Column, sentence: Column) -> Column:
    """struct(items, status, reason) of a plan made from a sentence; a null reply is a call that failed."""
    items = plan_items(raw)
    reason = (
        F.when(F.coalesce(sentence, F.lit("")) == "", "no sentence").when(raw.isNull(), "no reply").when(items.isNull(), "no JSON array").when(F.size(items) == 0, "empty")
    )
    none = F.array().cast("array<string>")
    return F.struct(F.when(reason.isNull(), items).otherwise(none).alias("items"), F.when(reason.isNull(), "OK").otherwise("REVIEW_REQUIRED").alias("status"), reason.alias("reason"))


def sentence_at(raw: Column, place: Column) -> Column:
    """The sentence that a reply gives for the item at a place of its array; empty if there is none."""
    listed = F.from_json(array_text(raw), "array<struct<educational_sentence:string>>")
    return F.coalesce(F.get(listed, place)["educational_sentence"], F.lit(""))


def extraction(raw: Column, retry: Column) -> Column:
    """struct(status, concepts) of a model's reply and of its one retry.

    OK: the reply holds a sound array. OK_AFTER_LENIENT_EXTRACT: its fields do. OK_AFTER_REPAIR: the retry holds one or its
    fields do. FAILED_AFTER_REPAIR: neither, and no concepts. A null retry is one that never came.
    """

    def read(c):
        listed = F.when(schema_valid(array_text(c)), F.from_json(array_text(c), CONCEPTS))
        found = lenient_concepts(c)
        sound = F.forall(found, lambda x: (x["concept"] != "") & (x["source_span"] != ""))
        return listed, F.when((F.size(found) > 0) & sound, found)

    (a, b), (c, d) = read(raw), read(F.coalesce(retry, F.lit("")))
    status = F.when(a.isNotNull(), "OK").when(b.isNotNull(), "OK_AFTER_LENIENT_EXTRACT").when(c.isNotNull() | d.isNotNull(), "OK_AFTER_REPAIR").otherwise("FAILED_AFTER_REPAIR")
    return F.struct(status.alias("status"), F.coalesce(a, b, c, d, F.array().cast(CONCEPTS)).alias("concepts"))


def card(c: Column) -> Column:
    """struct(word_en, video_url, vimeo_id, thumb_path, has_video) of a listing's card; what is missing is null."""
    take = lambda text, pattern: F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.regexp_extract(text, pattern, 1))
    title = strip(F.regexp_replace(take(c, r"(?s)field-title[\"']?>(.*?)</h5>"), "<[^>]+>", ""))
    video = F.replace(take(c, r'href="(https://player\.vimeo\.com[^"]+)"'), F.lit("&amp;"), F.lit("&"))
    return F.struct(title.alias("word_en"), video.alias("video_url"), take(video, r"/external/(\d+)\.").alias("vimeo_id"), take(c, r"data-thumb='([^']*)'").alias("thumb_path"), video.isNotNull().alias("has_video"))


def repaired(c: Column) -> Column:
    """The first of: the text, with literal \\n as blanks, with parenthesised values quoted, that is a JSON array."""
    a = F.replace(c, F.lit("\\n"), F.lit(" "))
    b = F.regexp_replace(a, r": \(([^)]*)\)", r': "$1"')
    out = F.lit(None).cast("string")
    for x in (b, a, c):
        out = F.when(F.json_array_length(x).isNotNull(), x).otherwise(out)
    return out


def html_title(c: Column) -> Column:
    """The h1 text without tags and with &amp; decoded; null if there is none."""
    inner = F.regexp_extract(c, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return F.nullif(F.replace(F.regexp_replace(inner, "<[^>]+>", ""), F.lit("&amp;"), F.lit("&")), F.lit(""))


def sections(c: Column) -> Column:
    """Parts that begin with a level-two heading."""
    return F.filter(F.split(c, r"(?m)(?=^## )"), lambda s: s.startswith("##"))


def after_marker(c: Column, marker: str, schema: str) -> Column:
    """The JSON block after a marker in a log; null if there is no marker or no JSON."""
    return F.when(F.contains(c, F.lit(marker)), F.from_json(F.regexp_extract(F.substring_index(c, marker, -1), r"(?s)\{.*\}", 0), schema))


def selector_choice(c: Column) -> Column:
    """struct(id, confidence) of a selector's reply; NONE in any writing is null, the default confidence is low."""
    j = F.from_json(bounded_object(c), "struct<id:string,confidence:string>")
    ident = F.when(F.lower(j["id"]).isin("none", ""), None).otherwise(j["id"])
    return F.struct(ident.alias("id"), F.coalesce(j["confidence"], F.lit("low")).alias("confidence"))
