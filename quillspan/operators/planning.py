"""Sign plans, request checks and small classifiers over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

# Words that do not tell variants apart.
VARIANT_STOP = ["the", "a", "an", "of", "my", "your", "his", "her", "our", "their", "is", "are", "to", "in", "on"]


def all_tokens(c: Column) -> Column:
    return F.array_union(text.tokens_en(c), text.tokens_ar(c))


def missing_terms(key_terms: Column, plan: Column) -> Column:
    """Key terms with tokens of which no plan item has any."""
    return F.filter(key_terms, lambda k: (F.size(all_tokens(k)) > 0) & ~F.exists(plan, lambda p: F.arrays_overlap(all_tokens(k), all_tokens(p))))


def collapsed(plan: Column, sentence: Column) -> Column:
    """One plan item for a sentence with two or more distinct content words."""
    return (F.size(plan) == 1) & (F.size(F.array_distinct(all_tokens(sentence))) >= 2)


def plan_status(sentence: Column, plan: Column) -> Column:
    """REVIEW_REQUIRED without a sentence, a readable plan or any item in it, and for a collapsed plan; else OK."""
    return F.when((F.coalesce(sentence, F.lit("")) == "") | plan.isNull() | (F.size(plan) == 0), "REVIEW_REQUIRED").when(collapsed(plan, sentence), "REVIEW_REQUIRED").otherwise("OK")


def variant(english: Column, catalog: Column) -> Column:
    toks = lambda c: F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z']+)"), F.lit(1)), lambda w: ~w.isin(VARIANT_STOP))
    e, c = toks(english), toks(catalog)
    return F.when(text.strip(english).rlike(r"(?i)^(my|your|his|her|our|their)\s+\w+"), "MULTI_CONCEPT").when((F.size(e) == 0) | (F.size(c) == 0), "SUPPLEMENTARY_ONLY").when(F.arrays_overlap(e, c), "PLAUSIBLE_VARIANT").otherwise("SUPPLEMENTARY_ONLY")


def request_error(language: Column, duration: Column, file_name: Column, size: Column) -> Column:
    """The first failing check of a request, or null."""
    return (
        F.when(~language.isin("auto", "en", "ar"), "bad language").when(~duration.between(10, 180), "bad duration")
        .when(~F.lower(file_name).rlike(r"\.(md|txt)$"), "bad extension").when(size > 2 * 1024 * 1024, "too large")
    )


def can_render(status: Column, allow_review: bool = False) -> Column:
    return F.when(status == "BLOCKED", False).when(status == "REVIEW_REQUIRED", F.lit(allow_review)).otherwise(True)


def renderable(d: DataFrame) -> DataFrame:
    """Supplementary rows that can be shown: words with a video, both bounds and both labels."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return d.where((F.col("content_type") == "WORD") & full("youtube_video_id") & F.col("segment_start_s").isNotNull() & F.col("segment_end_s").isNotNull() & full("english_meaning") & full("arabic_text"))


def script_sound(english: Column, arabic: Column) -> Column:
    return ~text.is_arabic(english) & text.is_arabic(arabic)


def segments(units: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, unresolved): every verified or spelled item ends in clips or is listed.

    units: unit_id, idx, term, status, clip_keys (one for a sign, one per letter for spelling); available: clip_key.
    """
    parts = units.where(F.col("status").isin("VERIFIED", "FINGERSPELL_CANDIDATE") & F.col("unit_id").isNotNull() & F.col("idx").isNotNull())
    each = parts.select("unit_id", "idx", "term", F.posexplode_outer("clip_keys").alias("pos", "clip_key")).join(available.select("clip_key", F.lit(True).alias("ok")).distinct(), "clip_key", "left")
    out = each.withColumn("all_ok", F.every(F.coalesce("ok", F.lit(False))).over(W.partitionBy("unit_id", "idx")))
    return out.where("all_ok").select("unit_id", "idx", "pos", "term", "clip_key"), out.where("not all_ok").select("unit_id", "idx", "term").distinct()
