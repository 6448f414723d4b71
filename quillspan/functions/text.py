"""Text functions over columns: language, normalising, tokens, word forms, names, gates. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lists that results depend on.
STOP_WORDS = ["a", "an", "the", "of", "is", "are", "was", "were", "be", "to", "and", "or", "in", "on", "at", "for", "with", "very", "every", "all", "many"]
MODIFIERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "some", "many", "few", "several", "no", "all", "every", "each", "both", "very", "so", "quite", "extremely", "really", "too", "not", "never"]
MODIFIERS_AR = [
    "واحد", "واحدة", "اثنان", "اثنين", "ثلاثة", "اربعة", "خمسة", "ستة", "سبعة", "ثمانية", "تسعة", "عشرة", "بعض", "كثير", "قليل", "عدة", "كل", "جميع",
    "جدا", "جدًا", "كثيرا", "كثيرًا", "قليلا", "قليلاً", "لا", "لم", "ليس", "ما", "ابدا", "ابدًا",
]
KINSHIP_POSSESSIVE = ["امي", "امى", "ابي", "ابى", "اخي", "اخى", "اختي", "اختى"]
CLITICS = ["وال", "فال", "بال", "كال", "لل", "ال", "و", "ف", "ب", "ل", "ك"]
STRIP = " \t\n\r\f\v"
# Ranges of Arabic letters: basic, with the supplement, and all forms.
AR_LETTERS = "[\\u0600-\\u06FF]"
AR_WIDE = "[\\u0600-\\u06FF\\u0750-\\u077F]"
AR_FULL = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"
# Limits and marks of a proposed term and of a gloss.
TERM_MOST, GLOSS_MOST, ALTERNATIVE_MARKS = 60, 40, ("or", "أو", "/", "،", ",", ";", "(", ")")
# End of fixed values.


def strip(c: Column) -> Column:
    """Without white space at either end, as Python's strip (ASCII white space)."""
    return F.btrim(c, F.lit(STRIP))


def detect_language(c: Column) -> Column:
    """ar if Arabic letters outnumber Latin ones, unknown if there are neither, else en."""
    arabic, latin = F.regexp_count(c, F.lit(AR_WIDE)), F.length(F.regexp_replace(c, "[^A-Za-z]+", ""))
    return F.when((arabic == 0) & (latin == 0), "unknown").when(arabic > latin, "ar").otherwise("en")


def content_id(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def language_mode(requested: Column) -> Column:
    return F.when(requested == "auto", "auto-detected").otherwise("user-declared")


def tokens_en(c: Column) -> Column:
    """Words of Latin letters and apostrophes, lower-cased, without stop-words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1)), lambda t: ~t.isin(STOP_WORDS))


def plain_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))


def normalize_ar(c: Column) -> Column:
    """Drop marks and tatweel, unify alif forms, strip, lower; ta marbuta and alif maksura stay."""
    bare = F.regexp_replace(c, "[\\u0617-\\u061A\\u064B-\\u0652\\u0670\\u06D6-\\u06ED\\u0640]", "")
    return F.lower(strip(F.translate(bare, "أإآ", "ااا")))


def tokens_ar(c: Column) -> Column:
    return F.regexp_extract_all(normalize_ar(c), F.lit("([\\u0600-\\u06FF]+)"), F.lit(1))


def unicode_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("((?U)\\w+)"), F.lit(1)))


def is_arabic(c: Column, letters: str = AR_LETTERS) -> Column:
    return c.rlike(letters)


def safe_forms(w: Column) -> Column:
    """Plural reductions in fixed order; null where a rule does not apply."""
    n = F.length(w)
    return F.array(
        F.when(w.endswith("ies") & (n > 4), F.concat(F.substr(w, F.lit(1), n - 3), F.lit("y"))),
        F.when(w.endswith("es") & (n > 3), F.substr(w, F.lit(1), n - 2)),
        F.when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substr(w, F.lit(1), n - 1)),
    )


def risky_forms(w: Column) -> Column:
    """Reductions of -ing and -ed in fixed order."""
    n = F.length(w)
    ing, ed = w.endswith("ing") & (n > 5), w.endswith("ed") & (n > 4)
    return F.array(
        F.when(ing, F.substr(w, F.lit(1), n - 3)),
        F.when(ing, F.concat(F.substr(w, F.lit(1), n - 3), F.lit("e"))),
        F.when(ed, F.substr(w, F.lit(1), n - 2)),
        F.when(ed, F.substr(w, F.lit(1), n - 1)),
    )


def clitic_forms(normalized: Column) -> Column:
    """One leading clitic removed, in fixed order, where at least two letters stay."""
    forms = [F.when(normalized.startswith(p) & (F.length(normalized) - len(p) >= 2), F.substr(normalized, F.lit(len(p) + 1))) for p in CLITICS]
    return F.array_compact(F.array(*forms))


def slugify(c: Column) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unnamed"))


def sanitize_filename(c: Column) -> Column:
    s = F.regexp_replace(F.substring_index(c, "/", -1), "[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("source"))


def alignment_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z\\u0600-\\u06FF]", "")


#: All canonical compositions of Arabic letters, base and mark to the one letter.
ARABIC_COMPOSED = (("\u0627\u0653", "\u0622"), ("\u0627\u0654", "\u0623"), ("\u0648\u0654", "\u0624"), ("\u0627\u0655", "\u0625"), ("\u064A\u0654", "\u0626"), ("\u06D5\u0654", "\u06C0"), ("\u06C1\u0654", "\u06C2"), ("\u06D2\u0654", "\u06D3"))


def letters(c: Column) -> Column:
    """Letters to spell, in order: marks, spaces and direction marks gone, letters composed (NFC), alif forms unified."""
    bare = F.regexp_replace(strip(c), "[\\u064B-\\u0652\\u0670]", "")
    for parts, whole in ARABIC_COMPOSED:
        bare = F.replace(bare, F.lit(parts), F.lit(whole))
    bare = F.regexp_replace(bare, "[ \\u200E\\u200F]", "")
    return F.filter(F.split(F.translate(bare, "أإآ", "ااا"), ""), lambda x: x != "")


def term_gate(c: Column) -> Column:
    """struct(clean, status, reason) of a proposed Arabic term; the first failing check names the reason."""
    t = strip(F.btrim(strip(c), F.lit('"')))
    many = F.lit(False)
    for mark in ALTERNATIVE_MARKS:
        many = many | F.contains(t, F.lit(mark))
    review = lambda why: F.struct(F.lit(None).cast("string").alias("clean"), F.lit("REVIEW_REQUIRED").alias("status"), F.lit(why).alias("reason"))
    return (
        F.when(t == "", review("empty"))
        .when(F.contains(t, F.lit("\n")) | (F.length(t) > TERM_MOST), review("commentary"))
        .when(many, review("alternatives"))
        .when(~t.rlike(AR_LETTERS), review("no Arabic script"))
        .when(~t.rlike("^[\\u0600-\\u06FF\\s]+$"), review("other characters"))
        .otherwise(F.struct(t.alias("clean"), F.lit("OK").alias("status"), F.lit("single clean term").alias("reason")))
    )


def terminology_need(item: Column, source_arabic: Column) -> Column:
    """NOT_NEEDED for items in Arabic script or of an Arabic source: they stand for themselves; else ASK."""
    return F.when(is_arabic(item) | source_arabic, "NOT_NEEDED").otherwise("ASK")


def gloss_gate(c: Column) -> Column:
    t = strip(c)
    return (~F.contains(t, F.lit("\n"))) & (F.length(t) <= GLOSS_MOST) & ~t.rlike(AR_LETTERS) & t.rlike("^[A-Za-z\\s\\-]+$")


def category_of_path(c: Column) -> Column:
    """The path component two after `Data`, or null."""
    parts = F.split(c, "/")
    at = F.array_position(parts, "Data")
    return F.when(at > 0, F.get(parts, (at + 1).cast("int")))


def caption_en(term: Column, fallback: Column) -> Column:
    return F.when((F.coalesce(term, F.lit("")) != "") & ~term.rlike(AR_FULL), term).when(F.coalesce(fallback, F.lit("")) != "", F.upper(fallback)).otherwise("[EN UNAVAILABLE]")


def caption_ar(c: Column) -> Column:
    return F.when(c.rlike(AR_FULL), c).otherwise("[AR UNAVAILABLE]")


def catalog_text(*parts: Column, prefix: str = "") -> Column:
    """The non-empty parts, joined; models that tell queries from passages want their prefix in front."""
    return F.concat(F.lit(prefix), F.concat_ws(" | ", *[F.nullif(p, F.lit("")) for p in parts]))


def segment_stem(number: Column, label: Column) -> Column:
    """Three digits, an underscore and the label."""
    return F.format_string("%03d_%s", number, label)


def utc_stamp(c: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, to two digits, half to even."""
    return F.bround((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6, 2)


def display_label(en: Column, ar: Column, ident: Column) -> Column:
    """What a reason calls a row: its English label, else the Arabic one, else its id."""
    return F.coalesce(F.nullif(en, F.lit("")), F.nullif(ar, F.lit("")), ident)


def label(en: Column, ar: Column) -> Column:
    return F.when(F.coalesce(ar, F.lit("")) != "", F.concat(en, F.lit(" ("), ar, F.lit(")"))).otherwise(en)


def timecode(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def clip_key(name: Column, ident: Column, category: Column) -> Column:
    return F.concat_ws("/", slugify(category), F.concat(slugify(name), F.lit("_"), F.substr(ident, F.lit(1), F.lit(8)), F.lit(".mp4")))


def answer_digit(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "[1-4]", 0), F.lit("")).try_cast("int")


def rounded(c: Column, digits: int = 6) -> Column:
    """floor(c * 10**d + 0.5) / 10**d: the one rounding that agrees with other engines bit for bit."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, rounded(part * 100.0 / whole, digits)).otherwise(0.0)


def information_loss(item: Column, selected: Column) -> Column:
    """What a dictionary label loses of an item: modifiers may go, the head may not."""
    arabic = is_arabic(F.coalesce(item, F.lit("")))
    words = F.when(arabic, tokens_ar(item)).otherwise(plain_words(item))
    mods = F.when(arabic, F.array(*map(F.lit, MODIFIERS_AR))).otherwise(F.array(*map(F.lit, MODIFIERS)))
    content, modifiers = F.array_except(words, mods), F.array_intersect(words, mods)
    chosen = F.array_union(plain_words(selected), F.array(F.lower(strip(selected))))
    return (
        F.when(F.size(words) == 0, "AMBIGUOUS")
        .when(arabic & (F.size(words) == 1) & F.arrays_overlap(words, F.array(*map(F.lit, KINSHIP_POSSESSIVE))), "CORE_WITH_MODIFIER_LOSS")
        .when((F.size(modifiers) == 0) | (F.size(content) == 0), "FULL")
        .when(F.arrays_overlap(content, chosen), "CORE_WITH_MODIFIER_LOSS")
        .when(F.arrays_overlap(modifiers, chosen), "ESSENTIAL_INFORMATION_LOSS")
        .otherwise("AMBIGUOUS")
    )
