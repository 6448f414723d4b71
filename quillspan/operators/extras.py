"""Smaller operators: flags and filters on units, plan comparisons, face and body metrics, template regions, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def structured_units(concepts: DataFrame, sentences: DataFrame) -> DataFrame:
    """Verified concepts zipped with sentences by position; a sentence that does not rest on its span is blanked.

    concepts: doc_id, ord, concept, span, verified; sentences: doc_id, pos, sentence.
    """
    from .grounding import grounded

    pos = F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1
    d = concepts.where("verified").withColumn("pos", pos).join(sentences, ["doc_id", "pos"], "left")
    ok = F.coalesce(grounded(F.col("sentence"), F.col("span")), F.lit(False))
    return d.select("doc_id", F.format_string("u%02d", F.col("pos") + 1).alias("unit_id"), "concept", F.when(ok, F.col("sentence")).otherwise("").alias("sentence"), ok.alias("grounded"), (~ok).alias("review_required"))


def unit_flags(units: DataFrame, resolutions: DataFrame) -> DataFrame:
    """review: the unit's own flags or that of any of its resolutions. units: unit_id, review_required, loss, plan_status."""
    r = resolutions.groupBy("unit_id").agg(F.bool_or("review_required").alias("_r"))
    d = units.join(r, "unit_id", "left")
    return d.select("unit_id", (F.coalesce("review_required", F.lit(False)) | F.coalesce("loss", F.lit(False)) | (F.coalesce("plan_status", F.lit("OK")) == "REVIEW_REQUIRED") | F.coalesce("_r", F.lit(False))).alias("review"))


def status_filter(d: DataFrame, status: str) -> DataFrame:
    """ALL passes everything; rows count as included unless the flag is false."""
    kept = d if status == "ALL" else d.where(F.col("status") == status)
    return kept.withColumn("included", F.coalesce("included", F.lit(True)))


def face_covered(hand: Column, nose: Column, chin: Column) -> Column:
    """A hand point within 0.75 of twice the distance from nose to chin."""
    r = 0.75 * 2 * F.hypot(nose["x"] - chin["x"], nose["y"] - chin["y"])
    return F.exists(hand, lambda p: F.hypot(p["x"] - nose["x"], p["y"] - nose["y"]) < r)


def hand_expected(visibility: Column, x: Column, y: Column) -> Column:
    return (visibility > 0.5) & x.between(0, 1) & y.between(0, 1)


def mentions(c: Column, substrings: Column) -> Column:
    return F.exists(substrings, lambda s: F.contains(F.lower(c), s))


def caption_with_fallback(rows: DataFrame, supplementary: DataFrame) -> DataFrame:
    """caption, caption_source: the row's own label if it is sound, else the other dictionary's for the same English word.

    rows: key, en, ar, integrity; supplementary: en, ar, ord.
    """
    other = supplementary.groupBy(F.lower(text.strip(F.col("en"))).alias("_k")).agg(F.min_by("ar", "ord").alias("_o"))
    d = rows.join(other, F.lower(text.strip(F.col("en"))) == F.col("_k"), "left")
    own = F.when((F.col("integrity") == "VALID") & (F.coalesce("ar", F.lit("")) != ""), F.col("ar"))
    return d.select("key", F.coalesce(own, "_o").alias("caption"), F.when(own.isNotNull(), "PRIMARY").when(F.col("_o").isNotNull(), "SUPPLEMENTARY").otherwise("NONE").alias("caption_source"))


def plan_metrics(d: DataFrame, key: str) -> DataFrame:
    """One count per render source and status."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(f"n_{v.lower()}")
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), *[n("render_source", v) for v in ("PRIMARY", "SUPPLEMENTARY", "FINGERSPELL")], *[n("status", v) for v in ("VERIFIED", "REVIEW_REQUIRED", "UNSUPPORTED")])


def hand_span(hand: Column) -> Column:
    """The larger side of a hand's box."""
    side = lambda n: F.array_max(F.transform(hand, lambda p: p[n])) - F.array_min(F.transform(hand, lambda p: p[n]))
    return F.greatest(side("x"), side("y"))


def mean_contour(d: DataFrame, key: str, points: str) -> DataFrame:
    p = d.select(key, F.posexplode(points).alias("i", "p"))
    return p.groupBy(key, "i").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))


def band_energy(d: DataFrame, key: str, top: str, bottom: str) -> DataFrame:
    """The band with the larger spread of frame differences; the bottom one on ties."""
    g = d.groupBy(key).agg(F.stddev_pop(top).alias("top"), F.stddev_pop(bottom).alias("bottom"))
    return g.withColumn("band", F.when(F.col("bottom") >= F.col("top"), "bottom").otherwise("top"))


def signature_steps(d: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """Sum of absolute differences to the signature before; null for the first."""
    p = F.lag(v).over(W.partitionBy(key).orderBy(order))
    return d.select(key, order, F.aggregate(F.zip_with(v, p, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x).alias("step"))


def relative_position(wrist: Column, neck: Column, left: Column, right: Column) -> tuple[Column, Column]:
    w = F.hypot(left["x"] - right["x"], left["y"] - right["y"])
    return (wrist["x"] - neck["x"]) / w, (wrist["y"] - neck["y"]) / w


def face_ratios(eye_top: Column, eye_bottom: Column, mouth_top: Column, mouth_bottom: Column, face: Column) -> tuple[Column, Column]:
    """Openness of eye and mouth over the face's height."""
    d = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return d(eye_top, eye_bottom) / face, d(mouth_top, mouth_bottom) / face


def crop_box(width: Column, height: Column, fractions: tuple[float, float, float, float]) -> Column:
    """Pixel box of fractional bounds, cut off towards zero."""
    x0, y0, x1, y1 = fractions
    return F.struct(*[(c * f).cast("int").alias(n) for c, f, n in ((width, x0, "x0"), (height, y0, "y0"), (width, x1, "x1"), (height, y1, "y1"))])


def recall_verdict(d: DataFrame, hit1: Column, hit_k: Column, positive: Column, least: float = 0.6) -> DataFrame:
    g = d.where(positive).agg(F.count(F.lit(1)).alias("n"), F.avg(hit1.cast("double")).alias("recall_1"), F.avg(hit_k.cast("double")).alias("recall_k"))
    return g.withColumn("verdict", F.when(F.col("recall_1") >= least, "USEFUL").otherwise("NOT_USEFUL"))


def throughput(d: DataFrame, key: str, ts: str, total: Column) -> DataFrame:
    """Done, seconds since the first row, rows a second and seconds left, per row in order."""
    w = W.partitionBy(key).orderBy(ts)
    done = F.row_number().over(w)
    elapsed = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.min(F.col(ts).cast("timestamp")).over(w))) / 1e6
    d = d.select("*", done.alias("done"), elapsed.alias("elapsed"))
    return d.withColumn("rate", F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed"))).withColumn("eta", (total - F.col("done")) / F.col("rate"))


def legend(lines: DataFrame) -> DataFrame:
    """number, category, word of lines `NNN.jpg: Category / Word`."""
    part = lambda g: F.regexp_extract("value", r"^(\d+)\.jpg:\s*(.*?)\s*/\s*(.*?)\s*$", g)
    return lines.select(F.nullif(part(1), F.lit("")).cast("int").alias("number"), part(2).alias("category"), part(3).alias("word")).where("number is not null")
