"""A whole episode: the supplementary dictionary's layer, its evidence, checks with ordered reasons, and the trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import planning, resolve
from .durable import spread, spread_parts


def as_catalog(rows: DataFrame) -> DataFrame:
    """Supplementary rows (ord, supplementary_id, english_meaning, ...) in the shape of a catalog; has_video says whether a row can be shown."""
    good = planning.renderable(rows).select("supplementary_id", F.lit(True).alias("_ok")).distinct()
    d = rows.join(good, "supplementary_id", "left")
    return d.select("ord", F.col("supplementary_id").alias("id"), F.col("english_meaning").alias("word_en"), F.col("arabic_text").alias("word_ar"), F.col("content_type").alias("category"), F.coalesce("_ok", F.lit(False)).alias("has_video"))


def supplementary(items: DataFrame, rows: DataFrame, selector: DataFrame | None = None, top: int = 5) -> DataFrame:
    """item, supplementary_id, method, information_loss, n_candidates, outcome of the supplementary layer.

    The first row with the item's label counts if it can be shown. Else the selector (item, selected_id) may choose among
    the candidates: a row that can be shown, loses nothing essential, and has its labels in their own scripts. An id from
    outside the candidates is rejected.
    """
    only, catalog = items.select("item").distinct(), as_catalog(rows)
    d = only.join(resolve.exact(only, catalog).where("exact.row.has_video").select("item", F.col("exact.row").alias("_e")), "item", "left")
    arabic = catalog.select(F.col("ord").alias("_o"), "word_ar")
    found = resolve.candidates(only, catalog, top).join(arabic, F.col("row.ord") == F.col("_o"))
    d = d.join(found.groupBy("item").agg(F.collect_list(F.struct("row", "word_ar")).alias("_c")), "item", "left")
    d = d.join(selector.select("item", "selected_id"), "item", "left") if selector is not None else d.withColumn("selected_id", F.lit(None).cast("string"))
    chosen = F.get(F.filter("_c", lambda x: x["row"]["id"] == F.col("selected_id")), F.lit(0))
    d = d.withColumn("_s", F.when(F.col("_e").isNull(), chosen)).withColumn("_n", F.when(F.col("_e").isNotNull(), 0).otherwise(F.coalesce(F.size("_c"), F.lit(0))))
    loss = text.information_loss(F.col("item"), F.col("_s.row.word_en"))
    outcome = (
        F.when(F.col("_e").isNotNull(), "EXACT").when(F.col("_n") < 1, "NO_CANDIDATES").when(F.col("selected_id").isNull(), "NOT_SELECTED").when(F.col("_s").isNull(), "NOT_A_CANDIDATE")
        .when(~F.col("_s.row.has_video"), "NOT_RENDERABLE").when(loss.isin("ESSENTIAL_INFORMATION_LOSS", "AMBIGUOUS"), loss)
        .when(~planning.script_sound(F.col("_s.row.word_en"), F.col("_s.word_ar")), "WRONG_SCRIPT").otherwise("SELECTED")
    )
    d = d.withColumn("outcome", outcome)
    exact, selected = F.col("outcome") == "EXACT", F.col("outcome") == "SELECTED"
    return d.select(
        "item", F.when(exact, F.col("_e.id")).when(selected, F.col("_s.row.id")).alias("supplementary_id"), F.when(exact, "SUPPLEMENTARY_EXACT").when(selected, "SUPPLEMENTARY_CANDIDATE_SELECTED").alias("method"),
        F.when(exact, "FULL").when(selected, loss).alias("information_loss"), F.greatest("_n", F.lit(0)).cast("long").alias("n_candidates"), "outcome",
    )


def supporting(resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """resolved with supporting: the id of the supplementary row of the same label, where the primary dictionary gave the sign."""
    hit = resolve.exact(resolved.select("item").distinct(), as_catalog(rows)).select("item", F.col("exact.row.id").alias("_s"))
    d = resolved.join(hit, "item", "left")
    own = (F.col("status") == "VERIFIED") & (F.col("render_source") == "PRIMARY") & F.col("_s").isNotNull()
    return d.withColumn("supporting", F.when(own, F.array("_s")).otherwise(F.array().cast("array<string>"))).drop("_s")


def gloss_bridge(items: DataFrame, catalog: DataFrame, glosses: DataFrame, top: int = 5) -> DataFrame:
    """item, gloss, rank, id, score: candidates by English gloss of the Arabic items that have none of their own.

    glosses: item, gloss as a model gave it; only a clean one is used.
    """
    only = items.select("item").where(text.is_arabic(F.col("item"))).distinct()
    bare = only.join(resolve.top_overlaps(only, catalog, 1).select("item"), "item", "left_anti")
    g = bare.join(glosses.where(text.gloss_gate(F.col("gloss"))).select("item", text.strip(F.col("gloss")).alias("gloss")), "item").dropDuplicates(["item"])
    found = resolve.candidates(g.select(F.col("gloss").alias("item")).distinct(), catalog, top)
    return g.join(found.select(F.col("item").alias("gloss"), "rank", F.col("row.id").alias("id"), "score"), "gloss").select("item", "gloss", "rank", "id", "score")


def coverage(resolutions: DataFrame) -> DataFrame:
    """The full coverage report: counts by status, by loss and by source of the sign, and the percentages to one digit, 0.0 for no items."""
    verified = F.col("status") == "VERIFIED"
    loss = F.coalesce("information_loss", F.lit("FULL"))
    of = lambda source: F.count_if(verified & F.col("render_source").eqNullSafe(source))
    n = resolutions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(verified).alias("verified"), F.count_if(verified & (loss == "FULL")).alias("full_match"), F.count_if(verified & (loss == "CORE_WITH_MODIFIER_LOSS")).alias("partial_match"),
        F.count_if(F.col("status") == "FINGERSPELL_CANDIDATE").alias("fingerspelled"), F.count_if(F.col("status") == "UNSUPPORTED").alias("unsupported"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review"),
        of("PRIMARY").alias("verified_primary"), of("SUPPLEMENTARY").alias("verified_supplementary"),
    )
    share = {"full": F.col("full_match"), "verified": F.col("verified"), "partial": F.col("partial_match"), "renderable": F.col("verified") + F.col("fingerspelled"), "primary": F.col("verified_primary"), "supplementary": F.col("verified_supplementary"), "combined": F.col("verified_primary") + F.col("verified_supplementary")}
    return n.select("*", *[text.percent(c, F.col("total")).alias(f"pct_{k}") for k, c in share.items()])


def validate(units: DataFrame, sources: DataFrame, resolutions: DataFrame) -> DataFrame:
    """doc_id, counters, blocking and review reasons in order of units and their items, and the overall status.

    units: doc_id, ord, unit_id, concept, source_span, review_required. sources: doc_id, source_text. resolutions: doc_id,
    ord, pos, term, status, ref_id, spelled (whether every letter was found), reason.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    n = spread_parts(units, resolutions)
    u = spread(units, n, "doc_id").join(spread(sources.select("doc_id", "source_text"), n, "doc_id"), "doc_id", "left")
    u = u.withColumn("_ok", ~blank(F.col("source_span")) & F.coalesce(F.contains("source_text", "source_span"), F.lit(False)))
    ident = F.coalesce("unit_id", F.lit("None"))
    say = lambda when, kind, sub, pos, what: F.when(when, F.struct(F.lit(kind).alias("kind"), F.col("ord").cast("long").alias("ord"), F.lit(sub).alias("sub"), pos.cast("long").alias("pos"), F.concat(ident, F.lit(": "), what).alias("what")))
    zero = F.lit(0)
    of_unit = F.array_compact(F.array(
        say(~F.col("_ok"), "B", 0, zero, F.lit("source_span not found verbatim in source text")),
        say(blank(F.col("concept")) | blank(F.col("source_span")), "B", 1, zero, F.lit("missing concept or source_span (no provenance)")),
        say(F.coalesce("review_required", F.lit(False)), "R", 3, zero, F.lit("unit-level review_required flag set")),
    ))
    r = spread(resolutions, n, "doc_id", "ord").join(spread(units.select("doc_id", "ord", "unit_id"), n, "doc_id", "ord"), ["doc_id", "ord"])
    term, status, why = F.col("term"), F.col("status"), F.coalesce("reason", F.lit(""))
    of_item = F.array_compact(F.array(
        say((status == "VERIFIED") & blank(F.col("ref_id")), "B", 2, F.col("pos"), F.concat(F.lit("VERIFIED '"), term, F.lit("' has no row in either dictionary"))),
        say((status == "FINGERSPELL_CANDIDATE") & ~F.coalesce("spelled", F.lit(False)), "B", 2, F.col("pos"), F.concat(F.lit("FINGERSPELL_CANDIDATE '"), term, F.lit("' is not fully resolved to letters"))),
        say(status.isin("UNSUPPORTED", "REVIEW_REQUIRED"), "R", 2, F.col("pos"), F.concat(F.lit("'"), term, F.lit("' "), status, F.lit(": "), why)),
    ))
    # reasons and counts of a document in one pass on either side; rows without a reason collect nothing
    said = lambda x: F.flatten(F.collect_list(F.when(F.size(x) > 0, x)))
    counts = spread(u.withColumn("x", of_unit), n, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_units"), F.count_if("_ok").alias("verified_spans"), said(F.col("x")).alias("of_unit"))
    named = (("VERIFIED", "verified_signs"), ("FINGERSPELL_CANDIDATE", "fingerspelled"), ("UNSUPPORTED", "unsupported"), ("REVIEW_REQUIRED", "review_required"))
    by = spread(r.select("doc_id", "status", of_item.alias("x")), n, "doc_id").groupBy("doc_id").agg(*[F.count_if(status == s).alias(c) for s, c in named], said(F.col("x")).alias("of_item"))
    d = counts.join(by, "doc_id", "left").na.fill(0, ["verified_signs", "fingerspelled", "unsupported", "review_required"])
    every = F.when(F.col("doc_id").isNotNull(), F.array_sort(F.when(F.col("of_item").isNull(), F.col("of_unit")).otherwise(F.concat("of_unit", "of_item"))))
    lines = lambda kind: F.transform(F.filter("_every", lambda x: x["kind"] == kind), lambda x: x["what"])
    d = d.withColumn("_every", every).withColumns({"blocking": lines("B"), "review": lines("R")}).drop("_every", "of_unit", "of_item")
    none = F.array().cast("array<string>")
    d = d.withColumn("blocking", F.coalesce("blocking", none)).withColumn("review", F.coalesce("review", none))
    return d.withColumn("overall", F.when(F.size("blocking") > 0, "BLOCKED").when(F.size("review") > 0, "REVIEW_REQUIRED").when(F.col("fingerspelled") > 0, "PASS_WITH_FALLBACK").otherwise("PASS"))


def trace_line(status: Column, fallback: Column, source: Column, method: Column, term: Column, label: Column, concept: Column, sentence: Column, span: Column, stem: Column) -> Column:
    """One row of the trace table; a null reads as nothing, a fallback stands in brackets behind the status."""
    s = lambda c: F.coalesce(c, F.lit(""))
    decision = F.concat(s(status), F.when(s(fallback) != "", F.concat(F.lit(" ("), fallback, F.lit(")"))).otherwise(""))
    cells = [F.concat(F.lit("`"), s(stem), F.lit("`")), decision, s(source), s(method), s(term), s(label), s(concept), s(sentence), F.concat(F.lit('"'), s(span), F.lit('"'))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


TRACE_HEAD = ("| Segment | Decision | Source | Method | Term | Label | Concept | Sentence | Span |", "|---|---|---|---|---|---|---|---|---|")


def trace_markdown(rows: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One Markdown table per key, its rows in order."""
    body = F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(key).agg(body.alias("b")).select(key, F.concat_ws("\n", F.concat(F.array(*map(F.lit, TRACE_HEAD)), "b", F.array(F.lit("")))).alias("markdown"))


def stage_counts(concepts: DataFrame, plans: DataFrame, units: DataFrame) -> DataFrame:
    """What a run's stages leave: concepts, those with a verified span, plan items, units whose plan is fine.

    concepts: verified. plans: plan (array). units: plan_status.
    """
    a = concepts.agg(F.count(F.lit(1)).alias("concepts"), F.count_if("verified").alias("verified_concepts"))
    b = plans.agg(F.coalesce(F.sum(F.greatest(F.size("plan"), F.lit(0))), F.lit(0)).cast("long").alias("plan_items"))
    c = units.agg(F.count_if(F.col("plan_status") == "OK").alias("units_ok"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
