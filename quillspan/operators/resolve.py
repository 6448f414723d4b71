"""Resolving terms against an ordered dictionary through prioritised layers.

All layers are computed for all distinct items as equi-joins and one CASE takes the first success, so nothing runs row at a
time. Catalog columns: ord, id, word_en, word_ar, category, has_video. Order is data: of several rows with one key the one
with the smallest ord wins. Model decisions (selector, translation) come in as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

POLYSEMOUS = ["Directions and Locations"]
ROW = "ord", "id", "word_en", "category", "has_video"


def _row() -> Column:
    return F.struct(*[F.col(c) for c in ROW])


def english_keys(catalog: DataFrame) -> DataFrame:
    """key, row: the first row of each lower-cased English label."""
    k = F.lower(text.strip(F.col("word_en")))
    return catalog.where(F.coalesce("word_en", F.lit("")) != "").groupBy(k.alias("key")).agg(F.min_by(_row(), "ord").alias("row"))


def arabic_keys(catalog: DataFrame) -> DataFrame:
    k = text.normalize_ar(F.col("word_ar"))
    return catalog.where(F.coalesce("word_ar", F.lit("")) != "").groupBy(k.alias("key")).agg(F.min_by(_row(), "ord").alias("row"))


def exact(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """item, exact: struct(row, method), by the English key first, then the Arabic one."""
    en, ar = english_keys(catalog).withColumnRenamed("row", "en"), arabic_keys(catalog).withColumnRenamed("row", "ar")
    d = items.select("item", F.lower(text.strip(F.col("item"))).alias("_e"), text.normalize_ar(F.col("item")).alias("_a"))
    d = d.join(en, d["_e"] == en["key"], "left").drop("key")
    d = d.join(ar, d["_a"] == ar["key"], "left").drop("key")
    hit = F.when(F.col("en").isNotNull(), F.struct(F.col("en").alias("row"), F.lit("EXACT_EN").alias("method"))).when(F.col("ar").isNotNull() & (F.col("_a") != ""), F.struct(F.col("ar").alias("row"), F.lit("EXACT_AR").alias("method")))
    return d.where(F.col("en").isNotNull() | F.col("ar").isNotNull()).select("item", hit.alias("exact"))


def tried_forms(item: Column) -> Column:
    """array of struct(rank, token, form, safe) that morphology looks up: token by token, plural forms before -ing/-ed forms, then the whole word."""
    whole = F.lower(text.strip(item))
    toks = text.tokens_en(item)
    toks = F.when(F.size(toks) > 0, toks).otherwise(F.array(whole))
    single = ~whole.rlike(r"\s")

    def forms(word, pos):
        tier = lambda f, t: F.transform(f, lambda x, i: F.struct((pos * 100 + t * 10 + i).cast("int").alias("rank"), word.alias("token"), x.alias("form"), F.lit(t == 0).alias("safe")))
        return F.concat(tier(text.safe_forms(word), 0), tier(text.risky_forms(word), 1))

    per_token = F.flatten(F.transform(toks, lambda t, i: forms(t, i)))
    tried = F.when(single, F.concat(per_token, forms(whole, F.lit(10_000)))).otherwise(per_token)
    return F.filter(tried, lambda x: x["form"].isNotNull() & (~x["safe"] | (x["form"] != x["token"])))


def alias_keys(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, row: the catalog row of the first alias with the key; aliases (ord, catalog_id, alias) of unknown rows do not count."""
    known = aliases.join(catalog.select(F.col("id").alias("catalog_id"), _row().alias("row")), "catalog_id")
    both = F.array(F.lower(text.strip(F.col("alias"))), text.normalize_ar(F.col("alias")))
    return known.select("ord", "row", F.explode(F.array_distinct(both)).alias("key")).where("key <> ''").groupBy("key").agg(F.min_by("row", "ord").alias("row"))


def layers(items: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """item, exact, morph, alias, clitic of the items that any of these layers finds, by one join of all their keys.

    Every layer's best row is the one of the smallest rank among its own keys.
    """
    item = F.col("item")
    low, norm = F.lower(text.strip(item)), text.normalize_ar(item)
    none = F.lit(None)

    def key(layer, rank, names, k, token=none, form=none, safe=none):
        return F.struct(F.lit(layer).alias("layer"), rank.cast("int").alias("rank"), F.lit(names).alias("names"), k.alias("key"), token.cast("string").alias("token"), form.cast("string").alias("form"), safe.cast("boolean").alias("safe"))

    zero, one = F.lit(0), F.lit(1)
    fixed = F.array(key("E", zero, "e", low), key("E", one, "a", norm), key("A", zero, "l", low), key("A", one, "l", norm))
    forms = F.transform(tried_forms(item), lambda x: key("M", x["rank"], "e", x["form"], x["token"], x["form"], x["safe"]))
    clitics = F.transform(text.clitic_forms(norm), lambda x, i: key("C", i, "a", x, form=x))
    asked = items.select("item", F.explode(F.concat(fixed, forms, clitics)).alias("k")).select("item", "k.*").where("key <> ''")
    named = lambda d, n: d.select(F.lit(n).alias("names"), "key", "row")
    dictionary = named(english_keys(catalog), "e").unionByName(named(arabic_keys(catalog), "a"))
    if aliases is not None:
        dictionary = dictionary.unionByName(named(alias_keys(catalog, aliases), "l"))
    best = lambda layer, c: F.min_by(c, F.when(F.col("layer") == layer, F.col("rank")))
    method = F.when(F.col("rank") == 0, "EXACT_EN").otherwise("EXACT_AR")
    return asked.join(dictionary, ["names", "key"]).groupBy("item").agg(
        best("E", F.struct("row", method.alias("method"))).alias("exact"), best("M", F.struct("row", F.when(F.col("safe"), "MORPHOLOGY_EN").otherwise("MORPHOLOGY_CANDIDATE").alias("method"), "token", "form")).alias("morph"),
        best("A", F.col("row")).alias("alias"), best("C", F.struct("row", "form")).alias("clitic"),
    )


def morphology(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """item, morph: struct(row, method, token, form) of the items that a reduced form finds."""
    return layers(items, catalog).where("morph is not null").select("item", "morph")


def alias(items: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """item, alias: the catalog row of the first alias, by the English key first, then the Arabic one."""
    return layers(items, catalog, aliases).where("alias is not null").select("item", "alias")


def clitic(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """item, clitic: struct(row, form) of the first form without its leading clitic that is an Arabic label."""
    return layers(items, catalog).where("clitic is not null").select("item", "clitic")


def token_set(word_en: Column, word_ar: Column) -> Column:
    """The English and Arabic tokens of a label, each once, marked by language and sorted."""
    tag = lambda a, t: F.transform(F.array_distinct(a), lambda x: F.concat(F.lit(t), x))
    return F.array_sort(F.concat(tag(text.tokens_en(F.coalesce(word_en, F.lit(""))), "e:"), tag(text.tokens_ar(F.coalesce(word_ar, F.lit(""))), "a:")))


#: Tokens up to which a label is matched by pairs of its tokens; a longer one by each of its tokens.
SHORT = 32


def _pairs(tokens: Column) -> Column:
    """Every two tokens of a sorted set as one text."""
    return F.flatten(F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: F.concat(x, F.lit("\n"), y))))


def top_overlaps(items: DataFrame, catalog: DataFrame, top: int) -> DataFrame:
    """item, rank, row, score: for each item the `top` rows with most shared tokens, dictionary order on ties, exactly.

    Rows with equal token sets score alike, so of each set only the first `top` rows count; items with equal sets are one
    query. Rows that share two tokens or more are found by pairs of tokens, their score by the number of pairs. A row that
    shares one token is needed only if fewer than `top` rows share more, so it is among the first 2 * top rows of its token:
    a list of that length is kept of each token, and a token that stands in every row costs no more than that. Labels of more
    than SHORT tokens have too many pairs and are matched by each token.
    """
    asked = items.select("item", token_set(F.col("item"), F.col("item")).alias("q")).where(F.size("q") > 0)
    queries = asked.select("q").distinct()
    rows = catalog.select(F.col("ord"), _row().alias("row"), token_set(F.col("word_en"), F.col("word_ar")).alias("t")).where(F.size("t") > 0)
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("t").orderBy("ord"))).where(F.col("_n") <= top).drop("_n")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, "k").groupBy("q", "ord").agg(F.count(F.lit(1)).alias("c"))

    each = lambda d, tokens, *keep: d.select(*keep, F.explode(tokens).alias("k"))
    short_q, long_q = queries.where(F.size("q") <= SHORT), queries.where(F.size("q") > SHORT)
    short_r, long_r = rows.where(F.size("t") <= SHORT), rows.where(F.size("t") > SHORT)
    listed = each(short_r, "t", "ord").withColumn("_n", F.row_number().over(W.partitionBy("k").orderBy("ord"))).where(F.col("_n") <= 2 * top).drop("_n")
    one = each(short_q, "q", "q").join(listed, "k").select("q", "ord", F.lit(1).cast("long").alias("score")).distinct()
    more = meet(each(short_q, _pairs(F.col("q")), "q"), each(short_r, _pairs(F.col("t")), "ord"))
    more = more.select("q", "ord", F.floor((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).alias("score"))
    plain = meet(each(queries, "q", "q"), each(long_r, "t", "ord")).unionByName(meet(each(long_q, "q", "q"), each(short_r, "t", "ord"))).withColumnRenamed("c", "score")
    scored = one.unionByName(more).unionByName(plain).groupBy("q", "ord").agg(F.max("score").alias("score"))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= top)
    return asked.join(best, "q").join(rows.select("ord", "row"), "ord").select("item", "rank", "row", "score")


def candidates(items: DataFrame, catalog: DataFrame, top: int = 5) -> DataFrame:
    """item, rank, row, score of the best rows, dictionary order on ties."""
    return top_overlaps(items, catalog, top)


def inventory(items: DataFrame, sources: list[tuple[str, DataFrame]], top: int = 12) -> DataFrame:
    """item, rank, label, source, score over several dictionaries; on equal scores the earlier dictionary comes first."""
    parts = [top_overlaps(items, c, top).select("item", "score", F.lit(i).alias("s"), F.lit(name).alias("source"), F.col("row.ord").alias("ord"), F.col("row.word_en").alias("label")) for i, (name, c) in enumerate(sources)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    order = W.partitionBy("item").orderBy(F.desc("score"), "s", "ord")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "label", "source", "score")


def resolve(items: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, selector: DataFrame | None = None, supplementary: DataFrame | None = None, terminology: DataFrame | None = None, alphabet: DataFrame | None = None, top: int = 5) -> DataFrame:
    """One row per distinct item: status, match_method, catalog_id, word, information_loss, render_source, n_candidates, review_required.

    items: item, and optionally source_arabic. selector: item, selected_id. terminology: item, arabic_term (already gated).
    alphabet: letter. supplementary: a catalog of its own; its first row of a label counts only if has_video (candidates
    of that layer, and what supports a primary sign: episode.supplementary and episode.supporting).
    """
    d = items.select("item", (F.col("source_arabic") if "source_arabic" in items.columns else F.lit(False)).alias("source_arabic")).distinct()
    only = d.select("item")
    none = F.lit(None)
    out = d.join(layers(only, catalog, aliases), "item", "left")
    found = candidates(only, catalog, top).groupBy("item").agg(F.collect_list(F.struct("rank", "row")).alias("c"))
    out = out.join(found, "item", "left")
    demoted = F.col("exact.method").eqNullSafe("EXACT_EN") & F.col("exact.row.category").isin(POLYSEMOUS)
    item = F.col("item")
    loss_m, loss_c = text.information_loss(item, F.col("morph.row.word_en")), text.information_loss(item, F.col("clitic.row.word_en"))
    safe = F.col("morph.method").eqNullSafe("MORPHOLOGY_EN") & (loss_m != "ESSENTIAL_INFORMATION_LOSS")
    listed = F.transform(F.array_sort(F.coalesce("c", F.array().cast(found.schema["c"].dataType))), lambda x: x["row"])
    extra = F.filter(F.array(F.when(demoted, F.col("exact.row")), F.when(F.col("morph.method") == "MORPHOLOGY_CANDIDATE", F.col("morph.row"))), lambda x: x.isNotNull())
    out = out.withColumn("_cands", F.array_distinct(F.concat(extra, listed)))
    hit = (
        F.when(F.col("exact").isNotNull() & ~demoted, F.struct(F.col("exact.row").alias("row"), F.col("exact.method").alias("method"), F.lit("FULL").alias("loss")))
        .when(safe, F.struct(F.col("morph.row").alias("row"), F.lit("MORPHOLOGY_EN").alias("method"), loss_m.alias("loss")))
        .when(F.col("alias").isNotNull(), F.struct(F.col("alias").alias("row"), F.lit("ALIAS").alias("method"), F.lit("FULL").alias("loss")))
        .when(F.col("clitic").isNotNull() & (loss_c != "ESSENTIAL_INFORMATION_LOSS"), F.struct(F.col("clitic.row").alias("row"), F.lit("CLITIC_AR").alias("method"), loss_c.alias("loss")))
    )
    out = out.withColumn("hit", hit)
    if selector is not None:
        out = out.join(selector.select("item", "selected_id"), "item", "left")
        chosen = F.get(F.filter("_cands", lambda x: x["id"] == F.col("selected_id")), F.lit(0))
        out = out.withColumn("_chosen", chosen)
        loss = text.information_loss(item, F.col("_chosen.word_en"))
        good = F.col("_chosen").isNotNull() & F.col("_chosen.has_video") & ~loss.isin("ESSENTIAL_INFORMATION_LOSS", "AMBIGUOUS")
        out = out.withColumn("hit", F.coalesce("hit", F.when(good, F.struct(F.col("_chosen").alias("row"), F.lit("CANDIDATE_SELECTED").alias("method"), loss.alias("loss")))))
    out = out.withColumn("render_source", F.when(F.col("hit").isNotNull(), "PRIMARY"))
    if supplementary is not None:
        extra_hit = exact(only, supplementary).where("exact.row.has_video").select("item", F.col("exact.row").alias("_s"))
        out = out.join(extra_hit, "item", "left")
        out = out.withColumn("render_source", F.coalesce("render_source", F.when(F.col("_s").isNotNull(), "SUPPLEMENTARY")))
        out = out.withColumn("hit", F.coalesce("hit", F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("row"), F.lit("SUPPLEMENTARY_EXACT").alias("method"), F.lit("FULL").alias("loss")))))
    drift = F.col("source_arabic") & (text.strip(item) != "") & ~text.is_arabic(item)
    out = out.withColumn("review", F.lit(False))
    term = F.when(text.is_arabic(item) | F.col("source_arabic"), item)
    if terminology is not None:
        out = out.join(terminology.select("item", "arabic_term"), "item", "left")
        term = F.coalesce(term, F.col("arabic_term"))
    out = out.withColumn("_term", F.when(F.col("hit").isNull() & ~drift, term))
    if terminology is not None:
        second = exact(out.select(F.col("_term").alias("item")).where("item is not null").distinct(), catalog).where("exact.row.has_video").select(F.col("item").alias("_term"), F.col("exact.row").alias("_t"))
        out = out.join(second, "_term", "left").withColumn("review", F.col("_t").isNotNull())
        out = out.withColumn("render_source", F.coalesce("render_source", F.when(F.col("_t").isNotNull(), "PRIMARY")))
        out = out.withColumn("hit", F.coalesce("hit", F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("row"), F.lit("EXACT_AR_VIA_TERMINOLOGY").alias("method"), F.lit("FULL").alias("loss")))))
    spelled = F.lit(None).cast("boolean")
    if alphabet is not None:
        letters = out.select("item", F.explode(text.letters(F.col("_term"))).alias("letter")).join(alphabet.select("letter", F.lit(True).alias("ok")).distinct(), "letter", "left")
        out = out.join(letters.groupBy("item").agg(F.every(F.coalesce("ok", F.lit(False))).alias("_spelled")), "item", "left")
        spelled = F.col("_spelled")
    status = (
        F.when(F.col("hit").isNotNull(), "VERIFIED").when(drift | F.col("_term").isNull(), "REVIEW_REQUIRED")
        .when(F.coalesce(spelled, F.lit(False)), "FINGERSPELL_CANDIDATE").otherwise("UNSUPPORTED")
    )
    return out.select(
        "item", status.alias("status"), F.col("hit.method").alias("match_method"), F.col("hit.row.id").alias("catalog_id"), F.col("hit.row.word_en").alias("word"), F.col("hit.loss").alias("information_loss"),
        F.coalesce("render_source", F.lit("FINGERSPELL")).alias("render_source"), F.size("_cands").cast("long").alias("n_candidates"), (F.col("review") | (status == "REVIEW_REQUIRED") | (status == "UNSUPPORTED")).alias("review_required"),
    )


def coverage(resolutions: DataFrame) -> DataFrame:
    """Counts by status and loss with percentages to one digit; zero on an empty table. A null loss counts as FULL."""
    verified = F.col("status") == "VERIFIED"
    loss = F.coalesce("information_loss", F.lit("FULL"))
    n = resolutions.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(verified).alias("verified"), F.count_if(verified & (loss == "FULL")).alias("full_match"), F.count_if(verified & (loss == "CORE_WITH_MODIFIER_LOSS")).alias("partial_match"),
        F.count_if(F.col("status") == "FINGERSPELL_CANDIDATE").alias("fingerspelled"), F.count_if(F.col("status") == "UNSUPPORTED").alias("unsupported"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review"),
    )
    return n.select("*", *[text.percent(F.col(c), F.col("total")).alias(f"pct_{c}") for c in ("verified", "full_match", "partial_match", "fingerspelled", "unsupported", "review")])
