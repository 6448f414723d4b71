"""The layered resolver bound to part names: a dictionary of all names and some nouns, and mutated names as items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import resolve as r
from ..operators import series
from .base import query, sql_list, table

_CATALOG = """catalog AS (SELECT CAST(row_number() OVER (ORDER BY w) - 1 AS INT) AS ord, w AS word_en, 'c' || CAST(row_number() OVER (ORDER BY w) - 1 AS VARCHAR) AS id, CASE WHEN w LIKE '%a%' THEN 'Directions and Locations' ELSE 'Things' END AS category
FROM (SELECT DISTINCT p_name w FROM part UNION SELECT unnest(['ring', 'bolt', 'gear'])))"""
_ITEMS = """items AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' WHEN 3 THEN 'very ' || p_name WHEN 4 THEN split_part(p_name, ' ', 2) || 's' ELSE split_part(p_name, ' ', 2) || 'ing' END AS item FROM part)"""
_MODS = sql_list(text.MODIFIERS)
_TOK = f"list_filter(regexp_extract_all(lower(item), '[a-z'']+'), lambda x: x NOT IN ({sql_list(text.STOP_WORDS)}))"


def _loss(word: str) -> str:
    w, c = "regexp_extract_all(lower(item), '[a-z'']+')", f"list_append(regexp_extract_all(lower({word}), '[a-z'']+'), lower({word}))"
    content, mods = f"list_filter({w}, lambda x: x NOT IN ({_MODS}))", f"list_filter({w}, lambda x: x IN ({_MODS}))"
    return f"CASE WHEN len({w}) = 0 THEN 'AMBIGUOUS' WHEN len({mods}) = 0 OR len({content}) = 0 THEN 'FULL' WHEN list_has_any({content}, {c}) THEN 'CORE_WITH_MODIFIER_LOSS' WHEN list_has_any({mods}, {c}) THEN 'ESSENTIAL_INFORMATION_LOSS' ELSE 'AMBIGUOUS' END"


def _forms(w: str, rank: str) -> str:
    one = [
        (0, f"CASE WHEN ends_with({w}, 'ies') AND length({w}) > 4 THEN left({w}, -3) || 'y' END"), (1, f"CASE WHEN ends_with({w}, 'es') AND length({w}) > 3 THEN left({w}, -2) END"), (2, f"CASE WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') AND length({w}) > 3 THEN left({w}, -1) END"),
        (10, f"CASE WHEN ends_with({w}, 'ing') AND length({w}) > 5 THEN left({w}, -3) END"), (11, f"CASE WHEN ends_with({w}, 'ing') AND length({w}) > 5 THEN left({w}, -3) || 'e' END"), (12, f"CASE WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN left({w}, -2) END"), (13, f"CASE WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN left({w}, -1) END"),
    ]
    return "[" + ", ".join(f"{{'rank': ({rank}) * 100 + {n}, 'form': {e}}}" for n, e in one) + "]"


_RESOLVED = f"""{_CATALOG}, {_ITEMS}, di AS (SELECT DISTINCT item FROM items), ti AS (SELECT item, CASE WHEN len({_TOK}) > 0 THEN {_TOK} ELSE [lower(item)] END t FROM di),
tk AS (SELECT item, unnest(t) w, unnest(range(0, len(t))) p FROM ti UNION ALL SELECT item, lower(item), 100 FROM di WHERE NOT contains(item, ' ')),
fm AS (SELECT item, unnest({_forms("w", "p")}) f FROM tk), mh AS (SELECT item, arg_min(c, f.rank) row, min(f.rank) rank FROM fm JOIN catalog c ON lower(c.word_en) = f.form WHERE f.form IS NOT NULL GROUP BY item),
it AS (SELECT item, unnest(list_distinct({_TOK})) t FROM di), ct AS (SELECT ord, id, word_en, unnest(list_distinct(list_filter(regexp_extract_all(lower(word_en), '[a-z'']+'), lambda x: x NOT IN ({sql_list(text.STOP_WORDS)})))) t FROM catalog),
sc AS (SELECT item, ord, id, word_en, count(*) score FROM it JOIN ct USING (t) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, ord) rank FROM sc), cd AS (SELECT item, id, rank FROM rk WHERE rank <= 5),
al AS (SELECT item, e.id eid, e.word_en ew, e.category ec, m.row.id mid, m.row.word_en mw, m.rank % 100 < 10 safe, m.row IS NOT NULL has_m FROM di LEFT JOIN catalog e ON lower(e.word_en) = lower(trim(item)) LEFT JOIN mh m USING (item)),
ex AS (SELECT item, eid id FROM al WHERE ec = 'Directions and Locations' UNION SELECT item, mid FROM al WHERE has_m AND NOT safe), nc AS (SELECT item, count(*) n FROM (SELECT item, id FROM cd UNION SELECT item, id FROM ex) GROUP BY item),
ls AS (SELECT *, {_loss("mw")} loss FROM al),
res AS (SELECT item, CASE WHEN eid IS NOT NULL AND ec <> 'Directions and Locations' THEN 'EXACT_EN' WHEN has_m AND safe AND loss <> 'ESSENTIAL_INFORMATION_LOSS' THEN 'MORPHOLOGY_EN' END match_method,
CASE WHEN eid IS NOT NULL AND ec <> 'Directions and Locations' THEN ew WHEN has_m AND safe AND loss <> 'ESSENTIAL_INFORMATION_LOSS' THEN mw END word,
CASE WHEN eid IS NOT NULL AND ec <> 'Directions and Locations' THEN 'FULL' WHEN has_m AND safe AND loss <> 'ESSENTIAL_INFORMATION_LOSS' THEN loss END information_loss, coalesce(n, 0) n_candidates FROM ls LEFT JOIN nc USING (item))"""


def catalog_of(spark, sf_dir):
    """A dictionary of distinct names in their order."""
    p = table(spark, sf_dir, "part").select("p_name")
    w = p.union(spark.createDataFrame([("ring",), ("bolt",), ("gear",)], "p_name string")).distinct()
    ordered = series.global_number(w, "p_name", name="ord").select(F.col("ord").cast("int").alias("ord"), F.col("p_name").alias("word_en"))
    return ordered.select("ord", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("id"), "word_en", F.lit(None).cast("string").alias("word_ar"), F.when(F.contains("word_en", F.lit("a")), "Directions and Locations").otherwise("Things").alias("category"), F.lit(True).alias("has_video"))


def items_of(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 6
    noun = F.split_part(n, F.lit(" "), F.lit(2))
    item = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.concat(n, F.lit("s"))).when(k == 3, F.concat(F.lit("very "), n)).when(k == 4, F.concat(noun, F.lit("s"))).otherwise(F.concat(noun, F.lit("ing")))
    return table(spark, sf_dir, "part").select("p_partkey", item.alias("item"))


def _resolved(spark, sf_dir):
    items = items_of(spark, sf_dir)
    return items, r.resolve(items, catalog_of(spark, sf_dir))


@query(f"WITH {_RESOLVED} SELECT p_partkey, item, CASE WHEN match_method IS NOT NULL THEN 'VERIFIED' ELSE 'REVIEW_REQUIRED' END AS status, match_method, word, information_loss, n_candidates FROM items JOIN res USING (item)")
def resolve_items(spark, sf_dir):
    items, found = _resolved(spark, sf_dir)
    return items.join(found, "item").select("p_partkey", "item", "status", "match_method", "word", "information_loss", "n_candidates")


_COUNTS = "count(*) total, count(*) FILTER (WHERE match_method IS NOT NULL) verified, count(*) FILTER (WHERE match_method IS NOT NULL AND information_loss = 'FULL') full_match, count(*) FILTER (WHERE match_method IS NOT NULL AND information_loss = 'CORE_WITH_MODIFIER_LOSS') partial_match, 0::BIGINT fingerspelled, 0::BIGINT unsupported, count(*) FILTER (WHERE match_method IS NULL) review"


@query(f"WITH {_RESOLVED}, n AS (SELECT {_COUNTS} FROM items JOIN res USING (item)) SELECT total, verified, full_match, partial_match, fingerspelled, unsupported, review, " + ", ".join(f"floor({c} * 100.0::DOUBLE / total * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS pct_{c}" for c in ("verified", "full_match", "partial_match", "fingerspelled", "unsupported", "review")) + " FROM n")
def coverage_report(spark, sf_dir):
    items, found = _resolved(spark, sf_dir)
    return r.coverage(items.join(found, "item"))


@query(f"WITH {_RESOLVED} SELECT match_method, information_loss, count(*) AS n FROM items JOIN res USING (item) WHERE match_method IS NOT NULL GROUP BY ALL")
def match_method_counts(spark, sf_dir):
    items, found = _resolved(spark, sf_dir)
    return items.join(found, "item").where("match_method is not null").groupBy("match_method", "information_loss").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RESOLVED} SELECT item, CAST(rank AS INT) AS rank, id, score FROM rk WHERE rank <= 5")
def candidate_topk(spark, sf_dir):
    d = r.candidates(items_of(spark, sf_dir).select("item").distinct(), catalog_of(spark, sf_dir))
    return d.select("item", "rank", F.col("row.id").alias("id"), "score")


@query(f"""WITH {_RESOLVED}, b AS (SELECT item, score, 0 s, 'first' source, ord, word_en FROM sc WHERE ord % 2 = 0 UNION ALL SELECT item, score, 1, 'second', ord, word_en FROM sc WHERE ord % 2 = 1)
SELECT * FROM (SELECT item, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, s, ord) AS INT) AS rank, word_en AS label, source, score FROM b) WHERE rank <= 12""")
def inventory_topk(spark, sf_dir):
    c = catalog_of(spark, sf_dir)
    return r.inventory(items_of(spark, sf_dir).select("item").distinct(), [("first", c.where("ord % 2 = 0")), ("second", c.where("ord % 2 = 1"))])
