"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base patterns and looser ones propose candidate spans. Five labelers (format, gazetteer, context, boundary, shape) vote
yes, no or nothing on each. Expectation-maximisation over the counts of vote patterns estimates how reliable every labeler
is for every kind, and so how likely each pattern is personal data; a logistic span classifier is then fitted to those
soft labels over the votes and the span's surroundings, counted once per distinct combination, and decides on the
candidates that the base rules do not already settle. The driver sees only those counts: at most a few thousand rows, by
the number of feature values, however many documents there are.

Matches and gaps come from splitting a text at a pattern, so offsets are sums of lengths in code points; patterns use
possessive repeats and look-behind so that long runs neither recurse nor take quadratic time.

Defined results: null text counts as empty and has no spans; repeated rows are documents of their own; an empty table
gives an empty result; extra columns are ignored by find() and kept by redact().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: The base kinds, in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, is a base pattern, Java pattern). \G lets a match begin right after the one before.
PATTERNS = [
    ("email", True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++"),
    ("phone", False, r"(?<![0-9.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("secret", False, r"(?i)(?<![a-z0-9])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd|pwd)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_-]{12,}+"),
]
#: Gazetteers: ends of mail domains, prefixes of card issuers, country codes, networks without owners.
MAIL_ENDS = ["com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "us", "ca"]
CARD_STARTS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|62|30[0-5]|3[689])"
COUNTRY_CODES = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NO_OWNER = r"^(0|10|127|169\.254|192\.168|255|172\.(1[6-9]|2[0-9]|3[01]))\."
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)(e-?mail|mailto|contact|write|reach|address|correo|courriel|kontakt)",
    "ip": r"(?i)(\bip\b|server|host|addr|login|client|peer)",
    "card": r"(?i)(card|visa|master|amex|credit|debit|account|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|contact|ruf)",
    "secret": r"(?i)(key|token|secret|pass|auth|login|config|export)",
}
LABELERS = ("format", "gazetteer", "context", "boundary", "shape")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))),
        F.lit(0),
        lambda a, v: (a + v).cast("int"),
    )
    return total % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    """The check that a base match of its kind must pass."""
    d = _digits(m)
    parts_ok = F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", parts_ok)
        .when(kind == "card", F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
        .when(kind == "phone", F.length(d).between(9, 15))
        .otherwise(F.lit(False))
    )


def _matches(text: Column, kind: str, base: bool, pattern: str) -> Column:
    """All matches of one pattern as array of struct(pattern, idx, gap before, match, text before, character after)."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    quick = {"email": F.contains(text, F.lit("@")) if base else text.rlike(r"(?i)[(\[]at[)\]]"), "secret": text.rlike("[:=]")}.get(kind, text.rlike("[0-9]"))
    out = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"), F.slice(pieces, F.lit(2), F.size(found)).alias("q")),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("idx"), F.length(z["p"]).alias("gap"), z["m"].alias("m"), F.right(z["p"], F.lit(32)).alias("before"), F.left(z["q"], F.lit(1)).alias("after")),
    )
    return F.when(quick, out).otherwise(F.array().cast("array<struct<kind:string,base:boolean,idx:int,gap:int,m:string,before:string,after:string>>"))


def _votes(c: DataFrame) -> DataFrame:
    """The labelers' votes 1, -1 or 0, and the surroundings that the classifier also sees."""
    kind, m = F.col("kind"), F.col("m")
    d = F.substring(_digits(m), 1, 32)
    ok, alnum_after = F.col("ok"), F.col("after").rlike("[A-Za-z0-9]")
    alnum_before = F.col("before").rlike("[A-Za-z0-9]$")
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    strict = F.when(F.col("base"), ok).when(kind == "email", m.rlike(r"(?i)[(\[]dot[)\]]|\.[a-z]{2,}$")).when(kind == "phone", F.length(d) == 10).otherwise(m.rlike("[0-9]") & (F.length(m) >= 20))
    end = F.lower(F.element_at(F.split(F.right(m, F.lit(64)), r"[.\x20)\]]"), -1))
    gazetteer = (
        F.when(kind == "email", sign(end.isin(MAIL_ENDS), ~end.rlike("^[a-z]{2,}$")))
        .when(kind == "ip", sign(~m.rlike(NO_OWNER), m.rlike(NO_OWNER)))
        .when(kind == "card", sign(d.rlike(CARD_STARTS), ~d.rlike(CARD_STARTS)))
        .when(kind == "phone", sign(d.rlike(COUNTRY_CODES), F.lit(not COUNTRY_CODES)))
        .otherwise(sign(m.rlike("[0-9a-fA-F]{16,}$"), m.rlike("(?i)(example|changeme|placeholder|x{6,})")))
    )
    context = F.lit(0)
    for k, words in CONTEXT.items():
        context = F.when(kind == k, sign(F.col("before").rlike(words), F.col("before").rlike(r"[0-9][.,\x20-]?$"))).otherwise(context)
    boundary = sign(~(alnum_before | alnum_after), alnum_before & alnum_after)
    one_digit = (F.length(d) > 3) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) <= 1)
    shape = F.when(kind.isin("card", "phone"), sign(F.regexp_count(m, F.lit(r"[\x20().-]")).between(2, 6), one_digit)).when(kind == "ip", sign(m.rlike(r"^[1-9]"), m.rlike(r"(^|\.)0[0-9]"))).otherwise(sign(F.length(m).between(6, 120), F.length(m) > 254))
    return c.select(
        "*",
        sign(strict, ~strict).alias("format"), gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"), boundary.alias("boundary"), shape.cast("int").alias("shape"),
        F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("int").alias("f_length"),
        F.when(F.col("before") == "", 0).when(F.col("before").rlike(r"\s$"), 1).when(alnum_before, 2).otherwise(3).cast("int").alias("f_before"),
        F.when(F.col("after") == "", 0).when(F.col("after").rlike(r"\s"), 1).when(alnum_after, 2).otherwise(3).cast("int").alias("f_after"),
    )


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> tuple[dict, dict]:
    """EM over (kind, votes, count): each labeler's chances of each vote when it is and is not personal data.

    Returns {(kind, votes): probability} and {(kind, labeler): (P(yes|true), P(no|true), P(yes|false), P(no|false))}.
    Counts are smoothed by one, so an unseen vote is never impossible.
    """
    post = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _ in patterns}
    table: dict = {}
    for _ in range(rounds):
        prior: dict = {}
        table = {}
        for k, v, n in patterns:
            p = post[k, v]
            t, f = prior.get(k, (1.0, 1.0))
            prior[k] = (t + n * p, f + n * (1 - p))
            for j, vote in enumerate(v):
                row = table.setdefault((k, j), {(s, y): 1.0 + (y == s) for s in (1, -1) for y in (1, -1, 0)})
                row[1, vote] += n * p
                row[-1, vote] += n * (1 - p)
        chance = {kj: {(s, y): row[s, y] / sum(row[s, x] for x in (1, -1, 0)) for s in (1, -1) for y in (1, -1, 0)} for kj, row in table.items()}
        for k, v, _ in patterns:
            t, f = (math.log(x / sum(prior[k])) for x in prior[k])
            for j, vote in enumerate(v):
                t += math.log(chance[k, j][1, vote])
                f += math.log(chance[k, j][-1, vote])
            post[k, v] = 1 / (1 + math.exp(max(-50.0, min(50.0, f - t))))
    return post, {(k, LABELERS[j]): tuple(round(c[s, y], 6) for s in (1, -1) for y in (1, -1)) for (k, j), c in chance.items()} if patterns else {}


def fit_classifier(rows: list[tuple[list[tuple[str, object]], float, float]], rounds: int = 150, rate: float = 1.0) -> dict[tuple[str, object], float]:
    """Logistic weights of indicator features from (features, soft label, count), by full gradient steps with momentum."""
    weights: dict = {("bias", 0): 0.0} | {f: 0.0 for fs, _, _ in rows for f in fs}
    speed = dict.fromkeys(weights, 0.0)
    total = sum(math.sqrt(n) for _, _, n in rows) or 1.0
    for _ in range(rounds):
        grad = {f: 0.002 * w for f, w in weights.items()}
        for fs, label, n in rows:
            z = weights["bias", 0] + sum(weights[f] for f in fs)
            g = (1 / (1 + math.exp(max(-50.0, min(50.0, -z)))) - label) * math.sqrt(n) / total
            grad["bias", 0] += g
            for f in fs:
                grad[f] += g
        for f in weights:
            speed[f] = 0.9 * speed[f] - rate * grad[f]
            weights[f] += speed[f]
    return weights


FEATURES = (*LABELERS, "f_length", "f_before", "f_after")


def candidates(docs: DataFrame, owner: str = "pii", keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a row number and the matches c of every document (and what `keep` says), and its candidate spans with votes; both stored."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    found = F.flatten(F.array(*[_matches(text, *p) for p in PATTERNS]))
    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("`doc_id`").alias("doc_id"), found.alias("c"), *([] if keep is None else [keep])), "pii-matches", owner)
    c = rows.select("rid", F.explode("c").alias("c")).select("rid", "c.*")
    order = W.partitionBy("rid", "kind", "base").orderBy("idx")
    c = c.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    c = c.withColumn("start", F.col("end") - F.length("m")).withColumn("ok", F.when(F.col("base"), valid(F.col("kind"), F.col("m"))).otherwise(False))
    spans = _votes(c).select("rid", "kind", "base", "start", "end", "ok", *FEATURES)
    return rows, common.stored(spans, "pii-spans", owner)


def train(spans: DataFrame) -> tuple[dict, dict]:
    """(weights of the span classifier, reliabilities of the labelers), from counts of the distinct feature combinations."""
    counts = [(r.kind, tuple(getattr(r, f) for f in FEATURES), r.n) for r in spans.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()]
    votes: dict = {}
    for k, v, n in counts:
        key = k, v[: len(LABELERS)]
        votes[key] = votes.get(key, 0) + n
    post, reliable = reliabilities([(k, v, n) for (k, v), n in sorted(votes.items())])
    rows = [([("kind", k), *[(f"{k}.{f}", x) for f, x in zip(FEATURES, v, strict=True)]], post[k, v[: len(LABELERS)]], n) for k, v, n in sorted(counts)]
    return fit_classifier(rows), reliable


def probability(weights: dict) -> Column:
    z = F.lit(float(weights["bias", 0]))
    for k in KINDS:
        part = F.lit(float(weights.get(("kind", k), 0.0)))
        for f in FEATURES:
            values = sorted((x, w) for (name, x), w in weights.items() if name == f"{k}.{f}")
            step = F.lit(0.0)
            for x, w in values:
                step = F.when(F.col(f) == x, F.lit(float(w))).otherwise(step)
            part = part + step
        z = z + F.when(F.col("kind") == k, part).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, threshold: float = 0.5, owner: str = "pii") -> DataFrame:
    """rid, doc_id and spans: array of struct(start, order, kind, end, base) by start, then kind as listed, for every document.

    Valid base matches always stay; other candidates join them if the classifier gives at least threshold and they touch
    no base span.
    """
    rows, spans = candidates(docs, owner)
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,base:boolean>>")
    return rows.select("rid", "doc_id").join(decided(spans, threshold), "rid", "left").select("rid", "doc_id", F.coalesce("spans", empty).alias("spans"))


def decided(spans: DataFrame, threshold: float) -> DataFrame:
    """rid, spans of the documents that have candidate spans."""
    weights, _ = train(spans)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    kept = spans.where(F.col("ok") | (~F.col("base") & (probability(weights) >= threshold)))
    per = kept.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end", F.col("ok").alias("base")))).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    free = F.filter("s", lambda x: x["base"] | ~F.exists(F.col("b"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return per.withColumn("b", base).select("rid", free.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5, owner: str = "pii") -> DataFrame:
    """The documents with every span's text replaced by its kind in angle brackets; overlapping spans become one.

    Only documents with candidate spans meet their spans in a join; the others pass where they lie.
    """
    columns = docs.columns
    rows, spans = candidates(docs, owner, keep=F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"))
    kept = rows.select(F.col("rid").alias("__rid"), "__row", (F.size("c") > 0).alias("__some"))
    found = decided(spans, threshold).select(F.col("rid").alias("doc_id"), "spans")
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,kind:string,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (x["start"] < F.get(a, F.size(a) - 1)["end"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.get(a, F.size(a) - 1)["kind"].alias("kind"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))),
    )
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__rid"), merged.alias("__m"))
    text = F.col("__row.text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("__m")),
        lambda i: F.concat(
            F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(F.get(F.col("__m"), i - 1)["kind"]), F.lit(">"))),
            F.substr(text, F.coalesce(F.get(F.col("__m"), i - 1)["end"], F.lit(0)).cast("int") + 1, F.coalesce(F.get(F.col("__m"), i)["start"], F.length(text).cast("long")).cast("int") - F.coalesce(F.get(F.col("__m"), i - 1)["end"], F.lit(0)).cast("int")),
        ),
    )
    clear = kept.where("not __some").select(*[F.col("__row")[c].alias(c) for c in columns])
    d = kept.where("__some").join(spans, "__rid", "left").withColumn("__new", F.when(F.col("__m").isNull(), text).otherwise(F.array_join(pieces, "")))
    return clear.unionByName(d.select(*[(F.col("__new") if c == "text" else F.col("__row")[c]).alias(c) for c in columns]))
