"""URL filters: fixed host/path rules, and association rules mined from labelled pages by FP-growth.

A page's basket holds the tokens of its url (scheme, top domain, host labels, path words, extension, query keys) and, for
labelled pages, its class. FP-growth mines the frequent baskets; rules `tokens -> block` and `tokens -> allow` that reach
the support and confidence wanted are kept, unless a shorter rule with the same class says it as surely. An inverted index
from token to rules finds the rules whose tokens a url has all of; the surest one decides.

Defined results: a null url or one without `://` has empty host and path and no tokens, so no rule fits and it is allowed;
repeated rows are judged alike; without labels no rule is mined; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, ALLOW = "class=block", "class=allow"
#: (host, path, verdict); a rule fits its host and all subdomains if the path starts with its path.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    first = F.regexp_extract(url, whole, 1)
    return F.translate(first, _UPPER, _LOWER), F.regexp_extract(url, whole, 2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out.otherwise(F.lit(None))


def url_tokens(url: str | None) -> list[str]:
    m = re.match(r"(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)", url or "", re.S)
    if not m:
        return []
    scheme, host, path, query = m[1].lower(), m[2].lower(), m[3], m[4]
    labels = [x for x in host.split(".") if x]
    out = {f"scheme={scheme}"}
    out.update(f"host={x}" for x in labels[:-1])
    out.update(f"tld={x}" for x in labels[-1:])
    out.update(f"site={x}" for x in [".".join(labels[-3:])] if len(labels) > 2)
    for part in path.lower().split("/"):
        stem, _, ext = part.partition(".")
        out.update(f"path={x}" for x in re.split(r"[^a-z0-9]+", stem) if x and not x.isdigit())
        if ext:
            out.add(f"ext={ext[:16]}")
        if stem.isdigit():
            out.add(f"digits={len(stem)}")
    out.update(f"query={x.partition('=')[0][:32]}" for x in query[1:].lower().split("&") if x)
    if path.endswith("/"):
        out.add("path-ends=/")
    return sorted(out)


def baskets(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """url tokens of labelled pages (columns url, blocked boolean), with the class as one more item."""

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"items": [[*url_tokens(u), BLOCK if b else ALLOW] for u, b in zip(pdf["url"], pdf["blocked"], strict=True)]})

    return pages.select("url", "blocked").mapInPandas(run, "items array<string>")


def mine(labelled: DataFrame, min_support: float = 0.004, min_confidence: float = 0.5, max_rules: int = 50_000, partitions: int | None = None) -> list[tuple[tuple[str, ...], str, float, float]]:
    """(tokens, verdict, confidence, support) by falling confidence. Support bounds the rules; over max_rules is an error."""
    items = baskets(labelled)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, **({} if partitions is None else {"numPartitions": partitions})).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK) | F.array_contains("consequent", ALLOW))
    found = rules.select("antecedent", "consequent", "confidence", "support").limit(max_rules + 1).collect()
    if len(found) > max_rules:
        raise ValueError(f"more than {max_rules} rules; raise min_support")
    found = sorted(((tuple(sorted(r.antecedent)), r.consequent[0].split("=")[1], r.confidence, r.support) for r in found), key=lambda r: (len(r[0]), -r[2], r[0]))
    kept: dict[tuple[str, ...], tuple] = {}
    for tokens, verdict, confidence, support in found:  # a longer rule must be surer than every shorter one within it
        within = (part for n in range(len(tokens)) for part in combinations(tokens, n))
        if not any((part, verdict) in kept and kept[part, verdict][2] >= confidence for part in within):
            kept[tokens, verdict] = (tokens, verdict, confidence, support)
    return sorted(kept.values(), key=lambda r: (-r[2], -r[3], r[0]))


class RuleIndex:
    """Inverted index: token to the rules that need it."""

    def __init__(self, rules):
        self.rules = rules
        self.of: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            for t in r[0]:
                self.of[t].append(i)

    def best(self, tokens: list[str], verdict: str) -> tuple[float, str]:
        seen: dict[int, int] = defaultdict(int)
        for t in tokens:
            for i in self.of.get(t, ()):
                seen[i] += 1
        hit = min((i for i, n in seen.items() if n == len(self.rules[i][0]) and self.rules[i][1] == verdict), default=None)
        return (0.0, "") if hit is None else (self.rules[hit][2], " & ".join(self.rules[hit][0]))


def judge(pages: DataFrame, mined: list, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule that decided with its confidence.

    Without a fitting fixed rule a url is blocked if its surest block rule has at least threshold confidence and no allow
    rule is surer.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(it):
        index = RuleIndex(mined)
        for pdf in it:
            out = []
            for u in pdf["url"]:
                tokens = url_tokens(u)
                block, by = index.best(tokens, "block")
                allow, other = index.best(tokens, "allow")
                blocked = block >= threshold and block >= allow
                out.append(("block", by, block) if blocked else ("allow", other, allow))
            yield pd.concat([pdf[["page_id", "url"]].reset_index(drop=True), pd.DataFrame(out, columns=["mined_verdict", "mined_rule", "confidence"])], axis=1)

    d = common.table_of(pages, "page_id", "url").mapInPandas(run, f"page_id {kind}, url string, mined_verdict string, mined_rule string, confidence double")
    host, path = host_and_path(F.col("url"))
    d = d.select("page_id", host.alias("host"), path.alias("path"), "mined_verdict", F.nullif("mined_rule", F.lit("")).alias("mined_rule"), "confidence")
    fit = fixed_rule(F.col("host"), F.col("path"), rules)
    return d.select("page_id", "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], F.col("mined_verdict")).alias("verdict"), "mined_verdict", "mined_rule", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's address ends in the id of its document; it counts as blocked if that is of low quality or toxic."""
    doc = F.expr(r"try_cast(nullif(regexp_extract(`url`, '://[^?#]*/([0-9]{1,18})(?:[./?#]|$)', 1), '') as bigint)")
    marks = labels.select(F.col("`doc_id`").alias("_doc"), ((F.col("`quality`") == 0) | (F.col("`toxic`") == 1)).alias("blocked")).where("blocked is not null").groupBy("_doc").agg(F.max("blocked").alias("blocked"))
    return pages.select(F.col("`url`").alias("url"), doc.alias("_doc")).where("_doc is not null").join(marks, "_doc").select("url", "blocked")
