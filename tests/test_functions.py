"""Text, parsing and geometry functions on hand-written cases."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quillspan.functions import parsing, text
from quillspan.operators import motion, reports, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "want"), [("", "unknown"), ("123", "unknown"), ("abc", "en"), ("شمس", "ar"), ("abc شمس", "en"), ("ab شمس", "ar")])
def test_detect_language(spark, value, want):
    assert one(spark, value, text.detect_language) == want


def test_text_functions(spark):
    assert one(spark, " أَلْـف ", text.normalize_ar) == "الف"
    assert one(spark, "The Cat's hats, IS very", text.tokens_en) == ["cat's", "hats"]
    assert one(spark, "والشمس", text.clitic_forms) == ["شمس", "الشمس"]
    assert one(spark, "لي", text.clitic_forms) == []
    assert one(spark, "studies", text.safe_forms) == ["study", "studi", "studie"]
    assert one(spark, "class", text.safe_forms) == [None, None, None]
    assert one(spark, "making", text.risky_forms) == ["mak", "make", None, None]
    assert one(spark, " --A b!! ", text.slugify) == "a-b" and one(spark, "!!", text.slugify) == "unnamed"
    assert one(spark, "/x/a b?.md", text.sanitize_filename) == "a_b_.md" and one(spark, "x/", text.sanitize_filename) == "source"
    assert one(spark, "أَب ج", text.letters) == ["ا", "ب", "ج"]
    assert one(spark, "/c/Data/en/Food/x", text.category_of_path) == "Food" and one(spark, "/a/b", text.category_of_path) is None
    assert one(spark, 754.9, text.timecode, "double") == "12:34"
    assert one(spark, "شمس", text.caption_ar) == "شمس" and one(spark, "x", text.caption_ar) == "[AR UNAVAILABLE]"


@pytest.mark.parametrize(("raw", "used", "n"), [("[1,2]", False, 2), ("say [1, 2] ok", True, 2), ("<think>[9]</think>[3]", False, 1), ("[", None, None), ("{}", None, None), ("[]", False, 0)])
def test_bounded_array(spark, raw, used, n):
    r = one(spark, raw, parsing.bounded_array)
    assert r["used"] is used and (None if r["json"] is None else len(json.loads(r["json"]))) == n


def test_schema_gate(spark):
    good = [{"concept": "a", "key_terms": ["b"], "source_span": "c"}]
    cases = {json.dumps(good): True, "[]": True, "not json": False, "{}": False, "null": False}
    for field, bad in (("concept", ""), ("concept", 3), ("key_terms", "b"), ("key_terms", [1]), ("source_span", None), ("key_terms", [])):
        cases[json.dumps([{**good[0], field: bad}])] = field == "key_terms" and bad == []
    for raw, want in cases.items():
        assert one(spark, raw, parsing.schema_valid) is want, raw


def test_lenient_and_repair(spark):
    raw = '{"concept": "a \\"q\\"", "key_terms": ["x", "y"] "source_span": "s"} {"concept": "b", "key_terms": [broken], "source_span": "t"}'
    r = one(spark, raw, parsing.lenient_concepts)
    assert [(x.concept, x.key_terms, x.source_span) for x in r] == [('a "q"', ["x", "y"], "s")]
    assert one(spark, '[{"a": (b c)}]', parsing.repaired) == '[{"a": "b c"}]'
    assert one(spark, 'x {"id": "None"}', parsing.selector_choice).asDict() == {"id": None, "confidence": "low"}
    assert one(spark, 'log\n== {"a": 1}', lambda c: parsing.after_marker(c, "==", "a int"))["a"] == 1 and one(spark, "none", lambda c: parsing.after_marker(c, "==", "a int")) is None


def test_angles(spark):
    p = lambda x, y, z=0.0: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(z)).alias("z"))
    r = spark.range(1).select(motion.joint_angle(p(1, 0), p(0, 0), p(0, 1)).alias("a"), motion.joint_angle(p(0, 0), p(0, 0), p(0, 1)).alias("b"), motion.torso_lean(p(1, 0), p(0, 1)).alias("c"), motion.affine(p(1, 0), F.lit(5.0), F.lit(0.0), F.lit(90.0), F.lit(2.0)).alias("d"), motion.facing(F.lit(None).cast("struct<x:double,y:double,z:double>")).alias("e")).first()
    assert (round(r.a, 9), r.b, round(r.c, 9), r.e) == (90.0, 180.0, 45.0, "undetermined") and (round(r.d["x"], 9), round(r.d["y"], 9)) == (5.0, 2.0)


def test_integrity_and_merge(spark):
    d = spark.createDataFrame([("ام", "Mother"), ("ام", "Father"), ("قط", "Cat 1"), ("قط", "Big cat 2"), ("", "x"), ("ن", "77"), ("ن", "star")], "ar string, en string")
    assert {r.shared: r.status for r in reports.integrity(d, "ar", "en").collect()} == {"ام": "SUSPECT", "قط": "VALID", "": "MISSING", "ن": "VALID"}
    old = spark.createDataFrame([(1, "a", "x"), (7, "b", "y")], "id long, k string, v string")
    new = spark.createDataFrame([(0, "b", "z", 1), (0, "c", "p", 2), (0, "c", "q", 3), (0, "d", "r", 4)], "id long, k string, v string, o int")
    assert sorted(tuple(r) for r in reports.merge_new(old, new, ["k"], "id", "o").collect()) == [(1, "a", "x"), (7, "b", "y"), (8, "c", "p"), (9, "d", "r")]


def test_sequence_scores():
    same = "a b c d e".split()
    assert vectors.bleu4(same, same) == pytest.approx(1.0) and vectors.bleu4(same, []) == 0.0
    assert 0 < vectors.bleu4(same, "a b c d x".split()) < 1
    assert vectors.lcs_length("abcde", "ace") == 3
    assert vectors.bleu4(same, "a x".split()) == pytest.approx(math.exp(1 - 5 / 2 + 0.25 * (math.log(1 / 2) + math.log(math.log(2) / 10 / 1) + math.log(math.log(2) / 20 / 1) + math.log(math.log(2) / 40 / 1))), rel=1e-6)


def test_long_replies_cost_no_stack(spark):
    """Replies of a megabyte: a concept of one piece, one full of escapes, and many objects."""
    long, escapes = "ب" * 1_200_000, '\\"x\\n' * 250_000
    one_of = lambda c, t, s: f'{{"concept": "{c}", "key_terms": {t}, "source_span": "{s}"}}'
    r = one(spark, one_of(long, '["k"]', long), parsing.lenient_concepts)
    assert [(x.concept == long, x.key_terms, x.source_span == long) for x in r] == [(True, ["k"], True)]
    r = one(spark, one_of(escapes, "[]", "s"), parsing.lenient_concepts)
    assert r[0].concept == '"x\n' * 250_000
    r = one(spark, "chatter " + ", ".join(one_of(f"c{i}", '["k"]', "s") for i in range(15_000)), parsing.lenient_concepts)
    assert [x.concept for x in r] == [f"c{i}" for i in range(15_000)]
    status = lambda raw, retry: spark.createDataFrame([(raw, retry)], "a string, b string").select(parsing.extraction(F.col("a"), F.col("b")).alias("r")).first().r
    assert status('"' + long, long).status == "FAILED_AFTER_REPAIR"
    assert status('[{"concept": "a\'./b", "key_terms": ["c"]}]', "[]").asDict() == {"status": "OK_AFTER_REPAIR", "concepts": []}
    assert status("not json at all", "still not json").status == "FAILED_AFTER_REPAIR"
    assert status('[{"concept": "Cell", "key_terms": "cell", "source_span": "s"}]', "[]").status == "OK_AFTER_REPAIR"
