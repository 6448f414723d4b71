"""The layered resolver on hand-written rows, each expectation derived by hand."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text
from quillspan.operators import planning, resolve

CATALOG = [
    (0, "c0", "Sun", "شمس", "Nature"), (1, "c1", "One", "واحد", "Numbers"), (2, "c2", "Hot", "حار", "Things"), (3, "c3", "Call", "اتصل", "Verbs"), (4, "c4", "Cell", "خلية", "Things"), (5, "c5", "Cat", "قط", "Animals"),
    (6, "c6", "Left", "يسار", "Directions and Locations"), (7, "c7", "Mother", "ام", "Family"), (8, "c8", "cat", "قطة", "Animals"), (9, "c9", "Big Cat", "نمر", "Animals"), (10, "c10", "Wind", "الشمال", "Nature"),
]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(*r, r[1] != "c4") for r in CATALOG], "ord int, id string, word_en string, word_ar string, category string, has_video boolean").cache()


def run(spark, catalog, items, **how):
    d = resolve.resolve(spark.createDataFrame([(i,) for i in items], "item string"), catalog, **how)
    return {r.item: r for r in d.collect()}


def test_layers_and_their_order(spark, catalog):
    got = run(spark, catalog, ["SUN ", "cats", "CALLED CELLS", "called", "شمس", "الشمس", "والشمس", "الشمال", "left", "lefts", "zzz", "cat"])
    assert (got["SUN "].match_method, got["SUN "].catalog_id) == ("EXACT_EN", "c0")
    assert (got["cats"].match_method, got["cats"].catalog_id) == ("MORPHOLOGY_EN", "c5")
    assert got["CALLED CELLS"].status == "REVIEW_REQUIRED" and got["CALLED CELLS"].match_method is None  # the first hit is a risky form
    assert got["called"].status == "REVIEW_REQUIRED" and got["called"].n_candidates == 1
    assert got["شمس"].match_method == "EXACT_AR"
    assert (got["الشمس"].match_method, got["الشمس"].catalog_id) == ("CLITIC_AR", "c0")
    assert got["والشمس"].match_method == "CLITIC_AR"
    assert (got["الشمال"].match_method, got["الشمال"].catalog_id) == ("EXACT_AR", "c10")  # exact before clitic
    assert got["left"].match_method is None and got["left"].n_candidates == 1  # an ambiguous category is only a candidate
    assert got["lefts"].match_method == "MORPHOLOGY_EN"
    assert got["zzz"].n_candidates == 0 and got["cat"].catalog_id == "c5"  # the first row of a key wins


def test_every_arabic_label_resolves_to_its_own_row(spark, catalog):
    got = run(spark, catalog, [r[3] for r in CATALOG])
    assert {w: got[w].catalog_id for w in got} == {r[3]: r[1] for r in CATALOG}


def test_selector_gates(spark, catalog):
    choose = lambda rows: {"selector": spark.createDataFrame(rows, "item string, selected_id string")}
    got = run(spark, catalog, ["ONE BROTHER", "VERY HOT", "big dog cat", "cell wall", "hot one"], **choose([("ONE BROTHER", "c1"), ("VERY HOT", "c2"), ("big dog cat", "nope"), ("cell wall", "c4"), ("hot one", "c2")]))
    assert got["ONE BROTHER"].status != "VERIFIED"  # only the modifier would be shown
    assert (got["VERY HOT"].match_method, got["VERY HOT"].information_loss) == ("CANDIDATE_SELECTED", "CORE_WITH_MODIFIER_LOSS")
    assert got["big dog cat"].status != "VERIFIED"  # the id is not among the candidates
    assert got["cell wall"].status != "VERIFIED"  # no video
    assert got["hot one"].match_method == "CANDIDATE_SELECTED"


def test_fallbacks(spark, catalog):
    alphabet = spark.createDataFrame([(c,) for c in "ابتسشمل"], "letter string")
    extra = spark.createDataFrame([(0, "s0", "Moon", "قمر", "x", True), (1, "s1", "Star", "نجم", "x", False)], catalog.schema)
    terms = spark.createDataFrame([("gravity", "شمس"), ("plant", "بسم"), ("rock", "صخر")], "item string, arabic_term string")
    items = spark.createDataFrame([("moon", False), ("star", False), ("gravity", False), ("plant", False), ("rock", False), ("drift", True), ("lone", False)], "item string, source_arabic boolean")
    got = {r.item: r for r in resolve.resolve(items, catalog, supplementary=extra, terminology=terms, alphabet=alphabet).collect()}
    assert (got["moon"].render_source, got["moon"].catalog_id) == ("SUPPLEMENTARY", "s0")
    assert got["star"].status == "REVIEW_REQUIRED"
    assert (got["gravity"].match_method, got["gravity"].review_required) == ("EXACT_AR_VIA_TERMINOLOGY", True)
    assert (got["plant"].status, got["rock"].status, got["drift"].status, got["lone"].status) == ("FINGERSPELL_CANDIDATE", "UNSUPPORTED", "REVIEW_REQUIRED", "REVIEW_REQUIRED")
    d = resolve.coverage(resolve.resolve(items, catalog, supplementary=extra, terminology=terms, alphabet=alphabet)).first()
    assert d.total == 7 == d.verified + d.fingerspelled + d.unsupported + d.review


def test_alias(spark, catalog):
    aliases = spark.createDataFrame([(0, "c0", "Solar Disc"), (1, "c9", "solar disc"), (2, "gone", "ghost")], "ord int, catalog_id string, alias string")
    got = run(spark, catalog, ["solar disc", "ghost"], aliases=aliases)
    assert (got["solar disc"].match_method, got["solar disc"].catalog_id) == ("ALIAS", "c0") and got["ghost"].match_method is None


def test_information_loss(spark):
    cases = {("أمي", "Mother"): "CORE_WITH_MODIFIER_LOSS", ("أمى", "Mother"): "CORE_WITH_MODIFIER_LOSS", ("قصير", "Short"): "FULL", ("two", "Two"): "FULL", ("not hot", "Not"): "ESSENTIAL_INFORMATION_LOSS", ("!!", "x"): "AMBIGUOUS", ("اخ واحد", "Brother"): "AMBIGUOUS"}
    d = spark.createDataFrame(list(cases), "item string, sel string").select("item", "sel", text.information_loss(F.col("item"), F.col("sel")).alias("l"))
    assert {(r["item"], r["sel"]): r["l"] for r in d.collect()} == cases


def test_plans_and_segments(spark):
    d = spark.createDataFrame([(["water cycle"], ["WATER"], "the water cycle"), (["heat"], ["rain", "sun"], "rain falls"), (None, None, "x")], "k array<string>, p array<string>, s string")
    rows = d.select(planning.missing_terms(F.col("k"), F.col("p")).alias("m"), planning.plan_status(F.col("s"), F.col("p")).alias("st")).collect()
    assert [(r.m, r.st) for r in rows] == [([], "REVIEW_REQUIRED"), (["heat"], "OK"), (None, "REVIEW_REQUIRED")]
    units = spark.createDataFrame([("u1", 0, "sun", "VERIFIED", ["a"]), ("u1", 1, "bat", "FINGERSPELL_CANDIDATE", ["b", "c", "d"]), ("u2", 0, "gone", "VERIFIED", ["x"]), ("u2", 1, "n", "VERIFIED", None), ("u2", 2, "r", "UNSUPPORTED", None)], "unit_id string, idx int, term string, status string, clip_keys array<string>")
    good, bad = planning.segments(units, spark.createDataFrame([(c,) for c in "abcd"], "clip_key string"))
    assert good.count() == 4 and {r.term for r in bad.collect()} == {"gone", "n"}


def test_spans_in_sources(spark):
    from quillspan.operators import grounding

    spans = spark.createDataFrame([(1, " the cat "), (2, "dog"), (3, ""), (4, None), (5, "dog"), (6, "o")], "item_id long, text string")
    sources = spark.createDataFrame([(1, "see the cat run"), (2, "dog dog"), (3, None), (4, "zzz"), (5, "the catdog")], "doc_id long, text string").repartition(5)
    for size in (1 << 22, 3):  # one block of spans, or several
        got = {r.item_id: (r.n_sources, r.verified) for r in grounding.verify_spans(spans, sources, size).collect()}
        assert got == {1: (2, True), 2: (2, True), 3: (0, False), 4: (0, False), 5: (2, True), 6: (2, True)}
    assert grounding.verify_spans(spans, sources.limit(0)).where("verified").count() == 0


def _brute(items, rows, top):
    out = []
    for item in set(items):
        q = set(item.split())
        scored = sorted((-len(q & set(w.split())), o) for o, w in rows if q & set(w.split()))
        out += [(item, k + 1, o, -s) for k, (s, o) in enumerate(scored[:top])]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 3, 5])
def test_top_overlaps_match_brute_force(spark, top):
    import random

    rng = random.Random(top)
    word = lambda: f"{'abcdefgh'[min(7, int(rng.expovariate(0.5)))]}x{'ab'[rng.randrange(2)]}"
    label = lambda n: " ".join(word() for _ in range(n))
    rows = [(o, label(rng.randint(1, 6))) for o in range(400)]
    rows += [(400 + o, " ".join(f"w{(o + j) % 60}q" for j in range(40))) for o in range(20)]  # longer than SHORT
    rng.shuffle(rows)
    items = [label(rng.randint(1, 5)) for _ in range(60)] + ["axa axa bxb", "nothing here", "", " ".join(f"w{j}q" for j in range(35)), "w1q axa"]
    items = [i.replace("w", "v") if i == "nothing here" else i for i in items]
    c = spark.createDataFrame([(o, f"c{o}", w, None, "x", True) for o, w in rows], "ord int, id string, word_en string, word_ar string, category string, has_video boolean")
    fold = lambda s: " ".join(t for t in __import__("re").findall("[a-z']+", s))
    got = resolve.top_overlaps(spark.createDataFrame([(i,) for i in set(items)], "item string"), c, top)
    want = _brute([i for i in items if i], [(o, w) for o, w in rows], top)
    assert fold("axa") == "axa"
    letters = {(i, k, o, s) for i, k, o, s in want if not any(ch.isdigit() for ch in i)}
    assert {(r.item, r["rank"], r.row.ord, r.score) for r in got.collect() if not any(ch.isdigit() for ch in r.item)} == letters


def test_a_token_of_every_row_costs_a_list_of_fixed_length(spark):
    rows = spark.range(3000).selectExpr("cast(id as int) ord", "concat('c', id) id", "concat('common ', translate(cast(id as string), '0123456789', 'abcdefghij')) word_en", "cast(null as string) word_ar", "'x' category", "true has_video")
    items = spark.range(500).selectExpr("concat('common ', translate(cast(id * 7 as string), '0123456789', 'abcdefghij')) item")
    d = resolve.top_overlaps(items, rows, 5)
    got = d.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s")).collect()
    assert all(r.n == 5 for r in got) and sum(r.s == 2 for r in got) > 400
    assert [(r.row.ord, r.score) for r in d.where("item = 'common ej'").orderBy("rank").collect()] == [(49, 2), (0, 1), (1, 1), (2, 1), (3, 1)]
    assert d.count() == 2500


def test_spans_are_found_at_any_place(spark):
    """Against plain containment: places of every alignment, overlapping copies, repeats, other alphabets, near misses."""
    import random

    from quillspan.operators import grounding

    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdeشم \n") for _ in range(n))
    texts = [say(rng.randrange(400)) for _ in range(60)] + ["", None, "ab" * 300, "x" * 100]
    texts += texts[:5]
    spans = []
    for t in [t for t in texts if t and len(t) > 60]:
        for n in (1, 2, 3, 14, 20, 31, 32, 45, 60):
            at = rng.randrange(len(t) - n)
            spans.append(t[at : at + n])
        spans.append(t[5:50] + "!")
    spans += ["ab" * 40, "x" * 100, "x" * 101, "", "  ", None, "nowhere to be found in any of the texts above"]
    s = spark.createDataFrame(list(enumerate(spans)), "item_id long, text string")
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    strip = lambda t: t.strip(" \n\t\r\x0b\x0c") if t else ""
    got = {r.item_id: r.n_sources for r in grounding.verify_spans(s, d).collect()}
    want = {i: sum(strip(x) in t for t in texts if t is not None) if strip(x) else 0 for i, x in enumerate(spans)}
    assert got == want
