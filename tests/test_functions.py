import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import label, rules as R, text as X
from tessera.functions.ids import parse_seed_id, perturb_seed, tracking_id
from tessera.functions.perturb import perturb_text, perturb_text_exact
from tessera.catalogue import PHRASES


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


SANITIZED = [
    ("  **RE-CHECK__ NOTE**  Wound looks DRY!!!  no fever since Monday???   All calm.   ", "re-check note wound looks dry! no fever since monday? all calm."),
    ("wait??", "wait??"),
    ("bahut bahut dard", "bahut bahut dard"),
    ("ÉCOLE Ok", "Écolé ok".replace("lé", "le")),
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("café", "café"),
    ("zero​width﻿", "zerowidth"),
    ("pain \U0001f600 level", "pain level"),
    ("a  b", "a b"),
]


def test_sanitizer(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SANITIZED)], "k int, t string").select("k", X.sanitize_text(F.col("t")).alias("x"))
    got = {r["k"]: r["x"] for r in rows.collect()}
    for k, (given, want) in enumerate(SANITIZED):
        assert got[k] == want, given


#: Texts of all kinds of white space, marks and edges, for the steps against their plain forms.
ODD = [None, "", " ", "\n", "a\n", " a", "a  b", "a \tb", "\ta b\n", "a\u2003b", "a \u3000 b\x1c", "\xa0\xa0", "#a.!?#\n", "..., a", "!?", "a\u200b\u200fb\ufeff", "x\U0001f600\u2190y", "\u0915\u093c", "e\u0301 E\u0301\u0302", "\u1112\u1161\u11ab", "\U0001d15e", "\u2126 \u212b \uf900", "na\u00efve caf\u00e9 \u2019s", "(\u0928\u0939\u0940)\u093e#"]


def test_steps_equal_their_plain_forms(spark):
    c, inside = F.col("t"), rf"\p{{L}}\p{{N}}_{R.PROTECTED}"
    plain = {
        "san_emoji": F.regexp_replace(c, R.EMOJI, ""),
        "san_zero_width": F.regexp_replace(c, R.ZERO_WIDTH, ""),
        "san_whitespace": F.regexp_replace(F.regexp_replace(c, f"[{R.WS}]+", " "), "^ | $", ""),
        "san_edge_junk": F.regexp_replace(F.regexp_replace(c, f"^[^{inside}]+", ""), f"[^{inside}.,!?]+$", ""),
    }
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    cut = X.san_edge_junk(X.san_whitespace(c))
    for r in rows.select("t", *(F.struct(getattr(X, n)(c).alias("got"), p.alias("want")).alias(n) for n, p in plain.items()), F.struct(cut.alias("got"), X.san_whitespace(cut).alias("want")).alias("last")).collect():
        for n in (*plain, "last"):
            assert r[n]["got"] == r[n]["want"], (n, r["t"])


def test_only_texts_that_nfc_may_change_go_to_python(spark):
    chars = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    pairs = [d.split() for d in map(unicodedata.decomposition, chars) if d and not d.startswith("<")]
    joins = {chr(int(p[1], 16)) for p in pairs if len(p) == 2} | {chr(k) for a, b in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for k in range(a, b)}
    may = [x for x in chars if unicodedata.normalize("NFC", x) != x or unicodedata.combining(x) or x in joins]
    rows = spark.createDataFrame([(x,) for x in may], "t string")
    assert rows.where(~F.col("t").rlike(R.NOT_NFC)).collect() == []
    # "naïve café's" in one character a letter, and plain texts, stay in the JVM
    assert spark.createDataFrame([("naïve café\u2019s \u201cÄrger\u201d \u2014 \u00bfQué?",)], "t string").where(F.col("t").rlike(R.NOT_NFC)).collect() == []
    got = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").select("k", X.san_nfc(F.col("t")).alias("x")).collect()
    assert {r["k"]: r["x"] for r in got} == {k: t if t is None else unicodedata.normalize("NFC", t) for k, t in enumerate(ODD)}


TIERS = [*zip(PHRASES[:10], ["S1", "S2", "S3", "S5", "S4", "S1", "S4", "S1", "S4", "S1"], strict=True), ("", "S4"), (None, "S4"), ("  ", "S4"), ("ACUTE STROKE", "S2"), ("inacute strokes", "S4")]


def test_cascade(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(TIERS)], "k int, t string").select("k", label.severity_cascade5(F.col("t")).alias("s"))
    got = {r["k"]: r["s"] for r in rows.collect()}
    for k, (given, want) in enumerate(TIERS):
        assert got[k]["severity"] == want, given
        assert (got[k]["label_source"], got[k]["confidence"]) == (R.LABEL_SOURCE, "low")
    assert got[10]["matched_tier"] == "default_empty_input" and got[4]["matched_tier"] == "default_no_match"


def test_patterns_are_reported_with_their_edges(spark):
    got = {t: one(spark, t, label.severity_cascade5)["matched_pattern"] for t in ("found unresponsive", "a code blue", "calm")}
    assert got == {"found unresponsive": r"\bunresponsive\b(?!\s+to\b)", "a code blue": r"\bcode blue\b", "calm": None}


def test_caseless_letters_beyond_ascii_match():
    import re

    for word in ("ſevere", "sıgnificant paın", "SİGNİFICANT pain"):
        assert re.fullmatch("severe|significant pain", word.translate(str.maketrans(*label.FOLDED)).lower())


def test_every_rule_has_a_literal_in_all_its_matches():
    for patterns in R.TIERS5.values():
        for p in patterns:
            part = label.literal_of(p).strip()
            assert part in p


def test_scan3(spark):
    x = one(spark, "acute emergency, Code Blue and routine", label.severity_scan3)
    assert x["severity"] == "critical" and x["keywords"] == ["code blue", "emergency"]
    assert one(spark, "", label.severity_scan3)["severity"] == "unknown"
    assert one(spark, "follow-up, well controlled", label.severity_scan3)["keywords"] == ["follow-up", "well controlled"]


def test_ids(spark):
    import hashlib

    r = spark.range(1).select(tracking_id(F.lit("12"), F.lit(1)).alias("t")).select("t", parse_seed_id(F.col("t")).alias("s"), perturb_seed(F.col("t")).alias("p")).first()
    h = hashlib.sha256(b"12::1").hexdigest()[:8]
    assert r["t"] == f"12::v1::{h}" and r["s"] == "12" and r["p"] == int(h, 16)


MIXED = "Aaj sir mein bahut dard hai, doctor kal subah nahi milega."


@pytest.mark.parametrize("f", [perturb_text, perturb_text_exact])
def test_perturbation(spark, f):
    seeds = spark.range(10).select(F.lit(MIXED).alias("t"), "id")
    got = [r["p"]["text"] for r in seeds.select("id", f(F.col("t"), F.col("id"), 0.6).alias("p")).orderBy("id").collect()]
    again = [r["p"]["text"] for r in seeds.repartition(3).select("id", f(F.col("t"), F.col("id"), 0.6).alias("p")).orderBy("id").collect()]
    assert got == again and len(set(got)) > 1
    with pytest.raises(ValueError):
        f(F.col("t"), F.col("id"), 1.5)


def test_perturbation_rates(spark):
    none = one(spark, MIXED, lambda c: perturb_text(c, F.lit(1), 0.0))
    assert none["text"] == MIXED and not none["subs"]
    text = "YEH yeh Kuch doctor xdoctor nahi Nahi nahi BAHUT"
    every = one(spark, text, lambda c: perturb_text(c, F.lit(7), 1.0))
    words = every["text"].split(" ")
    assert words[0] == "YE" and words[1] == "ye" and words[2] == "Kuc" and words[4] == "xdoctor"
    assert words[3] in ("daktar", "dactor")
    # a changed word never stays a word that a later rule knows
    assert all(w.lower() not in ("nahin", "bohot") for w in words)


def test_perturbation_chains_and_audit(spark):
    rows = spark.range(40).select(perturb_text(F.lit("nahi"), F.col("id"), 1.0).alias("p")).collect()
    assert any(len(r["p"]["subs"]) == 2 for r in rows)
    for r in rows:
        subs = r["p"]["subs"]
        assert subs[0]["original"] == "nahi" and subs[-1]["replacement"] == r["p"]["text"]


def test_text_after_the_last_known_word_is_left_alone(spark):
    tail = " é 😀 und so weiter,\n who knows".ljust(200, "x")
    for f in (perturb_text, perturb_text_exact):
        for text in ("Nahi, Kya dard", "kya NAHI haı hoé ſab", "mera", "nothing here"):
            a, b = (one(spark, t, lambda c: f(c, F.lit(5), 1.0)) for t in (text, text + tail))
            assert b["text"] == a["text"] + tail and b["subs"] == a["subs"], (f, text)
    # the plain mode cuts that part off before it looks at words
    plan = spark.createDataFrame([("x",)], "t string").select(perturb_text(F.col("t"), F.lit(1)).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" in plan


def test_second_making_is_dealt_by_the_size_of_the_table(spark):
    from tessera.catalogue import QUERIES

    plan = QUERIES["expect_deterministic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "REPARTITION_BY_NUM" not in plan.split("hashpartitioning(doc_id")[1].split("\n")[0]
