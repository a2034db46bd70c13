"""Operators over documents: hard cases and samples of the given tables against plain versions."""

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, toxicity
from tessera.llm.decontamination import build_index, contamination, decontaminate, proximity_matches
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents, plan
from tessera.llm.quality import quality
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.token_shards import feistel, read_slots, write_shards
from tessera.llm.tokens import WordTokens, vocabulary

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, v int, hits int, component int, words string"
RNG = random.Random(5)
VOCAB = [f"w{k}" for k in range(400)] + ["The", "ÉCOLE", "naïve", "x.", "10"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Nulls, empty and blank texts, repeated rows and ids, short texts, copies, near copies, shared passages, a long text."""
    passage, base = prose(60), prose(200)
    texts = [None, "", " \n\t ", "one", "One", "one two three four", "one two three four five", base, base, base.upper(), base.replace("w1", "w2", 2), base + " " + prose(20)]
    texts += [prose(30) + " " + passage + "\n" + prose(40), passage, prose(10) + "\x0b" + passage + " " + prose(3), "same " * 100, "Ab cd " * 60, "a\x00b # * $ % a|b <x>\n" * 40]
    texts += [prose(3000), " ".join(prose(50).split() * 3), "éé üü " * 50, "x" * 5000]
    rows = [(k, t) for k, t in enumerate(texts)]
    for k in range(12):  # edits far enough to be linked only through others
        w = base.split()
        for j in range(0, 3 * k, 3):
            w[j * 5 % 200] = f"e{k}{j}"
        rows.append((100 + k, " ".join(w)))
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 1, "z", 1, 2, 3, "q") for i, t in rows], SCHEMA).repartition(parts)


def test_near_duplicates(spark, hard):
    got = [tuple(r) for r in near_duplicates(frame(spark, hard)).orderBy("doc_id").collect()]
    assert got == brute.near_duplicates(hard)
    again = near_duplicates(frame(spark, [*hard, hard[7], (None, "x")], 2))
    assert again.count() == len(hard) + 1
    assert near_duplicates(frame(spark, [])).count() == 0


def test_substring_dedup(spark, hard):
    rows = [*hard, hard[7], (None, hard[12][1]), (None, None)]
    x = remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(repr, map(tuple, x.collect()))) == sorted(map(repr, brute.substring_dedup(rows)))
    assert remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_splits_hot_anchors(spark, monkeypatch):
    from tessera.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 500)
    rng = random.Random(3)
    line = prose(12, rng)
    rows = [(k, prose(30, rng) + " " + line + " " + prose(30, rng)) for k in range(12)] + [(50 + k, prose(20, rng) + " " + line + " " + " ".join(["q"] * 40)) for k in range(4)]
    x = remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted(map(tuple, x.collect())) == sorted(brute.substring_dedup(rows))


def test_tables_beyond_the_broadcast_bound_are_merged(spark, hard, monkeypatch):
    from tessera.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    items = [(1, prose(25)), (5, hard[8][1]), (None, "naïve x 10 Ab"), (7, "cd ab")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    x = contamination(frame(spark, hard), bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted(map(repr, map(tuple, x.collect()))) == sorted(map(repr, brute.contamination(hard, items)))


def test_near_duplicates_in_a_bucket_of_unlike_texts(spark):
    """Texts that share a boilerplate, a large group of copies with edits, and others that are just not similar enough."""
    rng, boiler, base = random.Random(8), prose(120, random.Random(9)), prose(150, random.Random(10)).split()
    rows = [(k, boiler + " " + " ".join(f"u{k}x{j}" for j in range(60))) for k in range(60)]
    for k in range(60):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(0, 12)):
            w[j] = f"e{k}y{j}"
        rows.append((100 + k, " ".join(w)))
    got = [tuple(r) for r in near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == brute.near_duplicates(rows)


def test_contamination(spark, hard):
    items = [(1, prose(25)), (2, "one two"), (3, None), (4, ""), (5, hard[8][1]), (None, "naïve x 10 Ab"), (5, hard[13][1]), (7, "cd ab")]
    rows = [*hard, hard[7], (None, hard[12][1]), (None, None)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, t int")
    x = contamination(frame(spark, rows), bench).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    want = brute.contamination(rows, items)
    assert sorted(map(repr, map(tuple, x.collect()))) == sorted(map(repr, want))
    kept = decontaminate(frame(spark, hard), bench)
    assert {r["doc_id"] for r in kept.collect()} == {w[0] for w in brute.contamination(hard, items) if not w[5]}
    assert contamination(frame(spark, []), bench).count() == 0
    assert contamination(frame(spark, hard[:4]), bench.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 200 + "beta gamma")])
    phrases = spark.createDataFrame([(9, ["alpha", "beta", "gamma"])], "phrase bigint, words array<string>")
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    assert {r["k1"] for r in proximity_matches(index, phrases, 5).collect()} == {1, 2}


def test_proximity_of_a_phrase_of_over_64_words(spark):
    words = [f"p{j}" for j in range(150)]
    back = words[::-1]
    docs = frame(spark, [(n, " ".join(["q"] * 61 * n + back[:70] + ["z"] * n + back[70:])) for n in (0, 5, 6, 7)])
    phrases = spark.createDataFrame([(9, words)], "phrase bigint, words array<string>")
    index = build_index(docs, phrases.select(F.explode("words").alias("term")))
    got = {(r["k1"], r["place"]) for r in proximity_matches(index, phrases, 5).collect()}
    assert got == {(n, 62 * n + 149) for n in (0, 5, 6)}


def test_quality(spark, hard):
    rows = [*hard, hard[7], (None, None)]
    x = quality(frame(spark, rows))
    got = sorted(map(repr, map(tuple, x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())))
    assert got == sorted(repr((i, *brute.base_counts(t))) for i, t in rows)
    for r in x.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["quality"] <= 1
    assert quality(frame(spark, [])).count() == 0


def test_packing(spark, hard):
    rows = [*hard, hard[7], (None, prose(90))]
    size = 64
    x = pack_documents(frame(spark, rows), size=size).collect()
    want = []
    for (i, _), raw in zip(rows, brute.token_bytes([t for _, t in rows]), strict=True):
        want += [(i, k, at // 4, len(raw[at : at + 4 * size]) // 4, zlib.crc32(raw[at : at + 4 * size])) for k, at in enumerate(range(0, len(raw), 4 * size))]
    assert sorted(map(repr, (tuple(r)[:5] for r in x))) == sorted(map(repr, want))
    at = {}
    for r in sorted(x, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert at[r["sequence_id"]] <= size
    assert len(at) <= 1.1 * sum(r["length"] for r in x) / size + 1
    assert pack_documents(frame(spark, []), size=size).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for size in (10, 37, 64):
        lengths = sorted((rng.randint(1, size) for _ in range(300)), reverse=True)
        bins = []
        for n in lengths:  # plain best fit
            fits = [b for b in bins if b[0] >= n]
            b = min(fits, default=None)
            if b is None:
                bins.append([size - n])
            else:
                b[0] -= n
        runs = plan({n: lengths.count(n) for n in set(lengths)}, size)
        assert max(first + -(-(hi - lo) // each) for _, lo, hi, first, each, _ in runs) == len(bins)
        assert sum(hi - lo for _, lo, hi, *_ in runs) == 300


def test_tokens_are_the_tokenizers():
    texts = ["The cat's 123 é ΣΑΣ Σ", "", "a<|startoftext|>b <|endoftext|>c", "<|STARTOFTEXT|>", " x\x1cy z ", "é é", None, "İ x9y ½²Ⅷ", "“'S”.'ll .\u0301x \u0958 <\u0338"]
    texts += [f"a{chr(c)}b'S{chr(c)} .{chr(c)}-Z1" for c in range(0x400)]
    texts += [r[0] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pandas().itertuples(index=False)]
    for most in (2_000_000, 50):
        tokens = WordTokens(vocabulary(), most=most)
        for at in range(0, len(texts), 97):
            part = texts[at : at + 97]
            ids, first = tokens.encode(pa.array(part, pa.string()))
            assert [ids[a:b].astype("<u4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] == brute.token_bytes(part)


def test_whole_texts_of_other_vocabularies():
    tokens = WordTokens(vocabulary("byte_bpe_50k.json"), end=7)
    ids, first = tokens.encode(pa.array(["a b", None, "é  x"]))
    assert tokens.pieces is None and [int(ids[x - 1]) for x in first[1:]] == [7, 7, 7] and first[2] - first[1] == 1
    assert tokens.tokenizer.decode(ids[first[2] : first[3] - 1].tolist()) == "é  x"


def test_shards(spark, hard, tmp_path):
    assert sorted(feistel(range(1000), 1000, 9)) == list(range(1000)) and list(feistel([0], 1, 3)) == [0]
    rows = [*hard, hard[7], (None, "x"), (None, None)]
    want = None
    for parts, folder in ((2, "a"), (5, "b")):
        df = frame(spark, rows, parts)
        manifest, n = write_shards(df, f"file://{tmp_path}/{folder}", length=32, per_shard=10, block_bytes=4000)
        x = read_slots(spark, manifest, 32).collect()
        assert sorted(r["slot"] for r in x) == list(range(n)) and all(r["shard"] == r["slot"] // 10 and r["offset"] == r["slot"] % 10 * 68 for r in x)
        # the ids of each slot, from a plain version of blocks, sequences and slots
        if want is None:
            keyed = df.select("doc_id", "text", F.xxhash64("text").alias("k2")).withColumn("h", F.xxhash64("doc_id", "k2")).collect()
            want = brute.shard_slots(keyed, sum(len((t or "").encode()) for _, t in rows), 4000, 32, lambda k, n: int(feistel([k], n, 1337)[0]))
        assert {r["slot"]: (r["n_tokens"], r["ids_crc32"]) for r in x} == want
        late = {r["slot"]: r["ids_crc32"] for r in read_slots(spark, manifest, 32, start=25).collect()}
        assert late == {k: c for k, (_, c) in want.items() if k >= 25}
    empty, none = write_shards(frame(spark, []), f"file://{tmp_path}/c", length=32)
    assert none == 0 and read_slots(spark, empty, 32).count() == 0
    with pytest.raises(Exception, match="without a scheme"):
        write_shards(frame(spark, hard[:3]), f"{tmp_path}/d", length=32)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.fit(docs)
    x = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = x.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    odd = language.identify(frame(spark, [(1, None), (2, ""), (3, "123 .."), (4, "привет мир"), (None, "the and of"), (6, "the and of der die das nicht und eine keit ung le la des les eau que ment")]), model)
    got = {r["doc_id"]: r for r in odd.collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] in model.languages and all(0 <= r["score"] <= 1 for r in got.values())
    assert len(got[6]["spans"]) > 1
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs.limit(3), none).collect()} == {"und"}


def test_language_scores_all_of_a_long_run(spark):
    de, en = "unddernichteinekeitungschlechtwirdauch", "theandofthatwithwhichthroughshouldhave"
    rows = [(k, " ".join(RNG.choice([x[j : j + 9] for j in range(20)]) for _ in range(60)), lang) for k in range(60) for x, lang in [((de, "de"), (en, "en"))[k % 2]]]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    run = de[:38] + de[:2] + en * 60
    assert len(language.pieces(run)) > 50
    assert abs(model.scores(language.pieces(run)).sum(axis=0) - model.scores([run])[0]).max() < 0.1
    assert model.scores([run])[0].argmax() == model.languages.index("en")
    got = language.identify(spark.createDataFrame([(1, f"7 {run}. the"), (2, "\u0130" * 90)], "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    assert got[0]["lang_pred"] == "en" and 0.9 < got[0]["score"] < 1
    assert [tuple(x) for x in got[0]["spans"]] == [(2, 42, "de"), (42, 2 + len(run) + 5, "en")]
    assert [(x["begin"], x["end"]) for x in got[1]["spans"]] == [(0, 90)]


def test_numbers_are_no_letters(spark):
    model = language.LanguageModel([("en", " th", 5), ("en", "the", 5), ("en", "he ", 5), ("en", "#latin", 9)])
    texts = ["½ ² ① Ⅷ 7", "x² ½", "_", "the", "一二"]
    got = [r["lang_pred"] for r in language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    assert got == ["und", "en", "und", "en", "en"]


def test_many_languages_and_scripts_narrow_them(spark):
    counts = []
    for k in range(300):
        word = "".join(chr(0x61 + (k // 26**j) % 26) for j in range(3)) + "qz"
        counts += [(f"l{k:03d}", g, 50) for g in language.trigrams(word)] + [(f"l{k:03d}", "#latin", 50)]
    counts += [("ru", g, 50) for g in language.trigrams("мир")] + [("ru", "#cyrillic", 50)]
    model = language.LanguageModel(counts)
    texts = [(k, f"{chr(0x61 + k % 26)}{chr(0x61 + k // 26 % 26)}{chr(0x61 + k // 676)}qz") for k in (0, 127, 128, 255, 299)] + [(1000, "мир aaaqz aaaqz")]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(texts, "doc_id bigint, text string"), model).collect()}
    assert all(got[k]["lang_pred"] == f"l{k:03d}" for k, _ in texts[:5])
    assert [x["lang"] for x in got[1000]["spans"]] == ["ru", "l000"]


def test_toxicity_grammar():
    m = toxicity.ToxicityModel({"=fool": 6.0, "^stup": 5.0})
    g = toxicity.grammar()

    def weigh(text):
        state, total = g.start, 0.0
        for w in text.split():
            s, weight = m.symbol(w)
            state, _, factor = g.step(state, s)
            total += weight * factor
        return total

    assert weigh("you are a fool") > weigh("what a fool") > weigh("he is not a fool") > 0
    assert weigh("she said what a stupid thing") < weigh("what a stupid thing")
    assert weigh("a calm day") == weigh("they will not said you") == 0
    # insults in a row are a phrase; apart they aren't
    assert weigh("stupid old fool") > weigh("stupid a b c d fool") == weigh("stupid") + weigh("fool")
    # violence is a threat after an intent, in any of the languages
    assert weigh("i will kill you") == weigh("ich werde das vernichten") == weigh("voy a matar") == 4 * weigh("to kill time")
    assert weigh("i will not kill you") < weigh("i will kill you") < weigh("you i will kill")
    assert weigh("he wrote i will kill you") < weigh("i will kill you")


def test_grammar_is_a_composition_of_five():
    names = [toxicity._insult, toxicity._threat, toxicity._target, toxicity._negation, toxicity._reporting]
    g, rng = toxicity.grammar(), random.Random(4)
    for _ in range(200):
        text = [rng.choice(".ivmynr") for _ in range(12)]
        state, got = g.start, []
        for x in text:
            state, out, f = g.step(state, x)
            got.append((out, f))
        want = [(x, 1.0) for x in text]
        for make in names:  # one after the other over the whole clause
            t = make()
            s, after = t.start, []
            for x, f in want:
                s, out, h = t.step(s, x)
                after.append((out, f * h))
            want = after
        assert got == want


def test_toxicity_learns(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        rows.append((k, prose(40, rng) + (" such a blorg today " if bad else " ") + prose(10, rng)))
        labels.append((k, 1, int(bad)))
    m = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, [*rows, (1000, None), (1001, "")]), m).collect()}
    assert all((got[k] >= 0.5) == (k % 5 == 0) for k in range(400)) and got[1000] < 0.5 and got[1001] < 0.5
    empty = toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.toxicity(frame(spark, []), empty).count() == 0


def plain_evidence(model, text):
    """Evidence of a text by five passes over each clause, one for each transducer, without composing them."""
    import math
    import re

    text = (text or "").lower()

    def symbol(w):
        weights = [v for p, v in model.patterns.items() if (p[0] == "=" and w == p[1:]) or (p[0] == "^" and w.startswith(p[1:])) or (p[0] == "+" and w.startswith(p[1:]) and len(w) >= len(p))]
        if weights:
            return "i", max(weights)
        for s, words, weight in (("v", toxicity.VIOLENCE, model.threat), ("m", toxicity.INTENTS, 0.0), ("y", toxicity.TARGETS, 0.0), ("n", toxicity.NEGATIONS, 0.0), ("r", toxicity.REPORTS, 0.0)):
            if w in words:
                return s, weight
        return ".", 0.0

    sums, strong, threats = [], 0, 0
    for clause in re.split(r"[.!?;:\n]+", text):
        own = [symbol(w) for w in re.findall(r"[^\W\d_]+", clause)]
        s = [x for x, _ in own]
        if not {"i", "v"} & set(s):
            continue
        # the words since the last of a kind; what is too far off doesn't count
        near = lambda k, kind, scope: any(x in kind for x in s[max(0, k - scope) : k])
        reported = s.index("r") if "r" in s else len(s)
        total, attacked = 0.0, False
        for k, (x, weight) in enumerate(own):
            if x not in "iv":
                continue
            factor = 1.0
            if x == "i" and near(k, "i", 3):
                factor *= 1.25
            threat = x == "v" and near(k, "m", 5)
            if x == "v" and not threat:
                factor *= 0.25
            if near(k, "y", 6):
                factor *= 1.25
            if near(k, "n", 4):
                factor *= 0.25
            if k > reported:
                factor *= 0.25
            total += weight * factor
            attacked |= factor >= 1
            threats += factor >= 1 and threat
        strong += attacked
        sums.append(total)
    return [1.0, max(sums), math.log1p(sum(sums)), math.log1p(strong), math.log1p(threats)] if sums else [0.0] * 5


def test_scores_of_a_fixed_model_over_all_documents(spark):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(None, "you will kill the fool"), (5, None), (5, ""), (5, "don't kill. he said kill; FOOL fools fool!"), (7, "thing of a thing " * 20_000)]
    m = toxicity.ToxicityModel({"=fool": 6.0, "^thi": 1.5, "+fool": 2.0, "=of": 0.5, "^und": 1.0, "+est": 3.0})
    got = toxicity.toxicity(frame(spark, rows), m).collect()
    assert len(got) == len(rows) and sum(r["evidence"][0] for r in got) > 100
    plain = [(i, plain_evidence(m, t)) for i, t in rows]
    want = sorted(((-1 if i is None else i), [round(x, 9) for x in e], round(m.score(e), 9)) for i, e in plain)
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), [round(x, 9) for x in r["evidence"]], round(r["score"], 9)) for r in got) == want


def test_patterns_are_chosen_by_their_words():
    # the bare stem is common; with more letters after it, it tells; some of those tell more
    count = lambda texts: {p: (sum(p in toxicity.features(t) for t in texts), sum(p in toxicity.features({w}) for t in texts for w in t)) for p in set().union(*map(toxicity.features, texts))}
    toxic = [{"plain", "stem" + "abcdefgh"[k % 8], "stem" + "abcdefgh"[k % 7]} for k in range(40)]
    clean = [{"plain", "other"} for _ in range(400)] + [{"stem", "plain"} for _ in range(60)] + [{"stemz"}, {"stemh"}]
    got = toxicity.select_patterns(count(toxic), count(clean), len(toxic), len(clean), 30.0)
    m = toxicity.ToxicityModel(got)
    assert all(m.weight("stem" + x) > 2 for x in "abcdefg") and m.weight("stem") == m.weight("plain") == m.weight("other") == m.weight("ste") == 0
