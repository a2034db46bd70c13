"""The pipeline's stages one by one against plain versions of what each decides."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language
from tessera.llm.common import staged
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.substring_dedup import remove_repeats

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF), name))
    for x in seen[:-1]:
        assert x.columns == docs.columns
    rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in seen[:-1]]
    assert len(rows[1]) == len(rows[0])
    assert sorted(i for i, _ in rows[2]) == [i for i, _, _, kept in brute.near_duplicates(rows[1]) if kept]
    want = {i: (n, gone, h) for i, n, gone, h in brute.substring_dedup(rows[2])}
    before = dict(rows[2])
    for i, t in rows[3]:
        assert t == before[i] if want[i][1] == 0 else brute.sha(t) == want[i][2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(i for i, _ in rows[4]) == sorted(x[0] for x in brute.contamination(rows[3], items) if not x[5])
    assert {r["doc_id"] for r in seen[-1].collect()} == {i for i, _ in rows[4]}


@pytest.mark.parametrize("stage", ["language", "near_dedup", "decontamination"])
def test_stages_judge_rows_of_null_and_repeated_ids_by_their_own_text(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy(F.desc(F.length("text"))).first()["text"]
    lost = {"language": "12 34", "decontamination": item}.get(stage)
    texts = [" ".join(f"{'abcdefgh'[j % 8]}word{'xyz'[k]}{'pqrstu'[j * j % 6]}{'klmno'[j % 5]}" for j in range(90)) for k in range(3)]
    rows = [(i, t) for i in (None, -7) for t in (texts[0], texts[1], lost) if t is not None] + [(-6, texts[1] + " more"), (-5, texts[2])]
    extra = spark.createDataFrame(rows, "doc_id bigint, text string")
    more = docs.limit(1).drop("doc_id", "text").crossJoin(extra).select(docs.columns)
    x = dict(corpus_pipeline.STAGES)[stage](spark, staged(docs.unionAll(more), "in"), SF)
    got = sorted(((r["doc_id"], r["text"]) for r in x.where("doc_id is null or doc_id < 0").collect()), key=repr)
    want = [r for r in rows if r[1] != lost and not (stage == "near_dedup" and r[0] == -6)]
    assert got == sorted(want, key=repr)
    assert x.schema == docs.schema


def test_near_duplicates_keep_the_links_of_all_texts_of_an_id(spark):
    text = [" ".join(f"t{k}w{j}" for j in range(60)) for k in range(3)]
    rows = [(1, text[0]), (5, text[0] + " x"), (5, text[1]), (6, text[1] + " y"), (5, text[2]), (4, text[2]), (9, None), (9, text[2] + " z"), (10, "")]
    x = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in x) == sorted((i, 10 if i == 10 else 1, i in (1, 10)) for i, _ in rows)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_with_odd_rows_columns_and_empty_tables(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    odd = [(None, None), (-1, None), (-2, ""), (-2, ""), (-3, " \n"), (None, "7"), (-4, "x" * 3000)]
    made = spark.createDataFrame(odd, "doc_id bigint, text string").select("doc_id", "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields[2:]))
    more = docs.unionByName(made).select("*", *(F.lit(k).alias(c) for k, c in enumerate(["_", "a.b", "k1", "k2", "_k2", "hits", "carried", "node", "lang_pred", "length", "block"])))
    x = run(spark, staged(more, "in"), SF)
    if stage != "packing":
        assert x.schema.names == more.schema.names
        assert all(r["a.b"] == 1 and r["block"] == 10 for r in x.collect())
    got = sorted(((r["doc_id"], r["text"]) for r in x.where("doc_id is null or doc_id < 0").collect()), key=repr) if stage != "packing" else sorted((r["doc_id"] for r in x.where("doc_id is null or doc_id < 0").collect()), key=repr)
    want = {
        # only the text of letters has a language
        "language": [(-4, "x" * 3000)],
        # rows alike in id and text are one
        "near_dedup": [r for k, r in enumerate(odd) if k != 3],
        "substring_dedup": odd,
        "decontamination": odd,
    }
    # one piece each
    assert got == sorted([i for i, _ in odd] if stage == "packing" else want[stage], key=repr)
    none = run(spark, staged(more.limit(0), "none"), SF)
    assert none.count() == 0 and none.schema.names == x.schema.names


def test_texts_go_to_python_once_and_no_workers_of_another_kind_start(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    carry = tuple(docs.columns)
    for x in (language.identify(docs, language.fit(docs), with_spans=False, carry=carry), remove_repeats(docs, carry=carry)):
        assert x.select("carried.*").columns == docs.columns
        last = x._jdf.queryExecution().analyzed().toString()
        sent = last[last.index("MapInArrow") :].split("\n")[1:]
        made = next(line for line in sent if "struct(" in line)
        assert "text, text#" not in made and "lang, lang#" in made
    assert "ExistingRDD" not in pack_documents(docs)._jdf.queryExecution().analyzed().toString()


def test_a_worker_keeps_a_bounded_number_of_words():
    counts = [("aa", "#latin", 9), ("aa", " ab", 5), ("bb", "#latin", 9), ("bb", " ba", 5)]
    model = language.LanguageModel(counts)
    letters = [chr(97 + j) for j in range(26)]
    words = [a + b + c + d for a in letters[:12] for b in letters for c in letters for d in letters[:16]]
    texts = [" ".join(words[j : j + 1000]) for j in range(0, len(words), 1000)]
    kept = []
    for k in range(0, len(texts), 30):
        b = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts[k : k + 30]))), "text": texts[k : k + 30]})
        assert sum(x.num_rows for x in language._label(model, 8.0, False)(iter([b]))) == b.num_rows
        kept.append(len(language._known[model.name][0]))
    assert len(words) > 120_000 and max(kept) <= 60_000
