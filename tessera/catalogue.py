"""The registered queries of the library and their SQL.

`clinical` is the documents table with a deterministic phrase put in front of each text and a deterministic raw category,
because the given prose matches none of the rule words. Both engines make it from the same lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .functions import label, rules as R, text as X
from .functions.ids import parse_seed_id, perturb_seed, tracking_id
from .functions.perturb import match_case, perturb_text, perturb_text_exact
from .operators import expand, near_copies, probe, quality as Q, split as S, summary, vectors as V
from .plans import builds
from .sources import notes
from .sources.shared import folder, written
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# What is put in front of the texts, and raw categories beside the known ones.
PHRASES = [
    "He went into cardiac arrest on the ward and the team began at once.",
    "Since noon she has had the worst headache of her life.",
    "The child keeps a persistent fever and looks dehydrated.",
    "Seen for the annual physical, in no apparent distress.",
    "Comes for a new prescription of the usual tablets.",
    "Had a cardiac arrest in an earlier year, feels fine, routine follow-up.",
    "Once the limb was exsanguinated the cuff was filled.",
    "She exsanguinated within minutes due to hemorrhage after the fall.",
    "A rash unresponsive to two creams, now referred.",
    "Neighbours found him unresponsive on the stairs.",
    "ACUTE severe fracture!!! severe",
    "routine follow-up, chronic but stable",
    "life-threatening emergency???",
    "###POST-OP NOTE### ***done***",
    "pain \U0001f600 level ☀️ high",
    "zero​width﻿ text",
    "café ÉCOLE",
    "Mera bahut dard ho raha hai",
    "Yeh dard bohot zyada hai, NAHI theek",
    "doctor at the Hospital gave medicine",
    "nahi nahin kuch sab thoda",
    "severe chest pain, moderate distress",
    "refill request; within normal limits",
    "nothing remarkable here",
]
RAW = [*(c for c, _, _ in R.CATEGORIES), None, "   ", " Surgery ", "Unlisted Clinic"]


def q(s: str | None) -> str:
    """A SQL string."""
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt to all cores if the input's splits (one for each row group of a file) are fewer; large tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def clinical_of(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (d % len(values) + 1).cast("int"))
    body = F.when(d % 97 == 13, None).when(d % 89 == 7, "  ").when(d % 83 == 5, "two words").otherwise(F.concat(pick(PHRASES), F.lit(" "), F.col("text")))
    return documents.select("doc_id", d.cast("string").alias("seed_id"), pick(RAW).alias("raw_category"), body.alias("text"), "lang", "source")


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical_of(spread(table(spark, sf_dir, "documents")))


def _pick(values: list[str | None]) -> str:
    return f"[{', '.join(map(q, values))}][doc_id % {len(values)} + 1]"


CLINICAL = (
    f"clinical AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS seed_id, {_pick(RAW)} AS raw_category, "
    f"CASE WHEN doc_id % 97 = 13 THEN NULL WHEN doc_id % 89 = 7 THEN '  ' WHEN doc_id % 83 = 5 THEN 'two words' ELSE {_pick(PHRASES)} || ' ' || text END AS text, lang, source FROM documents)"
)
WS = R.WS
W = r"[\p{L}\p{N}_]"


def trim_sql(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def blank_sql(c: str) -> str:
    return f"coalesce(NOT regexp_matches({c}, '[^{WS}]'), TRUE)"


def punct_sql(c: str) -> str:
    for ch in R.PUNCT_RUN_CHARS:
        c = f"regexp_replace({c}, '[{ch}]{{3,}}', '{ch}', 'g')"
    return c


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INSIDE = rf"\p{{L}}\p{{N}}_{R.PROTECTED}"
STEPS_SQL: dict[str, Callable[[str], str]] = {
    "san_nfc": lambda c: f"nfc_normalize({c})",
    "san_emoji": lambda c: f"regexp_replace({c}, '{R.EMOJI}', '', 'g')",
    "san_punct_runs": punct_sql,
    "san_junk_runs": lambda c: f"regexp_replace({c}, '{R.JUNK_RUN}', ' ', 'g')",
    "san_zero_width": lambda c: f"regexp_replace({c}, '{R.ZERO_WIDTH}', '', 'g')",
    "san_lower_latin": lambda c: f"translate({c}, '{UPPER}', '{LOWER}')",
    "san_whitespace": lambda c: f"regexp_replace(regexp_replace({c}, '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')",
    "san_edge_junk": lambda c: f"regexp_replace(regexp_replace({c}, '^[^{INSIDE}]+', ''), '[^{INSIDE}.,!?]+$', '')",
}


def sanitize_sql(c: str) -> str:
    for step in STEPS_SQL.values():
        c = step(c)
    return f"coalesce({STEPS_SQL['san_whitespace'](c)}, '')"


CLEAN = f"clean AS (SELECT *, {sanitize_sql('text')} AS cleaned FROM clinical)"
MAP = "category AS (SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in R.CATEGORIES) + ") t(raw_label, department_code, routing_confidence))"
MAPPED = f"mapped AS (SELECT c.*, coalesce({trim_sql('c.raw_category')}, '') AS raw_label, k.department_code, k.routing_confidence FROM clinical c LEFT JOIN category k ON k.raw_label = coalesce({trim_sql('c.raw_category')}, ''))"


def match_sql(c: str, pattern: str) -> str:
    inner = pattern.replace(r"\b(?!\s+to\b)", "").replace(r"\w", W).replace(r"\s", f"[{WS}]")
    if pattern.startswith("unresponsive"):
        c = f"regexp_replace({c}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])unresponsive[{WS}]+to($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return f"regexp_matches({c}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{inner})(?:$|[^\\p{{L}}\\p{{N}}_])')"


def cascade_sql(c: str, what: str) -> str:
    """The tier (what = 'tier') or the matched pattern (what = 'pattern') of the five-tier cascade."""
    cases = " ".join(f"WHEN {match_sql(c, p)} THEN {q(t if what == 'tier' else label.edged(p))}" for t, ps in R.TIERS5.items() for p in ps)
    return f"CASE WHEN {blank_sql(c)} THEN {q('S4' if what == 'tier' else None)} {cases} ELSE {q('S4' if what == 'tier' else None)} END"


def keywords_sql(c: str, tier: str) -> str:
    found = [f"list_transform(regexp_extract_all({c}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({k})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), lambda x: lower(x))" for k in R.KEYWORDS3[tier]]
    return f"list_sort(list_distinct(flatten([{', '.join(found)}])))"


def register(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def on_clinical(name: str, sql: str | None, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(clinical(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = sql


# text

for _name, _sql in STEPS_SQL.items():
    on_clinical(_name, f"WITH {CLINICAL} SELECT seed_id, {_sql('text')} AS text FROM clinical", lambda df, f=getattr(X, _name): df.select("seed_id", f(F.col("text")).alias("text")))
on_clinical("sanitize_text", f"WITH {CLINICAL} SELECT seed_id, {sanitize_sql('text')} AS text FROM clinical", lambda df: df.select("seed_id", X.sanitize_text(F.col("text")).alias("text")))
on_clinical("word_count", f"WITH {CLINICAL} SELECT seed_id, coalesce(len(regexp_extract_all(text, '[^{WS}]+')), 0) AS n FROM clinical", lambda df: df.select("seed_id", X.word_count(F.col("text")).alias("n")))
on_clinical("norm_category", f"WITH {CLINICAL} SELECT seed_id, coalesce({trim_sql('raw_category')}, '') AS label FROM clinical", lambda df: df.select("seed_id", X.norm_category(F.col("raw_category")).alias("label")))

# filters, audits, expectations

SHORT = f"coalesce(len(regexp_extract_all(text, '[^{WS}]+')), 0) < {R.MIN_WORDS}"
NO_CAT = blank_sql("raw_category")
on_clinical("audit_filter", f"WITH {CLINICAL} SELECT seed_id, text FROM clinical WHERE NOT ({NO_CAT} OR {SHORT})", lambda df: Q.audit_filter(df).select("seed_id", "text"))
on_clinical("audit_counts", f"WITH {CLINICAL} SELECT count(*) AS n_in, count(*) FILTER (NOT ({NO_CAT} OR {SHORT})) AS n_kept, count(*) FILTER ({NO_CAT} OR {SHORT}) AS n_dropped, count(*) FILTER ({NO_CAT}) AS n_no_category, count(*) FILTER ({SHORT}) AS n_short FROM clinical", Q.audit_counts)
on_clinical("drop_blank_text", f"WITH {CLINICAL} SELECT seed_id, text FROM clinical WHERE NOT {blank_sql('text')}", lambda df: Q.drop_blank_text(df).select("seed_id", "text"))
on_clinical("src_notes_validated", f"WITH {CLINICAL} SELECT seed_id, text FROM clinical WHERE text IS NOT NULL", lambda df: notes.notes_validated(df, "text", "raw_category").select("seed_id", "text"))
on_clinical("src_notes_filled", f"WITH {CLINICAL} SELECT seed_id, coalesce(text, '') AS text FROM clinical", lambda df: notes.notes_filled(df, "text").select("seed_id", "text"))
on_clinical("limit_seeds", f"WITH {CLINICAL} SELECT seed_id, coalesce(text, '') AS text FROM clinical ORDER BY doc_id LIMIT 50", lambda df: notes.notes_filled(df, "text", "doc_id", 50).select("seed_id", "text"))
on_clinical("map_category", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT seed_id, raw_label, department_code, routing_confidence FROM mapped", lambda df: label.map_category(df).select("seed_id", "raw_label", "department_code", "routing_confidence"))
ORACLE_SQL["join_category"] = ORACLE_SQL["map_category"]
QUERIES["join_category"] = QUERIES["map_category"]
on_clinical("quarantine_unknown", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT seed_id, raw_label FROM mapped WHERE department_code IS NULL", lambda df: Q.quarantine_unknown(df).select("seed_id", "raw_label"))
on_clinical("expect_labels_mapped", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT 'labels_mapped' AS \"check\", count(DISTINCT raw_label) = 0 AS passed, CAST(count(DISTINCT raw_label) AS VARCHAR) AS observed FROM mapped WHERE department_code IS NULL", Q.expect_labels_mapped)
on_clinical("expect_row_count", f"WITH {CLINICAL} SELECT 'row_count' AS \"check\", count(*) = 4999 AS passed, CAST(count(*) AS VARCHAR) AS observed FROM clinical", lambda df: Q.expect_row_count(df, 4999))
on_clinical("expect_cardinality", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT 'cardinality_department_code' AS \"check\", count(DISTINCT department_code) = 13 AS passed, CAST(count(DISTINCT department_code) AS VARCHAR) AS observed FROM mapped", lambda df: Q.expect_cardinality(label.map_category(df), "department_code", 13))
on_clinical("expect_tier_share", f"WITH {CLINICAL}, t AS (SELECT {cascade_sql('text', 'tier')} AS s FROM clinical) SELECT 'tier_share' AS \"check\", avg((s = 'S1')::INT) < 0.02 AS passed, printf('%.6f', round(avg((s = 'S1')::INT), 6)) AS observed FROM t", lambda df: Q.expect_share_below(df.select(label.severity_cascade5(F.col("text"))["severity"].alias("s")), F.col("s") == "S1", 0.02, "tier_share"))
on_clinical("expect_unique_seed", f"WITH {CLINICAL} SELECT seed_id, count(*) AS n FROM clinical GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5", lambda df: Q.expect_unique(df, "seed_id"))
on_clinical("raw_labels_per_department", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT department_code, count(DISTINCT raw_label) AS n FROM mapped WHERE department_code IS NOT NULL GROUP BY 1", lambda df: label.map_category(df).where("department_code is not null").groupBy("department_code").agg(F.count_distinct("raw_label").alias("n")))
on_clinical("filter_low_confidence", f"WITH {CLINICAL}, {MAP}, {MAPPED} SELECT seed_id, CASE WHEN routing_confidence = 'low' THEN 0.25 ELSE 1.0 END::DOUBLE AS weight FROM mapped WHERE department_code IS NOT NULL", lambda df: label.map_category(df).where("department_code is not null").select("seed_id", Q.confidence_weight(F.col("routing_confidence")).cast("double").alias("weight")))

# labels



def _scanned(df: DataFrame) -> DataFrame:
    x = df.select("seed_id", X.sanitize_text(F.col("text")).alias("c")).withColumn("low", label.folded(F.col("c")))
    return x.select("seed_id", label.severity_scan3(F.col("c"), F.col("low")).alias("s")).select("seed_id", "s.severity", F.array_join("s.keywords", "|").alias("keywords"), "s.confidence")


def _cascaded(df: DataFrame) -> DataFrame:
    x = df.select("seed_id", "text", label.folded(F.col("text")).alias("low"))
    x = x.select("seed_id", label.cascade_rank(F.col("text"), F.col("low")).alias("rank"))
    return x.select("seed_id", label.severity_of_rank(F.col("rank")).alias("s")).select("seed_id", "s.severity", "s.matched_pattern", "s.label_source", "s.confidence")


ONE = {t: f"len({keywords_sql('cleaned', t)}) > 0" for t in R.KEYWORDS3}
on_clinical(
    "severity_scan3",
    f"WITH {CLINICAL}, {CLEAN} SELECT seed_id, CASE {' '.join(f'WHEN {ONE[t]} THEN {q(t)}' for t in R.KEYWORDS3)} ELSE 'unknown' END AS severity, "
    f"array_to_string(CASE {' '.join(f'WHEN {ONE[t]} THEN {keywords_sql('cleaned', t)}' for t in R.KEYWORDS3)} ELSE [] END, '|') AS keywords, 'low' AS confidence FROM clean",
    _scanned,
)
on_clinical(
    "severity_cascade5",
    f"WITH {CLINICAL} SELECT seed_id, {cascade_sql('text', 'tier')} AS severity, {cascade_sql('text', 'pattern')} AS matched_pattern, {q(R.LABEL_SOURCE)} AS label_source, 'low' AS confidence FROM clinical",
    _cascaded,
)
BARE, EXSANG = R.TIERS5["S1"][4], R.TIERS5["S1"][6]
on_clinical(
    "neg_context_rules",
    f"WITH {CLINICAL} SELECT seed_id, {match_sql('text', BARE)} AS bare_unresponsive, {match_sql('text', EXSANG)} AS trauma_exsanguination FROM clinical WHERE text IS NOT NULL",
    lambda df: df.where("text is not null").select("seed_id", F.col("text").rlike(X.word_rule(BARE)).alias("bare_unresponsive"), F.col("text").rlike(X.word_rule(EXSANG)).alias("trauma_exsanguination")),
)
on_clinical(
    "phrase_context_share",
    f"WITH {CLINICAL}, o AS (SELECT unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])unresponsive(?:$|[^\\p{{L}}\\p{{N}}_])(?:to(?:$|[^\\p{{L}}\\p{{N}}_]))?')) AS found FROM clinical) "
    "SELECT count(*) FILTER (regexp_matches(found, '(?i) to[^a-z]*$')) AS benign, count(*) AS n FROM o",
    lambda df: df.agg(*(F.coalesce(F.sum(F.regexp_count("text", F.lit(X.word_rule(p)))), F.lit(0)).alias(a) for p, a in (("unresponsive[ ]to", "benign"), ("unresponsive", "n")))),
)
OLD_RULE = "unresponsive"
on_clinical(
    "rule_pack_diff",
    f"WITH {CLINICAL}, t AS (SELECT {cascade_sql('text', 'tier')} AS new_tier, coalesce(regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])unresponsive(?:$|[^\\p{{L}}\\p{{N}}_])'), FALSE) AS bare FROM clinical) "
    "SELECT CASE WHEN bare THEN 'S1' ELSE new_tier END AS old_tier, new_tier, count(*) AS n FROM t GROUP BY 1, 2",
    lambda df: df.select(label.severity_cascade5(F.col("text"))["severity"].alias("new_tier"), F.coalesce(F.col("text").rlike(X.word_rule(OLD_RULE)), F.lit(False)).alias("bare")).groupBy(F.when(F.col("bare"), "S1").otherwise(F.col("new_tier")).alias("old_tier"), "new_tier").agg(F.count("*").alias("n")),
)
on_clinical(
    "class_imbalance",
    f"WITH {CLINICAL}, t AS (SELECT {cascade_sql('text', 'tier')} AS severity FROM clinical) SELECT severity, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM t GROUP BY 1",
    lambda df: summary.class_share(df.select(label.severity_cascade5(F.col("text"))["severity"].alias("severity")), "severity"),
)
on_clinical("sorted_keywords", ORACLE_SQL["severity_scan3"], _scanned)

# ids and splits

TID = "seed_id || '::v' || v || '::' || substr(sha256(seed_id || '::' || v), 1, 8)"
IDS = f"WITH ids AS (SELECT seed_id, v, {TID} AS tracking_id FROM (SELECT CAST(doc_id AS VARCHAR) AS seed_id, unnest(range(4)) AS v FROM documents))"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("seed_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    return d.withColumn("tracking_id", tracking_id(F.col("seed_id"), F.col("v")))


register("tracking_id", f"{IDS} SELECT tracking_id FROM ids")(lambda s, d: _ids(s, d).select("tracking_id"))
register("parse_seed_id", f"{IDS} SELECT tracking_id, split_part(tracking_id, '::', 1) AS seed_id FROM ids")(lambda s, d: _ids(s, d).select("tracking_id", parse_seed_id(F.col("tracking_id")).alias("seed_id")))
register("perturb_seed", f"{IDS} SELECT tracking_id, CAST('0x' || split_part(tracking_id, '::', 3) AS BIGINT) AS seed FROM ids")(lambda s, d: _ids(s, d).select("tracking_id", perturb_seed(F.col("tracking_id")).alias("seed")))
register("row_surrogate_id", "SELECT doc_id, printf('MTA-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")(lambda s, d: S.numbered(table(s, d, "documents").select("doc_id"), "doc_id").select("doc_id", S.row_surrogate_id(F.col("number"), "MTA").alias("id")))
RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY sha256('1337:' || CAST(key AS VARCHAR))) - 1 AS k, count(*) OVER () AS n FROM keys)"
CUT = {False: ("floor(n * 0.8::DOUBLE)", "floor(n * 0.1::DOUBLE)"), True: ("round_even(n * 0.8::DOUBLE, 0)", "round_even(n * 0.1::DOUBLE, 0)")}


def cut_sql(half_even: bool) -> str:
    a, b = CUT[half_even]
    return f"CASE WHEN k < {a} THEN 'train' WHEN k < {a} + {b} THEN 'val' ELSE 'test' END"


register("split_rank_rows", f"WITH keys AS (SELECT doc_id AS key FROM documents), {RANKED} SELECT key AS doc_id, {cut_sql(False)} AS split FROM r")(lambda s, d: S.split_rank_rows(table(s, d, "documents").select("doc_id"), "doc_id"))
GROUPED = f"keys AS (SELECT DISTINCT conv_id AS key FROM conversations), {RANKED}, cut AS (SELECT key, {cut_sql(True)} AS split FROM r)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("seed_id"), "turn", tracking_id(F.col("conv_id").cast("string"), F.col("turn")).alias("tracking_id"))
    return S.split_grouped_seeds(c, "seed_id")


register("split_grouped_seeds", f"WITH {GROUPED} SELECT CAST(conv_id AS VARCHAR) AS seed_id, turn, split FROM conversations JOIN cut ON key = conv_id")(lambda s, d: _turns(s, d).select("seed_id", "turn", "split"))
register("join_split_ids", "WITH keys AS (SELECT doc_id AS key FROM documents), " + RANKED + f" SELECT doc_id, source, {cut_sql(False)} AS split FROM r JOIN documents ON key = doc_id")(lambda s, d: (lambda docs: S.join_split_ids(docs, S.split_rank_rows(docs, "doc_id").select("doc_id", "split"), "doc_id"))(table(s, d, "documents").select("doc_id", "source")))
register("join_split_rows", ORACLE_SQL["split_grouped_seeds"])(lambda s, d: S.join_split_rows(_turns(s, d).drop("split", "seed_id"), _turns(s, d).select("seed_id", "split").distinct()).select("seed_id", "turn", "split"))
register("verify_no_leakage", f"WITH {GROUPED}, x AS (SELECT conv_id, split FROM conversations JOIN cut ON key = conv_id) SELECT count(*) AS n_leaks FROM (SELECT conv_id FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1)")(lambda s, d: S.leaks(_turns(s, d)).agg(F.count("*").alias("n_leaks")))
PAIRS = [(a, b) for k, a in enumerate(S.NAMES) for b in S.NAMES[k + 1 :]]
register("set_disjoint_splits", f"WITH {GROUPED}, x AS (SELECT CAST(conv_id AS VARCHAR) AS seed_id, split FROM conversations JOIN cut ON key = conv_id) SELECT * FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in PAIRS)}) t(one, other) JOIN (SELECT a.seed_id, a.split AS one, b.split AS other FROM x a JOIN x b USING (seed_id)) USING (one, other)")(lambda s, d: S.shared_seeds(_turns(s, d)).select("one", "other", "seed_id"))
register("first_per_seed", f"WITH {GROUPED} SELECT CAST(conv_id AS VARCHAR) AS seed_id, min(turn) AS turn FROM conversations GROUP BY 1")(lambda s, d: _turns(s, d).groupBy("seed_id").agg(F.min("turn").alias("turn")))
register("dist_split_seeds", f"WITH {GROUPED} SELECT split, count(*) AS n FROM cut GROUP BY 1")(lambda s, d: _turns(s, d).groupBy("split").agg(F.count_distinct("seed_id").alias("n")))
register("expect_nonempty_split", "SELECT source, count(*) AS n, round_even(count(*) * 0.8::DOUBLE, 0) > 0 AND round_even(count(*) * 0.1::DOUBLE, 0) > 0 AND count(*) - round_even(count(*) * 0.8::DOUBLE, 0) - round_even(count(*) * 0.1::DOUBLE, 0) > 0 AS passed FROM documents GROUP BY 1")(lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("passed", S.expect_nonempty_split(F.col("n"))))
register("stratified_sample", "SELECT source, doc_id, r AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM documents) WHERE r <= 3")(lambda s, d: S.stratified_sample(table(s, d, "documents"), "source", "doc_id", 3).select("source", "doc_id", "rank"))
CONTENT = f"WITH keys AS (SELECT DISTINCT sha256(text) AS key FROM documents), {RANKED}, cut AS (SELECT key, {cut_sql(True)} AS split FROM r)"


def _content(s: SparkSession, d: str) -> DataFrame:
    return S.split_grouped_seeds(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content")), "content")


register("content_group_split", f"{CONTENT} SELECT doc_id, split FROM documents JOIN cut ON key = sha256(text)")(lambda s, d: _content(s, d).select("doc_id", "split"))
register("leak_audit_by_content", "WITH keys AS (SELECT doc_id AS key, text FROM documents), " + RANKED + f", x AS (SELECT sha256(text) AS content, {cut_sql(False)} AS split FROM r) SELECT content FROM x GROUP BY 1 HAVING count(DISTINCT split) > 1")(lambda s, d: S.leaks(S.split_rank_rows(table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("content")), "doc_id"), "content"))

SETS = "[^\\x20\\x09-\\x0D]+"


@register(
    "leak_audit_near_copies",
    "WITH keys AS (SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL), " + RANKED + f", x AS (SELECT min(key) AS key, {cut_sql(False)} AS split, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{SETS}') AS w FROM r GROUP BY {cut_sql(False)}, text), "
    "s AS (SELECT DISTINCT key, split, array_to_string(w[j:j + 4], ' ') AS shingle FROM x, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS j) WHERE len(w) > 0), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1), "
    "p AS (SELECT a.split AS one, b.split AS other, a.key AS one_key, b.key AS other_key, count(*) AS n_shared FROM s a JOIN s b USING (shingle) WHERE list_position(['train', 'val', 'test'], a.split) < list_position(['train', 'val', 'test'], b.split) GROUP BY ALL) "
    "SELECT one, other, one_key, other_key, CAST(n_shared AS INT) AS n_shared, CAST(a.n + b.n - n_shared AS INT) AS n_all FROM p JOIN n a ON a.key = one_key JOIN n b ON b.key = other_key WHERE 100 * n_shared >= 75 * (a.n + b.n - n_shared)",
)
def _leak_audit_near_copies(s: SparkSession, d: str) -> DataFrame:
    return near_copies.near_leaks(S.split_rank_rows(spread(table(s, d, "documents").select("doc_id", "text")), "doc_id"), "doc_id")


# expansion

BANK = "bank AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(p)})" for k, p in enumerate(["", *R.PREFIXES])) + ") t(v, prefix))"
EXPANDED = f"expanded AS (SELECT c.*, v AS variant_index, prefix || coalesce(text, '') AS body, {TID} AS tracking_id, {cascade_sql("prefix || coalesce(text, '')", 'tier')} AS severity FROM clinical c, bank)"
KNOWN = "known AS (SELECT e.*, m.department_code, m.routing_confidence FROM expanded e JOIN mapped m USING (doc_id) WHERE m.department_code IS NOT NULL)"
ALL = f"WITH {CLINICAL}, {MAP}, {MAPPED}, {BANK}, {EXPANDED}, {KNOWN}"
on_clinical("expand_variants", f"WITH {CLINICAL}, {BANK}, {EXPANDED} SELECT tracking_id, variant_index, variant_index > 0 AS is_perturbed, body AS text FROM expanded", lambda df: expand.expand_variants(df, None).select("tracking_id", "variant_index", "is_perturbed", "text"))
ORACLE_SQL["union_variants"] = ORACLE_SQL["expand_variants"]
QUERIES["union_variants"] = QUERIES["expand_variants"]


def _draw_sql(rule: str, what: str) -> str:
    return f"(CAST('0x' || substr(sha256(seed || ':' || {rule} || ':{what}:' || i), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def _respelt_sql(old: str, rule: str) -> str:
    """The word that a rule (k, to_) makes of an old one in its place, with the old one's case; null if the draw is against it."""
    new = f"{rule}.to_[floor({_draw_sql(f'{rule}.k', 'choice')} * len({rule}.to_))::INT + 1]"
    cased = f"CASE WHEN {old} = upper({old}) AND upper({old}) <> lower({old}) AND length({old}) > 1 THEN upper({new}) WHEN upper({old}[1]) <> lower({old}[1]) AND {old}[1] = upper({old}[1]) THEN upper({new}[1]) || {new}[2:] ELSE {new} END"
    return f"CASE WHEN {rule}.k IS NOT NULL AND {_draw_sql(f'{rule}.k', 'apply')} < {R.RATE}::DOUBLE THEN {cased} END"


_RULES = [*((w, to, why) for w, to, why in R.VARIANTS), *((w, [t], R.FINAL_DROP_REASON) for w, t in R.FINAL_DROPS)]
#: A row a word of each variant: the word, what its rule makes of it, and what the later rule makes of that.
RESPELT = (
    "spelling AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {q(w)}, [{', '.join(map(q, to))}], {q(why)})" for k, (w, to, why) in enumerate(_RULES)) + ") t(k, word, to_, why)), "
    f"variants AS (SELECT c.seed_id, v, {TID} AS tracking_id, CAST(CAST('0x' || substr(sha256(seed_id || '::' || v), 1, 8) AS BIGINT) AS VARCHAR) AS seed, prefix || coalesce(text, '') AS body FROM clinical c, bank), "
    f"words AS (SELECT tracking_id, seed, unnest(regexp_extract_all(body, '{W}+|[^{W[1:-1]}]+')) AS word, generate_subscripts(regexp_extract_all(body, '{W}+|[^{W[1:-1]}]+'), 1) - 1 AS i FROM variants WHERE v > 0), "
    f"once AS (SELECT w.*, a.k AS k1, a.why AS why1, {_respelt_sql('w.word', 'a')} AS one FROM words w LEFT JOIN spelling a ON a.word = lower(w.word)), "
    f"twice AS (SELECT o.*, b.why AS why2, {_respelt_sql('o.one', 'b')} AS two FROM once o LEFT JOIN spelling b ON b.word = lower(o.one) AND b.k > o.k1), "
    "respelt AS (SELECT v.*, coalesce(t.text, body) AS text, v > 0 AS is_perturbed FROM variants v LEFT JOIN (SELECT tracking_id, string_agg(coalesce(two, one, word), '' ORDER BY i) AS text FROM twice GROUP BY 1) t USING (tracking_id))"
)
PERTURBED = f"WITH {CLINICAL}, {BANK}, {RESPELT}"
on_clinical("perturb_text", f"{PERTURBED} SELECT tracking_id, text FROM respelt", lambda df: expand.expand_variants(df).select("tracking_id", "text"))
on_clinical(
    "perturb_audit",
    f"{PERTURBED}, s AS (SELECT tracking_id, i, 0 AS step, word AS original, one AS replacement, why1 AS reason FROM twice WHERE one IS NOT NULL UNION ALL SELECT tracking_id, i, 1, one, two, why2 FROM twice WHERE two IS NOT NULL) "
    "SELECT tracking_id, CAST(row_number() OVER (PARTITION BY tracking_id ORDER BY i, step) - 1 AS INT) AS n, original, replacement, reason FROM s",
    lambda df: expand.perturb_audit(expand.expand_variants(df)),
)
on_clinical("perturb_text_exact", None, lambda df: expand.expand_variants(df, None).select("tracking_id", perturb_text_exact(F.col("text"), perturb_seed(F.col("tracking_id"))).alias("p")).select("tracking_id", "p.text"))
_DIGEST = "CAST(sum(CAST('0x' || substr(sha256(text || chr(31) || tracking_id), 1, 15) AS BIGINT)) AS VARCHAR)"
on_clinical(
    "expect_deterministic",
    f"{PERTURBED} SELECT 'perturb_text' AS \"check\", count(*) AS n, {_DIGEST} AS digest_a, {_DIGEST} AS digest_b, TRUE AS same FROM respelt",
    lambda df: Q.expect_same(*(expand.expand_variants(x).select("tracking_id", "text") for x in (df, df.repartition("doc_id"))), "perturb_text"),
)


def _known(df: DataFrame) -> DataFrame:
    x = expand.expand_variants(label.map_category(df).where("department_code is not null"), None, with_severity=True)
    return x.withColumn("severity", F.col("severity.severity"))


DISTS = {"dist_severity": "severity", "dist_department": "department_code", "dist_confidence": "routing_confidence"}
for _name, _c in DISTS.items():
    on_clinical(_name, f"{ALL} SELECT {_c}, count(*) AS n FROM known GROUP BY 1", lambda df, c=_c: summary.distribution(_known(df), c))
on_clinical("dist_sorted", f"{ALL} SELECT department_code, count(*) AS n FROM known GROUP BY 1 ORDER BY n DESC, 1", lambda df: summary.distribution(_known(df), "department_code").orderBy(F.desc("n"), "department_code"))
on_clinical("n_seeds", f"{ALL} SELECT count(DISTINCT seed_id) AS n FROM known", lambda df: _known(df).agg(F.count_distinct("seed_id").alias("n")))


@register("n_seeds_sketch", f"{ALL}, x AS (SELECT department_code, count(DISTINCT seed_id) AS n FROM known GROUP BY 1) SELECT department_code, n, TRUE AS close, TRUE AS mergeable FROM x UNION ALL SELECT 'all', count(DISTINCT seed_id), TRUE, TRUE FROM known")
def _n_seeds_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts, whether the kept sketches come within 2 % of them, and whether sketches of other groups of the same rows add up to the same within 1 % (their estimator depends on their filling)."""
    known, code = _known(clinical(spark, sf_dir)), "department_code"
    kept = written(summary.seed_sketches(known, by=code), "sketches")
    exact = summary.with_total(known, code, F.count_distinct("seed_id"))
    told = summary.sketched_seeds(kept, code).unionByName(summary.sketched_seeds(kept).withColumn(code, F.lit("all")))
    whole = summary.sketched_seeds(summary.seed_sketches(known, by="routing_confidence")).select(F.col("n").alias("whole"), F.lit("all").alias(code))
    x = exact.join(told.withColumnRenamed("n", "told").hint("merge"), code).join(whole.hint("merge"), code, "left")
    return x.select(code, "n", (F.abs(F.col("told") - F.col("n")) <= 0.02 * F.col("n")).alias("close"), F.coalesce(F.abs(F.col("told") - F.col("whole")) <= 0.01 * F.col("n"), F.lit(True)).alias("mergeable"))


on_clinical(
    "manifest_rollup",
    f"{ALL} SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(department_code) = 0 THEN 'department_code' ELSE 'routing_confidence' END AS what, coalesce(severity, department_code, routing_confidence) AS value, count(*) AS n FROM known GROUP BY GROUPING SETS ((severity), (department_code), (routing_confidence))",
    lambda df: summary.rollup(_known(df), [*DISTS.values()]),
)
CLASSES = ", ".join(f"{c[0]}_class AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS i FROM (SELECT DISTINCT {c} FROM known))" for c in ("department_code", "severity"))


def _indexed(df: DataFrame) -> DataFrame:
    known = written(_known(df).select("tracking_id", "department_code", "severity"), "known")
    for c, name in (("department_code", "department_index"), ("severity", "severity_index")):
        # 13 and 5 classes
        known = known.join(F.broadcast(V.label_dimension(known, c).withColumnRenamed("class_index", name)), c)
    return known.select("tracking_id", *(F.col(c).cast("int").alias(c) for c in ("department_index", "severity_index")))


on_clinical("label_index", f"{ALL}, {CLASSES} SELECT tracking_id, CAST(d.i AS INT) AS department_index, CAST(s.i AS INT) AS severity_index FROM known JOIN d_class d USING (department_code) JOIN s_class s USING (severity)", _indexed)
ORACLE_SQL["join_label_dim"], QUERIES["join_label_dim"] = ORACLE_SQL["label_index"], QUERIES["label_index"]
on_clinical("sorted_label_codes", f"WITH {MAP} SELECT department_code, CAST(row_number() OVER (ORDER BY department_code) - 1 AS INT) AS class_index FROM (SELECT DISTINCT department_code FROM category)", lambda df: V.label_dimension(label.map_category(df).where("department_code is not null"), "department_code").select("department_code", F.col("class_index").cast("int")))
on_clinical(
    "set_equal_labels",
    f"WITH {CLINICAL}, {MAP}, {MAPPED}, a AS (SELECT DISTINCT department_code FROM category), b AS (SELECT DISTINCT department_code FROM mapped WHERE department_code IS NOT NULL) SELECT 'rules' AS only_in, department_code FROM a ANTI JOIN b USING (department_code) UNION ALL SELECT 'data', department_code FROM b ANTI JOIN a USING (department_code)",
    lambda df: Q.set_difference(label.category_map(df).select("department_code").distinct(), label.map_category(df).select("department_code").where("department_code is not null").distinct(), "rules", "data"),
)
on_clinical("provenance_cols", f"{ALL} SELECT tracking_id, severity, {q(R.LABEL_SOURCE)} AS label_source, 'low' AS label_confidence FROM known", lambda df: label.provenance_cols(_known(df)).select("tracking_id", "severity", "label_source", "label_confidence"))
_N = "daktar"
on_clinical(
    "perturb_match_case",
    f"WITH {CLINICAL}, w AS (SELECT seed_id, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM clinical) SELECT seed_id, word, CASE WHEN word = upper(word) AND length(word) > 1 THEN upper('{_N}') WHEN word[1] = upper(word[1]) THEN upper('{_N[0]}') || '{_N[1:]}' ELSE '{_N}' END AS made FROM w",
    lambda df: df.select("seed_id", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).withColumn("made", match_case(F.col("word"), F.lit(_N))),
)


# whole builds, sinks and sources

BUILD_A = f"WITH {CLINICAL}, {CLEAN}, kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM clean WHERE text IS NOT NULL AND NOT {NO_CAT} AND len(regexp_extract_all(cleaned, '[^{WS}]+')) >= 3), keys AS (SELECT printf('MTA-%06d', number) AS key, kept.* FROM kept), {RANKED}, built AS (SELECT key AS tracking_id, {trim_sql('raw_category')} AS specialty_label, cleaned AS cleaned_text, CASE {' '.join(f'WHEN {ONE[t]} THEN {q(t)}' for t in R.KEYWORDS3)} ELSE 'unknown' END AS severity_label_heuristic, {cut_sql(False)} AS target_split FROM r)"
_A = ["tracking_id", "specialty_label", "cleaned_text", "severity_label_heuristic", "target_split"]
on_clinical("clean_build", f"{BUILD_A} SELECT {', '.join(_A)} FROM built", lambda df: builds.clean_build(df, "doc_id").select(*_A))
on_clinical("dist_severity_by_split", f"{BUILD_A} SELECT target_split, severity_label_heuristic, count(*) AS n FROM built GROUP BY 1, 2", lambda df: builds.clean_build(df, "doc_id").groupBy("target_split", "severity_label_heuristic").agg(F.count("*").alias("n")))
_NO_TEXT = f"coalesce(len(regexp_extract_all(cleaned, '[^{WS}]+')), 0) < {R.MIN_WORDS}"
on_clinical(
    "pipeline_summary",
    f"{BUILD_A}, c AS (SELECT count(*) AS n_raw, count(*) FILTER ({NO_CAT}) AS n_no_category, count(*) FILTER ({_NO_TEXT}) AS n_short FROM clean WHERE text IS NOT NULL) "
    f"SELECT any_value(n_raw) AS n_raw, count(*) AS n_kept, any_value(n_raw) - count(*) AS n_dropped, any_value(n_no_category) AS n_no_category, any_value(n_short) AS n_short, {', '.join(f"count(*) FILTER (target_split = '{n}') AS n_{n}" for n in S.NAMES)} FROM built, c",
    lambda df: builds.build_summary(df, "doc_id"),
)
SEEDS_B = f"keys AS (SELECT DISTINCT seed_id AS key FROM known), {RANKED}, cut AS (SELECT key, {cut_sql(True)} AS split FROM r)"
BUILD_B = f"{ALL}, {SEEDS_B}, built AS (SELECT k.*, split FROM known k JOIN cut ON key = seed_id)"
_B = ["tracking_id", "seed_id", "variant_index", "department_code", "routing_confidence", "severity_heuristic", "split"]
B_SQL = "SELECT tracking_id, seed_id, variant_index, department_code, routing_confidence, severity AS severity_heuristic, split FROM built"
on_clinical("variant_build", f"{BUILD_B} {B_SQL}", lambda df: builds.variant_build(df, None).select(*_B))
_P13 = ["tracking_id", "seed_id", "variant_index", "is_perturbed", "language", "text", "raw_medical_specialty", "department_code", "routing_confidence", "severity_heuristic", "severity_label_source", "severity_confidence", "split"]
on_clinical(
    "variant_build_perturbed",
    f"WITH {CLINICAL}, {MAP}, {MAPPED}, {BANK}, {RESPELT}, known AS (SELECT r.tracking_id, r.seed_id, CAST(r.v AS INT) AS variant_index, r.is_perturbed, CASE WHEN r.v > 0 THEN 'hinglish' ELSE 'en' END AS language, r.text, m.raw_label AS raw_medical_specialty, m.department_code, m.routing_confidence, "
    f"{cascade_sql('r.text', 'tier')} AS severity_heuristic, {q(R.LABEL_SOURCE)} AS severity_label_source, {q(R.LABEL_CONFIDENCE)} AS severity_confidence FROM respelt r JOIN mapped m USING (seed_id) WHERE m.department_code IS NOT NULL), {SEEDS_B} SELECT {', '.join(_P13)} FROM known JOIN cut ON key = seed_id",
    lambda df: builds.variant_build(df).select(*_P13),
)
on_clinical("dist_split_rows", f"{BUILD_B} SELECT split, count(*) AS n FROM built GROUP BY 1", lambda df: summary.distribution(builds.variant_build(df, None), "split"))


@register("snk_dataset", f"{BUILD_B} {B_SQL}")
def _snk_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes.write_dataset(builds.variant_build(clinical(spark, sf_dir), None), path := folder(spark, "dataset"))
    return spark.read.parquet(path).select(*_B)


@register("snk_dataset_one_split", f"{BUILD_B} SELECT tracking_id, variant_index, split, split = 'val' AS built_anew FROM built WHERE split <> 'val' OR variant_index = 0")
def _snk_dataset_one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole build, and then twice a build of the validation split alone, now of the originals: it replaces that split and no other."""
    x = written(builds.variant_build(clinical(spark, sf_dir), None), "variants").select("tracking_id", "variant_index", "split")
    notes.write_dataset(x.withColumn("built_anew", F.lit(False)), path := folder(spark, "dataset"))
    for _ in range(2):
        notes.replace_splits(x.where("split = 'val' and variant_index = 0").withColumn("built_anew", F.lit(True)), path)
    return spark.read.parquet(path).select("tracking_id", "variant_index", "split", "built_anew")


@register("src_split", f"{BUILD_B} SELECT tracking_id, body AS text FROM built WHERE split = 'val' AND NOT {blank_sql('body')}")
def _src_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes.write_dataset(builds.variant_build(clinical(spark, sf_dir), None), path := folder(spark, "dataset"))
    return notes.read_split(spark, path, "val").select("tracking_id", "text")


on_clinical("peek_perturbed", f"{BUILD_B} SELECT tracking_id, upper(split) AS split, CASE WHEN length(body) > 120 THEN substr(body, 1, 120) || '...' ELSE body END AS text FROM built WHERE variant_index > 0 ORDER BY tracking_id LIMIT 2", lambda df: notes.peek(builds.variant_build(df, None)))


@register("snk_raw_snapshot", f"WITH {CLINICAL} SELECT printf('MTA-RAW-%06d', row_number() OVER (ORDER BY doc_id) - 1) AS raw_row_id, text AS transcription, coalesce({trim_sql('raw_category')}, '') AS specialty_label FROM clinical WHERE text IS NOT NULL")
def _snk_raw_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = S.numbered(notes.notes_validated(clinical(spark, sf_dir), "text", "raw_category"), "doc_id")
    x = x.select(S.row_surrogate_id(F.col("number"), "MTA-RAW").alias("raw_row_id"), F.col("text").alias("transcription"), X.norm_category(F.col("raw_category")).alias("specialty_label"))
    notes.write_csv(x, path := folder(spark, "snapshot"))
    return spark.read.options(**notes.CSV).schema(x.schema).csv(path)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as a file of raw notes, and that file read."""
    blank = F.lit(None).cast("string")
    x = clinical(spark, sf_dir).select(F.col("seed_id").alias("row"), blank.alias("description"), F.col("raw_category").alias("medical_specialty"), blank.alias("sample_name"), F.col("text").alias("transcription"), blank.alias("keywords"))
    notes.write_csv(x, path := folder(spark, "notes"))
    return notes.read_notes(spark, path)


register("src_notes_csv", f"WITH {CLINICAL} SELECT seed_id, raw_category AS medical_specialty, text AS transcription FROM clinical WHERE text IS NOT NULL")(lambda s, d: notes.notes_validated(_notes(s, d)).select("seed_id", "medical_specialty", "transcription"))
register("src_notes_counts", f"WITH {CLINICAL} SELECT count(*) AS n_before, count(text) AS n_after, count(*) - count(text) AS n_null_text FROM clinical")(lambda s, d: s.createDataFrame([notes.archive_notes(_notes(s, d), folder(s, "archive"))], "n_before bigint, n_after bigint, n_null_text bigint"))
register("nan_to_null", "SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN value END AS value FROM events")(lambda s, d: notes.nan_to_null(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 3, float("nan")).otherwise(F.col("value")).alias("value"))))


@register("snk_raw_archive", f"WITH {CLINICAL} SELECT seed_id, text FROM clinical WHERE text IS NOT NULL")
def _snk_raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = notes.notes_validated(clinical(spark, sf_dir), "text", "raw_category").select("seed_id", "text")
    x.write.parquet(path := folder(spark, "archive"))
    return spark.read.parquet(path)


def _text_counts(c: str, table: str) -> str:
    return f"(SELECT string_agg({c} || '=' || n, ',' ORDER BY {c}) FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY 1))"


def _told(counts: Column) -> Column:
    """A map of counts as a line, sorted by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def _clean_json(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    x = written(builds.clean_build(clinical(spark, sf_dir), "doc_id"), "clean")
    notes.write_clean_json(x, path := folder(spark, "clean-json"), summary.export_metadata(x, {"target_split": "splits", "severity_label_heuristic": "severities"}))
    return x, path


@register("snk_clean_json", f"{BUILD_A} SELECT {', '.join(_A)} FROM built")
def _snk_clean_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = _clean_json(spark, sf_dir)
    return spark.read.schema(x.schema).json(f"{path}/records").select(*_A)


@register("snk_clean_metadata", f"{BUILD_A} SELECT count(*) AS n_records, '{summary.SCHEMA_VERSION}' AS schema_version, TRUE AS stamped, {_text_counts('target_split', 'built')} AS splits, {_text_counts('severity_label_heuristic', 'built')} AS severities FROM built")
def _snk_clean_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.schema(summary.METADATA).json(f"{_clean_json(spark, sf_dir)[1]}/metadata")
    stamp = F.col("export_timestamp_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d.*Z$")
    return x.select("n_records", "schema_version", stamp.alias("stamped"), _told(F.col("splits")).alias("splits"), _told(F.col("severities")).alias("severities"))


_M = {"severity_heuristic": "severities", "department_code": "departments", "routing_confidence": "confidences", "split": "split_rows"}


@register(
    "snk_manifest",
    f"{BUILD_B}, b AS (SELECT *, severity AS severity_heuristic FROM built), first AS (SELECT DISTINCT seed_id, split FROM b) "
    f"SELECT 'perturbation_rate=none,source=documents,split_fractions=0.8/0.1/0.1,split_seed=1337' AS parameters, count(*) AS n_rows, count(DISTINCT seed_id) AS n_seeds, 4 AS n_variants, {', '.join(f'{_text_counts(c, "b")} AS {a}' for c, a in _M.items())}, {_text_counts('split', 'first')} AS split_seeds, TRUE AS leakage_verified FROM b",
)
def _snk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = written(builds.variant_build(clinical(spark, sf_dir), None), "variants")
    summary.manifest(x, _M, parameters=summary.run_parameters("documents", None)).write.json(path := folder(spark, "manifest"))
    x = spark.read.schema(summary.manifest_schema(_M)).json(path)
    return x.select(_told(F.col("parameters")).alias("parameters"), "n_rows", "n_seeds", "n_variants", *(_told(F.col(a)).alias(a) for a in (*_M.values(), "split_seeds")), "leakage_verified")


# vocabularies and vectors

_P = [(k, a, w, v) for k, (w, to) in enumerate([*((w, to) for w, to, _ in R.VARIANTS), *((w, [t]) for w, t in R.FINAL_DROPS)]) for a, v in enumerate(to)]
PLAN = "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a}, {q(w)}, {q(v)})" for k, a, w, v in _P) + ") t(rule_idx, alt_idx, canonical, variant) WHERE variant <> canonical), plan AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY rule_idx, alt_idx) AS r FROM pairs) WHERE r = 1)"
#: Documents' words that some rule knows stand for the base vocabulary.
BASE = "base AS (SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(regexp_extract_all(text, '\\p{L}+')) AS w FROM clinical))"


def _base(s: SparkSession, d: str) -> DataFrame:
    return clinical(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select(F.lower("w").alias("token")).distinct()


def _new(s: SparkSession, d: str) -> DataFrame:
    return V.new_tokens(V.vocab_plan(V.rule_frame(s)), _base(s, d))


register("vocab_plan", f"WITH {CLINICAL}, {PLAN}, {BASE} SELECT canonical, variant, rule_idx, alt_idx, token IS NOT NULL AS present FROM plan LEFT JOIN base ON token = variant")(lambda s, d: V.vocab_plan(V.rule_frame(s)).join(_base(s, d).withColumnRenamed("token", "variant").withColumn("p", F.lit(True)).hint("merge"), "variant", "left").select("canonical", "variant", "rule_idx", "alt_idx", F.coalesce("p", F.lit(False)).alias("present")))
for _n in ("first_claim_wins", "vocab_dedupe"):
    QUERIES[_n], ORACLE_SQL[_n] = QUERIES["vocab_plan"], ORACLE_SQL["vocab_plan"]
register("anti_existing_vocab", f"WITH {CLINICAL}, {PLAN}, {BASE} SELECT canonical, variant FROM plan ANTI JOIN base ON token = variant")(lambda s, d: _new(s, d).select("canonical", "variant"))
register("vocab_growth_count", f"WITH {CLINICAL}, {PLAN}, {BASE} SELECT count(*) AS n FROM plan ANTI JOIN base ON token = variant")(lambda s, d: _new(s, d).agg(F.count("*").alias("n")))
register("expect_disjoint_tokens", f"WITH {CLINICAL}, {PLAN}, {BASE} SELECT token FROM base SEMI JOIN plan ON token = variant")(lambda s, d: _base(s, d).join(F.broadcast(V.vocab_plan(V.rule_frame(s)).select(F.col("variant").alias("token"))), "token", "left_semi"))

CELLS = "cells AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2)"
emb = lambda s, d: table(s, d, "embeddings")
cells_of = lambda df, key, vec: df.select(key, F.posexplode(vec).alias("pos", "x")).select(key, F.col("pos").cast("bigint").alias("pos"), (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))
register("anchor_mean_vector", f"WITH {CELLS} SELECT label, pos, round(x, 4) + 0.0::DOUBLE AS x FROM cells")(lambda s, d: cells_of(V.mean_vectors(emb(s, d), "label", "embedding"), "label", "vector"))
# anchors are labels; tokens "a<label>" are new, "v<id>" are there
WARM = f"WITH {CELLS} SELECT 'a' || label AS token, pos, round(x, 4) + 0.0::DOUBLE AS x FROM cells UNION ALL SELECT 'v' || vec_id, unnest(range(len(embedding))), round(unnest(embedding)::DOUBLE, 4) + 0.0::DOUBLE FROM embeddings"


def _warm(s: SparkSession, d: str) -> DataFrame:
    anchors = V.mean_vectors(emb(s, d), "label", "embedding").withColumn("canonical", F.col("label").cast("string"))
    base = emb(s, d).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    plan = anchors.select("canonical", F.concat(F.lit("a"), F.col("canonical")).alias("variant"))
    return V.warm_start(plan, anchors, base)


register("embedding_warm_start", WARM)(lambda s, d: cells_of(_warm(s, d), "token", "vector"))
register(
    "embedding_copy_audit",
    "WITH w AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, len(v)::INT AS dims, array_to_string([printf('%.6f', x::DOUBLE) FOR x IN v[1:5]], ',') AS head, len(v) = len(embedding) AND len([1 FOR x, i IN v IF abs(x - embedding[i]) > 1e-8 + 1e-5 * abs(embedding[i])]) = 0 AS same FROM w JOIN embeddings USING (vec_id)",
)(lambda s, d: emb(s, d).alias("a").join(_warm(s, d).alias("b").hint("merge"), F.col("b.token") == F.concat(F.lit("v"), F.col("a.vec_id").cast("string"))).select("a.vec_id", V.copy_audit(F.col("b.vector"), F.col("a.embedding")).alias("c")).select("vec_id", "c.dims", "c.head", "c.same"))
register("anchor_single_piece_check", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1 HAVING count(*) <> 1")(lambda s, d: V.not_single_piece(emb(s, d), "label"))
register("join_anchor_pieces", "SELECT e.label, e.vec_id, f.vec_id AS first_id FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) f USING (label)")(lambda s, d: emb(s, d).select("label", "vec_id").join(emb(s, d).groupBy("label").agg(F.min("vec_id").alias("first_id")), "label").select("label", "vec_id", "first_id"))
register("first_vector_pool", "SELECT label, unnest(range(len(embedding))) AS pos, round(unnest(embedding)::DOUBLE, 4) + 0.0::DOUBLE AS x FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1) USING (label, vec_id)")(lambda s, d: cells_of(emb(s, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")), "label", "v"))

WEIGHTS = {n: [[((c * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for c in range(n)] for n in (13, 5)}
SCORES = ", ".join(f"s{n} AS (SELECT vec_id, label, c::INT AS c, list_sum([embedding[j + 1]::DOUBLE * (((c * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE) for j in range(64)]) AS s FROM embeddings, (SELECT unnest(range({n})) AS c))" for n in (13, 5))
HEADS = f"{SCORES}, " + ", ".join(f"h{n} AS (SELECT vec_id, any_value(label % {n})::INT AS y, CAST(arg_max(c, s) AS INT) AS pred, ln(sum(exp(s))) - max(CASE WHEN c = label % {n} THEN s END) AS loss FROM s{n} GROUP BY 1)" for n in (13, 5))


def _heads(s: SparkSession, d: str) -> DataFrame:
    x = emb(s, d).select("vec_id", "label", *(V.linear_head(F.col("embedding"), WEIGHTS[n], [0.0] * n).alias(f"s{n}") for n in (13, 5)))
    for n in (13, 5):
        x = x.withColumn(f"y{n}", (F.col("label") % n).cast("int")).withColumn(f"p{n}", V.argmax(F.col(f"s{n}"))).withColumn(f"l{n}", V.cross_entropy(F.col(f"s{n}"), F.col(f"y{n}")))
    return x


register("linear_head_scores", f"WITH {SCORES} SELECT 13 AS head, vec_id, c, round(s, 4) + 0.0::DOUBLE AS s FROM s13 UNION ALL SELECT 5, vec_id, c, round(s, 4) + 0.0::DOUBLE FROM s5")(lambda s, d: reduce(DataFrame.unionAll, (_heads(s, d).select(F.lit(n).alias("head"), "vec_id", F.posexplode(f"s{n}").alias("c", "s")).select("head", "vec_id", "c", (F.round("s", 4) + 0.0).alias("s")) for n in WEIGHTS)))
register("cross_entropy", f"WITH {HEADS} SELECT round(avg(h13.loss), 4) AS first, round(avg(h5.loss), 4) AS second FROM h13 JOIN h5 USING (vec_id)")(lambda s, d: _heads(s, d).agg(F.round(F.avg("l13"), 4).alias("first"), F.round(F.avg("l5"), 4).alias("second")))
register("joint_loss", f"WITH {HEADS} SELECT round(avg(h13.loss) + 1.2::DOUBLE * avg(h5.loss), 4) AS loss FROM h13 JOIN h5 USING (vec_id)")(lambda s, d: _heads(s, d).agg(F.round(V.joint_loss(F.avg("l13"), F.avg("l5")), 4).alias("loss")))
register("argmax_accuracy", f"WITH {HEADS} SELECT round(avg((h13.pred = h13.y)::INT), 6)::DOUBLE AS first, round(avg((h5.pred = h5.y)::INT), 6)::DOUBLE AS second FROM h13 JOIN h5 USING (vec_id)")(lambda s, d: _heads(s, d).agg(*(F.round(F.avg((F.col(f"p{n}") == F.col(f"y{n}")).cast("int")), 6).alias(a) for n, a in ((13, "first"), (5, "second")))))
register("ordinal_confusion", f"WITH {HEADS} SELECT y, pred, CASE abs(y - pred) WHEN 0 THEN 'exact' WHEN 1 THEN 'adjacent' ELSE 'distant' END AS band, count(*) AS n FROM h5 GROUP BY 1, 2, 3")(lambda s, d: V.ordinal_confusion(_heads(s, d).select(F.col("y5").alias("y"), F.col("p5").alias("pred")), "y", "pred"))
register("join_pred_label", f"WITH {HEADS} SELECT h.vec_id, pred, label FROM h13 h JOIN embeddings e USING (vec_id)")(lambda s, d: _heads(s, d).select("vec_id", F.col("p13").alias("pred")).join(emb(s, d).select("vec_id", "label"), "vec_id").select("vec_id", "pred", "label"))
register("weighted_running_metrics", f"WITH {HEADS}, b AS (SELECT vec_id % 16 AS batch, avg(loss) AS loss, count(*) AS n, sum((pred = y)::INT) AS correct FROM h13 GROUP BY 1) SELECT round(sum(loss * n) / sum(n), 4) AS loss, round(sum(correct) / sum(n), 6)::DOUBLE AS accuracy FROM b")(lambda s, d: V.running_metrics(_heads(s, d).groupBy((F.col("vec_id") % 16).alias("batch")).agg(F.avg("l13").alias("loss"), F.count("*").alias("n"), F.sum((F.col("p13") == F.col("y13")).cast("int")).alias("correct"))).select(F.round("loss", 4).alias("loss"), F.round("accuracy", 6).alias("accuracy")))
register("linear_probe_fit")(lambda s, d: V.linear_probe(emb(s, d), "embedding", "label").select("vec_id", "label", F.col("prediction").cast("int").alias("prediction")))
HEADS_OF = {"department": "department_code", "severity": "severity"}


@register("linear_probe_heads")
def _linear_probe_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both heads over the words of the notes: fitted on the training split with the weights of low routing confidence, told for all splits."""
    x = label.map_category(clinical(spark, sf_dir)).where("department_code is not null")
    x = x.select("seed_id", "text", "department_code", Q.confidence_weight(F.col("routing_confidence")).alias("weight"), label.severity_cascade5(F.col("text"))["severity"].alias("severity"))
    x = written(probe.indexed(S.split_grouped_seeds(written(x, "labelled"), "seed_id"), HEADS_OF), "indexed")
    model = probe.fit_heads(x.where("split = 'train'"), HEADS_OF, weight="weight")
    return probe.predict(model, x).select("seed_id", "split", *(f"{h}_{c}" for h in HEADS_OF for c in ("index", "prediction")))


register(
    "snk_label_space",
    f"{ALL}, {CLASSES} SELECT 'department' AS head, department_code AS class, CAST(i AS INT) AS class_index, (SELECT count(*) FROM known k WHERE k.department_code = c.department_code) AS n, {R.ALPHA}::DOUBLE AS loss_weight FROM d_class c "
    f"UNION ALL SELECT 'severity', severity, CAST(i AS INT), (SELECT count(*) FROM known k WHERE k.severity = c.severity), {R.BETA}::DOUBLE FROM s_class c",
)(lambda s, d: _label_space(s, d))


def _label_space(s: SparkSession, d: str) -> DataFrame:
    x = V.label_space(_known(clinical(s, d)), {"department": "department_code", "severity": "severity"}, {"department": R.ALPHA, "severity": R.BETA})
    x.write.json(path := folder(s, "labels"))
    return s.read.schema(x.schema).json(path)


# streams: a file stream over the given tables, run until nothing is left, and its sink


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(s, d, name).schema
    return s.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")


def _sink(s: SparkSession, stream: DataFrame) -> DataFrame:
    streams.run_once(stream, path := folder(s, "stream"), folder(s, "offsets"))
    return s.read.schema(stream.schema).parquet(path)


def _stream_clinical(s: SparkSession, d: str) -> DataFrame:
    live = _stream(s, d, "documents")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    return live.select(F.col("doc_id").cast("string").alias("seed_id"), pick(RAW).alias("raw_category"), F.concat(pick(PHRASES), F.lit(" "), F.col("text")).alias("text"))


THRESHOLD = "CAST('0x' || substr(sha256('1337:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
SPLIT = f"CASE WHEN {THRESHOLD} < 0.8::DOUBLE THEN 'train' WHEN {THRESHOLD} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'test' END"
LIVE = f"live AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS seed_id, {_pick(RAW)} AS raw_category, {_pick(PHRASES)} || ' ' || text AS text FROM documents)"
register("stream_threshold_split", f"SELECT doc_id, {SPLIT} AS split FROM documents")(lambda s, d: _sink(s, _stream(s, d, "documents").select("doc_id", S.threshold_split(F.col("doc_id")).alias("split"))))
register("stream_clean_label", f"WITH {LIVE}, c AS (SELECT *, {sanitize_sql('text')} AS cleaned_text FROM live) SELECT seed_id, cleaned_text, {cascade_sql('cleaned_text', 'tier')} AS severity, {SPLIT} AS split FROM c")(lambda s, d: _sink(s, streams.clean_label(_stream_clinical(s, d)).select("seed_id", "cleaned_text", "severity", "split")))
_UNKNOWN = f"coalesce({trim_sql('raw_category')}, '') NOT IN (SELECT raw_label FROM category)"


def _quarantined(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that one stream fills."""
    live = streams.quarantine(_stream_clinical(s, d)).select("seed_id", "raw_label", "department_code", "known")
    paths = folder(s, "known"), folder(s, "quarantine")
    streams.run_split(live, streams.quarantine_sinks(*paths), folder(s, "offsets"))
    return tuple(s.read.schema(T.StructType([*live.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(p) for p in paths)


register("stream_quarantine", f"WITH {LIVE}, {MAP} SELECT seed_id, coalesce({trim_sql('raw_category')}, '') AS raw_label FROM live WHERE {_UNKNOWN}")(lambda s, d: _quarantined(s, d)[1].select("seed_id", "raw_label"))
register("stream_quarantine_sinks", f"WITH {LIVE}, {MAP} SELECT CASE WHEN {_UNKNOWN} THEN 'quarantine' ELSE 'known' END AS sink, seed_id, k.department_code FROM live LEFT JOIN category k ON k.raw_label = coalesce({trim_sql('raw_category')}, '')")(
    lambda s, d: reduce(DataFrame.unionAll, (x.select(F.lit(name).alias("sink"), "seed_id", "department_code") for name, x in zip(("known", "quarantine"), _quarantined(s, d), strict=True)))
)


@register("stream_ingest_counts", f"WITH {CLINICAL} SELECT count(*) AS n_before, count(text) AS n_after, count(*) - count(text) AS n_null_text FROM clinical")
def _stream_ingest_counts(s: SparkSession, d: str) -> DataFrame:
    """Notes arrive as a stream and are kept if they have a text; a listener tells the counts of the batches."""
    live = clinical_of(_stream(s, d, "documents")).select("seed_id", "text", "raw_category")
    told = streams.run_counted(notes.notes_validated(live, "text", "raw_category", "ingest"), folder(s, "stream"), folder(s, "offsets"), "ingest")
    return s.createDataFrame([told], "n_before bigint, n_after bigint, n_null_text bigint")


def _events(s: SparkSession, d: str) -> DataFrame:
    return _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


register("stream_dedupe_ids", "SELECT DISTINCT event_id FROM events")(lambda s, d: _sink(s, streams.dedupe_ids(_events(s, d), "ts", "event_id").select("event_id")))
#: An epoch of the events is a day.
_DAY = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


@contextmanager
def _rocksdb(s: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the streams that start within."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key)
    s.conf.set(key, streams.ROCKSDB)
    try:
        yield
    finally:
        s.conf.set(key, before)


# epochs that a later one of the same type has closed, or the watermark
@register(
    "stream_epoch_metrics",
    f"WITH m AS (SELECT max(ts) - INTERVAL 70 MINUTE AS mark FROM events), g AS (SELECT event_type AS key, {_DAY} AS epoch, round(sum(value), 2) AS loss_sum, round(avg((event_id % 3 = 0)::INT), 6)::DOUBLE AS accuracy, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2) "
    "SELECT key, epoch, loss_sum, accuracy, n FROM (SELECT *, max(epoch) OVER (PARTITION BY key) AS newest FROM g), m WHERE epoch < newest OR last < mark",
)
def _stream_epoch_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = _events(s, d).select("event_type", F.floor(F.unix_timestamp("ts") / 86400).alias("epoch"), "value", F.lit(1).alias("n"), (F.col("event_id") % 3 == 0).cast("int").alias("correct"), "ts")
    with _rocksdb(s):
        x = _sink(s, streams.epoch_metrics(rows, "event_type", "epoch", "value", "n", "correct", "ts"))
    return x.select("key", "epoch", F.round(F.col("loss") * F.col("n"), 2).alias("loss_sum"), F.round("accuracy", 6).alias("accuracy"), "n")


# windows that the watermark has passed when the stream has ended
register(
    "stream_running_metrics",
    "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2",
)(lambda s, d: _sink(s, streams.running_metrics(_events(s, d), "ts", "value", "event_type")).select("window_start", "event_type", "n", F.round("mean", 4).alias("mean")))
