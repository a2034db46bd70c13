"""Queries with SQL give what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"
NAMES = [
    "sanitize_text", "word_count", "audit_counts", "map_category", "severity_scan3", "severity_cascade5", "row_surrogate_id", "split_rank_rows", "split_grouped_seeds", "expand_variants",
    "manifest_rollup", "snk_manifest", "clean_build", "variant_build", "vocab_plan", "embedding_warm_start", "cross_entropy", "ordinal_confusion", "stream_dedupe_ids", "stream_running_metrics", "leak_audit_by_content",
    "src_notes_csv", "src_notes_counts", "snk_raw_snapshot", "snk_clean_metadata", "snk_label_space", "label_index", "set_disjoint_splits", "set_equal_labels", "phrase_context_share", "join_split_ids",
    "perturb_text", "perturb_audit", "expect_deterministic", "variant_build_perturbed", "n_seeds_sketch", "snk_dataset_one_split", "leak_audit_near_copies", "stream_quarantine_sinks", "stream_ingest_counts", "stream_epoch_metrics",
    "anchor_mean_vector", "audit_filter", "src_split", "perturb_match_case", "nan_to_null", "provenance_cols", "embedding_copy_audit", "linear_head_scores", "first_vector_pool", "pipeline_summary",
]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(catalogue.ORACLE_SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == cols
    want = sorted(repr([plain(r[theirs.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
