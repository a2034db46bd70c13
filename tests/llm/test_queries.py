"""The registered queries over whole tables: against their SQL, plain versions, or held-out accuracy."""

import collections
import zlib
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from tessera.llm.oracles import ORACLE_SQL
from tessera.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


def rows(table, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/{table}.parquet", columns=list(columns)).to_pylist()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_quality(spark):
    docs = rows("documents", "doc_id", "text")
    got = {r["doc_id"]: tuple(r)[1:8] for r in QUERIES["op9_quality"](spark, SF).collect()}
    kept = brute.quality_kept([t for _, t in docs])
    for (i, t), k in zip(docs, kept, strict=True):
        n, chars, symbols, dup, rep = brute.base_counts(t)
        assert got[i] == (n, chars, symbols, dup, rep, n < 50 or 100 * rep > 50 * n, k)


def test_packing(spark):
    docs = dict(rows("documents", "doc_id", "text"))
    got = collections.defaultdict(list)
    for r in QUERIES["op2_packing"](spark, SF).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]))
    bins = collections.defaultdict(list)
    for (i, _), raw in zip(docs.items(), brute.token_bytes(docs.values()), strict=True):
        pieces = [raw[a : a + 4 * 4096] for a in range(0, len(raw), 4 * 4096)]
        assert [x[:4] for x in sorted(got[i])] == [(k, 4096 * k, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(pieces)]
        for x in got[i]:
            bins[x[4]].append((x[5], x[2]))
    for own in bins.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096


@pytest.mark.parametrize(("name", "table", "column", "least"), [("op5_language", "documents", "lang", 0.97), ("op1_toxicity", "labels", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, table, column, least):
    truth = dict(rows(table, "doc_id", column))
    got = QUERIES[name](spark, SF).collect()
    assert len(got) == len(rows("documents", "doc_id"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["lang_pred"] if column == "lang" else r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(held) >= 10 and sum(a == b for a, b in held) >= least * len(held)


def test_shards(spark):
    got = QUERIES["op7_token_shards"](spark, SF).collect()
    total = sum(len(b) // 4 for b in brute.token_bytes([t for (t,) in rows("documents", "text")]))
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and sum(r["n_tokens"] for r in got) == total
