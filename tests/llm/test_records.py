"""Chat formatting and web archives: round trips and damage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc
from tessera.llm.chat import BY_FINGERPRINT, LAYOUTS, canonical_turns, fingerprint, format_chats, layout_of, read_loss_text, read_turns

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "[[INST]", "<s></s>", "[/ROLE]", "a\n$1\\$2 \\E \\Q", "", None, "é \U0001f600", "<<s>"]


def test_turns_round_trip(spark):
    rows = [(c, t, r, x) for c, (r, x) in enumerate(zip(["user", "assistant", "system", None, "[INST]", "a\nb"] * 2, NASTY, strict=True)) for t in range(1)]
    rows += [(50, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(NASTY)] + [(50, 3, "assistant", "again"), (None, 0, "user", "x"), (51, None, "user", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, extra int")
    made = format_chats(df).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in made.collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
    assert format_chats(df.limit(0)).count() == 0


def test_layouts(spark):
    assert len(BY_FINGERPRINT) == len(LAYOUTS) and fingerprint(["a:string", "b:number"]) == fingerprint(["b:number", "a:string"])
    cases = {
        "messages": ("messages array<struct<role:string,content:string>>", ([("user", "q"), ("assistant", "a")],)),
        "from_value": ("conversations array<struct<from:string,value:string>>", ([("human", "q"), ("gpt", "a")],)),
        "prompt_response": ("prompt string, response string", ("q", "a")),
        "prompt_completion": ("prompt string, completion string", ("q", "a")),
        "instruction": ("instruction string, input string, output string", ("q", None, "a")),
        "question_answer": ("question string, answer string", ("q", "a")),
    }
    for name, (schema, row) in cases.items():
        df = spark.createDataFrame([(1, *row)], f"conv_id bigint, {schema}")
        assert layout_of(df, "conv_id") == name
        assert [tuple(t) for t in canonical_turns(df).first()["turns"]] == [("user", "q"), ("assistant", "a")]
    both = spark.createDataFrame([(1, 0, "user", "x", "q", "a")], "conv_id bigint, turn int, role string, text string, prompt string, response string")
    assert layout_of(both, "conv_id") == "turn_rows" and [tuple(t) for t in canonical_turns(both).first()["turns"]] == [("user", "x")]
    with pytest.raises(ValueError):
        layout_of(spark.range(1).withColumnRenamed("id", "conv_id"), "conv_id")


PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://c/", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>x</p>"), (7, "l", "long " * 50_000)]


def test_archives(spark):
    df = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id bigint, url string, html string, digest int")
    got = sorted(((r["record_id"], r["warc_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["problem"]) for r in warc.archived(df).collect()), key=str)
    last = {}
    for p, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if p is None else p)
    name = lambda p: f"<{warc.PREFIX}{'none' if p is None else p}>"
    want = []
    for p, _, h in PAGES:
        body, own = (h or "").encode(), last[h or ""] == p
        want.append((name(p), "response" if own else "revisit", None if own else name(last[h or ""]), len(body), "sha1:" + warc.digest32(body), None))
    assert got == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def records(n):
    return [warc.record("response", f"r{k}", None, f"payload {k} ".encode() * 20, warc.digest32(f"payload {k} ".encode() * 20), None) for k in range(n)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.member(r) if packed else r for r in records(6)]
    whole = b"".join(parts)
    assert [x.problem for x in warc.read_archive(whole)] == [None] * 6
    at = [sum(map(len, parts[:k])) for k in range(7)]
    hurt = bytearray(whole)
    hurt[at[3] - 30] ^= 0xFF
    hurt = bytes(hurt[: at[4] + 15]) + bytes(hurt[at[5] :])
    found = list(warc.read_archive(hurt))
    good = [x.fields["warc-record-id"] for x in found if x.problem is None]
    assert good == ["<r0>", "<r1>", "<r3>", "<r5>"]
    assert found[0].begin == 0 and found[-1].end == len(hurt) and all(a.end == b.begin for a, b in zip(found, found[1:], strict=False))
    assert [(x.begin, x.end) for x in found if x.problem] == [(at[2], at[3]), (at[4], at[4] + 15)]
    # a cut in the record loses it; one in a member's trailer only doesn't, for its digest proves it
    cut = list(warc.read_archive(b"junk" + whole[: at[3] - 25]))
    assert [x.problem is None for x in cut] == [False, True, True, False]
    cut = list(warc.read_archive(b"junk" + whole[: at[3] - 5]))
    assert [x.problem is None for x in cut] == [False, True, True, packed]
    assert list(warc.read_archive(b"")) == []


def test_read_warc_from_a_path(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, records(3))))
    (tmp_path / "b.warc").write_bytes(b"".join(records(2))[:-10])
    x = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sum(r["problem"] is None for r in x) == 4 and sum(r["problem"] is not None for r in x) == 1
    assert {hashlib.sha1(r["payload"]).hexdigest() for r in x if r["payload"]}


def test_several_records_in_a_member():
    r = records(5)
    whole = warc.member(b"".join(r))
    found = list(warc.read_archive(whole))
    assert [x.fields["warc-record-id"] for x in found] == [f"<r{k}>" for k in range(5)]
    assert {(x.begin, x.end) for x in found} == {(0, len(whole))} and found[0].inside[0] == 0
    assert all(a.inside[1] == b.inside[0] for a, b in zip(found, found[1:], strict=False))
    bad = list(warc.read_archive(warc.member(r[0] + r[1].replace(b"payload 1", b"payload 9", 1) + r[2]) + warc.member(r[3])))
    assert [x.problem for x in bad] == [None, "payload digest differs", None, None] and bad[1].inside == (len(r[0]), len(r[0]) + len(r[1]))
    # a member cut short keeps the records that were inflated and proved
    noise = warc.record("response", "big", None, hashlib.sha512(b"x").digest() * 9999, None or "", None)
    cut = warc.member(r[0] + r[1] + noise)
    found = list(warc.read_archive(cut[: len(cut) - 40] + warc.member(r[4])))
    assert [x.fields.get("warc-record-id") for x in found if x.problem is None] == ["<r0>", "<r1>", "<r4>"]


def test_versions_and_folded_headers():
    one = b"WARC/0.17\r\nWARC-Type: response\r\nWARC-Record-ID:\r\n <a>\r\nWARC-Target-URI: http://x/\r\n\t y\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for version in (b"0.17", b"0.18", b"1.0", b"1.1", b"2.0"):
        for data in (one.replace(b"0.17", version), warc.member(one.replace(b"0.17", version)), b"junk" + warc.member(one.replace(b"0.17", version))):
            (x,) = (f for f in warc.read_archive(data) if f.problem is None)
            assert (x.fields["warc-record-id"], x.fields["warc-target-uri"], x.payload) == ("<a>", "http://x/ y", b"abc")


def test_unproved_records_are_kept_and_named():
    plain = [f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{k}>\r\nContent-Length: 5\r\n\r\nbody{k}\r\n\r\n".encode() for k in range(3)]
    proved = lambda data: [(f.fields.get("warc-record-id"), f.proved) for f in warc.read_archive(data) if f.problem is None]
    assert proved(warc.member(b"".join(plain))) == [("<0>", True), ("<1>", True), ("<2>", True)]
    assert proved(b"".join(plain)) == [("<0>", False), ("<1>", False), ("<2>", False)]
    noise = b"WARC/1.0\r\nContent-Length: 99999\r\n\r\n" + hashlib.sha512(b"y").digest() * 1500
    data = warc.member(b"".join(plain) + noise)
    found = list(warc.read_archive(data[:-30] + warc.member(records(1)[0])))
    assert [(f.fields.get("warc-record-id"), f.problem, f.proved) for f in found] == [("<0>", None, False), ("<1>", None, False), ("<2>", None, False), (None, found[3].problem, False), ("<r0>", None, True)]
    assert found[3].problem.startswith("gzip: ") and list(warc.read_archive(data[:-30]))[-1].problem == "gzip member cut short"
    assert found[2].inside[1] == found[3].inside[0] and found[3].end == found[4].begin


def test_large_members_are_read_in_pieces(monkeypatch):
    import tracemalloc
    import zlib

    body = b"0123456789abcdef" * 4096
    z, parts = zlib.compressobj(1, zlib.DEFLATED, 31), []
    for k in range(1_700):  # 111 MB of plain bytes
        parts.append(z.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n" % (k, len(body)) + body + b"\r\n\r\n"))
    data = b"".join([*parts, z.flush()])
    tracemalloc.start()
    n = 0
    for x in warc.read_archive(data):
        assert x.problem is None and x.proved and x.fields["warc-record-id"] == f"<{n}>" and x.payload_bytes == len(body) and x.end == len(data)
        n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_700 and peak < 50e6
    # pieces of any size give the same records and gaps
    r = records(40)
    hurt = b"".join(r[:10]) + b"x" * 3000 + b"".join(r[10:30])[:-20] + b"".join(r[30:])
    want = [(x.begin, x.end, x.problem) for x in warc.read_plain(hurt)]
    assert [p is None for _, _, p in want].count(True) == 39 and want[-1][1] == len(hurt)
    for step in (1, 7, 300, 1000):
        monkeypatch.setattr(warc, "STEP", step)
        assert [(x.begin, x.end, x.problem) for x in warc.read_plain(hurt)] == want
        assert [x.problem for x in warc.read_archive(warc.member(hurt))] == [p for _, _, p in want]


def test_spellings_of_digests_and_revisits():
    body = b"some payload"
    plain = warc.record("response", "a", None, body, warc.digest32(body), None)
    for digest in (warc.digest32(body).lower(), hashlib.sha1(body).hexdigest(), hashlib.sha1(body).hexdigest().upper()):
        x = warc.record("response", "a", None, body, digest, None)
        assert [f.problem for f in warc.read_archive(x)] == [None]
    assert [f.problem for f in warc.read_archive(plain.replace(b"sha1:", b"SHA1:"))] == [None]
    assert [f.problem for f in warc.read_archive(plain.replace(b"sha1:", b"md5:"))] == [None]
    empty = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <v>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    found = list(warc.read_archive(empty + plain))
    assert [(f.problem, f.payload_bytes) for f in found] == [(None, None), (None, len(body))]
