"""Page text, hard negatives and whitening against plain versions, over whole tables and odd small ones."""

import html
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import charpoly, html_text, whitening
from tessera.llm.hard_negatives import SortedLists, hard_negatives, score_window, threshold_search
from tessera.llm.html_blocks import blocks
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "word " * 60


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.fit(html_text.labelled(spark))


def article(page):
    """The headline and paragraphs of a given page, by splitting at their tags."""
    body = page[page.find("<article>") : page.find("</article>") if "</article>" in page else len(page)]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body))
    return "\n\n".join(x for x in parts if x)


def test_text_of_given_pages(spark):
    want = {r["page_id"]: (r["url"], article(r["html"])) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in QUERIES["op11_html"](spark, SF).collect()}
    assert got == want


PAGES = {
    "blog": (
        f"""<head><title>T</title></head><body class="has-sidebar"><header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></nav>
        <div id="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>
        <main><article class="post comments-open"><header class="entry-header"><h1>My <em>title</em> &amp; more</h1></header><p>{LONG}<a href=x>link</a>&nbsp; more&hellip;</p><p>Short.</p><div class="ad-slot">Buy now.</div>
        <ul><li>first<li>second</ul><pre>a  b\nc</pre><table><tr><td>c1<td>c2</table><p>End.</div><footer>Filed under <a href=t>Tag</a></footer></article>
        <section id="comments"><ol><li class="comment"><article class="comment-body"><p>{LONG}</p></article></ol><form><label>Name</label><textarea>hi</textarea></form></section></main>
        <aside><p>{LONG}</p></aside><footer>&copy; Site</footer><script>var x="<p>no</p>"</script></body>""",
        ["My title & more", f"{LONG}link more…", "Short.", "first", "second", "a b c", "c1", "c2", "End."],
    ),
    "divs": (
        f"<body><div><a href=1>Home</a> | <a href=2>News</a></div><div><h1>Headline of the day</h1></div><div>{LONG}</div><div>Short.</div><div>{LONG}<br>after</div><div><a href=4>More news</a></div><div>Copyright <a href=6>Privacy</a> <a href=7>Terms</a></div>",
        ["Headline of the day", LONG.strip(), "Short.", f"{LONG}after"],
    ),
    "form around all": (f"<form id=f><div id=menu><a href=1>Home</a></div><div id=content><h2>Hi</h2><p>{LONG}</p><p>x < y</p></div></form>", ["Hi", LONG.strip(), "x < y"]),
    "cut": ("<article><p>One two</p><p>Three fo<b", ["One two", "Three fo"]),
    "text": ("just text &lt;b&gt; here", ["just text <b> here"]),
    "quote that never ends": ('<p a="x>y</p><p>ok</p>', ["y", "ok"]),
    "comment that never ends": ("<p>a b c</p><!-- <p>no</p>", ["a b c"]),
    "hidden": ('<article><p>shown</p><p style="display: none">no</p><template><p>no</p></template><p hidden>no</p></article>', ["shown"]),
    "empty": ("", []),
    "null": (None, []),
}


def test_text_of_other_layouts(spark, tree):
    rows = [(k, h, 7) for k, (h, _) in PAGES.items()]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id string, html string, TEXT int"), tree)
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {k: (t := "\n\n".join(want), len(t)) for k, (_, want) in PAGES.items()}
    assert html_text.main_text(spark.createDataFrame([], "page_id int, html string"), tree).count() == 0


def test_long_and_nested_pages_take_linear_time():
    n = 100_000
    assert len(blocks("<p>x" * n)) == n
    assert blocks("<div>" * n + "deep" + "</p></b>" * n)[0]["text"] == "deep"
    assert blocks("<!-- " * n) == [] and blocks("<a b='" * n) == [] and len(blocks("< " * n)) == 1


def plain_negatives(rows, is_anchor):
    """rows: (id, label, whole components)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, a in rows:
        if not is_anchor(i):
            continue
        all_ = sorted((-dot(a, v), j, other == label) for j, other, v in rows if j != i)
        for s, p, _ in [x for x in all_ if x[2]][:5]:
            inside = [x for x in all_ if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, rank, j, -s, -n) for rank, (n, j, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 3, 200])
def test_hard_negatives(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(i), int(rng.integers(4)), [int(v) for v in rng.integers(-spread, spread + 1, 6)]) for i in range(400)]
    rows += [(i + 400, 1, rows[0][2]) for i in range(150)]  # a third are copies
    df = spark.createDataFrame([(i, c, [v / 256 + 0.001 for v in x], "x") for i, c, x in rows] + [(None, 1, [1.0] * 6, "x"), (900, None, [1.0] * 6, "x"), (1000, 1, None, "x"), (1100, 2, [1.0, None], "x"), (1200, 2, [1.0, math.nan], "x"), (1300, 2, [math.inf], "x")], "vec_id long, label int, embedding array<double>, ANCHOR string")
    got = hard_negatives(df, F.col("vec_id") % 20 == 0)
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want and want


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, 1, [1.0])], schema), F.col("vec_id") == 0).count() == 0
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.0, 0.5]), (3, 2, []), (4, 3, [0.0, 0.5])]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()))
    # both rows of id 1 are positives; ties go by id
    assert got == sorted(2 * [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 4, 65536, 32768)])
    # beyond what doubles tell apart
    huge = [(0, 1, [1e6, 3.0]), (1, 1, [1e6, 1.0]), (2, 2, [5e5, 7.0])]
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(huge, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2, (10**12 + 3) * 65536, (5 * 10**11 + 21) * 65536)]


def test_threshold_stops_early_and_windows():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(5_000, 4)) * 50)
    x[:, 1:] = np.floor(x[:, 1:] / 50)
    lists = SortedLists(np.arange(len(x)), x)
    looked = []
    lists.x = type("Counted", (np.ndarray,), {"__getitem__": lambda self, k: (looked.append(len(k)), np.asarray(self)[k])[1]})(x.shape, buffer=np.ascontiguousarray(x), dtype=x.dtype)
    (best,) = threshold_search(lists, np.array([9.0, 1.0, -1.0, 0.0]), [(None, None)], 5, np.ones(len(x), dtype=bool))
    s = x @ [9, 1, -1, 0]
    assert best == [(int(s[i]), int(i)) for i in np.lexsort((np.arange(len(x)), -s))[:5]]
    assert sum(looked) < len(x) / 2
    assert score_window(10, 30, 90) == (3, 9) and score_window(1, 30, 90) is None and score_window(0, 30, 90) == (0, 0) and score_window(-10, 30, 90) is None


def test_polynomial_and_roots():
    moduli = charpoly.primes(80)
    residues = charpoly.modular_polynomials([[2, 1], [1, 2]], moduli)
    assert charpoly.remaindered([(p, [int(v) for v in r]) for p, r in zip(moduli, residues, strict=True)]) == [3, -4, 1]
    poly = [-6 * 7, 6 + 7 * 6 + 7, -(6 + 7 + 1), 1]  # 1, 6, 7
    assert [charpoly.roots_above(poly, a, 0) for a in (0, 1, 5, 6, 7)] == [3, 2, 2, 1, 0]
    found = [charpoly.refined(poly, low, e, n) for _, low, e, n in charpoly.isolated(poly, 3)]
    assert [round((low + 0.5) * 2.0**e, 12) for low, e in found] == [7, 6, 1]
    twice = [16, -24, 9, -1]  # 4, 4, 1
    assert [(k, n) for k, _, _, n in charpoly.isolated(twice, 3)] == [(1, 2), (3, 1)]


def whitened_of(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    model = whitening.fit(df, **kw)
    return model, whitening.whiten(df, model)


def test_whitening_of_given_vectors(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x = np.floor(64 * np.array(t["embedding"], dtype=float)).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    want = dict(zip(t["vec_id"], centred @ u[:, ::-1] / np.sqrt(e[::-1]), strict=True))
    got = QUERIES["op13_whitening"](spark, SF).toPandas()
    assert sorted(got["component"].unique()) == list(range(1, 33)) and len(got) == 32 * n
    assert (got["n"] == n).all() and got["identity_error"].max() < 1e-12
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(zip(t["vec_id"], (((n * x - total) ** 2).sum(axis=1)).tolist(), strict=True))
    for c, part in got.groupby("component"):
        theirs = np.array([want[i][c - 1] for i in part["vec_id"]])
        mine = part["whitened"].to_numpy()
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-8
        assert abs(part["explained"].iloc[0] - e[::-1][c - 1] / e.sum()) < 1e-12


def test_whitening_of_odd_tables(spark):
    model, got = whitened_of(spark, [])
    assert (model.n, model.eigenvalues, got.count()) == (0, [], 0)
    model, got = whitened_of(spark, [(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)])
    assert (model.n, model.eigenvalues, got.count()) == (2, [], 0)
    # nulls take no part, short vectors end in zeros, equal eigenvalues, one of 0; null and repeated keys
    rows = [(1, [1.0, 0.0, 5.0], 0), (1, [-1.0, 0.0, 5.0], 0), (None, [0.0, 1.0, 5.0], 0), (3, [0.0, -1.0, 5.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [math.nan], 0), (7, [-math.inf, 1.0], 0)]
    model, got = whitened_of(spark, rows, scale=1.0)
    assert model.n == 4 and np.allclose(model.eigenvalues, [0.5, 0.5]) and model.identity_error < 1e-12
    assert np.allclose(model.projections @ model.projections.T, 2 * np.eye(2)) and np.allclose(model.explained, 0.5)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 8 and {int(r["deviation"]) for r in got.collect()} == {16}
    model, _ = whitened_of(spark, [(1, [4.0], 0), (2, [], 0)], scale=1.0)
    assert model.sums == [4] and np.allclose(model.eigenvalues, [4.0])
    big, _ = whitened_of(spark, [(1, [3e9, 1.0], 0), (2, [-3e9, 5.0], 0), (3, [1.0, 2.0], 0)], scale=1.0)
    assert big.n == 3 and abs(big.eigenvalues[0] / 6e18 - 1) < 1e-6
