import numpy as np

from tidegauge.llm import html_layout, permutation_index


def exact(x, ids, every, k):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            score = (x * x[i]).sum(1)
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[int(q)] = [int(ids[j]) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 1) for i, row in zip(ids, x)], "vec_id long, embedding array<float>, score int")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 24))).astype(np.float32).astype(float) * rng.uniform(0.5, 2.0, (3000, 1)).astype(np.float32)
    x = x.astype(np.float32).astype(float)
    ids = np.arange(3000)
    rows = permutation_index.nearest(frame(spark, ids, x), every=20).collect()
    want = exact(x, ids, 20, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert abs(r["score"] - float((x[r["query_id"]] * x[r["vec_id"]]).sum())) < 1e-9
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (20 * len(want)) >= 0.9


def test_blocks_ties_and_bad_vectors(spark, monkeypatch):
    same = [[1.0, 0.0]] * 300
    df = frame(spark, range(300), same)
    bad = spark.createDataFrame(
        [(1000, None, 1), (1020, [0.0, 0.0], 1), (1040, [float("nan"), 1.0], 1), (1060, [1.0, None], 1), (1080, [float("inf"), 1.0], 1), (1100, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (0, [1.0, 0.0], 1)], df.schema
    )
    rows = permutation_index.nearest(df.unionByName(bad), every=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == set(range(0, 300, 20))
    assert got[0] == list(range(1, 21)) and got[280] == list(range(20))
    few = permutation_index.nearest(frame(spark, [20, 3, 4], [[1.0, 2.0], [3.0, -1.0], [0.5, 0.5]]), every=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(few)] == [(20, 1, 4), (20, 2, 3)]
    assert permutation_index.nearest(df.limit(0), every=20).count() == 0


CASES = [
    ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>after", "- a\n- b\n  3. x\n  4. y\n\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Fig<td>12</table>", "Name   Qty\nApple  3\nFig    12"),
    ("<head><title>T</title><style>p{}</style></head><body>Hi<script>if (a</script>there</script> you</body>", "Hithere you"),
    ("<div hidden>no</div><div style='color:red; display:none'>no</div><div aria-x=1>yes</div><!-- no --><template>no</template>", "yes"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<pre>  x\n   y</pre>z", "  x\n   y\n\nz"),
    ("AT&amp;T &lt;tag&gt; 1 < 2", "AT&T <tag> 1 < 2"),
    ("<dl><dt>Term<dd>Meaning<dt>Other<dd>Thing</dl>", "Term\n  Meaning\nOther\n  Thing"),
    ("<details><summary>More</summary>hidden</details><details open><summary>S</summary>shown</details>", "More\nS\nshown"),
    ("plain", "plain"), ("", ""), (None, ""), ("<", "<"), ("<p", "<p"), ("</p>x", "x"), ("<p>a</div>b</p>", "ab"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a in  b"),
    ("<select><option>one<option>two</select>", "one\ntwo"),
]


def test_layout_cases():
    for page, want in CASES:
        if want is not None:
            assert html_layout.extract(page).strip("\n") == want, page


def test_all_visible_words_are_kept_once():
    page = "<body>" + "".join(f"<div><p>w{i} <i>x{i}</i><ul><li>y{i}</ul>" for i in range(300)) + "<table>" + "<tr><td>q<td>r" * 50
    got = html_layout.extract(page).split()
    assert [w for w in got if w != "-"] == [w for i in range(300) for w in (f"w{i}", f"x{i}", f"y{i}")] + ["q", "r"] * 50


def test_depth_and_length_do_not_matter():
    assert html_layout.extract("<div>" * 30_000 + "deep" + "</div>" * 10) == "deep"
    assert len(html_layout.extract("word " * 200_000)) == 999_999


def test_visible_text_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_layout.visible_text(df).collect()) == [("1", "a"), ("1", "a"), ("None", "")]
    assert html_layout.visible_text(df.limit(0)).count() == 0
