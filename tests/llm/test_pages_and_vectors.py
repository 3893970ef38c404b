"""HTML extraction and nearest neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repsight.llm.html_extraction import extract, extract_pages, host_paths
from repsight.llm.nearest import index, nearest, search
from llm.conftest import SF


def page(body):
    return f"<!DOCTYPE html><html><head><title>no</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_boilerplate():
    body = """<nav><a href="/x">menu</a></nav><div class="cookie-notice">accept</div><article><h1>Title &amp; more</h1><p><b>First
      <i>para</i>graph &lt;1&gt;<br><p>Second <a href="a>b">link</a> here<form>send</form></article><section class="comments"><p>me too</p></section>
      <aside>side</aside><div class='ad'>buy</div><!-- <p>hidden</p> --><footer>&copy; me</footer>"""
    assert extract(page(body), None) == "Title & more\nFirst paragraph <1>\nSecond link here"


def test_nested_containers_and_broken_markup():
    body = "<div class='wrap7'><div class=menu>home</div><div class='content x12'><p>" + "</p><p>".join(f"paragraph number {i} with words" for i in range(5)) + "</div></div><p>stray"
    assert extract(page(body), None).split("\n") == [f"paragraph number {i} with words" for i in range(5)]
    assert extract("plain text, no markup", None) == "plain text, no markup"
    assert extract("<script>never closed <p>x</p>", None) == ""
    assert extract("<p>a < b && c</p>", None) == "a < b && c"


def test_host_path_wins(llm):
    good = "<div class='story'>" + "".join(f"<p>story text {i} is rather long and good</p>" for i in range(4)) + "</div>"
    odd = "<div class='junk9'>" + "".join(f"<p>list {i} of things that are longer than all else on this page here</p>" for i in range(4)) + "</div>"
    rows = [(i, f"http://Host.example/{i}", page(good)) for i in range(9)] + [(9, "https://host.example:80/9", page(good + odd))]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.path.split(">")[-1] for r in host_paths(pages).collect()] == ["div.story"]
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert len(got) == 10 and got[0].startswith("story text 0")


def test_boilerplate_words_do_not_cover_the_article():
    text = "\n".join(f"paragraph number {i} of the article with words" for i in range(6))
    article = "".join(f"<p>{t}</p>" for t in text.split("\n"))
    around = "<nav><a href='/'>home</a></nav>{}<footer>about this site</footer>"
    for attributes in ("div class='content no-sidebar'", "div class='page has-sidebar'", "div class='layout with-header'", "div id='search-results'", "form id='aspnetForm'", "div class='comments-open' id=search"):
        body = f"<{attributes}><div class=sidebar>side text</div>{article}</{attributes.split()[0]}>"
        assert extract(page(around.format(body)), None) == text, attributes
    for name in ("div class='entry-header'", "div class='section-header'", "header"):
        assert extract(page(around.format(f"<article><{name}><h1>Title</h1></{name.split()[0]}>{article}</article>")), None) == "Title\n" + text, name
    comments = "<section class=comments>" + "<p>me too, and a lot more of it, again and again</p>" * 20 + "</section>"
    assert extract(page(around.format(f"<article>{article}</article>{comments}")), None) == text
    assert extract(page("<header><h1>Site</h1></header><article><p>short text</p></article><aside>long side text, much longer than the article</aside>"), None) == "short text"


def test_whole_article_over_several_containers():
    lead, body = "lead words " * 9, [f"sentence number {i} of the body, " * 3 for i in range(9)]
    paragraphs = "".join(f"<p>{t}</p>" for t in body)
    want = "\n".join(" ".join(t.split()) for t in ("T", lead, *body))
    links = "<div class=more>" + "".join(f"<p><a href=/{i}>another article of the site, number {i}, to be read</a></p>" for i in range(9)) + "</div>"
    for outer in ("div class=post", "article", "section"):
        for bodied in (f"<div class=body>{'. '.join(body)}</div>", f"<div class=body>{paragraphs}</div>"):
            got = extract(page(f"<nav>menu</nav><{outer}><h1>T</h1><div class=lead>{lead}</div>{bodied}</{outer.split()[0]}>{links}<footer>end</footer>"), None)
            assert got.split("\n")[:2] == want.split("\n")[:2] and "sentence number 8" in got and "another article" not in got, (outer, got)
    got = extract(page(f"<div class=post><div class=lead>In short.</div><div class=body>{paragraphs}</div><div class=end>The end.</div></div>"), None)
    assert got.split("\n") == ["In short.", *map(str.strip, body), "The end."]
    halves = f"<div class=left>{paragraphs}</div><div class=ad>buy this now</div><div class=right><h2>Part two</h2>{paragraphs}</div>"
    got = extract(page(halves), None)
    assert got == "\n".join([*map(str.strip, body), "Part two", *map(str.strip, body)])
    assert extract(page(halves), "html>body>div.left") == extract(page(halves), "html>body>div.right") == got


def test_page_edges(llm):
    rows = [(1, None, None), (2, "not a url", ""), (2, "not a url", ""), (None, "http://h/1", page("<p>hello  \n world</p>")), (3, "http://h/2", page("<p>" + "word " * 300_000 + "</p>")),
            (4, "http://h/3", page("<div>" * 3000 + "deep" + "</div>" * 3000))]
    pages = llm.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    got = sorted(extract_pages(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.text[:11] for r in got] == ["", "", "", "word word w", "deep", "hello world"] and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(pages.limit(0)).collect() == []


def test_recall_and_exact_scores(llm):
    rows = llm.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()]
    ids, v = np.array([x[0] for x in data]), np.stack([x[1] for x in data])
    got = {}
    for r in nearest(rows, F.col("vec_id") % 50 == 0, block_rows=700).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        one = v[ids == q][0]
        score = (v @ one) / (np.linalg.norm(v, axis=1) * np.linalg.norm(one))
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[ids == i][0]) < 1e-12 for _, i, s in mine)
        hit, total = hit + len(set(best.tolist()) & {m[1] for m in mine}), total + 5
    assert hit >= 0.9 * total


def test_vector_edges(llm):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [1.0, float("nan")]), (200, [float("inf"), 1.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 1.0]),
            (None, [1.0, 0.0]), (4, [1.0, None]), (5, []), (6, [-1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (250, [5.0])]
    frame = llm.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 6)]
    assert nearest(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_repeated_query_ids_and_blocks_of_any_size(llm):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [1.0, 0.1])]
    frame = llm.createDataFrame(rows * 3, "vec_id long, embedding array<double>")
    want = None
    for block_rows in (1, 4, 1000):
        got = [tuple(r) for r in nearest(frame, F.col("vec_id") == 0, block_rows=block_rows).orderBy("query_id", "rank").collect()]
        assert want in (None, got)
        want = got
    assert [r[2] for r in want] == [1, 1, 1, 1, 1]  # of the rows of id 0 the smallest vector, (0, 1), asks


def test_vectors_are_shuffled_once(llm):
    from repsight.plans.inspect import plan_text
    frame = llm.range(20_000).selectExpr("id as vec_id", "array(rand(1), rand(2), rand(3)) as embedding")
    text = plan_text(nearest(frame, F.col("vec_id") % 50 == 0, block_rows=2000), "simple")
    assert text.count("Generate explode") == 1 and "FlatMapCoGroupsInPandas" not in text  # only queries are copied


@pytest.mark.parametrize("dim", [64, 256])
def test_share_verified_on_clustered_vectors(dim):
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((60, dim))
    v = centres[rnd.integers(0, 60, 6000)] + 0.25 * rnd.standard_normal((6000, dim))
    ids = np.arange(6000)
    queries = ids[::50]
    found, verified = search(index(v, ids, 24), v[queries], queries, 5, 0.75, 1.645, 1.3)
    cosines = (v[queries] @ v.T) / (np.linalg.norm(v[queries], axis=1)[:, None] * np.linalg.norm(v, axis=1))
    cosines[np.arange(len(queries)), queries] = -9
    best = {(q, i) for q, row in zip(queries, np.argsort(-cosines, axis=1)[:, :5], strict=True) for i in row}
    assert verified <= 0.2 * len(queries) * len(v)
    assert len(best & {(q, i) for q, i, _ in found}) >= 0.9 * len(best)


@pytest.mark.parametrize("fragment, text", [
    ("<b>x", "x"), ("<span>hi<p>y</p></span>", "hi\ny"), ("<a>top<p>para</p>", "top\npara"), ("<font>intro text<hr>more", "intro text\nmore"),
    ("<title>T</title><b>hi<p>x", "hi\nx"), ("<a href=x>hi<div>d</div></a>", None), ("text<div><p>one</p></div>tail", None), ("</p></div>stray", "stray"), ("<", "<"), ("<div", "<div")])
def test_fragments_of_any_shape(fragment, text):
    got = extract(fragment, None)
    assert got == text if text is not None else got


def test_fragments_through_spark(llm):
    rows = [(k, "http://h.example/", f) for k, f in enumerate(["<b>x", "<a href=x>hi<div>d</div></a>", "<i>" * 50, "a<hr>b", "<p hidden>no</p>", None])]
    got = {r.page_id: r.text for r in extract_pages(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "x" and "hi" in got[1] + "hi" and got[2] == "" and got[3] == "a\nb" and got[4] == "" and got[5] == ""


def test_hidden_elements_are_dropped():
    shown = "<p>Shown text of the page, in full.</p>"
    for attributes in ("hidden", "class=x hidden", 'style="display:none"', "style='color:red; Display : None'", 'style="visibility: hidden"', 'hidden=""'):
        assert extract(page(f"<article>{shown}<p {attributes}>Not shown.</p>{shown}</article>"), None) == "Shown text of the page, in full.\n" * 1 + "Shown text of the page, in full."
    for attributes in ('title="hidden"', "class=not-hidden-now", 'data-x="a hidden b"'):
        assert "Is shown" in extract(page(f"<article>{shown}<p {attributes}>Is shown.</p>{shown}</article>"), None)


def test_marked_prose_inside_the_text_stays():
    prose = "Earlier authors came to much the same result, though by another road, and their work is taken up again in the part that follows here."
    plain = "<p>This paragraph is plain text of the article and long enough to count.</p>"
    for name in ("related-work", "editor-comment", "share-price-table-note"):
        got = extract(page(f"<article><h1>T</h1>{plain}<p class={name}>{prose}</p>{plain}</article>"), None)
        assert prose in got, name
        linked = extract(page(f"<article><h1>T</h1>{plain}<div class={name}><a href=x>{prose}</a></div>{plain}</article>"), None)
        assert prose not in linked, name
    for name in ("related", "comment", "cookie-notice", "newsletter-signup", "share-links", "ad-slot-3"):
        assert prose not in extract(page(f"<article><h1>T</h1>{plain}<p class={name}>{prose}</p>{plain}</article>"), None), name
    assert extract(page(f"<div class=post><div class=header><h1>The title</h1></div>{plain}{plain}</div>"), None).startswith("The title\n")
    assert "Site" not in extract(page(f"<div class=header><h2>Site</h2></div><div class=post><h1>T</h1>{plain}{plain}</div>"), None)


def test_deep_pages_need_memory_in_proportion():
    import tracemalloc
    deep = "<div class=abc>x " * 60_000  # a megabyte, each level with a text of its own
    tracemalloc.start()
    got = extract(deep, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.count("x") > 0 and peak < 400 << 20


def test_known_articles_on_generated_pages(llm):
    import random
    rnd = random.Random(12)
    words = lambda n: " ".join(rnd.choice("the of river house people found water after long small year".split()) for _ in range(n)).capitalize() + "."
    rows, want = [], {}
    for k in range(200):
        host = k % 6
        lines = [words(4), *[words(rnd.randrange(15, 60)) for _ in range(rnd.randrange(2, 8))]]
        body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" if rnd.random() < 0.9 else f"<ul><li>{x}</li></ul>" for x in lines[1:])
        around = ("<article>{}</article>", "<div class='post-{}'>{{}}</div>".format(k), "<main><div id=content>{}</div></main>", "<div class=wrap><section class=entry>{}</section></div>",
                  "<td class=story>{}</td>", "<form id=aspnetForm><div class=text>{}</div></form>")[host].format(body)
        menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(8)) + "</ul></nav>"
        frame = f"<div class='cookie-banner'>{words(12)}</div><header><a href=/>Home</a></header>{menu}{around}<div class=comments><p>{words(20)}</p></div><aside>{words(15)}</aside><footer>{words(9)}</footer>"
        rows.append((k, f"https://h{host}.example/{k}", page(frame)))
        want[k] = lines
    got = {r.page_id: r.text.split("\n") for r in extract_pages(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_host_paths_join_without_broadcast(llm, monkeypatch):
    from repsight.llm import html_extraction
    pages = llm.read.parquet(f"{SF}/pages.parquet").limit(60)
    want = sorted((r.page_id, r.text) for r in extract_pages(pages).collect())
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.text) for r in extract_pages(pages).collect()) == want
