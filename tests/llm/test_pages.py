"""Page operators and the pipeline on small, awkward inputs."""

import random
import time

import pytest

from marksmith.llm import html_extract, url_filter


def extract(spark, rows):
    source = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(source).collect()}


def test_url_parts_and_stated_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net/fr", "ftp://example.com/de/",
            "http://x.org/fr/a", "http://org/fr", "no scheme", None, "http://badexample.net",
            "http://net/", "http://example.com/DE/", "a://b://c/d", "http://h.net?q=/en/"]
    rows = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, tokens string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"])
           for r in url_filter.judge_urls(rows, none).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/fr", "net/", "block"), ("example.com", "/de/", "example.com/de/", "block"),
        ("x.org", "/fr/a", "org/fr/", "allow"), ("org", "/fr", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("badexample.net", "", None, "allow"),
        ("net", "/", "net/", "block"), ("example.com", "/DE/", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("h.net", "", None, "allow")]


def test_mined_rules_equal_counting(spark):
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.example.org/en/{i}?ref=x") for i in range(300)]
    labels = [(i, 0 if i % 3 == 0 and i % 30 else 1, 0) for i in range(300)]
    labels += [(7, None, None), (None, 0, 1)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = url_filter.mine_rules(p, rows)
    got = {(tuple(r["tokens"]), r["verdict"]): (r["support"], round(r["confidence"], 6))
           for r in rules.collect()}
    assert got == {(("h:spam",), "block"): (90, 0.9), (("h:good",), "allow"): (200, 1.0)}
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(p, rules).collect()}
    assert verdicts == {i: "block" if i % 3 == 0 else "allow" for i in range(300)}
    assert url_filter.mine_rules(p, rows.limit(0)).count() == 0
    assert url_filter.judge_urls(p.limit(0), rules).count() == 0
    assert url_filter.judge_urls(p.union(p), rules).count() == 600


def test_tokens_of_equal_occurrence_are_one_item(spark):
    shared = "/".join(f"word{i}" for i in range(20))
    pages = [(i, f"http://host{i % 2}.example.org/{shared if i < 20 else 'other'}/p{i}") for i in range(400)]
    pages += [(1000, "http://h/word3/x"), (1001, "http://h/word/x"), (1002, f"http://h/{shared}")]
    rows = spark.createDataFrame([(i, 0 if i < 20 else 1, 0) for i in range(400)],
                                 "doc_id long, quality int, toxic int")
    p = spark.createDataFrame(pages, "page_id long, url string")
    rules = url_filter.mine_rules(p, rows)
    block = [r for r in rules.collect() if r["verdict"] == "block"]
    assert [(r["tokens"], r["support"], r["confidence"]) for r in block] == [(["p:word0"], 20, 1.0)]
    assert sorted(block[0]["members"][0]) == sorted(f"p:word{i}" for i in range(20))
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(p, rules).collect()}
    assert verdicts == {i: "block" if i < 20 or i in (1000, 1002) else "allow" for i, _ in pages}
    # too few labelled pages for any rule
    few = url_filter.mine_rules(p, rows.filter("doc_id < 4"))
    assert few.count() == 0


def test_article_without_boilerplate(spark):
    page = ("<html><head><title>t</title><script>var x='</p>';</script></head><body>"
            "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
            "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; co</h1>"
            "<p><b>First<br><p>sec<i>ond</i>\n  line<aside>side</aside>"
            "<section class=comments><p>reader</p></section></article>"
            "<form><p>join</p></form><footer>&copy; x</footer>")
    rows = [(1, "http://a/1", page, "c"), (2, "http://a/2", None, "c"), (3, None, "", "c"),
            (4, "x", "plain words", "c"), (4, "x", "plain words", "c"), (5, "y", "<p>a<p>b", "c")]
    got = extract(spark, rows)
    assert got[1] == "Title & co First second line"
    assert got[2] == got[3] == "" and got[4] == "plain words" and got[5] == "a b"
    assert html_extract.extract(spark.createDataFrame(
        [], "page_id long, url string, html string")).count() == 0


def test_constant_blocks_are_template(spark):
    rows = [(k, "http://h/x", f"<div class=top>Our site</div><div id=b><p>Story {k} about {k * 7}"
             f"<p>More of story {k}<p>Write to the editors</div><div>Imprint</div>", "c")
            for k in range(8)]
    got = extract(spark, rows)
    assert got == {k: f"Story {k} about {k * 7} More of story {k}" for k in range(8)}
    # copies of one page do not make a template
    copies = [(k, "http://h/x", rows[0][2], "c") for k in range(5)]
    assert "Story 0" in extract(spark, copies)[3]


def test_copies_of_an_article_are_no_template(spark):
    story = "<article><h1>The title</h1><p>The story itself</p><p>Its end</p></article>"
    bare = "<div id=story><p>The story itself</p><p>Its end</p></div>"
    rows = [(k, "http://same/x", f"<div class=ad>Buy {k}</div>{story}", "c") for k in range(3)]
    # many near copies beside a few other pages of the host
    rows += [(10 + k, "http://mixed/x", f"<nav>Menu {k}</nav>{story}<p>Read on {k}</p>", "c")
             for k in range(8)]
    rows += [(20, "http://mixed/x", "<article><p>Another</p></article>", "c")]
    # without an article: another advert, menu, comment or attribute makes no new page
    rows += [(30 + k, "http://bare/x", f"<nav>Menu {k}</nav><div class=ad>Buy {k}</div>{bare}"
              f"<div class=comments>Reader {k}</div><i data-k={k}></i>", "c") for k in range(5)]
    got = extract(spark, rows)
    whole = "The title The story itself Its end"
    assert {k: got[k] for k in range(3)} == dict.fromkeys(range(3), whole)
    assert {k: got[k] for k in range(10, 18)} == dict.fromkeys(range(10, 18), whole)
    assert got[20] == "Another"
    assert {k: got[k] for k in range(30, 35)} == dict.fromkeys(range(30, 35),
                                                              "The story itself Its end")


def test_roles_and_deep_containers(spark):
    menu, story = "<p>Home and away</p>", "<p>The story</p><p>Its end</p>"
    deep, named = "<div>" * 60, "<li class=x>" * 60
    around = "<nav>Menu</nav><div class=ad>Buy</div>{}<div class=comments>Reader</div><footer>End</footer>"
    rows = [f"<div role=banner>{menu}</div><div>{story}</div>",
            f"<div role=navigation>{menu}</div><div role=main>{story}</div>",
            f"<div>{story}</div><div role=navigation>{menu * 9}</div>",
            deep + around.format(story),
            deep + around.format(f"<article>{story}<nav>Menu</nav></article><p>{'More ' * 9}</p>"),
            named + around.format(f"<div>Other</div><main>{story}</main>")]
    got = extract(spark, [(i, f"http://h{i}/x", r, "c") for i, r in enumerate(rows)])
    assert got == dict.fromkeys(range(len(rows)), "The story Its end")


def test_all_parts_of_the_content(spark):
    links = "".join(f"<li><a href=/{k}>Link {k}</a>" for k in range(4))
    card = "<article class=card><p>Card</p></article>"
    pages = {
        "<div id=content><div class=part-a><p>First and longest part</p></div>"
        "<div class=part-b><p>Second</p></div></div>": "First and longest part Second",
        "<section><p>One</p></section><aside>Side</aside><section class=b><p>Two three</p></section>":
            "One Two three",
        f"<ul>{links}</ul><div><p>Before</p><p><a href=/x>A linked line</a></p><p>After</p>"
        f"<ul class=x>{links}</ul></div>": "Before A linked line After",
        f"<main><p>The story is long</p></main><div>{card * 3}</div>": "The story is long",
        f"<main><p>The story is long</p>{card}</main>": "The story is long Card",
        f"<main><p>List</p>{card}<article>Second card</article></main>": "Card Second card",
        "<article><img></article><main></main><div>Story</div>": "Story",
        f"<ul>{links}</ul>": "", "<p><a href=/x>Only a link</a></p>": "Only a link"}
    rows = [(i, f"http://h{i}/x", page, "c") for i, page in enumerate(pages)]
    assert extract(spark, rows) == dict(enumerate(pages.values()))


def test_names_do_not_empty_a_page(spark):
    story = "<p>The story is long</p><p>Its end</p>"
    article, whole = f"<article>{story}</article>", "The story is long Its end"
    card = "<article class=card><p>Card</p></article>"
    pages = {
        f"<div class='site-content no-sidebar'>{article}</div>": whole,
        f"<div class='layout has-header'><div class=header>Site</div>{article}</div>": whole,
        f"<div class='content sidebar-left'><nav>Menu</nav>{story}</div><p>Short</p>": f"{whole} Short",
        f"<div class=widget-area><main>{story}</main></div><div>{'More ' * 20}</div>": whole,
        f"<form id=aspnet><div class=login>Log in</div><div>{article}</div></form>": whole,
        f"<form role=form>{story}<fieldset>Search</fieldset></form>": whole,
        f"<div>{story}</div><form>Join</form><div class=site-footer>End</div>": whole,
        f"<div>{story}</div><div class=comments>{'Reader ' * 20}</div>": whole,
        f"<div>{story}</div><div class=related-posts>{card}</div>": whole,
        f"{article}<div class=related-posts>{card}</div>": whole,
        f"{article}<article id=comment-7 class=comment>Reader</article>": whole,
        f"<article class='post comments-open'>{story}</article><p>Short</p>": whole,
        "<article><header class='entry-header'><h1>Title</h1></header><p class=notice>A note</p>"
        "<p class='share-price'>Price</p><div class=share>Tweet</div>"
        "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math></p>"
        "<div class='share-list'>Shares</div></article>": "Title A note Price So x=2 Shares",
        f"<main><header class=entry-header><h1>Title</h1></header>{story}"
        "<div class=related-posts>Other</div></main>": f"Title {whole}"}
    rows = [(i, f"http://h{i}/x", page, "c") for i, page in enumerate(pages)]
    # most of the text is template, most of what varies is inside the form
    rows += [(100 + k, "http://form/x", f"<form><p>Story {k}</p></form><div>{'Imprint ' * 9}</div>", "c")
             for k in range(4)]
    assert extract(spark, rows) == {**dict(enumerate(pages.values())),
                                    **{100 + k: f"Story {k}" for k in range(4)}}


def test_tree_matching():
    a = html_extract.Page("<body><nav>x</nav><div class=q>w</div><article>y</article></body>")
    b = html_extract.Page("<body><nav>x</nav><article>y</article><footer>z</footer></body>")
    names = html_extract.align(a.tree(), b.tree())
    label = dict(enumerate(b.labels))
    assert [label.get(n) for n in names] == ["#", "body", "nav", None, "article"]


def plain_score(a, b):
    """Simple tree matching as defined: every pair of children, quadratic."""
    labels, parents, ref_labels, ref_parents = a.labels, a.parents, b.labels, b.parents
    if not parents:
        return 0

    def score(x, y):
        if labels[x] != ref_labels[y]:
            return 0
        u = [i for i, p in enumerate(parents) if p == x]
        v = [i for i, p in enumerate(ref_parents) if p == y]
        best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i, p in enumerate(u):
            for j, q in enumerate(v):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score(p, q))
        return best[-1][-1] + 1

    return score(0, 0)


def test_tree_matching_equals_brute_force():
    rng = random.Random(5)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in
                       rng.choices(["div", "div class=a", "section", "div class=b"], k=rng.randrange(5)))

    def closed(source):
        return source.replace("</div class=a>", "</div>").replace("</div class=b>", "</div>")

    for _ in range(150):
        a, b = (html_extract.Page(closed(tree(3))) for _ in range(2))
        names = html_extract.align(a.tree(), b.tree())
        found = [(i, n) for i, n in enumerate(names) if n >= 0]
        assert len(found) == plain_score(a, b)
        assert len({n for _, n in found}) == len(found)
        for i, n in found:  # equal labels, matched parents, order kept among children
            assert a.labels[i] == b.labels[n]
            assert i == 0 or names[a.parents[i]] == b.parents[n]
        for i, n in found:
            for j, m in found:
                if a.parents[i] == a.parents[j] and i < j:
                    assert n < m


def test_many_siblings_take_no_quadratic_time():
    def forum(names):
        return "<body>" + "".join(f"<div class={n}>{i}</div>" for i, n in enumerate(names)) + "</body>"

    letters = "abcdefghijklmnopqrstuvwxyz"
    distinct = [a + b + c for a in letters for b in letters for c in letters][:12000]
    for names in (["odd", "even"] * 10000, distinct, distinct[::-1]):
        page = html_extract.Page(forum(names))
        start = time.perf_counter()
        found = html_extract.align(page.tree(), page.tree())
        assert list(found) == list(range(len(page.labels)))
        html_extract.align(page.tree(), html_extract.Page(forum(distinct)).tree())
        assert time.perf_counter() - start < 20
        assert len(page.blocks) == len(names)


def test_template_nodes_and_slots_decide(spark):
    adverts = ["Buy our bread", "Fly to the sea", "Win a car"]
    body = "<div class=zz{}>{}</div><div class=yy><p>{}</p><p>{}</p></div>"
    rows = [(k, "http://rotating/x", body.format("", adverts[k % 3], f"Story {k} " + "is long " * 5,
                                                 f"End of {k}"), "c") for k in range(12)]
    # the same adverts on hosts with too few pages for a template stay
    rows += [(100 + k, f"http://alone{k}/x", body.format("", adverts[k % 3], f"Story {k}", f"End of {k}"), "c")
             for k in range(3)]
    # near copies of two long stories: every paragraph stands on half of the pages
    near = [" ".join(f"Part {i} of story {j}" for i in range(9)) for j in range(2)]
    parts = ["".join(f"<p>Part {i} of story {j}</p>" for i in range(9)) for j in range(2)]
    rows += [(200 + k, "http://near/x", f"<div class=yy>{parts[k % 2]}<p>Own line {k}</p></div>"
              f"<div class=zz>{adverts[k // 2 % 2]}</div>", "c") for k in range(8)]
    # an article in a template node beside the story's article
    rows += [(300 + k, "http://two/x", f"<article class=pick><p>{adverts[k % 3]}</p></article>"
              f"<article class=story><p>Report {k} " + "goes on " * 9 + "</p></article>", "c")
             for k in range(12)]
    # the only article is kept, whatever its node
    rows += [(400 + k, "http://one/x", f"<article><p>{adverts[k % 3]}</p></article>"
              f"<nav>Menu</nav><p>Line {k}</p>", "c") for k in range(12)]
    got = extract(spark, rows)
    for k in range(12):
        assert got[k] == f"Story {k} " + "is long " * 5 + f"End of {k}"
        assert got[300 + k] == f"Report {k} " + ("goes on " * 9).strip()
        assert got[400 + k] == adverts[k % 3]
    for k in range(8):
        assert got[200 + k] == f"{near[k % 2]} Own line {k}"
    for k in range(3):
        assert got[100 + k] == f"{adverts[k % 3]} Story {k} End of {k}"
    # without its wrapper a page keeps the advert: the wrapper changed the text
    page = html_extract.Page(rows[0][2])
    assert html_extract.content(page, html_extract.align(page.tree(), page.tree()), frozenset()).startswith("Buy")


@pytest.mark.parametrize("odd", ["<" * 2000, "<a href='" * 500, "<div>" * 3000 + "deep", "</p></div>" * 50,
                                 "<!-- never closed", "<script>var", "&#xD800; &bogus; &#0;"])
def test_odd_pages(odd):
    html_extract.Page(odd).tree()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    base = " ".join(f"token{i}" for i in range(60))
    leak = "a benchmark question that nobody should find in the training data of a model"
    rows = [(1, base, "en"), (2, base, "en"), (3, base.replace("token30", "changed"), "en"),
            (4, "before " + leak + " after", "en"), (5, None, "en"), (6, "12 34", "en"),
            (7, "der die das und nicht ein kurzer Text", "de"), (8, "", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "near_join", "decontamination", "sentencepiece"]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 7]


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline
    schema = ("doc_id long, text string, lang string, source string, n_chars long, key string, "
              "digest string, _row string, rep string, m long, copy boolean")
    extra = ("k", "d", "r", "p", 5, True)
    texts = [(1, "the cat sat on the mat and looked at the dog", "en"), (None, None, None), (2, "", None),
             (3, "the cat sat on the mat and looked at the dog", "en"), (4, "der Hund und die Katze im Haus", "de")]
    rows = [(i, t, lang, "s", len(t or ""), *extra) for i, t, lang in texts]
    for name, docs in (("none", []), ("some", rows)):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(
            f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert sorted(r["doc_id"] for r in got) == [3, 4] and all(r["n_tokens"] > 0 for r in got)
