"""Main texts of made-up sites."""

from weft.llm import html_text
from weft.llm.common import stored


def page(k, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>T{k}</title><style>p{{x}}</style><script>var a="</p>{k}";</script></head><body><header><a href=/>Site</a></header><nav class="top"><ul><li><a>Home {k}</a><li><a>About</a></ul></nav>'
        f'<!-- <p>no</p> --><div class="ad">Buy {k}</div>{body}<aside>More {k}</aside>{extra}<form><input value="x"><button>Go</button></form><footer>&copy; {k}</footer></body></html>'
    )


ARTICLE = '<article><h1>Head {k} &amp; on</h1><p><b>First   {k}<br><p>Two<i>fold</i> &eacute;&#233;\n line</p><div class="share">Share</div></article><section id="comments"><p>Reader {k}</p></section>'
PLAIN = '<div class="body"><div class="text"><p>Long words {k} about something that matters here, number {k}.</p><p>And again {k}.</p></div></div><div class="box"><p>Always the same.</p></div>'


def rows(spark):
    out = [(k, f"https://a.example/{k}?x#y", page(k, ARTICLE.format(k=k))) for k in range(12)]
    out += [(100 + k, f"http://B.example:80/{k}", page(k, PLAIN.format(k=k * 7919))) for k in range(12)]
    out += [(200, "https://c.example/", None), (201, "https://c.example/", ""), (202, None, "<p>Alone</p>"), (203, "https://d.example/1", "no tags &lt;at&gt; all"), (204, "https://d.example/2", "<article><p>open <b>end"), (205, "", "<div><p>x<p>y</div></div></p>"), (None, "https://a.example/1", page(1, ARTICLE.format(k=1)))]
    return spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in out], "page_id long, url string, html string, text string, wrapper int")


def test_main_texts(spark):
    df = rows(spark)
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(df, stored).collect()}
    assert len(got) == df.count()
    for k in range(12):
        assert got[k] == f"Head {k} & on First {k} Twofold éé line"
        assert got[100 + k] == f"Long words {k * 7919} about something that matters here, number {k * 7919}. And again {k * 7919}."
    assert got[200] == got[201] == "" and got[202] == "Alone" and got[203] == "no tags <at> all" and got[204] == "open end" and got[205] == "x y" and got[None] == got[1]
    assert html_text.main_texts(df.limit(0), stored).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    df = spark.createDataFrame([(k, "https://a.example/", page(1, ARTICLE.format(k=1))) for k in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.main_texts(df, stored).collect()} == {"Head 1 & on First 1 Twofold éé line"}


def test_simple_tree_matching():
    tree = lambda s: html_text.folded([html_text.parsed(s)])
    a, b = tree("<div><p>1</p><ul><li>2</ul><h1>3</h1></div>"), tree("<div><p>1</p><h1>4</h1><hr></div>")
    assert html_text.matched(a.kids, b.kids)[0] == 3  # div, p, h1
    w = html_text.merged(a, b)
    div = w.kids[0]
    assert [(k.label, k.pages, k.const is None) for k in div.kids] == [("p", 2, False), ("ul", 1, False), ("h1", 2, True), ("hr", 1, False)]


def test_hosts():
    assert html_text.host("HTTPS://u:p@A.example/x?y") == "a.example" and html_text.host(None) == "" and html_text.host("//b.example#z") == "b.example"


def test_names_alone_do_not_empty_a_page():
    for source in (
        '<div class="content with-sidebar"><article><p>Text here.</p></article></div>', '<div id="page" class="site header-fixed"><article><p>Text here.</p></article></div>',
        '<article class="post comment-open"><p>Text here.</p></article>', '<div class="content with-sidebar"><p>Text here.</p></div><div class="sidebar">Side</div>', "<div>" * 3000 + "Text here." + "</div>" * 3000,
    ):
        assert html_text.extracted(source, None) == "Text here."
    assert html_text.extracted('<article><p>Short.</p></article><div class="post-comments"><p>Readers say much more than the article itself does.</p></div>', None) == "Short."


def test_hidden_nodes_are_slots_of_their_own(spark):
    df = spark.createDataFrame([(k, "https://a.example/", f'<div hidden>track {k}</div><div><p>Visible text number {k}.</p></div>') for k in range(3)] + [(9, "https://a.example/9", "<div><p>Without a box.</p></div>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(df, stored).collect()}
    assert got == {0: "Visible text number 0.", 1: "Visible text number 1.", 2: "Visible text number 2.", 9: "Without a box."}


def test_template_from_two_pages_on():
    page = lambda k: html_text.parsed(f'<article><div class="box">Always the same.</div><p>Own words {k}.</p></article>')
    trees = [page(k) for k in range(2)]
    w = html_text.decided(html_text.merged(*[html_text.folded([t]) for t in trees]))
    assert [html_text.text_below(t, w) for t in trees] == ["Own words 0.", "Own words 1."]


def random_page(rng, depth=0):
    tags = ["div", "p", "section", "ul", "h1", 'div class="a"', 'div class="nav-bar"', "article", "span"]
    return "".join(f"<{(t := rng.choice(tags))}>w{rng.randrange(4)} {random_page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else ''}</{t.split()[0]}>" for _ in range(rng.randrange(1, 4)))


def test_merging_does_not_depend_on_order():
    import random

    rng = random.Random(21)
    for _ in range(20):
        trees = [html_text.parsed(random_page(rng)) for _ in range(6)]
        seen = set()
        for _ in range(4):
            rng.shuffle(order := list(range(6)))
            w = None
            for k in order:
                s = html_text.folded([trees[k]])
                w = s if w is None else html_text.merged(w, s)
            w = html_text.decided(html_text.Slot.of(html_text.json.loads(html_text.json.dumps(w.flat()))))
            seen.add(tuple(html_text.text_below(t, w) for t in trees))
        assert len(seen) == 1


def test_matching_equals_brute_force():
    import random

    rng = random.Random(22)

    def best(a, b):  # every order-keeping choice
        if not a or not b:
            return 0
        skip = max(best(a[1:], b), best(a, b[1:]))
        return max(skip, 1 + best(a[0].kids, b[0].kids) + best(a[1:], b[1:])) if a[0].label == b[0].label else skip

    for _ in range(40):
        a, b = (html_text.folded([html_text.parsed(random_page(rng))]) for _ in range(2))
        size, pairs = html_text.matched(a.kids, b.kids)
        assert size == best(a.kids, b.kids) and pairs == sorted(pairs) and all(a.kids[i].label == b.kids[j].label for i, j in pairs)
