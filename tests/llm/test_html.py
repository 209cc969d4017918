from gridloom.llm import html

P = ["This is the first paragraph of the article, and it runs on for a while.", "Short one.", "A third &amp; last paragraph with &eacute; and some more words in it."]
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><header>Site header text that is long enough to matter</header>"
    "<div class='ad'>Buy this very good thing now, it is really very cheap today.</div>{0}"
    "<aside>Related reading that goes on and on in the side bar</aside><div id='comments'><p>I am a reader and this is my long opinion.</p></div>"
    "<form><label>Mail</label><input><button>Send it</button></form><footer>&copy; somebody, all rights reserved everywhere</footer></body></html>"
)
WANT = "Title\n\n" + "\n\n".join(P).replace("&amp;", "&").replace("&eacute;", "é")


def test_article_and_main_and_plain_divs():
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in P)
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "{}"):
        assert html.main_text(PAGE.replace("{0}", around.format(body))) == WANT
    loose = "<h1>Title</h1>" + "".join(f"<p><b>{p}<br>" for p in P)
    assert html.main_text(PAGE.replace("{0}", f"<article>{loose}</article>")) == WANT


def test_edges():
    assert html.main_text(None) == html.main_text("") == html.main_text("<html></html>") == ""
    assert html.main_text("just   text\n here") == "just text here"
    assert html.main_text("<p>cut off in the middle of a ta<b") == "cut off in the middle of a ta"
    assert html.main_text("<article><p>one</p><table><tr><td>a</td><td>b</td></tr></table><![x[<p>two</p></article>")
    assert html.main_text("<article><p>" + "word " * 50_000 + "</p></article>") == ("word " * 50_000).strip()
    assert html.main_text("<article>" + "<p>x y z</p>" * 3000 + "</article>").count("\n\n") == 2999
    assert html.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_frame(spark, sf):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>some text</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as text", "1 as n_chars")
    got = sorted(map(str, (tuple(r) for r in html.extract(df).collect())))
    assert got == sorted(map(str, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "some text", 9)]))
    assert html.extract(df.limit(0)).count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert html.extract(pages).filter("n_chars = 0").count() == 0


def test_smoothing_keeps_constants():
    assert all(abs(x - 2.0) < 1e-12 for x in html.smoothed([2.0] * 9))


def test_content_outside_of_articles_stays():
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in P)
    teaser = "<article><p>A teaser card that is long enough to pass the threshold of the page by itself.</p></article>"
    for page in (f"<div class='content'>{body}</div>{teaser}", f"{teaser}<div class='content'>{body}</div>"):
        got = html.main_text(PAGE.replace("{0}", page)).split("\n\n")
        assert set(WANT.split("\n\n")) <= set(got) and len(got) == 5


def test_inline_furniture_loses_its_own_text_only():
    long = "A long paragraph that goes on for quite a while, and then some more of it."
    for p, want in (
        (f"<span class='share'>Share</span> {long}", long), (f"<label>Note</label>{long}", long), (f"{long}<button>Send</button>", long),
        ("The first half of it,<span class='ad'>buy now</span> and the <b class='promo'>cheap</b> second half; done.", "The first half of it, and the second half; done."),
        ("One sentence that ends here.<button>Share</button>Another sentence follows.", "One sentence that ends here. Another sentence follows."),
        ("A word<span class='ad'>buy now</span>, and more words that follow on it.", "A word, and more words that follow on it."),
    ):
        assert html.main_text(f"<article><h1>Title</h1><p>{p}</p><p><span class='share'>Share this</span></p></article>") == f"Title\n\n{want}"


TEMPLATES = [
    "<body><nav><a href='/'>Home</a></nav><article>{}</article><footer>All rights reserved</footer></body>",
    "<body><header><h1>The site</h1></header><main>{}</main><aside>Read more about other things</aside></body>",
    "<body><div id='sidebar'><p>Some words about the author of this site.</p></div><div id='content'>{}</div></body>",
    "<table><tr><td class='nav-links'><a>One</a> <a>Two</a></td></tr><tr><td>{}</td></tr></table>",
    "<body><div class='cookie-notice'>We use cookies on this site, as all do.</div>{}<div class='comments'><p>I don't agree at all.</p></div></body>",
    "<body><ul class='menu'><li><a>A</a><li><a>B</a></ul><section>{}</section><form>Mail <input> <button>Go</button></form></body>",
    "<body>{}<div role='complementary'>Elsewhere on this site there is more.</div></body>",
    "<div><div class='ad-banner'>Buy this now.</div><div><div>{}</div></div><div class='share buttons'>Share it</div></div>",
    "<body><div hidden>Not to be seen by anyone.</div><article>{}<aside>Beside the point, this one.</aside></article></body>",
    "<body><script>var a = '<p>no</p>';</script><noscript>Turn it on</noscript><article>{}</article><!-- <p>gone</p> --></body>",
    "<body><dialog open>Sign up to read more of this</dialog><div class='post-list'>{}</div><div class='newsletter-signup'>Sign up here.</div></body>",
]


def test_page_templates():
    for t in TEMPLATES:
        for order in (P, P[::-1], P * 4):
            want = "\n\n".join(["Title", *order]).replace("&amp;", "&").replace("&eacute;", "é")
            assert html.main_text(t.replace("{}", "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in order))) == want, t


def test_words_in_an_id_or_class_do_not_delete_content():
    body = "".join(f"<p>{p}</p>" for p in P)
    for start, end in (("<div id='search-space'>", "</div>"), ("<div class='social-studies'>", "</div>"), ("<section id='comment-on-method'>", "</section>")):
        assert html.main_text(f"<article>{start}<h2 id='social-effects'>Effects</h2>{body}{end}</article>").startswith("Effects\n\nThis is the first")
    assert html.main_text("<article><p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of two <svg><text>no</text></svg>terms.</p></article>") == "The sum x+y of two terms."
    assert html.marks("ad") and html.marks("site-footer dark") and html.marks("x ad3") and not html.marks("adventure") and not html.marks("main content")


def brute(lines, sigma, share, reach):
    """Which lines are content, by numpy over the whole page at once."""
    import numpy as np

    r = np.array([0.0 if f else np.log1p(len(t) / max(1, n)) for t, n, f, *_ in lines])
    if not r.any():
        return [False] * len(lines)
    size = np.array([len(t) for t, *_ in lines]) * (r > 0)
    at = np.arange(len(r))
    far = np.abs(at[:, None] - at[None, :])
    w = np.where(far <= max(1, np.ceil(3 * sigma)), np.exp(-0.5 * (far / sigma) ** 2), 0)
    on = (w @ r) / w.sum(axis=1) >= share * (r @ size) / size.sum()
    for i in at[on]:
        for j in at[on]:
            if i < j <= i + reach + 1 and not on[i + 1 : j].any() and lines[i][3] == lines[j][3]:
                on = on | ((at > i) & (at < j))
    for i in at[:-1][::-1]:
        on[i] |= lines[i][4] and on[i + 1] and r[i + 1] > 0
    return [bool(x) for x in on & (r > 0)]


def test_clusters_match_brute_force(sf):
    import random

    import pyarrow.parquet as pq

    r = random.Random(2)
    made = [
        "<body>" + "".join(f"<{t}{r.choice(['', ' class=ad', ' id=x'])}>{'word ' * r.choice([1, 2, 9, 80])}</{t}>" for _ in range(r.randrange(1, 40)) for t in [r.choice(["p", "div", "li", "nav", "h2"])])
        for _ in range(150)
    ]
    for page in made + pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist():
        lines = html.parsed(page)
        assert html.selected(lines) == brute(lines, html.SIGMA, html.THRESHOLD, html.REACH)


def test_smoothing_decides(sf, monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet")["html"].to_pylist()
    page = "<p>" + "long paragraph " * 20 + "</p><p><b>No</b>.</p><p>" + "another one " * 20 + "</p>" + "<div><a>a</a></div>" * 30
    with_it = [html.main_text(p) for p in [*pages, page]]
    assert "No." in with_it[-1].split("\n\n") and with_it[-1].count("\n\n") < 10
    monkeypatch.setattr(html, "smoothed", lambda x: x)
    monkeypatch.setattr(html, "REACH", 0)
    without = [html.main_text(p) for p in [*pages, page]]
    assert sum(a != b for a, b in zip(with_it, without, strict=True)) > 1


def test_time_in_proportion_to_length():
    import time

    took = []
    for n in (4000, 32000):
        page = "<article><i><div>" + "<b>" * n + "x</i>" * n + "</div><p>" + "<b>word</b></u> " * n + "</article>"
        t = time.process_time()
        html.main_text(page)
        took.append(time.process_time() - t)
    assert took[1] < 30 * max(took[0], 0.05)
    inner = "<p>An unclosed notice" + "<b>" * 9 + "<p>The paragraph that follows it stays, whatever was open."
    assert html.main_text(f"<article><div class='notice'>{inner[:40]}</div><div>{inner}</div></article>").endswith("whatever was open.")
