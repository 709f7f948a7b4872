from driftwell.llm import html as H

LONG = "The article is about the way in which the river came to be as it is and what it was before that time."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">{LONG}</div><main><h1>Head&amp;line &eacute;</h1><p>{LONG}<p>Short one.<br>More\n\t of&nbsp;it.
<aside>{LONG}</aside><div class="ads">{LONG}</div><table><tr><td>A<td>B</table><section id="comments"><p>{LONG}</p></section>
<form>{LONG}<input></form></main><div class="sidebar">{LONG}</div><footer>&copy; {LONG}</footer></body></html>"""


def test_main_element():
    assert H.main_text(PAGE) == f"Head&line é\n{LONG}\nShort one. More of it.\nA\nB"


def test_without_a_main_element_density_decides():
    links = "<p>" + " ".join(f'<a href="/{i}">some link text {i}</a>' for i in range(8)) + "</p>"
    page = f"<body>{links}<h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>{links}<p>{'Tariff 12.5 '* 12}<a>x</a></p></body>"
    assert H.main_text(page) == f"Title\n{LONG}\nShort.\n{LONG}"


def test_open_blocks_follow_the_nearest_decided_one():
    block = lambda text, linked=0: H.Block(text, linked, False, False)
    menu = block("menu " * 4, 20)
    assert H.labels([menu, block("a"), block("b"), block("c"), block(LONG)]) == [False, False, False, True, True]
    assert H.labels([menu, block("a"), block("b")]) == [False, False, False]
    assert H.labels([block("a")]) == [True] and H.labels([]) == []


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("just text &lt;b&gt; &#x41;") == "just text <b> A"
    assert H.main_text("<article><p>%%% ### $$$</p></article>") == "%%% ### $$$"
    assert H.main_text("<p>a<p>b</div></p>c") == "a\nb\nc"
    assert H.main_text("<article><p>unclosed <b>bold<p>next") == "unclosed bold\nnext"
    assert H.main_text('<article class="comment"><p>' + LONG + "</p></article><p>" + LONG + "!</p>") == LONG + "!"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert H.main_text(deep) == "x"
    assert H.main_text("<article>" + "<p>word word</p>" * 20000 + "</article>").count("\n") == 19999


def test_wrappers_named_after_what_is_beside_them_keep_their_text():
    body = f"<h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"Title\n{LONG}\nShort.\n{LONG}"
    side = f'<div class="sidebar"><p>{LONG}</p></div>'
    for tag, name in (("article", "node node--promoted node--view-mode-full"), ("div", "content has-sidebar"), ("div", "no-sidebar"),
                      ("div", "page-with-sidebar"), ("div", "elementor-widget elementor-widget-text-editor"), ("article", "sidebar-layout")):
        assert H.main_text(f'<body><{tag} class="{name}">{body}</{tag}>{side}</body>') == want, name
    for inner in (body, f"<main>{body}</main>", f"<article>{body}</article>"):
        assert H.main_text(f'<body><form action="/x"><input name=s><label>no</label>{inner}{side}</form></body>') == want
        assert H.main_text(f'<body><div id="sidebar-page">{inner}</div>{side}</body>') == want
    comments = f'<div class="comment-list">{"<article><p>" + LONG + "</p></article>"}</div>' * 9
    assert H.main_text(f"<body>{body}{comments}</body>") == want
    assert H.main_text(f"<body><p>{LONG}</p><form><p>{LONG}</form></body>") == LONG


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    rows = H.extract_pages(df).collect()
    assert len(rows) == 3 and all(r.n_chars == len(r.text) for r in rows)
    assert sorted(r.n_chars for r in rows)[0] == 0
