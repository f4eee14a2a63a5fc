from tieout.llm import site_template as s


def text(page, template=()):
    root, hashes = s._hashes(page)
    return s.blocks(root, frozenset(template), hashes)


def test_main_text_of_broken_markup():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/x>menu</a></nav><!-- <p>no</p> -->"
        "<div class='ad box'>buy</div><article><header>head</header><h1>Title &amp; more</h1><p><b>one<br>two<p>three &lt;3 &eacute;&nbsp; x</p>"
        "<section class='reader-comments'><p>first!</p></section><form>f</form><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>5 < 6 &am</article><footer>&copy; me</foot"
    )
    assert text(page) == ["Title & more", "one two", "three <3 é x", "a", "b", "1", "2", "5 < 6 &am"]


def test_pages_without_article():
    assert text("<p>one<p>two <b>three</b> tail<script>if (a<b) {}</script><div id=sidebar>x</div> end") == ["one", "two three tail", "end"]
    assert text("") == [] and text("plain  text") == ["plain text"] and text("<") == ["<"] and text("<p") == []
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert text(deep) == ["x"]


def test_recurring_subtrees_are_deleted(table):
    shared = "<div><p>Welcome to our site</p></div>"
    rows = [(i, f"http://a.example/{i}", f"{shared}<p>story {i}</p><p>license</p>" if i < 8 else f"<article><p>story {i}</p><p>license</p></article>") for i in range(16)]
    rows += [(20, "http://b.example/", f"{shared}<p>other</p>"), (21, None, None), (None, "nonsense", ""), (22, "http://A.example:80/x", rows[0][2]), (22, "http://A.example:80/x", rows[0][2])]
    pages = table("page_id long, url string, html string, text string, host string", [(*r, "clash", "clash") for r in rows])
    got = {r.page_id: r.text for r in s.extract_main_text(pages, share=0.2).collect()}
    assert got[3] == "story 3" and got[12] == "story 12\nlicense"  # in an article nothing recurs
    assert got[20] == "Welcome to our site\nother" and got[21] == "" and got[None] == "" and got[22] == "story 0"
    assert s.extract_main_text(pages).count() == len(rows)
    assert s.extract_main_text(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(table):
    pages = table("page_id long, url string, html string", [(i, f"http://a.example/{i}", "<div><p>only story</p></div>") for i in range(9)])
    assert {r.text for r in s.extract_main_text(pages).collect()} == {"only story"}


def test_salted_join_gives_the_same(table, monkeypatch):
    pages = table("page_id long, url string, html string", [(i, f"http://a.example/{i}", f"<div>menu</div><p>{i}</p>") for i in range(9)])
    want = sorted(s.extract_main_text(pages).collect())
    monkeypatch.setattr(s, "BROADCAST_ELEMENTS", 0)
    assert sorted(s.extract_main_text(pages).collect()) == want and want[0].text == "0"


def test_wrappers_of_articles_are_no_template(table):
    def page(i, start, end):
        return f"<body><div class=container><nav>menu</nav><div><p>slogan</p></div>{start}<p>story {i}</p>{end}<footer>foot</footer></div><div>imprint</div>"

    marks = [("<article>", "</article>"), ("<div class=main>", "</div>"), ("<div><main><div><article>", "</article></div></main></div>")]
    rows = [(10 * k + i, f"http://{k}.example/{i}", page(i, *m)) for k, m in enumerate(marks) for i in range(6)]
    got = {r.page_id: r.text for r in s.extract_main_text(table("page_id long, url string, html string", rows)).collect()}
    assert got == {i: f"story {i % 10}" for i, _, _ in rows}


def test_deep_pages_count_and_lose_template(table):
    rows = [(i, f"http://a.example/{i}", "<div>menu</div>" + f"<font>{i} " * 5000) for i in range(4)]
    got = {r.page_id: r.text for r in s.extract_main_text(table("page_id long, url string, html string", rows)).collect()}
    assert got == {i: " ".join([str(i)] * 5000) for i in range(4)}


def test_recurring_boxes_in_articles_are_deleted(table):
    body = "A long passage that few articles share. " * 20

    def page(i):
        shared = f"<div>{body}</div>" if i < 3 else ""
        return f"<div class=wrap><article><h1>title {i}</h1><p>story {i}</p>{shared}<div class=bio><p>Ann writes here</p></div><section><ul><li>Read more</ul></section></article></div>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)]
    rows += [(20 + i, f"http://b.example/{i}", f"<p>see {i}</p><main><h1>title</h1><div>{body}</div></main>") for i in range(4)]
    got = {r.page_id: r.text for r in s.extract_main_text(table("page_id long, url string, html string", rows)).collect()}
    assert got[5] == "title 5\nstory 5" and got[1] == f"title 1\nstory 1\n{body.strip()}" and got[21] == f"title\n{body.strip()}"


def test_template_of_a_large_host(table, monkeypatch):
    rows = [(i, f"http://a.example/{i}", f"<div>menu {i % 30}</div>" + ("<div>rare</div>" if i < 5 else "") + f"<p>{i}</p>") for i in range(900)]
    pages = table("page_id long, url string, html string", [*rows, rows[0]])
    want = {i: f"rare\n{i}" if i < 5 else f"{i}" for i in range(900)}
    assert {r.page_id: r.text for r in s.extract_main_text(pages).collect()} == want
    monkeypatch.setattr(s, "HOST_ELEMENTS", 10)
    got = s.extract_main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == 901


def test_articles_survive_any_wrapper():
    for start, end in [
        ("<div id=content-with-sidebar>", "</div>"), ("<div class=has-sidebar><div class=header-fixed>", "</div></div>"), ("<form id=aspnet>", "</form>"),
        ("<header>", "</header>"), ("<div class=sidebar>", "</div>"), ("<aside>", "</aside>"), ("<div class='ad'><section class=menu>", "</section></div>"),
    ]:
        assert text(f"<body>{start}<nav>menu</nav><article><h1>title</h1><p>story</p></article>{end}<footer>foot</footer>") == ["title", "story"]
    # a teaser in a sidebar is no article beside another one
    assert text("<aside><article>teaser</article></aside><article>story</article>") == ["story"]


def test_names_are_whole_words_or_compounds():
    page = "<article><div class='article-header'><h1>title</h1></div><section class='skip-lists'>a</section><p class=social>b</p>{}<p>c</p></article>"
    kept = ["title", "a", "b", "c"]
    for part in ("<div class=ad>x</div>", "<div class='box share-buttons'>x</div>", "<section id=comments>x</section>", "<div class=main-nav>x</div>", "<div role=navigation>x</div>", "<form>x</form>", "<div class=cookie-banner>x</div>"):
        assert text(page.format(part)) == kept, part
    for part in ("<div class=has-comments>x</div>", "<h2 class=notice>x</h2>", "<div class=adapter>x</div>", "<div class=headers>x</div>"):
        assert text(page.format(part)) == ["title", "a", "b", "x", "c"], part


def test_unmatched_tags_take_linear_time():
    import time

    start = time.time()
    assert text("<font>" * 40_000 + "x" + "</b>" * 40_000) == ["x"] and text("<font>" * 20_000 + "<p>y" * 20_000) == ["y"] * 20_000
    assert time.time() - start < 20
