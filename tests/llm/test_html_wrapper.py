import random
import re

from pointweave.llm import html_wrapper as hw

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a>b">A</a><li>B</ul></nav><!-- <p>no</p> --><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>One&nbsp; two<br>three &#233;<p>Four &lt;b&gt; {n}</p><p>Five &am</p><ul><li>six {n}<li>seven</ul>
<div class="comments"><p>mine</p></div><form><p>sign up</p></form></article><aside>side</aside><footer>&copy; foot</footer></body></html>"""


def stream(page):
    """The events as the text that ``expression`` is matched with."""
    return "".join("#" if what == "#" else f"<{v}>" if what == "<" else f"</{v}>" for what, v, _ in with_ends(page))


def with_ends(page):
    open_kinds = []
    for what, v, n in hw.events(page):
        if what == "<":
            open_kinds.append(v)
        yield what, open_kinds.pop() if what == ">" else v, n


def wrapped(pages):
    w = hw.page_tree(pages[0])
    for p in pages[1:]:
        w = hw.merge(w, hw.page_tree(p))
    return hw.unpacked(hw.packed(w))


def texts(pages):
    d = hw.Decided(hw.decide(wrapped(pages)))
    return [d.text_of(p) for p in pages]


def test_one_page():
    assert texts([PAGE.replace("{n}", "1")]) == ["Head & line\nOne two three é\nFour <b> 1\nFive &am\nsix 1\nseven"]


def test_alignment_makes_optional_and_repeated_groups():
    w = wrapped(["<div><h1>x</h1><p>y</p></div>", "<div><h1>x</h1><table><tr><td>k</td></tr></table><p>y</p><p>z</p></div>"])
    div = w.kids["div"]
    assert div.groups == [[["h1"], False], [["table"], False], [["p"], True]]
    assert [div.kids[k].optional for k in ("h1", "table", "p")] == [False, True, False]
    assert hw.sequence([[["a"], False], [["b"], False]], [[["b"], False], [["a"], False]]) == [[["a", "b"], True]]
    assert hw.sequence([[["a"], False], [["c"], True]], [[["b"], False], [["c"], False]]) == [[["a"], False], [["b"], False], [["c"], True]]
    assert hw.fold(list("habachd")) == [[["h", "a", "b", "c"], True], [["d"], False]]


def test_a_wrapper_matches_every_page_that_made_it():
    rng = random.Random(3)

    def made(depth):
        return "".join(f"<{t}>{rng.choice(['', 'x', 'y'])}{made(depth - 1)}</{t}>" for t in rng.choices(["div", "section", "ul", "h2", "table"], k=rng.randint(0, 4))) if depth else ""

    for _ in range(150):
        pages = [made(3) for _ in range(rng.randint(1, 5))]
        pattern = re.compile(hw.expression(wrapped(pages)))
        assert all(pattern.fullmatch(stream(p)) for p in pages)


def test_merging_does_not_depend_on_the_grouping():
    pages = [PAGE.replace("{n}", str(i)) for i in range(6)]
    trees = lambda: [hw.page_tree(p) for p in pages]
    a, b = trees(), trees()
    one = a[0]
    for x in a[1:]:
        one = hw.merge(one, x)
    two = hw.merge(hw.merge(hw.merge(b[0], b[1]), b[2]), hw.merge(b[3], hw.merge(b[4], b[5])))
    assert hw.packed(one) == hw.packed(two)


def test_the_wrapper_decides_where_no_name_does():
    page = "<body><div class='q'>Same on each page, a long line that says nothing of note</div><div class='z'><h2>T{n}</h2><p>Story {n} is told in words here</p>{more}<div class='k'>Fixed line in between, always the same</div></div><div class='y'><a href=x>Other story {n} of this place, linked</a></div></body>"
    pages = [page.replace("{n}", str(i)).replace("{more}", f"<p>And more {i}</p>" * (i % 3)) for i in range(8)]
    assert texts(pages)[4] == "T4\nStory 4 is told in words here\nAnd more 4"
    alone = texts([pages[4]])[0]
    assert "Fixed line in between" in alone  # one page has nothing to be aligned with


def test_blocks_whose_names_sound_like_menus_stay():
    page = "<article><h1>T{n}</h1><p>Text {n}</p><div class='share-price'>Price {n}</div><div class='social-history'>Past {n}</div><div class='search-results'>Found {n}</div></article>"
    got = texts([page.replace("{n}", str(i)) for i in range(3)])
    assert got[1] == "T1\nText 1\nPrice 1\nPast 1\nFound 1"


def test_repeated_records_go_and_sections_stay():
    page = "<main><h1>T{n}</h1>" + "<section><h2>S{n}</h2><p>Long part of the text number {n}</p></section>" * 3 + "<div class='r'><div>by {n}</div><p>Reply {n}</p></div>" * 4 + "</main>"
    got = texts([page.replace("{n}", str(i)) for i in range(4)])
    assert got[2] == "T2" + "\nS2\nLong part of the text number 2" * 3


PARTS = {
    "nested list": ("<ul><li><p>Point {n}</p><ul><li>Under {n}</li><li>Also {n}</li></ul></li><li><p>Next {n}</p></li></ul>", "Point {n}\nUnder {n}\nAlso {n}\nNext {n}"),
    "callouts": ("<div class='note'><p>Mind {n}</p></div><div class='note'><p>And {n}</p><p>more {n}</p></div>", "Mind {n}\nAnd {n}\nmore {n}"),
    "quote": ("<blockquote><p>Said {n}</p><p>Who {n}</p></blockquote><blockquote><p>Told {n}</p></blockquote>", "Said {n}\nWho {n}\nTold {n}"),
    "sources": ("<h2>Sources {n}</h2><ul><li><a href='x'>Book {n}</a></li><li><a href='y'>Paper {n}</a></li></ul>", "Sources {n}\nBook {n}\nPaper {n}"),
    "table": ("<table><tr><td>k {n}</td><td>v {n}</td></tr><tr><td>l {n}</td><td>w {n}</td></tr></table>", "k {n}\nv {n}\nl {n}\nw {n}"),
    "questions": ("<div class='q'><p>Asked {n}</p><div>Told {n}</div></div><div class='q'><p>Why {n}</p><div>So {n}</div></div>", "Asked {n}\nTold {n}\nWhy {n}\nSo {n}"),
}


def test_an_article_keeps_all_its_blocks():
    """Each page has its own choice of parts; beside the article stand a menu, other stories and a footer."""
    rng = random.Random(1)
    pages, want = [], []
    for n in range(12):
        parts = [PARTS[k] for k in rng.sample(sorted(PARTS), rng.randint(1, 6))]
        body = "<h1>T{n}</h1><p>Opening words of story {n}</p>" + "<p>between {n}</p>".join(p for p, _ in parts)
        page = "<nav><a href=x>Home</a></nav><article>" + body + "<div class='ad'><p>Buy {n}</p></div><div class='comments'><div><b>by</b><p>me {n}</p></div></div></article><div><a href=x>Story {n}</a></div><footer>(c) {n}</footer>"
        pages.append(page.replace("{n}", str(n)))
        want.append(("T{n}\nOpening words of story {n}\n" + "\nbetween {n}\n".join(t for _, t in parts)).replace("{n}", str(n)))
    assert texts(pages) == want


def test_the_alignment_tells_comments(monkeypatch):
    page = "<main><h1>T{n}</h1><p>A long enough text of story number {n}</p><ul><li><p>One {n}</p></li><li><p>Two {n}</p></li></ul>" + "<div class='r'><div>by {n}</div><p>Reply {n}</p><p>and more {n}</p></div>" * 3 + "</main>"
    nested = "<article><h1>T{n}</h1><p>A long enough text of story number {n}</p>" + "<article><p>by {n}</p><div>Reply {n}</div></article>" * 3 + "</article>"
    pages, others = ([p.replace("{n}", str(i)) for i in range(4)] for p in (page, nested))
    assert texts(pages)[1] == "T1\nA long enough text of story number 1\nOne 1\nTwo 1"
    assert texts(others)[1] == "T1\nA long enough text of story number 1"
    monkeypatch.setattr(hw, "fold", lambda kinds: [])
    monkeypatch.setattr(hw, "sequence", lambda a, b: [])
    assert "Reply 1" in texts(pages)[1]


def test_truncated_and_odd_pages():
    for page in ("<p>one</p><p", "<p>one</p><a href=\"x", "<p>one</p><!-- x", "<p>one</p><script>y", "<P CLASS=x>one</P></div></p>"):
        assert [v for what, v, _ in hw.events(page) if what == "#"][:1] == ["one"]
    assert list(hw.events("")) == [] and list(hw.events("a < b")) == [("#", "a < b", 0)]


def test_deep_and_long_pages():
    deep = "<div>" * 100_000 + "<p>far down</p>"
    assert texts([deep]) == ["far down"]
    rows = "<ul>" + "<li><div>x</div>" * 100_000 + "</ul>"
    wide = "<body>" + rows + "".join(f"<p>line {i} of a page</p>" for i in range(200_000)) + "</body>"
    assert len(texts([wide, wide.replace("line", "row")])[0].split("\n")) == 200_000
    assert texts(["<p>" * 50_000 + "<button>" * 50_000 + "<div>" * 50_000 + "x"]) == [""]


def test_main_text_of_a_table(spark):
    rows = [(i, f"https://u@Host.example:80/{i}", PAGE.replace("{n}", str(i))) for i in range(30)]
    plain = "<html><body><div class='top'>Same everywhere</div><div class='text'><p>Story {n}</p>{more}</div></body></html>"
    rows += [(100 + i, "http://plain.example/x", plain.replace("{n}", str(i)).replace("{more}", "<p>more</p>" * (i % 3))) for i in range(12)]
    rows += [(200, None, "<p>lone</p>"), (201, "http://host.example/none", None), (202, "http://host.example/x", "<body><p>no article</p></body>"), (202, "http://host.example/x", "<body><p>no article</p></body>"), (None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", hw.F.lit("clash")).withColumn("host", hw.F.lit("clash")).repartition(3)
    for how in ({}, {"broadcast_bytes": 0, "salts": 3}):
        got = {}
        for r in hw.main_text(pages, **how).collect():
            got.setdefault(r["page_id"], []).append(r["text"])
        assert got[3] == ["Head & line\nOne two three é\nFour <b> 3\nFive &am\nsix 3\nseven"]
        assert got[102] == ["Story 2\nmore\nmore"] and got[100] == ["Story 0"]
        assert got[200] == ["lone"] and got[201] == [""] and got[202] == ["no article"] * 2 and got[None] == [""]
        assert sum(map(len, got.values())) == len(rows)
    assert hw.main_text(pages.limit(0)).count() == 0


def test_partial_wrappers_are_merged_in_groups(spark):
    rows = [("h", hw.packed(hw.page_tree("<div>" + "".join(f"<{t}>x{i}</{t}>" for k, t in enumerate(("h1", "h2", "p", "ul", "ol")) if i >> k & 1) + "</div>"))) for i in range(32)]
    one = hw.infer_wrappers(spark.createDataFrame(rows, "host string, wrapper string"), group_size=4).collect()
    assert len(one) == 1
    div = hw.unpacked(one[0]["wrapper"]).kids["div"]
    assert set(div.kids) == {"h1", "h2", "p", "ul", "ol"} and all(k.optional and k.n == 16 for k in div.kids.values()) and div.pages == 32


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div class='top'>Site</div><div class='text'><p>{n}</p></div></body>"
    rows = [(i, "http://copies.example/x", page.replace("{n}", "One story")) for i in range(6)]
    rows += [(10 + i, "http://mixed.example/x", page.replace("{n}", f"Story {min(i, 2)}")) for i in range(6)]
    rows += [(20 + i, "http://nonce.example/x", f"<script>{i}</script>" + page.replace("{n}", "One story")) for i in range(6)]
    rows += [(30 + i, "http://sets.example/x", "".join(f"<div class='{c}'>{c}</div>" for c in "pqrs" if c != "pqrs"[i])) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in hw.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i] == "One story" and got[20 + i] == "One story" for i in range(6))
    assert [got[10 + i] for i in range(6)] == [f"Story {min(i, 2)}" for i in range(6)]
    assert got[30] == "q\nr\ns"
