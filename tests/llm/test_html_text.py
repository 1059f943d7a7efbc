"""Main texts of pages whose article no tag marks, of deep and damaged markup, and of odd tables."""

import pytest

pytest.importorskip("breezeline.llm")
from breezeline.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string, host string, wrapper string, choice string"


def texts(spark, pages):
    rows = [(i, url, page, "x", "y", "z", "w") for i, (url, page) in enumerate(pages)]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["page_id", "url", "text"]
    return [r["text"] for r in sorted(got.collect(), key=lambda r: r["page_id"])]


def wrapper(pages):
    whole = None
    for page in pages:
        one = H._template(H.parse(page))
        whole = one if whole is None else H._merged(whole, one)
    return whole


def test_nothing_leaks_at_any_depth():
    for depth in (1, 118, 119, 120, 121, 500, 20_000):
        page = "<div>" * depth + "<nav>MENU</nav><p>text</p>" + "</div>" * depth + "<footer>end</footer>"
        assert H.extract(page) == "text"
        assert H.extract(page, H.choose(wrapper([page] * 6))) == "text"


def test_title_and_lead_belong_to_a_text_without_marks():
    page = "<body><div><h1>Title</h1><p class=lead>Lead</p><blockquote>" + "long quote " * 40 + "</blockquote></div></body>"
    assert H.extract(page) == "Title\nLead\n" + ("long quote " * 40).strip()


def test_paragraphs_that_differ_late_are_slots(spark):
    lead = "the same opening words " * 12
    pages = [(f"http://a.example/{i}", f"<body><div><p>{lead}{i}</p><p>own {i * 7}</p></div></body>") for i in range(6)]
    assert texts(spark, pages) == [f"{lead}{i}\nown {i * 7}" for i in range(6)]


def test_shared_text_of_an_article_stays(spark):
    pages = [(f"http://a.example/{i}", f"<body><div><p>A shared note</p><p>own {i}</p></div></body>") for i in range(6)]
    assert texts(spark, pages) == [f"A shared note\nown {i}" for i in range(6)]
    copies = [(f"http://b.example/{i}", "<body><div><h1>One</h1><p>text</p></div></body>") for i in range(7)]
    assert texts(spark, copies) == ["One\ntext"] * 7


def test_what_all_pages_repeat_around_the_slots_goes(spark):
    page = "<body><div class=upper>Welcome to the site</div><div class=mid><p>own {0}</p>{1}</div><div class=lower>Made here</div></body>"
    pages = [(f"http://a.example/{i}", page.format(i, "<p>more</p>" * (i % 3))) for i in range(9)]
    assert texts(spark, pages) == ["\n".join([f"own {i}"] + ["more"] * (i % 3)) for i in range(9)]
    menu = "<body><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul><h1>T {0}</h1><p>see <a href=c>Home</a> {0}</p></body>"
    pages = [(f"http://b.example/{i}", menu.format(i)) for i in range(9)]
    assert texts(spark, pages) == [f"T {i}\nsee Home {i}" for i in range(9)]


def test_groups_of_the_wrapper():
    pages = [
        "<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p></div>",
        "<div><h2>c</h2><p>3</p><h2>d</h2><p>4</p><h2>e</h2><p>5</p><hr></div>",
    ]
    whole = wrapper(pages)
    assert H.regular_expression(whole) == "<#page><div>(<h2>#</>)+(<p>#</>)+(<hr></>)?</></>"
    assert H.from_json(H.to_json(whole)) == whole


def test_wrapper_does_not_depend_on_salts(spark):
    rows = [(f"http://a.example/{i}", f"<div><p>{i}</p>{'<hr>' * (i % 2)}<b>x</b></div>") for i in range(40)]
    pages = spark.createDataFrame(rows, "url string, html string").repartition(7)
    (one,) = H.infer_wrappers(pages).collect()
    whole = H.from_json(one["wrapper"])
    assert whole[H.PAGES] == 40
    assert H.regular_expression(whole) == "<#page><div><p>#</>(<hr></>)?<b>'x'</></></>"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<nav>only a menu</nav>", ""), ("a < b &amp; c", "a < b & c"), ("<p>open<p", "open<p"),
        ("</div></p>x</b>", "x"), ("<!-- c --><p>a<!-- b -->b</p>", "ab"), ("<p>a\n\t b&nbsp;c</p>", "a b c"),
        ("<article><p>in</p></article><div class=sidebar>side</div>", "in"), ("<div>a<br>b</div>", "a b"),
    ],
)
def test_odd_pages(page, text):
    assert H.extract(page) == text


def test_odd_tables(spark):
    same = ("http://a.example/1", "<article><p>one</p></article>")
    assert texts(spark, [same, same, (None, None), (None, "<p>x</p>"), ("no url", "")]) == ["one", "one", "", "x", ""]
    assert H.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 400_000
    assert texts(spark, [("http://a.example/1", f"<article><p>{long}</p><aside>no</aside></article>")]) == [long.strip()]
