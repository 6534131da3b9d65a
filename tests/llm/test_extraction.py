import math
from html.parser import HTMLParser

import pytest

from tessel.llm.html import tokens
from tessel.llm import extraction
from tessel.llm.extraction import extract

LONG = "Plenty of plain words that tell a long story about rivers and hills and the people there. "


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("just text", "just text"), ("a &lt;b&gt; &amp; c&nbsp;d", "a <b> & c d"),
    ("<p>a<p>b<br>c<script>var t='</p>'</script><style>p{}</style>", "a b c"), ("<ul><li>one<li>two</ul>", "one two"),
    ("<!-- x --><div>a<b>b</b>c</div>", "abc"), ("<p>unclosed <b>bold", "unclosed bold"), ("<script>never closed", ""),
])
def test_small_pages(page, want):
    assert extract(page) == want


def test_boilerplate_goes():
    page = f"""<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="ad-box">Buy now</div><div id="cookieNotice">We use cookies</div>
    <div id="main"><h2>Story</h2><p>{LONG}</p><p>Short.</p><p>{LONG}<a href=x>link</a> end</p></div><div class="sidebar"><p>{LONG}</p></div><form><p>Name</p></form>
    <section class="comments"><p>{LONG}</p></section><footer>c 2024</footer></body></html>"""
    assert extract(page) == " ".join(f"Story {LONG} Short. {LONG}link end".split())


def test_link_lists_lose_against_text():
    links = "".join(f"<li><a href=/{i}>A link with some words in it {i}</a></li>" for i in range(40))
    assert extract(f"<body><div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == " ".join((LONG * 2).split())


def test_uneven_sections_stay():
    a, b = (("".join(f"<p>{c}{i:02} {'word ' * 79}</p>" for i in range(n))) for c, n in (("A", 10), ("B", 2)))
    b += "<p>See <a href=/r>the report</a> too.</p>"
    text_a, text_b = (" ".join(f"{c}{i:02} {'word ' * 79}" for i in range(n)).split() for c, n in (("A", 10), ("B", 2)))
    text_b += "See the report too.".split()
    assert extract(f'<div id="content"><section>{a}</section><section>{b}</section></div>').split() == text_a + text_b
    assert extract(f'<div id="content"><section>{b}</section><section>{a}</section></div>').split() == text_b + text_a


def test_sparse_siblings_stay_and_link_lists_beside_them_go():
    intro, links = LONG * 2, "".join(f"<li><a href=/{i}>A link with some words in it {i}</a></li>" for i in range(12))
    text = "".join(f"<p>{LONG * 4}</p>" for _ in range(10))
    page = f"<div><h1>Head</h1><p>By <a href=/w>A. Writer</a>, 3 May</p><p>{intro}</p><ul>{links}</ul><div>{text}</div><p>Short end.</p></div>"
    assert extract(page).split() == f"Head By A. Writer, 3 May {intro} {LONG * 40} Short end.".split()


def test_single_links_within_the_core_stay():
    text = "".join(f"<p>{LONG * 4}</p>" for _ in range(5))
    assert extract(f"<div>{text}<p><a href=/x>The whole report</a></p></div>").split() == f"{LONG * 20} The whole report".split()


@pytest.mark.parametrize("tag", ["main", "article"])
def test_link_lists_within_articles_go(tag):
    links, text = "".join(f"<li><a href=/{i}>A link with some words in it {i}</a></li>" for i in range(12)), "".join(f"<p>{LONG * 4}</p>" for _ in range(10))
    page = f"<{tag}><h1>Head</h1>{text}<p><a href=/x>The whole report</a></p><div><ul>{links}</ul></div><p>Short end.</p></{tag}>"
    assert extract(page).split() == f"Head {LONG * 40} The whole report Short end.".split()


def test_sibling_articles_stay():
    a, b = ("".join(f"<p>{w} {LONG * 4}</p>" for _ in range(n)) for w, n in (("First", 10), ("Second", 3)))
    want = f"First {LONG * 4}" * 10 + f"Second {LONG * 4}" * 3
    assert extract(f"<div><article>{a}</article><article>{b}</article></div>").split() == want.split()


def test_articles_of_many_and_few_blocks():
    for n in (1, 2, 30):
        body = "".join(f"<p>{LONG}{i}</p>" for i in range(n))
        assert extract(f"<nav><ul><li><a href=x>x</a></ul></nav><article><h1>Head</h1>{body}</article><footer>f</footer>") == " ".join(("Head " + " ".join(f"{LONG}{i}" for i in range(n))).split())


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>", "t", 5), (1, "u", f"<p>{LONG}</p>", "t", 5), (2, None, None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract_pages(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, LONG.strip(), len(LONG.strip()))] * 2 + [(2, "", 0)]
    assert extraction.extract_pages(pages.limit(0)).count() == 0


def test_deep_pages_do_not_recurse():
    assert extract("<div>" * 20000 + "deep" + "</div>" * 20000) == "deep"


@pytest.mark.parametrize("name", ["layout no-sidebar", "article has-comments", "page-with-header", "social-history", "sidebar", "comments", "main-content", "header", "navWrapper"])
def test_wrappers_named_like_boilerplate_stay(name):
    body = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    assert extract(f'<body><div class="{name}">{body}</div><footer>c</footer></body>').split() == f"Head {LONG * 2}".split()
    assert extract(f'<body><div id="{name}"><div>{body}</div></div><p>Other <a href=/x>site</a> text</p></body>').startswith(f"Head {LONG * 2}Other")


@pytest.mark.parametrize("name", ["comments", "reader-comments", "post_comments", "sidebar-left", "adBox", "ad-300x250", "site-footer", "cookieNotice", "newsletter signup", "related-articles", "mainNav"])
def test_blocks_named_as_boilerplate_go(name):
    page = f'<body><div><h1>Head</h1><p>{LONG}</p></div><div class="{name}"><p>{LONG * 3}</p></div></body>'
    assert extract(page).split() == f"Head {LONG}".split()


class Plain(HTMLParser):
    """A tree of tags and texts for well-formed pages without tags within links, to compute densities again."""

    def __init__(self, page):
        super().__init__()
        self.at = self.body = {"tag": "body", "items": [], "up": None}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        child = {"tag": tag, "items": [], "up": self.at}
        self.at["items"].append(child)
        self.at = child

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        self.at["items"].append({"tag": "", "items": [], "text": data})

    def raw(self, node):
        return node["text"] if node["tag"] == "" else "".join(map(self.raw, node["items"]))

    def measures(self, node):
        """(C, T, LC, LT) of a block; white space within a run of text and links is one space, as in the text given out."""
        c, t, lc, lt, run = 0, 0, 0, 0, ""
        for x in node["items"]:
            if x["tag"] in ("", "a"):
                run += self.raw(x)
                if x["tag"] == "a":
                    t, lc, lt = t + 1, lc + len(" ".join(self.raw(x).split())), lt + 1
                continue
            c, run = c + len(" ".join(run.split())), ""
            inner = self.measures(x)
            c, t, lc, lt = c + inner[0], t + inner[1] + 1, lc + inner[2], lt + inner[3]
        return c + len(" ".join(run.split())), t, lc, lt

    def density(self, node):
        (c, t, lc, lt), (bc, _, blc, _) = self.measures(node), self.measures(self.body)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + blc / max(1, bc) * c + math.e)
        t, lt, x = max(1, t), max(1, lt), max(1, lc)
        return c / t * math.log(max(1.0, c / x * t / lt)) / math.log(base) if base > 1 + 1e-9 else c / t


def test_densities_and_sums_equal_an_independent_computation():
    links = "".join(f"<li><a>A link with words {i}</a></li>" for i in range(6))
    page = f"<div><ul>{links}</ul></div><div><h1>Head</h1><p>{LONG}</p><p>{LONG} <a>more</a></p></div><div><p>{LONG}</p></div>"
    plain = Plain(page)
    body = extraction.parse(page)
    extraction.settle_doubts(body)
    extraction.measure(body)

    def blocks(node):
        return [node, *(y for x in node["items"] if x["tag"] and x["tag"] != "a" for y in blocks(x))]

    def tree(block):
        return [block, *(y for x in block.items if x.tag for y in tree(x))]

    want, got = blocks(plain.body), tree(body)
    assert [w["tag"] for w in want] == [g.tag for g in got]
    for w, g in zip(want, got, strict=True):
        assert g.density == pytest.approx(plain.density(w)), w["tag"]
        if all(x["tag"] not in ("", "a") for x in w["items"]):
            assert g.total == pytest.approx(sum(plain.density(x) for x in w["items"]))


PROSE = " ".join(f"Sentence {i} of the story tells what the people of the town did next." for i in range(12))


def article(inner):
    return f"<html><body><nav><a href='/'>Home</a> <a href='/x'>More</a></nav><article><h1>Title</h1><p>{PROSE}</p>{inner}<p>The end of it all.</p></article><footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("name", ["comments", "related", "copyright", "sharing", "search", "navigation", "notice", "legal"])
def test_names_of_headings_and_sections_delete_nothing(name):
    assert extraction.extract(article(f'<h2 id="{name}" class="{name}">About {name}</h2><p>Text on it.</p>')) == f"Title {PROSE} About {name} Text on it. The end of it all."
    assert extraction.extract(article(f'<section id="{name}"><p>Text on it.</p></section>')) == f"Title {PROSE} Text on it. The end of it all."


def test_rows_and_code_stay():
    assert "Year Sum 1 2" in extraction.extract(article('<table><tr class="header"><td>Year</td><td>Sum</td></tr><tr><td>1</td><td>2</td></tr></table>'))
    assert "x = 1 # why" in extraction.extract(article('<pre>x = 1 <span class="comment"># why</span></pre>'))


def test_pages_in_forms_and_open_menus_stay():
    inner = f"<h1>Title</h1><p>{PROSE}</p><input type='text'><select><option>one</option></select><button>Send</button>"
    for page in (f"<body><form action='/'>{inner}</form></body>", f"<body><div role='form'>{inner}</div></body>", f"<body><form>{inner}</form><div>Imprint</div></body>"):
        assert extraction.extract(page).removesuffix(" Imprint") == f"Title {PROSE}"
    menu = "".join(f"<li><a href='/{i}'>Place {i}</a></li>" for i in range(8))
    assert extraction.extract(f"<body><nav><ul>{menu}</ul><div><h1>Title</h1><p>{PROSE}</p></div></body>") == f"Title {PROSE}"
    assert extraction.extract(article("<form><p>Subscribe here</p><button>Go</button></form>")) == f"Title {PROSE} The end of it all."


def test_comments_with_a_heading_go():
    page = f"<body><div><h1>Title</h1><p>{PROSE}</p></div><div class='comments'><h1>Replies</h1><p>{PROSE} {PROSE}</p></div></body>"
    assert extraction.extract(page) == f"Title {PROSE}"


def test_numbered_references_stay_and_link_lists_go():
    items = "".join(f"<li><a href='/{i}'>A book of some title {i}</a></li>" for i in range(6))
    assert "References A book of some title 0" in extraction.extract(article(f"<h2>References</h2><ol>{items}</ol>"))
    assert "A book" not in extraction.extract(article(f"<ul>{items}</ul>"))


@pytest.mark.parametrize("page", ["<a " * 1_000_000, "<a '" * 300_000, '<a "' * 300_001 + ">", "<a \"'" * 200_000 + "> x", "<" * 1_000_000, "<!" * 500_000, "</" * 500_000, "<a>" * 30_000])
def test_broken_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    n = sum(1 for _ in tokens(page))
    assert time.process_time() - began < 3 and n < len(page)


def test_quotes_that_nothing_closes():
    assert list(tokens('<a title="x>y</a> z')) == [("open", "a", ' title="x'), ("text", "", "y"), ("close", "a", ""), ("text", "", " z")]
    assert list(tokens("<p class='a>b'>it's <b x=\"1>2\">bold</b> 1 < 2 <")) == [
        ("open", "p", " class='a>b'"), ("text", "", "it's "), ("open", "b", ' x="1>2"'), ("text", "", "bold"), ("close", "b", ""), ("text", "", " 1 < 2 <"),
    ]
