import html
import math
import random
import re
import time

from bookloom.llm.pages import Tree, content_node, extract, main_text
from tests.llm.helpers import SMALL, empty


def test_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    out = {r["page_id"]: r for r in extract(pages).collect()}
    for page in pages.collect():
        inner = re.search("<article>(.*?)</article>", page["html"], re.S)[1]
        inner = re.sub("<[^>]+>", "", re.sub("</?(?:p|h1)[^>]*>", "\n", inner).replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in inner.split("\n")) if x)
        got = out[page["page_id"]]
        assert got["text"] == want and got["n_chars"] == len(want) and got["url"] == page["url"]


def test_furniture_goes_and_content_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
      <div id="cookie-notice">We use cookies</div><form><label>Name</label><input></form><aside>Side bar</aside>
      <div class=content><h2>Head &amp; line</h2><p>First   paragraph of the text, with
      a <a href="/y">link</a> and &lt;marks&gt;.<p>Second<br>paragraph.<script>var x = "</p><p>no";</script><ul><li>one<li>two</ul></div>
      <div class="comments"><p>A long comment by a reader that should not be part of it.</p></div>
      <footer>&copy; nobody</footer></body></html>"""
    assert main_text(page) == "Head & line\nFirst paragraph of the text, with a link and <marks>.\nSecond paragraph.\none\ntwo"


def test_density_prefers_text_over_links():
    links = "".join(f"<li><a href=/{i}>Another page {i}</a></li>" for i in range(30))
    text = "".join(f"<p>{'Plain words make up this paragraph. ' * 4}</p>" for _ in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><div>{text}</div></div></body>"
    tree = Tree(page)
    assert tree.tag[content_node(tree)] == "div" and "Another page" not in main_text(page) and main_text(page).count("Plain words") == 24


def test_broken_markup():
    assert main_text("<p>a<b>b<p>c</b>d</p></div></p>e") == "ab\ncd\ne"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text("<article><p title='x>y'>quoted</article>") == "quoted"
    assert main_text("<p>open <script>never closed") == "open"
    assert main_text("<body><!-- a <p>comment</p> -- > <p>text</p>") == ""
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert main_text("<nav><a>only a menu</a></nav>") == "" and main_text("") == "" and main_text(None) == ""


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, "u", "<p>x</p>", "k"), (1, "u", "<p>x</p>", "k"), (2, None, None, None), (None, "v", "", ""), (3, "w", "<p>" + "long words " * 50_000 + "</p>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(((r["page_id"] or 0, r["url"], r["n_chars"]) for r in extract(pages).collect()), key=str)
    assert out == sorted([(1, "u", 1), (1, "u", 1), (2, None, 0), (0, "v", 0), (3, "w", 549_999)], key=str)
    assert extract(empty(pages)).count() == 0


def test_names_and_forms_do_not_take_the_article():
    """Words inside a class name, wrappers of the whole page, and a form round the page are no furniture."""
    text = "".join(f"<p>{'Plain words make up this paragraph. ' * 4}</p>" for _ in range(6))
    body = "\n".join([" ".join(["Plain words make up this paragraph."] * 4)] * 6)
    for page in (
        f"<body><article class='post tag-search'>{text}</article></body>",
        f"<body><div class='layout no-sidebar'>{text}</div></body>",
        f"<body><div class='has-sidebar'><div class='elementor-widget-container'>{text}</div></div></body>",
        f"<body><div class=widget>{text}</div><div class=sidebar>Old posts</div></body>",
        f"<body><form action=/x><input type=hidden name=v><div><input name=q></div>{text}</form></body>",
        f"<body><aside>{text}</aside></body>",
    ):
        assert main_text(page) == body
    assert main_text(f"<body><main><div class='article-header'><h1>Head</h1></div>{text}</main></body>") == "Head\n" + body
    assert main_text(f"<body><article><h2><button>Head</button></h2>{text}<button>Send</button></article></body>") == "Head\n" + body


def test_furniture_named_as_a_whole_still_goes():
    text = "<p>A short article of a few words.</p>"
    long = "<p>" + "A long comment by a reader. " * 20 + "</p>"
    for junk in ("<div class='site-footer'>Junk</div>", "<div id=main_nav>Junk</div>", "<div class='x related-posts'>Junk</div>",
                 "<form><label>Name</label><input></form>", "<aside>Junk</aside>", f"<div class=comments>{long}</div>"):
        assert main_text(f"<body><article>{text}{junk}</article></body>") == "A short article of a few words."


def test_attributes_are_read_as_browsers_do():
    three = "<p title=it's>First paragraph.</p><p>Second paragraph isn't lost.</p><p>Third.</p>"
    assert main_text(f"<article>{three}</article>") == "First paragraph.\nSecond paragraph isn't lost.\nThird."
    assert main_text("<article><p><a href=http://x.org/>linked</a> and plain text</p><p>More text here.</p></article>") == "linked and plain text\nMore text here."
    assert main_text('<article><p data-x="a>b" class=\'c\' hidden=\'>\'>One<br/>two</p></article>') == "One two"
    assert main_text('<article><p title="open>One</p><p>Two</p></article>') == "One\nTwo"
    assert main_text("<article><p>Before</p><xmp><b>raw</b> &amp; text</xmp><p>After</p></article>") == "Before\n<b>raw</b> &amp; text\nAfter"


NAMES = "user-comments disqus_thread comment-list-wrapper reader-responses cookie-policy-banner gdpr-consent-v2 ad-slot-1 adsbygoogle"


def test_comments_notices_and_adverts_go_by_word():
    text = "".join(f"<p>{'Plain words make up this paragraph. ' * 2}</p>" for _ in range(2))
    body = "\n".join([" ".join(["Plain words make up this paragraph."] * 2)] * 2)
    for name in NAMES.split():
        is_comment = any(w in name for w in ("comment", "disqus", "responses"))
        junk = "<p>A reader says a lot about this and that. </p>" * (20 if is_comment else 1)
        assert main_text(f"<body><div class=post-body>{text}</div><div class={name}>{junk}</div></body>") == body, name
        assert main_text(f"<body><div class=post-body>{text}</div><div id='{name}'>{junk}</div></body>") == body, name
    for name in ("no-comments", "has-ads", "tag-cookies", "category-ad"):
        assert main_text(f"<body><div class='{name}'>{text}</div><div>x</div></body>").startswith(body), name


def test_a_page_of_replies_keeps_them():
    replies = "<p>A reader says a lot about this and that.</p>" * 20
    assert main_text(f"<body><h1>Question</h1><div class=thread-comments>{replies}</div></body>").count("A reader says") == 20


def test_time_follows_length():
    def seconds(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    pages = ["<a " * 60_000, "<span><li>" * 20_000, "<div>" * 20_000 + "</b>" * 20_000, "<!" * 60_000, "<a x=\"" * 30_000, "<a " * 30_000 + "x='>'", "<aside>" * 20_000,
             "<" * 100_000, "<script>" * 20_000, "<p>" * 40_000, "<table><td>" * 20_000, "<a x='" * 30_000 + ">", "&" * 100_000]
    for page in pages:
        assert seconds(page) < 5, page[:20]


def plain_densities(node, whole, linked=False):
    """(characters, link characters, tags, link tags) of (tag, parts) and, into ``whole``, of all nodes below, by recursion."""
    tag, parts = node
    linked = linked or tag == "a"
    c = lc = t = lt = 0
    for part in parts:
        if isinstance(part, str):
            c, lc = c + len(part), lc + len(part) * linked
        else:
            a, b, d, e = plain_densities(part, whole, linked)
            c, lc, t, lt = c + a, lc + b, t + d + 1, lt + e + (part[0] == "a")
    whole[id(node)] = (c, lc, t, lt)
    return c, lc, t, lt


def plain_content(body):
    """The text of the content by the definition: maximal density sum, threshold on its path, further subtrees, their common root."""
    sums = {}
    plain_densities(body, sums)
    share = sums[id(body)][1] / sums[id(body)][0]

    def density(node):
        c, lc, t, lt = sums[id(node)]
        if not c:
            return 0.0
        log = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(max(log, 1 + 1e-9))

    nodes, up = [], {}

    def walk(node):
        nodes.append(node)
        for part in node[1]:
            if not isinstance(part, str):
                up[id(part)] = node
                walk(part)

    walk(body)
    total = {id(n): sum(density(k) for k in n[1] if not isinstance(k, str)) for n in nodes}

    def path(node):
        out = [node]
        while id(out[-1]) in up:
            out.append(up[id(out[-1])])
        return out

    def below(node):
        return [n for n in nodes if any(x is node for x in path(n))]

    first_best = lambda group: max(group, key=lambda n: (total[id(n)], -[x is n for x in nodes].index(True)))
    top = first_best(nodes)
    threshold = min(density(n) for n in path(top))
    marked = [top]
    for n in nodes:
        if any(m is x for m in marked for x in path(n)[1:]):
            continue
        if sums[id(n)][0] and all(density(x) >= threshold for x in path(n)):
            marked.append(first_best(below(n)))
    common = [n for n in nodes if all(any(n is x for x in path(m)) for m in marked)][-1]
    text = lambda n: "".join(p if isinstance(p, str) else text(p) for p in n[1])
    return text(common)


def test_content_equals_plain_densities():
    """Random trees of span and a elements: the content equals that of the definition, recomputed by recursion."""
    rnd = random.Random(7)

    def grow(depth, in_link=False):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.random()
            if depth and kind < 0.6:
                link = not in_link and rnd.random() < 0.25
                parts.append(("a" if link else "span", grow(depth - 1, in_link or link)))
            else:
                parts.append("x" * rnd.randint(1, 60))
        return parts

    shown = lambda n: "".join(p if isinstance(p, str) else f"<{p[0]}>{shown(p)}</{p[0]}>" for p in n[1])
    for _ in range(150):
        body = ("body", grow(4))
        assert main_text(f"<body>{shown(body)}</body>") == plain_content(body)
