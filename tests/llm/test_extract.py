import html
import random

from tallyframe.llm import extract
from tests.llm.conftest import in_use

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>if (a<b) "</p>"</script><style>p{{}}</style></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/x">Home</a></li><li>About us</li></ul></nav>
<div class="cookie-notice">We use cookies, agree now to all of it please</div><!-- x -- > y -->
{open}<h1>Title &lt;one&gt;</h1><p>First <b>bold</b>text
with&nbsp;space.<br>Next line<p>Second &eacute; <a title="a>b" href='c'>link</a>, end.<ul><li>item one<li>item <i>two</i></ul>
<div class="ad">Buy this now, it is very cheap and you will like it so much more than all</div><form><input name=q><button>Go</button></form>
<blockquote>Quoted words</blockquote><p>Last.</p>{close}
<section id="comments"><article class="comment"><p>I liked the article a lot and wrote this long comment about it, thanks.</p></article></section>
<aside class="sidebar"><p>Other posts you may like</p></aside><footer>&copy; 2020 Company, all rights reserved</footer></body></html>"""
WANT = "Title <one>\nFirst boldtext with space. Next line\nSecond é link, end.\nitem one\nitem two\nQuoted words\nLast."
PAIRS = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id=content>', "</div>"), ('<section role="main">', "</section>")]


def labelled(n):
    rng = random.Random(1)
    for i in range(n):
        words = lambda k: html.escape(" ".join(rng.choice(["red", "sea & sun", "<x>", "été"]) for _ in range(k)))
        body = [words(rng.randint(1, 40)) for _ in range(rng.randint(1, 9))]
        page = (f"<html><head><title>{words(4)}</title></head><body><nav><ul><li><a href=/>{words(3)}</a></li></ul></nav><div class='ad'>{words(rng.randint(1, 90))}</div>"
                f"<article><h1>{words(2)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</article><div class='teaser'>{words(30)}</div><footer>{words(9)}</footer>")
        start = page.index("<h1>") + 4
        want = "\n".join([html.unescape(page[start:page.index("</h1>")]), *map(html.unescape, body)])
        yield page, want


def test_pages(spark):
    known = list(labelled(60))
    pages = [p for p, _ in known] + [PAGE.format(open=a, close=b) for a, b in PAIRS]
    want = [w for _, w in known] + [WANT] * len(PAIRS)
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "http://x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in extract.extract(in_use(df, "text", "n_chars")).collect()}
    for i, w in enumerate(want):
        assert rows[i].text == w and rows[i].n_chars == len(w), i


def test_odd_pages(spark):
    odd = [None, "", "   ", "<", "plain words only", "<p>a<p>b", "<!-- open", "<script>x", "<article><p>unclosed &amp", "<p>1 < 2 &amp; 3 > 2</p>", '<a "' * 20_000, "<div>" * 30_000 + "deep", "x " * 300_000]
    df = spark.createDataFrame([(None, "u", p) for p in odd] + [(1, "u", "<p>a<p>b")] * 2, "page_id long, url string, html string")
    texts = [r.text for r in extract.extract(df).collect()]
    assert texts[:10] == ["", "", "", "<", "plain words only", "a\nb", "", "", "unclosed &", "1 < 2 & 3 > 2"]
    assert texts[11] == "deep" and len(texts[12]) == 599_999 and texts[-2:] == ["a\nb"] * 2
    assert extract.extract(df.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    rng = random.Random(6)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = extract.best_region(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_names_beyond_the_commonest_have_their_weights(spark):
    text = "one two three four five six seven eight"
    pages = [f"<article id=unique-{i}>{'<p>' + text * 9 + '</p>'}<div class=aa><p>{text}</p></div></article><div class=zz><p>{text}</p></div>" for i in range(12)]
    pages += [f"<div class=zz><p>{text} {text}</p></div><div class=aa><p>wanted words</p></div>", None, ""]
    pages += pages[-3:]
    df = spark.createDataFrame([(None if i % 2 else i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    whole, few = (sorted((r.page_id or -1, r.text) for r in extract.extract(df, most_names=n).collect()) for n in (5000, 3))
    assert few == whole
    assert [t for _, t in few].count("wanted words") == 2 and [t for _, t in few].count("") == 4
    assert extract.extract(df.limit(0), most_names=0).count() == 0


def test_attributes_are_read_whole(spark):
    plain = ['style="overflow:hidden"', 'title="hidden gems"', "title='x class=ad id=ad'", 'data-id="ad"', "data-role=banner", ":class='ad'", "xhidden", 'title = "a" data-x=hidden', "'hidden' x=y"]
    for a in plain:
        assert extract.names_of("div", " " + a) == [], a
    named = [
        ("class=ad", [".ad"]), ('CLASS = "Ad  b"', [".ad", ".b"]), ("id='x'class=\"y\"role=z", [".x", ".y", ".z"]), ("hidden", ["hidden"]), ("/hidden/", ["hidden"]), ("hidden=''", ["hidden"]),
        ('aria-hidden="true"', ["hidden"]), ("aria-hidden=false", []), ('style="overflow:hidden" class=ad', [".ad"]), ("title=\"it's\" id=x", [".x"]), ("data-a id\n=\n'x'", [".x"]), ("id", []), ("a= =b class=c", [".c"])]
    for a, want in named:
        assert extract.names_of("div", " " + a) == want, a
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(i, "u", f"<div {a}><p>{text}</p></div>") for i, a in enumerate([*plain, "hidden"])], "page_id long, url string, html string")
    assert [r.text for r in extract.extract(df).orderBy("page_id").collect()] == [text] * len(plain) + [""]
