import re

from entlink.llm import html_text as h
from entlink.llm import queries as Q

LONG = "The cat sat on the mat and it was very happy with the day because the sun was out. " * 4


def test_odd_pages():
    t = h.main_text
    assert t(None) == t("") == t("<") == t("<p") == ""
    assert t(f"<article><h1>T &amp; U</h1><p>a&nbsp;\n b<br>c<p>d<script>var x='<p>no</p>'</script> e</article><footer>no</footer>") == "T & U\n\na b c\n\nd e"
    assert t("<article><p>one</p><div class='ad'>no</div><div id=comments><p>no</p></div><p>two</p><form><p>no</p></form><!-- <p>no</p> --></article>") == "one\n\ntwo"
    assert t("<header><p>no</p></header><main><header><h1>Title</h1></header><p>x &lt;b&gt; &#233;&#x1F642; &am") == "Title\n\nx <b> é🙂 &am"
    assert t("<article><ul><li><a href=x>link one</a><li><a href='y'>link two</a></ul><p>see <a href=z>this</a> for more words</p></article>") == "see this for more words"
    assert t('<article><p title="a > b">in</p><p class=\'x>y\'>quoted</p><a href="unclosed>never') == "in\n\nquoted"
    assert t("<article><p><b>bold<br><p>next</p></article>") == "bold\n\nnext"
    assert t("<article><svg><text>no</text></svg><style>p{}</style><noscript>no</noscript><p>yes") == "yes"
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert t(deep) == "" and t("<article>" + deep) == "x"
    assert t("<article><p>" + "word " * 200000 + "</article>") == ("word " * 200000).strip()


def test_two_passes_without_article():
    page = (f"<div><a href=/>Home</a> <a href=/b>About us</a></div><h1>Short title</h1><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>"
            "<p>It is the one that we have seen with all of the others, so to say, and then more.</p>"
            "<div><a href=/1>Some link to a page that has a long enough name to count as long text</a></div><p>© 2020 nobody</p><p>End bit</p>")
    got = h.main_text(page).split("\n\n")
    clean = " ".join(LONG.split())
    assert got[:4] == ["Short title", clean, "Tiny.", clean][1:] + got[3:4] or got[0] == clean
    assert "Tiny." in got and clean in got and any(x.startswith("It is the one") for x in got)
    assert not any("link" in x or "©" in x or "Home" in x or "End bit" == x for x in got)
    russian = "Мама мыла раму и смотрела в окно на улицу, где шёл дождь. " * 5
    assert h.main_text(f"<div><p>{russian}</p><p><a href=x>ссылка</a></p></div>") == " ".join(russian.split())


def test_both_passes_with_an_article():
    clean = " ".join(LONG.split())
    tags = "Tags: economy markets banking inflation currency trade exports policy rates growth"
    inside = (f"<article><h1>Title</h1><p>By <a href=/j>Jane Doe of somewhere</a></p><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p><div>{tags}</div>"
              "<div>Share</div><div>© 2020 nobody</div><div>Print</div></article>")
    assert h.main_text(inside).split("\n\n") == ["Title", clean, "Tiny.", clean]
    outside = f"<article><h2>Teaser</h2></article><div><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div>Some words after it</div>"
    assert h.main_text(outside).split("\n\n") == ["Teaser", clean, "Tiny.", clean]
    near = f"<article><p>{LONG}</p></article><p>Sign up and get all of the news that we have for you in one mail of the day.</p>"
    assert h.main_text(near) == clean
    russian = "Мама мыла раму и смотрела в окно на улицу, где шёл дождь. " * 5
    assert h.main_text(f"<article><h1>Мама</h1><p>{russian}</p><p>Конец</p></article>") == f"Мама\n\n{russian.strip()}\n\nКонец"


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.QUERIES["op6_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    import html

    for r in got:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]]["html"], re.S)
        inside = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", i) if "<br>" in i else re.sub(r"<[^>]*(>|\Z)", "", i)).split()) for i in inside) if x)
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article>a</article>", "x")], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in h.extract(df).collect()), key=repr) == sorted([(1, "u", ""), (1, "u", ""), (None, None, "a")], key=repr)
    assert h.extract(df.limit(0)).count() == 0


BODY = ("This is the first paragraph of the article and it has all of the words that one would want to read in it, more than a few of them.",
        "And then there is the second one, which was written so that it is about as long as the first and has the same kind of words in it.")


def article(opening, closing="", inside=""):
    return f"<html><body><nav><a href='/'>Home</a></nav>{opening}<p>{BODY[0]}</p>{inside}<p>{BODY[1]}</p>{closing}<footer>Imprint</footer></body></html>"


def test_names_around_an_article_do_not_empty_it():
    from entlink.llm.html_text import main_text

    whole = "\n\n".join(BODY)
    for opening in ("<div class='layout has-sidebar'><article>", "<article class='post category-social'>", "<article class='post comments-open'>", "<article id='search-engines-explained'>",
                    "<div class='sidebar'><article>", "<article class='social'>", "<div id='widget'><main>", "<div class='share related'><article class='post'>"):
        assert main_text(article(opening, "</article></div>")) == whole, opening
    # beside an article without such names they count
    two = article("<article>", "</article><div class='sidebar'><article><p>" + BODY[0].replace("first", "third") + "</p></article></div>")
    assert main_text(two) == whole
    for name in ("comment-body", "related", "site-footer", "cookie-banner", "newsletter form"):
        assert main_text(article("<article>", "</article>", f"<div class='{name}'><p>{BODY[0].replace('first', 'other')}</p></div>")) == whole, name


def test_anchors_and_marks_inside_paragraphs():
    from entlink.llm.html_text import main_text

    whole = "\n\n".join(BODY)
    assert main_text(article("<article><a name='top'>", "</article>")) == whole
    assert main_text(article("<article><p><a href='/x'>Link without an end</p>", "</article>")).endswith(whole)
    right = "The rights to it, © 2020, are those of the people who wrote this, and it is here that one can read of them and what they have done."
    assert main_text(article("<article>", "</article>", f"<p>{right}</p>")) == f"{BODY[0]}\n\n{right}\n\n{BODY[1]}"
    assert "©" not in main_text(article("<article>", "<p>© 2020 Some Firm</p></article>"))


def nearest(labels, i, step, decided, edge):
    i += step
    while 0 <= i < len(labels):
        if labels[i] in decided:
            return labels[i]
        i += step
    return edge


def test_sweeps_find_the_nearest_neighbours():
    import random

    from entlink.llm import html_text as ht

    rnd = random.Random(3)
    for _ in range(300):
        labels = [rnd.choice(["good", "bad", "near", "short"]) for _ in range(rnd.randint(0, 12))]
        for decided in (("good", "bad"), ("good", "bad", "near")):
            before, after = ht._sides(labels, decided, "good", "bad")
            assert before == [nearest(labels, i, -1, decided, "good") for i in range(len(labels))]
            assert after == [nearest(labels, i, 1, decided, "bad") for i in range(len(labels))]


def test_a_page_of_a_hundred_thousand_blocks():
    import time

    from entlink.llm.html_text import main_text

    page = "<body>" + "<p>short words</p><p>an other</p>" * 50_000 + "</body>"
    began = time.time()
    assert main_text(page) == ""
    assert time.time() - began < 20
