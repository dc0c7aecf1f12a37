from textloom.llm import op1_html as H

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class='ad'>Buy</div>{}<footer>&copy; foot</footer></body></html>"
SCHEMA = "page_id bigint, url string, html string, host string, text string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(2)
    return {r.page_id: (r.text, r.n_chars) for r in H.extract_main_text(df).collect()}


def test_article_of_marked_up_page(spark):
    body = "<article><h1>Head &amp;  line</h1><p><b>One\n two<br><p>Th&eacute; &#233;nd</p><aside>Side</aside><div class='comments'><p>Me too</p></div></article>"
    got = run(spark, [(1, "http://a.b/x/1", PAGE.format(body)), (2, "http://a.b/x/2", PAGE.format("<article><p>Other</p></article>"))])
    assert got == {1: ("Head & line One two Thé énd", len("Head & line One two Thé énd")), 2: ("Other", 5)}


def test_shared_lines_go_without_an_article(spark):
    rows = [(i, f"http://a.b/n/{i}", f"<html><body><div>Site name</div><div>Story {i} text</div><div>Imprint</div></body></html>") for i in range(6)]
    got = run(spark, rows)
    assert {i: t for i, (t, _) in got.items()} == {i: f"Story {i} text" for i in range(6)}


def test_copies_keep_their_text(spark):
    rows = [(i, "http://a.b/same", "<div>Site</div><p>All the same</p>") for i in range(3)]
    assert {t for t, _ in run(spark, rows).values()} == {"Site All the same"}


def test_nulls_and_odd_pages(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://q.r/", "<p>cut <a hre"), (4, "http://s.t/", "a < b & c &lt; d"), (5, "http://u.v", "<script>never closed <p>x"), (6, "http://w.x", "<p>" + "long " * 50_000)]
    got = run(spark, rows)
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[3] == ("cut", 3) and got[4] == ("a < b & c < d", 13) and got[5] == ("", 0)
    assert got[6][1] == 5 * 50_000 - 1


def text(page, *others):
    return H.main_text(H.lines(page), [H.lines(x) for x in others])


def test_class_names_that_mark_nothing():
    assert text('<div id="page" class="has-sidebar"><h1>Title</h1><p>Body text</p></div>') == "Title Body text"
    assert text('<article><div class="entry no-comments"><p>Body</p></div></article>') == "Body"
    assert text('<div class="left-sidebar">Menu</div><p>Body</p>') == "Body" == text('<div class="postComments">Nice</div><p>Body</p>')
    assert text('<div class="share-buttons">Share</div><div class="comments-open"><p>Body</p></div>') == "Body"
    # a page that is marked as a whole
    assert text('<div class="widget"><p>All there is</p></div>') == "All there is" and text("<nav>Menu</nav>") == ""


def test_attributes():
    assert text('<p title="the hidden cost">Body text</p>') == "Body text"
    assert text("<p data-x=don't>Hello world. It's fine</p><p>End</p>") == "Hello world. It's fine End"
    assert text("<p a='>' b=\">\" c = x/y>Body</p><img alt='a > b'><p hidden>Not</p><br/><p style='display: none'>Nor</p>") == "Body"
    assert text('<span class="ad">Buy <span>now</span> all</span> <span>this</span>') == "this"
    assert text('<div role="main"><p>A</p><div role=complementary>B</div></div><div>C</div>') == "A"


def test_time_grows_with_the_page():
    import time

    began = time.process_time()
    for page in ("<svg>" * 40_000, "<div>" * 8_000 + "x" + "</div>" * 8_000, "<a b='" * 30_000, "<span class=ad>" * 20_000, "<textarea><p>" * 20_000, "<a " + "b=c " * 50_000):
        H.lines(page)
    assert time.process_time() - began < 10


def test_alignment_decides_without_markup():
    """Pages of a site without any tag or class that tells, the same menu and imprint, an advert on three of four."""
    def page(i):
        advert = "<div>Buy now</div>" if i % 4 else ""
        return f"<div>Site name</div><div>Home</div>{advert}<div>Story {i}</div><div>It happened {i} times</div><div>Imprint</div>"

    rows = [(i, f"http://a.b/n/{i:03}", page(i)) for i in range(12)]
    # an exact copy and a near one, beside their page: neither makes the story a template
    rows += [(100, "http://a.b/n/005?x", page(5)), (101, "http://a.b/n/005a", page(5).replace("Imprint", "Imprint</div><div>Late news"))]
    rows.sort(key=lambda r: (r[1].partition("?")[0], r[0]))
    got = {r[0]: r[2] for r in H._stream((i, u, "a.b", u, h) for i, u, h in rows)}
    assert got[100] == got[5] == "Story 5 It happened 5 times" and got[101] == "Story 5 It happened 5 times Late news"
    assert all(got[i] == f"Story {i} It happened {i} times" for i in range(12))


def test_alignment_decides_between_articles():
    """A teaser that the pages of a host share is in an <article> as well as their stories; paragraphs of a story that are
    on other pages too stay."""
    def page(i):
        return f"<main><p>Best of all sites</p><article><p>Win a car</p></article><article><h1>Story {i}</h1><p>The same quote</p></article></main>"

    rows = [(i, f"http://a.b/n/{i:03}", page(i)) for i in range(6)]
    got = {r[0]: r[2] for r in H._stream((i, u, "a.b", u, h) for i, u, h in rows)}
    assert got == {i: f"Story {i} The same quote" for i in range(6)}
    # nothing tells in which one the article is, alone on the host or where all is shared
    alone = "Best of all sites Win a car Story 1 The same quote"
    assert text(page(1)) == alone == text(page(1), page(1), page(1))
    assert text("<article><p>A</p><article><p>B</p></article><p>C</p></article>", "<article><p>X</p></article>") == "A B C"


def test_without_the_alignment_the_site_frame_stays():
    page = H.lines("<div>Site</div><div>Story</div>")
    assert H.main_text(page, []) == "Site Story" and H.main_text(page, [H.lines("<div>Site</div><div>Other</div>")]) == "Story"


def test_many_copies_are_one_neighbour():
    rows = [(i, f"http://a.b/n/1?{i}", "<div>Site</div><div>Copied</div>") for i in range(300)] + [(1000, "http://a.b/n/2", "<div>Site</div><div>Else</div>")]
    got = {r[0]: r[2] for r in H._stream((i, u, "a.b", u, h) for i, u, h in rows)}
    assert got == {**dict.fromkeys(range(300), "Copied"), 1000: "Else"}


def test_empty_table(spark):
    assert H.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    import random

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    most = H.MOST_BITS
    try:
        for trial in range(300):
            H.MOST_BITS = 4 if trial % 2 else most
            a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
            hit = H.shared(a, b)
            kept = [x for x, h in zip(a, hit, strict=True) if h]
            assert len(kept) == length(a, b) == length(kept, b)
    finally:
        H.MOST_BITS = most
