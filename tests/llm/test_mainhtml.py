from storyspark.llm import mainhtml
from storyspark.llm.mainhtml import FEATURES, LABELLED, Tree, labelled_rows, main_text

SCHEMA = "page_id bigint, url string, html string, text string, n_chars int"
TREE = Tree(labelled_rows())

FULL = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
<body class="main"><!-- <p>comment</p> --><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a><li><a href="/x">A long menu line of ten words that is no article</a></ul></nav>
<div class="cookie-notice"><p>We use cookies and some more words to fill a long line of text, as such notices do.</p></div>
<div class="ad"><p>Buy &amp; save now.</p></div>
<article class="post"><h1>A  title &lt;here&gt;</h1><p><b>First <a href="#">linked</a> words<br>and more.<p>Second&nbsp;one
with a break.</p><p>No.</p><div class="share-buttons"><a>Share</a></div><ul><li>item one<li>item two</ul>
<aside>See also this</aside><form><label>Mail</label><input><button>Go</button></form>
<section id="comments"><article class="comment"><p>A reader's comment that is long enough to look like an article to anyone.</p></article></section>
<p>Last &#233;&eacute; line &copy.</article><div id="sidebar"><p>Recent posts and a great many other words in a long sidebar text</p></div>
<footer><p>&copy; 2020 Somebody, who wrote a long footer of more than ten words, all rights reserved.</p></footer></body></html>"""

WANT = "A title <here>\nFirst linked words and more.\nSecond one with a break.\nNo.\nitem one\nitem two\nLast éé line ©."


#: Pages that the tree has not seen, labelled alike.
UNSEEN = (
    ("<div>{1/1}</div><div>{2/2}</div><div>{60}</div><div>{35}</div><div>{12}</div><div>{47/2}</div><div>{2/2}</div><div>{2/2}</div>", "00" "1111" "00"),
    ("<div>{6/6}</div><div>{3}</div><div>{2/2}</div><h1>{7}</h1><div>{55}</div><div>{20}</div><div>{41/3}</div><div>{4/4}</div>", "000" "1111" "0"),
    ("<div>{20/20}</div><div>{44/40}</div><div>{60}</div><div>{33}</div><div>{25/25}</div><div>{40/38}</div>", "00" "11" "00"),
    ("<p>{90}<p>{30/28}<p>{29/27}<p>{6/6}", "1" "000"),
    ("<article><h1>{5}</h1><p>{25}<nav><ul><li>{2/2}<li>{3/3}<li>{2/2}</ul></nav><p>{33}<p>{7/7}<p>{20}</article><footer>{9}</footer>", "11" "000" "111" "0"),
    ("<div class=menu>{4/4}</div><article><p>{2}<p>{11}</article><div>{30}</div><div class=banner>{12}</div>", "0" "11" "00"),
)


def test_tree_learns_its_table():
    rows = labelled_rows()
    assert all(TREE.predict(row[:-1]) == row[-1] for row in rows)
    assert {len(row) for row in rows} == {len(FEATURES) + 1} and len(LABELLED) < 40


def errors(tree, rows, off=()):
    return sum(tree.predict(tuple(0 if FEATURES[i] in off else v for i, v in enumerate(row[:-1]))) != row[-1] for row in rows)


def test_words_and_links_of_block_and_neighbours_decide():
    """Unseen pages come out right; a tree grown without densities, or without neighbours, fails on them."""
    rows = labelled_rows(UNSEEN)
    assert errors(TREE, rows) <= 1
    for off in (("link_density", "links_before", "links_after"), ("words", "words_before", "words_after"), ("words_before", "links_before", "words_after", "links_after")):
        blind = [tuple(0 if i < len(FEATURES) and FEATURES[i] in off else v for i, v in enumerate(row)) for row in labelled_rows()]
        assert errors(Tree(blind), rows + labelled_rows(), off) > errors(TREE, rows + labelled_rows()), off


def slow_label(rows, asked):
    """The tree by plain recursion: every cut of every feature, the first of the purest."""
    labels = [r[-1] for r in rows]
    if len(set(labels)) < 2:
        return labels[0]
    cuts = [(f, (a + b) / 2) for f in range(len(asked)) for a, b in zip(sorted({r[f] for r in rows}), sorted({r[f] for r in rows})[1:])]

    def impurity(cut):
        sides = [[r[-1] for r in rows if (r[cut[0]] <= cut[1]) is low] for low in (True, False)]
        return round(sum(len(s) * (sum(s) / len(s)) * (1 - sum(s) / len(s)) for s in sides), 9)

    f, cut = min(cuts, key=lambda c: (impurity(c), c))
    return slow_label([r for r in rows if (r[f] <= cut) == (asked[f] <= cut)], asked)


def test_predictions_match_a_plain_tree():
    table = labelled_rows()
    for row in labelled_rows(UNSEEN):
        assert TREE.predict(row[:-1]) == slow_label(table, row[:-1])


def test_article_without_the_rest():
    assert main_text(FULL, TREE) == WANT


def test_names_of_frames():
    line = "word " * 40
    for name in ("commentlist", "site-footer", "cookieBar", "left-sidebar", "ad-slot", "notice", "related-posts", "nav2", "post-comments"):
        assert main_text(f'<article><p>{line}</p><div class="{name}"><p>{line}</p></div></article>', TREE) == line.strip(), name
    for name in ("commentary", "shadow", "adventure", "story-body", "navy", "content"):
        assert main_text(f'<article><div class="{name}"><p>{line}</p></div></article>', TREE) == line.strip(), name


def test_page_without_article_element():
    line = "word " * 40
    page = f"<body><a href=x>Home</a> <a href=y>News</a><div>{line}</div><div>{line}</div><div><a>More</a> <a>links</a></div></body>"
    assert main_text(page, TREE) == "\n".join([line.strip()] * 2)


def test_rows_and_odd_pages(spark):
    pages = [None, "", "   ", "<", "<p", "<article><p>cut off &am", "<article><p>ends <b", "<article></article>", "plain words " * 12, FULL, FULL]
    pages.append("<article>" + "<div>" * 3000 + "deep" + "</div>" * 10)
    pages.append("<article>" + "<p>long words here</p>" * 20000)
    got = {r.page_id: r for r in mainhtml.extract(spark.createDataFrame([(i, f"u{i}", p, "x", 1) for i, p in enumerate(pages)], SCHEMA)).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert [got[i].text for i in (0, 1, 2, 7)] == [""] * 4
    assert got[5].text.startswith("cut off &") and got[6].text == "ends" and got[8].text == ("plain words " * 12).strip()
    assert got[9].text == got[10].text == WANT and got[11].text == "deep" and got[12].text.count("\n") == 19999
    assert mainhtml.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_head_left_open():
    """HTML lets </head> be left out; the body, or an element that can't stand in a head, ends it."""
    line = ("word " * 40).strip()
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>", "<head><style>p{}</style><noscript><p>no</p></noscript><body>"):
        assert main_text(f"{start}<article><p>{line}</p></article>", TREE) == line, start
    assert main_text(f"<head><title>T</title>\n{line}", TREE) == line


def test_wrappers_do_not_empty_a_page():
    line = ("word " * 60).strip()
    article = f"<article><h1>Title here</h1><p>{line}<p>short</article>"
    want = f"Title here\n{line}\nshort"
    side = "<div class=sidebar><p>links and other words</div>"
    for start, end in (
        ("<div class=content-sidebar-wrap>", f"{side}</div>"), ("<body class='has-sidebar'><div class=has-sidebar>", f"{side}</div>"), ("<form method=post>", f"{side}</form>"),
        ("<form><div class='page with-sidebar'>", "</div></form>"), ("<div id=header-footer-wrap><nav><a>x</a></nav>", "<footer>end of it</footer></div>"),
    ):
        assert main_text(start + article + end, TREE) == want, start
        assert main_text(start + article.replace("<article>", "<div id=content>").replace("</article>", "</div>") + end, TREE) == want, start
    # what holds no body, or few of the words, stays a frame
    assert main_text(f"<div class=sidebar><p>{line}</div>{article}", TREE) == want
    assert main_text(f"{article}<section id=comments><article class=comment><p>{line} {line} {line}</article></section>", TREE) == want
    assert main_text(f"<article><p>{line}<div class=related><div class=content>{line} {line}</div></div></article>", TREE) == line


def test_an_articles_own_header():
    line = ("word " * 40).strip()
    page = f"<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By somebody, today</p></header><p>{line}</p><footer>tags</footer></article>"
    assert main_text(page, TREE) == f"Title\n{line}"
