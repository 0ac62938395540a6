import html
import re
import time

import pytest
from pyspark.sql import functions as F

from snapframe.llm import html_extract, queries, unit_dedup
from snapframe.llm.html_extract import extract

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><div class="cookie-banner">We use cookies, really, yes</div>
<header><h1>Site</h1></header><div id=nav><a href=x>a</a></div>
<div class="content"><h1>Title</h1><p>First para, with commas, and text &amp; more <a href=z>link</a>.<p>Second   para<br>line two
<div>Loose text here, really.</div><form>name <input></form><ul><li>one<li>two</ul><script>var a = "<p>no</p>";</script></div>
<div class=comments><p>nice post, really, long long comment, with, commas, commas</div><div class="sidebar">x</div><footer>f</footer>"""


def test_article_without_boilerplate():
    assert extract(PAGE) == "Title\n\nFirst para, with commas, and text & more link.\n\nSecond para line two\n\nLoose text here, really.\n\none\n\ntwo"


def test_siblings_of_the_best_container_are_kept():
    page = "<body><div><p>Lead, short.</p><div><p>" + "long text, with commas, " * 20 + "</p></div><p>Tail text.</p><ul><li><a href=1>a b c</a><li><a href=2>d e f</a><li><a href=3>g h</a></ul></div></body>"
    text = extract(page)
    assert text.startswith("Lead, short.") and text.endswith("Tail text.") and "a b c" not in text


def test_names_drop_boilerplate_only():
    body = "<h1>Title</h1><p>" + "Long text, with commas. " * 20 + "</p><p>Second text, long enough.</p>"
    whole = "Title\n\n" + ("Long text, with commas. " * 20).strip() + "\n\nSecond text, long enough."
    for wrapper in ("class='content sidebar-right'", "id='wrapper' class='nav-fixed'", "class='layout menu-open'", "class=modal"):
        assert extract(f"<body><div {wrapper}>{body}</div></body>") == whole
    page = f"<body><article>{body}<section id='social-impact'><h2 id='discussion'>Impact</h2><p>More.</p></section><div class='post-share-row'><a href=1>Send it</a></div></article>"
    assert extract(page) == whole + "\n\nImpact\n\nMore."
    comment = "<article class='comment'><p>Nice post, really, with, many, commas.</p></article>"
    assert extract(f"<body><article>{body}{comment}</article>{comment * 9}</body>") == whole
    assert extract(f"<body><div class=content>{body}<div class='sidebar right'><p>Other, words, here.</p></div></div><div class=comments-area>{comment * 40}</div>") == whole


def test_broken_markup_never_fails():
    for page in ("", " ", "<", "<p>", "</p></p>x", "<a href='x", "<script>x", "a<b", "<b>bold", "<div " * 500, '<a "' * 2000, "<div>" * 5000 + "x", "<!-- open", "<td>a<td>b"):
        assert isinstance(extract(page), str)
    assert extract("<b>bold") == "bold"
    assert extract("plain, text") == "plain, text"
    assert extract("<p>a&nbsp;b&lt;c&#x41;") == "a b<cA"
    assert extract(None) == ""


def test_test_pages_give_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    found = html_extract.extract_pages(pages).collect()
    assert len(found) == len(source)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1|ul|li)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_page_table_edges(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>x, y</p>"), (2, "u", "<p>" + "w, " * 100_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    assert sorted(r.n_chars for r in html_extract.extract_pages(pages).collect()) == [0, 0, 4, 299_999]
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


LINE = " ".join(f"w{i}" for i in range(30))


def brute_spans(rows, min_words=unit_dedup.MIN_WORDS):
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        at, spans = 0, []
        for line in (text or "").split("\n"):
            key = unit_dedup.digest(line, min_words)
            if key and key in seen:
                spans.append((at, at + len(line), seen[key]))
            elif key:
                seen[key] = doc_id
            at += len(line) + 1
        out.append((doc_id, spans))
    return out


def test_units_match_brute_force(make_docs, documents):
    rows = [(5, f"é {LINE}\nshort\n{LINE}"), (2, f"{LINE.upper()}  \nshort"), (9, f"{LINE}\n{LINE}\nshort"), (3, None), (4, ""), (7, "\n\n"), (8, (LINE + " x ") * 2000)]
    rows += [(r.doc_id + 100, r.text) for r in documents.collect()]
    found = unit_dedup.repeated_spans(make_docs(*rows)).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.removed]) for r in found) == sorted(brute_spans(rows))


def test_removal_keeps_the_first_and_the_rest_of_the_text(make_docs):
    docs = make_docs((1, f"{LINE}\ntail"), (2, f"head\n{LINE}\ntail"), (None, "x"), (3, None), (2, f"head\n{LINE}\ntail"))
    out = unit_dedup.remove_repeats(docs)
    assert out.columns == [*docs.columns, "removed_spans"]
    assert sorted(str((r.doc_id, r.text)) for r in out.collect()) == sorted(str(x) for x in [(1, f"{LINE}\ntail"), (2, "head\ntail"), (2, "head\ntail"), (3, None), (None, "x")])
    assert unit_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_paragraph_units(make_docs):
    text = f"{LINE}\n{LINE}\n\nother"
    found = {r.doc_id: r for r in unit_dedup.repeated_spans(make_docs((1, text), (2, text)), unit="paragraph").collect()}
    assert [tuple(s) for s in found[2].removed] == [(0, 2 * len(LINE) + 1, 1)] and found[1].n_removed == 0


def wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_query_finds_passages_whatever_the_lines(spark, make_docs, tmp_path):
    own = lambda name, n: [f"{name}{i}" for i in range(n)]
    passage = own("é", 54)
    rows = [
        (1, wrapped(own("a", 15) + passage + own("b", 80), 70)),
        (2, wrapped(own("c", 30) + passage + own("d", 9), 15)),
        (3, "\n\n".join([" ".join(own("e", 5)), wrapped(own("f", 24), 8)])),
        (4, "\n\n".join([wrapped(own("f", 24), 8), " ".join(own("g", 5))])),
        (5, " ".join(own("h", 200))),
        (6, " ".join(["x"] * 300)),
        (7, None),
    ]
    make_docs(*rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op6_unit_dedup(spark, str(tmp_path)).collect()}
    assert [found[i].n_removed for i in range(1, 8)] == [0, 1, 0, 1, 0, 1, 0]
    cut = {i: rows[i - 1][1][found[i].removed[0].start : found[i].removed[0].end].split() for i in (2, 4, 6)}
    assert " ".join(cut[2]) in " ".join(passage) and len(cut[2]) >= 54 - 2 * (unit_dedup.WINDOW - 1) and found[2].removed[0].keep_id == 1
    assert cut[4] == own("f", 24) and found[4].removed[0].keep_id == 3
    assert len(cut[6]) == 300 - unit_dedup.PASSAGE_WORDS


def test_passages_match_brute_force(make_docs, documents):
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = sorted({r.doc_id: r.text for r in documents.collect()}.items())
    found = {r.doc_id: r.removed for r in unit_dedup.repeated_passages(make_docs(*rows)).collect()}
    k, sure, ends = unit_dedup.PASSAGE_WORDS, unit_dedup.MIN_WORDS + 2 * (unit_dedup.WINDOW - 1), unit_dedup.WINDOW - 1
    seen = {}
    for doc_id, text in rows:
        words, at = lower(text), [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        gone = {i for s in found[doc_id] for i, (a, b) in enumerate(at) if s.start <= a and b <= s.end}
        may, must = set(), set()
        for n in (k, sure):
            for i in range(len(words) - n + 1):
                doc, first = seen.setdefault(tuple(words[i : i + n]), (doc_id, i))
                if n == k and (doc, first) != (doc_id, i):
                    may |= set(range(i, i + n))
                if n == sure and (doc != doc_id or first + n <= i):  # else the text overlaps with what it repeats
                    must |= set(range(i + ends, i + n - ends))
        assert must <= gone <= may, doc_id


def test_rows_of_one_id_are_cut_apart(make_docs):
    shared = " ".join(f"w{i}" for i in range(25))
    docs = make_docs((1, f"{shared}\nfirst"), (2, f"{shared}\nsecond"), (2, "OTHER text that must stay whole " + "x" * 200), (None, shared + "\nnull id"), (2, None)).withColumn("removed_spans", F.lit(5))
    cut = unit_dedup.remove_repeats(docs)
    assert cut.columns == [*docs.columns, "removed_spans_"]
    texts = sorted((r.doc_id or 0, r.text or "") for r in cut.collect())
    assert texts == [(0, shared + "\nnull id"), (1, "first"), (2, ""), (2, "OTHER text that must stay whole " + "x" * 200), (2, "second")]


def test_unclosed_markup_is_read_in_linear_time():
    import time

    began = time.process_time()
    for unit in ("x <a ", "<a ", "<a x='", '<a "', "<div>", "<p <b>", "<!", "</i>", "<ul><div><li>", "<div><a href=x>y</a>"):
        for size in (1, 200_000 // len(unit)):
            html_extract.extract("<table><td><p>" + unit * size)
    assert time.process_time() - began < 60
    assert html_extract.extract("a <b c" * 3) == "a <b c" * 3
    assert "b>" not in html_extract.extract(f'<p {"x" * 20_000} title="a>b">' + "Some words, and more of them. " * 9)


def test_a_form_around_the_page_is_no_form():
    body = "".join(f"<p>Paragraph {i} has words, commas, and a good length to read.</p>" for i in range(9))
    inner = "<form><p>Your name, please, and address, too.</p><input name=q></form>"
    found = html_extract.extract(f"<form id='aspnetForm'><div id='page'><nav>Home</nav><div>{body}</div>{inner}</div></form>")
    assert found.count("Paragraph") == 9 and "Your name" not in found and "Home" not in found


ARTICLE = "<article><h1>Title</h1><p>" + "Real text, with commas, goes on here. " * 10 + "</p>%s</article>"


@pytest.mark.parametrize(
    "page,gone",
    [
        ("<body><div class='sidebar'>" + "<p>boilerplate, more of it, and more.</p>" * 60 + "</div>" + ARTICLE % "" + "</body>", True),
        (ARTICLE % "" + "<section id='comments'>" + "<p>boilerplate says a reader, hello.</p>" * 300 + "</section>", True),
        (ARTICLE % "<div class='notice'><p>boilerplate, accept please</p></div>", True),
        (ARTICLE % "<p class='advert'>boilerplate, buy now</p>", True),
        ("<body><form>" + "<p>boilerplate, sign up, now.</p>" * 40 + "</form>" + ARTICLE % "" + "</body>", True),
        ("<form id='aspnet'>" + ARTICLE % "<p>boilerplate</p>" + "</form>", False),
        (ARTICLE % "<ul><li><a href='a'>Alpha one</a></li><li><a href='b'>boilerplate</a></li><li><a href='c'>Gamma three</a></li></ul>", False),
        (ARTICLE % "<p><a href='a'>Alpha one</a>, <a href='b'>boilerplate</a>, <a href='c'>Gamma three</a>.</p>", False),
        ("<body>" + (ARTICLE % "").replace("Real", "boilerplate") + ARTICLE % "" + "</body>", False),
    ],
)
def test_named_boilerplate_goes_whatever_its_size_and_nothing_else(page, gone):
    text = html_extract.extract(page)
    assert "Real text" in text and ("boilerplate" in text) is not gone


@pytest.mark.parametrize("page", ["<li><ul>" + "<span>" * 30_000 + "<li>x" * 30_000, "<b><table>" + "<i>" * 30_000 + "</b>" * 30_000, "<table>" + "<tr><td>" * 30_000 + "</span>" * 30_000])
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.extract(page)
    assert time.perf_counter() - began < 5
