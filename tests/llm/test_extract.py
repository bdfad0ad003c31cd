import pytest

from terraloom.llm.extract import extract_text, main_text, parse, vote

SCHEMA = "path string, page_id bigint, html string, url string, text string"
BODY = [f"Paragraph {i} of the lesson on rice fields, long enough to count as running text." for i in range(4)]


def site(kind, paragraphs=BODY):
    ps = "".join(f"<p>{p}</p>" for p in paragraphs)
    around = {
        "plain": f"<article><h1>Title</h1>{ps}</article>",
        "div": f'<div id="page" class="has-sidebar"><div class="post-12 content"><h1>Title</h1>{ps}</div><div class="sidebar"><p>{"Side text. " * 30}</p></div></div>',
        "comments": f'<main><h1>Title</h1>{ps}<section id="comments"><h2>Comments</h2>{"<div class=comment><p>Reader says much here.</p></div>" * 20}</section></main>',
        "table": f'<table><tr><td><ul><li><a href="/">Home</a></li></ul></td><td><h1>Title</h1>{ps}</td></tr></table>',
    }[kind]
    return (f'<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body class="no-footer">'
            f'<header><p>Site name</p></header><nav><a href="/a">A</a></nav><div class="cookie-notice">We use cookies. Accept?</div><!-- <p>hidden</p> -->'
            f'<div class="ad">Buy now</div>{around}<form><label>Mail</label><input></form><footer><p>&copy; someone</p></footer></body></html>')


WANT = "\n\n".join(["Title", *BODY])


@pytest.mark.parametrize("kind", ["plain", "div", "comments", "table"])
def test_one_page(kind):
    assert main_text(site(kind), None)[0] == WANT


def running(k, n=3):
    return [f"Part {k}, sentence {i}: rain falls on the fields of the district all day." for i in range(n)]


def tagged(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("page, want", [
    (f'<article class="post category-legal tag-social">{tagged(running(1))}</article>', running(1)),
    (f'<div class="content-with-sidebar">{tagged(running(1))}</div>', running(1)),
    (f'<article>{tagged(running(1))}<section id="search-methods">{tagged(running(2))}</section></article>', running(1) + running(2)),
    (f'<article><header><h1>Title</h1><p>Lead.</p></header><div class="body">{tagged(running(1, 9))}</div><section class="notes"><p>Note.</p></section></article>',
     ["Title", "Lead.", *running(1, 9), "Note."]),
    (f'<div id="comments-page"><article>{tagged(running(1))}</article></div>', running(1)),
    (f'<div class="related">{tagged(running(1, 9))}</div><div class="ad"><p>Buy.</p></div>', running(1, 9)),
    (f'<main>{tagged(running(1))}<div class="share-buttons"><p>Tell your friends about this.</p></div><div id="comment-list">{tagged(running(7, 2))}</div></main>', running(1)),
    (f'<div class="story">{tagged(running(1))}<div class="cookie-notice"><p>We use cookies.</p></div></div><div class="newsletter box"><p>Sign up now.</p></div>', running(1)),
])
def test_names_alone_do_not_lose_an_article(page, want):
    assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>end</footer></body></html>", None)[0].split("\n\n") == want


def test_host_path_keeps_all_parts_of_an_article():
    page = f'<body><article class="first">{tagged(running(1, 6))}</article><article class="second">{tagged(running(2))}</article></body>'
    assert main_text(page, ">body>article.first")[0].split("\n\n") == running(1, 6) + running(2)


def test_generated_pages_against_their_parts(spark):
    """Pages put together from known blocks: exactly the article comes back, in order, however the page is laid out."""
    import random

    rng, rows, want = random.Random(9), [], {}
    noise = ['<nav><ul><li><a href="/a">Menu</a></li></ul></nav>', '<div class="ad">Buy this.</div>', "<aside><p>Aside text here.</p></aside>", "<script>x='</p>'</script>",
             '<div id="cookie-notice"><p>Cookies?</p></div>', "<form><p>Search</p></form>", '<section class="comments"><p>Nice!</p></section>']
    for i in range(120):
        host = rng.randrange(4)
        body = [x for k in range(rng.randrange(2, 6)) for x in running(f"{i}-{k}", rng.randrange(1, 4))]
        inner = "".join(rng.choice([f"<p>{t}</p>", f"<div>{t}</div>", f"<p>{t.replace(' ', chr(10) + '  ', 2)}"]) for t in body)
        some = lambda: "".join(rng.sample(noise, rng.randrange(4)))
        wrap = [("<article>", "</article>"), ('<div class="entry-12 lesson">', "</div>"), ('<main id="top">', "</main>"), ('<div class="w"><article class="tag-related">', "</article></div>")][host]
        rows.append(("x", i, f"<html><body>{some()}{wrap[0]}{inner}{wrap[1]}{some()}<footer>f</footer></body></html>", f"http://h{host}.example/{i}", "t"))
        want[i] = "\n\n".join(body)
    got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_long_running_text():
    body = running("long", 20_000)
    assert main_text(f"<body><div>{tagged(body)}</div></body>", None)[0].split("\n\n") == body


def test_reading_is_tolerant():
    assert main_text("<article><p><b>One &eacute;\n  two<br>three<p>Four <i>five</i>&nbsp;six", None)[0] == "One é two three\n\nFour five six"
    assert main_text("just text < 3 & more", None)[0] == "just text < 3 & more"
    assert main_text('<p title="a>b">x</p><p title="open>y</p>', None)[0].startswith("x")
    assert main_text("<div><p>a</div><p>b</p></nav></article><!-- open <p>c", None)[0] == "a\n\nb"
    assert main_text("<script>never closed <p>x</p>", None)[0] == "" and main_text("", None)[0] == ""
    assert main_text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", None)[0] == "a\n\nb\n\nc\n\nd"
    assert main_text("<p>" * 50000 + "x" + "<div>" * 3000, None)[0] == "x"
    assert main_text("<p a=\"" * 2000, None)[0] is not None


def test_path_is_general():
    assert vote(parse(site("div"))) == vote(parse(site("div").replace("post-12", "post-999"))) == ">body>div.has-sidebar>div.content.post"


def test_host_path_wins_over_the_page(spark):
    rows = [("x", i, site("div", [f"{p} {i}" for p in BODY]), f"https://Peta.example/{i}", "t") for i in range(8)]
    # a page on which a long extra box outweighs the lesson: its own vote would take both
    odd = site("div").replace('<div class="sidebar">', '<div class="box"><p>' + "Another offer of the shop. " * 12 + '</p></div><div class="sidebar">')
    assert "offer" in main_text(odd, None)[0]
    rows += [("x", 100, odd, "http://peta.example:80/odd", "t"), ("x", 101, site("table"), "https://peta.example/other", "t")]
    rows += [("x", 102, None, "https://peta.example/n", "t"), ("x", 103, "", None, "t"), ("x", None, site("plain"), None, "t"), ("x", 104, site("plain"), "not a url", "t"), ("x", 104, site("plain"), "not a url", "t")]
    got = extract_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[100]["text"] == by[101]["text"] == by[None]["text"] == by[104]["text"] == WANT
    assert by[102]["text"] == by[103]["text"] == "" and by[102]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty_table(spark):
    assert extract_text(spark.createDataFrame([], SCHEMA)).collect() == []
