import random
import re

import numpy as np

from ledgerline.llm.html_extract import DROP, HOST, KEEP, NAMED, UNDECIDED, aligned, extracted, lines_of, line_hashes, main_text, shared_lines

SCHEMA = "page_id long, url string, html string, text string, key string, shared string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(150):
        a, b = (np.array([rng.randint(0, 6) for _ in range(rng.randint(0, 14))], np.uint64) for _ in range(2))
        on = shared_lines(a, b)
        assert on.sum() == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in a[on])  # in order
        assert len(aligned(a, b, cells=4)) == lcs(a, b)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return {(r.page_id, r.url): (r.text, r.n_chars, r.n_shared) for r in extracted(df).collect()}


def test_landmarks_decide_where_there_are_some(spark):
    page = (
        "<html><head><title>T</title><script>if (a < b) x('<p>no</p>')</script></head><body><header>Site</header><nav><a>Home</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>one\n two<p>x&lt;y <b>bold</b><br>z"
        "<aside>see also</aside><form>mail <input></form><div class='comments'><p>first!</p></div></article><footer>&copy; me</footer></body></html>"
    )
    got = run(spark, [(1, "http://a.org/x/1", page), (2, "http://a.org/x/2", page.replace("one", "1"))])
    assert got[1, "http://a.org/x/1"][0] == "A & B\none two\nx<y bold\nz"
    assert got[1, "http://a.org/x/1"][1] == len("A & B\none two\nx<y bold\nz")


def test_differencing_decides_without_landmarks(spark):
    def page(*body):
        return "<body><div>Top menu</div>" + "".join(f"<p>{x}</p>" for x in body) + "<div>All pages end so</div></body>"

    rows = [(i, f"http://h.org/d{i // 5}/p{i}.html", page(f"story {i}", f"more {i}")) for i in range(40)] + [(99, "http://alone.org/1", page("only"))]
    got = run(spark, rows)
    for i in range(40):
        assert got[i, f"http://h.org/d{i // 5}/p{i}.html"] == (f"story {i}\nmore {i}", len(f"story {i}\nmore {i}"), 2)
    assert got[99, "http://alone.org/1"][0] == "Top menu\nonly\nAll pages end so"


def test_odd_input(spark):
    rows = [(None, None, None), (1, None, "<p>a"), (1, None, "<p>a"), (2, "::::", "<<<p>>b</p"), (3, "http://a/", ""), (4, "http://a/", "x" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = extracted(df).collect()
    assert len(got) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got if r.page_id == 1) == ["a", "a"]
    assert extracted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_roles():
    assert lines_of("a<main>b<nav>c</nav>d</main>e") == [(UNDECIDED, "a"), (KEEP, "b"), (DROP, "c"), (KEEP, "d"), (UNDECIDED, "e")]
    assert lines_of("<div hidden>x</div>y&nbsp; z<!-- no -->") == [(DROP, "x"), (UNDECIDED, "y z")]


def test_names_of_the_page_and_of_articles_drop_nothing():
    for page in (
        "<body class='home no-sidebar'><p>text</p></body>",
        "<html class='menu'><body class='has-header-image nav'><p>text</p></body></html>",
        "<body><div class='widget'><p>text</p></div></body>",
    ):
        assert lines_of(page) == [(NAMED if "widget" in page else UNDECIDED, "text")]
    assert lines_of("<article class='post comments-open'><div class='entry-header'><h1>Title</h1></div><p>text</p></article>") == [(UNDECIDED, "Title"), (KEEP, "text")]
    assert lines_of("<main id='search'><p>text</p><div class='comments'>first</div></main>") == [(KEEP, "text"), (NAMED, "first")]
    assert lines_of("<article><div class='has-sidebar'><header><h1>T</h1></header><div class='entry-content'>x</div></div></article>") == [(UNDECIDED, "T"), (KEEP, "x")]
    assert lines_of("<ul class='main-menu'><li>Home</ul><div id='main' class='has-sidebar'>x</div>") == [(UNDECIDED, "Home"), (KEEP, "x")]


def test_names_around_a_main_landmark_drop_nothing():
    assert lines_of("<div class='header'><div class='nav'>a<div role='main' class='widget'>b</div></div><p>c</div>") == [(UNDECIDED, "a"), (KEEP, "b"), (UNDECIDED, "c")]
    assert lines_of("<div class='sidebar'><p>a</p></div><div class='search'><main>b</main></div>") == [(NAMED, "a"), (KEEP, "b")]
    assert lines_of("<div class='widget'><article>a</article></div>") == [(KEEP, "a")]
    assert lines_of("<main>a</main><div class='comments'><article>first</article></div>") == [(KEEP, "a"), (NAMED, "first")]


def test_a_title_in_a_doubtful_block_stays(spark):
    def page(i):
        return f"<body class='home no-sidebar'><div class='site-nav'>Menu</div><article class='post comments-open'><div class='entry-header'><h1>Title {i}</h1></div><p>text</p><div class='share-buttons'>Share</div></article></body>"

    got = run(spark, [(i, f"http://a.org/x/{i}", page(i)) for i in (1, 2)])
    assert [got[i, f"http://a.org/x/{i}"][0] for i in (1, 2)] == ["Title 1\ntext", "Title 2\ntext"]


def test_quotes_and_values():
    assert lines_of("<main><p title=\"it\"s\">one</p><p a='x' b = \"y > z\" c=d'e>two</p></main>") == [(KEEP, "one"), (KEEP, "two")]
    assert lines_of("<div title='class=ad id=menu'>one</div><div data-id='menu'>two</div>") == [(UNDECIDED, "one"), (UNDECIDED, "two")]
    assert lines_of("<article><div class='header'><h1>T</h1></div>x</article>") == [(UNDECIDED, "T"), (KEEP, "x")]


def whole(rows):
    """The operator from its definition: runs in the order of host, path, id, url; each with its nearest other run."""
    runs = []
    for i, url, html in sorted(rows, key=lambda r: (*address(r[1]), r[0], r[1])):
        lines = lines_of(html)
        host, path = address(url)
        texts = [t for _, t in lines]
        if not runs or runs[-1]["host"] != host or runs[-1]["texts"] != texts:
            runs.append({"host": host, "texts": texts, "first": path, "pages": []})
        runs[-1]["last"] = path
        runs[-1]["pages"].append((i, url, [r for r, _ in lines]))
    out = []
    for k, run in enumerate(runs):
        near = []
        for j, mine, other in ((k - 1, "first", "last"), (k + 1, "last", "first")):
            if 0 <= j < len(runs) and runs[j]["host"] == run["host"]:
                a, b = run[mine], runs[j][other]
                near.append((next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b))), -len(near), j))
        shared = [np.zeros(0, bool)]
        if near:
            most = max(n for n, _, _ in near)
            shared = [shared_lines(line_hashes(run["texts"]), line_hashes(runs[j]["texts"])) for n, _, j in near if n == most]
        out += [(i, url, {main_text(roles, run["texts"], s) for s in shared}) for i, url, roles in run["pages"]]
    return out


def address(url):
    found = re.match(HOST, url)
    return (found[1].lower() if found else "", re.sub(r"/?(?:[?#].*)?$", "", re.sub(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", "", url), count=1))


def test_whole_query_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        host = rng.choice(["a.org", "a.org", "B.org", "c.org"])
        body = [f"<p>{rng.choice(['menu', 'foot', 'more', 'ad'])} {rng.randint(0, 2)}</p>" for _ in range(rng.randint(0, 7))]
        body += [f"<div class='{rng.choice(['ad', 'x', 'site-nav'])}'>note {rng.randint(0, 3)}</div>", f"<p>story {rng.randint(0, 90)}</p>"]
        if rng.random() < 0.3:
            body.append(f"<article>text {rng.randint(0, 2)}</article><nav>n {i % 5}</nav>")
        rng.shuffle(body)
        html = "".join(body) if rng.random() < 0.7 else "<p>the same page</p><p>again and again</p>"
        rows.append((i, f"http://{host}/d{rng.randint(0, 6)}/p{i % 50}", html))
    got = run(spark, rows)
    want = whole(rows)
    assert len(got) == 300 and sum(n for _, _, n in got.values()) > 100  # differencing decides many lines
    for i, url, allowed in want:
        assert (got[i, url][0], got[i, url][2]) in allowed, (i, url)


def test_differencing_finds_the_text_of_pages_without_landmarks(spark):
    """Pages as in the test tables, whose landmarks and names are taken away and whose menus a host's pages share."""
    rows, truth = [], {}
    for i in range(120):
        h = i % 4
        text = [f"Title {i}", *[f"sentence {i} {k} of the story" for k in range(i % 5 + 1)]]
        truth[i] = "\n".join(text)
        rows.append((i, f"https://h{h}.org/en/{i}.html", f"<body><ul><li>Home {h}</li><li>News {h}</li></ul><div>Advert {h}</div><div><h1>{text[0]}</h1>{''.join(f'<p>{t}</p>' for t in text[1:])}</div><div>&copy; h{h}</div></body>"))
    got = run(spark, rows)
    assert all(got[i, url][:2] == (truth[i], len(truth[i])) and got[i, url][2] == 4 for i, url, _ in rows)
