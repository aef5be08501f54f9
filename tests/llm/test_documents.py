import random
from collections import defaultdict

from evflow.llm import html as H
from evflow.llm import jaccard as J
from evflow.llm.components import components


def brute(rows):
    """Classes by comparing all pairs of sets."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and group[a] != group[b] and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, s) in enumerate(sets):
        own = [j for (j, _), g in zip(sets, group, strict=True) if g == group[k] and j is not None]
        out.append((i, len(s), min(own) if own else None))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    assert sorted(map(tuple, J.classes(df).collect()), key=str) == brute(rows)


def test_classes_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows, line = [], " ".join(words[:12])
    for n in range(30):
        text = [r.choice(words) for _ in range(r.choice([2, 4, 5, 7, 9, 11, 14, 20, 60, 150]))]
        for c in range(r.choice([1, 1, 3, 6])):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), f"{line} {' '.join(text[:6])}"))
    check(spark, rows)


def test_short_sets_meet_by_subsets(spark, monkeypatch):
    monkeypatch.setattr(J, "sample_facts", lambda docs: (*(__import__("numpy").zeros(0, t) for t in ("u8", "i8")), 12, 4))
    r = random.Random(6)
    rows = []
    for n in range(12):
        text = [f"v{r.randrange(60)}" for _ in range(r.randint(5, 18))]
        for c in range(4):
            copy = list(text)
            if c:
                copy[-1 if c == 1 else 0] = f"x{c}"
            rows.append((len(rows), " ".join(copy + ["tail"] * (c == 3))))
    check(spark, rows)


def test_hard_rows(spark, hard, none):
    rows = [(x.doc_id, x.text) for x in hard.collect()]
    check(spark, rows)
    assert J.classes(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="sidebar"><p>Side {n}</p></div>
<div class="wrap"><div class="post post-{n}"><h1>Title &amp; {n}</h1><p>First   para
graph {n} with words.<p>Second <b>one<br>here &lt;3</p><div class="ad-box"><p>buy</p></div>
<form><p>Your name</p></form></div></div><section id="comments"><p>A very long comment {n} that says much more than the article itself does, really.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_main_text_by_consensus(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.format(n=k)) for k in range(5)]
    odd = "<html><body><div class='wrap'><div class='post post-9'><p>Short.</p></div></div><div class='other'><p>A longer block of prose that would win by itself on this page alone.</p></div></body></html>"
    rows += [(9, "http://a.example/9", odd), (10, None, None), (11, "", ""), (12, "http://b.example/", "<p>Only</p> &amp &#233;"), (13, "http://b.example/x", "<div><p>cut <b>off"), (9, "http://a.example/9", odd)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    got = defaultdict(list)
    for x in H.extract(df, min_votes=2).collect():
        got[x.page_id].append(x.text)
        assert x.n_chars == len(x.text)
    for k in range(5):
        assert got[k] == [f"Title & {k}\n\nFirst para graph {k} with words.\n\nSecond one here <3"]
    assert got[9] == ["Short."] * 2
    assert got[10] == got[11] == [""]
    assert got[12] == ["Only\n\n& é"] and got[13] == ["cut off"]


def test_hosts_beyond_the_bound_are_joined(spark, monkeypatch):
    rows = [(k, f"http://h{k % 3}.example/{k}", PAGE.format(n=k)) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, H.extract(df).collect())) == want


def test_long_page(spark):
    rows = [(1, "http://c.example/", "<article>" + "<p>some words of text</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert H.extract(df).first().n_chars == 20_000 * 18 + 19_999 * 2


def test_names_outside_class_id_and_role_are_no_boilerplate():
    article = "<p>An article of some words here.</p>"
    tags = ['div style="overflow:hidden"', 'article style="overflow: hidden"', 'div aria-hidden="false"', 'div data-id="menu"', 'div data-grid="header"', 'div class="search-results"', "form"]
    for tag in tags:
        html = f"<body><nav>Home</nav><{tag}>{article}<div class=sidebar>No</div><aside>No</aside></{tag.split()[0]}><footer>No</footer></body>"
        assert H.main_text(html, None) == "An article of some words here.", tag
    assert H.main_text("<p>a <math><mi>x</mi></math> <object>y</object> <svg><text>z</text></svg></p>", None) == "a x y z"


def test_time_grows_with_length_alone():
    import time

    took = []
    for n in (5_000, 40_000):
        page = "<body><i><ul>" + "<font>" * n + "text " + "<p>x</p></i><li>y" * n
        begun = time.process_time()
        assert H.main_text(page, None).startswith("text")
        took.append(time.process_time() - begun)
    assert took[1] < 25 * max(took[0], 0.05)


def test_winning_paths_equal_plain_counts(spark):
    from collections import Counter

    r = random.Random(8)
    rows = [(f"h{r.randrange(4)}", r.randrange(5), float(r.randrange(3))) for _ in range(200)]
    got = {x.host: (x.path, x.votes) for x in H.winning_paths(spark.createDataFrame(rows, "host string, path long, score double").repartition(3)).collect()}
    votes, score = Counter((h, p) for h, p, _ in rows), Counter()
    for h, p, s in rows:
        score[h, p] += s
    for h in {h for h, _, _ in rows}:
        best = max((votes[h, p], score[h, p], p) for p in range(5) if votes[h, p])
        assert got[h] == (best[2], best[0])


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_are_not_lost_by_tags_or_names():
    said = "The story of a long day, told here."
    for page in (
        f"<body><title-bar>x</title-bar><article><p>{said}</p></article></body>",
        f"<body><template-card></template-card><article><p>{said}</p></article></body>",
        f"<body><select><option>a<option>b<div><article><p>{said}</p></article></div></body>",
        f"<body><div><p class='comment-text'>{said}</p></div></body>",
        f"<body><article><p>{said}</p></article><div class='user-opinions'>{'<p>I disagree with all of it, at length.</p>' * 5}</div></body>",
        f"<body><div class='comment-list'><p>{said}</p></div></body>",
    ):
        assert H.main_text(page, None) == said, page
    inner = "<h2 class='section-header'>One</h2><div class='entry-header'><h1>Two</h1></div><p class='side-note'>Three</p><p class='copyright-law'>Four</p><p>The <span class='form'>five</span> of <a class='search'>six</a>, here.</p>"
    text = "One\n\nTwo\n\nThree\n\nFour\n\nThe five of six, here."
    assert H.main_text(f"<body><article>{inner}<div class='ad-box'><p>buy</p></div><ul class='menu'><li><a>x</a></ul></article></body>", None) == text
    long = "<p>" + "Prose of the article goes on and on. " * 15 + "</p>"
    assert H.main_text(f"<body><article><p>{said}</p><div class='legal-text'>{long}</div><div class='notice'>Closed today.</div></article></body>", None).startswith(said + "\n\nProse")


def test_random_pages_give_what_they_were_made_of():
    r = random.Random(11)
    words = "river stone light winter garden paper window music".split()

    def prose(n):
        return " ".join(r.choices(words, k=n)) + "."

    outside = ["<nav><a href='/'>{}</a></nav>", "<div class='sidebar'><p>{}</p></div>", "<footer>{}</footer>", "<header><p>{}</p></header>", "<div class='comments'><p>{}</p></div>", "<form><input><label>{}</label></form>", "<script>{}</script>", "<x-card><aside>{}</aside></x-card>"]
    within = ["<div class='ad'>{}</div>", "<ul class='share-links'><li><a href='#'>{}</a></ul>", "<style>{}</style>", "<!-- {} -->", "<select><option>{}"]
    for _ in range(150):
        want, page = [], "".join(r.choice(outside).format(prose(4)) for _ in range(r.randint(0, 4)))
        wrap = r.choice(["<article>", "<main><div class='story'>", "<div class='post-7'>"])
        page += wrap
        for _ in range(r.randint(2, 6)):
            if r.random() < 0.3:
                page += r.choice(within).format(prose(3))
            text = prose(r.randint(12, 30))
            open_, close = r.choice([("<p>", "</p>"), ("<p>", ""), ("<h2>", "</h2>"), ("<div class='lead'><p>", "</div>"), ("<blockquote>", "</blockquote>")][: 3 if "post" in wrap else 5])
            page += open_ + text.replace("stone", "<b>st&#111;ne</b>") + close
            want.append(text)
        page += "</div></article></main>" + "".join(r.choice(outside).format(prose(4)) for _ in range(r.randint(0, 3)))
        assert H.main_text(f"<html><body>{page}</body></html>", None) == "\n\n".join(want), page
