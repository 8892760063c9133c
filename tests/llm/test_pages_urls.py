import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhaul.llm import main_text as M, queries, url_lists as U


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 26, 6])
def test_alignment_is_longest(cells):
    r = random.Random(1)
    for _ in range(800):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        got = M.shared_lines(a, b, cells)
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in rest for i in got)


def text(html):
    return "\n".join(t for t, zone in M.lines_of(html) if zone == M.DECLARED)


def test_lines_and_zones():
    html = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div id="page-sidebar"><article><h2>Not here</h2></article></div><main><article><header><h1>Caf&eacute;  &amp;\n <i>co</i></h1></header>
<p><b>One<br>two<p>three &lt;x&gt; &am</p><aside>aside</aside><form><p>mail</p></form><table><tr><td>a</td><td>b</td></tr></table>
<div class="cookie-notice"><p>cookies</p></div><section class="comments"><article><p>first!</p></article></section></article></main>
<footer>&copy; 2024</footer>"""
    # an article brought in by a side bar is still an article
    assert text(html) == "Not here\nCafé & co\nOne two\nthree <x> &am\na\nb"
    assert text(None) == text("") == "" and text("<article><p>cut off &am") == "cut off &am"


@pytest.mark.parametrize("inner, want", [
    ("<p>One <embed src=a> two</p><p>Three</p>", "One two\nThree"),
    ("<embed src=a><p>One</p>", "One"),
    ("<p>One <select><option>a<option>b</p><p>Two</p>", "One\nTwo"),
    ("<div>One <button>Go</div><p>Two</p>", "One\nTwo"),
    ("<p>One</p><select><option>a<p>Two</p>", "One\nTwo"),
    ("<p>One</p><svg><path><p>Two</p><object data=x><p>Three <button>b <svg></svg></p>", "One\nTwo\nThree"),
    ("<p>One <button><div>Icon</div>go</button> two</p><object><p>instead</p><object>x</object></object>Three", "One two\nThree"),
    ("<p>One<script>var a = '<p>no</p>'</script></p></select></button>Two", "One\nTwo")])
def test_silent_parts_end(inner, want):
    html = f"<body><div>Top</div><article>{inner}</article><article><p>Last</p></article><div>Foot</div>"
    assert text(html) == want + "\nLast"
    assert [t for t, zone in M.lines_of(html) if zone == M.OPEN] == ["Top", "Foot"]


def page(own, k, host="h.example.com", template=("Top menu", "Subscribe now"), wrap="div"):
    lines = "".join(f"<p>{t}</p>" for t in own)
    return k, f"https://{host}/a/{k:04d}?x={k}", f"<body><p>{template[0]}</p><{wrap}>{lines}</{wrap}><p>{template[1]}</p></body>"


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_shared_lines_go_wherever_the_sort_is_cut(spark, parts):
    data = [page([f"own {k}", f"more {k}"], k, f"h{k % 3}.example.com") for k in range(40)]
    data += [page(["alone"], 90, "single.example.com"), page(["declared"], 91, wrap="article"), page(["same"], 92), page(["same"], 93),
             (94, None, "<p>x</p>"), (95, "https://h.example.com/z", None), (96, "nonsense", ""), page(["own 3", "more 3"], 3, "h0.example.com")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("k", F.lit(1))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = M.main_texts(pages).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == len(data)
    got = {r.page_id: r for r in rows}
    for k in range(40):
        assert got[k].text == f"own {k}\nmore {k}" and got[k].n_shared == 2
    assert got[90].text == "Top menu\nalone\nSubscribe now"  # no other page of its host
    assert got[91].text == "declared"
    assert {got[92].text, got[93].text} <= {"same", "Top menu\nsame\nSubscribe now"} and "same" in got[93].text
    assert got[94].text == "x" and got[95].text == got[96].text == ""
    assert all(r.n_chars == len(r.text) for r in rows)
    assert M.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_shared_lines_decide_beside_declared_ones(spark, parts):
    host = "https://n.example.com"
    story = [f"A long story {k} that stands in a plain part of its page, with sentence after sentence." for k in range(4)]
    data = [(k, f"{host}/s/{k}", f"<body><p>Top</p><article>Card {k}</article><div><p>{t}</p><p>{t} On.</p></div><article>More {k}</article><p>Foot</p></body>")
            for k, t in enumerate(story)]
    # a line of the site inside main; one quoted by three pages of seven
    main = "https://m.example.com"
    data += [(10 + k, f"{main}/{k}", f"<main><p>Follow us</p><p>Own text {k}</p>{'<p>Quoted</p>' if k < 3 else ''}</main><p>Foot</p>") for k in range(7)]
    data += [(20, "https://c.example.com/1", "<p>Top</p><article class='post has-sidebar share comments'>Kept</article>"),
             (21, "https://c.example.com/2", "<p>Top</p><main id='notice'><p>Kept too</p><div class='share'>Mail</div></main>")]
    # copies that differ in marked lines, between pages that do not
    data += [(30 + k, f"https://d.example.com/b{k}", f"<nav>n{k}</nav><p>Top</p><p>Twice told</p><p>Foot</p>") for k in range(5)]
    data += [(40, "https://d.example.com/z", "<nav>n</nav><p>Top</p><p>Other</p><p>Foot</p>")]
    data += [(50 + k, "https://e.example.com/only", "<p>Top</p><p>All alike</p>" + f"<nav>n{k}</nav>") for k in range(2)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.page_id: r for r in M.main_texts(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, t in enumerate(story):
        assert got[k].text == f"Card {k}\n{t}\n{t} On.\nMore {k}" and got[k].n_shared == 2
    for k in range(7):
        assert got[10 + k].text == f"Own text {k}" + "\nQuoted" * (k < 3) and got[10 + k].n_shared == 2
    assert got[20].text == "Kept" and got[21].text == "Kept too" and got[21].n_marked == 1
    assert [got[30 + k].text for k in range(5)] == ["Twice told"] * 5 and got[40].text == "Other"
    assert [got[50 + k].text for k in range(2)] == ["Top\nAll alike"] * 2


def test_given_pages_keep_their_articles(spark, sf_dir):
    """By plain search: the article element, tag by tag."""
    import html
    import re

    rows = {r.page_id: r.text for r in queries.op2_main_text(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div|li|ul)>|<br>(?=<p>)", inner))
        assert rows[p.page_id] == "\n".join(b for b in parts if b)


def test_url_keys(spark):
    urls = ["HTTPS://user@A.b.Example.com:8080/x//y/z?q#f", "http://h.com", "ftp://h/#a", "nonsense", "", None, "http:///p"]
    got = [r.k for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.keys_of(F.col("u")).alias("k")).collect()]
    assert sorted(got[0]) == ["d:a.b.example.com", "d:b.example.com", "d:com", "d:example.com",
                              "p:a.b.example.com/x", "p:a.b.example.com/x/y", "p:a.b.example.com/x/y/z"]
    assert sorted(got[1]) == ["d:com", "d:h.com"] and got[2] == ["d:h"]
    assert got[3] == got[4] == got[5] == got[6] == []


def plain(captures, entries):
    """By day: which entries are on, and the most specific of them."""
    out = []
    for url, day, keys in captures:
        active = []
        for name, key in {(e[0], e[1]) for e in entries if None not in e}:
            past = [(d, on) for n, k, d, on in entries if (n, k) == (name, key) and None not in (d, on) and day and d <= day]
            last = max((d for d, _ in past), default=None)
            if past and all(on for d, on in past if d == last) and key in keys:
                active.append((-len(key), name == "allow", name, key))
        best = min(active, default=None)
        out.append((url, day, bool(best and not best[1]), best and best[3], best and best[2], len(active)))
    return out


def test_lists_as_of_the_fetch(spark):
    r = random.Random(8)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org"]
    start = date(2023, 11, 20)
    keys = ["d:a.x.com", "d:x.com", "d:com", "p:a.x.com/p", "p:a.x.com/p/q", "d:y.org", "p:y.org/p"]
    entries = [(r.choice(["bad", "allow", "worse"]), r.choice(keys), start + timedelta(r.randrange(900)), r.random() < 0.6) for _ in range(120)]
    entries += [entries[0], (None, "d:x.com", start, True), ("bad", None, start, True), ("bad", "d:com", None, True), ("bad", "d:com", start, None)]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/p', '/p/q/r', '/z'])}" for _ in range(200)] + [None, "nonsense", "http://a.x.com/p"]
    data = [(i, u, None if i == 5 else start + timedelta(r.randrange(900))) for i, u in enumerate(urls)] + [(0, urls[0], None)]
    captures = spark.createDataFrame(data, "key long, url string, fetched date").withColumn("n", F.lit(1)).withColumn("month", F.lit(2))
    got = U.evaluate(captures, spark.createDataFrame(entries, "list string, key string, day date, listed boolean"))
    assert got.columns == [*captures.columns, "blocked", "decided_by", "decided_list", "n_active"]
    own = {(x.key, x.url, x.fetched): set(x.ks) for x in captures.withColumn("ks", U.keys_of(F.col("url"))).collect()}
    want = plain([(u, d, own[i, u, d]) for i, u, d in data], entries)
    assert sorted(map(repr, (tuple(x[1:3]) + tuple(x[5:]) for x in got.collect()))) == sorted(map(repr, want))
    assert U.evaluate(captures.limit(0), spark.createDataFrame(entries, "list string, key string, day date, listed boolean")).count() == 0
    none = U.evaluate(captures, spark.createDataFrame([], "list string, key string, day date, listed boolean"))
    assert none.filter("NOT blocked AND n_active = 0 AND decided_by IS NULL").count() == len(data)
