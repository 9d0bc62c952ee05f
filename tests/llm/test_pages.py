"""URL rules and main-text extraction against plain re-computation."""

import html
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import html_text, url_rules
from fleetgauge.llm.queries import QUERIES, URL_RULES

from .brute import SF

URLS = [None, "", "no scheme/x", "http://A.Example.ORG", "https://example.org/es/x?y", "https://x.example.org/en/1", "ftp://org/a#b",
        "https://badexample.org/es/", "https://a.com/fr/1", "https://com/de/", "https://a.b.com/de/2?q=/fr/", "x://h?p=1#/org/", "http://ÄB.com/DE/",
        "https://site.example.com:80/en/7", "a://b://org/x", "https://a.com/fr/1"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match("[^?#]*", rest[len(host):])[0]


def longest(host, path):
    fits = [(len(r), r, v) for r, v in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def tokens(spark, urls):
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    return [set(r[0]) for r in rows.select(url_rules.url_tokens(F.col("url"))).collect()]


def test_explicit_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, None, None)], "page_id bigint, url string, host string")
    labelled = spark.createDataFrame([], "url string, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, labelled, URL_RULES).collect()}
    assert got == {i: (*split(u), longest(*split(u))[0], longest(*split(u))[1] or "allow") for i, u in [*enumerate(URLS), (None, None)]}
    assert url_rules.judge_urls(pages.where("false"), labelled, URL_RULES).count() == 0


def test_mined_rules_block_what_they_match(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labelled = pages.select("url", (F.col("url").contains("utm_source") & F.col("url").contains("/en/")).alias("blocked"))
    labelled = labelled.union(labelled.limit(0)).union(spark.createDataFrame([("http://a/b", None)], "url string, blocked boolean"))
    rules = {(tuple(r["antecedent"]), round(r["confidence"], 9)) for r in url_rules.mine_rules(labelled, 0.05, 0.9).collect()}
    rows = [(set(t), r["blocked"]) for t, r in zip(tokens(spark, [r["url"] for r in labelled.collect()]), labelled.collect()) if r["blocked"] is not None]
    assert (("path:en", "query:utm_source=feed"), 1.0) in rules
    for antecedent, confidence in rules:
        held = [b for t, b in rows if set(antecedent) <= t]
        assert round(sum(held) / len(held), 9) == confidence >= 0.9 and sum(held) >= 0.05 * len(rows)
        assert not any(set(a) < set(antecedent) and c >= confidence for a, c in rules)
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(pages, labelled, [], 0.05, 0.9).collect()}
    found = pages.select("page_id", "url").collect()
    want = {r["page_id"]: "block" if any(set(a) <= t for a, _ in rules) else "allow" for r, t in zip(found, tokens(spark, [r["url"] for r in found]))}
    assert got == want


def test_rules_of_more_than_four_tokens_block(spark):
    tags = [f"t{i}" for i in range(6)]
    urls = [("http://h/p?" + "&".join(tags), True)] * 10
    urls += [("http://h/p?" + "&".join(t for t in tags if t != missing), False) for missing in tags for _ in range(12)]
    urls += [("http://h/q?u", True)] * 3 + [("http://h/q?u&v", False)] * 2
    labelled = spark.createDataFrame(urls, "url string, blocked boolean")
    found = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine_rules(labelled, 0.02, 0.5).collect()}
    assert found == {tuple(f"query:{t}" for t in tags): 1.0, ("path:q",): 0.6, ("query:u",): 0.6}
    pages = spark.createDataFrame(list(enumerate(sorted({u for u, _ in urls}))), "page_id bigint, url string")
    blocked = {r["page_id"] for r in url_rules.judge_urls(pages, labelled, [], 0.02, 0.5).where("verdict = 'block'").collect()}
    assert blocked == {i for i, u in enumerate(sorted({u for u, _ in urls})) if "?u" in u or all(t in u for t in tags)}


def article(source):
    """The expected text of the tables' pages, whose articles hold only h1, p, b and br."""
    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_table(spark):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op2_html_text"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == article(rows[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == rows[r["page_id"]]["url"]


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b &amp; c&nbsp;d<br>e", "a\nb & c d e"),
    ("<body><header>h</header><main><header><h1>T</h1></header><p>x <i>y</i>z</p><aside>s</aside><form>f</form></main><footer>f</footer>", "T\nx yz"),
    ("<article><p>one</p><div class='share-bar'>no</div><section id=comments><p>no</p></section><ul><li>l<li>m</ul></article><p>out", "one\nl\nm"),
    ("<style>p{}</style><script>var t='</p>';</script><!-- <p>no --><p>yes</p><script>never closed <p>no", "yes"),
    ("<div class=\"cookie notice\">c</div><nav><ul><li>n</nav><div>text <b>bold<p>next</div><div role=search>q</div>", "text bold\nnext"),
    ("<p title='a > b'>kept</p> 1 < 2 <p>tail<", "kept\n1 < 2\ntail<"),
    ("<article>cut off <p>here", "cut off\nhere"), ("<p>" + "w " * 50000, ("w " * 50000).strip()),
])
def test_structure(source, text):
    assert html_text.main_texts([html_text.page_blocks(source or "")]) == [text]


def test_repeated_runs_are_those_of_brute_force():
    streams = [list("abcdefghXY"), list("ZZabcdefghQ"), list("qabcdefgh"), list("abcdefg"), [], list("hhhhhhhhhhhhhh")]
    got = html_text.repeated_runs(streams, 8, 3)
    for s, marks in zip(streams, got):
        want = [False] * len(s)
        for i in range(len(s) - 7):
            if sum(any(t[j:j + 8] == s[i:i + 8] for j in range(len(t) - 7)) for t in streams) >= 3:
                want[i:i + 8] = [True] * 8
        assert marks.tolist() == want


def test_boilerplate_without_an_article_goes_and_unique_text_stays(spark):
    pages = [(i, "http://h.org/x", f"<div>{'all pages of this site share this long line'}</div><div>unique {i} words</div>", "extra") for i in range(600)]
    rows = spark.createDataFrame([*pages, (None, None, None, None)], "page_id bigint, url string, html string, host string")
    for chunk in (256, 8):
        got = {r["page_id"]: r["text"] for r in html_text.extract_text(rows, chunk, 4).collect()}
        assert got == {**{i: f"unique {i} words" for i in range(600)}, None: ""}
    assert html_text.extract_text(rows.where("false")).count() == 0


def test_a_line_on_few_pages_of_a_large_host_goes(spark):
    line, twice = "a notice that only a few of the pages show", "this longer line is on two of the pages only"
    pages = []
    for i in range(3000):
        more = f"<div>{line}</div>" if i % 1000 == 7 else f"<div>{twice}</div>" if i in (50, 2500) else ""
        pages.append((i, f"http://h.org/{i}", f"<div>unique {i} words</div>{more}"))
    pages += [(5000, "http://other.org/", f"<div>{line}</div>"), (5001, "http://h.org/x", f"<article>{line}</article>")]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    want = {i: f"unique {i} words" + (f"\n{twice}" if i in (50, 2500) else "") for i in range(3000)} | {5000: line, 5001: line}
    assert {r["page_id"]: r["text"] for r in html_text.extract_text(rows).collect()} == want


def test_whole_hosts_give_what_all_pages_together_give(spark):
    pages = [r["html"].replace("article>", "div>").replace("main>", "div>") for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(rows).collect()}
    assert got == dict(enumerate(html_text.main_texts([html_text.page_blocks(p) for p in pages])))


def test_the_suffix_array_brings_repeated_runs_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = "one two three four five six seven eight nine ten"
    pages = [(i, f"http://h{i % 2}.org/", f"<div>{' '.join(f'w{k}' for k in rng.integers(0, 4, 30))}</div><div>{line if i % 5 else i}</div>") for i in range(200)]
    pages += [(i, p[1], p[2].replace("div", "article")) for i, p in enumerate(pages[:40], 200)]
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(7)
    want = {}
    for host in ("http://h0.org/", "http://h1.org/"):
        mine = [p for p in pages if p[1] == host]
        want |= {p[0]: t for p, t in zip(mine, html_text.main_texts([html_text.page_blocks(p[2]) for p in mine]))}
    found = html_text.extract_text(rows)
    assert "key" in found._jdf.queryExecution().optimizedPlan().toString() and "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["page_id"]: r["text"] for r in found.collect()} == want
    keys = [(bytes(k), uid, 0, uid % 2 == 0) for k, n in ((b"a", 2), (b"b", 5), (b"c", 1)) for uid in range(n)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["key", "uid", "place", "bare"])
    for cut in range(1, len(keys)):
        got = [r for b in html_text.repeated_neighbours(iter([batch(keys[:cut]), batch(keys[cut:])]), 3) for r in b.to_pylist()]
        assert [r["uid"] for r in got] == [0, 2, 4]


def furnished(tag):
    """200 pages of two hosts: a line of the site, a repeated or short line and words of a small vocabulary in ``tag``."""
    rng = np.random.default_rng(5)
    line, more = "one two three four five six seven eight nine ten", "this line is seen on few of the pages only"
    return [(i, f"http://h{i % 2}.org/{i}", f"<div>{line if i % 5 else i}</div><{tag}>{' '.join(f'w{k}' for k in rng.integers(0, 3, 40))}</{tag}>"
             f"<{tag}>{more if i % 60 < 2 else 'short'}</{tag}>" if i % 50 else None) for i in range(200)]


def test_pages_with_an_article_go_through_the_suffix_array(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PORTION", 3000)
    pages = furnished("article")
    rows = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    blocks = {p[0]: html_text.page_blocks(p[2] or "") for p in pages}
    found = html_text.extract_text(rows)
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert got == {i: "\n".join(b.text for b in blocks[i] if b.main) for i in blocks}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "rangepartitioning(key" in plan and plan.count("ReusedExchange") == 2      # parsed once
    parsed = html_text.parsed_portions(rows, 256)
    assert parsed.count() > 3
    marks = {}
    for r in parsed.join(html_text.repeated_suffixes(parsed, 40_000, 3, 8), "portion", "left").collect():
        part = pa.ipc.open_stream(bytes(r["pages"])).read_all()
        suffixes = html_text.suffixes_of(part["host"].to_pylist(), part["texts"].combine_chunks(), 8)
        marks |= dict(zip(part["page_id"].to_pylist(), html_text.covered_tokens(suffixes, np.array(r["runs"] or [], np.int64))))
    for host in range(2):
        mine = range(host, 200, 2)
        for i, want in zip(mine, html_text.repeated_runs([[w for b in blocks[i] for w in b.text.split()] for i in mine], 8, 3)):
            assert marks[i].tolist() == want.tolist()
    assert sum(m.any() for m in marks.values()) > 150


@pytest.mark.parametrize("least, length", [(1, 1), (2, 2), (3, 8), (40, 8), (3, 11)])
def test_portions_give_what_whole_hosts_give(spark, monkeypatch, least, length):
    monkeypatch.setattr(html_text, "PORTION", 3000)
    pages = furnished("div")
    rows = spark.createDataFrame([*pages, *pages[1:3]], "page_id bigint, url string, html string").repartition(3)
    want = []
    for host in range(2):
        mine = [p for p in [*pages, *pages[1:3]] if p[0] % 2 == host]
        parsed = [html_text.page_blocks(p[2] or "") for p in mine]
        streams = [[w for b in blocks for w in b.text.split()] for blocks in parsed]
        runs = [{tuple(s[j:j + length]) for j in range(len(s) - length + 1)} for s in streams]
        for p, s, blocks in zip(mine, streams, parsed):
            marked = np.zeros(len(s), bool)
            for j in range(len(s) - length + 1):
                if sum(tuple(s[j:j + length]) in r for r in runs) >= least:
                    marked[j:j + length] = True
            want.append((p[0], html_text.page_text(blocks, marked)))
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract_text(rows, 16, least, length).collect()) == sorted(want)


def test_pages_without_words(spark):
    rows = spark.createDataFrame([(1, "http://h/", None), (2, None, ""), (None, "http://h/", "<p> </p>"), (3, "x", "<article><br></article>")], "page_id bigint, url string, html string")
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(rows).collect()} == dict.fromkeys([1, 2, None, 3], ("", 0))


def test_packed_numbers_are_read_back():
    rng = np.random.default_rng(2)
    for bits in (1, 5, 8, 20, 44):
        for n in (1, 2, 7, 8, 3000):
            numbers = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64))
            assert html_text.unpack(html_text.pack(numbers, bits), bits).tolist() == numbers.tolist()


def test_marks_of_enough_pages_are_found():
    sent = [(0, 1, [3, 3, 9]), (0, 2, [9]), (0, 3, [3, 5]), (4, 2, [3, 3]), (4, 3, [7, 7, 7])]
    rows = [(n, portion, html_text.pack(np.array(marks, np.uint64), 8)) for n, portion, marks in sent]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], names=["range", "portion", "marks"])
    for cut in range(1, len(rows)):
        got = [r for b in html_text.shared_marks(iter([batch(rows[:cut]), batch(rows[cut:])]), 8, 3) for r in b.to_pylist()]
        assert [(r["range"], r["portion"], html_text.unpack(r["marks"], 8).tolist()) for r in got] == [(0, 1, [3]), (0, 3, [3]), (4, 3, [7])]
