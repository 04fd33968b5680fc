from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib

import numpy as np
import pytest
import zstandard
from helpers import WORD, awkward, frame, prose
from knnscore.llm import decontamination, html_text, quality_classifier, quality_rules
from knnscore.llm.queries import QUERIES
from knnscore.llm.shingles import WordHashes, shingle_hashes


def counts(text):
    """Base counts, the slow way."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = (text or "").split("\n")
    duplicate = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), duplicate, len(covered)


@pytest.mark.parametrize("text", [None, "", "a b c a b c", "x y x y x y x", "a\na\n \n \nb", "# * $ %%", prose(2, 200) + "\n" + prose(2, 60), "  x y"])
def test_base_counts(text):
    assert quality_rules.base_counts(text) == counts(text)


def test_bands_reject_repetition_and_noise(spark):
    noise = "".join(chr(33 + zlib.crc32(str(i).encode()) % 90) + " " * (i % 7 == 6) for i in range(6000))
    rows = [(1, prose(1, 900)), (2, " ".join(f"{w} {w} {w} x" for w in prose(3, 30).split()) * 9), (3, noise), (4, "few words"), (5, "=-" * 3000 + prose(1, 60))]
    got = {r.doc_id: r for r in quality_rules.rule(frame(spark, rows)).collect()}
    assert [i for i, r in sorted(got.items()) if r.kept] == [1]
    assert got[4].base_failed and got[2].base_failed and not got[3].base_failed and not got[5].base_failed
    assert got[1].ratio == pytest.approx(len(rows[0][1].encode()) / len(zstandard.ZstdCompressor(level=3).compress(rows[0][1].encode())))


def test_quality_rules_on_awkward_tables(spark):
    docs = frame(spark, awkward())
    assert quality_rules.rule(docs).count() == len(awkward())
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and {4, 5, 6} <= {r.doc_id for r in kept.collect()}
    assert quality_rules.rule(docs.limit(0)).count() == 0


def brute_leaks(rows, items):
    def grams(text, size):
        words = WORD.findall((text or "").lower())
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    out = set()
    for item, text in items:
        size = min(5, len(WORD.findall((text or "").lower())))
        own = grams(text, size) if size else set()
        out |= {(doc, item) for doc, t in rows if own and len(own & grams(t, size)) >= 0.8 * len(own)}
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    items = [(k, prose(1000 + k, 15 + 7 * k)) for k in range(8)] + [(50, "three little words"), (51, ""), (52, None), (53, prose(1000, 15))]
    rows = [*awkward(), *((200 + k, prose(k, 4000) + " " + items[k][1].upper().replace(" ", ", ") + "\n" + prose(k + 7, 90)) for k in range(8))]
    for k in range(8):  # some words changed: at and below the threshold
        words = items[k][1].split()
        for cut in (2, 4, 9):
            rows.append((300 + 10 * k + cut, prose(k, 50) + " " + " ".join(words[:-cut]) + " " + prose(k, 30)))
    rows.append((900, "so THREE little-words here"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(rows, items)
    assert len(expected) > 12
    found = lambda: {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, rows), benchmark).collect()}
    assert found() == expected
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 900)  # several passes
    assert found() == expected
    kept = decontamination.drop_leaks(frame(spark, rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontamination.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontamination.find_leaks(frame(spark, rows), benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("words", [19, 259, 4099])
def test_items_are_found_without_their_least_hashes(spark, words):
    """Sizes whose allowed number of missing shingles is whole (3 of 15, 51 of 255, 819 of 4095) and comes out lower in floating point."""
    item = [f"word{k}" for k in range(words)]
    n = words - 4
    own = shingle_hashes(WordHashes().of([" ".join(item)])[0], 5)
    least = set(np.argsort(own)[: n // 5].tolist())
    text = " ; ".join(" ".join([f"other{k}", *item[k : k + 5]]) for k in range(n) if k not in least)  # each shingle but the n / 5 of least hash
    got = decontamination.find_leaks(frame(spark, [(1, text)]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got] == [(1, 7, n, n - n // 5)]


def test_classifier_on_small_tables(spark):
    good = [(i, prose(i, 60 + i)) for i in range(0, 120)]
    bad = [(i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(120, 180)]
    docs = frame(spark, [*good, *bad, *[(i and i + 1000, t) for i, t in awkward()]])
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(180)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 180]
    assert sum(r.predicted == int(r.doc_id < 120) for r in held) >= 0.95 * len(held)
    nobody = quality_classifier.fit(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, nobody).collect()} == {0.5}
    one = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert {r.predicted for r in quality_classifier.score(docs, one).collect()} == {1}


def plain_statistics(text):
    """The statistics of a text in plain Python."""
    text = text or ""
    space = "[^ \\t\\n\\x0b\\f\\r]+"
    words, chars = len(re.findall(space, text)), len(text)
    held = lambda letters: sum(c in letters for c in text)
    lines, own = text.split("\n"), re.split("[ \\t\\n\\x0b\\f\\r]+", text.lower())
    over = lambda a, b: a / max(b, 1)
    return {
        "log_words": math.log1p(words),
        "word_length": over(chars, words),
        "upper_share": over(sum(unicodedata.category(c) == "Lu" for c in text), chars),
        "symbol_share": over(held("#*$%&|<>{}[]\\^~_=+@"), chars),
        "digit_share": over(held("0123456789"), chars),
        "mark_share": over(held(".,;:!?"), words),
        "bang_share": over(held("!"), words),
        "bar_share": over(held("|"), words),
        "line_words": over(words, len(lines)),
        "own_line_share": over(len(set(lines)), len(lines)),
        "own_word_share": over(len(set(own)), words),
    }


def test_scores_equal_rules_in_plain_python(spark):
    """Every rule of the fitted ensemble, row by row, against the column expressions."""
    good = [(i, prose(i, 40 + i % 50)) for i in range(90)]
    bad = [(i, (prose(i, 30) + "\n") * 2 + "BUY | NOW!! " * (i % 9)) for i in range(90, 170)]
    docs = frame(spark, [*good, *bad, *[(i and i + 1000, t) for i, t in awkward()]])
    labels = spark.createDataFrame([(i, int(i < 90)) for i in range(170)], "doc_id long, quality int")
    ensemble = quality_classifier.fit(docs, labels)
    assert len(ensemble.rules) > 2
    texts = {i: t for i, t in [*good, *bad, *[(i and i + 1000, t) for i, t in awkward()]]}
    seen = set()
    for r in quality_classifier.score(docs, ensemble).collect():
        values, total = plain_statistics(texts[r.doc_id]), ensemble.intercept
        for n, (rule, weight) in enumerate(ensemble.rules):
            holds = all(values[name] > bound if above else values[name] <= bound for name, above, bound in rule.terms)
            seen.add((n, holds))
            total += weight * holds
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9), r.doc_id
        assert r.predicted == int(r.score >= 0.5)
    assert len(seen) > len(ensemble.rules)  # rules that hold and that don't
    assert quality_classifier.score(docs.limit(0), ensemble).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifier_orders_held_out_documents(spark):
    scores = QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.01")
    held = scores.where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="ad">Buy &amp; save</div><div id="cookie-notice">We use cookies</div>
{body}<aside class="sidebar"><p>Elsewhere</p></aside><section class="comments"><div class=comment><p>First! I think this is a long reader comment that goes on and on.</p></div></section>
<form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; 2024</footer>"""
TEXT = "<h2>Head &lt;1&gt;</h2><p>One <b>bo</b>ld\n  word &amp; more<br>line two of the paragraph, with some length to it.<p>Two&nbsp;is an unclosed paragraph, also long enough to count.<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"
EXPECTED = "Head <1> One bold word & more line two of the paragraph, with some length to it. Two is an unclosed paragraph, also long enough to count. a b c d"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "<article>{}"])
def test_main_text(around):
    page = PAGE.format(body=around.format(TEXT + ("</article>" if around == "<article>{}" else "")))
    assert html_text.main_text(page) == EXPECTED


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ('<div class="post-header"><h1>Title</h1><p>Lead of it.</p></div><p>Body.</p>', "Title Lead of it. Body."),
        ('<p class="share-price">The price rose.</p><p>Body.</p>', "The price rose. Body."),
        ("<p>As <math><mi>x</mi></math> grows, so does y.</p>", "As x grows, so does y."),
        ('<header><h1>Title</h1></header><p>Body.</p><div class="related-posts"><p>More</p></div><div class="comments">No!</div><aside>Box</aside><form>Mail</form>', "Title Body."),
        ('<section class="notice-of-rights"><p>Rights.</p></section><ul class="social"><li>Post</ul>', "Rights."),
    ],
)
def test_only_whole_boxes_go_from_an_article(inner, expected):
    assert html_text.main_text(PAGE.format(body=f"<article>{inner}</article>")) == expected


def test_lines_are_clustered_where_no_element_holds_the_text():
    long = "A paragraph of the text that is long enough to stand out from the links around it, as paragraphs do."
    links = "".join(f"<p><a href=/{k}>Link {k}</a>" for k in range(8))
    page = f"<html><body>{links}<h1>Title</h1><p>{long}<p>{long}<p>Short.<p>{long}{links}</body></html>"
    assert html_text.main_text(page) == f"Title {long} {long} Short. {long}"


def test_nested_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert html_text.main_text("<div><p>word text</p>" * 20_000).startswith("word text word text")
    assert html_text.main_text("<b>" * 20_000 + "x" + "</i></b>" * 20_000) == "x"
    assert time.perf_counter() - began < 5


def test_pages_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", PAGE.format(body=f"<article>{TEXT}</article>")), (4, "u", "<b>plain"), (5, "u", "<<<>&#x;</a></p>" * 3), (6, "u", "<article><p>x</article>" + "<div>" * 3000)]
    got = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got if r.page_id < 5) == [(1, 0), (2, 0), (3, 0), (4, 5), (4, len(EXPECTED))]
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 7
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_articles_of_the_test_pages(spark):
    """The generated pages hold one article without parts to leave out; tags stripped by pattern are the brute force."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in QUERIES["op10_html_text"](spark, "/root/testdata/sf0.01").collect():
        inner = re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1])
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())


PARAGRAPH = "<p>" + "A long paragraph of the text itself, with many words in it. " * 6 + "</p>"


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="post has-sidebar">%s</div>', '<div class="site header-fixed"><main>%s</main></div>', '<div class="layout with-sidebar"><article>%s</article></div>', '<form id="form1">%s</form>',
        '<div class="elementor-widget elementor-widget-text">%s</div>', '<div class="widget">%s</div>', '<div class="sidebar"><article>%s</article></div>', '<div id="header"><div class="x">%s</div></div>', "<div>%s</div>",
    ],
)
def test_wrappers_do_not_take_the_text_along(wrapper):
    page = '<html><body><nav><a href="/">Home</a> <a href="/a">About us</a></nav>' + wrapper % (PARAGRAPH * 2) + '<div class="sidebar"><p>Other stories</p></div><footer>Imprint</footer></body></html>'
    assert html_text.main_text(page) == " ".join([re.sub("<.*?>", "", PARAGRAPH).strip()] * 2)


def test_what_is_beside_the_text_goes():
    text = re.sub("<.*?>", "", PARAGRAPH).strip()
    comments = "<html><body><div class='post'>" + PARAGRAPH + "</div><div class='comments-area'>" + PARAGRAPH * 12 + "</div></body></html>"
    assert html_text.main_text(comments) == text
    cards = "<html><body>" + "".join(f"<article class=card><a href=x>Story {i}</a></article>" for i in range(5)) + "<div class=post>" + PARAGRAPH * 3 + "</div></body></html>"
    assert html_text.main_text(cards) == " ".join([text] * 3)  # the articles are cards, the cluster is elsewhere
    for name in ("site-header", "mainMenu_nope menu", "ad", "top-banner", "cookie-notice", "nav-menu", "related-posts", "share_buttons", "sidebar-1"):
        assert html_text.main_text(f'<body><div class="{name}"><p>Something else here</p></div><div class="story">{PARAGRAPH}</div></body>') == text


@pytest.mark.parametrize("mark", ['<b x="', "<!-- ", "<![x", "<a ", "</", "<?", "&#", '<b x=">', "<b x='>\" "])
def test_broken_markup_is_read_in_linear_time(mark):
    import time

    start = time.perf_counter()
    for end in ("", "<p>end of text</p>"):
        assert html_text.main_text("<p>start of text here " + mark * 30_000 + end)
    assert time.perf_counter() - start < 4
    assert html_text.main_text("<![foo]>hello <p>x") == "hello x" and html_text.main_text("a < b and c > d") == "a < b and c > d"


def test_empty_tables_give_no_row(spark):
    none = frame(spark, [])
    assert quality_rules.rule(none).collect() == [] and quality_rules.keep(none).collect() == []
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    assert decontamination.find_leaks(none, items).collect() == [] and decontamination.find_leaks(frame(spark, [(1, prose(1, 30))]), items.limit(0)).collect() == []
    twice = items.union(spark.createDataFrame([(2, prose(1, 30))], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(frame(spark, [(1, prose(2, 40_000) + " " + prose(1, 30))]), twice).collect()) == [(1, 1), (1, 2)]


def verdict(text):
    """The bands restated: the whole text and each 4,096-byte chunk against the limits of their length."""
    bands, data = quality_rules.Bands(), text.encode()
    ratio = lambda x: len(x) / len(zstandard.ZstdCompressor(level=3).compress(x))

    def fits(x, table):
        low, high = [(lo, hi) for least, lo, hi in table if len(x) >= least][-1]
        return low <= ratio(x) <= high

    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    bad = sum(len(c) for c in chunks if not fits(c, bands.chunk))
    n_words, _, _, _, repeated = counts(text)
    return n_words >= 50 and 100 * repeated <= 50 * n_words and fits(data, bands.document) and 2 * bad <= len(data)


def test_kept_equals_a_restatement(spark):
    noise = "".join(chr(33 + zlib.crc32(str(i).encode()) % 90) + " " * (i % 7 == 6) for i in range(9000))
    texts = [prose(s, n) for s, n in enumerate((60, 120, 400, 900, 2000))] + [prose(9, 900) + noise[:n] for n in (500, 3000, 9000)]
    texts += [prose(7, 300) + " ".join(f"item {i} of the list" for i in range(n)) for n in (20, 200, 900)] + ["ab " * 60, noise]
    got = {r.doc_id: r.kept for r in quality_rules.rule(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: verdict(t) for i, t in enumerate(texts)} and len(set(got.values())) == 2
