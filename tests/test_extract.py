"""Articles of pages that publishers write in different ways."""

import datetime as dt
import json

import pytest

from lodestream.sources import extract as X

TODAY = dt.date(2026, 9, 20)
P = [f"Paragraph number {k} says that growth slowed as exports fell and households saved." for k in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in P[:4])


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


def get(body, head="", url="https://h.example/a/b"):
    return X.extract(page(body, head), url, TODAY)


@pytest.mark.parametrize(("head", "body", "want"), [
    ('<meta property="og:title" content="Rates stay high"><title>Other | Site</title>', "<h1>Heading</h1>", "Rates stay high"), ('<meta property="og:title" content="rates-stay-high-2026">', "<h1>Rates stay high</h1>", "Rates stay high"),
    ("<title>Rates stay high | The Bank</title>", "", "Rates stay high"), ("<title>Review - August 2026</title>", "<h1>Review - August 2026</h1>", "Review - August 2026"), ("<title>T</title>", "", "T"), ("", "", ""),
    ('<script type="application/ld+json">{"@type": "Article", "headline": "From data - x", "articleBody": "b"}</script><title>From title</title>', "", "From data - x"),
])
def test_titles(head, body, want):
    assert get(body, head)["title"] == want


def test_densest_container_and_frame():
    menu = "<nav><p>" + "menu entry that is long enough to count as text " * 9 + "</p></nav>"
    got = get(f"{menu}<div class='page-content'><p>{P[7]}</p><article>{BODY}<h2>Outlook</h2><p>{P[4]}<p>{P[5]}<ul><li>Hike<li><p>{P[6]}</p></li></ul><p>short</p></article></div><div class='post'><p>{P[0]}</p></div>")
    assert got["sections"] == [(None, "\n\n".join(P[:4])), ("Outlook", "\n\n".join([P[4], P[5], "• Hike", P[6]]))]


def test_tables_and_figures_stand_behind_sections():
    table = "<table><caption>Rates</caption><tr><td>Bank<td colspan=2>Rate<tr><td>A<td>1.5<td>2</table>"
    layout = f"<table><tr><td><p>{P[5]}</p></td></tr></table>"
    pics = "<figure><img data-src='/x.png'><figcaption>Chart 1</figcaption></figure><img src='/x.png'><img src='data:x'><img src='y.svg'><div class='author-bio'><img src='/me.png'></div><img srcset='a.png 1x, b.png 2x'>"
    got = get(f"<main><h2>One</h2>{BODY}{table}<h2>Two</h2>{pics}<p>{P[4]}</p>{layout}<table><thead><tr><td>1</td><td>2</td></tr></thead><tr><td>3<td>4</table></main>")
    assert [s[0] for s in got["sections"]] == ["One", "Two"] and got["sections"][1][1] == f"{P[4]}\n\n{P[5]}"
    assert got["tables"] == [(0, "Rates", True, [["Bank", "Rate", "Rate"], ["A", "1.5", "2"]]), (1, None, True, [["1", "2"], ["3", "4"]])]
    assert got["figures"] == [(0, "https://h.example/x.png", "Chart 1"), (0, "https://h.example/a/b.png", None)]


@pytest.mark.parametrize(("rows", "want"), [
    ("<tr><td>a<td>b<tr><td>c<td>d", False), ("<tr><td>a<td>b<tr><td>c<td>4", True), ("<tr><td>a<td>2026<tr><td>c<td>4", False), ("<tr><th>a<th>2<tr><td>c<td>4", True), ("<tr><td><td>b<tr><td>c<td>4", False),
    ("<tr><td>a<td>b", None), ("<tr><td>a<tr><td>b<tr><td>c", None), ("<tr><td>a<td><tr><td><td>b", None),
])
def test_headings_of_tables(rows, want):
    grid = X.data_table(X.parse(f"<table>{rows}</table>").find("table")[0])
    assert (grid and grid[1]) is want


def test_fallbacks():
    data = json.dumps({"@graph": [{"@type": "NewsArticle", "articleBody": "\n\n".join(P), "author": [{"name": "A. Writer"}], "datePublished": "2026-09-02"}]})
    got = get("<p>too short</p>", f'<script type="application/ld+json">{data}</script><script type="application/ld+json">{{broken</script>')
    assert got["sections"] == [(None, "\n\n".join(P))] and got["author"] == "A. Writer" and got["published"] == dt.date(2026, 9, 2)
    assert get(f"<p>{P[0]}</p><p>{P[1]}</p>")["sections"] == [(None, f"{P[0]}\n\n{P[1]}")]
    assert get("<main><div>" + " ".join(P * 2) + "</div></main>")["sections"] == [(None, " ".join(P * 2))]
    assert get("<main><div>" + P[0] + "</div></main>")["sections"] == []
    for nothing in (None, "", "<", "</p></table>", "<table><tr><table>"):
        assert X.extract(nothing, None, TODAY)["sections"] == []


@pytest.mark.parametrize(("head", "body", "want"), [
    ('<meta property="article:published_time" content="2026-09-02T10:00:00Z">', "<time datetime='2026-01-01'>x</time>", (2026, 9, 2)), ("", "<time datetime='2026-01-05'>x</time>", (2026, 1, 5)), ("", "<span class='publish-date'>2 September 2026</span>", (2026, 9, 2)),
    ('<meta name="date" content="2027-01-01">', "", None), ("", f"<h1>Outlook (Aug 2026)</h1><main>{BODY}</main>", (2026, 8, 1)), ("", "", None),
])
def test_dates_of_pages(head, body, want):
    assert get(body, head)["published"] == (want and dt.date(*want))


def test_disclaimer_ends_the_article():
    got = get(f"<article>{BODY}<h3>Important information</h3><p>For informational purposes only, not an offer to anyone at all.</p><table><tr><td>a<td>1<tr><td>b<td>2</table></article>")
    assert len(got["sections"]) == 1 and got["disclaimer"].startswith("For informational") and got["tables"][0][0] == 0


def test_articles_of_rows(spark):
    df = spark.createDataFrame([(1, page(f"<article>{BODY}</article>", "<title>T</title>"), "https://h/x"), (2, None, None)], "page_id long, html string, url string")
    got = {r.page_id: r for r in X.articles(df, "page_id", "html", "url", TODAY).collect()}
    assert got[1].title == "T" and got[1].sections[0].text == "\n\n".join(P[:4]) and got[2].sections == [] and got[2].title == ""
