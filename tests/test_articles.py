"""Parts, dates, disclaimers and blocks on free text."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.operators import articles as A

TODAY = dt.date(2026, 9, 20)


@given(st.text("ab\n ", max_size=120), st.integers(3, 20))
@settings(max_examples=400, deadline=None)
def test_parts_are_within_the_limit_and_rebuild(text, most):
    cut = A.spans(text, most)
    assert all(b - a <= most for a, b in cut) and all(x[1] <= y[0] for x, y in zip(cut, cut[1:], strict=False))
    if len(text) > most:
        at, between = 0, []
        for a, b in cut:
            between.append(text[at:a])
            at = b
        assert all(re.fullmatch(r"(\n\s*\n)*", g) or g.strip() == "" for g in [*between, text[at:]])
    assert "".join(text[a:b] for a, b in cut).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")


@given(st.lists(st.integers(0, 12), max_size=30), st.integers(10, 15))
@settings(max_examples=200, deadline=None)
def test_batches_are_full(sizes, most):
    batch = A.packed(sizes, most)
    sums = {}
    for size, b in zip(sizes, batch, strict=True):
        sums[b] = sums.get(b, 0) + size
    assert all(s <= most or batch.count(b) == 1 for b, s in sums.items()) and batch == sorted(batch)
    for k in range(1, len(sizes)):
        if batch[k] != batch[k - 1]:
            assert sum(s for s, b in zip(sizes[:k], batch, strict=False) if b == batch[k - 1]) + sizes[k] > most


def test_paragraphs_stay_whole_where_they_fit():
    text = "a" * 30 + "\n\n" + "b" * 30 + "\n \n" + "c" * 95 + "\n\n" + "d" * 10
    assert [text[a:b] for a, b in A.spans(text, 70)] == ["a" * 30 + "\n\n" + "b" * 30, "c" * 70, "c" * 25, "d" * 10]


@pytest.mark.parametrize(("text", "want"), [
    ("Revenue 1,200 1,300 1,400\nCosts 900 950 990\nMargin 25% 27% 29%", True), ("Contact: desk@example.org, tel 555 0100", True), ("Growth was 2% in May. It was 3% in June. Exports rose. Imports fell 4%, 5%, 6%, 7%, 8% and 9% in turn.", False), ("No figures, write to a@b", False),
])
def test_verbatim(text, want):
    assert A.kept_verbatim(text) is want


def test_parts_of_rows(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, None), (3, ""), (4, "a\n\nb")], "id long, text string")
    got = sorted((r.id, r.part, r.batch, r.begins, r.ends) for r in A.parts(df, "id", "text", most=10).collect())
    assert got == [(1, 0, 0, 0, 10), (1, 1, 1, 10, 20), (1, 2, 2, 20, 25), (3, 0, 0, 0, 0), (4, 0, 0, 0, 4)]


DATES = [
    (["https://h/a/20260902-note"], (2026, 9, 2)), (["https://h/2026/09/02/x"], (2026, 9, 2)), (["h/2026_9_2"], (2026, 9, 2)), (["Outlook Q3 2026"], (2026, 7, 1)), (["outlook-3q26"], (2026, 7, 1)), (["Bericht 02.09.2026"], (2026, 9, 2)),
    (["weekly-02092026.pdf"], (2026, 9, 2)), (["note-260828.pdf"], (2026, 8, 28)), (["note-280826.pdf"], (2026, 8, 28)), (["note_010203"], (2003, 2, 1)), (["September 2nd, 2026"], (2026, 9, 2)), (["sept-02-2026"], (2026, 9, 2)), (["2 September 2026"], (2026, 9, 2)), (["the 2nd of it, 22-Jun-2026"], (2026, 6, 22)),
    (["https://h/2026/report", "Note of 22 June"], (2026, 6, 22)), (["https://h/2026/report", "June 22: rates"], (2026, 6, 22)), (["Dealer's Eye (Aug, 2026)"], (2026, 8, 1)), (["Eye (August 2026)"], (2026, 8, 1)), (["a%2F2026-09-02"], (2026, 9, 2)),
    (["weakest since March 2020"], None), (["22 June 2025 to 2026"], (2025, 6, 22)), (["June 22", "2025 and 2026"], None), (["2026-02-31"], None), (["Outlook Q4 2027"], None), (["2 January 2027"], None), (["note-991399"], None), ([None, ""], None), (["dismay 3 2026"], None), (["20260921"], (2026, 9, 21)), (["20260922"], None),
]


@pytest.mark.parametrize(("values", "want"), DATES)
def test_dates(values, want):
    assert A.publication_date(values, TODAY) == (want and dt.date(*want))


@given(st.lists(st.text("0123456789-/. qJjuneMay(),", max_size=24), max_size=3))
@settings(max_examples=500, deadline=None)
def test_dates_are_never_in_the_future(values):
    date = A.publication_date(values, TODAY)
    assert date is None or date <= TODAY + dt.timedelta(days=1)


def test_dates_of_rows(spark):
    df = spark.createDataFrame([(k, (v + [None, None])[0], (v + [None, None])[1]) for k, (v, _) in enumerate(DATES)], "k int, url string, title string")
    got = {r.k: r.published for r in A.publication_dates(df, "k", ["url", "title"], TODAY).collect()}
    assert got == {k: w and dt.date(*w) for k, (_, w) in enumerate(DATES)}


BODY = "Growth slowed in the second quarter as exports fell, and households saved more than they had a year before, the bureau said."
LEGAL = "This report is for informational purposes only and does not constitute an offer."


@pytest.mark.parametrize(("text", "body", "legal"), [
    (f"{BODY}\n\n{LEGAL}", BODY, LEGAL), (f"{BODY}\n\nDisclaimer: see page 9.\n\nMore.", BODY, "Disclaimer: see page 9.\n\nMore."), (f"{BODY}\n \n本内容为营销材料。", BODY, "本内容为营销材料。"),
    (f"{BODY}\n\nPast performance is no guarantee.\n\nThe bank accepts no liability.\n\n仅供参考", BODY, "Past performance is no guarantee.\n\nThe bank accepts no liability.\n\n仅供参考"),
    (f"{BODY}\n\nPast performance is no guide to the future.\n\nNext week: jobs.", f"{BODY}\n\nPast performance is no guide to the future.\n\nNext week: jobs.", None),
    (f"Short.\n\n{LEGAL}", f"Short.\n\n{LEGAL}", None), (BODY, BODY, None), ("", "", None), (f"{BODY}\n\nDisclaimer", f"{BODY}\n\nDisclaimer", None),
    (f"{BODY}\n\nAccuracy is\nnot guaranteed, and it does not meet\nresearch rules.", f"{BODY}\n\nAccuracy is\nnot guaranteed, and it does not meet\nresearch rules.", None),
])
def test_disclaimers(text, body, legal):
    assert A.split_disclaimer(text) == (body, legal)


def test_segments():
    assert A.partition_segments([("Intro", BODY), ("Important information", " Read this. "), ("Later", "x")]) == ([("Intro", BODY)], "Read this.")
    assert A.partition_segments([("Intro", BODY), ("Related insights", "x"), ("Next", "y"), (None, f"z\n\n{LEGAL}"), ("Later", "x")]) == ([("Intro", BODY)], LEGAL)
    assert A.partition_segments([(None, BODY), ("Outlook", f"Fine.\n\n{LEGAL}"), ("Later", "x")]) == ([(None, BODY), ("Outlook", "Fine.")], LEGAL)
    assert A.partition_segments([("Disclaimered", "x"), (None, LEGAL)]) == ([("Disclaimered", "x"), (None, LEGAL)], None)
    assert A.partition_segments([]) == ([], None)


@pytest.mark.parametrize(("text", "want"), [
    ("One\nTwo\n\nThree", [("paragraph", ["One"]), ("paragraph", ["Two"]), ("paragraph", ["Three"])]), ("• a\n- b\n\n* c\nEnd\n– d", [("list", ["a", "b", "c"]), ("paragraph", ["End"]), ("list", ["d"])]),
    ("-1.9% today\n-\n \n• ", [("paragraph", ["-1.9% today"]), ("paragraph", ["-"]), ("paragraph", ["•"])]), ("", []),
])
def test_blocks(text, want):
    assert A.blocks(text) == want


@given(st.text("ab•- \n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_blocks_keep_all_words(text):
    assert "".join(c for _, items in A.blocks(text) for i in items for c in i if c in "ab") == "".join(c for c in text if c in "ab")


def test_structure_of_rows(spark):
    df = spark.createDataFrame([(1, f"{BODY}\n- a\n- b\n\n{LEGAL}"), (2, None)], "id long, text string")
    got = sorted(tuple(r) for r in A.structured(df, "id", "text").collect())
    assert got == [(1, "body", 0, "paragraph", 0, BODY), (1, "body", 1, "list", 0, "a"), (1, "body", 1, "list", 1, "b"), (1, "disclaimer", 0, "paragraph", 0, LEGAL)]
