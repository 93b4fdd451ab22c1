import random

import pytest

from docketmill.operators import ordering


def found(spark, *documents):
    """The contradictions of each document, given as its lines."""
    rows = [(d, i, t) for d, texts in enumerate(documents) for i, t in enumerate(x for t in texts for x in ([t] if t is None else t.split("\n")))]
    out = [[] for _ in documents]
    for r in ordering.contradictions(spark.createDataFrame(rows, "doc_id long, idx int, text string").repartition(3)).collect():
        out[r.doc_id].append((r.kind, r.what, r.other))
    return [sorted(x) for x in out]


CLEAN = ["This Deed is dated 3 March 2026.", '"Completion Date" means 10 April 2026.', '"Long Stop Date" means 30 June 2026.', '"Handover" means 30 days after the Completion Date.', "1. Claims", "A claim is made within 12 months after the Completion Date.", "The retention is paid out 1 year after the Completion Date.", "2. Ending", "Either party may terminate on 14 days notice. A breach is cured within 2 weeks.", "The Initial Term is 12 months. The Initial Term is 1 year.", "Notice is given 360 days before the end of the Initial Term."]


CASES = [
        (None, "", []),
        (2, '"Long Stop Date" means 1 May 2026.', [("stop before event", "Handover", "Long Stop Date")]),
        (2, '"Long Stop Date" means 9 May 2026.', [("stop before event", "Handover", "Long Stop Date")]),
        (2, '"Long Stop Date" means 10 May 2026.', []),
        (2, '"Outside Date" means 2 March 2026.', [("stop before event", "Completion Date", "Outside Date"), ("stop before event", "Handover", "Outside Date"), ("stop before signing", "Outside Date", "signing")]),
        (1, '"Completion Date" means 1 January 2026.', [("event before signing", "Completion Date", "signing"), ("event before signing", "Handover", "signing")]),
        (3, '"Handover" means 5 months before the Completion Date.', [("event before signing", "Handover", "signing")]),
        (3, '"Handover" means 3 days after the Completion Date.\n"Handover" means 4 days after the Completion Date.', [("no day fits", "Handover", "")]),
        (3, '"Handover" means 1 month after the Completion Date.\n"Handover" means 29 days after the Completion Date.', []),
        (5, "A claim is made within 11 months after the Completion Date.", [("claims end before release", "11 months", "1 year")]),
        (5, "A claim is made within 11 months after the Handover.", []),
        (8, "Either party may terminate on 13 days notice. A breach is cured within 2 weeks.", [("remedy outlasts notice", "2 week", "13 day")]),
        (9, "The Initial Term is 12 months. The Initial Term is 2 years.", [("term stated twice", "Initial Term 2 years", "12 months")]),
        (10, "Notice is given 13 months before the end of the Initial Term.", []),
        (10, "Notice is given 400 days before the end of the Initial Term.", [("notice longer than term", "400 days", "Initial Term 1 year")]),
    ]


def test_each_flag_and_its_bounds(spark):
    documents = [[text if i == line else t for i, t in enumerate(CLEAN)] for line, text, _ in CASES]
    documents[-1][9] = "The Initial Term is 1 year."
    assert found(spark, *documents) == [want for _, _, want in CASES]


def test_a_circle_ends_and_empty_documents_have_nothing(spark):
    circle = ['"Start" means 1 May 2026.', '"End" means 2 days after the Start.', '"Start" means 1 day after the End.']
    assert found(spark, circle, ['"A" means 2 days after the B.', '"B" means 1 day after the A.'], [None, ""]) == [[("no day fits", "Start", "")], [], []]


@pytest.mark.parametrize("seed", range(3))
def test_bounds_are_the_tightest_that_the_distances_allow(spark, seed):
    """Against shortest paths over all constraints, one document of random events."""
    rnd = random.Random(seed)
    known = [(1, f"E{i}", d, d) for i in range(2) for d in [rnd.randrange(0, 50)]]
    far = []
    for i in range(2, 9):
        for _ in range(rnd.randrange(1, 3)):
            least = rnd.randrange(-20, 20)
            far.append((1, f"E{i}", f"E{rnd.randrange(0, i)}", least, least + rnd.choice([0, 3, 3, 60])))
    want = {e: [lo, hi] for _, e, lo, hi in known}
    for i in range(2, 9):
        ways = [(want[a][0] + x, want[a][1] + y) for _, e, a, x, y in far if e == f"E{i}" and a in want and want[a][0] <= want[a][1]]
        if ways:
            want[f"E{i}"] = [max(w[0] for w in ways), min(w[1] for w in ways)]
    got = ordering.tightened(spark.createDataFrame(known, "doc_id long, event string, lo int, hi int"), spark.createDataFrame(far, "doc_id long, event string, anchor string, least int, most int"))
    got = {r.event: [r.lo, r.hi] for r in got.collect()}
    # What hangs on an event that no day fits may have been told something before that came out.
    bad = {e for e, (lo, hi) in want.items() if lo > hi}
    tainted = set()
    for i in range(2, 9):
        tainted |= {f"E{i}"} if any(e == f"E{i}" and a in bad | tainted for _, e, a, _, _ in far) else set()
    sure = set(want) - tainted
    assert {e: b for e, b in got.items() if e in sure - bad} == {e: b for e, b in want.items() if e in sure - bad}
    assert bad & sure == {e for e, (lo, hi) in got.items() if lo > hi and e in sure} and len(sure) > 3
