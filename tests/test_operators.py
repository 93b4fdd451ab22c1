"""What the oracles don't show: defined results for nulls, ties and empty input, and functions in Python."""

import pytest
from pyspark.sql import functions as F

from docketmill.functions import text as T
from docketmill.operators import checks, deadlines, ledger, mail, money, structure, versions
from docketmill.streaming import jobs

BLOCKS = "doc_id long, idx int, text string"


def blocks(spark, *lines):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], BLOCKS)


def test_lines_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "x\n\ny")], "doc_id long, text string")
    got = {}
    for r in structure.blocks(docs).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {1: ["a", "b", "c"], 4: ["x", "", "y"]}


def test_numbers_begin_anew_in_a_schedule(spark):
    b = blocks(spark, "1. One", "text", "Schedule 1 Goods", "before", "1. Item", "more")
    assert [r.label for r in structure.labels(b).orderBy("idx").collect()] == ["clause 1", "clause 1", "Schedule 1", "Schedule 1", "Schedule 1, paragraph 1", "Schedule 1, paragraph 1"]
    assert checks.numbering(b).collect() == []


def test_clean_text_has_no_findings_and_empty_input_no_rows(spark):
    b = blocks(spark, "1. One", "A plain sentence.", "2. Two", "Another one; nothing is wrong.")
    assert checks.run_all(b).collect() == []
    assert checks.run_all(b.limit(0)).collect() == [] and checks.run_all(blocks(spark, None, "1. One", None)).collect() == []


@pytest.mark.parametrize("line,kind", [("Pay within thirty-one (30) days.", "amount"), ("Sign on Friday, 6 April 2026.", "weekday"), ("See [DATE] here.", "blank"), ("It is is so.", "repeated word")])
def test_one_defect_one_finding(spark, line, kind):
    assert [r.kind for r in checks.run_all(blocks(spark, line)).collect()] == [kind]


def test_cap_keeps_the_worst_and_counts_the_rest(spark):
    rows = [(1, i, "k", 1 + i % 3, f"a{i:02}", "n") for i in range(25)]
    got = checks.capped(spark.createDataFrame(rows, "doc_id long, idx int, kind string, severity int, anchor string, note string")).collect()
    assert len(got) == 11 and [r.note for r in got if not r.anchor] == ["and 15 more"] and max(r.severity for r in got if r.anchor) <= 2


def test_early_terms_need_the_gap(spark):
    b = blocks(spark, "1. Use", "The Goods are here.", "2. Other", "3. Terms", '"Goods" means things.')
    assert [r.anchor for r in checks.early_terms(b).collect()] == ["Goods"] and checks.early_terms(b, 3).collect() == []


def test_number_words(spark):
    row = spark.range(1).select(*(T.number_of(F.lit(w)).alias(w) for w in ("zero", "Ninety-Nine", "twenty", "gazillion")), T.in_words(F.lit(10**12)).alias("over")).first()
    assert (row["zero"], row["Ninety-Nine"], row["twenty"], row["gazillion"], row["over"]) == (0, 99, 20, None, None)


def test_money_and_cells(spark):
    b = blocks(spark, "USD 1,500.50 and £2 million, or 12.5% of $3")
    assert sorted((r.kind, r.currency, float(r.value)) for r in money.amounts(b).collect()) == [("money", "GBP", 2_000_000.0), ("money", "USD", 3.0), ("money", "USD", 1500.5), ("percent", None, 12.5)]
    cells = spark.createDataFrame([("$1,200.00",), ("(5)",), ("-3.5",), ("12%",), ("n/a",), (None,)], "t string")
    assert [None if r.v is None else float(r.v) for r in cells.select(money.cell_value(F.col("t")).alias("v")).collect()] == [1200.0, -5.0, -3.5, 12.0, None, None]


def test_a_month_is_a_range(spark):
    b = blocks(spark, "Reply within 1 month after Notice.", "Reply 30 days after Notice.", "Reply 10 days after Notice.")
    assert [(r.anchor, r.n) for r in deadlines.stated_twice(b).collect()] == [("Notice", 2)]


def test_calendar_text(spark):
    ics = deadlines.calendar_file(deadlines.calendar(blocks(spark, "On 3 March 2026 it ends."))).first().ics
    assert ics.startswith("BEGIN:VCALENDAR\r\n") and "DTSTART;VALUE=DATE:20260303" in ics and ics.endswith("END:VCALENDAR\r\n")


def test_alignment():
    long = "This whole clause of some length was moved elsewhere."
    got = versions.aligned(["a one", long, "b", "c", "d the same thing"], ["a one", "b", "c", "d the same things", "new", long])
    assert [(x["kind"], x["old_idx"], x["new_idx"]) for x in got] == [("replaced", 4, 3), ("inserted", None, 4), ("moved", 1, 5)]
    assert versions.aligned(["x"], ["x"]) == [] and versions.aligned([], ["x"])[0]["kind"] == "inserted"
    assert versions.hunks("pay thirty days", "pay sixty days") == [("thirty", "sixty")] and versions.hunks("abc", "xyz") == [("abc", "xyz")]


def test_changes_prove_the_comparison(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "new"), (3, "same", "same"), (4, "gone", None)], "doc_id long, old string, new string")
    c = versions.changes(pairs)
    assert {r.doc_id: r.proven for r in versions.proven(pairs, c).collect()}[1]
    wrong = c.where("kind <> 'inserted'")
    assert not {r.doc_id: r.proven for r in versions.proven(pairs, wrong).collect()}[1]
    assert {r.doc_id for r in c.collect()} == {1, 2, 4}


def test_mail_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(mail.own_words(F.lit("mine\nOn 1 May A wrote:\n> old"))) == "mine" and row(mail.own_words(F.lit(""))) == ""
    assert row(mail.undo_numbers(F.lit("Undo 3, 1 and 3. Not 9"))) == [1, 3] and row(mail.undo_numbers(F.lit("keep 3"))) is None
    assert row(mail.quote_found(F.lit("b ... d"), F.lit("a b c d"))) and not row(mail.quote_found(F.lit("d ... b"), F.lit("a b c d")))
    assert row(mail.dismissed_letters(F.lit("ignore b, d"))) == ["B", "D"]
    assert row(mail.admitted(F.lit("mx; spf=pass x; dkim=fail"))) == "refused" and row(mail.admitted(F.lit(None).cast("string"))) == "unknown"


def test_anti_joins_ignore_null_keys(spark):
    children = spark.createDataFrame([(1, 10), (2, None), (3, 11)], "id long, key long")
    assert [r.id for r in ledger.orphans(children, spark.createDataFrame([(10,), (None,)], "key long"), "key").collect()] == [3]


def test_upsert_with_null_values(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(tuple(r) for r in ledger.upserted(old, new, ["k"], ["v"]).collect()) == [(1, "a"), (2, None), (3, "c")]


def test_send_once_survives_a_replay(spark, tmp_path):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "event_id long, body string")
    assert jobs.send_once(batch, f"{tmp_path}/outbox") == 2
    assert jobs.send_once(batch, f"{tmp_path}/outbox") == 0
    assert spark.read.parquet(f"{tmp_path}/outbox").count() == 2


def test_functions_have_names_in_sql(spark):
    from docketmill.functions.registry import register

    assert len(register(spark)) == 4
    row = spark.sql("select text_likeness('abcd', 'abcx') l, text_likeness(null, 'a') n, changed_words('pay thirty days', 'pay sixty days') w, decode_entities('a &amp; b') d, mark_quotations('<blockquote>x</blockquote>') q").first()
    assert (row.l, row.n, row.d, row.q.strip()) == (0.75, None, "a & b", "> x") and [(x.removed, x.added) for x in row.w] == [("thirty", "sixty")]


def test_lines_of_a_large_region_are_no_changes_of_each_other():
    from docketmill.operators import versions

    for n in (50, 201):
        kinds = [c["kind"] for c in versions.aligned([f"old{chr(97 + i % 26)}{i * i}" for i in range(n)], [f"{i * 7} fresh" for i in range(n)])]
        assert sorted(kinds) == ["deleted"] * n + ["inserted"] * n


def test_numbers_in_words_and_back(spark):
    from pyspark.sql import functions as F

    from docketmill.functions import text as T

    values = [0, 1, 19, 20, 21, 99, 100, 101, 110, 999, 1000, 1001, 1100, 20_000, 100_000, 999_999, 10**6, 10**6 + 1, 2_500_000, 10**9, 999_999_999_999]
    frame = spark.createDataFrame([(v,) for v in values], "n long")
    rows = frame.select("n", T.in_words(F.col("n")).alias("w")).withColumn("back", T.number_of(F.col("w"))).collect()
    assert all(r.n == r.back for r in rows), rows
    words = {r.n: r.w for r in rows}
    assert words[1001] == "one thousand and one" and words[2_500_000] == "two million five hundred thousand"
    odd = spark.createDataFrame([("a hundred",), ("",), (None,), ("Thousand",), ("forty-two",), ("nine and ten",), ("billion billion",), ("ten twenty",), ("one thousand two million",), ("nineteen hundred",), ("zero zero",)], "w string")
    assert [r.n for r in odd.select(T.number_of(F.col("w")).alias("n")).collect()] == [None, None, None, 1000, 42, None, None, None, None, 1900, None]


def test_definitions_in_every_form_and_a_broken_check(spark):
    from docketmill.operators import checks

    lines = [
        (0, '"Day" shall mean a working day; "Fee" includes tax', [("Day", "stated", "a working day"), ("Fee", "stated", "tax")]),
        (1, 'X Ltd (the "Buyer" or "Purchaser"), together the “Sellers”', [("Buyer", "named", None), ("Purchaser", "named", None), ("Sellers", "named", None)]),
        (2, '"Loss" has the meaning given in clause 2', [("Loss", "elsewhere", None)]),
        (3, '(a) "Charge":', [("Charge", "headed", None)]),
        (4, 'marked "Secret" and kept, "Open" is never closed: "Rate', []),
        (5, '"A Group" or "Groups" means all', [("A Group", "stated", "all"), ("Groups", "stated", "all")]),
        (6, 'In this deed "Fee" means tax. "Rate" means four per cent.', [("Fee", "stated", "tax."), ("Rate", "stated", "four per cent.")]),
        (7, 'The "Fee" and (stamped "Paid") are shown; "fee" means nothing', []),
        (8, '"Fee" means a sum (the "Fee")', [("Fee", "stated", "a sum (the")]),
    ]
    frame = spark.createDataFrame([(1, i, t) for i, t, _ in lines], "doc_id long, idx int, text string")
    got = sorted((r.idx, r.term, r.how, r.meaning) for r in checks.definitions(frame).collect())
    assert got == sorted((i, *x) for i, _, found in lines for x in found)
    found = checks.run_all(frame, [checks.blanks, lambda b: b.select("nothing"), checks.punctuation]).collect()
    assert [r.kind for r in found if r.doc_id is None] == ["not checked"]


def test_kinds_are_told_by_the_nearest_cue(spark):
    b = blocks(spark, "Bills are sent; after 5 weeks the seller may rescind, and within 2 days pay.", "The fee is due within 3 days. Claims are made on 4 weeks.", "Within 6 days all is done; a review follows.", "It is on 7 days.", "Within 99999999999 days pay.")
    got = sorted((r.idx, r.n, r.kind) for r in deadlines.classified(b).collect())
    assert got == [(0, 2, "payment"), (0, 5, "ending"), (1, 3, "payment"), (1, 4, "claim"), (2, 6, "review"), (3, 7, "period")]


def test_periods_that_count_their_first_day_and_none_beyond_the_calendar(spark):
    b = blocks(spark, '"Start" means 1 March 2026.', "Pay 10 days after the Start.", "Pay 10 days from and including the Start.", "Pay 9999 years after the Start.", "Pay 123456 days after the Start.", "Pay 1 month beginning with the Start.")
    assert sorted((r.idx, str(r.day)) for r in deadlines.due(b).collect()) == [(1, "2026-03-11"), (2, "2026-03-10"), (3, "None"), (5, "2026-03-31")]


def test_terms_one_letter_off(spark):
    from docketmill.operators import checks

    b = blocks(spark, '"Seller" means A. "Goods" means B.', "The Sellar, the Selle, the Sellers and the Selleer.", "The Goods, the Godos and Gooda.")
    assert sorted(r.anchor for r in checks.misspelt_terms(b).collect()) == ["Gooda", "Sellar", "Selle", "Selleer"]


def test_lower_case_terms_are_whole_words_outside_their_definition(spark):
    from docketmill.operators import checks

    b = blocks(spark, '"Trade Mark" means any trade mark.', "A trade mark is used.", "The trade markets.", "A Trade Mark.", None)
    assert [(r.idx, r.anchor) for r in checks.lower_case_terms(b).collect()] == [(1, "trade mark")]


def test_removals_in_every_voice(spark):
    from docketmill.operators import mail

    doc = "The exclusivity period runs. A non-solicit applies; see clause 7.2. The long stop date is fixed."
    said = {
        "The exclusivity period has been removed.": {"exclusivity period"}, "We struck out the non-solicit wording.": {"non-solicit"}, "As agreed the non-solicit clause was deleted, and clause 7.2 is now gone.": {"non-solicit", "clause 7.2"},
        "It no longer mentions the long stop date.": {"long stop date"}, "I took out references to the exclusivity period from it.": {"exclusivity period"}, "Nothing was removed.": set(), "We deleted clause 7.": set(), "We removed the exclusivity periods.": set(), "": set(),
    }
    frame = spark.createDataFrame([(i, t, doc) for i, t in enumerate(said)], "msg_id long, body string, doc string")
    got = [set() for _ in said]
    for r in mail.removals_still_there(frame).collect():
        got[r.msg_id].add(r.phrase)
    assert got == list(said.values())


def test_no_number_is_too_long(spark):
    from docketmill.operators import mail, structure

    n = "9" * 24
    b = blocks(spark, f"{n}. Terms", f"See Section {n} and seven ({n}).", f"Within {n} days pay USD {n} and {n}%.", f"{n} days notice. The term of this Agreement is {n} months.", f"On {n}/{n}/2026 and Monday, 99 May {n}.", f"Schedule {n}")
    assert {r.kind for r in checks.run_all(b).collect()} == {"amount"}
    assert money.amounts(b).collect() == [] and deadlines.periods(b).collect() == [] and structure.numbers(b).where("number is not null").collect() == []
    letters = spark.createDataFrame([(1, f"undo {n} and 2. Schedules 1-{n}, Schedules 3-4, version {n}", "x")], "msg_id long, body string, filename string")
    assert letters.select(mail.undo_numbers(F.col("body")).alias("u")).first().u == [2]
    assert sorted(r.title for r in mail.promised(letters).collect()) == ["Schedule 3", "Schedule 4"] and mail.version_mismatch(letters).collect() == []


def test_compatible_forms_are_held(spark):
    rows = [("The ﬁrst Ｃlause", "first  clause", True), ("plain", "PLAIN", True), ("plain", "", False), (None, "x", None), ("x²", "x2", True), ("ab", "abc", False)]
    got = spark.createDataFrame([r[:2] for r in rows], "t string, p string").select(T.holds(F.col("t"), F.col("p")).alias("h")).collect()
    assert [r.h for r in got] == [r[2] for r in rows]
