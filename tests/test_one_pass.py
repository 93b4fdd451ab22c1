"""Checks read the lines once, and long texts are not dealt out again."""

import re

from pyspark.sql import functions as F

from docketmill.operators import checks, deadlines, money, ordering, structure
from docketmill.plans.documents import agreements, lines

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString()


def text_of(spark, *texts):
    return structure.blocks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_lines_end_alike(spark):
    got = text_of(spark, "a\r\nb\rc\n", "", "x\n\ny", None).collect()
    assert [tuple(r) for r in got] == [(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (2, 0, "x"), (2, 1, ""), (2, 2, "y")]


def test_punctuation_reads_the_lines_once_and_finds_all(spark):
    found = checks.punctuation(text_of(spark, "The THE, the end ,of  it,all: aa. .aab a a", "xaa aa aax"))
    assert len(re.findall("Generate posexplode", plan(found))) == 1
    assert sorted((r.doc_id, r.kind, r.anchor) for r in found.collect()) == [(0, "double space", ",of  it,all:"), (0, "no space after comma", "it,all"), (0, "repeated word", "the the"), (0, "repeated word", "the the")]


def test_date_styles_and_unused_terms_read_the_lines_no_more_than_needed(spark):
    b = text_of(spark, "1 May 2026, 2 May 2026 and May 3, 2026")
    assert len(re.findall("Generate posexplode", plan(checks.date_styles(b)))) == 1
    assert len(re.findall("Generate posexplode", plan(checks.unused_terms(b)))) == 2
    assert [tuple(r)[2:] for r in checks.date_styles(b).collect()] == [("date style", 3, "May 3, 2026", "3 May 2026")]


def test_texts_are_made_after_the_rows_are_dealt_out(spark):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = structure.first_place(lines(spark, FOLDER), agreements(spark, FOLDER).selectExpr("doc_id", "'Goods' as anchor"))
        made.collect()
        told = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    told = told.split("Initial Plan")[0]
    assert not [x for x in told.splitlines() if "Exchange hashpartitioning(doc_id" in x]


def test_amounts_and_percentages_are_found_in_one_pass(spark):
    found = money.amounts(text_of(spark, "Pay USD 1,500.00 and $2 million, or 5% and 7.5 per cent of £3k.", "none", "EUR 99999999999999999999"))
    assert len(re.findall("Generate", plan(found))) == 2
    got = sorted((r.doc_id, r.kind, r["at"], r.currency, str(r.value)) for r in found.collect())
    assert got == [(0, "money", 0, "USD", "1500.00"), (0, "money", 1, "USD", "2000000.00"), (0, "money", 2, "GBP", "3000.00"), (0, "percent", 0, None, "5.00"), (0, "percent", 1, None, "7.50")]


def test_dates_and_periods_are_found_in_one_pass_and_stay_with_their_document(spark):
    b = text_of(spark, "On 30 days notice, from 3 May 2026 and after 2 weeks until August 5, 2026.", "Paid for 1 year on 31 February 2026")
    told = plan(deadlines.table(b))
    assert len(re.findall("Generate", told)) == 2 and "Union" not in told
    got = sorted((r.doc_id, r.kind, r.what, str(r.day), r.lo, r.hi) for r in deadlines.table(b).collect())
    days = [(0, "date", "3 May 2026", "2026-05-03", None, None), (0, "date", "August 5, 2026", "2026-08-05", None, None)]
    assert got == sorted([*days, (0, "period", "2 week", "None", 14.0, 14.0), (0, "period", "30 day", "None", 30.0, 30.0), (1, "date", "31 February 2026", "None", None, None), (1, "period", "1 year", "None", 365.0, 366.0)])


def test_lines_that_cannot_hold_an_anchored_period_meet_no_pattern(spark):
    b = text_of(spark, '"Start Date" means 31 January 2027.\nPaid 1 month after the Start Date, or 5 weeks beginning with the Start Date.')
    assert plan(deadlines.due(b)).count("Contains(text") >= 3
    assert sorted(str(r.day) for r in deadlines.due(b).collect()) == ["2027-02-28", "2027-03-06"]


def test_what_stands_around_a_period_is_searched_few_times(spark):
    frame = spark.createDataFrame([("the fee is paid; in force", "after notice"), ("it may extend", ""), ("", "x terminated"), ("", "")], "b string, a string")
    kind = frame.select(deadlines.kind_of(F.col("b"), F.col("a")).alias("kind"))
    assert plan(kind).count("invoic") <= 5
    assert [r.kind for r in kind.collect()] == ["duration", "extension", "ending", None]


def test_contradictions_of_times_are_the_same_without_lines_that_tell_nothing(spark):
    text = "Dated 3 March 2026\n{}1. Ending\n{}Either party may terminate on 4 weeks notice.\nA breach is cured within 60 days.\n{}\"Long Stop Date\" means 1 February 2026."
    rows = [sorted(tuple(r)[1:] for r in ordering.contradictions(text_of(spark, text.format(x, x, x))).collect()) for x in ("", "Nothing else applies.\n")]
    assert rows[0] == rows[1] == [("remedy outlasts notice", 2, "60 day", "4 week"), ("stop before signing", 1, "Long Stop Date", "signing")]


def test_quotations_are_told_without_the_plain_text_where_that_is_enough(spark):
    from docketmill.operators import mail

    def brute(quote, text):
        plain = lambda x: re.sub("[^a-z0-9.]+", " ", x.lower()).strip()
        at, whole = 0, plain(text)
        for part in filter(None, (p.strip() for p in plain(quote).split("..."))):
            if (found := whole.find(part, at)) < 0:
                return False
            at = found + len(part)
        return True

    texts = ["The Seller\n delivers, and pays.", "the seller delivers", "delivers the seller", "Seller: delivers... the end", "THE  SELLER", "", "é the seller é delivers 1.5", "a b a", "sellerdelivers the"]
    quotes = ["The Seller delivers", "seller ... delivers", "delivers ... seller", "the seller...", "...", "", "a ... a", "a b ... a", "1.5", "seller delivers the"]
    for q in quotes:
        got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mail.quote_found(F.lit(q), F.col("text")).alias("f")).collect()
        assert [r.f for r in got] == [brute(q, r.text) for r in got], q
