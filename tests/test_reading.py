"""Documents read once give what each check by itself gives, with no shuffle of lines or words."""

import random
import re

from pyspark.sql import functions as F

from docketmill.operators import checks, reading

PIECES = [
    '"Completion Date" means 10 April 2026', '"Goods" means the goods', '“Fee” has the meaning given in clause 2', '(the "Buyer" or "Purchaser")', '"Goods" means other goods', '"Losses":', "See Section 3 and Clause 99999999999", "Schedule 2", "the Service Levels and The Service Levels",
    "The Goods are sold", "Losses are borne", "The Goodz, the Losse", "completion date", "thirty (13) days", "7 (seven) and two hundred and five (205)", "nine and ten (10)", "USD 5", "US$5", "£ 3", "on Monday, 6 April 2026", "Tuesday 6 April 2026", "June 5, 2026", "31 June 2026", "This is made on 3 March 2026 and", "the date of this Agreement is 4 March 2026",
    "Acme Mills Limited", "Acme Mills Ltd", "Acme Mills LLP", "the the goods , now", "a  b,c", "400 days notice", "the term of this Agreement is 12 months", "[AMOUNT]", "____", "TBC", "é ñ", "", "\t",
]
STARTS = ["1. ", "2. ", "2. ", "5. ", "99999999999. ", "Schedule 1 ", "Schedule 3", "", "", "", ""]


def odd_lines(spark, n=60):
    rnd = random.Random(7)
    rows = [(k, i, None if rnd.random() < 0.03 else rnd.choice(STARTS) + ". ".join(rnd.choice(PIECES) for _ in range(rnd.randrange(4)))) for k in [*range(n), None] for i in range(rnd.randrange(1, 18))]
    return spark.createDataFrame(rows, "doc_id long, idx int, text string")


def test_one_pass_is_each_check_by_itself(spark):
    lines = odd_lines(spark)
    for check in checks.CHECKS:
        got = sorted(map(str, reading.findings(lines, [check.__name__]).collect()))
        if check is not checks.misspelt_terms:
            assert got == sorted(map(str, check(lines).collect())), check.__name__
        assert got, check.__name__
    alone = [c for c in checks.CHECKS if c is not checks.misspelt_terms]
    whole = checks.capped(checks.deduplicated(lines.sparkSession.createDataFrame([r for c in alone for r in c(lines).collect()], reading.findings(lines, ["blanks"]).schema)), 1)
    assert sorted(map(str, checks.run_all(lines, alone, most=1).collect())) == sorted(map(str, whole.collect()))


def test_misspelt_terms_are_those_of_all_pairs(spark):
    letters, rnd = "abcd", random.Random(3)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 6))).capitalize()
    rows = [(k, i, (f'"{word()}" means x. ' if i < 4 else "") + " ".join(word() for _ in range(5))) for k in range(40) for i in range(12)]
    lines = spark.createDataFrame(rows, "doc_id long, idx int, text string")
    terms = checks.definitions(lines).select("doc_id", "term").distinct()
    words = lines.select("doc_id", "idx", F.explode(F.regexp_extract_all("text", F.lit(checks.WORD), F.lit(0))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("idx").alias("idx")).where("n = 1")
    rare = words.join(terms.withColumnRenamed("term", "word"), ["doc_id", "word"], "left_anti")
    want = rare.join(terms, "doc_id").where("levenshtein(word, term) = 1 and concat(term, 's') <> word and concat(word, 's') <> term")
    got = checks.misspelt_terms(lines)
    assert sorted((r.doc_id, r.idx, r.anchor, r.note) for r in got.collect()) == sorted((r.doc_id, r.idx, r.word, f"for {r.term}") for r in want.collect()) != []


def test_neither_lines_nor_words_are_shuffled_or_sorted(spark):
    from docketmill.plans import documents

    for name in ("check_misspelt_terms", "all_findings"):
        plan = getattr(documents, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = plan[: plan.index("Generate posexplode")]
        assert lines.count("MapInArrow") == 1 and not re.search("Exchange|Sort|Window|Join", lines) and "REPARTITION_BY_NUM" in plan


def test_kinds_of_periods_are_those_of_the_columns(spark):
    from docketmill.operators import deadlines

    rnd = random.Random(9)
    pieces = ["Bills are paid", "; after 5 weeks", " the Seller may rescind.", " Within 3 days of the claim", "retention", " for two (2) years", " on 14 days notice", ", cured within 60 days", ". is 7 months", "due", " "]
    rows = [(1, i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(8)))) for i in range(300)]
    got = sorted((i, *x) for _, i, t in rows for x in deadlines.classified_in(t))
    assert got == sorted((r.idx, r.kind, r.n, r.unit) for r in deadlines.classified(spark.createDataFrame(rows, "doc_id long, idx int, text string")).collect()) and len({x[1] for x in got}) > 5


def test_contradictions_join_and_broadcast_nothing(spark):
    from docketmill.plans import ordering

    plan = ordering.time_contradictions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and not re.search("Broadcast|Join|Window|Aggregate", plan)


def test_days_within_a_document_are_tightened_as_in_the_table(spark):
    from docketmill.operators import ordering

    rnd = random.Random(4)
    names, docs = [f"E{i}" for i in range(6)], []
    for _ in range(40):
        known = {n: (d, d + rnd.choice([0, 0, -1, 5])) for n in rnd.sample(names, 2) for d in [rnd.randrange(30)]}
        docs.append((known, [(rnd.choice(names), rnd.choice(names), least, least + rnd.choice([0, 3])) for _ in range(5) for least in [rnd.randrange(-5, 6)]]))
    known = [(d, e, *b) for d, (k, _) in enumerate(docs) for e, b in k.items()]
    far = [(d, *f) for d, (_, fs) in enumerate(docs) for f in fs]
    got = ordering.tightened(spark.createDataFrame(known, "doc_id long, event string, lo int, hi int"), spark.createDataFrame(far, "doc_id long, event string, anchor string, least int, most int"))
    assert sorted(map(tuple, got.collect())) == sorted((d, e, *b) for d, (k, fs) in enumerate(docs) for e, b in ordering._tightened(k, fs).items())
