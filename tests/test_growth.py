"""Steps whose work grows with their rows, and not with the square of a group's."""

import datetime as dt
import difflib
import random
import re

from docketmill.operators import checks, ledger, versions


def test_first_after_looks_back_and_never_on_to_the_end_for_each_row(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [(1, 1, at(0), "view"), (1, 2, at(5), "view"), (1, 3, at(5), "purchase"), (1, 4, at(5), "view"), (1, 5, at(9), "purchase"), (1, 6, at(9), "view"), (2, 7, at(1), "view"), (2, 8, at(0), "purchase")]
    found = ledger.first_after(spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, step string"), "view", "purchase", 240)
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 300, False), (1, 2, 0, True), (1, 4, 240, True), (1, 6, None, False), (2, 7, None, False)]


def test_a_message_meets_each_alias_once(spark):
    wanted = spark.createDataFrame([(1, "u", ["x", "a", "b"]), (2, "u", ["b", "a"]), (3, "w", ["a"])], "msg_id long, owner string, wanted array<string>")
    aliases = spark.createDataFrame([("u", "a", 9), ("u", "a", 7), ("u", "b", 8), ("v", "x", 1)], "owner string, alias string, thread long")
    found = ledger.resolve_aliases(wanted, aliases)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*Aggregate \[owner#\d+, alias#\d+\]", plan, re.DOTALL)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7), (2, 8)]


def test_likeness_is_that_of_difflib_and_short_texts_need_no_table_of_characters(monkeypatch):
    rnd, pairs = random.Random(5), []
    for t in range(800):
        letters = "ab" if t % 3 else "abcdefgh "
        a = [rnd.choice(letters) for _ in range(rnd.randrange(60))]
        b = list(a) if t % 4 else [rnd.choice(letters) for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(8)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randrange(4)] = [rnd.choice(letters) for _ in range(rnd.randrange(4))]
        pairs.append(("".join(a), "".join(b)))
    want = [difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    long = "".join(rnd.choice("abc") for _ in range(5000))
    assert versions.likeness(long, "x" + long) == difflib.SequenceMatcher(None, long, "x" + long, autojunk=False).ratio()
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert [versions.likeness(a, b) for a, b in pairs] == want
    assert versions.likeness("abcd", "abxy", 0.8) == 0.0 and versions.likeness("", "") == 1.0


def test_findings_are_made_share_by_share_and_nothing_stays_kept(spark, monkeypatch):
    from docketmill.plans import documents

    kept, real = [], documents.structure.blocks
    monkeypatch.setattr(documents.structure, "blocks", lambda docs: kept.append(docs.count()) or real(docs))
    monkeypatch.setattr(checks, "CHECKS", [checks.blanks, checks.amounts])
    monkeypatch.setattr(checks.run_all, "__defaults__", (checks.CHECKS,))
    monkeypatch.setattr(documents, "DOCS_AT_ONCE", 600, raising=False)
    found = documents.every_finding(spark, "/root/testdata/sf0.001")
    docs = documents.agreements(spark, "/root/testdata/sf0.001")
    assert len(kept) == 3 and max(kept) < 600 and sum(kept) == docs.count()
    whole = checks.run_all(real(docs), checks.CHECKS)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and not spark._jsc.getPersistentRDDs()


def test_proofs_of_a_comparison_read_the_file_without_packing_it_again(monkeypatch):
    from docketmill.sinks import compared, word

    old, new = compared.built(["One two three four.", "Gone.", "A\tb"]), compared.built(["One two five four.", "A\tb", "New."])
    made, calls, real = compared.compared(old, new, "x"), [], word._packed
    assert made["old_proven"] and made["new_proven"]
    for accept in (False, True):
        assert compared.read_back(made["content"], accept) == compared.stories(word.decide(made["content"], lambda _, a=accept: a)) == compared.stories(new if accept else old)
    for module in (compared, word):
        monkeypatch.setattr(module, "_packed", lambda parts: calls.append(1) or real(parts))
    assert compared.compared(old, new, "x") == made and len(calls) == 3
