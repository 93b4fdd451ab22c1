import pytest

from docketmill.operators import outgoing

SCHEMA = "msg_id long, sender string, external string, filename string, body string, doc string, tracked boolean, comments boolean"
CLEAN = {"sender": "u1@firm.example", "external": "legal@acme.example", "filename": "Agreement v3.docx", "body": "Please find attached version 3 of the agreement.", "doc": "Between Acme Mills Limited and another. The term is a year.", "tracked": False, "comments": False}
CASES = [
    ({}, set()),
    ({"external": "Legal <legal@strand.example>"}, {("another recipient", "strand")}),
    ({"body": "The agreement is attached; more will follow."}, {("claim about file", "promises more")}),
    ({"body": "We deleted the exclusivity period.", "doc": "The Exclusivity Period of Acme Mills Limited."}, {("still there", "exclusivity period")}),
    ({"body": "A clean copy.", "tracked": True, "comments": True}, {("not clean", "changes, comments")}),
    ({"filename": "Lease.docx"}, {("another kind", "agreement and lease")}),
    ({"external": "U1@Gmail.com", "doc": "no companies"}, {("own webmail", "u1@gmail.com")}),
    ({"body": "See Schedules 2-3.", "filename": "Schedule 2.docx"}, {("schedule not there", "Schedule 3")}),
    ({"filename": "Agreement FINAL.docx", "body": "Here.", "comments": True}, {("final but marked", "comments")}),
    ({"filename": "Agreement v4.docx"}, {("another version", "3 and 4")}),
    ({"body": "Attached is the agreement with Bluewater Ports Limited."}, {("another company", "Bluewater Ports Limited")}),
    ({"body": "Enclosed are the agreement and the lease."}, {("companion missing", "lease")}),
    ({"doc": "Internal only. Acme Mills Limited."}, {("internal marking", "internal only")}),
    ({"external": None, "body": None, "doc": None, "filename": None}, set()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [tuple((CLEAN | {"msg_id": i} | case)[c.split()[0]] for c in SCHEMA.split(", ")) for i, (case, _) in enumerate(CASES)]
    out = [set() for _ in CASES]
    for r in outgoing.findings(spark.createDataFrame(rows, SCHEMA)).collect():
        out[r.msg_id].add((r.kind, r.note))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_each_check_finds_its_own(found, i):
    assert found[i] == CASES[i][1]


def test_every_check_has_a_case_and_nothing_gives_nothing(spark):
    assert {k for _, want in CASES for k, _ in want} == set(outgoing.CHECKS)
    assert outgoing.findings(spark.createDataFrame([], SCHEMA), ["not clean", "another kind"]).collect() == []
