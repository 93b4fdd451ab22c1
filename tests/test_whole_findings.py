"""Findings and verdicts are those of all checks, or none."""

import pytest
from pyspark.errors import PySparkException

from docketmill.operators import checks


def test_a_check_that_cannot_be_made_is_an_error_of_the_query_and_of_verdicts(spark, monkeypatch):
    from docketmill.plans import documents

    def broken(blocks):
        return blocks.select("nothing")

    frame = spark.createDataFrame([(1, 0, "All is well.")], "doc_id long, idx int, text string")
    with pytest.raises(PySparkException):
        checks.verdicts(checks.run_all(frame, [checks.blanks, broken]), frame).collect()
    assert [r.verdict for r in checks.verdicts(checks.run_all(frame, [checks.blanks]), frame).collect()] == ["clean"]
    monkeypatch.setattr(checks.run_all, "__defaults__", ([checks.blanks, broken],))
    for name in ("all_findings", "capped_findings", "document_verdicts", "findings_as_text"):
        with pytest.raises(PySparkException):
            documents.__dict__[name](spark, "/root/testdata/sf0.001").collect()
