import duckdb
import pytest

import __spark_entry__ as entry
from oracle import differences


@pytest.mark.parametrize("name", ["routed_messages", "undo_requests"])
def test_a_word_does_not_end_at_an_accented_letter(spark, tmp_path, name):
    texts = ["We say undoñ 7 and on.", "éundo 4 it", "undo 5 and 3. Not 9", "please undo", "undo. 8", "récheck", "reviewé", "undó 6", "undo_2", "UNDO 12\n13", "ócompare", "compare it"]
    rows = [(i, 1 if i % 2 else 3, "user", t) for i, t in enumerate(t for t in texts for _ in range(2))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert differences(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == ""
    found = {r.msg_id: r[1] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    undone = {k: v for k, v in found.items() if v == "wish: undo" or name == "undo_requests"}
    assert {k // 100 for k in undone if (k // 100) % 2 == 0} == {4, 6, 8, 18}
