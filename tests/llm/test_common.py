from pathlib import Path

from docketmill.llm import common


def test_cut_reads_back_and_sweep_leaves_nothing(spark):
    folder = Path(common.shared_folder(spark).removeprefix("file://"), "docketmill")
    frame = spark.createDataFrame([(1, "a"), (None, None)], "k long, t string")
    kept = common.cut(frame)
    assert sorted(map(str, kept.collect())) == sorted(map(str, frame.collect())) and kept.schema == frame.schema
    other = common.cut(frame.limit(0))
    assert other.collect() == []
    common.drop(kept)
    assert len(list(folder.glob("*/*"))) >= 1
    common.sweep(spark)
    assert not list(folder.glob("*/*"))


def test_small_looks_at_the_size(spark):
    text = lambda f: f._jdf.queryExecution().optimizedPlan().toString()
    few = spark.range(10)
    assert "ResolvedHint" in few.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    assert common.small(few, 9) is few and common.small(few, 10) is not few and text(few)


def test_slices_keep_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    assert [v for s in common.slices(iter([batch])) for v in s.column("x").to_pylist()] == list(range(1000))
