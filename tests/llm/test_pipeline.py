import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from docketmill.llm import decontaminate, secrets, simhash, toxicity  # noqa: E402

rnd = random.Random(12)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("tables"))
    item, rows = text(40), []
    for i in range(300):
        t = text(60 + i % 50)
        rows.append((i, t + " zorkish vlerp" if i % 6 == 0 else t, "en", "a", len(t)))
    rows += [(1000 + i, rows[1][1], "en", "a", 0) for i in range(20)] + [(1000, rows[1][1], "en", "a", 0)]
    rows += [(2000 + i, f"{text(30)} {item} {text(10)}", "en", "a", 0) for i in range(5)]
    rows += [(3000 + i, f"{text(40)} token = \"{'0123456789abcdef' * 2}{i:08d}\" {text(20)}", "en", None, 0) for i in range(5)]
    rows += [(4000, None, None, None, None), (4001, "", "en", "a", 0), (None, text(50), "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([(0, item), (1, text(30))], "item_id long, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def groups_of(rows):
    """Groups of texts that share four fifths of their five-word shingles, by comparing all pairs."""
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)]) for r in rows for w in [(r.text or "").lower().split()]]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return len({find(i) for i in range(len(sets))})


def test_each_stage_takes_effect_and_keeps_clean_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    states = [before]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = corpus_pipeline.cut(out)
        states.append(docs.collect())
    ids = [{r.doc_id for r in s} for s in states]
    assert len({i for i in range(0, 300, 6)} & ids[1]) < 8 and len(ids[0] - {*range(0, 300, 6)} - ids[1]) < 8
    scored = toxicity.score(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(states[1]) == scored.where("predicted = 0").count()
    group = [i for i in (1, *range(1000, 1020)) if i in ids[1]]
    assert [i for i in group if i in ids[2]] == group[:1]
    assert len(states[2]) == groups_of(states[1])
    assert ids[2] - ids[3] == {i for i in ids[2] if i in range(2000, 2005)} and len(states[2]) - len(states[3]) == 5
    assert decontaminate.contamination(spark.createDataFrame(states[3], SCHEMA), spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    assert len(states[4]) == len(states[3])
    old = {r.doc_id: r for r in states[3]}
    for r in states[4]:
        if r.doc_id in range(3000, 3005):
            assert "0123456789" not in r.text and "[redacted]" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == old[r.doc_id].text and r.n_chars == (len(r.text) if r.text is not None else None)


def test_run_packs_what_the_stages_leave(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in rows}
    assert not kept & {*range(2000, 2005)} and len(kept & {1, *range(1000, 1020)}) == 1 and len(kept) > 200


def test_redaction_joins_overlapping_spans_and_leaves_the_rest(spark):
    key = "0123456789abcdef0123456789abcdef"
    rows = [(1, f'token = "{key}" é {key}{key} end'), (2, f"{key}"), (3, None), (4, "clean é"), (5, f"{key} x {key}"), (6, "")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    mark = "[redacted]"
    assert got == {1: f'{mark}" é {mark} end', 2: mark, 3: None, 4: "clean é", 5: f"{mark} x {mark}", 6: ""}


def test_redaction_keeps_columns_whatever_their_names(spark):
    rows = [(1, "0123456789abcdef0123456789abcdef", "a", "b", 3, 4)]
    names = ["doc_id", "text", "__docketmill_least", "found_0_tested", "Found_1_spans", "least"]
    got = secrets.redact(spark.createDataFrame(rows, names)).collect()
    assert [tuple(r) for r in got] == [(1, "[redacted]", "a", "b", 3, 4)]


def test_empty_documents(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
