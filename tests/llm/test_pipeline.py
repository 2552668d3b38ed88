"""The pipeline's stages on the smallest tables, against plain versions of what each must keep."""

import corpus_pipeline
from colloquy.llm import decontaminate, packing
from colloquy.llm.common import table, written
from tests.conftest import SF
from tests.llm.test_llm_operators import classes_by_hand, texts


def test_stages_keep_what_they_must(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "t")
        assert out.columns == docs.columns
        kept[name] = texts(docs), texts(out)
        docs = out
    before, after = kept["near_dedup"]
    assert {i for i, _ in after} == {i for i, (_, c) in classes_by_hand(before, 5).items() if i == c}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    before, after = kept["decontaminate"]
    found = decontaminate.Items(list(range(len(items))), [decontaminate.normal(t) for t in items], 0.05)
    assert {i for i, _ in after} == {i for i, t in before if not found.matches(decontaminate.normal(t))}
    before, after = kept["toxicity"]
    assert 0 < len(before) - len(after) < len(before) / 4
    before, after = kept["language"]
    assert len(after) >= 0.98 * len(before)
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in texts(docs)}


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == [c.split()[0] for c in packing.PACKED.split(", ")] and rows.count()


def test_nothing_in(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "t")
    assert docs.count() == 0
