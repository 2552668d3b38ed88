"""What the classifiers' stages of the pipeline hold in a task."""

import tracemalloc

import numpy as np

import corpus_pipeline
from colloquy.llm import language, toxicity
from colloquy.llm.common import WHILE_WRITTEN


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_batch_of_chunks_stays_small():
    draw, h = np.random.default_rng(2), 8
    net = language.Network([str(k) for k in range(8)], language.Direction.new(draw, h), language.Direction.new(draw, h), draw.standard_normal((2 * h, 8)).astype("f4"), np.zeros(8, "f4"))
    texts = [draw.integers(97, 123, n, np.uint8).tobytes() for n in (600_000, 0, 5, 3000)]
    assert peak_mb(lambda: language.pooled(net, texts, 256, 16)) < 70
    assert np.allclose(language.pooled(net, texts, 256, 16), language.pooled(net, texts, 256, 16, batch=2048), atol=1e-6)


def test_windows_are_settled_in_small_parts():
    """The gaps of all windows are the same, however many are compressed at a time."""
    words = [f"w{k}" for k in range(90_000)]
    gaps, sizes = toxicity.Gaps(toxicity.wide(words[:300]), toxicity.wide(words[:100])), []
    saved = toxicity.Gaps.saved

    class Noted(toxicity.Gaps):
        def saved(self, parts):
            sizes.append(len(parts))
            return saved(self, parts)

    (found,) = Noted(gaps.toxic, gaps.ordinary).of([" ".join(words)])
    assert len(found) == len(words) - 1 and max(sizes) <= 50_000
    assert (found[:200] == gaps.of([" ".join(words[:201])])[0]).all()


def test_classifier_stages_run_on_small_batches(spark, monkeypatch):
    """Both stages pass Python batches of 8 MB, though whoever writes their result sets nothing."""
    held = []

    def noted(docs, *_):
        return docs.where("doc_id is not null")

    def write(df, name):
        held.append(name)
        return df

    monkeypatch.setattr(corpus_pipeline, "written", write)
    for name in ("drop_toxic", "drop_undetermined", "fit_toxicity", "fit_language"):
        monkeypatch.setattr(corpus_pipeline, name, noted)
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    corpus_pipeline.toxicity(spark, docs, "")
    corpus_pipeline.language(spark, docs, "")
    assert held == ["stage-toxicity", "stage-language"] and WHILE_WRITTEN["spark.sql.execution.arrow.maxBytesPerBatch"] == "8m"
