"""What a worker holds while it looks at texts: little above the batch, whatever the batch holds."""

import tracemalloc

import numpy as np
import pyarrow as pa

from actiscope.llm import jaccard, langid, quality
from actiscope.llm.base import FINE_BYTES, kept, slices, trimmed, utf8


def test_language_stage_holds_little(spark):
    class Watched(langid.Model):
        def logits(self, data, at):
            tracemalloc.start()
            out = langid.Model.logits(self, data, at)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            if peak > 60e6:
                raise MemoryError(f"{peak / 1e6:.0f} MB for {len(data) / 1e6:.1f} MB of text")
            return out

    rows = np.random.default_rng(1).standard_normal((langid.BUCKETS, 4))
    model = Watched(["de", "en", "fr", "xx"], rows, np.zeros(4))
    d = spark.range(2500).selectExpr("id AS doc_id", "repeat(concat('wort zahl ', id, ' '), 150) AS text").coalesce(1)
    assert langid.accepted(d, model).count() == langid.identify(d, model).where("NOT rejected").count() == 2500


def test_kept_cuts_batches_finely(spark):
    def test(text):
        if text.nbytes > 2 * FINE_BYTES:
            raise MemoryError(text.nbytes)
        return np.arange(len(text)) >= 0

    d = spark.range(2500).selectExpr("id AS doc_id", "repeat(concat('wort zahl ', id, ' '), 150) AS text").coalesce(1)
    assert kept(d, "text", test).count() == 2500


def test_slices_change_no_result():
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}é"[: i % 7 + 1] + " ." * (i % 3) for i in range(500)])
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 900, 400)] + [None, "", "x"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BUCKETS, 3)), rng.standard_normal(3))
    parts = [b.column("text") for b in slices(iter([whole]), "text", 50_000)]
    assert len(parts) > 5
    for f in (lambda c: model.logits(*utf8(c)), lambda c: quality.statistics(*utf8(c)), lambda c: jaccard.shingle_sets(c, 3)[0], lambda c: jaccard.routes(*jaccard.shingle_sets(c, 3), 80, 100)[0][0]):
        np.testing.assert_array_equal(f(whole.column("text")), np.concatenate([f(p) for p in parts]))


def test_trimmed_is_the_same_work():
    assert list(trimmed(lambda x: (i + 1 for i in x))(iter([1, 2]))) == [2, 3]
