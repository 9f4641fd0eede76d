"""What Python workers hold of the texts that they have worked on."""

import resource
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import common, ngram_join, packing, tokens  # noqa: E402


@pytest.mark.parametrize("kind", [tokens.Ids, tokens.PieceIds])
def test_pretokens_are_kept_in_bounded_memory(kind):
    ids = kind()
    ids.encode(pa.array([" x"]))
    tracemalloc.start()
    try:
        for k in range(25):
            ids.encode(pa.array([" " + " ".join(f"{k * 20000 + i:x}q" for i in range(20000))]))
        assert tracemalloc.get_traced_memory()[0] < 40 << 20
        ids.forget()
        assert tracemalloc.get_traced_memory()[0] < 2 << 20
    finally:
        tracemalloc.stop()


def test_freed_memory_goes_back():
    def held():
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() >> 20

    most, last = [], []

    def work(batches):
        for batch in batches:
            own = [np.ones(100) for _ in range(250_000)]
            last.append(np.ones(100))  # the heap's end stays in use
            most.append(held())
            del own
            yield batch

    before = held()
    assert sum(1 for _ in common.lean(work)(iter([pa.record_batch({"x": [1]})]))) == 1
    assert most[0] > before + 150 and held() < before + 80


def test_batches_of_texts_are_small(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    for run in (ngram_join.ngram_join, packing.pack_documents):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        assert run(docs).count() == 2
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
