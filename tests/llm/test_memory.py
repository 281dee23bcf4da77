"""What a worker holds while it reads a batch."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from geoloom.llm import language_id


def test_language_id_holds_little_of_a_large_batch():
    """A worker held 230 MB besides a batch of 12 MB, as the labels of all its words were found at once."""
    rnd = np.random.default_rng(1)
    words = ["the", "house", "der", "garten", "und", "of", "river", "strasse"]
    texts = [" ".join(rnd.choice(words, 400)) for _ in range(6000)]
    model = language_id.fit(["the house of river".encode() * 20, "der garten und strasse".encode() * 20], ["en", "de"])
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "text": pa.array(texts)})
    assert batch.nbytes > 11 << 20
    tracemalloc.start()
    out = pa.Table.from_batches(language_id._predict(SimpleNamespace(value=model), 1, [0])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["id"].to_pylist() == list(range(len(texts))) and peak < 100e6


def test_large_rows_have_small_pages_and_row_groups(spark):
    """100 rows of a megabyte made one page, which writer, reader and codec hold as a whole."""
    import os
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    from geoloom.session import discard, materialize

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([os.urandom(1 << 20)])], ["id", "text"])

    d = materialize(spark.range(0, 60, 1, 1).mapInArrow(run, "id long, text binary"), "large-rows")
    (file,) = Path(d._geoloom_path.removeprefix("file:")).glob("*.parquet")
    about = pq.ParquetFile(file).metadata
    assert max(about.row_group(k).total_byte_size for k in range(about.num_row_groups)) <= 20 << 20
    assert d.count() == 60
    discard(d)
