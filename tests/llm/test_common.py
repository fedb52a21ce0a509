import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrecall.llm import common


def test_slices_hold_about_so_many_bytes():
    texts = ["a" * 10, None, "b" * 100, "", "c", "d" * 30, "e" * 31]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.slices(batch, 1, 60, 3))
    assert [v for p in parts for v in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 60 for p in parts) and max(p.num_rows for p in parts) <= 3
    assert [p.num_rows for p in common.slices(batch, "text")] == [7] and not list(common.slices(batch.slice(0, 0), 1))


def test_a_cluster_needs_a_shared_folder():
    class Unset:
        def get(self, *_):
            return None

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"
            getConf = staticmethod(Unset)

        conf = Unset()

    with pytest.raises(ValueError):
        common.work_dir(Session)


def test_batches_by_bytes(spark):
    """Python tasks of a kept table get batches of bounded bytes, however large its rows are."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    was = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = common.keep(rows.mapInArrow(sizes, "rows long, bytes long"), "batch-sizes").collect()
    assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) < 12_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == was
