import numpy as np
import pyarrow as pa

from logloom.llm import classlm as C


def test_copies_spread_over_buckets_and_homes(spark):
    """Texts alike but for their ids fill neither one bucket nor one home."""
    model = C.train(spark.createDataFrame([("a b c",)], "text string"))
    n = 1000
    batch = pa.record_batch({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(["a b c"] * n)})
    filed = list(C._file([batch], model, 10, 10, 0))
    assert max(len(b["doc_id"][0]) for b in filed) < n / 5
    homes = C._summed(pa.Table.from_batches(filed), 10)
    assert max(np.diff(homes["doc_id"].combine_chunks().offsets.to_numpy())) < n / 5
