"""Long texts reach Python few at a time."""

import pyarrow as pa
from pyspark.sql import functions as F

from streamwarden.llm import bpe
from streamwarden.session import prepare


def test_batches_and_slices_of_long_texts_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    texts = prepare(spark).range(0, 3000, 1, 1).select(F.repeat(F.col("id").cast("string"), 2000).alias("text"))
    found = [r.bytes for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert len(found) > 1 and max(found) < 5 << 20
    assert bpe.SLICE <= 4 << 20
