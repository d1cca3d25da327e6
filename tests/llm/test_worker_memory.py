"""Workers drop what they remember for a tokenizer once other operators run."""

import pyarrow as pa

from corpuslake.llm import common


def test_other_operators_drop_remembered_pieces(spark):
    def fill(batches):
        from corpuslake.llm import tokens

        tokens._open["x"] = None
        yield from batches

    def left(batches):
        from corpuslake.llm import tokens

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._open)] * b.num_rows)], names=["id"])

    one = spark.range(1).coalesce(1)
    assert common.map_arrow(common.map_arrow(one, fill, "id long", remembers=True), left, "id long", remembers=True).first()[0] >= 0
    assert common.map_arrow(one, left, "id long").first()[0] == 0
