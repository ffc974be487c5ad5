"""Fields of annotation reports that hold a list."""

import json

from strandflow.operators import nested


def test_field_of_several_values_is_null(spark):
    features = [{"type": "cds", "product": ["a", "b"], "locus": ["x"]}, {"type": "cds", "product": "c"}]
    text = json.dumps({"features": features})
    df = spark.createDataFrame([(1, text), (1, text)], "report_id long, payload string")
    flat = nested.flat_table(nested.label_nodes(df, "report_id", "payload"), "features", ["type", "product", "locus"])
    assert {(r.position, r.type, r["product"], r.locus) for r in flat.collect()} == {(0, "cds", None, "x"), (1, "cds", "c", None)}
