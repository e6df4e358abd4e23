from pyspark.sql import types as T

from waymill.sources.jsonl import hidden_leaks, read_jsonl


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n  \nnot json\n[1]\n{"n": 3}\n{"id": "4"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    good, bad = read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, "id")
    assert sorted(map(tuple, good.collect()), key=str) == [("1", 2), ("4", None)]
    assert sorted((r.value, r.fault) for r in bad.collect()) == [("[1]", "not_an_object"), ("not json", "not_an_object"), ('{"n": 3}', "missing_key")]


def test_hidden_leaks(spark):
    df = spark.createDataFrame([('{"a": 1}', "x"), ('{"reward": 1}', "y"), (None, "z")], "j string, Oracle string")
    r = hidden_leaks(df, ["reward", "oracle"], ["j"]).first()
    assert r.denied_columns == ["Oracle"] and r.n == 3 and r.leaks_j == 1
