"""Versions of a table, YAML items, and table functions in SQL."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import table_functions
from lodestone.sources import readers, versions


def values(df):
    return sorted(r[0] for r in df.collect())


def test_rewrite_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.write(spark.range(5).toDF("x"), path) == 1
    old = versions.read(spark, path)
    assert versions.rewrite(spark, path, lambda df: df.select((F.col("x") * 10).alias("x"))) == 2
    assert values(versions.read(spark, path)) == [0, 10, 20, 30, 40]
    # Who reads the old version goes on.
    assert values(old) == values(versions.read(spark, path, 1)) == [0, 1, 2, 3, 4]
    assert versions.numbers(spark, path) == [1, 2]


def test_a_writer_that_fails_leaves_the_table_as_it_is(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(5).toDF("x"), path)
    broken = spark.range(5, numPartitions=5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("disk full"))).cast("long").alias("x"))
    with pytest.raises(Exception, match="disk full"):
        versions.write(broken, path)
    assert versions.numbers(spark, path) == [1] and values(versions.read(spark, path)) == [0, 1, 2, 3, 4]
    versions.write(spark.range(2).toDF("x"), path)
    assert values(versions.read(spark, path)) == [0, 1]
    gone = versions.vacuum(spark, path, keep=1)
    assert len(gone) == 2 - (not (tmp_path / "t").exists()) and versions.numbers(spark, path) == [2] and values(versions.read(spark, path)) == [0, 1]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 1)


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write(spark.range(5).toDF("x"), path)
    one, two = versions.read(spark, path), versions.read(spark, path)
    versions.write(one.where("x > 2"), path, after=1)
    with pytest.raises(versions.ConflictError):
        versions.write(two.where("x < 2"), path, after=1)
    assert values(versions.read(spark, path)) == [3, 4] and versions.vacuum(spark, path, keep=5) == []


def test_yaml_items(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "good.yaml").write_text("letters:\n- {id: 1, text: a}\n- {id: 2}\n- just text\n- {id: 4, text: d, extra: x}\n- {id: five, text: e}\n")
    (tmp_path / "list.yml").write_text("- {id: 6, text: 'é: f'}\n")
    (tmp_path / "broken.yaml").write_text("letters: [")
    (tmp_path / "empty.yaml").write_text("")
    schema = "id int, text string"
    got = sorted(((r.id, r.text) for r in readers.read_yaml(spark, str(tmp_path), schema, required=("text",)).collect()), key=str)
    assert got == [(1, "a"), (4, "d"), (6, "é: f"), (None, "e")]
    bad = {(r._file.rsplit("/", 1)[1], r._error) for r in readers.read_yaml(spark, str(tmp_path), schema, required=("text",), errors=True).where("_error IS NOT NULL").collect()}
    assert bad == {("good.yaml", "item 2 lacks text"), ("good.yaml", "item 3 is no mapping"), ("broken.yaml", "not YAML")}


def test_table_functions(spark):
    assert table_functions.register(spark) == ["flatten_pairs", "flatten_json", "collect_texts", "word_count", "content_id", "bond_index"]
    pairs = [(1, json.dumps([["a", "b"], "c", ["d", ["e"]]]), json.dumps([["A"], ["C1", "C2"], ["D", "E"]])), (2, None, json.dumps(["x"])), (3, "{", None), (4, "[]", "[]")]
    spark.createDataFrame(pairs, "id int, a string, b string").createOrReplaceTempView("pairs")
    got = [tuple(r) for r in spark.sql("SELECT id, f.* FROM pairs, LATERAL flatten_pairs(a, b) f ORDER BY id, path").collect()]
    assert got == [(1, "1.1", "a", "A"), (1, "2.1", None, "C1"), (1, "2.2", None, "C2"), (1, "3.1", "d", "D"), (1, "3.2.1", "e", None), (2, "1", None, "x")]
    document = json.dumps({"a": [1, {"b": True, "c": None}], "d": "x", "e": []})
    flat = spark.sql("SELECT * FROM flatten_json(:j)", {"j": document}).collect()
    assert [tuple(r) for r in flat] == [("a.1", "number", "1"), ("a.2.b", "boolean", "true"), ("d", "text", "x")]
    texts = json.dumps({"content": "z" * 30, "text": ["x" * 30, {"he": "y" * 30}], "other": "n" * 30})
    assert [r.text[0] for r in spark.sql("SELECT * FROM collect_texts(:j, 3, 20)", {"j": texts}).collect()] == ["x", "y", "z"]
    assert [r.text[0] for r in spark.sql("SELECT * FROM collect_texts(:j, 2, 20)", {"j": texts}).collect()] == ["x", "z"]
    assert spark.sql("SELECT word_count('  a b\tc '), bond_index(1, 2, 2.0D), bond_index(0, 0, 1.0D), word_count('')").first()[:] == (3, 0.25, 0.0, 0)
