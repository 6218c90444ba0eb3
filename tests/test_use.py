"""Use around contracts: decorators, rendering, suggestions, streams, Python checks."""

import pytest

from pactframe import Contract, SchemaError
from pactframe import functions as f
from pactframe.contract import ContractError, rendered, validated
from pactframe.operators.markers import Required


def test_decorated_functions(spark):
    @validated(df=Contract({Required("a"): f.Coerce(int)}), returns=Contract({"a": f.Range(max=5)}))
    def double(df, by=2):
        return df.selectExpr(f"a * {by} as a")

    assert [r.a for r in double(spark.createDataFrame([("2",)], "a string")).collect()] == [4]
    with pytest.raises(ContractError, match=r"a: coerce \(1\)"):
        double(spark.createDataFrame([("x",)], "a string"))
    with pytest.raises(ContractError, match="a: range"):
        double(spark.createDataFrame([("2",)], "a string"), by=9)
    with pytest.raises(SchemaError):
        validated(nothing=Contract({}))(double)


def test_rendered_and_suggestions(spark):
    df = spark.createDataFrame([([1, 9], "x")], "items array<int>, nmae string")
    c = Contract({"items": [f.Range(max=5)], Required("name"): str})
    assert c.apply(df).select(rendered().alias("t")).first().t.split("\n") == ["nmae: not_a_valid_option (extra_keys_not_allowed)", "name: required (required)", "items[1]: range_max (range)"]
    assert c.suggestions(df) == {"nmae": ["name"]}


def test_python_checks(spark, tmp_path):
    (tmp_path / "x").write_text("")
    (tmp_path / "l").symlink_to(tmp_path / "x")
    rows = [(str(tmp_path), str(tmp_path / "x"), str(tmp_path / "l"), "a+"), ("/no", "/no\0", "/no", "(")]
    c = Contract({"d": f.IsDir(), "f": f.IsFile(), "l": f.IsSymlink(), "r": f.IsRegex()})
    got = [[e["code"] for e in r.errors] for r in c.apply(spark.createDataFrame(rows, "d string, f string, l string, r string")).collect()]
    assert got == [[], ["not_a_directory", "not_a_file", "not_a_symlink", "value"]]


def test_streams_take_contracts(spark, tmp_path):
    spark.createDataFrame([(1,), (9,)], "a int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a int").parquet(f"{tmp_path}/in")
    query = Contract({"a": f.Range(max=5)}).valid(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.a for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [1]
