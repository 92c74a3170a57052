"""Inputs that the queries derive from the given tables."""

from workload import base


def test_lookup_makes_the_texts_of_the_checking_sql(spark):
    rows = [(k, k % 7 + 1, 3 * k, k % 11, k % 50) for k in range(400)] + [
        tuple(None if i == j else 57 for j in range(5)) for i in range(5)
    ] + [(109, None, None, 0, 5), (109, 3, None, 4, None), (-5, 1, -9, 2, 3)]
    schema = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity decimal(15,2)"
    made = spark.createDataFrame(rows, schema.replace("decimal(15,2)", "int"))
    for both in (base.code_path, base.code_text):
        got = made.selectExpr(f"{both(base.choice_sql)} AS was", f"{both(base.choice_lookup)} AS now")
        assert got.where("NOT was <=> now").collect() == []
        assert got.where("was IS NOT NULL").count() > 390


def test_texts_of_code_are_neither_moved_nor_written(spark, tables, tmp_path):
    sf = "/root/testdata/sf0.001"
    for files in (base.corpus(spark, sf),):
        plan = files._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        read = {f.split("file:")[-1].rsplit("/", 1)[0] for f in files.inputFiles()}
        for folder in read:
            kinds = {k for _, k in spark.read.parquet(folder).dtypes}
            assert "string" not in kinds
    assert files.count() == tables("lineitem").count()


def test_versions_of_all_parts_are_keyed_by_many_tasks(spark):
    from workload.dependencies import version_grammars

    sf = "/root/testdata/sf0.001"
    assert len(base.table(spark, sf, "part").inputFiles()) == 1
    assert len(version_grammars(spark, sf).inputFiles()) > 1


def test_streamed_code_is_not_written(spark):
    """The stream picks up rows of the table; neither texts nor what the query does not read are written."""
    from pathlib import Path

    from workload.registry import QUERIES

    base_dir = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(base_dir.iterdir())
    found = QUERIES["scan_stream"](spark, "/root/testdata/sf0.001")
    assert found.count() > 1000
    folders = {f.parent for new in set(base_dir.iterdir()) - before for f in new.rglob("*.parquet")}
    assert folders and all({"code", "vulnerable_code"}.isdisjoint(spark.read.parquet(str(f)).columns) for f in folders)
