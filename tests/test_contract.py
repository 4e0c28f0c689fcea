import __spark_entry__ as contract

DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 1 and df.columns[0] == "n"


def test_registry():
    q, o = contract.queries(), contract.oracle_sql()
    assert len(q) > 150 and set(o) <= set(q)


def test_small_results_match(spark):
    """A few plans end to end; tools/check.py runs all of them next to the SQL."""
    q = contract.queries()
    split = q["time_split"](spark, DIR)
    log = q["interactions"](spark, DIR)
    assert split.count() == log.count()
    assert split.drop("split").exceptAll(log.select(*split.drop("split").columns)).count() == 0
    recs = q["user_cf_recommend"](spark, DIR)
    assert recs.join(log, ["user_id", "item_id"], "left_semi").count() == 0
