from pyspark.sql import functions as F

from quillstream.session import cut, salted_rank


def test_salted_rank_is_a_permutation(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 950, None).otherwise(F.col("id").cast("string")).alias("k"), "id")
    for per in (50_000, 100):
        r = salted_rank(df, ["k"], [F.col("id")], "pos", per)
        got = {}
        for x in r.collect():
            got.setdefault(x.k, []).append(x.pos)
        assert sorted(got["hot"]) == list(range(900)) and sorted(got[None]) == list(range(50))
        assert all(v == [0] for k, v in got.items() if k not in ("hot", None))
    assert salted_rank(df.where("false"), ["k"], [F.col("id")], "pos").count() == 0


def test_cut_uses_the_shared_folder(spark):
    assert cut(spark.range(5)).count() == 5
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from quillstream.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda key, default=None: default)})()})()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)
