import pytest
from pyspark.sql import functions as F
from railtide import session


def test_shared_dir_needs_a_name_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session())


def test_broadcast_by_measured_bytes(spark):
    df = spark.range(1000).select("id", F.lit("x" * 100).alias("text"), F.array(F.struct(F.lit(1).alias("a"), F.lit("s").alias("b"))).alias("xs"), F.lit(None).cast("string").alias("none"))
    size = session.total_bytes(df)
    assert 1000 * 120 <= size <= 1000 * 250
    hint = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hint(session.broadcast_if_small(df)) and not hint(session.broadcast_if_small(df, size - 1))
    assert session.total_bytes(df.limit(0)) == 0
