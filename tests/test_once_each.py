"""Equal values are worked once, whatever their number; rows and nulls stay."""

from pyspark.sql import functions as F

from wattlore.functions.steps import once_each


def test_equal_values_are_worked_once(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i % 3}") for i in range(50)], "n int, s string")
    for few in (100, 1):
        seen = spark.sparkContext.accumulator(0)

        @F.udf("int")
        def length(s):
            seen.add(1)
            return -1 if s is None else len(s)

        got = once_each(rows, "s", lambda x: x.withColumn("k", length("s")), ["k"], few).collect()
        assert sorted((r.n, r.k) for r in got) == [(i, -1 if i % 5 == 0 else 2) for i in range(50)]
        assert seen.value == 4
