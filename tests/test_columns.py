import random

from arcloom.functions.columns import tenths


def test_tenths_rounds_as_c_does(spark):
    rng = random.Random(7)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 1.25, 2.5, 9.95, 9.949999, 99.95, 0.449999999, 3.0]
    values += [m / 20 for m in range(400)]
    values += [rng.randint(1, 10**10) / rng.randint(1, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", tenths(df.v).alias("text")).collect():
        assert row.text == f"{row.v:.1f}", row
