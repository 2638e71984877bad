from pyspark.sql import functions as F

from wareloom.functions import values


def plain(n):
    if n is None:
        return "?"
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB"


def test_sizes_round_halves_to_even(spark):
    sizes = [None, 0, 1023, 1024, 1280, 1792, 2304, 1075, 1076, 1024**2 - 1, 1024**2, 5 * 2**18, 7 * 2**18, 5 * 2**18 + 1, 10**12, *range(2000, 9000, 37)]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", values.human_bytes(F.col("n")).alias("size")).collect()
    assert [r.size for r in rows] == [plain(n) for n in sizes]
