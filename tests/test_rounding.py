"""Numbers as text, and remainders, are those of the SQL to the last bit."""

import math

from pyspark.sql import functions as F

from tonewright.functions import scalars as S
from tonewright.operators import grid as G
from tonewright.sources.notes import ANCHOR, SIX


def test_human_bytes_rounds_ties_to_even(spark):
    sizes = [1088, 1152, 41156608, 42205184, 1073741824 + 1073741824 // 4, 1023, 1048575, 0, 5 * 1024**4 // 4]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(S.human_bytes(F.col("n"))).collect()]
    assert got == ["1.1KB", "1.1KB", "39.2MB", "40.2MB", "1.2GB", "1023B", "1024.0KB", "0B", "1.2TB"]


def test_fixed_rounds_the_binary_value(spark):
    """Times of which the fifth decimal is a five alone: whether they lie above or below the half is in their bits."""
    times = [(k * 1_000_000 + 500_000) / 1e10 for k in range(0, 3_000_000, 997)] + [0.0, 0.03125, 0.09375, 1234567.5, -0.00015]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in times], "x double").coalesce(1).select(S.fixed(F.col("x"), 4)).collect()]
    assert got == ["%.4f" % x for x in times]


def test_signed_has_the_bits_of_the_sql(spark):
    times = [ANCHOR + k * SIX + v / 1000 for k in range(0, 2000, 7) for v in (-2, -1, 0, 1, 2)]
    rows = spark.createDataFrame([(x,) for x in times], "x double").coalesce(1)
    got = [r[0] for r in rows.select(G.signed(F.col("x"), F.lit(ANCHOR), F.lit(SIX))).collect()]
    moved = [x - ANCHOR + SIX / 2 for x in times]
    assert got == [x - SIX * math.floor(x / SIX) - SIX / 2 for x in moved]
