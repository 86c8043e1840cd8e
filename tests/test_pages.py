from __future__ import annotations

import time

from pyspark.sql import functions as F

from quirekit.functions import lines
from quirekit.operators import pages


def test_long_text_against_itself(spark):
    text = "\n".join(f"line number {i} of a long source text with words" for i in range(42_000))
    frame = spark.createDataFrame([(text,)], "t string")
    audit = frame.select(pages.text_layer_audit(F.col("t"), F.col("t")).alias("a")).first().a
    assert len(text) > 1_900_000 and (audit.length_coverage, audit.missing) == (1.0, 0)


def test_missing_lines_are_all_listed(spark):
    source = "\n".join(f"source line {i} that the output does not hold" for i in range(1000))
    rows = [(source, "something else"), (source, source.replace("\n", " ")), ("a line that stands here\nanother line that does not", "x\nA line that stands here\ny")]
    frame = spark.createDataFrame(rows, "s string, o string")
    got = [r.a for r in frame.select(pages.text_layer_audit(F.col("s"), F.col("o")).alias("a")).collect()]
    assert [a.missing for a in got] == [1000, 0, 1] and len(got[0].missing_lines) == 1000
    assert got[2].missing_lines == ["another line that does not"]
    assert frame.select(F.size(pages.text_layer_audit(F.col("s"), F.col("o"), 5)["missing_lines"]).alias("n")).first().n == 5


def test_cutting_takes_linear_time(spark):
    def seconds(size: int) -> float:
        frame = spark.createDataFrame([("x" * size,)], "t string").select(F.size(lines.fixed_slices(F.col("t"), 512)).alias("n"))
        start = time.perf_counter()
        assert frame.first().n == -(-size // 512)
        return time.perf_counter() - start

    seconds(1 << 20)
    assert seconds(1 << 22) < 8 * max(seconds(1 << 20), 0.25)
