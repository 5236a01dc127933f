import math
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.linkage_spec import dice as dice_spec
from tests.linkage_spec import popcount as popcount_spec
from tests.linkage_spec import smc as smc_spec
from veilmatch import session
from veilmatch.functions import all_equal, clk_words, dice, get_bit, logand_count, popcount, py_floordiv, smc


@pytest.mark.parametrize("n_bytes", [1, 3, 7, 8, 9, 16, 25])
def test_words_and_coefficients(spark, n_bytes):
    rng = random.Random(n_bytes)
    rows = [(rng.randbytes(n_bytes), rng.randbytes(n_bytes)) for _ in range(20)]
    rows += [(bytes(n_bytes), bytes(n_bytes)), (b"\xff" * n_bytes, bytes(n_bytes)), (b"\xff" * n_bytes, b"\xff" * n_bytes), (b"\x80" + bytes(n_bytes - 1), bytes(n_bytes - 1) + b"\x01")]
    df = spark.createDataFrame(rows, "x binary, y binary")
    a, b = clk_words(F.col("x"), n_bytes), clk_words(F.col("y"), n_bytes)
    got = df.select("x", "y", popcount(a).alias("p"), dice(a, b).alias("d"), smc(a, b, 8 * n_bytes).alias("s"), logand_count(a, b).alias("c"), get_bit(a, n_bytes * 8 - 3).alias("bit"), get_bit(a, 1).alias("bit1")).collect()
    for r in got:
        assert r["p"] == popcount_spec(r["x"])
        assert r["d"] == dice_spec(r["x"], r["y"])
        assert r["s"] == smc_spec(r["x"], r["y"])
        assert r["c"] == popcount_spec(bytes(i & j for i, j in zip(r["x"], r["y"])))
        assert r["bit"] == r["x"][-1] >> 2 & 1 and r["bit1"] == r["x"][0] >> 6 & 1


def test_python_floor_division(spark):
    rng = random.Random(3)
    values = [rng.uniform(-20, 20) for _ in range(500)] + [i * 0.05 for i in range(-400, 400)] + [0.0, -0.1, 0.1, 0.3]
    for y in (0.1, 0.3, 6.0):
        got = spark.createDataFrame([(v,) for v in values], "x double").select("x", py_floordiv(F.col("x"), y).alias("q")).collect()
        assert [r["q"] for r in got] == [r["x"] // y for r in got]
    with pytest.raises(ValueError):
        py_floordiv(F.col("x"), 0)


def test_smc_needs_bits_and_all_equal(spark):
    with pytest.raises(ZeroDivisionError):
        smc([], [], 0)
    assert all_equal(spark.createDataFrame([(1,), (1,)], "x int"), "x")
    assert not all_equal(spark.createDataFrame([(1,), (2,)], "x int"), "x")
    assert all_equal(spark.createDataFrame([], "x int"), "x")
    assert math.isclose(2 * 3 / 7, 6 / 7)


@pytest.mark.parametrize("module", ["plans.product", "operators.candidates", "operators.solving", "operators.similarity", "functions.bits", "sources.pairs", "session", "queries"])
def test_modules_import_first(module):
    """A Python worker may start with any module."""
    subprocess.run([sys.executable, "-c", f"import veilmatch.{module}"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_intermediate_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    held = session.write_table(spark.range(5).toDF("x"), "kept")
    folder = os.path.dirname(held.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert held.count() == 5 and os.path.exists(folder)
    session.drop_tables(spark)
    assert not os.path.exists(folder)
