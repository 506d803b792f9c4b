"""Constants in one place, bounds that raise, shares, and draws by jumps."""

import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veristrata import config
from veristrata.functions import columns as K
from veristrata.operators import gates, resample


def test_prespecified_constants_stand_in_one_place():
    """No other module assigns a name of the thresholds."""
    names = {n for n in vars(config) if n.isupper()}
    root = Path(config.__file__).parent
    for path in root.rglob("*.py"):
        if path.name == "config.py" or "llm" in path.parts:
            continue
        assigned = {t.id for node in ast.parse(path.read_text()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name)}
        assert not assigned & names, path


def test_bounds_raise():
    """G10, G15."""
    gates.at_least(3, 3, "rows")
    with pytest.raises(gates.GateError):
        gates.at_least(2, 3, "rows")
    gates.near(1.0, 1.001, 0.01, "share")
    with pytest.raises(gates.GateError):
        gates.near(1.0, 1.1, 0.01, "share")


def test_shares_of_nothing(spark):
    """H15."""
    t = spark.createDataFrame([(1, 4), (0, 0), (3, 3)], "k int, n int")
    assert [r[0] for r in t.select(K.percent(F.col("k"), F.col("n"))).collect()] == [25.0, 0.0, 100.0]


def test_jumps_equal_steps():
    """The state after any number of steps, and draws that begin anywhere."""
    state, mask = 12345, (1 << 64) - 1
    states = [state]
    for _ in range(300):
        states.append((states[-1] * resample.LCG_MULTIPLIER + resample.LCG_INCREMENT) & mask)
    assert [resample.lcg_jump(state, k) for k in (0, 1, 2, 77, 300)] == [states[k] for k in (0, 1, 2, 77, 300)]
    whole = [(s >> 33) % 1000 for s in states[1:]]
    assert resample.lcg_draws(state, 0, 300, 1000).tolist() == whole and resample.lcg_draws(state, 123, 50, 1000).tolist() == whole[123:173] and resample.lcg_draws(state, 5, 0, 7).tolist() == []
