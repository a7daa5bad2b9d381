"""Gradients of pooled Haar coefficients against finite differences."""

import random

import pytest

from pointloom.plans import multirun, pooled_gradients


@pytest.mark.parametrize("of", ["d", "r"])
def test_pooled_haar_gradient_with_fractional_weights(spark, of):
    """Totals of a run that differ by rounding between levels are one total: nothing comes twice."""
    r = random.Random(3)
    rows = {c: [(i, r.randrange(65536), r.random() + 0.1) for i in range(n)] for c, n in (("d", 40), ("r", 120))}
    runs = multirun.plan(spark, [("a", 1.0, 0.0), ("b", 1.0, 0.3), ("c", 0.6, 0.1)])
    frames = lambda moved: {c: spark.createDataFrame([(i, x, w + (moved if c == of and i == 3 else 0.0)) for i, x, w in v], "id long, c0 long, w double") for c, v in rows.items()}
    settings = {"axes": ["c0"], "levels": [0, 1, 2]}

    def pooled(moved):
        f = frames(moved)
        return {(x.pool, x.pattern): x.mean_we2 for x in multirun.pooled_haar(multirun.run_haar_sums(f["d"], f["r"], runs, **settings), 0.02).collect()}

    f = frames(0.0)
    got = {(x.pool, x.pattern): x.value for x in pooled_gradients.pooled_haar_gradient(f["d"], f["r"], runs, of, **settings).where("id = 3").collect()}
    high, low = pooled(1e-5), pooled(-1e-5)
    assert got and got == pytest.approx({k: (high[k] - low[k]) / 2e-5 for k in got}, rel=1e-4, abs=1e-7)
