"""Kernel machines: optimality conditions, classes that no line parts, cross-validation, model files."""

import numpy as np
import pytest
from tessella.operators import machines


def rings(n=90, seed=1):
    r = np.random.default_rng(seed)
    label = np.arange(n) % 3
    turn, far = r.uniform(0, 2 * np.pi, n), label + 1 + r.normal(0, 0.08, n)
    return np.column_stack([far * np.cos(turn), far * np.sin(turn)]), label


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
def test_optimality(kernel):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(40, 3)), np.where(r.random(40) < 0.5, 1.0, -1.0)
    k = machines.products(x, x, kernel, 0.5, 1.0)
    alpha, offset = machines.solve(k, y, 2.0, 1e-6)
    assert abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= 2.0
    margin = y * (k @ (alpha * y) + offset)
    assert (margin[alpha < 1e-9] >= 1 - 1e-4).all() and (margin[alpha > 2.0 - 1e-9] <= 1 + 1e-4).all()
    assert np.allclose(margin[(alpha > 1e-9) & (alpha < 2.0 - 1e-9)], 1, atol=1e-4)


def test_classes_within_each_other(spark):
    x, label = rings()
    machine = machines.train(x, label, c=10.0, gamma=1.0)
    fresh, truth = rings(300, 7)
    assert (machine.predict(fresh) == truth).mean() > 0.98
    again = machines.Machine.from_json(machine.to_json())
    df = spark.createDataFrame([(i, v, int(t)) for i, (v, t) in enumerate(zip(fresh.tolist(), truth, strict=True))] + [(999, None, 0)], "vec_id long, e array<double>, label int")
    got = {r.vec_id: r.label for r in machines.predicted(df, again).collect()}
    assert [got[i] for i in range(300)] == machine.predict(fresh).tolist() and 999 not in got


def test_cross_validation(spark):
    x, label = rings()
    df = spark.createDataFrame([(i, v, int(t)) for i, (v, t) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, e array<double>, label int")
    table = machines.cross_validate(df, [(1.0, 1.0), (10.0, 1.0), (1.0, 1e-4)], folds=3)
    got = {(r.c, r.gamma): r.accuracy for r in table.collect()}
    assert got[1.0, 1e-4] < 0.7 < 0.95 < got[10.0, 1.0]
    assert machines.best_setting(table)[1] == 1.0
    with pytest.raises(ValueError):
        machines.train(x, label, rows=10)
