"""Stable regions against thresholds tried one by one."""

import numpy as np
import pytest
from tessella.operators import stable
from tessella.operators.regions import regions_of
from test_borders import pixels


def tree_by_thresholds(a):
    """Every region of every threshold once: {pixels: the first level at which it is there}."""
    out = {}
    for level in sorted(set(a.ravel().tolist())):
        named = regions_of(a <= level)
        for r in np.unique(named[named >= 0]).tolist():
            out.setdefault(frozenset(np.flatnonzero(named.ravel() == r).tolist()), level)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tree_and_stable_regions(seed):
    r = np.random.default_rng(seed)
    a = np.kron(r.integers(0, 12, (4, 5)), np.ones((3, 3), int)) * 8 + r.integers(0, 5, (12, 15))
    tree, want = stable.Tree(a), tree_by_thresholds(a)
    parent = np.array(tree.parent)
    sets = []
    for i in range(len(parent)):
        inside = {i}
        for k in range(i - 1, -1, -1):
            if parent[k] in inside:
                inside.add(k)
        sets.append(frozenset(p for p, of in enumerate(tree.pixel.tolist()) if of in inside))
    assert {s: level for s, level in zip(sets, tree.level, strict=True)} == want and [len(s) for s in sets] == tree.area
    for i, p in enumerate(tree.parent):
        above = [s for s in want if sets[i] < s]
        assert (sets[p] == min(above, key=len)) if above else p == -1
    for delta in (1, 6):
        for i, change in stable.stable_regions(tree, delta, 4, 120, 0.5, 0.2):
            later = max((s for s, level in want.items() if sets[i] <= s and level <= tree.level[i] + delta), key=len)
            assert change == (len(later) - len(sets[i])) / len(sets[i]) <= 0.5 and 4 <= len(sets[i]) <= 120


def test_dark_squares_are_found(spark):
    a = np.full((40, 60), 200)
    a[5:15, 5:15], a[20:30, 30:45] = 20, 60
    a += np.random.default_rng(1).integers(0, 4, a.shape)
    got = stable.regions(pixels(spark, a), (40, 60), delta=5).collect()
    boxes = {(r.left, r.top, r.right, r.bottom): r for r in got}
    assert set(boxes) == {(5, 5, 14, 14), (30, 20, 44, 29)}
    assert {r.area for r in got} == {100, 150} and sorted(r.region for r in got) == [1, 2]
    assert boxes[5, 5, 14, 14].m10 == 100 * 9.5
