"""Borders, tiles and sizes: what the tables of the oracle are too small or too regular to show."""

import numpy as np
import pytest
from tessella.operators import neighbourhood as N
from tessella.operators import regions
from tessella.operators.tiles import over_tiles


def pixels(spark, a, img=1):
    h, w = a.shape
    rows = [(img, y, x, int(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img int, y int, x int, v int").repartition(4)


def grid(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def test_xor_with_the_pixel_above(spark):
    """Across a tile's border, in the first row, and below a missing cell."""
    a = np.random.default_rng(5).integers(0, 256, (300, 3))
    px = pixels(spark, a).where("NOT (y = 128 AND x = 1)")
    a[128, 1] = 0
    want = a ^ np.vstack([np.zeros((1, 3), int), a[:-1]])
    got = {(r.y, r.x): r.v for r in N.xor_above(px).collect()}
    assert got == {(y, x): int(want[y, x]) for y in range(300) for x in range(3) if (y, x) != (128, 1)}


def test_a_flat_image_has_no_edges(spark):
    px = pixels(spark, np.full((6, 6), 100))
    for name in N.KERNELS:
        assert {r.v for r in N.edges(px, name, (6, 6)).collect()} == {0}
    assert {(r.gx, r.gy) for r in N.differences(px, (6, 6)).collect()} == {(0, 0)}
    assert N.canny(px, 0, 1, (6, 6)).count() == 0
    assert N.canny(px, 0.5, 1.0, (6, 6), of_mean=True).count() == 0


@pytest.mark.parametrize("border", N.BORDERS)
def test_border_modes(spark, border):
    a = np.random.default_rng(1).integers(0, 256, (7, 9))
    k = [(dy, dx) for dy in (-2, -1, 0, 1, 2) for dx in (-1, 0, 1)]
    got = {(r.y, r.x): r.s for r in N.correlate(pixels(spark, a), k, list(range(15)), (7, 9), border=border).collect()}
    for y in range(7):
        for x in range(9):
            if 2 <= y < 5 and 1 <= x < 8:
                assert got[y, x] == sum(w * a[y + dy, x + dx] for w, (dy, dx) in enumerate(k))
            else:
                assert got.get((y, x)) == {"zero": 0, "replicate": a[y, x], "ignore": None}[border]


def test_tiles_meet(spark):
    """An image over several tiles gives what one array gives."""
    a = np.random.default_rng(2).integers(0, 256, (150, 300))
    want = np.zeros(a.shape)
    want[1:-1, 1:-1] = sum(a[1 + dy : 149 + dy, 1 + dx : 299 + dx] for dy, dx in N.NINE)
    assert (grid(N.correlate(pixels(spark, a), N.NINE, [1] * 9, a.shape), a.shape, "s") == want).all()
    pad = np.pad(a, 1, mode="edge")
    low = np.minimum.reduce([pad[1 + dy : 151 + dy, 1 + dx : 301 + dx] for dy, dx in N.NINE])
    assert (grid(N.morph(pixels(spark, a), "erode"), a.shape) == low).all()


def test_tiles_send_margins_alone(spark):
    seen = spark.sparkContext.accumulator(0)
    a = np.zeros((256, 256), int)

    def work(t):
        seen.add(int(t.whole.sum()))
        return t.there(), {"v": t.near(0, 0).astype(np.int32)}

    assert over_tiles(pixels(spark, a), 2, work, "v int").count() == a.size
    assert seen.value < 1.1 * a.size


def test_thresholds_at_the_frame(spark):
    a = np.full((9, 9), 100)
    plain = grid(N.local_mean_threshold(pixels(spark, a), 3, 4, (9, 9)), a.shape)
    assert (plain == 255).all()
    turned = grid(N.local_mean_threshold(pixels(spark, a), 3, 0, (9, 9), most=7, invert=True), a.shape)
    # a fixed-point mean is a little below the pixels, so nothing is at or below it
    assert (turned == 0).all()
    with pytest.raises(ValueError):
        N.mean_kernel(4)


def flood(mask):
    """Regions by flooding, numbered in order of first pixels."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            out[y, x] = n
            while todo:
                a, b = todo.pop()
                for dy, dx in N.NINE:
                    c, d = a + dy, b + dx
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not out[c, d]:
                        out[c, d] = n
                        todo.append((c, d))
    return out


@pytest.mark.parametrize("share", [0.3, 0.42, 0.7])
def test_regions_over_tiles(spark, share):
    mask = np.random.default_rng(int(share * 100)).random((40, 50)) < share
    mask[20, :] = share < 0.4  # a line through all tiles
    px = pixels(spark, mask.astype(int)).where("v = 1")
    assert (grid(regions.label(px, tile=8), mask.shape, "label") == flood(mask)).all()
    want = regions.regions_of(mask)
    assert ((want >= 0) == mask).all() and len(np.unique(want[mask])) == flood(mask).max()
