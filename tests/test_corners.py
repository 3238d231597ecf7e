"""Oriented corners and their descriptors against one array, and through a turn of the image."""

import numpy as np
import pytest
from tessella.operators import corners, matching
from tessella.operators import neighbourhood as N
from test_borders import pixels

SIZE = (96, 110)


@pytest.fixture(scope="module")
def image():
    """Blocks of different brightness: corners everywhere."""
    r = np.random.default_rng(5)
    a = np.kron(r.integers(0, 256, (12, 14)), np.ones((8, 8), int))[: SIZE[0], : SIZE[1]]
    return np.clip(a + r.integers(0, 6, a.shape), 0, 255)


def test_levels_and_quotas(spark, image):
    px = pixels(spark, image).cache()
    got = corners.detect(px, SIZE, wanted=40, levels=2, threshold=15).collect()
    assert {r.level for r in got} == {0, 1}
    for n, (scale, h, w) in enumerate(corners._levels(SIZE, 0.83, 2)):
        own = [r for r in got if r.level == n]
        level = px if n == 0 else N.resize_bilinear(px, SIZE[1], SIZE[0], w, h)
        peaks = sorted((-r.strength, r.y, r.x) for r in N.strict_peaks(N.fast_corners(level, 15, 9), "strength").collect())
        quota = max(10, int(40 / 1.83 * scale + 0.5))
        last = peaks[min(quota, len(peaks)) - 1][0]
        want = {(y, x) for s, y, x in peaks if s <= last and 18 <= x < w - 18 and 18 <= y < h - 18}
        assert {(r.y, r.x) for r in own} == want
        assert all(abs(r.y0 - r.y / scale) < 1e-9 and 0 <= r.angle < 360 for r in own)


def test_descriptors_equal_those_of_one_array(spark, image):
    px = pixels(spark, image).cache()
    found = corners.detect(px, SIZE, wanted=60, levels=1, threshold=15).cache()
    got = corners.describe(px, found, SIZE, levels=1).collect()
    assert len(got) == found.count() > 5
    kernel = [int(k * 0xFFFF) for k in N.gaussian_kernel(5, 2.0)]

    def blur(a):
        out = np.zeros_like(a)
        out[:, 2:-2] = np.minimum(sum(a[:, i : a.shape[1] - 4 + i] * k >> 16 for i, k in enumerate(kernel)), 255)
        return out

    smooth = blur(blur(image).T).T
    for r in got:
        turn = np.radians(r.angle)
        want = 0
        for i, (ax, ay, bx, by) in enumerate(corners.pattern()):
            c, s = np.float32(np.cos(turn)), np.float32(np.sin(turn))
            at = lambda x, y: smooth[r.y + corners._round(np.float32(x) * s + np.float32(y) * c), r.x + corners._round(np.float32(x) * c - np.float32(y) * s)]  # noqa: E731, B023
            want |= int(at(ax, ay) < at(bx, by)) << i
        assert bytes(r.bits) == want.to_bytes(32, "little")


def test_a_turned_image_matches_itself(spark, image):
    """After a quarter turn the same corners are found, and descriptors find their counterparts."""
    square = image[:96, :96]
    a, b = pixels(spark, square, 1), pixels(spark, np.rot90(square), 2)
    described = [corners.numbered(corners.describe(p, corners.detect(p, (96, 96), wanted=60, levels=1, threshold=15), (96, 96), levels=1)).cache() for p in (a, b)]
    place = [{r.vec_id: (r.y, r.x) for r in d.collect()} for d in described]
    best = [r for r in matching.nearest(described[1], described[0], 1, "hamming", own=True).collect() if r.distance < 40]
    assert len(best) >= 5
    right = sum(place[1][r.vec_id] == (95 - place[0][r.query_id][1], place[0][r.query_id][0]) for r in best)
    assert right >= 0.9 * len(best)
