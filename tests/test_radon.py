"""Lines through images against scalar sums."""

import math

import numpy as np
import pytest

from tempora.operators import radon as R


def scalar(image, theta, rho, how):
    """One line, sample by sample."""
    nx, ny = image.shape
    out = []
    rows = R.along_rows(theta, how)
    for q in range(nx if rows else ny):
        if rows:
            at = (rho - (q - (nx - 1) / 2) * math.cos(theta)) / math.sin(theta) + (ny - 1) / 2
            line = image[q]
        else:
            at = (rho - (q - (ny - 1) / 2) * math.sin(theta)) / math.cos(theta) + (nx - 1) / 2
            line = image[:, q]
        if how.interpolation == "nearest":
            k = math.floor(at + 0.5)
            out.append(line[k] if 0 <= k < len(line) else math.nan)
        else:
            k = math.floor(at)
            out.append(line[k] * (1 - at + k) + line[k + 1] * (at - k) if 0 <= at < len(line) - 1 else math.nan)
    return out


@pytest.mark.parametrize("axis", [None, "x", "y"])
@pytest.mark.parametrize("interpolation", ["nearest", "linear"])
def test_transform(axis, interpolation):
    image = np.random.default_rng(1).uniform(0.5, 2, (9, 7))
    thetas, rhos = np.array([0.3, 0.9, 1.4, 2.5, -0.7]), np.array([-3.0, -0.4, 0.0, 2.2, 30.0])
    for method, f in (("sum", sum), ("mean", lambda v: sum(v) / len(v)), ("logsum", lambda v: sum(map(math.log, v))), ("product", math.prod)):
        how = R.Lines(axis, interpolation, method)
        got = R.transform(image, thetas, rhos, how)
        for i, t in enumerate(thetas):
            for j, r in enumerate(rhos):
                v = [x for x in scalar(image, t, r, how) if not math.isnan(x)]
                assert math.isnan(got[i, j]) if not v else abs(got[i, j] - f(v)) < 1e-9


def test_padding_and_vectors():
    image = np.random.default_rng(2).uniform(0.5, 2, (6, 5))
    for pad, fill in (("mean", image.mean(axis=1)), ("median", np.median(image, axis=1)), ("geomean", np.exp(np.log(image).mean(axis=1))), (3.0, np.full(6, 3.0))):
        how = R.Lines("x", method="mean", pad=pad)
        v = np.array(scalar(image, 0.6, 2.0, how))
        assert abs(R.transform(image, np.array([0.6]), np.array([2.0]), how)[0, 0] - np.where(np.isnan(v), fill, v).mean()) < 1e-12
    assert np.isfinite(R.transform(image, np.array([0.6]), np.array([2.0]), R.Lines("x", pad="random"))).all()
    with pytest.raises(ValueError):
        R.transform(image, np.array([0.6]), np.array([2.0]), R.Lines(pad="mean"))
    assert R.rho_vector(5, 5)[0] == -R.rho_vector(5, 5)[-1] and abs(R.rho_vector(5, 5)[-1] - math.sqrt(8)) < 1e-12
    assert len(R.theta_vector(30, 30)) == math.ceil(math.pi * math.hypot(14.5, 14.5) * math.sqrt(2))
