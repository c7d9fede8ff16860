"""Merging of samples with the index of near components against one that looks at all, and its growth in one pass."""

import time

import numpy as np
import pytest

from tempora.operators import density as D


def plain(x, var, threshold, method):
    n, d = x.shape
    start = np.diag(var) if method == "full" else var
    count, mean, cov, grown = [], [], [], []
    for row in x:
        far = [(row - m) @ np.linalg.solve(c, row - m) if method == "full" else ((row - m) ** 2 / c).sum() for m, c in zip(mean, cov, strict=True)]
        j = int(np.argmin(far)) if far else -1
        if j >= 0 and far[j] < threshold**2:
            m, step = count[j], (row - mean[j]) / (count[j] + 1)
            outer = np.outer(step, step) if method == "full" else step * step
            if method != "constant":
                cov[j] = (m * (cov[j] + outer) + start + m * m * outer) / (m + 1)
            mean[j], count[j] = mean[j] + step, m + 1
        else:
            count.append(1)
            mean.append(row.astype(float))
            cov.append(start)
        grown.append(len(count))
    return np.array(count), np.array(mean), np.array(cov), grown


@pytest.mark.parametrize("method", ["diagonal", "full", "constant"])
@pytest.mark.parametrize(("dims", "threshold"), [(1, 1.0), (2, 0.5), (3, 2.0), (5, 3.0)])
def test_near_components_suffice(method, dims, threshold):
    r = np.random.default_rng(dims)
    x = np.concatenate([r.normal(size=(250, dims)) * 3, r.normal(size=(60, dims)) * 0.1 + 2, np.repeat(r.normal(size=(3, dims)), 5, axis=0), r.normal(size=(30, dims)) * 40])
    r.shuffle(x)
    var = r.uniform(0.05, 0.4, dims)
    want = plain(x, var, threshold, method)
    got = D.merge_source(x, var, threshold, method)
    assert (got[0] == want[0]).all() and np.allclose(got[1], want[1]) and np.allclose(got[2], want[2])
    ends = [25, 100, 101, len(x)]
    assert D.merge_source(x, var, threshold, method, ends) == [want[3][e - 1] for e in ends]
    assert D.merge_source(x, var, 0.0, method, ends) == ends and len(D.merge_source(x, var, 0.0, method)[0]) == len(x)


def test_a_sample_meets_few_of_many_components():
    r = np.random.default_rng(9)
    var = np.full(3, 1e-4)

    def seconds(n):
        x = r.uniform(-1, 1, (n, 3))
        t = time.perf_counter()
        k = len(D.merge_source(x, var, 1.0)[0])
        assert k > 0.9 * n
        return time.perf_counter() - t

    seconds(500)
    assert seconds(16_000) < 6 * seconds(4_000)  # 16 times, if each met all
    cells = D.Cells(var, 1.0)
    for j, m in enumerate(r.uniform(-1, 1, (2000, 3))):
        cells.put(j, m, var)
    assert max(len(cells.near(m)) for m in r.uniform(-1, 1, (200, 3))) < 40
    cells.put(5000, np.zeros(3), np.ones(3))  # wide
    assert 5000 in cells.near(np.array([0.9, 0.9, 0.9])) and cells.near(np.full(3, 50.0)).tolist() == [5000]
