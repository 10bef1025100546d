"""The wide filter of large groups against that of single pairs."""

import numpy as np

from tallyweave.llm import similar as S


def test_wide_filter_of_groups_is_that_of_pairs():
    rng = np.random.default_rng(1)
    some = lambda size: rng.integers(0, 2**63, size=size).astype(np.uint64)
    sets = [np.unique(some(size)) for size in (0, 10, 500, 513, 600, 700, 1500, 5000, 5100, 3000, 3100)]
    sets += [np.unique(np.r_[sets[7][:keep], some(300)]) for keep in (4000, 4600, 4900)] + [np.unique(np.r_[sets[4][:560], some(30)])]
    wide, n = [S.wide_parity(x) for x in sets], np.array([len(x) for x in sets])
    a, b = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    got = S.wide_allowed(wide, n, a, b)
    assert got.tolist() == [S.wide_within(wide[i], int(n[i]), wide[j], int(n[j])) for i, j in zip(a, b, strict=True)]
    alike = [S.alike(len(np.intersect1d(sets[i], sets[j])), int(n[i]), int(n[j])) for i, j in zip(a, b, strict=True)]
    assert all(g for g, x in zip(got, alike, strict=True) if x) and not got.all()
    assert S.wide_allowed([], n[:0], a[:0], b[:0]).tolist() == []
