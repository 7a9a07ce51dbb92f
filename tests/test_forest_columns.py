"""Trees that are folded by whole columns."""

import numpy as np

from tallyforge.operators import forest


def test_trees_are_folded_by_columns():
    """As rows that go down one by one, gaps too, with more depths than a byte tells apart."""
    rng = np.random.default_rng(3)
    for sample, rows in ((64, 3000), (2048, 40_000)):
        x = rng.normal(size=(rows, len(forest.NAMES)))
        made = forest.fit(x, 3, sample)
        if sample > 256:
            made.trees = [(f, s, r, rng.permutation(len(f)) / 7) for f, s, r, _ in made.trees]
            assert len(np.unique(made.trees[0][3])) > 256
        some = x[:200].copy()
        some[::9, 2] = np.nan
        for tree in made.trees:
            feature, split, right, leaf = tree
            want = []
            for row in some:
                k = 0
                while feature[k] >= 0:
                    k = right[k] if row[feature[k]] >= split[k] else k + 1
                want.append(leaf[k])
            assert np.array_equal(forest._folded(np.ascontiguousarray(some.T), *forest._coded(*tree)), want)
    alone = forest.Forest([(np.array([-1]), np.zeros(1), np.array([-1]), np.array([2.5]))], 4)
    assert len(set(alone.scores(x[:7]))) == 1
