"""Recall of the fitted visits on vectors that are in no sample."""

import numpy as np
import pytest

from quillweave.llm.multi_index import IndexPlan, fit, unit


@pytest.mark.parametrize(("n", "dims", "clusters"), [(200_000, 256, 0), (1_000_000, 256, 0), (4_000_000, 64, 0), (4_000_000, 64, 2000)])
def test_visits_hold_for_other_vectors(n, dims, clusters):
    plan, rng = IndexPlan(), np.random.default_rng(8)
    centres = rng.normal(size=(max(1, clusters), dims))
    draw = lambda m: unit(rng.normal(size=(m, dims)) + (centres[rng.integers(0, clusters, m)] if clusters else 0))
    k = round((n / plan.cell) ** 0.5)
    books = fit(draw(min(plan.sample, max(plan.least_sample, 16 * k))), n, plan)
    x = draw(3000)
    turn = rng.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    y = plan.cosine * x + (1 - plan.cosine**2) ** 0.5 * unit(turn)
    found = (books.order(x, books.visits) == books.home(y)[:, None]).any(axis=1) | (books.order(y, books.visits) == books.home(x)[:, None]).any(axis=1)
    assert found.mean() >= 0.96
    assert books.visits < books.k**2 / 4
