"""The discriminant's densities against their formula."""

import numpy as np

from ledgerline.llm import quality_model as model


def test_densities_equal_the_formula():
    rng = np.random.default_rng(1)
    samples = [rng.normal(3 * q, 1 + q, (60 + 20 * q, model.D)) @ rng.normal(size=(model.D, model.D)) for q in (0, 1)]
    total = np.stack([np.c_[np.ones(len(x)), x].T @ np.c_[np.ones(len(x)), x] for x in samples])
    classes = model._classes_of(total)
    n = np.array([len(x) for x in samples])
    covariances = [np.cov(x.T, bias=True) for x in samples]
    scale = np.sqrt(sum(k * np.diag(c) for k, c in zip(n, covariances, strict=True)) / n.sum())
    probes = rng.normal(size=(9, model.D))
    for q, (x, covariance) in enumerate(zip(samples, covariances, strict=True)):
        own = covariance / np.outer(scale, scale)
        shrunk = (1 - model.SHRINKAGE) * own + model.SHRINKAGE * np.diag(np.diag(own)) + model.FLOOR * np.eye(model.D)
        z = (probes - x.mean(axis=0)) / scale
        distance = np.einsum("ij,jk,ik->i", z, np.linalg.inv(shrunk), z)
        want = np.log(n[q] / n.sum()) - 0.5 * (distance + np.linalg.slogdet(shrunk)[1])
        np.testing.assert_allclose(model.density(probes, classes[q]), want, rtol=1e-9)


def test_one_class_only_gives_the_share_of_good_ones():
    total = np.zeros((2, model.D + 1, model.D + 1))
    classes = model._classes_of(total)
    assert model.density(np.ones((2, model.D)), classes[0]).tolist() == model.density(np.ones((2, model.D)), classes[1]).tolist()
