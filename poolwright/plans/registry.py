"""Strategies, scorers and feature extractors by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import strategies as s
from ..operators import textures
from ..operators.head import HeadScorer
from ..operators.scorers import MLScorer, PrototypeScorer, Scorer
from ..sources.tables import cached_features

#: name -> function of (pool, labels, n, scorer, features, seed)
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "RandomSampling": lambda pool, labels, n, scorer, features, seed: s.random_sampling(pool, labels, n, seed),
    "KMeansSampling": lambda pool, labels, n, scorer, features, seed: s.kmeans_sampling(pool, labels, n, seed=seed, scorer=scorer),
    "KCenterGreedy": lambda pool, labels, n, scorer, features, seed: s.kcenter_greedy(pool, labels, n),
    "BALDDropout": lambda pool, labels, n, scorer, features, seed: s.bald(pool, labels, n, scorer, seed=seed),
    "AdversarialBIM": lambda pool, labels, n, scorer, features, seed: s.adversarial_bim(pool, labels, n, scorer),
    "AdversarialDeepFool": lambda pool, labels, n, scorer, features, seed: s.deepfool(pool, labels, n, scorer),
}
for _name in s.SCORES:
    STRATEGIES[_name] = lambda pool, labels, n, scorer, features, seed, _n=_name: s.uncertainty(pool, labels, n, scorer, _n)
    STRATEGIES[f"{_name}Dropout"] = lambda pool, labels, n, scorer, features, seed, _n=_name: s.uncertainty_dropout(
        pool, labels, n, scorer, _n, seed=seed
    )
#: strategy -> extractor of the features that it works on
FEATURES: dict[str, str] = {}
for _kind in ("SSRAE", "VCTex"):
    for _how in ("KmeansSampling", "KmeansHCSampling"):
        FEATURES[f"{_kind}{_how}"] = _kind.lower()
    STRATEGIES[f"{_kind}KmeansSampling"] = lambda pool, labels, n, scorer, features, seed: s.feature_kmeans_sampling(
        features, n, seed=seed, tries=10
    )
    STRATEGIES[f"{_kind}KmeansHCSampling"] = lambda pool, labels, n, scorer, features, seed: s.hierarchical_sampling(features, n, seed=seed)

SCORERS: dict[str, Callable[[], Scorer]] = {"prototype": PrototypeScorer, "logistic": MLScorer, "head": HeadScorer}


def strategy(name: str) -> Callable[..., DataFrame]:
    if name not in STRATEGIES:
        raise NotImplementedError(name)
    return STRATEGIES[name]


def features_for(strategy: str, images: DataFrame, root: str) -> DataFrame:
    """(id, vec): the features that a strategy works on, of all of (id, height, width, pixels).

    They are extracted once and read from then on; the folder under ``root`` is named by the extractor and its parameters.
    """
    extractor = FEATURES[strategy]
    features = cached_features(textures.extract_features(images, extractor), f"{root}/{textures.feature_key(extractor)}")
    return features.select("id", features["vec"].cast("array<double>").alias("vec"))


def scorer(name: str) -> Scorer:
    if name not in SCORERS:
        raise NotImplementedError(name)
    return SCORERS[name]()
