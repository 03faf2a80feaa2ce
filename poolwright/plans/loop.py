"""The active-learning loop: train, evaluate, query, label, round by round."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, pool as state
from ..operators.clustering import cut, shared_path
from ..operators.scorers import Scorer
from ..sources import results
from ..sources.tables import checked_table
from . import registry

log = logging.getLogger("poolwright")


@dataclass
class Run:
    dataset: str
    strategy: str
    seed: int
    n_init: int
    n_query: int
    n_round: int
    curve: dict[str, list[float]] = field(default_factory=lambda: {m: [] for m in ("acc", "precision", "recall", "f1")})
    labels: DataFrame | None = None

    def result(self) -> dict:
        return {
            "dataset_name": self.dataset,
            "strategy_name": self.strategy,
            "n_init_labeled": self.n_init,
            "n_query": self.n_query,
            "n_round": self.n_round,
            "seed": self.seed,
            "all_acc": self.curve["acc"],
            "all_precision": self.curve["precision"],
            "all_recall": self.curve["recall"],
            "all_f1_score": self.curve["f1"],
            "rounds": list(range(len(self.curve["acc"]))),
        }


def evaluate(scorer: Scorer, test: DataFrame) -> dict[str, float]:
    predicted = test.select("id", "label").join(scorer.predict(test), "id")
    return metrics.weighted_scores(predicted).first().asDict()


def learn(
    pool: DataFrame,
    test: DataFrame,
    strategy: str,
    scorer: Scorer,
    labels: DataFrame,
    n_query: int,
    n_round: int,
    seed: int = 1,
    dataset: str = "pool",
    features: DataFrame | None = None,
    images: DataFrame | None = None,
) -> Run:
    """Run a strategy for so many rounds from a labelled state. The state is cut from its lineage every round, so plans
    do not grow; the scorer is fitted from scratch.

    A strategy on texture features takes them from ``features`` or extracts them, once, from ``images`` (id, height,
    width, pixels).
    """
    choose = registry.strategy(strategy)
    if features is None and images is not None and strategy in registry.FEATURES:
        features = registry.features_for(strategy, images, shared_path(pool.sparkSession, "features"))
    run = Run(dataset, strategy, seed, labels.count(), n_query, n_round)
    labels = cut(labels)
    for round_no in range(n_round + 1):
        if round_no:
            left = state.evict(features, labels) if features is not None else state.unlabeled(pool, labels)
            chosen = choose(pool, labels, n_query, scorer, left, seed)
            labels = cut(state.update(labels, chosen, round_no))
        scorer.fit(state.labeled(pool, labels))
        scores = evaluate(scorer, test)
        for name, values in run.curve.items():
            values.append(scores[name])
        log.info("round %d: %s", round_no, scores)
    run.labels = labels
    return run


def sweep(spark: SparkSession, strategies: list[str], n_queries: list[int], seeds: list[int]) -> DataFrame:
    """(strategy, n_query, seed): the runs of an experiment."""
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], [name])
    return one("strategy", strategies).crossJoin(one("n_query", n_queries)).crossJoin(one("seed", seeds))


def main(argv: list[str] | None = None) -> None:
    """Run one strategy on a table of vectors and write its results.json."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--table", required=True)
    p.add_argument("--id", default="id")
    p.add_argument("--vector", default="vec")
    p.add_argument("--label", default="label")
    p.add_argument("--out", required=True)
    p.add_argument("--seed", type=int, default=1)
    p.add_argument("--n_init_labeled", type=int, default=100)
    p.add_argument("--n_query", type=int, default=10)
    p.add_argument("--n_round", type=int, default=10)
    p.add_argument("--strategy_name", default="RandomSampling", choices=sorted(registry.STRATEGIES))
    p.add_argument("--scorer", default="prototype", choices=sorted(registry.SCORERS))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    rows = state.pool_of(spark.read.parquet(a.table), a.id, a.vector, a.label)
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    train, test = rows.where(~held), rows.where(held)
    labels = state.initial_labels(train, a.n_init_labeled, a.seed)
    images = None
    if a.strategy_name in registry.FEATURES:
        images = checked_table(spark, a.table, (a.id, "height", "width", "pixels"))
        images = images.withColumnRenamed(a.id, "id").join(train.select("id"), "id", "left_semi")
    run = learn(
        train, test, a.strategy_name, registry.scorer(a.scorer), labels, a.n_query, a.n_round, a.seed, a.table, images=images
    )
    results.write_run(run.result(), a.out)


if __name__ == "__main__":
    main()
