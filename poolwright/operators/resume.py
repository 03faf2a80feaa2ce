"""Long clusterings that continue where a killed run stopped: a log of states in a folder."""

from __future__ import annotations

import io
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..sources import files
from . import clustering


class StateLog:
    """States of one run, each a sealed file named by its number; the newest readable one counts.

    A state is written beside its name and renamed, and it is behind its digest: one that a killed run left half written,
    or that was damaged later, is passed over for the one before it. The ``keep`` newest stay.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        if keep < 1:
            raise ValueError("at least one state must stay")
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _numbers(self) -> list[int]:
        found = (n.removeprefix("state-") for n in files.names(self.spark, self.path) if n.startswith("state-"))
        return sorted(int(n) for n in found if n.isdigit())

    def _name(self, number: int) -> str:
        return f"{self.path}/state-{number:08d}"

    def save(self, number: int, said: dict, matrix: np.ndarray) -> None:
        out = io.BytesIO()
        np.savez(out, said=np.frombuffer(json.dumps(said).encode(), np.uint8), matrix=matrix)
        files.write_bytes(self.spark, self._name(number), files.sealed(out.getvalue()))
        for old in self._numbers()[: -self.keep]:
            files.delete(self.spark, self._name(old))

    def newest(self) -> tuple[int, dict, np.ndarray] | None:
        for number in reversed(self._numbers()):
            try:
                data = files.opened(files.read_bytes(self.spark, self._name(number)))
            except (ValueError, FileNotFoundError):
                continue
            with np.load(io.BytesIO(data)) as state:
                return number, json.loads(state["said"].tobytes()), state["matrix"]
        return None


def resumable_kmeans(
    rows: DataFrame,
    k: int,
    rounds: int,
    seed: int,
    path: str,
    start: str = "kmeans++",
    every: int = 1,
    keep: int = 2,
    after: Callable[[str, int], None] | None = None,
) -> np.ndarray:
    """Centroids as :func:`clustering.kmeans` gives them, with a state in ``path`` after every ``every`` steps.

    A step is a centre of the start, where the start chooses one by one, or a round. A run that finds states goes on
    behind the newest readable one; one that finds its last round gives the centroids at once. States of another k,
    seed, start or number of rounds belong to another run: ValueError. ``after`` is called behind each step with its
    phase, "start" or "round", and number; no rows give no centroids.
    """
    if start not in clustering.STARTS:
        raise ValueError(f"unknown start {start!r}")
    log = StateLog(rows.sparkSession, path, keep)
    run = {"k": k, "rounds": rounds, "seed": seed, "start": start}
    found = log.newest()
    number, phase, step, centroids = -1, "start", 0, None
    if found:
        number, said, centroids = found
        if said["run"] != run:
            raise ValueError(f"{path} has the states of another run: {said['run']}")
        phase, step = said["phase"], said["step"]
    if phase == "round" and step == rounds:
        return centroids
    rows = clustering.cut(rows.select("id", "vec"))

    def done(phase: str, step: int, matrix: np.ndarray, last: bool) -> None:
        nonlocal number
        if last or step % every == 0:
            number += 1
            log.save(number, {"run": run, "phase": phase, "step": step}, matrix)
        if after:
            after(phase, step)

    if phase == "start":
        if start == "kmeans++":
            said = lambda chosen: done("start", len(chosen), chosen, len(chosen) == k)
            centroids = clustering.kmeans_plus_plus(rows, k, seed, chosen=centroids, after=said)
        else:
            centroids = clustering.STARTS[start](rows, k, seed)
        step = 0
        done("round", 0, centroids, True)
    for step in range(step + 1, rounds + 1):
        centroids = clustering.lloyd(rows, centroids, 1)
        done("round", step, centroids, step == rounds)
    return centroids
