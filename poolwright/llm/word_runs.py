"""Periodic runs of words by partition refinement, and texts with their repeats collapsed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Words of texts that are refined together, so that short texts share the cost of a step. A longer text goes alone.
WORDS_TOGETHER = 200_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class _Classes:
    """Positions of several texts in classes of equal factors; the length of the factors grows by one each turn.

    A class is a list in ascending order of position, linked by ``after`` and ``before``. Each text ends in a position
    that equals no other, so a factor that would reach beyond its text is in a class of its own.
    """

    def __init__(self, texts: list[np.ndarray], min_exponent: int) -> None:
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        self.cls = np.empty(ends[-1] + 1, np.int64)
        #: The longest period that a run in the text of a position can have.
        self.longest = np.repeat(lengths // min_exponent, lengths + 1)
        self.is_end = np.zeros(len(self.cls), bool)
        self.is_end[ends] = True
        small, classes = np.ones(len(self.cls), bool), 0
        for at, words, end in zip(self.starts, texts, ends, strict=True):
            self.cls[at:end] = words + classes
            self.cls[end] = classes + (words.max(initial=-1) + 1)
            if len(words):  # of the first classes, which all came from one, the largest need not refine others
                small[at:end] = words != np.bincount(words).argmax()
            classes = self.cls[end] + 1
        order = np.argsort(self.cls, kind="stable")
        same = self.cls[order[1:]] == self.cls[order[:-1]]
        self.after, self.before = np.full((2, len(order)), -1, np.int64)
        self.after[order[:-1][same]] = order[1:][same]
        self.before[order[1:][same]] = order[:-1][same]
        self.size = np.bincount(self.cls, minlength=classes)
        self.head = order[np.concatenate([[0], np.cumsum(self.size)[:-1]])]
        self.small = np.flatnonzero(small)
        self.length = 1
        #: By distance: positions whose follower in the class was once that far off.
        self.at_distance: dict[int, list[np.ndarray]] = defaultdict(list)
        self._note(np.flatnonzero(self.after >= 0))

    def _note(self, positions: np.ndarray) -> None:
        distance = self.after[positions] - positions
        wanted = (distance >= self.length) & (distance <= self.longest[positions])
        positions, distance = positions[wanted], distance[wanted]
        order = np.argsort(distance, kind="stable")
        positions, distance = positions[order], distance[order]
        cuts = np.flatnonzero(np.diff(distance)) + 1
        for part in np.split(positions, cuts) if len(positions) else ():
            self.at_distance[int(self.after[part[0]] - part[0])].append(part)

    def squares(self) -> np.ndarray:
        """Where a square begins whose halves have the present length and no shorter period."""
        noted = self.at_distance.pop(self.length, None)
        if not noted:
            return np.empty(0, np.int64)
        found = np.unique(np.concatenate(noted))
        return found[self.after[found] - found == self.length]

    def grow(self) -> None:
        """Classes of factors one longer: each is split by the class of the position that follows.

        Only positions before members of small classes are looked at: of the classes into which one was split, all but
        the largest are small, and what stays behind is followed by the largest.
        """
        self.length += 1
        follow = self.small[self.small > 0]
        moved = follow - 1
        wanted = ~self.is_end[moved] & (self.size[self.cls[moved]] > 1) & (self.longest[moved] >= self.length)
        moved, follow = moved[wanted], follow[wanted]
        if not len(moved):
            self.small = moved
            return
        old, by = self.cls[moved], self.cls[follow]
        order = np.lexsort((moved, by, old))
        moved, old, by = moved[order], old[order], by[order]
        first = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (by[1:] != by[:-1])]))
        count = np.diff(np.append(first, len(moved)))  # members of each group that a class is split into
        of = old[first]
        first_group = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        groups = np.diff(np.append(first_group, len(of)))
        parent = of[first_group]
        stay = self.size[parent] - np.add.reduceat(count, first_group)
        largest = np.maximum.reduceat(count, first_group)
        # the first of the largest groups of each class
        is_largest = count == np.repeat(largest, groups)
        rank = np.cumsum(is_largest)
        is_largest &= rank == np.repeat(rank[first_group] - is_largest[first_group] + 1, groups)
        # where nothing stays behind, the largest group keeps the class
        goes = ~(is_largest & np.repeat(stay == 0, groups))
        in_small = goes & ~(is_largest & np.repeat(stay < largest, groups))
        left_small = parent[(stay > 0) & (stay < largest)]
        kept = np.where(stay > 0, stay, largest)

        number = len(self.size) + np.cumsum(goes) - 1
        row_goes = np.repeat(goes, count)
        group_of = np.repeat(np.arange(len(of)), count)[row_goes]
        leaving = moved[row_goes]
        self._unlink(leaving, old[row_goes])
        self.size[parent] = kept
        self.cls[leaving] = number[group_of]
        joined = group_of[1:] == group_of[:-1]
        self.after[leaving], self.before[leaving] = -1, -1
        self.after[leaving[:-1][joined]] = leaving[1:][joined]
        self.before[leaving[1:][joined]] = leaving[:-1][joined]
        self.size = np.append(self.size, count[goes])
        self.head = np.append(self.head, moved[first[goes]])
        self._note(leaving[self.after[leaving] >= 0])

        small, at = [leaving[in_small[group_of]]], self.head[left_small]
        while len(at):
            small.append(at)
            at = self.after[at]
            at = at[at >= 0]
        self.small = np.sort(np.concatenate(small))

    def _unlink(self, leaving: np.ndarray, old: np.ndarray) -> None:
        if not len(leaving):
            return
        order = np.lexsort((leaving, old))
        leaving, old = leaving[order], old[order]
        breaks = self.after[leaving[:-1]] != leaving[1:]  # neighbours that leave together are one chain
        front = np.concatenate([[True], breaks])
        before, after = self.before[leaving[front]], self.after[leaving[np.concatenate([breaks, [True]])]]
        has_before, has_after = before >= 0, after >= 0
        self.after[before[has_before]] = after[has_before]
        self.before[after[has_after]] = before[has_after]
        self.head[old[front][~has_before]] = after[~has_before]
        self._note(before[has_before & has_after])


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period; texts are numbers 0, 1, ... of their words.

    A run is a longest stretch with smallest period p, at least ``min_exponent`` (2 or more) times p and ``min_length``
    long. Classes of equal factors are refined up to the longest possible period; where neighbours in a class stand as
    far apart as their factors are long, there is a square, and squares at neighbouring places are one run.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    classes = _Classes(texts, max(2, min_exponent))
    while True:
        p = classes.length
        at = classes.squares()
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > 1)
            begin, end = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
            length = end - begin + 2 * p
            long = length >= max(min_length, min_exponent * p)
            text = np.searchsorted(classes.starts, begin, "right") - 1
            for k in np.flatnonzero(long):
                found[text[k]].append((int(begin[k] - classes.starts[text[k]]), int(length[k]), p))
        if not len(classes.small):
            return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]
        classes.grow()


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _collapsed(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    drop: set[int] = set()
    for start, length, period in runs:
        drop.update(range(start + period, start + length))
    return b" ".join(w for i, w in enumerate(words) if i not in drop) if drop else b" ".join(words)


def word_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """(id_col, n_words, runs, collapsed): the periodic runs of each whole text's words and the text without repeats.

    Words are maximal runs of anything but ASCII white space; ``runs`` has start and length in words and the period, by
    start and period (:func:`runs_of`). ``collapsed`` joins by one space the words that no run contains after its first
    period. Null and empty texts have no words, no runs and an empty collapsed text. Ids may be null or repeat: a row in
    is a row out. An empty table gives an empty result; other columns are not read.

    Nothing is shuffled: a text is one task's work, of n log n steps and some arrays of its words.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                words: list[list[bytes]] = []
                room = WORDS_TOGETHER
                while at + len(words) < batch.num_rows and room > 0:
                    words.append((texts[at + len(words)].as_py() or b"").split())
                    room -= len(words[-1])
                runs = runs_of([_numbers(w) for w in words], min_length, min_exponent)
                keys = ("start", "length", "period")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(words)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(keys, r, strict=True)) for r in rs] for rs in runs], pa.list_(_RUN)),
                        pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=[id_col, "n_words", "runs", "collapsed"],
                )
                at += len(words)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text_bytes"))
    return rows.mapInArrow(search, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {_SCHEMA}")
