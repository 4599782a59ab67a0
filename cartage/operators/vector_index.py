"""An inverted file over unit vectors: cells around centres, fitted on a bounded sample; every vector is in the cell of its nearest centre.

A query looks into the cells of its nearest centres.  How many is chosen on the sample: the fewest with which sampled queries
find the wanted share of their true neighbours among the sample.  What is found is compared exactly, so only recall is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartage.operators.topk import columns

SAMPLE, CELLS, RECALL = 8_000, 64, 0.97


def _placed(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Each row once for each of its ``probes`` nearest centres, with their number as ``cell``."""
    for b in batches:
        if len(b):
            near = np.argsort(-(columns(b)["e"] @ centres.T), axis=1, kind="stable")[:, :probes] if centres.size else np.zeros((len(b), 1), int)
            at = pa.array(np.repeat(np.arange(len(b)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "cell"])


@dataclass
class Index:
    centres: np.ndarray
    probes: int

    def _with_cells(self, rows: DataFrame, probes: int) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(partial(_placed, centres=self.centres, probes=probes), f"{schema}, cell int")

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """Every row of ``vectors`` (with a column e) with its cell."""
        return self._with_cells(vectors, 1)

    def probes_of(self, queries: DataFrame) -> DataFrame:
        """Every query once for each cell that it looks into."""
        return self._with_cells(queries, self.probes)


def fit(vectors: DataFrame, key: str, sample: int = SAMPLE, cells: int = CELLS, recall: float = RECALL, neighbours: int = 20, rounds: int = 8, seed: int = 7) -> Index:
    """An index from at most ``sample`` vectors, those whose keys have the smallest hashes."""
    drawn = vectors.orderBy(F.xxhash64(key)).limit(sample).select("e").toArrow()
    x = columns(drawn)["e"]
    if not len(x):
        return Index(np.zeros((1, 0)), 1)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        cell = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    cell = np.argmax(x @ centres.T, axis=1)
    asked = x[: min(300, len(x))]
    true = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :neighbours]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each centre for each query
    reached = np.take_along_axis(place, cell[true], axis=1)
    probes = next((p for p in range(1, len(centres) + 1) if (reached < p).mean() >= recall), len(centres))
    return Index(centres, probes)
