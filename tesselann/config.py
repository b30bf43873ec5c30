"""Datasets, metrics and the parameters of an index."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum


class Metric(Enum):
    IP = "ip"
    L2 = "l2"
    COSINE = "cosine"


@dataclass(frozen=True)
class DatasetSpec:
    """Rows, dimensions, metric and element type of a vector set. Unsigned bytes are held as smallint."""

    name: str
    rows: int
    dims: int
    metric: Metric
    element: str = "float"


# fixed values: public vector sets and their shapes
DATASETS = {
    s.name: s
    for s in (
        DatasetSpec("glove", 1_183_514, 100, Metric.COSINE),
        DatasetSpec("sift", 1_000_000, 128, Metric.L2),
        DatasetSpec("deep-1b", 10**9, 96, Metric.IP),
        DatasetSpec("sift-1b", 10**9, 128, Metric.L2, "smallint"),
        DatasetSpec("FB_ssnpp-1b", 10**9, 256, Metric.L2, "smallint"),
        DatasetSpec("spacev1b", 10**9, 100, Metric.L2, "tinyint"),
        DatasetSpec("yandex", 10**9, 200, Metric.IP),
    )
}


def register(spec: DatasetSpec) -> DatasetSpec:
    DATASETS[spec.name] = spec
    return spec


@dataclass(frozen=True)
class IndexConfig:
    """``dataset``: its name; ``epochs``: passes over the training sample, a multiple of ``every``; ``choices`` K: buckets an
    item may be put in; ``buckets`` B of each of ``repetitions`` R; ``hidden``: units of the classifier's hidden layer."""

    dataset: str
    epochs: int = 20
    choices: int = 2
    buckets: int = 4096
    repetitions: int = 4
    hidden: int = 512
    every: int = 5

    def __post_init__(self):
        if min(self.choices, self.buckets, self.repetitions, self.hidden, self.every) < 1 or self.epochs < 0:
            raise ValueError(f"not positive: {self}")
        if self.choices > self.buckets:
            raise ValueError("more choices than buckets")
        if self.epochs % self.every:
            raise ValueError(f"epochs must be a multiple of {self.every}: a model is kept at the end of each round")

    @property
    def name(self) -> str:
        return f"{self.dataset}_epc{self.epochs}_K{self.choices}_B{self.buckets}_R{self.repetitions}"

    @classmethod
    def parse(cls, name: str, **more) -> IndexConfig:
        """Read from the right, as a dataset's name may hold underscores."""
        m = re.fullmatch(r"(.+)_epc(\d+)_K(\d+)_B(\d+)_R(\d+)", name)
        if not m:
            raise ValueError(f"not an index name: {name!r}")
        return cls(m[1], *map(int, m.groups()[1:]), **more)

    def cap(self, rows: int, topm: int, mf: int) -> int:
        """Candidates a query may keep: twice the postings it expects to meet for each required hit, in whole 1024s."""
        return 1024 * (2 * self.repetitions * rows * topm // (self.buckets * max(1, mf)) // 1024)
