"""Data set dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crewlytics.operators.dataset import full_dataset
from crewlytics.operators.filters import staff
from crewlytics.sources.workforce import Workforce

SEED = 42


def dataset_full(w: Workforce, seed: int = SEED, limit: int | None = 2000) -> DataFrame:
    return full_dataset(staff(w.personnel), seed, limit=limit)


def dataset_heavy(w: Workforce, seed: int = SEED) -> DataFrame:
    return full_dataset(staff(w.personnel), seed)


REPORTS = [dataset_full, dataset_heavy]
