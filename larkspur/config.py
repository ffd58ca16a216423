"""Settings from TOML, with the year put in where {YEAR} stands."""

from __future__ import annotations

import random
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass, fields

import numpy as np


@dataclass(frozen=True)
class Settings:
    """What retrieval and index preparation can be told; unknown names are an error."""

    collection: str = ""
    embeddings: str = ""
    queries: str = ""
    qrels: str = ""
    turns: str = ""
    output: str = ""
    top_k: int = 1000
    rel_threshold: int = 1
    max_seq_length: int = 384
    max_doc_character: int = 10_000
    shards: int = 32
    rows_per_block: int = 2_500_000
    bm25_k1: float = 0.82
    bm25_b: float = 0.68


def seed_all(seed: int) -> None:
    """Seeds the driver's generators; operators take their seeds as arguments."""
    random.seed(seed)
    np.random.seed(seed % 2**32)


def load(path: str, year: str = "2023", needed: Iterable[str] = ()) -> Settings:
    """The file's settings; unknown names, and `needed` ones that it lacks, are errors."""
    with open(path, "rb") as file:
        given = tomllib.load(file)
    if unknown := set(given) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if missing := set(needed) - set(given):
        raise ValueError(f"missing settings: {', '.join(sorted(missing))}")
    return Settings(**{k: v.replace("{YEAR}", year) if isinstance(v, str) else v for k, v in given.items()})
