"""Model providers (recognition, language): pluggable, applied in batches inside the executors; the offline one proposes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list[str | None]]
_PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register(name: str, make: Callable[[], Provider]) -> None:
    """Registers a factory that is called once in each task and gives a function from texts to proposals."""
    _PROVIDERS[name] = make


register("offline", lambda: lambda texts: [None] * len(texts))


def proposals(rows: DataFrame, key: str, text: str, provider: str = "offline", batch: int = 20) -> DataFrame:
    """``key``, ``text`` of the provider's proposals for each row; rows without one are left out. A batch holds at most 50 texts."""
    make, size = _PROVIDERS[provider], max(1, min(50, batch))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        propose = make()
        for pdf in batches:
            out: list = []
            for k in range(0, len(pdf), size):
                part = pdf.iloc[k : k + size]
                got = propose(part[text].tolist())
                if len(got) == len(part):
                    out += [(i, t) for i, t in zip(part[key], got) if t is not None]
            yield pd.DataFrame(out, columns=[key, text])

    return rows.select(key, text).mapInPandas(run, rows.select(key, text).schema)
