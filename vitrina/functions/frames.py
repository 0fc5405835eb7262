"""Result frames of a job that writes several tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Frames(Mapping):
    """Frames by name, each built when it is first asked for. Builders share
    their parents (``functools.cache`` around a checkpointed table), so a frame
    costs what it needs and all frames together run each parent once."""

    def __init__(self, **builders: Callable[[], DataFrame]):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)
