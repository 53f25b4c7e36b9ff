"""Chains of named steps from tables to tables that can be checked, run and written down."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_STEPS: dict[str, tuple[Callable[..., DataFrame], frozenset[str]]] = {}


def step(name: str, needs: Sequence[str] = ()):
    """Registers a function (df, **parameters) -> df and the columns that it needs."""

    def put(f):
        _STEPS[name] = (f, frozenset(needs))
        return f

    return put


@dataclass
class Chain:
    steps: list[tuple[str, dict]] = field(default_factory=list)

    def then(self, name: str, **parameters) -> Chain:
        if name not in _STEPS:
            raise KeyError(f"no such step: {name}")
        return Chain([*self.steps, (name, parameters)])

    def run(self, df: DataFrame) -> DataFrame:
        """The whole chain as one lazy plan; a step whose columns are missing is an error before anything runs."""
        for name, parameters in self.steps:
            f, needs = _STEPS[name]
            if missing := needs - set(df.columns):
                raise ValueError(f"step {name} lacks {sorted(missing)}")
            df = f(df, **parameters)
        return df

    def dump(self) -> str:
        return json.dumps(self.steps)

    @classmethod
    def load(cls, text: str) -> Chain:
        out = cls()
        for name, parameters in json.loads(text):
            out = out.then(name, **parameters)
        return out
