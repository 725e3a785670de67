"""Steps that compose with >>: each is a function from a frame to a frame, so a pipe is one lazy plan that Catalyst sees whole."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Pipe:
    """Named steps in order. `frame >> pipe` has no frame to start from in Spark, so a pipe is called: pipe(frame)."""

    steps: tuple[tuple[str, Callable[[DataFrame], DataFrame], tuple[str, ...]], ...] = field(default=())

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, f, needs in self.steps:
            missing = [c for c in needs if c not in df.columns]
            if missing:
                raise ValueError(f"step {name} needs columns {', '.join(missing)}")
            df = f(df)
        return df

    def __rshift__(self, other: Pipe) -> Pipe:
        if not isinstance(other, Pipe):
            return NotImplemented
        return Pipe(self.steps + other.steps)

    @property
    def history(self) -> list[str]:
        return [name for name, _, _ in self.steps]

    def to_dot(self, name: str = "pipe", rankdir: str = "TB") -> str:
        """The steps as a Graphviz graph, from the input on."""
        labels = ["input", *self.history]
        quoted = [s.replace("\\", "\\\\").replace('"', '\\"') for s in labels]
        nodes = [f'  n{i} [label="{s}"];' for i, s in enumerate(quoted)]
        edges = [f"  n{i} -> n{i + 1};" for i in range(len(labels) - 1)]
        return "\n".join([f"digraph {name} {{", f"  rankdir={rankdir};", *nodes, *edges, "}"])


def step(*needs: str):
    """Makes a function (frame, parameters...) a maker of one-step pipes: @step("y") def centred(df, by): ..., then centred(by=2) >> ...; needs: columns that must be there."""

    def make(f: Callable[..., DataFrame]) -> Callable[..., Pipe]:
        @functools.wraps(f)
        def bound(*args, **params) -> Pipe:
            shown = ", ".join([*map(repr, args), *(f"{k}={v!r}" for k, v in params.items())])
            return Pipe(((f"{f.__name__}({shown})", lambda df: f(df, *args, **params), needs),))

        return bound

    return make


def pipeline(*parts: Pipe) -> Pipe:
    return functools.reduce(lambda a, b: a >> b, parts, Pipe())
