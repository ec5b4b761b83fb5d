"""One place for the choices of a run: what to read, how to transform, what to train."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class RunSettings:
    """Defaults of a run; from_args() takes --name value for each of them."""

    inputs: list[str] = field(default_factory=list)
    output: str = "out"
    kind: str = "csv"
    excluded: list[str] = field(default_factory=lambda: ["time", "timestamp"])
    categoricals: list[str] = field(default_factory=lambda: ["auto"])
    digits: int | None = None
    transforms: dict = field(default_factory=dict)
    rows: int = 1000
    parts: int | None = None
    batch: int = 10
    epochs: int = 100
    sequence: int = 50
    stride: int = 1
    epsilon: float = 2.0
    delta: float = 1e-5
    clip: float = 1e16
    private: bool = False
    seed: int = 0

    @staticmethod
    def from_args(args: list[str] | None = None) -> RunSettings:
        parser = argparse.ArgumentParser()
        for f in fields(RunSettings):
            kind = str(f.type)
            if "list" in kind:
                parser.add_argument(f"--{f.name}", nargs="*")
            elif kind == "bool":
                parser.add_argument(f"--{f.name}", action="store_true", default=None)
            elif kind == "dict":
                parser.add_argument(f"--{f.name}", type=lambda p: json.loads(Path(p).read_text()).get("transforms", {}), help="a JSON file")
            else:
                parser.add_argument(f"--{f.name}", type=int if "int" in kind else float if "float" in kind else str)
        return RunSettings(**{k: v for k, v in vars(parser.parse_args(args)).items() if v is not None})

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @staticmethod
    def load(path: str | Path) -> RunSettings:
        return RunSettings(**json.loads(Path(path).read_text()))
