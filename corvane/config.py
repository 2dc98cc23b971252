"""Settings as a JSON file: unknown keys are kept out, missing ones have defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Config:
    store: str = ".corvane"
    ignore: tuple[str, ...] = ()
    k1: float = 1.5
    b: float = 0.75
    results: int = 10
    neighbours: int = 50
    token_budget: int = 4000

    def __post_init__(self):
        if self.results < 1 or self.neighbours < 1 or self.token_budget < 0 or not 0 <= self.b <= 1 or self.k1 < 0:
            raise ValueError("a setting is out of range")


def load(path: str | Path) -> Config:
    """The settings of a file, or the defaults if there is none."""
    if not Path(path).exists():
        return Config()
    known = {f.name for f in dataclasses.fields(Config)}
    found = {k: tuple(v) if k == "ignore" else v for k, v in json.loads(Path(path).read_text()).items() if k in known}
    return Config(**found)


def save(config: Config, path: str | Path) -> None:
    """Written beside the file and moved into place."""
    new = Path(f"{path}.new")
    new.write_text(json.dumps(dataclasses.asdict(config), indent=2))
    new.replace(path)
