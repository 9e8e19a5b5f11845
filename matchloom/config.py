"""Settings, from arguments, the environment and files, in that order; no later source overrides an earlier one."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import ConfigError

PREFIX = "MATCHLOOM_"


@dataclass(frozen=True)
class Config:
    root: str = "matchloom-store"
    dims: int = 1536
    top_k: int = 5
    dry_run: bool = True
    review_brands: bool = False
    convert_units: bool = False
    provider: str = ""
    openai_key: str = ""
    google_key: str = ""

    def __post_init__(self):
        if self.dims < 1 or self.top_k < 1:
            raise ConfigError("dims and top_k must be positive", dims=self.dims, top_k=self.top_k)


def read_env_file(path: str) -> dict[str, str]:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        pairs = [line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def load(given: dict | None = None, files: tuple[str, ...] = (".env", ".env.demo")) -> Config:
    found: dict[str, str] = {}
    for source in [os.environ, *map(read_env_file, files)]:
        for key, value in source.items():
            if key.startswith(PREFIX):
                found.setdefault(key.removeprefix(PREFIX).lower(), value)
    types = {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    read = {k: (v.lower() in ("1", "true", "yes") if types[k] is bool else types[k](v)) for k, v in found.items() if k in types}
    return Config(**(read | {k: v for k, v in (given or {}).items() if v is not None}))
