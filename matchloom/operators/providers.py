"""Which model answers, if any: chosen from settings, made by factories that the caller registers.

The engine has no network of its own.  A factory takes the settings and gives the clients of one provider: picklable functions that
run in tasks (see models.py).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..config import Config
from ..errors import ConfigError
from .cascade import Decider, LexicalDecider
from .models import ModelDecider, client_vectors, hashed_vectors


@dataclass(frozen=True)
class Clients:
    """match: decisions for batches of requests; lines: lines read from batches of texts; embed: vectors of batches of texts; model: what vectors are kept under."""

    model: str
    match: Callable | None = None
    lines: Callable | None = None
    embed: Callable | None = None


_FACTORIES: dict[str, Callable[[Config], Clients]] = {}


def register(name: str, factory: Callable[[Config], Clients]) -> None:
    _FACTORIES[name] = factory


def chosen(settings: Config) -> str | None:
    """The provider named, else the one with a key (the first in order, if several); none in a dry run or without a key."""
    if settings.dry_run:
        return None
    keyed = [p for p in ("openai", "google") if getattr(settings, f"{p}_key")]
    if settings.provider and settings.provider not in ("openai", "google"):
        raise ConfigError("unknown provider", provider=settings.provider)
    if settings.provider:
        return settings.provider if settings.provider in keyed else None
    return keyed[0] if keyed else None


def clients(settings: Config) -> Clients | None:
    name = chosen(settings)
    if name is None:
        return None
    if name not in _FACTORIES:
        raise ConfigError("no client is registered for the provider", provider=name)
    return _FACTORIES[name](settings)


def decider(settings: Config) -> Decider:
    """Level 2 of the cascade: the model's, where there is one that decides."""
    found = clients(settings)
    return ModelDecider(found.match) if found and found.match else LexicalDecider()


def embedder(settings: Config) -> tuple[str, Callable]:
    """(the name that vectors are kept under, what makes them): never those of another model."""
    found = clients(settings)
    return (found.model, client_vectors(found.embed)) if found and found.embed else ("hashed", hashed_vectors)
