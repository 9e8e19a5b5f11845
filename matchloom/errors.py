"""Errors of the engine, with what they are about."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, message: str, **context):
        super().__init__(message if not context else f"{message} ({', '.join(f'{k}={v}' for k, v in context.items())})")
        self.context = context


class ExtractionError(EngineError):
    """A document that cannot be read as asked."""


class MatchingError(EngineError):
    """A reconciliation that cannot start."""


class ConfigError(EngineError):
    """Settings that contradict each other."""


class ConflictError(EngineError):
    """A commit that another writer's commit makes impossible."""
