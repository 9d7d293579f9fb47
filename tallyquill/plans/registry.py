"""Collects queries and their SQL per domain."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def keep(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.oracles[name] = sql
            return function

        return keep


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def recursive_with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"
