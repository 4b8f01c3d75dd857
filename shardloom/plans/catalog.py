"""Queries of the chunking and command operators, by name, and their DuckDB SQL."""

from __future__ import annotations

from . import chunks, lines, programs, shell

QUERIES: dict = {**chunks.QUERIES, **shell.QUERIES, **programs.QUERIES, **lines.QUERIES}
SQL: dict = {**chunks.SQL, **shell.SQL, **programs.SQL, **lines.SQL}
