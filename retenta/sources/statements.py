"""Query texts from files (S9, S10): a file of statements run over a bundle of tables, with named parameters.

A statement may be named by a line ``-- name: some_name`` before it. Parameters are
Spark's named markers (``:name``); values are bound, never pasted into the text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

# What a semicolon may stand in without ending a statement: quotes, line comments, block comments.
_PARTS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|;""", re.S)
_NAME = re.compile(r"^\s*--\s*name:\s*(\w+)\s*$", re.M)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.S)


def split_statements(text: str) -> list[str]:
    """The statements of a text, without the semicolons that end them; what holds comments and blanks only is none."""
    cuts = [m.start() for m in _PARTS.finditer(text) if m.group() == ";"]
    pieces = [text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)])]
    return [p.strip() for p in pieces if _COMMENT.sub("", p).strip()]


def named_statements(text: str) -> dict[str, str]:
    """The statements by name; one without a name is called by its number, from 1. A name that occurs twice is an error."""
    out: dict[str, str] = {}
    for i, statement in enumerate(split_statements(text), 1):
        names = _NAME.findall(statement)
        name = names[-1] if names else str(i)
        if name in out:
            raise ValueError(f"two statements are named {name}")
        out[name] = statement
    return out


def read_text(spark: SparkSession, path: str) -> str:
    """A file's whole text, from any store that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]


def run(tables: Tables, text: str, parameters: dict | None = None) -> dict[str, DataFrame]:
    """Each statement's lazy result by name. The tables are views of their names while the statements are
    analysed; a session view that already has such a name is an error, and none is left behind."""
    spark = tables.orders.sparkSession
    frames = tables.as_dict()
    taken = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name in frames]
    if taken:
        raise ValueError(f"the session has views named {', '.join(sorted(taken))}")
    try:
        for name, df in frames.items():
            df.createTempView(name)
        out = {}
        for name, statement in named_statements(text).items():
            used = set(re.findall(r":(\w+)", _COMMENT.sub("", statement)))
            out[name] = spark.sql(statement, args={k: v for k, v in (parameters or {}).items() if k in used})
        return out
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)


def run_file(tables: Tables, path: str, parameters: dict | None = None) -> dict[str, DataFrame]:
    return run(tables, read_text(tables.orders.sparkSession, path), parameters)
