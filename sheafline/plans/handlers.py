"""Strategies by name: methods of obligations, exporters, planners, description providers."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    """Functions by name. A name that isn't there is an error, or the default if there is one."""

    def __init__(self, default: str | None = None) -> None:
        self.known: dict[str, Callable[..., Any]] = {}
        self.default = default

    def add(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            if not name.strip():
                raise ValueError("a name must not be blank")
            self.known[name] = f
            return f

        return put

    def get(self, name: str) -> Callable[..., Any]:
        found = self.known.get(name) or (self.known.get(self.default) if self.default else None)
        if found is None:
            raise KeyError(f"unknown: {name}; known: {', '.join(sorted(self.known))}")
        return found

    def load(self, module: str) -> None:
        """let a module add its own functions through its ``register_handlers(registry)``."""
        importlib.import_module(module).register_handlers(self)


#: Renderings of the canonical documents by format.
EXPORTERS = Registry()
#: Plans by the planner's name; the internal one is the default.
PLANNERS = Registry("internal")
#: Providers of descriptions by name; the default describes nothing.
PROVIDERS = Registry("none")


def _exporter(name: str):
    def run(spark, sf_dir: str) -> DataFrame:
        from ..operators import documents

        return getattr(documents, name)(spark, sf_dir)

    return run


for _format, _name in (("txt", "text_document"), ("html", "html_document"), ("ast", "ast_document"), ("docx", "layout_rows"), ("pdf", "layout_rows")):
    EXPORTERS.add(_format)(_exporter(_name))


@PLANNERS.add("internal")
def _internal(rows: list[dict]) -> list[dict]:
    from ..operators.planning import plan

    return plan(rows)


def outcomes(rows: list[dict], names: tuple[str, ...]) -> list[dict]:
    """What each planner gives for a document's obligations: a plan's length and cost, or its error. One planner's
    failure doesn't stop the others."""
    out = []
    for name in names:
        try:
            steps = PLANNERS.get(name)(rows)
            solved = steps[-1]["action"] == "complete-job"
            out.append({"planner": name, "status": "solved" if solved else "failed", "steps": len(steps) if solved else 0, "cost": sum(s["cost"] for s in steps), "error": None if solved else steps[0]["action"]})
        except Exception as e:  # noqa: BLE001  any planner's error is its outcome
            out.append({"planner": name, "status": "failed", "steps": 0, "cost": 0, "error": f"{type(e).__name__}: {e}"})
    return out


@PROVIDERS.add("none")
def _nothing(content: bytes | None, kind: str) -> str:
    return ""


@PROVIDERS.add("size")
def _size(content: bytes | None, kind: str) -> str:
    """A deterministic stand-in for a model."""
    return f"{kind} of {len(content or b'')} bytes"


def describe(rows: DataFrame, provider: str, content: str, kind: str, fallback: str, out: str = "description") -> DataFrame:
    """A description of each row's content; an error or an empty answer gives the fallback column's text, else "".

    Rows run batch by batch where they are; partitions bound how many calls run at once.
    """
    call = PROVIDERS.get(provider)

    def one(c: bytes | None, k: str, text: str | None) -> str:
        try:
            return call(c, k) or text or ""
        except Exception:  # noqa: BLE001  the rule: a provider's error is the fallback
            return text or ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, k, t = (b.column(x).to_pylist() for x in (content, kind, fallback))
            yield b.append_column(out, pa.array([one(*x) for x in zip(c, k, t, strict=True)], pa.string()))

    return rows.mapInArrow(run, rows.withColumn(out, F.lit("")).schema)
