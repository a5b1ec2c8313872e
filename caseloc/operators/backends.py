"""Flow backends as plug-ins: functions from frames to flows, checked when they are
registered and run together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a backend is given, and what it must give.
INPUTS = {
    "terms": "term string",
    "files": "path string, text string",
    "lines": "path string, line_no int, line string",
    "entities": "path string, kind string, name string, start_line int, end_line int",
}
FLOWS = (("term", "string"), ("flow_type", "string"), ("confidence", "double"))

Backend = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]


class FlowBackends:
    """Named backends. ``register`` plans a backend on empty frames, so one that does
    not give (term, flow_type, confidence) is refused before any data is read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register(self, name: str, backend: Backend) -> None:
        if not name or name in self.known:
            raise ValueError(f"a backend needs a name of its own: {name!r}")
        empty = [self.spark.createDataFrame([], schema) for schema in INPUTS.values()]
        given = {f.name: f.dataType.simpleString() for f in backend(*empty).schema}
        lacking = [f"{column} {kind}" for column, kind in FLOWS if given.get(column) != kind]
        if lacking:
            raise TypeError(f"backend {name} lacks {', '.join(lacking)}")
        self.known[name] = backend

    def run(self, terms: DataFrame, files: DataFrame, lines: DataFrame, entities: DataFrame, names: list[str] | None = None) -> DataFrame:
        """(backend, term, flow_type, confidence) of all backends, or the named ones."""
        out = None
        for name in names if names is not None else self.known:
            flows = self.known[name](terms, files, lines, entities).select(F.lit(name).alias("backend"), *[c for c, _ in FLOWS])
            out = flows if out is None else out.unionByName(flows)
        if out is None:
            raise ValueError("no backend")
        return out
