"""Run configuration: groups of defaults, overridden by ``group.name=value`` in order; and a run's log."""

from __future__ import annotations

import copy
import json
import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("tracelens")

DEFAULTS: dict = {
    "data": {"limit": None},
    "evaluation": {"metric": "logprob", "normalize_by_length": True, "save_tokens": True, "save_entropies": False, "max_length": None},
    "methods": {
        "enabled": ["base", "simple_mean", "entropy_weighted_mean"],
        "patching": {"uniform": {"ratio": 4.0}, "entropy_threshold": {"ratio": 4.0}},
        "simple_mean": {"patching": "uniform"},
        "entropy_weighted_mean": {"patching": "entropy_threshold", "temperature": 0.0},
    },
}


def _value(text: str):
    """A value as JSON reads it; anything else is a text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def compose(overrides: Iterable[str] = (), defaults: Mapping = DEFAULTS) -> dict:
    """The defaults with ``group.name=value`` set; a group or name that is not there needs a leading ``+``."""
    out = copy.deepcopy(dict(defaults))
    for one in overrides:
        path, equals, text = one.partition("=")
        if not equals:
            raise ValueError(f"no value in {one}")
        new, (*groups, name) = path.startswith("+"), path.lstrip("+").split(".")
        at = out
        for g in groups:
            if g not in at and not new:
                raise KeyError(path)
            at = at.setdefault(g, {})
        if name not in at and not new:
            raise KeyError(path)
        at[name] = _value(text)
    return out


def resolved_text(config: Mapping) -> str:
    return json.dumps(config, indent=2, sort_keys=True)


class RunLog:
    """Metrics of a run as log lines and as rows (step, key, value)."""

    def __init__(self):
        self.rows: list[tuple[int, str, float]] = []

    def metrics(self, values: Mapping[str, float], step: int = 0) -> None:
        self.rows += [(step, k, float(v)) for k, v in values.items()]
        log.info("step %d: %s", step, " ".join(f"{k}={v:.4f}" for k, v in values.items()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "step int, key string, value double")
