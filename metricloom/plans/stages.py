"""An evaluation as stages that users add to: evaluators, validators and writers, each after those that it names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from metricloom.operators import validation
from metricloom.plans.config import EvalConfig
from metricloom.plans.evaluate import evaluate
from metricloom.sources.results import write_results

Results = dict[str, DataFrame]
#: What a stage does; stages of a later kind come after all of an earlier one.
KINDS = ("evaluator", "validator", "writer")


@dataclass(frozen=True)
class Stage:
    """``run`` takes the examples, the configuration and the results so far, and gives new results by name, or none."""

    name: str
    run: Callable[[DataFrame, EvalConfig, Results], Results | None]
    kind: str = "evaluator"
    run_after: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"a stage is one of {', '.join(KINDS)}")


METRICS = Stage("metrics", lambda df, config, _: evaluate(df, config))


def verdict() -> Stage:
    """One row of whether all thresholds hold, which counts slices that should be there and are not."""

    def run(df: DataFrame, config: EvalConfig, results: Results) -> Results | None:
        return {"verdict": validation.verdict(results["validations"], results["missing_slices"])} if "validations" in results else None

    return Stage("verdict", run, "validator")


def files(path: str, names: Sequence[str] = (), form: str = "parquet") -> Stage:
    """Results, all or those of some names, as folders of files with the configuration."""

    def run(df: DataFrame, config: EvalConfig, results: Results) -> None:
        write_results({n: x for n, x in results.items() if not names or n in names}, config, path, form)

    return Stage("files", run, "writer")


def ordered(stages: Sequence[Stage]) -> list[Stage]:
    """The stages in an order that all their wishes allow; among free ones by kind, then as they are given."""
    names = [s.name for s in stages]
    if len(set(names)) != len(names):
        raise ValueError("two stages have one name")
    for s in stages:
        for before in s.run_after:
            if before not in names:
                raise ValueError(f"{s.name} runs after {before}, which is not there")
    waiting, out = sorted(stages, key=lambda s: KINDS.index(s.kind)), []
    while waiting:
        free = next((s for s in waiting if all(b in {d.name for d in out} for b in s.run_after)), None)
        if free is None:
            raise ValueError(f"stages wait for each other: {', '.join(sorted(s.name for s in waiting))}")
        out.append(free)
        waiting.remove(free)
    return out


def run(df: DataFrame, config: EvalConfig, more: Sequence[Stage] = (), stages: Sequence[Stage] | None = None) -> Results:
    """The results of all stages: those of an evaluation and ``more``, or ``stages`` alone.

    Two stages with a result of the same name are an error, so none is lost.
    """
    out: Results = {}
    for stage in ordered([*([METRICS, verdict()] if stages is None else stages), *more]):
        for name, frame in (stage.run(df, config, dict(out)) or {}).items():
            if name in out:
                raise ValueError(f"{stage.name} makes {name}, which is there already")
            out[name] = frame
    return out
