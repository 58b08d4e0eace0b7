"""Registries of models that turn audio into notes or tempi.

A transcriber is a function of an iterator of pandas frames of audio blocks that yields frames of
notes; it runs in ``mapInPandas``, so a model is loaded once in each worker. The models of the
contract have no weights here: their names are known, and asking for one says what is missing.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import dealt

NOTES = "song_id long, stem string, note_id long, pitch int, velocity int, start_s double, end_s double"
Transcriber = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class BackendError(RuntimeError):
    pass


_transcribers: dict[str, Transcriber] = {}
_estimators: dict[str, Callable] = {}
KNOWN = ("muscriptor", "basic-pitch", "adt-str")
NON_COMMERCIAL = {"muscriptor", "adt-str"}


def register(name: str, f: Transcriber) -> None:
    _transcribers[name] = f


def register_estimator(name: str, f: Callable) -> None:
    _estimators[name] = f


def _get(found: dict, name: str, kind: str):
    if name in found:
        return found[name]
    if name in KNOWN:
        raise BackendError(f"{kind} {name!r} needs a model that is not installed; register() one under this name")
    raise BackendError(f"unknown {kind} {name!r}; there is: {', '.join(sorted(found)) or 'none'}")


def guard(name: str) -> None:
    """Refuses models for non-commercial use where only commercial ones may run, before any work."""
    if os.environ.get("TONEWRIGHT_COMMERCIAL", "").lower() in ("1", "true", "yes") and name in NON_COMMERCIAL:
        raise BackendError(f"{name!r} is for non-commercial use only")


def device(gpus: float, cpus: int = 1):
    """What a task of a model needs: a share of a device, of which an executor has one."""
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    tasks = TaskResourceRequests().cpus(cpus).resource("gpu", gpus)
    return ResourceProfileBuilder().require(ExecutorResourceRequests().cores(max(cpus, round(1 / gpus) * cpus if gpus < 1 else cpus)).resource("gpu", max(1, int(gpus)))).require(tasks).build


def transcribe(blocks: DataFrame, name: str, gpus: float = 0.0) -> DataFrame:
    """Notes of stems' blocks. With ``gpus`` the model's tasks are a stage of their own, between two exchanges,
    on executors that have devices; the stages around it don't hold any."""
    guard(name)
    model = _get(_transcribers, name, "transcriber")
    if not gpus:
        return blocks.mapInPandas(model, NOTES)
    held = dealt(blocks, "song_id", "stem").mapInPandas(model, NOTES, barrier=False, profile=device(gpus))
    return dealt(held, "song_id", "stem")


def estimate_tempo(notes: DataFrame, name: str = "autocorrelation") -> DataFrame:
    return _get(_estimators, name, "estimator")(notes)


def _autocorrelation(notes: DataFrame) -> DataFrame:
    from ..operators.tempo import onset_tempo

    return onset_tempo(notes)


register_estimator("autocorrelation", _autocorrelation)
