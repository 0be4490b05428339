"""What a document leaves to the program: callbacks by name, progress of streams and jobs, and stopping them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..errors import QuernError

#: Functions by the names that documents call them: (frames by system, config) -> frames that change.
CALLBACKS: dict[str, Callable[[Mapping[str, DataFrame], Mapping], Mapping[str, DataFrame]]] = {}


def callback(name: str):
    """Register a function as a callback, or as an operator to apply."""

    def add(f):
        CALLBACKS[name] = f
        return f

    return add


def run_callbacks(coupling: list[Mapping], frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Frames by system after the couplings `callback` and `operator_apply` of a document, in its order. A name without a function, or a change to an unknown system, is an error."""
    out = dict(frames)
    for c in coupling:
        name = {"callback": c.get("callback_id"), "operator_apply": c.get("operator")}.get(c.get("type"))
        if c.get("type") not in ("callback", "operator_apply"):
            continue
        if name not in CALLBACKS:
            raise QuernError("unknown_callback", f"{name}")
        changed = CALLBACKS[name](dict(out), c.get("config") or {})
        if extra := set(changed) - set(out):
            raise QuernError("undefined_system", f"{name} changes {sorted(extra)}")
        out |= changed
    return out


#: Functions that compute a parameter's new value: (variables, parameters, config) -> frame of the parameter's axes and `value`.
HANDLERS: dict[str, Callable[[Mapping[str, DataFrame], Mapping[str, DataFrame], Mapping], DataFrame]] = {}


def handler(name: str):
    """Register a function as the handler of parameters' updates."""

    def add(f):
        HANDLERS[name] = f
        return f

    return add


def handled(rule: Mapping, variables: Mapping[str, DataFrame], parameters: Mapping[str, DataFrame]) -> DataFrame:
    """A parameter's new value by its update rule's handler, which sees what the rule says that it reads, and nothing else."""
    h = rule.get("handler") or {}
    if h.get("handler_id") not in HANDLERS:
        raise QuernError("unknown_handler", f"{h.get('handler_id')}")
    for names, frames in ((h.get("read_vars"), variables), (h.get("read_params"), parameters)):
        if missing := [n for n in names or [] if n not in frames]:
            raise QuernError("undefined_name", f"{missing}")
    return HANDLERS[h["handler_id"]]({n: variables[n] for n in h.get("read_vars") or []}, {n: parameters[n] for n in h.get("read_params") or []}, h.get("config") or {})


class Progress(StreamingQueryListener):
    """Tells `heard` of each micro-batch (stream's name, batch number, rows) and of ends; a failure of `heard` stops no stream."""

    def __init__(self, heard: Callable[[str, int, int], None]):
        self.heard = heard

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.heard(p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def cancellable(spark: SparkSession, work: Callable[[], object], stop: Callable[[], bool], every: float = 0.2):
    """What work() gives; its Spark jobs are cancelled once stop() says so, and then an error tells it."""
    tag, done, told = f"quern-{uuid.uuid4().hex}", threading.Event(), []

    def watch() -> None:
        while not done.wait(every):
            if stop():
                told.append(True)
                spark.sparkContext.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        return work()
    except Exception as e:
        if told:
            raise QuernError("cancelled", "as asked") from e
        raise
    finally:
        done.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)
