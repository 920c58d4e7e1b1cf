"""A session: definitions and variables that build up, and programs that run over DataFrames with them.

Definitions are kept as text and shipped with each program, so executors need nothing but the program.  Adding one is
all or nothing; ``checkpoint`` and ``rollback`` undo what came after.
"""

from __future__ import annotations

import os
import sys
import threading
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from pipewright.lang.interp import Env, run
from pipewright.lang.modules import definitions, load
from pipewright.lang.printer import split_directives
from pipewright.operators.dynamic import apply_json, apply_rows
from pipewright.plans.lower import lower


class State(NamedTuple):
    sources: tuple[str, ...] = ()
    variables: tuple[tuple[str, object], ...] = ()


class Cancelled(BaseException):
    """Raised inside a run that was cancelled; no program can catch it."""


class Run:
    """A program on one value that stops when its fuel is used up, and can go on or be cancelled.

    It runs on a thread of its own, which waits between two calls of ``go``.  Fuel is counted in function calls of the
    interpreter, which grow in proportion to the steps of the program.
    """

    def __init__(self, outputs):
        self._outputs, self._made, self._fuel = outputs, [], 0
        self._turn, self._back = threading.Semaphore(0), threading.Semaphore(0)
        self.state, self.error, self._stop = "ready", None, False
        self._thread = threading.Thread(target=self._work, daemon=True)

    def _count(self, frame, event, arg):
        if event == "call":
            self._fuel -= 1
            if self._fuel < 0:
                self.state = "suspended"
                self._back.release()
                self._turn.acquire()
                if self._stop:
                    raise Cancelled

    def _work(self):
        self._turn.acquire()
        sys.setprofile(self._count)
        try:
            for x in self._outputs():
                self._made.append(x)
            self.state = "done"
        except Cancelled:
            self.state = "cancelled"
        except Exception as e:  # noqa: BLE001  whatever ended the program is the run's result
            self.state, self.error = "failed", e
        finally:
            sys.setprofile(None)
            self._back.release()

    def go(self, fuel: int) -> list:
        """The outputs made with so much fuel; ``state`` then is done, suspended or failed."""
        if self.state in ("done", "failed", "cancelled"):
            return []
        if self.state == "ready":
            self._thread.start()
        self._fuel, self.state = fuel, "running"
        self._turn.release()
        self._back.acquire()
        made, self._made = self._made, []
        return made

    def cancel(self) -> None:
        """End a run that is suspended or has not begun."""
        self._stop = True
        if self.state == "suspended":
            self._turn.release()
            self._back.acquire()
        elif self.state == "ready":
            self.state = "cancelled"


class Engine:
    def __init__(self, spark: SparkSession, modules: dict[str, str] | None = None):
        self.spark, self.modules, self._state = spark, dict(modules or {}), State()

    def define(self, source: str) -> None:
        """Add functions (``def f: ...;``).  A problem in the text leaves the session as it was."""
        definitions(source, self.modules)
        self._state = self._state._replace(sources=(*self._state.sources, source))

    def bind(self, name: str, value) -> None:
        """Give ``$name`` a value."""
        self._state = self._state._replace(variables=(*self._state.variables, (name, value)))

    @property
    def variables(self) -> dict:
        return dict(self._state.variables)

    def checkpoint(self) -> State:
        return self._state

    def rollback(self, state: State) -> None:
        self._state = state

    def reset(self) -> None:
        self._state = State()

    def dump(self) -> str:
        """The session's definitions, in the order they came."""
        return "".join(f"{s.strip()}\n" for s in self._state.sources)

    def _whole(self, program: str) -> str:
        """The program after the session's definitions, with the directives of all of them first."""
        heads, bodies = zip(*map(split_directives, (*self._state.sources, program)), strict=True)
        return "".join(heads) + "\n".join(bodies)

    def evaluate(self, program: str, value=None, inputs=()) -> list:
        """All outputs on one value, on the driver."""
        tree, env = load(self._whole(program), self.modules, self.variables)
        return list(run(tree, value, Env(env.vars, env.funcs, {"inputs": iter(inputs), "env": os.environ, "modules": self.modules})))

    def start(self, program: str, value=None, inputs=()) -> Run:
        """The program on one value, to be run with ``go`` as fuel is given."""
        tree, env = load(self._whole(program), self.modules, self.variables)
        return Run(lambda: run(tree, value, Env(env.vars, env.funcs, {"inputs": iter(inputs), "env": os.environ, "modules": self.modules})))

    def documents(self, df: DataFrame, program: str, column: str = "value", keep: tuple[str, ...] = (), errors: str = "raise") -> DataFrame:
        """Outputs on each document of JSON text."""
        return apply_json(df, self._whole(program), column, keep, self.variables, errors, self.modules)

    def rows(self, df: DataFrame, program: str, keep: tuple[str, ...] = (), errors: str = "raise") -> DataFrame:
        """Outputs on each row, as a JSON object."""
        return apply_rows(df, self._whole(program), keep, variables=self.variables, errors=errors, modules=self.modules)

    def table(self, df: DataFrame, program: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """A program over a whole table, lowered to a DataFrame plan."""
        return lower(df, self._whole(program), tables, self.variables, modules=self.modules)

    def run(self, df: DataFrame | None, program: str, tables: dict[str, DataFrame] | None = None, schema: str | None = None) -> DataFrame:
        """Any program over a table (of null where there is none); see ``plans.lower``."""
        return lower(self.spark if df is None else df, self._whole(program), tables, self.variables, schema, modules=self.modules)
