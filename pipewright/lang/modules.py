"""Modules: ``import "m" as m;`` (functions m::f), ``include "m";`` and ``import "d" as $d;`` (data, $d::d).

Modules are texts by name, read on the driver and shipped with a program, so that executors open no files.
"""

from __future__ import annotations

from pathlib import Path

from .interp import Env
from .parser import SyntaxProblem, _Parser, tokens
from .values import FilterError


def find(search: list[str]) -> dict[str, str]:
    """The texts of all modules (.jq) and data files (.json) under the search folders, by path without the ending; the
    first folder that has a name gives it."""
    out: dict[str, str] = {}
    for folder in search:
        for file in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".jq", ".json")):
            out.setdefault(str(file.relative_to(folder).with_suffix("")), file.read_text())
    return out


def _head(toks: list[tuple]):
    """The directives at a program's start as (word, path, alias), and the tokens after them."""
    out, i = [], 0
    while toks[i][0] == "id" and toks[i][1] in ("module", "import", "include"):
        word, path, alias = toks[i][1], None, None
        i += 1
        if word != "module":
            if toks[i][0] != "str" or len(toks[i][1]) != 1:
                raise SyntaxProblem(f"{word} needs a constant path")
            path, i = toks[i][1][0], i + 1
            if toks[i] == ("id", "as"):
                alias, i = toks[i + 1], i + 2
            if (word == "import") != (alias is not None):
                raise SyntaxProblem("import needs a name, include takes none")
        while toks[i] != ("op", ";"):
            if toks[i][0] == "eof":
                raise SyntaxProblem(f"{word} does not end")
            i += 1
        i += 1
        out.append((word, path, alias))
    return out, toks[i:]


def load(program: str, modules: dict[str, str] | None = None, variables: dict | None = None, open_: tuple[str, ...] = ()):
    """(tree, environment) of a program; a cycle of modules is an error.

    A program is text, a tree, or ("headed", directives, tree).
    """
    if not isinstance(program, str):
        if program[0] != "headed":
            return program, Env(vars=variables)
        return program[2], load(program[1] + " .", modules, variables)[1]
    heads, rest = _head(tokens(program))
    env = Env(vars=variables)
    for word, path, alias in heads:
        if word == "module":
            continue
        if path not in (modules or {}):
            raise SyntaxProblem(f"module {path!r} not found")
        if path in open_:
            raise SyntaxProblem(f"modules import each other: {' '.join((*open_, path))}")
        if alias and alias[0] == "var":
            from pipewright.sources.formats import decode

            data, name = list(decode(modules[path], "json")), alias[1][1:]
            env = env.bind_all({name: data, f"{name}::{name}": data})
            continue
        prefix = f"{alias[1]}::" if alias else ""
        found = {(prefix + n, k): f for (n, k), f in definitions(modules[path], modules, (*open_, path)).items()}
        env = Env(env.vars, {**env.funcs, **found}, env.state)
    return _Parser(rest).program(), env


def described(name: str, modules: dict[str, str]) -> dict:
    """What a module says of itself: its metadata, what it imports (deps) and what it defines (defs)."""
    from .interp import evaluate

    if name not in modules:
        raise FilterError(f"module {name!r} not found")
    toks = tokens(modules[name])
    out, deps, i = {}, [], 0
    while toks[i][0] == "id" and toks[i][1] in ("module", "import", "include"):
        end = next(k for k in range(i, len(toks)) if toks[k] == ("op", ";"))
        word, rest = toks[i][1], toks[i + 1 : end]
        head = [] if word == "module" else rest[:1]
        rest = rest[len(head) :]
        alias = rest[1][1].lstrip("$") if rest[:1] == [("id", "as")] else head[0][1][0] if head else None
        data = rest[:1] == [("id", "as")] and rest[1][0] == "var"
        rest = rest[2:] if rest[:1] == [("id", "as")] else rest
        given = evaluate(_Parser([*rest, ("eof", "")]).program())[0] if rest else {}
        if word == "module":
            out |= given
        else:
            deps.append({**given, "as": alias, "is_data": data, "relpath": head[0][1][0]})
        i = end + 1
    return {**out, "deps": deps, "defs": [f"{n}/{k}" for n, k in definitions(modules[name], modules)]}


def definitions(text: str, modules: dict[str, str] | None = None, open_: tuple[str, ...] = ()) -> dict:
    """The functions that a module's text defines."""
    tree, env = load(text, modules, None, open_)
    out = {}
    while tree[0] == "def":
        _, name, params, body, tree = tree
        env = env.define((name, len(params)), None)
        env.funcs[name, len(params)] = out[name, len(params)] = (params, body, env)
    if tree != ("identity",):
        raise SyntaxProblem("a module may only define functions")
    return out
