"""Modules, and the functions that came with them."""

import pytest

from pipewright.lang.interp import Env, evaluate, run
from pipewright.lang.modules import find, load
from pipewright.lang.parser import SyntaxProblem
from pipewright.lang.values import Halt
from pipewright.operators.dynamic import apply_json

MODULES = {"m": 'module {"v": 1}; import "n" as n; def f: n::g + 1; def h($x): $x * 2;', "n": "def g: 40;", "d": "1 [2]", "a": 'include "b";', "b": 'include "a";'}


def outputs(program, value=None):
    tree, env = load(program, MODULES)
    return list(run(tree, value, Env(env.vars, env.funcs)))


def test_modules(spark, tmp_path):
    assert outputs('import "m" as m; m::f, m::h(.)', 3) == [41, 6]
    assert outputs('include "m"; import "d" as $d; h(f), $d::d') == [82, [1, [2]]]
    for bad in ('import "x" as x; 1', 'include "a"; 1', 'import "m"; 1'):
        with pytest.raises(SyntaxProblem):
            outputs(bad)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "t.jq").write_text("def t: . + 1;")
    df = spark.createDataFrame([("1",), ("2",)], "value string")
    got = apply_json(df, 'import "s/t" as t; t::t', modules=find([str(tmp_path)]))
    assert sorted(r.output for r in got.collect()) == ["2", "3"]


@pytest.mark.parametrize(
    "program, want",
    [
        ("1 | j0", 0.7651976865579666), ("1 | j1", 0.44005058574493355), ("jn(2; 1)", 0.1149034849319005), ("1 | y0", 0.08825696421567697),
        ("1 | y1", -0.7812128213002887), ("yn(2; 1)", -1.6506826068162543), ("0.5 | erf", 0.5204998778130465), ("5 | ilogb", 2),
    ],
)
def test_functions(program, want):
    assert evaluate(program)[0] == pytest.approx(want, rel=1e-9)


def test_chance():
    assert evaluate("randint(3; 4), ([7] | choice), (uuidv7 | .[14:15]), (uuidv4 | length)") == [3, 7, "7", 36]
    assert evaluate("[1, infinite, nan] | map(isfinite)")[0] == [True, False, True]
    assert "map/1" in evaluate("builtins")[0]
    with pytest.raises(Halt) as e:
        evaluate('try ("x" | halt_error(3)) catch .')
    assert (e.value.status, e.value.message) == (3, "x")
