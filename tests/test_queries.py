"""Every driver query of the language against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from pipewright import queries as programs
from pipewright.functions.columns import NotLowered
from pipewright.operators.dynamic import apply_json
from pipewright.plans.lower import lower

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 3) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", programs.queries())
def test_query(spark, sql, name):
    got = programs.queries()[name](spark, DATA)
    want = sql.sql(programs.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    spot = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in spot) for r in want.fetchall()), key=repr)


def test_filter_reaches_the_scan(spark):
    plan = lower(spark.read.parquet(f"{DATA}/lineitem.parquet"), ".[] | select(.l_quantity > 25) | {l_orderkey}")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,25" in plan and "l_comment" not in plan


def test_not_lowered(spark):
    with pytest.raises(NotLowered):
        lower(spark.range(3), "foreach .[] as $x (0; . + $x)")


def test_dynamic_errors(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "[1]"), (3, None)], "id int, value string")
    kept = apply_json(rows, ".a", keep=("id",), errors="keep").orderBy("id").collect()
    assert [(r.id, r.pos, r.output, r.error is None) for r in kept] == [(1, 0, "1", True), (2, -1, None, False), (3, 0, "null", True)]
    assert apply_json(rows, ".a", keep=("id",), errors="skip").count() == 2


@pytest.fixture
def many_ranges(spark):
    """A session whose small shuffles are not joined into one partition, as those of large tables are not."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(
    "program, want",
    [
        ("sort_by(.k) | limit(7; skip(3; .[])) | {k}", lambda k: k[3:10]),
        ("sort_by(.k) | [skip(3; .[])] | .[:7] | map({k})", lambda k: k[3:10]),
        ("sort_by(-.k) | .[2990:] | map({k})", lambda k: k[::-1][2990:]),
        ("sort_by(.k) | .[10:-2980] | map({k})", lambda k: k[10:-2980]),
        ("sort_by(.none, .t, .k) | .[2990:] | map({k})", lambda k: sorted(k, key=lambda x: (x % 3, x))[2990:]),
        ("sort_by(.k) | foreach .[] as $r (0; . + 1; {k: ($r.k)}) | {k}", lambda k: k),
        ("sort_by(.k) | [foreach .[] as $r (0; . + 1)] | .[:5] | map({k: .})", lambda k: [1, 2, 3, 4, 5]),
    ],
)
def test_cuts_keep_the_order(many_ranges, program, want):
    rows = many_ranges.range(0, 3000, 1, 8).selectExpr("id * 1009 % 3000 as k", "cast(id * 1009 % 3000 % 3 as string) as t", "if(id % 2 = 0, null, null) as none", "id as pad")
    assert [r.k for r in lower(rows, program).collect()] == want(list(range(3000)))


def test_mathematics_beyond_the_domain(spark):
    rows = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 1.0), (4, -2.0), (5, None)], "id int, x double")
    names = ["log", "log2", "log10", "log1p", "atanh", "acosh", "asin"]
    made = lower(rows, ".[] | .x as $x | {id, " + ", ".join(f"{n}: ($x | {n})" for n in names) + "}", fallback=False).orderBy("id").collect()
    texts = {r.id: [None if v is None else str(round(v, 3) + 0.0) for v in r[1:]] for r in made}
    assert texts[1] == ["nan", "nan", "nan", "-inf", "-inf", "nan", "-1.571"]
    assert texts[2] == ["-inf", "-inf", "-inf", "0.0", "0.0", "nan", "0.0"]
    assert texts[3] == ["0.0", "0.0", "0.0", "0.693", "inf", "0.0", "1.571"]
    assert texts[4] == ["nan"] * 7 and texts[5] == [None] * 7
