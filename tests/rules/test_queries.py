"""Every query with a SQL counterpart against DuckDB, on the smallest data."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rulespark.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in DATA.iterdir():
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def closure(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        ready, seen = [a], set()
        while ready:
            fresh = after.get(ready.pop(), set()) - seen
            seen |= fresh
            ready += fresh
        out |= {(a, b) for b in seen}
    return out


def test_reach_covers_all_orders(spark, tmp_path):
    lines = [(o, n, 10 * (o // 300) + n + o % 2) for o in (1, 2, 399, 400, 401, 900, 901) for n in range(1, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    of = {(o, n): p for o, n, p in lines}
    want = closure((p, of[o, n + 1]) for (o, n), p in of.items() if (o, n + 1) in of)
    got = [tuple(r) for r in QUERIES["q29_reach"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and any(a >= 30 for a, _ in want)


def events(spark, path, kinds):
    """``kinds`` by user, in the order of time; the table is written in another."""
    rows = [(u, n, n, kind) for u, own in kinds.items() for n, kind in enumerate(own)]
    frame = spark.createDataFrame(rows[::-1], "user_id long, ts long, event_id long, event_type string")
    frame.write.parquet(str(path / "events.parquet"))


def test_parsing_takes_whole_sequences(spark, tmp_path):
    kinds = {1: ["click"] * 7 + ["view", "purchase"] * 10 + ["error"] + ["view"] * 4, 2: ["purchase"]}
    events(spark, tmp_path, kinds)
    want = set()
    for u, own in kinds.items():
        for i, kind in enumerate(own):
            want.add((u, i, i + 1, {"purchase": "P", "view": "V"}.get(kind, "X")))
            for k in range(i + 1, len(own) + 1):
                if set(own[i:k]) <= {"view", "purchase"}:
                    want.add((u, i, k, "A"))
    got = [tuple(r) for r in QUERIES["q32_cky"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_forward_weights_take_whole_sequences(spark, tmp_path):
    kinds = {1: [("view", "click", "purchase")[n * n % 7 % 3] for n in range(600)], 2: ["error"], 3: ["view"] * 9}
    events(spark, tmp_path, kinds)
    want = set()
    for u, own in kinds.items():
        x, y = len(own[0]) % 3 + 1, 1
        for t, kind in enumerate(own, 1):
            if t > 1:
                x, y = (x * 2 + y) * (len(kind) % 3 + 1), x + y * 3
            want.add((u, t, x % 1000003, y % 1000003))
    got = [tuple(r) for r in QUERIES["q33_hmm_forward"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_string_sums_take_all_customers(spark, tmp_path):
    rows = [(c, c % 3, "abc"[c % 3] + str(c % 7)) for c in range(1, 500)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = dict(tuple(r) for r in QUERIES["q43_string_sum"](spark, str(tmp_path)).collect())
    assert got == {n: "".join(sorted(s for _, m, s in rows if m == n)) for n in range(3)}


def test_plans_push_down_and_prune(spark):
    text = QUERIES["q01_sum_revenue"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in text and "CartesianProduct" not in text and "Python" not in text
    text = QUERIES["q38_semi_join"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in text and "EqualTo(o_orderpriority,1-URGENT)" in text
    text = QUERIES["q35_backchain_fn"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_the_library_does_without_its_optional_parts():
    """Everything but the training-data operators works where those are gone."""
    code = (
        "import sys; sys.modules['rulespark.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); assert 'q01_sum_revenue' in q and not any(n.startswith('op') for n in q)\n"
        "import rulespark.session.program, rulespark.session.repl, rulespark.streaming.adapter, rulespark.__main__\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(REPO)})
    assert done.returncode == 0, done.stderr
