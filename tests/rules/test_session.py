import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rulespark.lang.ast import RuleError
from rulespark.session import render
from rulespark.session.program import Program
from rulespark.session.repl import Session
from rulespark.session.trace import circuit, dot
from rulespark.sources import loaders
from rulespark.streaming.adapter import StreamedRelation

REPO = Path(__file__).resolve().parents[2]


def test_solution_text(spark):
    p = Program(spark, """
        far("bb","c") := 12.  far("a","c") := 3.  start := "a".  seen.  ok(1).  x max= 2 with_key &k(1).
        bad(1) = 1.  bad(1) = 2.  z := 1 / 0.""")  # fmt: skip
    assert p.solution() == """
Solution
========
seen.
start = "a".
x = 2.

$key/1
======
$key(x) = k(1).

bad/1
=====
bad(1) = $error.

far/2
=====
far("a","c")  = 3.
far("bb","c") = 12.

ok/1
====
ok(1).

Errors
======
Error(s) aggregating bad/1:
  ["1"] AggregatorError: `=` got conflicting values
Error(s) in rule 8:
    z := 1 / 0.
  ZeroDivisionError: division by zero
"""
    assert Program(spark).solution() == "Solution empty.\n"


def test_long_items_are_padded_to_forty(spark):
    p = Program(spark, 'f("' + "x" * 50 + '") := 1.  f("y") := 2.')
    assert 'f("y")' + " " * 34 + " = 2." in p.solution()


def test_errors_list_five_of_each(spark):
    p = Program(spark, "v(K) := 0 for K in range(9).  y(K) = K for _ is v(K).  y(K) = K + 1 for _ is v(K).")
    assert "  4 more ..." in p.solution()


def test_commands(spark):
    s = Session(Program(spark))
    assert s.run("rules") == "No rules found."
    assert s.run("a += 1. a += 2. b(X) += a for X in [1].") == "Changes\n=======\na = 3.\nb(1) = 3."
    assert s.run("query b(X)") == "b(1) = 3." and s.run("vquery b(X)") == "3 where {X=1}" and s.run("vquery a") == "3 where {}"
    assert s.run("rules").splitlines()[2:] == ["  0: a += 1.", "  1: a += 2.", "  2: b(X) += a for X in [1]."]
    assert s.run("a += 1") == "ERROR: Line doesn't end with period."
    assert s.run("query") == "No query specified. Type `help query` for usage." and s.run("query a.") == "Queries don't end with a dot."
    assert s.run("query xxxx") == "No results." and s.run("trace xxxx") == "no items matching `xxxx`."
    assert s.run("retract_rule q").startswith("Please specify an integer") and s.run("retract_rule 77").startswith("Rule 77 not found.")
    assert s.run("c += 1/0.") == ">>> 1 new errors. Type `sol` for details."
    assert s.run("retract_rule 3") == ">>> 1 errors cleared."
    assert s.run("retract_rule 0") == "Changes\n=======\na = 2.\nb(1) = 2."
    assert "Conflicting aggregators" in s.run("a max= 2.")
    assert s.run("load x = qweopr/;") == "Error: failed to parse load command." and s.run("load x = yyy()") == "did not recognize loader 'yyy'"
    assert s.run('load x = tsv("no/such")') == "file `no/such` does not exist." and s.run("post nope()") == "did not recognize post-processor 'nope'"
    assert s.run("help load").startswith("load NAME") and s.run("help what") == 'No help available for "what"'
    assert "scan" in s.run("explain b") and "Physical Plan" in s.run("explain b")
    with pytest.raises(SystemExit):
        s.run("exit")


def test_traces(spark):
    p = Program(spark, """
        a += 1.  a += a / 2.
        :- backchain f/1.  f(X) := f(X-1) + f(X-2) for X > 1.  f(1) := 1.  f(0) := 1.  b := f(3).""")  # fmt: skip
    a = p.trace("a")
    assert a.splitlines()[0] == "a = 2.0" and "continue as before (cyclic structure" in a and "a += a / 2." in a
    b = p.trace("b")
    assert "f(3) = 3" in b and "f(1) = 1" in b and "continue as before (shared structure)" in b
    assert "*max depth*" in p.trace("b", limit=1)


def test_circuit(spark):
    p = Program(spark, 'edge("a","b") := 3.  path("a") min= 0.  path(B) min= path(A) + edge(A,B).')
    graph = circuit(p)
    assert {"head": 'path("b")', "rule": 2, "value": "3", "body": ['path("a")', 'edge("a","b")']} in graph["edges"]
    assert '"path(\\"b\\")"' in dot(p)


def test_loaders(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\tS\tNP VP\n2\tNP\tDet N\n\n3\tonly two\n0\tX\ty\t\t\n")
    (tmp_path / "m.txt").write_text("1 2.5 3\n4\n5 6\n")
    (tmp_path / "e.txt").write_text('; comment\n(S (NP "George W") (VP sleeps))\n(A)\nleaf ()\n')
    p = Program(spark, "rule(X,Y,Z) := float(C) for r(_,C,X,R), [Y,Z] is split(R, \"\\\\s+\").")
    p.load(f'r = tsv("{tmp_path}/t.tsv")')
    p.load(f'm = matrix("{tmp_path}/m.txt")')
    p.load(f'w = matrix("{tmp_path}/m.txt", astype=str)')
    p.load(f'line = read_lines("{tmp_path}/m.txt")')
    assert p.items("line") == {(0,): "1 2.5 3", (1,): "4", (2,): "5 6"}
    p.load(f'load tree = sexpr("{tmp_path}/e.txt")')
    assert set(p.items("r/4")) == {(0, "1", "S", "NP VP"), (1, "2", "NP", "Det N"), (4, "0", "X", "y")}
    assert set(p.items("r/2")) == {(2, "")} and set(p.items("r/3")) == {(3, "3", "only two")}
    assert p.items("rule") == {("S", "NP", "VP"): 1.0, ("NP", "Det", "N"): 2.0}
    assert p.items("m") == {(0, 0): 1.0, (0, 1): 2.5, (0, 2): 3.0, (1, 0): 4.0, (2, 0): 5.0, (2, 1): 6.0} and p.items("w")[0, 1] == "2.5"
    assert p.items("tree") == {(0,): ("S", ("NP", "George W"), ("VP", "sleeps")), (1,): ("A",), (2,): "leaf", (3,): ()}
    p.add("label(I) := L for [L|_] is tree(I).")
    assert p.items("label") == {(0,): "S", (1,): "A"}
    for bad in ['x = tsv(")', "x = sexpr(open('f'))", 'x = matrix("a", astype=complex)']:
        with pytest.raises((RuleError, FileNotFoundError)):
            p.load(bad)


def test_trees_of_several_files(spark, tmp_path):
    folder = tmp_path / "trees"
    folder.mkdir()
    for name, text in [("b", "(three) four"), ("a", "(one (two))"), ("c", ""), ("d", "; none\n(five)")]:
        (folder / name).write_text(text)
    p = Program(spark)
    p.load(f'tree = sexpr("{folder}")')
    assert p.items("tree") == {(0,): ("one", ("two",)), (1,): ("three",), (2,): "four", (3,): ("five",)}
    (folder / "e").write_text("(not closed")
    with pytest.raises(RuleError, match="not closed"):
        p.load(f'other = sexpr("{folder}")')
    (tmp_path / "blank").write_text("")
    p.load(f'tree = sexpr("{tmp_path}/blank")')
    assert p.items("tree") == {}


def test_line_numbers_over_many_partitions(spark, tmp_path):
    (tmp_path / "n.txt").write_text("\n".join(f"{i} x" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = loaders.numbered_lines(spark, str(tmp_path / "n.txt"))
        assert got.select("line").distinct().count() == 3000
        assert got.where(F.split("text", " ")[0].cast("long") != F.col("line")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_paste(spark, tmp_path):
    s = Session(Program(spark))
    assert "total = 7" in s.run("paste\n total +=\n  part(K)\n  for K > 0.\n part(0) := 9.  part(1) := 3.\n part(2)\n := 4.")
    assert s.run("paste") == "" and "lines may break" in s.run("help paste")
    (tmp_path / "in.rules").write_text("a += 1.\n")
    done = subprocess.run(
        [sys.executable, "-m", "rulespark", str(tmp_path / "in.rules"), "-i", "--master", "local[1]"],
        cwd=REPO, capture_output=True, text=True, timeout=180, input="paste\na +=\n 4.\n\nquery a\n",
    )
    assert done.returncode == 0 and "a = 5" in done.stdout.split("> ")[-2]


def test_posts(spark, tmp_path):
    s = Session(Program(spark, "a += 1.  b := a."))
    assert "b = 1." in s.run("post dump_solution()")
    s.run(f'post dump_solution("{tmp_path}/s.txt")')
    assert "a = 1." in (tmp_path / "s.txt").read_text()
    s.run(f'post draw_circuit("{tmp_path}/c.json")')
    assert len(json.loads((tmp_path / "c.json").read_text())["edges"]) == 2
    assert "b := a." in s.run("post trace()")
    s.run(f'post save("{tmp_path}/saved")')
    t = Session(Program(spark))
    t.run(f'load p = pickled("{tmp_path}/saved")')
    assert t.program.value("b") == 1


def test_command_line(tmp_path):
    (tmp_path / "one.rules").write_text("a += 1.\n")
    (tmp_path / "two.rules").write_text("a += b(0,1).\n")
    (tmp_path / "m.txt").write_text("1 2\n")
    done = subprocess.run(
        [sys.executable, "-m", "rulespark", str(tmp_path / "one.rules"), str(tmp_path / "two.rules"), "-o", str(tmp_path / "out"), "--master", "local[1]",
         "--load", f'b = matrix("{tmp_path}/m.txt", astype=int)', "--post-process", f'draw_circuit("{tmp_path}/c.dot")'],
        cwd=REPO, capture_output=True, text=True, timeout=180,
    )
    assert done.returncode == 0, done.stderr
    assert "a = 3." in (tmp_path / "out").read_text() and "digraph" in (tmp_path / "c.dot").read_text()


def test_streamed_relation(spark, tmp_path):
    source = tmp_path / "in"
    rows = lambda n, k: spark.createDataFrame([("x", n), ("y", 1)], "k string, v long").coalesce(1).write.mode("append").parquet(str(source))
    rows(1, 0)
    p = Program(spark, "total += n(_).")
    grown = StreamedRelation(p, "n", ["k"], "v", "k string, v long", "+=", str(tmp_path / "held"))
    assert p.value("total") is None
    stream = spark.readStream.schema("k string, v long").parquet(str(source))
    for expected in (2, 8):
        q = grown.start(stream, str(tmp_path / "check"), availableNow=True)
        q.awaitTermination(60)
        assert p.value("total") == expected
        rows(5, 1)
    grown.take(spark.createDataFrame([("z", 100)], "k string, v long"), 900)
    grown.take(spark.createDataFrame([("z", 100)], "k string, v long"), 900)  # the same batch again
    assert p.value("total") == 108 and p.items("n") == {("x",): 6, ("y",): 2, ("z",): 100}


def test_rendering_of_rules_as_data(spark):
    p = Program(spark, "a += b(X) for X < 3.  b(1) := 2.")
    got = {r.rule: (r.functor, r.aggregator, r.source) for r in p.rules_frame().collect()}
    assert got == {0: ("a/0", "+=", "a += b(X) for X < 3."), 1: ("b/1", ":=", "b(1) := 2.")}
    assert render.rules(p).startswith("Rules\n=====\n  0: a += b(X)")
