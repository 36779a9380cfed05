"""File loaders: lines, delimited text, matrices, s-expressions and saved programs."""

from __future__ import annotations

import ast as python_ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.lang.ast import RuleError
from rulespark.operators import state
from rulespark.runtime import ship

LOADERS = ("read_lines", "tsv", "matrix", "sexpr", "pickled")
_COMMAND = re.compile(r"\s*(?:load\s+)?([a-z][A-Za-z0-9_]*)\s*=\s*([a-z][A-Za-z0-9_]*)\s*\((.*)\)\s*\.?\s*\Z", re.DOTALL)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a file, lines counted from 0 and right-stripped.

    Only counts by partition are gathered: a line's number is its place in its partition and the
    lines before that partition."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"\s+$", "").alias("text"))
    placed = raw.select(F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("own"), "text")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return placed.join(shifts, "part").select((F.col("own") + F.col("shift")).alias("line"), "text")


def _exists(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"file `{path}` does not exist.")


def read_lines(program, name: str, path: str):
    """name(i) = the i-th line of a file, without white space at its end."""
    _exists(program.spark, path)
    return program.bind(name, numbered_lines(program.spark, path), ["line"], "text", aggregator=":=", unique=True)


def tsv(program, name: str, path: str, delim: str = "\t"):
    """One true item a line: the line's number, then its fields as strings. Lines of different
    lengths are items of different arities; trailing empty fields vanish with the line's end."""
    _exists(program.spark, path)
    fields = numbered_lines(program.spark, path).select("line", F.split("text", delim).alias("f"))
    changes = None
    for r in sorted(fields.groupBy(F.size("f").alias("n")).count().collect()):
        n = r["n"]
        rows = fields.where(F.size("f") == n).select("line", *(F.get("f", F.lit(i)).alias(f"f{i}") for i in range(n)))
        changes = program.bind(name, rows, rows.columns, unique=True)
    return changes


def matrix(program, name: str, path: str, astype: str = "float", delim: str = r"\s+"):
    """name(i, j) = the j-th token of line i, as float, int or str; lines may differ in length."""
    _exists(program.spark, path)
    cells = numbered_lines(program.spark, path).select("line", F.posexplode(F.split("text", delim)).alias("col", "token"))
    kinds: dict[str, Column] = {"float": F.col("token").cast("double"), "int": F.col("token").cast("long"), "str": F.col("token")}
    if astype not in kinds:
        raise RuleError(f"cannot read cells as {astype!r}")
    rows = cells.select("line", F.col("col").cast("long").alias("col"), kinds[astype].alias("cell"))
    return program.bind(name, rows, ["line", "col"], "cell", aggregator=":=", unique=False)


_SEXPR = re.compile(r"\(|\)|\"(?:[^\"\\]|\\.)*\"|[^\s()\"]+")


def parse_sexprs(text: str) -> list:
    """Top-level s-expressions as nested tuples of strings; lines that start with ; are comments."""
    text = re.sub(r"(?m)^\s*;.*$", "", text)
    stack: list[list] = [[]]
    for m in _SEXPR.finditer(text):
        token = m[0]
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise RuleError("an s-expression ends before it starts")
            done = tuple(stack.pop())
            stack[-1].append(done)
        else:
            stack[-1].append(re.sub(r"\\(.)", r"\1", token[1:-1]) if token.startswith('"') else token)
    if len(stack) > 1:
        raise RuleError("an s-expression is not closed")
    return stack[0]


def sexpr(program, name: str, path: str):
    """name(i) = the i-th s-expression as a nested list, through all files by name. Trees are values
    without a static type. Each file is read by one task and written as trees; none comes to the driver."""
    spark = program.spark
    _exists(spark, path)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    trees, failed = [ty.to_spark(t, "term") for t in parse_sexprs(text)], None
                except RuleError as e:
                    trees, failed = [None], str(e)
                n = len(trees)
                columns = [pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(trees, pa.string()), pa.array([failed] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["file", "own", "tree", "failed"])

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")  # one file is one text
    held = state.written(texts.mapInArrow(run, "file string, own long, tree string, failed string"), 2).frame
    if failed := held.where("failed is not null").orderBy("file").first():
        raise RuleError(failed["failed"])
    sizes = held.groupBy("file").agg(F.count("*").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return program.bind_terms(name, held.join(shifts, "file").select((F.col("own") + F.col("shift")).alias("i"), "tree"), ["i"], "tree")


def load(program, command: str):
    """``name = loader("path", option=value)``; arguments are literals, nothing is executed."""
    m = _COMMAND.match(command)
    if not m:
        raise RuleError("Error: failed to parse load command.")
    name, loader, inner = m.groups()
    if loader not in LOADERS:
        raise RuleError(f"did not recognize loader '{loader}'")
    args, options = literal_arguments(inner)
    if loader == "pickled":
        return type(program).restore(program.spark, *args)
    return {"read_lines": read_lines, "tsv": tsv, "matrix": matrix, "sexpr": sexpr}[loader](program, name, *args, **options)


def literal_arguments(text: str) -> tuple[list, dict]:
    try:
        call = python_ast.parse(f"f({text})", mode="eval").body
        value = lambda node: node.id if isinstance(node, python_ast.Name) else python_ast.literal_eval(node)
        return [value(a) for a in call.args], {k.arg: value(k.value) for k in call.keywords}
    except (SyntaxError, ValueError) as e:
        raise RuleError(f"Syntax error: {e}") from None
