"""Command line: ``python -m rulespark PROGRAM... [-i] [-o FILE] [--load CMD]... [--post-process CMD]...``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rulespark", description="Runs rule programs on Spark.")
    parser.add_argument("source", nargs="*", help="program files, read one after the other as one program")
    parser.add_argument("-i", "--interactive", action="store_true", help="read commands after the program has run")
    parser.add_argument("-o", "--output", help="write the solution to this file")
    parser.add_argument("--load", action="append", default=[], help='e.g. --load \'m = matrix("path")\'')
    parser.add_argument("--post-process", action="append", default=[], help="e.g. --post-process 'save(\"path\")'")
    parser.add_argument("--master", help="Spark master; that of the environment by default")
    parser.add_argument("--debug", action="store_true", help="print the plan of every rule")
    parser.add_argument("--version", action="version", version="rulespark 0.1")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from rulespark.lang.ast import RuleError
    from rulespark.session import post, render
    from rulespark.session.program import Program
    from rulespark.session.repl import Session
    from rulespark.sources import loaders

    builder = SparkSession.builder.appName("rulespark").config("spark.ui.showConsoleProgress", "false")
    if args.master:
        builder = builder.master(args.master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    program = Program(spark)
    try:
        text = "\n".join(Path(s).read_text(encoding="utf-8") for s in args.source)
        if text.strip():
            program.add(text)
        for command in args.load:
            loaders.load(program, command)
        if args.debug:
            print(program.explain())
        for command in args.post_process:
            post.run(program, command)
        solution = render.solution(program)
    except (RuleError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    if args.output:
        Path(args.output).write_text(solution, encoding="utf-8")
    else:
        print(solution)
    if args.interactive or not args.source:
        session = Session(program)
        while True:
            try:
                line = input("> ")
                if line.strip() == "paste":
                    line += "\n" + "\n".join(iter(input, ""))
                print(session.run(line))
            except (EOFError, SystemExit):
                break
    return 0


if __name__ == "__main__":
    sys.exit(main())
