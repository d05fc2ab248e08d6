"""``python -m tessera.cli --data-dir DIR [-c SQL | -f FILE] [--log-json FILE]``; without -c and -f it reads statements.

A statement typed in goes on until a line ends with a semicolon; ``\\q`` or the end of input ends the session.  - stands for
standard input as FILE of -f, and for standard output as that of --log-json."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .plans.engine import Engine, split_script


def run(engine: Engine, text: str) -> bool:
    ok = True
    for s in split_script(text):
        try:
            if (df := engine.sql(s)) is not None:
                df.show(1000, False)
            else:
                print(f"OK ({engine.metrics[-1].rows} rows)")
        except EngineError as e:
            ok = False
            print(f"{e.severity}: {e}" + "".join(f"\n  hint: {h}" for h in e.hints))
    return ok


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--data-dir", required=True)
    p.add_argument("-c", dest="command")
    p.add_argument("-f", dest="file")
    p.add_argument("--log-json")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, a.data_dir, a.log_json)
    if a.command:
        return int(not run(engine, a.command))
    if a.file:
        return int(not run(engine, sys.stdin.read() if a.file == "-" else open(a.file).read()))
    return shell(engine)


def shell(engine: Engine) -> int:
    text = ""
    while True:
        try:
            line = input("     -> " if text else "tessera> ")
        except EOFError:
            line = "\\q"
        if line.strip() == "\\q":
            if text.strip():
                run(engine, text)
            return 0
        if not text and not line.strip():
            continue
        text += line + "\n"
        if line.rstrip().endswith(";") and text.count("'") % 2 == 0 or text.startswith("\\"):
            run(engine, text)
            text = ""


if __name__ == "__main__":
    sys.exit(main())
