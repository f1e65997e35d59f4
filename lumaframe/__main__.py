"""python -m lumaframe inspect PATH | config [FILE] | capabilities | frame PATH N | differing MANIFEST FOLDER

JSON lines on standard output; an error's code and message on standard error, and exit 1.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from lumaframe import commands, config
from lumaframe.errors import EngineError
from lumaframe.functions.arrays import whole_number
from lumaframe.sources import files


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumaframe")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("inspect").add_argument("path")
    sub.add_parser("config").add_argument("file", nargs="?")
    sub.add_parser("capabilities")
    for name, rest in (("frame", ("path", "number")), ("differing", ("manifest", "folder"))):
        p = sub.add_parser(name)
        for argument in rest:
            p.add_argument(argument)
    a = parser.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "inspect":
            df = commands.inspect(files.index(spark, a.path))
        elif a.command == "config":
            text = "\n".join(r[0] for r in spark.read.text(a.file, wholetext=True).collect()) if a.file else ""  # one file
            df = commands.config_df(spark, config.load(text))
        elif a.command == "capabilities":
            df = commands.capabilities(spark)
        elif a.command == "frame":
            df = files.frame_at(spark, a.path, whole_number(a.number)).drop("payload")
        else:
            df = files.differing_files(spark, files.manifest(spark, a.manifest), a.folder)
        for row in df.toJSON().toLocalIterator():
            print(row)
    except EngineError as e:
        print(json.dumps({"code": e.code, "message": str(e)}), file=sys.stderr)
        return 1
    except PySparkException as e:
        print(json.dumps({"code": "processing_failed", "message": str(e).splitlines()[0]}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
