"""``python -m stratum ask FILE QUESTION`` and ``python -m stratum accept FILE CASES``; exits 0 only if all is approved."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from stratum.plans import acceptance
from stratum.plans.assistant import Assistant, RequestError, compacted
from stratum.plans.config import Limits
from stratum.sources.files import ParseError, parse_file, text_source


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratum", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("ask", help="answer a question about a file")
    ask.add_argument("file", type=Path)
    ask.add_argument("question")
    accept = commands.add_parser("accept", help="run acceptance cases over a file")
    accept.add_argument("file", type=Path)
    accept.add_argument("cases", type=Path, help="JSON with a list of cases: id, question, expected_terms")
    for command in (ask, accept):
        command.add_argument("--workers", type=int, default=8)
        command.add_argument("--fan-in", type=int, default=4)
        command.add_argument("--replans", type=int, default=1)
    given = parser.parse_args(args)
    try:
        limits = Limits(max_workers=given.workers, fan_in=given.fan_in, max_replans=given.replans)
        text = parse_file(given.file.name, given.file.read_bytes()).text
        spark = SparkSession.builder.getOrCreate()
        if given.command == "ask":
            result = Assistant(spark, text_source(spark, text, given.file.name), limits=limits).ask(given.question)
            print(json.dumps(compacted(result), ensure_ascii=False, indent=2, default=str))
            return 0 if result["validation"]["approved"] else 1
        report = acceptance.run(spark, text, json.loads(given.cases.read_text("utf-8"))["cases"], limits=limits, name=given.file.name)
        shown = {k: v for k, v in report.items() if k != "cases"} | {"cases": [{k: r[k] for k in ("id", "question", "passed", "missing", "reasons")} | {"answer": r["answer"].answer} for r in report["cases"]]}
        print(json.dumps(shown, ensure_ascii=False, indent=2, default=str))
        return 0 if report["ok"] else 1
    except (RequestError, ParseError, ValueError, OSError) as e:
        print(str(e), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
