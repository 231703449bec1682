"""``python -m tessera --data-dir DIR (register FOLDER | scan SOURCE | parse | normalize | audit | search TEXT | state | status | export | backup TO)``"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.audit import format_report


def main() -> None:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--data-dir", required=True)
    p.add_argument("command", choices=["register", "scan", "parse", "normalize", "audit", "search", "state", "status", "export", "backup"])
    p.add_argument("argument", nargs="?")
    a = p.parse_args()
    engine = Engine(SparkSession.builder.appName("tessera").getOrCreate(), a.data_dir)
    if a.command == "register":
        print(engine.register(a.argument))
    elif a.command == "scan":
        print(engine.scan(a.argument))
    elif a.command in ("parse", "normalize"):
        print(getattr(engine, a.command)())
    elif a.command == "audit":
        print(format_report(engine.audit()))
    elif a.command == "search":
        engine.search(a.argument or "").show(50, False)
    elif a.command == "status":
        engine.parse_status().groupBy("form", "status").count().orderBy("form", "status").show(50, False)
    elif a.command == "export":
        print(json.dumps(engine.diagnostics(), ensure_ascii=False, default=str))
    elif a.command == "backup":
        engine.backup(a.argument)
    else:
        engine.state().show()


if __name__ == "__main__":
    main()
