"""python -m quillmesh.cli mine|evaluate|classify MESSAGES.parquet [OUT]: the engine over a stored table."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillmesh", description=__doc__)
    parser.add_argument("command", choices=["mine", "evaluate", "classify"])
    parser.add_argument("messages", help="Parquet table of messages")
    parser.add_argument("out", nargs="?", help="where the result goes as Parquet; else it is shown")
    parser.add_argument("--days", type=int, default=7)
    parser.add_argument("--min-spam", type=int, default=10)
    a = parser.parse_args(args)
    from quillmesh.engine import Engine
    from quillmesh.session import session

    spark = session()
    engine = Engine(spark.read.parquet(a.messages))
    if a.command == "classify":
        out = engine.classify(engine.messages)
    else:
        engine.mine(engine.messages.agg(F.max("timestamp")).first()[0], a.days, a.min_spam)
        out = engine.evaluate() if a.command == "evaluate" else spark.createDataFrame([(r.rule_id, r.sql) for r in engine.rules], "rule_id long, sql string")
    out.write.parquet(a.out) if a.out else out.show(50, False)


if __name__ == "__main__":
    main()
