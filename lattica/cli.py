"""A small SQL command line: ``python -m lattica.cli [-d DATA_DIR] [-f FILE] [-e SQL]``.

Commands: QUIT, HELP, CLEAR, SHOW TABLES, DESCRIBE t, EXPLAIN query, SET key=value, SET, RESET, SOURCE file, and SQL.
"""

from __future__ import annotations

import argparse
import pathlib

from pyspark.sql import SparkSession

from lattica.plans.dialect import rewrite

HELP = "QUIT  HELP  CLEAR  SHOW TABLES  DESCRIBE t  EXPLAIN query  SET key=value  RESET  SOURCE file  or any SQL"


class Client:
    """Runs commands; ``run`` returns text to print, or None to quit."""

    def __init__(self, spark: SparkSession, rows: int = 50):
        self.spark, self.rows, self.changed = spark, rows, {}

    def run(self, command: str) -> str | None:
        command = command.strip().rstrip(";").strip()
        word, _, rest = command.partition(" ")
        word = word.upper()
        if not command:
            return ""
        if word in ("QUIT", "EXIT"):
            return None
        if word == "HELP":
            return HELP
        if word == "CLEAR":
            return "\033[H\033[2J"
        if word == "SHOW" and rest.upper() == "TABLES":
            return "\n".join(sorted(t.name for t in self.spark.catalog.listTables()))
        if word == "DESCRIBE":
            return "\n".join(f"{name} {kind}" for name, kind in self.spark.table(rest.strip()).dtypes)
        if word == "EXPLAIN":
            return self.spark.sql("EXPLAIN FORMATTED " + rewrite(rest)).first()[0]
        if word == "SET" and "=" in rest:
            key, _, value = (x.strip() for x in rest.partition("="))
            self.changed.setdefault(key, self.spark.conf.get(key, None))
            self.spark.conf.set(key, value)
            return f"{key}={value}"
        if word == "SET":
            return "\n".join(f"{k}={self.spark.conf.get(k)}" for k in sorted(self.changed))
        if word == "RESET":
            for key, value in self.changed.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
            self.changed = {}
            return "reset"
        if word == "SOURCE":
            return "\n".join(self.run(part) or "" for part in pathlib.Path(rest.strip()).read_text().split(";") if part.strip())
        df = self.spark.sql(rewrite(command))
        return "\n".join(["\t".join(df.columns), *["\t".join(map(str, r)) for r in df.take(self.rows)]]) if df.columns else "ok"


def main() -> None:
    from lattica.session import build_session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-d", "--data", help="folder of Parquet tables to register")
    parser.add_argument("-f", "--file")
    parser.add_argument("-e", "--execute")
    args = parser.parse_args()
    spark = build_session("lattica-cli")
    for p in sorted(pathlib.Path(args.data).glob("*.parquet")) if args.data else ():
        spark.read.parquet(str(p)).createOrReplaceTempView(p.stem)
    client = Client(spark)
    if args.file or args.execute:
        print(client.run(f"SOURCE {args.file}" if args.file else args.execute))
        return
    while (text := client.run(input("lattica> "))) is not None:
        print(text)


if __name__ == "__main__":
    main()
