"""Run named queries at a scale factor and compare them with their SQL: ``python tests/check_queries.py [dir] [names]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402


def main() -> None:
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(directory), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, directory)
            if name in sql:
                found = differences(df, con, sql[name])
            else:
                found = [] if df.count() else ["no rows"]
        except Exception as error:  # report and go on
            found = [str(error)[:1500]]
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.1f}s {'' if name in sql else '(rows only)'}", flush=True)
        for line in found:
            print("     ", line, flush=True)
        if found:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
