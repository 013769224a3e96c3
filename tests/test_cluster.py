"""What one process hides: queries on executors with memory of their own."""

import subprocess
import sys
from collections import Counter

from tessera import queries, testdatabase

from .conftest import ROOT
from .oracle import DATA, connect

CHILD = """
import sys
from pyspark.sql import SparkSession
root, name, data, shared = sys.argv[1:]
sys.path.insert(0, root)
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + shared).getOrCreate()
import __spark_entry__
for row in __spark_entry__.queries()[name](spark, data).collect():
    print("ROW", *row, sep="|")
spark.stop()
"""


def test_jdbc_on_several_executors(tmp_path):
    done = subprocess.run([sys.executable, "-c", CHILD, ROOT, "jdbc_table", DATA, str(tmp_path)], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    got = Counter(line[4:] for line in done.stdout.splitlines() if line.startswith("ROW|"))
    assert got == Counter("|".join(r) for r in connect().execute(queries.ORACLE_SQL["jdbc_table"]).fetchall()), done.stderr[-2000:]


def test_database_keeps_odd_values(spark):
    rows = [(1, 'a "quoted", b', 1.5), (2, None, None), (3, "", -0.1), (None, "two\nlines", 1e300)]
    url = testdatabase.filled(spark.createDataFrame(rows, "k bigint, s string, x double").repartition(3), "odd", "s VARCHAR(60)")
    assert Counter(map(tuple, spark.read.jdbc(url, "odd").collect())) == Counter(rows)
