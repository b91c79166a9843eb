import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from coppice.session import build  # noqa: E402


# Started here because test modules make columns when they are read.
SESSION = build(
    "local[8]",
    app="coppice-tests",
    **{
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="coppice-tests-"),
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def forest(spark):
    """Makes ``(files, contents)`` frames from ``{path: text}``, all in repo ``r``."""
    from coppice.sources import trees

    def make(texts: dict, snapshot: str = "head"):
        rows = [("r", p, t) for p, t in texts.items()]
        df = spark.createDataFrame(rows, "repo string, path string, text string")
        return trees.from_table(df, "repo", "path", "text", snapshot)

    return make


@pytest.fixture(scope="session")
def values(spark):
    """Evaluates a column expression over a list of values."""

    def run(expression, items, schema="x string"):
        rows = [i if isinstance(i, tuple) else (i,) for i in items]
        df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + schema)
        return [r[0] for r in df.select(expression.alias("v"), "n").orderBy("n").select("v").collect()]

    return run
