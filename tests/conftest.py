import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from postsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests", master="local[8]",
        **{
            "spark__sql__shuffle__partitions": "4", "spark__driver__memory": "6g",
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over a list of texts."""

    def run(fn, texts, *more):
        rows = [(i, t, *[m[i] for m in more]) for i, t in enumerate(texts)]
        names = ["i", "a", "b", "c"][: 2 + len(more)]
        df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
        out = df.select("i", fn(*names[1:]).alias("v")).collect()
        return [r.v for r in sorted(out, key=lambda r: r.i)]

    return run
