import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from traitweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "traitweave-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collect as sorted tuples, floats rounded."""

    def collect(df, *cols):
        df = df.select(*cols) if cols else df
        out = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, bool) else (0, "", v) for v in r))

    return collect
