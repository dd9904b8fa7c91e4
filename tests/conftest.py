import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="session")
def spark():
    from pixelmill.session import local_session

    return local_session(8, "tests")


@pytest.fixture(scope="session")
def frame(spark):
    """Build a pixel table from text grids: one string per row, one frame per grid."""

    def build(*grids):
        rows = [
            (f, y, x, int(ch))
            for f, grid in enumerate(grids)
            for y, line in enumerate(grid)
            for x, ch in enumerate(line)
        ]
        return spark.createDataFrame(rows, "frame_id bigint, y int, x int, v int")

    return build


@pytest.fixture(scope="session")
def grid():
    """Back to text: rows of one frame as strings."""

    def show(df, col, frame_id=0):
        rows = df.filter(f"frame_id = {frame_id}").select("y", "x", col).collect()
        h, w = max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1
        out = [["."] * w for _ in range(h)]
        for r in rows:
            out[r["y"]][r["x"]] = str(r[col])
        return ["".join(line) for line in out]

    return show
