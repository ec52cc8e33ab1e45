import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from shelfmark.plans.bindings import Library  # noqa: E402
from shelfmark.schema import BOOKS  # noqa: E402
from shelfmark.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lib(spark):
    return Library(spark, DATA)


@pytest.fixture(scope="session")
def make_books(spark):
    """Catalogue rows from partial dicts."""
    from datetime import datetime

    defaults = {
        "format": "epub", "file_size": 0, "file_mtime": datetime(2024, 1, 1), "first_seen_at": "2024-01-01",
        "last_scanned_at": "2024-01-01", "is_missing": False, "epub_validated": False,
        "epub_deep_validated": False, "epub_version2": False,
    }

    def build(*rows):
        full = []
        for row in rows:
            path = row.get("file_path", f"/lib/{row['id']}.epub")
            merged = {**defaults, "file_path": path, "file_name": path.rsplit("/", 1)[-1], **row}
            full.append(tuple(merged.get(f.name) for f in BOOKS))
        return spark.createDataFrame(full, BOOKS)

    return build


@pytest.fixture(scope="session")
def make_files(spark):
    from datetime import datetime

    def build(*rows):
        day = datetime(2024, 1, 1)
        full = [(path, len(data), when or day, data) for path, data, when in (r if len(r) == 3 else (*r, None) for r in rows)]
        return spark.createDataFrame(full, "path string, file_size long, file_mtime timestamp, content binary")

    return build
