import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from memlake.schema import RECORD_SCHEMA  # noqa: E402

UTC = dt.timezone.utc
AS_OF = dt.datetime(2025, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="session")
def spark():
    from memlake.session import get_spark
    # Small files in small splits, so that the tests run on all cores.
    s = get_spark("local[*]", shuffle_partitions=8, extra={"spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "64k"})
    yield s
    s.stop()


def rec(id, content, source="manual", category="personal", tags=(), sensitive=False,
        confidence=0.8, created=None):
    created = created or dt.datetime(2024, 6, 1, tzinfo=UTC)
    return (id, content, source, category, list(tags), sensitive, confidence, created, created, content)


@pytest.fixture
def make_records(spark):
    def make(rows):
        return spark.createDataFrame(rows, RECORD_SCHEMA)
    return make


#: id, day, source, category, confidence, sensitive, tags, text
NOTES = [
    ("n1", 2, "obsidian", "professional", 0.70, False, "trade", "Repairs bicycles at a shop in Ghent."),
    ("n2", 5, "gemini", "project", 0.75, False, "rust learning", "Learns Rust on weekends."),
    ("n3", 9, "manual", "relationship", 0.60, False, "family", "Sister lives in Oslo."),
    ("n4", 14, "gemini", "personal", 1.00, True, "health", "Allergic to penicillin."),
    ("n5", 20, "obsidian", "preference", 0.50, False, "", "Takes the tram rather than the car."),
    ("n6", 27, "obsidian", "personal", 0.65, True, "health routine", "Blood pressure is checked monthly."),
    ("n7", 33, "gemini", "personal", 0.55, False, "books", "Reads Dutch crime novels."),
    ("n8", 40, "obsidian", "project", 0.90, False, "camera", "Builds a birdhouse camera."),
]


@pytest.fixture
def seeded(make_records):
    """Eight notes, newest last; the days count from December 2023."""
    start = dt.datetime(2023, 12, 1, tzinfo=UTC)
    return make_records([rec(i, text, source, category, tags.split(), sensitive, confidence, start + dt.timedelta(days=day))
                         for i, day, source, category, confidence, sensitive, tags, text in NOTES])
