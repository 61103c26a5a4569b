import pytest

SAMPLES = (
    "record_id bigint, dataset_id string, source_sample_id string, source_split string, group_id string, raw_label string, taxon_id string, sha256 string, phash string, "
    "_id string, _h string, _key string, component string"
)


@pytest.fixture
def samples(spark):
    """Rows from dicts, with columns whose names clash with internal ones."""

    def make(rows):
        names = [c.split()[0] for c in SAMPLES.split(", ")]
        return spark.createDataFrame([tuple(r.get(n, "clash" if n.startswith("_") or n == "component" else None) for n in names) for r in rows], SAMPLES)

    return make
