import duckdb
import pytest
from conftest import rows

from tidemesh.plans import reference_queries

OFFSET = 1_000_000


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The same three tables twice, the second time with analysis ids whose segment names fit into no bigint."""
    at = [tmp_path_factory.mktemp("small"), tmp_path_factory.mktemp("wide")]
    c = duckdb.connect()
    for folder, more in zip(at, (0, OFFSET)):
        for name, sql in {
            "points": "select i::bigint point_id, (1 + i % 4)::int epoch_id, (1 + i % 7)::double x, (1 + i % 11)::double y, (i % 5)::double z, 0e0 nx, 0e0 ny, 1e0 nz from range(200) t(i)",
            "epochs": f"select (2 * a + e)::int + 1 epoch_id, ({more} + 1 + a)::bigint analysis_id, e::int epoch_idx from range(2) t(a), range(2) s(e)",
            "analyses": f"select ({more} + 1 + a)::bigint analysis_id, 2::int n_epochs from range(2) t(a)",
        }.items():
            c.execute(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
    return [str(f) for f in at]


def _shifted(found, k):
    return sorted((*r[:k], int(r[k]) + OFFSET * 10**15, *r[k + 1 :]) for r in found)


def test_segment_ids_of_large_analysis_ids(spark, folders):
    small, wide = (rows(reference_queries.segment_ids(spark, f), "epoch", "segment_id", "new_id") for f in folders)
    assert len(small) == 24 and wide == _shifted(small, 1)


def test_patch_extremes_of_large_analysis_ids(spark, folders):
    small, wide = (rows(reference_queries.patch_extremes(spark, f)) for f in folders)
    assert small and wide == _shifted(small, 0)
