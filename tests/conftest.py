import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tsfold.session import local_session  # noqa: E402
from ts_sources import GAUGE_TS, REPORT_TS, STATION_TS, files_df  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fixture_files(spark):
    rows = [
        (1, "src/report.ts", 1, REPORT_TS),
        (1, "src/gauge.ts", 2, GAUGE_TS),
        (1, "src/station.ts", 3, STATION_TS),
    ]
    return files_df(spark, rows)
