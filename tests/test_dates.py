from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from pagemill.functions.dates import normalize_datetime

CASES = [
    "2026-02-01T10:00:00+01:00", "Sun, 16 Feb 2026 11:45:00 GMT", "20260201", "2026-02-01 10:00", "2026-02-01T10:00:00.5Z",
    "2026-W05-1", "2026W053T1015", "16 Feb 2026 11:45 -0000", "16 Feb 26 11:45:10 EST", "Feb 16 2026 10:00:00", "nope",
    "2026-13-01T00:00", "2026-02-01T10:00:00", "Mon, 16-Feb-2026 11:45:00 +0130", "2026-02-01T10", "20260201T101112+0200",
    "2026-02-01T10:00:00,123456789", "1 January 1999 1:02:03 PDT", "",
]


def expected(text):
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        try:
            moment = parsedate_to_datetime(text)
        except (TypeError, ValueError, IndexError):
            return None
    moment = moment.astimezone(UTC) if moment.tzinfo else moment
    return moment.isoformat().replace("+00:00", "Z")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_equal_the_standard_library_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(c,) for c in CASES], "d string").select("d", normalize_datetime("d").alias("n")).collect()
        assert {r["d"]: r["n"] for r in rows} == {c: expected(c) for c in CASES}
        kept = spark.range(1).select(normalize_datetime(F.lit("2026-99-99"))).first()[0]
        assert kept == "2026-99-99"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
