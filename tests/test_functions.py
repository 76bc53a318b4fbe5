from pyspark.sql import functions as F

from tidemark.functions import epoch_millis, ntz_to_instant


def test_ntz_conversion_ignores_session_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            row = spark.range(1).select(
                epoch_millis(ntz_to_instant(F.lit("1970-01-01 00:00:01.2345").cast("timestamp_ntz"))).alias("ms"),
                epoch_millis(ntz_to_instant(F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))).alias("cut"),
            ).first()
            assert (row.ms, row.cut) == (1234, 1705363200000), tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
