import math

import pytest
from pyspark.sql import functions as F

from chainweft.operators import alerts

ROWS = [("a", 1, 100, 0.9, 10.0, "high"), ("b", 2, 200, 0.4, None, "low"), ("a", 5, 7300, 0.5, 2.0, "low"), (None, 6, 1, 1.0, 1.0, "high"), ("", 7, 1, 1.0, 1.0, "high"), ("c", 8, 8000, None, 1.0, "high")]
SCHEMA = "key string, `order` long, at long, score double, value double, label string"


def test_state_priority_and_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = {r.key: r for r in alerts.current_alerts(df, spark.createDataFrame([("c",)], "key string")).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].score == 0.5 and (got["a"].created_at, got["a"].updated_at, got["a"].update_count) == (100, 7300, 1)
    assert got["a"].raw_priority == pytest.approx(0.5 * math.log(4)) and got["b"].raw_priority == pytest.approx(0.4 * math.log(2)) and got["c"].acknowledged
    top = alerts.top_alerts(alerts.current_alerts(df), F.lit(7400), 2).collect()
    assert [r.key for r in top] == ["a", "b"] and top[1].priority == pytest.approx(0.4 * math.log(2) * 0.9)
    counts = {r.label: (r.active, r.created, r.deduplicated) for r in alerts.alert_counts(alerts.current_alerts(df), ["high", "low", "none"]).collect()}
    assert counts == {"high": (1, 3, 1), "low": (2, 3, 1), "none": (0, 3, 1)}
    assert alerts.current_alerts(df.limit(0)).count() == 0
