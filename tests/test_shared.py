"""The shared folder of an application."""

import os

from flowlab import shared


def test_tables_lie_in_one_folder_and_can_be_cleared(spark, monkeypatch, tmp_path):
    assert shared.shared_dir(spark) == shared.shared_dir(spark) and (spark.sparkContext.applicationId in shared.shared_dir(spark) or "spark-flowlab-" in shared.shared_dir(spark))
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/own")
    kept = [shared.written(spark.range(5), "five") for _ in range(2)]
    assert [k.count() for k in kept] == [5, 5] and len(os.listdir(tmp_path / "own")) == 2
    shared.clear(spark)
    assert os.listdir(tmp_path) == []
