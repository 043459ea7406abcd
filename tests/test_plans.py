"""Manifests, layered configuration and the stage graph."""

import json

import pytest

from tessella.plans import config, pipeline


def test_manifest(tmp_path):
    m = {"paths": {"observations": "o.parquet"}, "system": {"window": 32, "stride": 8}, "cohorts": {"a": {"x": {}, "y": {}}, "b": {"x": {}}}}
    (tmp_path / "manifest.yaml").write_text(json.dumps(m))
    got = config.read_manifest(str(tmp_path / "manifest.yaml"))
    assert config.observations_path(got) == f"{tmp_path}/o.parquet" and config.typology_path(got) is None
    assert config.coordinate(got) == {"name": "signal_0", "unit": ""} and config.segments(got) is None and config.problems(got) == []
    assert config.segments({"intervention": {"enabled": True, "event_index": 7}}) == [("pre", 0, 6), ("post", 7, None)]
    assert config.segments({"segments": [{"name": "s", "range": [1, None]}]}) == [("s", 1, None)]
    assert config.problems({"system": {"window": 0}}) == ["paths is missing", "cohorts is missing", "system.window is not a positive number", "system.stride is not a positive number"]
    assert config.without_signals(got, {"x"})["cohorts"] == {"a": {"y": {}}} and list(config.for_cohort(got, "b")["cohorts"]) == ["b"]
    assert [config.skips_fleet({"system": {"mode": m}}, n) for m, n in (("auto", 1), ("auto", 2), ("skip", 5), ("force", 1), ("odd", 1))] == [True, False, True, False, True]


def test_layers(tmp_path):
    for folder, name, text in (("defaults", "a.json", {"x": {"y": 1, "z": [1, 2]}}), ("domains", "mill.json", {"x": {"z": [3]}}), ("environments", "test.json", {"x": {"y": 5}})):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(json.dumps(text))
    c = config.Config(str(tmp_path), "mill", "test")
    assert (c.get("x.y"), c.get("x.z"), c.get("x.q", 9), c.get("x.y.k")) == (5, [3], 9, None)
    assert config.Config(str(tmp_path)).get("x.y") == 1 and config.Config(str(tmp_path), "none").get("x.z") == [1, 2]


def test_run(spark, tmp_path):
    rows = spark.range(600).selectExpr("explode(array('a', 'b', 'c')) cohort", "id").selectExpr("cohort", "explode(array('p', 'q', 'r', 's')) signal_id", "cast(id as double) signal_0", "sin(id * ascii(signal_id) / 50.0) + ascii(cohort) * cos(id / 7.0) + rand(3) value")
    rows.write.parquet(f"{tmp_path}/observations.parquet")
    names = ["signal_vector", "cohort_vector", "cohort_geometry", "geometry_dynamics", "system_vector", "cohort_pairwise", "velocity_field"]
    assert pipeline.run(spark, str(tmp_path), stages=names, skip=["cohort_vector"]) == ["signal_vector", "cohort_geometry", "geometry_dynamics", "velocity_field", "system_vector", "cohort_pairwise"]
    assert spark.read.parquet(f"{tmp_path}/output/cohort_pairwise").count() > 0
    with pytest.raises(ValueError, match="no such stages"):
        pipeline.run(spark, str(tmp_path), stages=["nothing"])
    with pytest.raises(ValueError, match="ridge_proximity needs ftle_rolling"):
        pipeline.run(spark, str(tmp_path), stages=["ridge_proximity"])
    one = {"_data_dir": str(tmp_path), "system": {"mode": "skip"}}
    assert pipeline.run(spark, str(tmp_path), one, stages=["system_vector", "cohort_pairwise"]) == ["system_vector"]
