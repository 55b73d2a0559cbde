import numpy as np
import pytest

from loam.llm import models
from loam.llm.models import fitted, load_model, save_model, signature


def test_fitted_once_per_content(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "_KEPT", models.OrderedDict())
    path, calls = str(tmp_path / "t.parquet"), []
    fit = lambda df: calls.append(1) or {"n": df.count(), "a": np.arange(3)}
    spark.range(5).write.parquet(path)
    assert fitted("m", fit, spark.read.parquet(path))["n"] == 5
    assert fitted("m", fit, spark.read.parquet(path))["n"] == 5 and len(calls) == 1
    spark.range(7).write.mode("overwrite").parquet(path)
    assert fitted("m", fit, spark.read.parquet(path))["n"] == 7 and len(calls) == 2
    assert fitted("m", fit, spark.range(3))["n"] == 3 and signature(spark.range(3)) is None


def test_fitted_in_a_folder(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "t.parquet"), []
    spark.range(5).write.parquet(path)
    spark.conf.set("spark.loam.models.dir", str(tmp_path / "models"))
    try:
        for _ in range(2):
            monkeypatch.setattr(models, "_KEPT", models.OrderedDict())
            assert fitted("m", lambda df: calls.append(1) or df.count(), spark.read.parquet(path)) == 5
    finally:
        spark.conf.unset("spark.loam.models.dir")
    assert len(calls) == 1


def test_save_and_load(spark, tmp_path):
    path = str(tmp_path / "deep" / "m.pickle")
    for k in range(2):
        save_model(spark, {"k": k, "x": np.zeros(200_000)}, path)
        assert load_model(spark, path)["k"] == k
    with pytest.raises(FileNotFoundError):
        load_model(spark, path + "x")
