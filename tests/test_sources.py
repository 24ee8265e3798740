import zipfile

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from sparkloom.functions import geometry
from sparkloom.operators import ml, supervised
from sparkloom.sources import archives, models


def test_detect(spark):
    df = spark.createDataFrame([("a;b;c,d",), ("a\tb",), ("",), (None,), ("a,b;c",)], "t string")
    assert [r.d for r in df.select(archives.detect_delimiter(F.col("t")).alias("d")).collect()] == [";", "\t", ",", None, ","]
    assert [archives.detect_encoding(x) for x in ("é".encode(), "é".encode("cp1252"), "é".encode("utf-16"), "﻿a".encode())] == ["utf-8", "cp1252", "utf-16", "utf-8-sig"]


def test_uploads(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("ville;num\nÉpinal;3\n".encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x.csv", "ville,num\nLyon,4\nNancy,\n")
        z.writestr("skip.pdf", "no")
    (tmp_path / "empty.csv").write_text("")
    got = sorted((r.member, r.line, r.fields["ville"], r.fields["num"]) for r in archives.read_uploads(spark, str(tmp_path)).collect())
    assert got == [("one.csv", 0, "Épinal", "3"), ("x.csv", 0, "Lyon", "4"), ("x.csv", 1, "Nancy", "")]


def test_labels_from_paths(spark, tmp_path):
    (tmp_path / "n01-beagle").mkdir()
    (tmp_path / "n01-beagle" / "a.jpg").write_bytes(b"x")
    assert [r.label for r in archives.labels_from_paths(spark, str(tmp_path)).collect()] == ["beagle"]


def test_models_and_layers(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(2 * i + 1)) for i in range(20)], "x double, y double")
    model = supervised.fit(ml.assemble(df, ["x"]), "elastic_net", "y")
    path = models.save_model(model, str(tmp_path), "line")
    assert isinstance(models.load_model(path, spark), LinearRegressionModel)
    shape = spark.createDataFrame([([(0.0, 0.0), (1.0, 1.0)],)], "outline array<struct<x:double,y:double>>")
    written = models.write_layers({"a": shape, "b": {"c": shape}}, str(tmp_path / "layers"))
    assert len(written) == 2 and spark.read.parquet(written[1]).head().outline == "LINESTRING (0.0 0.0, 1.0 1.0)"
    lists = spark.createDataFrame([("['a', \"b's\"]",), (None,)], "t string").select(models.list_from_text(F.col("t")).alias("l"))
    assert [r.l for r in lists.collect()] == [["a", "b's"], None]


def test_supervised(spark, rows):
    df = spark.createDataFrame([(i, float(i % 3), float(i % 3) * 5 + i / 100) for i in range(90)], "id int, label double, x double")
    v = ml.assemble(df, ["x"]).cache()
    for kind in supervised.CLASSIFIERS:
        out = supervised.fit(v, kind, "label").transform(v)
        assert out.filter("prediction = label").count() >= 60, kind
    assert supervised.show_predictions(v, "label", "label", "x", "id", 5).count() == 5
    labels = spark.createDataFrame([(["b", "a"],), ([],)], "l array<string>")
    classes = supervised.classes_of(labels, "l")
    assert classes == ["a", "b"]
    assert rows(labels.select(supervised.binarise(F.col("l"), classes))) == [([0, 0],), ([1, 1],)]
    with pytest.raises(ValueError):
        supervised.classes_of(labels, "l", 1)
    rng = np.random.default_rng(0)
    normal = spark.createDataFrame([(float(x),) for x in rng.normal(size=300)], "x double")
    assert supervised.normality(normal, "x")["p"] > 0.01
    assert geometry.hull([(1.0, 1.0)]) == [(1.0, 1.0)]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from sparkloom.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda key, value: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
