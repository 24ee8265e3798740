"""Models and geometry as sinks."""

from __future__ import annotations

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.geometry import wkt


def save_model(model, folder: str, label: str | None = None) -> str:
    """Writes a pyspark.ml model below a folder, under its label or class name; returns the path."""
    path = f"{folder}/{label or type(model).__name__}"
    model.write().overwrite().save(path)
    return path


def load_model(path: str, spark=None):
    """Reads whatever pyspark.ml model lies at a path."""
    return DefaultParamsReader.loadParamsInstance(path, spark) if spark is None else DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)


def write_layers(layers: dict, folder: str, geometry: str = "outline") -> list[str]:
    """Writes nested dictionaries of frames as Parquet below a folder, geometry as text (WKT); returns the paths."""
    out: list[str] = []
    for name, layer in layers.items():
        if isinstance(layer, dict):
            out += write_layers(layer, f"{folder}/{name}", geometry)
        elif isinstance(layer, DataFrame):
            shaped = layer.withColumn(geometry, wkt(F.col(geometry))) if geometry in layer.columns else layer
            shaped.write.mode("overwrite").parquet(f"{folder}/{name}")
            out.append(f"{folder}/{name}")
    return out


def list_from_text(text: Column) -> Column:
    """A list that a CSV holds as text, such as ['a', 'b'] (never evaluated)."""
    return F.from_json(F.regexp_replace(text, r"(?<=[\[ ,])'|'(?=[\],])", '"'), "array<string>")
