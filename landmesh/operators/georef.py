"""Georeferencing: fits of many sheets at once, by least squares over centred control points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a model and how many control points it needs.
MODELS = {"affine": 3, "poly2": 6}


def _terms(model: str, u, v):
    one = u * 0 + 1
    return [one, u, v] if model == "affine" else [one, u, v, u * u, u * v, v * v]


def _solved(p: np.ndarray, model: str, degrees: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which sheets have a fit, and its values, of sheets with equally many points: (sheet, point, px py x y)."""
    origin = p[:, :, :2].mean(axis=1)
    apart = p[:, :, :2] - origin[:, None]
    scale = np.maximum(np.hypot(apart[..., 0], apart[..., 1]).max(axis=1), 1e-12)
    u, v = np.moveaxis(apart / scale[:, None, None], 2, 0)
    design = np.stack(_terms(model, u, v), axis=2)
    left, values, right = np.linalg.svd(design, full_matrices=False)
    ok = (values > 1e-8).sum(axis=1) == design.shape[2]
    middle = p[:, :, 2:].mean(axis=1)
    target = p[:, :, 2:] - middle[:, None]
    solved = np.swapaxes(right, 1, 2) @ ((np.swapaxes(left, 1, 2) @ target) / np.where(ok[:, None], values, 1.0)[:, :, None])
    rest = target - design @ solved
    solved[:, 0] += middle
    if degrees:
        rest = rest * 111320.0 * np.stack([np.cos(np.radians(middle[:, 1])), np.ones(len(p))], axis=1)[:, None]
    return ok, {"cx": solved[:, :, 0], "cy": solved[:, :, 1], "px0": origin[:, 0], "py0": origin[:, 1], "scale": scale, "rmse": np.sqrt((rest**2).sum(axis=2).mean(axis=1))}


def fit(points: DataFrame, model: str = "affine", degrees: bool = False) -> DataFrame:
    """Per sheet: coefficients for x and y, centre and scale, RMSE, number of points, and error.

    points: sheet_id, px, py, x, y. Too few or collinear points give an error text and nulls. With
    degrees the RMSE is in metres. A sheet has few points, so that one row holds them; sheets of as
    many points are solved together.
    """
    need = MODELS[model]

    def solve(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten()
            flat = np.stack([values.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("px", "py", "x", "y")], axis=1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            begin = np.cumsum(n) - n
            out = {c: np.full(len(n), None) for c in ("cx", "cy", "px0", "py0", "scale", "rmse", "error")}
            out["error"][n < need] = f"{model} needs {need} points"
            for size in np.unique(n[n >= need]).tolist():
                some = np.flatnonzero(n == size)
                ok, found = _solved(flat[begin[some][:, None] + np.arange(size)], model, degrees)
                out["error"][some[~ok]] = "control points are collinear"
                for c, value in found.items():
                    into = np.full(int(ok.sum()), None)
                    into[:] = value[ok].tolist()
                    out[c][some[ok]] = into
            kinds = [pa.list_(pa.float64())] * 2 + [pa.float64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *(pa.array(out[c].tolist(), kind) for c, kind in zip(out, kinds, strict=True))], ["sheet_id", "n", *out])

    kind = points.schema["sheet_id"].dataType.simpleString()
    sheets = points.groupBy("sheet_id").agg(F.collect_list(F.struct("px", "py", "x", "y")).alias("points"))
    return sheets.mapInArrow(solve, f"sheet_id {kind}, n int, cx array<double>, cy array<double>, px0 double, py0 double, scale double, rmse double, error string")


def apply(points: DataFrame, fits: DataFrame, model: str = "affine") -> DataFrame:
    """points (sheet_id, px, py) with x and y by their sheet's fit; null where there is none."""
    rows = points.join(fits.select("sheet_id", "cx", "cy", "px0", "py0", "scale"), "sheet_id", "left")
    u, v = (F.col("px") - F.col("px0")) / F.col("scale"), (F.col("py") - F.col("py0")) / F.col("scale")
    value = lambda c: sum(F.col(c)[i] * t for i, t in enumerate(_terms(model, u, v)))
    return rows.withColumn("fx", value("cx")).withColumn("fy", value("cy")).select(*points.columns, F.col("fx").alias("x"), F.col("fy").alias("y"))


def residuals(points: DataFrame, fits: DataFrame, model: str = "affine") -> DataFrame:
    """Distance of each control point from where its sheet's fit puts it."""
    placed = apply(points.withColumnRenamed("x", "tx").withColumnRenamed("y", "ty"), fits, model)
    return placed.withColumn("residual", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).drop("x", "y").withColumnRenamed("tx", "x").withColumnRenamed("ty", "y")
