"""Requests as rows: each is validated and answered on its own, with an error struct where the engine refuses it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError, error_envelope
from pulsegrid.functions import kernels as K

_BANDS = pa.struct([("bands", pa.list_(pa.list_(pa.float64()))), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])
_SCORES = pa.struct([("values", pa.list_(pa.float64())), ("error", pa.struct([("code", pa.string()), ("message", pa.string())]))])


def answer_dsp(requests: DataFrame) -> DataFrame:
    """requests (data array<double>, sample_rate_hz double, level int, filter struct or null, ...) with bands and error.

    filter: struct<type, cutoff_low_hz, cutoff_high_hz, taps, phase>; a null cutoff_high_hz makes cutoff_low_hz the only one.
    A request that is refused has null bands and the refusal's code; any other failure is dsp-failure.
    """

    def one(data, rate, level, spec) -> dict:
        try:
            x = np.asarray(data if data is not None else [np.nan], float)
            if not np.isfinite(x).all():
                raise SignalError("malformed-signal", "a signal has a sample that is missing or not finite")
            if spec is not None:
                cut = spec["cutoff_low_hz"] if spec["cutoff_high_hz"] is None else [spec["cutoff_low_hz"], spec["cutoff_high_hz"]]
                taps = K.design_fir({"type": spec["type"], "cutoff_hz": cut, "taps": spec["taps"]}, rate)
                x = (K.fir_zero_phase if spec["phase"] == "zero" else K.fir)(x, taps)
            return {"bands": [b.tolist() for b in K.decompose(x, level)], "error": None}
        except Exception as e:
            return {"bands": None, "error": error_envelope(e, "dsp-failure")}

    @F.arrow_udf("struct<bands:array<array<double>>,error:struct<code:string,message:string>>")
    def run(data: pa.Array, rate: pa.Array, level: pa.Array, spec: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in zip(*(c.to_pylist() for c in (data, rate, level, spec)), strict=True)], _BANDS)

    return requests.withColumn("_r", run("data", "sample_rate_hz", "level", "filter")).select(*requests.columns, "_r.bands", "_r.error")


def answer_inference(requests: DataFrame, models: dict[str, object]) -> DataFrame:
    """requests (model string as id@version, data array<double>, ...) with values and error.

    models: a function from a float32 array to scores for each registered model; a request of another model is
    model-loading-failure, and any failure of a model inference-failure. The functions go to the tasks with the plan.
    """

    def one(model, data) -> dict:
        try:
            if model not in models:
                raise SignalError("model-loading-failure", f"no model {model!r} is registered")
            values = np.asarray(models[model](np.asarray(data, np.float32)), float)
            if not np.isfinite(values).all():
                raise SignalError("inference-failure", "the model's output is not finite")
            return {"values": values.tolist(), "error": None}
        except Exception as e:
            return {"values": None, "error": error_envelope(e, "inference-failure")}

    @F.arrow_udf("struct<values:array<double>,error:struct<code:string,message:string>>")
    def run(model: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([one(*r) for r in zip(model.to_pylist(), data.to_pylist(), strict=True)], _SCORES)

    return requests.withColumn("_r", run("model", "data")).select(*requests.columns, "_r.values", "_r.error")
