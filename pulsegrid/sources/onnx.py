"""ONNX models as scorers: float32 windows in, one score for each class out. Needs onnxruntime."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.errors import SignalError
from pulsegrid.sources import documents

_SESSIONS: dict[int, object] = {}


def _session(model: bytes):
    key = hash(model)
    if key not in _SESSIONS:
        try:
            import onnxruntime
        except ImportError as e:
            raise SignalError("model-loading-failure", "onnxruntime is not installed") from e
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        try:
            _SESSIONS[key] = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        except Exception as e:
            raise SignalError("model-loading-failure", f"the model can't be loaded: {e}") from e
    return _SESSIONS[key]


def onnx_scorer(model: bytes, metadata: dict) -> Callable[[Column], Column]:
    """A scorer of windows (array<double>) by a model of a single-precision input; the session is made once a worker.

    The input's and output's names are the metadata's; anything but float32, and outputs of another number than the
    class labels, are refused.
    """
    if metadata["input"]["dtype"] != "float32":
        raise SignalError("model-compatibility-failure", "only float32 inputs can be run")
    given, made, classes = metadata["input"]["name"], metadata["output"]["name"], len(metadata["output"]["classLabels"])
    _session(model)

    @F.arrow_udf("array<double>")
    def run(windows: pa.Array) -> pa.Array:
        session, out = _session(model), []
        for w in windows.to_pylist():
            if w is None:
                out.append(None)
                continue
            try:
                values = np.asarray(session.run([made], {given: np.asarray(w, np.float32)})[0], float).ravel()
            except Exception as e:
                raise SignalError("inference-failure", f"the model failed: {e}") from e
            if len(values) != classes:
                raise SignalError("inference-failure", f"{len(values)} scores for {classes} classes")
            out.append(values.tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return run


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def probe_model(samples: int = 360) -> bytes:
    """The probe as an ONNX file: signal [samples] times a matrix of ones and minus ones gives logits [2]."""

    def tensor_info(name: bytes, n: int) -> bytes:
        shape = _field(2, _field(1, _field(1, n)))
        return _field(1, name) + _field(2, _field(1, _field(1, 1) + shape))

    weights = np.tile(np.array([1.0, -1.0], "<f4"), (samples, 1)).tobytes()
    node = _field(1, b"signal") + _field(1, b"weights") + _field(2, b"logits") + _field(4, b"MatMul")
    constant = _field(1, samples) + _field(1, 2) + _field(2, 1) + _field(8, b"weights") + _field(9, weights)
    graph = _field(1, node) + _field(2, b"probe") + _field(5, constant) + _field(11, tensor_info(b"signal", samples)) + _field(12, tensor_info(b"logits", 2))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(2, 13))


def probe_problems(data: bytes, metadata: dict | None = None) -> list[str]:
    """What is wrong with a stored probe: a length or digest other than the built one's, metadata that don't hold, names or shapes that differ."""
    m = documents.PROBE if metadata is None else metadata
    want = probe_model()
    out = [] if len(data) == len(want) else [f"{len(data)} bytes instead of {len(want)}"]
    out += [] if hashlib.sha256(data).digest() == hashlib.sha256(want).digest() else ["the SHA-256 differs"]
    out += documents.metadata_problems(m)
    if not out:
        try:
            session = _session(data)
            given, made = session.get_inputs()[0], session.get_outputs()[0]
            for name, have, said in (("input", given.name, m["input"]["name"]), ("output", made.name, m["output"]["name"]), ("input shape", list(given.shape), m["input"]["shape"])):
                out += [] if have == said else [f"the {name} is {have!r} instead of {said!r}"]
        except SignalError as e:
            out.append(str(e))
    return out
