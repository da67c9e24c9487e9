"""Latest-request-wins over a stream: a request supersedes all before it of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.errors import SignalError


class LatestGate:
    """Request ids of one caller: only the last one issued is current."""

    def __init__(self, prefix: str = "request"):
        self.prefix, self.last, self.signal = prefix, 0, None

    def issue(self, signal: str) -> str:
        self.last, self.signal = self.last + 1, signal
        return f"{self.prefix}-{self.last}"

    def is_current(self, request: str) -> bool:
        return self.last > 0 and request == f"{self.prefix}-{self.last}"

    def reset(self) -> None:
        self.signal = None


class LatestOnly:
    """Pending requests of one caller: issuing one refuses those before it with request-superseded; late results are dropped.

    kind names what is asked for (dsp or inference): it begins the request ids, and stands in the refusals.
    """

    def __init__(self, kind: str = "request"):
        self.kind, self.gate, self.pending, self.closed = kind, LatestGate(kind), {}, False

    def issue(self, signal: str, on_result, on_error) -> str:
        if self.closed:
            raise SignalError("invalid-input", "the caller is closed")
        request = self.gate.issue(signal)
        for _, refuse in self.pending.values():
            refuse(SignalError("request-superseded", f"a newer {self.kind} request took its place: {request}"))
        self.pending = {request: (on_result, on_error)}
        return request

    def resolve(self, request: str, result) -> bool:
        """True if the result was delivered; a superseded request's isn't."""
        if request not in self.pending or not self.gate.is_current(request):
            return False
        self.pending.pop(request)[0](result)
        return True

    def reject(self, request: str, cause: BaseException) -> bool:
        if request not in self.pending:
            return False
        self.pending.pop(request)[1](cause)
        return True

    def deliver(self, answer: dict) -> bool:
        """Routes an answer {kind, request, result or error: {code, message}}; those of another kind of request are passed over."""
        if answer.get("kind") == f"{self.kind}-result":
            return self.resolve(answer["request"], answer["result"])
        if answer.get("kind") == f"{self.kind}-error":
            error = answer["error"]
            return self.reject(answer["request"], SignalError(error["code"], error["message"]))
        return False

    def close(self) -> None:
        self.closed = True
        for _, refuse in self.pending.values():
            refuse(SignalError("request-superseded", f"the {self.kind} caller was closed"))
        self.pending = {}


def supersede(requests: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """(key, seq, payload, status) of a stream of requests (key string, seq long, payload string), in update mode.

    status is current for a request newer than all before it of its key, and request-superseded for the others,
    those that an arriving one replaces included; of equal seq, the first to arrive counts, and requests without one are left out. A key's state is its newest request, and goes after idle_ms without one.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, payload = state.get if state.exists else (None, None)
        out = []
        rows = [(int(s), p) for b in batches for s, p in zip(b["seq"], b["payload"], strict=True) if not pd.isna(s)]
        rows.sort(key=lambda r: r[0])
        for s, p in rows:
            if seq is not None and s <= seq:
                out.append((key[0], s, p, "request-superseded"))
                continue
            if seq is not None:
                out.append((key[0], seq, payload, "request-superseded"))
            seq, payload = s, p
        if rows and seq is not None and rows[-1][0] == seq:
            out.append((key[0], seq, payload, "current"))
        if seq is None:
            return
        state.update((seq, payload))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "payload", "status"])

    chosen = requests.selectExpr("cast(key as string) key", "cast(seq as long) seq", "cast(payload as string) payload")
    return chosen.groupBy("key").applyInPandasWithState(run, "key string, seq long, payload string, status string", "seq long, payload string", "update", GroupStateTimeout.ProcessingTimeTimeout)
