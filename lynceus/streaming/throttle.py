"""Streaming form of the throttle, with the open window of each key as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lynceus.functions.times import micros
from lynceus.operators.throttle import (
    LIMIT,
    NEVER,
    NO_KEY,
    WINDOW_MICROS,
    decide,
    state_after,
)

# Types whose JSON text gives the same value back.
CARRIED = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")
EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timeZone": "UTC",
}


def throttle_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    request_id: str,
    limit: int = LIMIT,
    window_micros: int = WINDOW_MICROS,
    expire_ms: int | None = None,
) -> DataFrame:
    """Every request, with all its columns and ``allowed``, decided in the order of its micro-batch.

    A micro-batch holds later requests than the one before; a late request is
    decided when it arrives. The state function sees a request's time and id, its other columns as
    one JSON text, and the state is two numbers per key. Other than plain columns (nested, binary, interval ones) are refused by name; a
    column named ``allowed`` is replaced. ``expire_ms`` drops keys idle for that
    long of processing time, which must cover the window. It suits queries that run on: one that
    ends with its input would wait for timeouts.
    Requests without a key share one window with those of the unnamed client, as in batch.
    """
    window_ms = -(-window_micros // 1000)
    if expire_ms is not None and expire_ms < window_ms:
        raise ValueError(f"expire_ms must be at least the window of {window_ms} ms")
    rest = [f for f in requests.schema.fields if f.name not in (request_id, "allowed")]
    if bad := [f.name for f in rest if f.dataType.simpleString().split("(")[0] not in CARRIED]:
        raise ValueError(f"columns {bad} can not be carried through the state function")
    timed = requests.select(
        F.coalesce(F.col(key).cast("string"), F.lit(NO_KEY)).alias("key"),
        micros(F.col(ts)).alias("t"),
        F.col(request_id).alias("id"),
        F.to_json(F.struct(*[F.col(f.name) for f in rest]), EXACT).alias("rest"),
    )
    id_type = timed.schema["id"].dataType.simpleString()

    def run(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
        times = pdf["t"].to_numpy(dtype=np.int64)
        start, used = state.get if state.exists else (NEVER, 0)
        allowed = decide(times, start, used, window_micros, limit)
        state.update(state_after(times, start, used, window_micros, limit))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame(
            {"id": pdf["id"], "rest": pdf["rest"], "allowed": allowed}
        )

    decided = timed.groupBy("key").applyInPandasWithState(
        run,
        f"id {id_type}, rest string, allowed boolean",
        "start bigint, used bigint",
        "append",
        GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    back = decided.select("id", F.from_json("rest", StructType(rest), EXACT).alias("rest"), "allowed")
    columns = [F.col("id").alias(c) if c == request_id else F.col("rest").getField(c).alias(c) for c in requests.columns if c != "allowed"]
    return back.select(*columns, "allowed")
