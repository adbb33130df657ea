"""F4 streaming form: the directory scan throttle as a stateful processor
(``transformWithStateInPandas``): one value state per key holding the last
accepted event time. Rows of a key inside a micro-batch are sorted first;
rows older than the key's last accepted time are late and dropped
explicitly. Needs the RocksDB state store provider."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThrottleProcessor(StatefulProcessor):
    def __init__(self, key: str, ts: str, tie: str, gap_ms: int, out_cols: list[str]):
        self.key, self.ts, self.tie, self.gap_us, self.out_cols = key, ts, tie, gap_ms * 1000, out_cols

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("last_us", T.LongType(), True)])
        self.last = handle.getValueState("last_accepted", schema)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.sort_values([self.ts, self.tie], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        us = pdf[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        keep = []
        for t in us:
            if last is None or t - last >= self.gap_us:
                keep.append(True)
                last = int(t)
            else:
                keep.append(False)  # throttled, or late (older than the last accepted)
        if last is not None:
            self.last.update((last,))
        out = pdf[keep]
        yield out[self.out_cols]

    def close(self) -> None:
        pass


def scan_throttle_stream(events: DataFrame, key: str = "wd", ts: str = "ts", tie: str = "event_id",
                         gap_ms: int = 1000) -> DataFrame:
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    cols = [f.name for f in events.schema.fields]
    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=ThrottleProcessor(key, ts, tie, gap_ms, cols),
        outputStructType=events.schema,
        outputMode="Append",
        timeMode="None",
    )
