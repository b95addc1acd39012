"""Session deduplication over a stream of requests, with the full tracker rules as state.

Spans are remembered by symbol key, by symbol name and by file range. A request looks up its
key first and its range only when the key is unknown; it is answered by a back reference when
the span found was emitted in an earlier turn. A forced request emits again.

Keys and ranges both name one file, so a span belongs to one (session, file): a busy session spreads
over its files. Sessions' files are dealt to buckets, and state is kept per bucket, by session, file and slot. A task holds the rows one
micro-batch brings for one bucket; however many they are, it asks the state for a slot once at most and writes it once at most.
"""

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeloom.session_log import asked, written

REQUEST = ("session_id string, seq long, turn int, symbol_key string, symbol_name string, path string, "
           "start_line int, end_line int, force boolean")
OUTPUT = "session_id string, seq long, is_deduplicated boolean, source_turn int, source_name string, source_start int, source_end int"
BUCKETS = 4096   # part of the state's layout
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Known(dict):
    """Spans by session, file and slot; the state is asked for those that are not known yet, and not at all while it holds nothing."""

    def __init__(self, state):
        self.state, self.empty = state, not state.exists()

    def __missing__(self, slot):
        self[slot] = span = None if self.empty else self.state.getValue(slot)
        return span


class Tracker(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getMapState("spans", "session string, path string, slot string", "turn int, name string, start int, stop int")

    def handleInputRows(self, key, rows, timer_values):
        frame = pd.concat(list(rows)).sort_values(["turn", "seq"], kind="stable")
        spans, shown, out = _Known(self.spans), {}, []
        for r in frame.itertuples(index=False):
            place, file = (r.path, r.start_line, r.end_line), (r.session_id, r.path)
            known = (spans[*file, slot] for slot in asked(r.symbol_key, *place))
            found = next((span for span in known if span is not None), None)
            if found is not None and not r.force and found[0] < r.turn:
                out.append((r.session_id, r.seq, True, *found))
                continue
            out.append((r.session_id, r.seq, False, None, None, None, None))
            span = (int(r.turn), r.symbol_name, int(r.start_line), int(r.end_line))
            for slot in written(r.symbol_key, r.symbol_name, *place):
                spans[*file, slot] = shown[*file, slot] = span
        for slot, span in shown.items():
            self.spans.updateValue(slot, span)
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        result = pd.DataFrame(out, columns=columns)
        for c in ("source_turn", "source_start", "source_end"):
            result[c] = result[c].astype("Int32")
        yield result

    def close(self) -> None:
        pass


def deduplicate_stream(requests: DataFrame) -> DataFrame:
    """Streaming requests (columns of ``REQUEST``) to one output row each."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.pmod(F.xxhash64("session_id", "path"), F.lit(BUCKETS))
    return requests.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Tracker(), outputStructType=OUTPUT, outputMode="append", timeMode="none")
