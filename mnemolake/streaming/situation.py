"""A conversation's topic as the state of a stream: the fold of ``operators.situation``, one batch's answer after another."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemolake.operators.situation import REFERENTS, SEGMENT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = f"kind string, conversation string, first long, topic string, start long, mentioned array<string>, closed {SEGMENT}"


class _Topic(StatefulProcessor):
    """The topic and where it began as one value; what is referred to, and what was closed, as lists."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "topic string, start long, first long")
        self.mentioned = handle.getListState("mentioned", "name string")
        self.closed = handle.getListState("closed", "start_sequence long, end_sequence long, gist string, referents array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.now.get() if self.now.exists() else (None, None, None)
        topic, start, seen = held
        mentioned = [r[0] for r in self.mentioned.get()] if self.mentioned.exists() else []
        for r in sorted(rows, key=lambda r: r["first"]):
            if r["now"] is None and r["referents"] is None and not r["shifted"] or seen is not None and r["first"] <= seen:
                continue
            closed = None
            if r["shifted"] and (topic is not None or mentioned):
                closed = (start if start is not None else r["before"], r["before"], topic or "", mentioned)
                self.closed.appendValue(closed)
                start = None
            start = r["first"] if start is None else start
            topic = topic if r["now"] is None else r["now"]
            mentioned = mentioned if r["referents"] is None else list(r["referents"])[:REFERENTS]
            seen = r["first"]
            yield Row(kind=key[0], conversation=key[1], first=seen, topic=topic, start=start, mentioned=mentioned, closed=closed)
        if seen is not None:
            self.now.update((topic, start, seen))
            self.mentioned.put([(m,) for m in mentioned]) if mentioned else self.mentioned.clear()

    def close(self) -> None:
        pass


def topics(stream: DataFrame) -> DataFrame:
    """The rows of ``operators.situation.fold`` for a stream of answers, as they come. The session's state store must be RocksDB.

    Answers of a conversation come in order; one at or before the last that changed the state is a repeat and changes nothing.
    """
    own = stream.select("kind", "conversation", "first", "before", "now", "referents", "shifted")
    return own.groupBy("kind", "conversation").transformWithState(_Topic(), OUTPUT, "Append", "None")
