"""A trace followed as a stream: call stacks, locks held, and compaction, with state kept by key.

Rows come in any order within the watermark's delay.  A key's rows wait in a list
until the watermark has passed them, and are then taken one at a time in the
order of time and number; so what waits is bounded by the delay, and results are
those of the batch operators on the rows that the watermark has passed.  A row
that comes after that is late and left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps lists and maps apart, so that a batch writes what it changes.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 50_000
EVENT = "us long, seq long, kind string, name string, item string"


class Ordered(StatefulProcessor):
    """Takes each key's rows in order, once the watermark has passed them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getValueState("last", "us long, seq long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Further state."""

    def fold(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        once: dict[str, str] = {}
        text = lambda x: once.setdefault(x, x)  # noqa: E731  (equal texts are one object)
        return self._ready(key, [(r["us"], r["seq"], text(r["kind"]), text(r["name"]), text(r["item"])) for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        return self._ready(key, [], timerValues)

    def _ready(self, key, new: list[tuple], timer) -> Iterator[Row]:
        mark = timer.getCurrentWatermarkInMs() * 1000
        last = tuple(self.last.get()) if self.last.exists() else None
        rows = sorted([*map(tuple, self.waiting.get()), *(r for r in new if last is None or r[:2] > last)], key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark]
        left = rows[len(ready) :]
        if left:
            self.waiting.put(left[:CHUNK])
            for k in range(CHUNK, len(left), CHUNK):
                self.waiting.appendList(left[k : k + CHUNK])
            # behind the first row that waits: the next look at this key
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            self.last.update(ready[-1][:2])
            yield from self.fold(key, ready)


class Tracer(Ordered):
    """Accesses with the calls open around them and the locks held, of one thread."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.stack = handle.getListState("stack", "name string, invno long")
        self.calls = handle.getMapState("calls", "name string", "n long")
        self.locks = handle.getMapState("locks", "address string", "seq long")

    def fold(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        stack = [tuple(r) for r in self.stack.get()]
        locks = {k[0]: v[0] for k, v in self.locks.iterator()}
        counts: dict[str, int] = {}
        for _, seq, kind, name, item in rows:
            if kind == "CALL":
                if name not in counts:
                    counts[name] = self.calls.getValue((name,))[0] if self.calls.containsKey((name,)) else 0
                counts[name] += 1
                stack.append((name, counts[name]))
            elif kind == "RETURN":
                del stack[-1:]
            elif kind == "LOCK":
                locks[item] = seq
            elif kind == "UNLOCK":
                locks.pop(item, None)
            else:
                func, invno = stack[-1] if stack else (None, None)
                yield Row(seq=seq, func=func, invno=invno, depth=len(stack), held=sorted(locks))
        self.stack.put(stack) if stack else self.stack.clear()
        for name, n in counts.items():
            self.calls.updateValue((name,), (n,))
        self.locks.clear()
        for address, seq in locks.items():
            self.locks.updateValue((address,), (seq,))


class Compactor(Ordered):
    """Reads and writes between other events, by variable; a run's segment is given out when it ends."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.segment = handle.getValueState("segment", "seg long, context string")
        self.sums = handle.getMapState("sums", "item string", "reads long, writes long, first_read long, first_write long")

    def fold(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        seg, context = tuple(self.segment.get()) if self.segment.exists() else (0, None)
        sums = {k[0]: list(v) for k, v in self.sums.iterator()}
        for _, seq, kind, name, item in rows:
            if kind not in ("READ", "WRITE"):
                for var, (reads, writes, first_read, first_write) in sums.items():
                    yield Row(part=key[0], seg=seg, context=context, item=var, reads=reads, writes=writes, first_read=first_read, first_write=first_write)
                sums, seg, context = {}, seg + 1, None
                continue
            context = name if not sums else context
            if name == context:  # others in the segment are left out, as the trace's compaction does
                s = sums.setdefault(item, [0, 0, None, None])
                write = kind == "WRITE"
                s[write] += 1
                s[2 + write] = seq if s[2 + write] is None else s[2 + write]
        self.segment.update((seg, context))
        self.sums.clear()
        for var, s in sums.items():
            self.sums.updateValue((var,), tuple(s))


def _run(stream: DataFrame, part: str, time: str, late: str, make: Callable[[], StatefulProcessor], schema: str) -> DataFrame:
    """``stream``: part, time, seq, kind, name, item."""
    rows = stream.select(F.col(part).cast("string").alias("part"), F.col(time).cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), "kind", F.col("name").cast("string").alias("name"), F.col("item").cast("string").alias("item"))
    return rows.withWatermark("at", late).withColumn("us", F.unix_micros("at")).groupBy("part").transformWithState(make(), schema, "Append", "EventTime")


def accesses(stream: DataFrame, part: str, time: str, late: str) -> DataFrame:
    """(seq, func, invno, depth, held) of each access: the innermost open call and its number, how many are open, the addresses of the locks held."""
    return _run(stream, part, time, late, Tracer, "seq long, func string, invno long, depth int, held array<string>")


def compacted(stream: DataFrame, part: str, time: str, late: str) -> DataFrame:
    """(part, seg, context, item, reads, writes, first_read, first_write) of each segment that has ended."""
    return _run(stream, part, time, late, Compactor, "part string, seg long, context string, item string, reads long, writes long, first_read long, first_write long")
