"""Location and possession intervals from a stream of changes.

State is kept by entity: the open location interval, and for each object it holds the gain that began the interval. It is read and
written once a trigger; entities have few rows each, so these come as rows, not as a frame an entity. One pass
over a trigger's rows, in order, closes intervals of both kinds. A change older than the entity's last one is put out as late:
its entity is refolded in batch from that chapter on (``late_points`` and ``operators.refold``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "kind string, novel long, entity long, id long, location string, since int, until int"
BOTH = "kind string, novel long, entity long, object long, id long, location string, since int, until int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_out = Row(*[x.split()[0] for x in BOTH.split(", ")])


class Intervals(StatefulProcessor):
    """Closed intervals of both kinds (location, possession), and late changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", "id long, location string, since int, chapter int, ordinal long, held array<struct<object:long,id:long,since:int>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # one read and one write of the entity's state a trigger
        before = self._state.get()
        own, held = (tuple(before[:5]), {x[0]: (x[1], x[2]) for x in before[5]}) if before is not None else (None, {})
        for row in sorted(rows, key=lambda r: (r.chapter, r.ordinal)):
            if own is not None and (row.chapter, row.ordinal) < (own[3], own[4]):
                yield _out("late", *key, None, row.ordinal, row.location, row.chapter, None)
                continue
            if own is None or own[1] != row.location:
                if own is not None:
                    yield _out("location", *key, None, own[0], own[1], own[2], max(row.chapter - 1, own[2]))
                own = (row.ordinal, row.location, row.chapter, row.chapter, row.ordinal)
            else:
                own = (*own[:3], row.chapter, row.ordinal)
            if row.change == "gain" and row.object is not None:
                held.setdefault(row.object, (row.ordinal, row.chapter))
            elif row.change == "loss" and row.object in held:
                id_, since = held.pop(row.object)
                yield _out("possession", *key, row.object, id_, None, since, row.chapter)
        self._state.update((*own, [(o, *x) for o, x in held.items()]))

    def close(self) -> None:
        pass


def stream_edges(deltas: DataFrame) -> DataFrame:
    """Closed intervals and late changes of a streaming log (novel, entity, chapter, ordinal, location, object, change).

    The session's state store must be RocksDB (``ROCKS``).
    """
    return deltas.groupBy("novel", "entity").transformWithState(Intervals(), BOTH, "append", "none")


def stream_location_edges(deltas: DataFrame) -> DataFrame:
    """Closed location intervals (kind ``closed``) and late changes of a streaming log (novel, entity, chapter, ordinal, location)."""
    plain = deltas.withColumns({"object": F.lit(None).cast("long"), "change": F.lit(None).cast("string")})
    out = stream_edges(plain).where("kind <> 'possession'")
    return out.select(F.when(F.col("kind") == "location", "closed").otherwise(F.col("kind")).alias("kind"), "novel", "entity", "id", "location", "since", "until")


def late_points(out: DataFrame) -> DataFrame:
    """(novel, entity, from_chapter) of a stream's output: from where its late entities must be refolded in batch."""
    return out.where("kind = 'late'").groupBy("novel", "entity").agg(F.min("since").alias("from_chapter"))
