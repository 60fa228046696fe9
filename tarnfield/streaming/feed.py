"""Streams: the feed of changes, write-behind with one change a key, last states, and windows over events."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import AUDIT, Catalog


def changes(spark: SparkSession, folder: str, schema: str = AUDIT) -> DataFrame:
    """The audit files of a catalog, as they come."""
    return spark.readStream.schema(schema).json(folder)


#: Changes of one key that are folded in one list at most: sequence numbers are unique, and cut into ranges of this size.
RUN = 4096
_STATES = ("none", "add", "edit", "del")
#: The state that a change makes of a state; what isn't named stays as it is.
_MOVES = {("none", "add"): "add", ("none", "edit"): "edit", ("none", "del"): "del", ("add", "edit"): "add", ("add", "del"): "none", ("edit", "edit"): "edit", ("edit", "del"): "del", ("del", "add"): "edit"}


def coalesced(journal: DataFrame, keys: list[str], seq: str, action: str, payload: str) -> DataFrame:
    """One change for each key from its changes in order of a unique whole number: keys, action (add, edit, del), payload.

    add then edit is add, add then del is nothing, edit then edit is edit, edit then del is del, del then add is edit, any
    other change of an open one is ignored; the last payload that took effect counts. Runs of RUN sequence numbers are
    folded into what they make of each possible state, then a key's runs are chained, so a key with very many changes
    needs no long list. Payloads don't travel with the lists: the deciding one is fetched by its number.
    """
    number = journal.schema[seq].dataType.simpleString()
    null = F.lit(None).cast(number)
    step = F.struct(F.col(seq).alias("s"), F.lower(F.col(action)).alias("a"), F.col(payload).isNotNull().alias("p"))
    runs = journal.groupBy(*keys, F.floor(F.col(seq) / RUN).alias("__run")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    begin = F.struct(*[F.struct(F.lit(s).alias("a"), null.alias("at"), F.lit(False).alias("set")).alias(s) for s in _STATES])

    def moved(state: Column, x: Column) -> Column:
        """A change applied to (a, at, set); set: the payload is one of this run's, or none."""
        to, hit = F.lit(None).cast("string"), F.lit(False)
        for (old, change), new in _MOVES.items():
            here = (state["a"] == old) & (x["a"] == change)
            to, hit = F.when(here, F.lit(new)).otherwise(to), hit | here
        cleared = to.isin("none", "del")
        at = F.when(cleared, null).when(hit & x["p"], x["s"]).when(hit & (state["a"] == "none"), null).otherwise(state["at"])
        fixed = state["set"] | F.coalesce(cleared, F.lit(False)) | (hit & x["p"]) | (hit & (state["a"] == "none"))
        return F.struct(F.coalesce(to, state["a"]).alias("a"), at.alias("at"), fixed.alias("set"))

    folded = runs.withColumn("f", F.aggregate("steps", begin, lambda acc, x: F.struct(*[moved(acc[s], x).alias(s) for s in _STATES])))
    lists = folded.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__run", "f"))).alias("fs"))

    def chained(acc: Column, x: Column) -> Column:
        own = x["f"]["none"]
        for s in _STATES[1:]:
            own = F.when(acc["a"] == s, x["f"][s]).otherwise(own)
        return F.struct(own["a"].alias("a"), F.when(own["set"], own["at"]).otherwise(acc["at"]).alias("at"))

    start = F.struct(F.lit("none").alias("a"), null.alias("at"))
    last = lists.select(*keys, F.aggregate("fs", start, chained).alias("x")).select(*keys, F.col("x.a").alias("__a"), F.col("x.at").alias("__at")).filter("__a <> 'none'")
    paid = journal.filter(F.col(payload).isNotNull()).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(seq).alias("__seq"), F.col(payload).alias("__payload"))
    same = F.col("__at") == F.col("__seq")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return last.join(paid, same, "left").select(*keys, F.col("__a").alias("action"), F.col("__payload").alias("payload"))


def write_behind(stream: DataFrame, catalog: Catalog, name: str, *, key: str, seq: str, action: str, payload: str, checkpoint: str, trigger: dict[str, Any] | None = None):
    """Each batch's changes, one a key, merged into a table in one commit. A batch that runs again finds its number in the
    commit's note, or a later batch's, and does nothing, so each is applied once however many commits lie between."""

    def merge(batch: DataFrame, number: int) -> None:
        own = f"stream {name} {checkpoint} "
        note = f"{own}{number}"
        # from the newest commit back to the stream's last one
        last = next((n for v in reversed(catalog.versions()) if (n := _note(catalog, v) or "").startswith(own)), None)
        if last is not None and int(last.removeprefix(own)) >= number:
            return
        one = coalesced(batch, [key], seq, action, payload).persist()
        table = catalog.table(name, links=False)
        rows = one.filter("action <> 'del'").select(F.from_json("payload", table.df.schema).alias("r")).select("r.*")
        with catalog.transaction(note):
            gone = one.filter("action = 'del'").select(F.col(key).cast(table.df.schema[table.id].dataType).alias(table.id))
            catalog.delete(name, gone)
            catalog.update(name, rows, force=True)
        one.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _note(catalog: Catalog, version: int) -> str:
    import json

    return json.loads(catalog.store.read(f"_log/{version:012}.json"))["note"]


def last_state(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate that combines on the map side."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("s")).select(key, "s.*")


def windowed(events: DataFrame, ts: str, size: str, keys: list[str], aggregates: dict[str, Column], *, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or sliding windows, on a table or a stream; `late` is how long a stream waits for late rows."""
    return _grouped(events, F.window(ts, size, slide) if slide else F.window(ts, size), ts, keys, aggregates, late)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: dict[str, Column], *, late: str | None = None) -> DataFrame:
    """Windows that end when a key has been quiet for `gap`."""
    return _grouped(events, F.session_window(ts, gap), ts, keys, aggregates, late)


def _grouped(events: DataFrame, window: Column, ts: str, keys: list[str], aggregates: dict[str, Column], late: str | None) -> DataFrame:
    df = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = df.groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)
