"""Config history: lifecycle, activation intervals and projections, all folded from the event log.

Events have seq, event, event_id, occurred_at, set_id, config_key, version_id,
version, scope_kind, scope_key, activated_at, deactivated_at.  Versions have
version_id, set_id, config_key, version, lifecycle, created_at and, for
projections, the document's members, artifact and definition_checksum.
Intervals have set_id, config_key, version_id, version, scope_kind, scope_key,
activated_at, deactivated_at, seq.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, or_else, unicode_trim
from .asof import as_of, carried

#: The state that each event leads to.
STATE_OF = {"config.draft_created": "draft", "config.validated": "validated", "config.compiled": "compiled", "config.activated": "active", "config.deactivated": "inactive", "config.archived": "archived", "config.rejected": "rejected"}
#: The states from which each state may be entered; none: a new version.
MAY_FOLLOW = {"draft": (None,), "validated": ("draft",), "compiled": ("validated",), "active": ("compiled", "inactive"), "inactive": ("active",), "archived": ("draft", "validated", "compiled", "inactive", "rejected"), "rejected": ("draft", "validated")}
INTERVAL = ["set_id", "config_key", "version_id", "version", "scope_kind", "scope_key", "activated_at"]
RUNTIME_KEY = ["scope_kind", "scope_key", "set_id", "config_key", "version_id", "version"]


def state_of(event: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATE_OF.items() for x in kv]), event)


def scope(kind: Column, key: Column) -> tuple[Column, Column]:
    """A scope in normal form: kind in lower case, both trimmed, global and default where blank."""
    return F.lower(or_else(kind, F.lit("global"))), or_else(key, F.lit("default"))


def activation_intervals(events: DataFrame) -> DataFrame:
    """One row per activation: it ends when the scope's next begins or when its version is deactivated there."""
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    e = events.where(F.col("event").isin("config.activated", "config.deactivated")).withColumn("scope_kind", kind).withColumn("scope_key", key)
    e = e.withColumn("at", F.coalesce(F.when(F.col("event") == "config.activated", F.col("activated_at")).otherwise(F.col("deactivated_at")), F.col("occurred_at")))
    # The next activation is sought within a day, and then among the first ones of the days that follow, so that no task has to hold a scope.
    where = ["scope_kind", "scope_key"]
    e = e.withColumn("day", F.coalesce(F.unix_date(F.to_date("at")), F.lit(-(1 << 30))))
    up = F.when(F.col("event") == "config.activated", F.struct("at", "seq"))
    days = e.groupBy(*where, "day").agg(F.min(up).alias("first"))
    days = days.select(*where, "day", F.last("first", ignorenulls=True).over(W.partitionBy(*where).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)).alias("then"))
    # Latest first: a frame that grows from the start is kept up row by row, one that shrinks to the end is made anew for each.
    later = W.partitionBy(*where, "day").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("next", F.last(up, ignorenulls=True).over(later)).join(days, [*where, "day"]).withColumn("next", F.coalesce("next", "then")).drop("then", "day")
    own = W.partitionBy("scope_kind", "scope_key", "version_id").orderBy(F.desc("at"), F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumn("stop", F.last(F.when(F.col("event") == "config.deactivated", F.struct("at", "seq")), ignorenulls=True).over(own))
    rows = e.where("event = 'config.activated'").withColumn("activated_at", F.col("at"))
    return rows.select(*INTERVAL, F.least(F.col("next.at"), F.col("stop.at")).alias("deactivated_at"), "seq")


def _beside(df: DataFrame, at: str, value: Column, forward: bool) -> DataFrame:
    """``df`` with ``beside``, the ``value`` of the row before (or, not ``forward``, after) each in its scope by ``at`` and seq.

    Sought within a day, and for a day's first (last) row among one row for each other day, so that no task has to hold a scope.
    """
    where = ["scope_kind", "scope_key"]
    e = df.withColumn("bucket", F.coalesce(F.unix_date(F.to_date(at)), F.lit(-(1 << 30)))).withColumn("_value", value)
    order = [F.col(at), F.col("seq")] if forward else [F.desc(at), F.desc("seq")]
    pick = F.max_by if forward else F.min_by
    days = carried(e.groupBy(*where, "bucket").agg(pick(F.struct(F.col("_value").alias("v")), F.struct(at, "seq")).alias("then")), where, "then", forward)
    # A struct around the value tells a row without one from no row.
    e = e.withColumn("beside", F.lag(F.struct(F.col("_value").alias("v"))).over(W.partitionBy(*where, "bucket").orderBy(*order)))
    return e.join(days, [*where, "bucket"]).withColumn("beside", F.coalesce("beside", "then")["v"]).drop("then", "bucket", "_value")


def deactivation_conflicts(events: DataFrame) -> DataFrame:
    """Deactivations of a version that is not active in the scope at that time."""
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    e = events.where(F.col("event").isin("config.activated", "config.deactivated")).withColumn("scope_kind", kind).withColumn("scope_key", key)
    e = e.withColumn("at", F.coalesce(F.when(F.col("event") == "config.activated", F.col("activated_at")).otherwise(F.col("deactivated_at")), F.col("occurred_at")))
    e = _beside(e, "at", F.struct("event", "version_id"), True).withColumn("pe", F.col("beside.event")).withColumn("pv", F.col("beside.version_id"))
    ok = F.coalesce((F.col("pe") == "config.activated") & (F.col("pv") == F.col("version_id")), F.lit(False))
    return e.where((F.col("event") == "config.deactivated") & ~ok).select(*events.columns)


def current_lifecycle(events: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """version_id, set_id, config_key, version, lifecycle, updated_at: the state after the last event; a deactivated version stays active while another scope holds it.

    ``intervals``: those of the events, at least the open ones, where they are there already.
    """
    e = events.withColumn("state", state_of(F.col("event"))).where("state is not null")
    last = e.groupBy("version_id").agg(F.max_by(F.struct("set_id", "config_key", "version", "state", "occurred_at"), F.struct("occurred_at", "seq")).alias("l"))
    held = (activation_intervals(events) if intervals is None else intervals).where("deactivated_at is null").select("version_id").distinct().withColumn("held", F.lit(True))
    state = F.when((F.col("l.state") == "inactive") & F.col("held").isNotNull(), "active").otherwise(F.col("l.state"))
    return last.join(held, "version_id", "left").select("version_id", "l.set_id", "l.config_key", "l.version", state.alias("lifecycle"), F.col("l.occurred_at").alias("updated_at"))


def audit_transitions(events: DataFrame) -> DataFrame:
    """Events whose state may not follow the one before: seq, version_id, event, from_state, to_state."""
    e = events.withColumn("to_state", state_of(F.col("event"))).where("to_state is not null")
    e = e.withColumn("from_state", F.lag("to_state").over(W.partitionBy("version_id").orderBy("occurred_at", "seq")))
    legal = F.lit(False)
    for to, froms in MAY_FOLLOW.items():
        from_ok = F.col("from_state").isNull() if froms == (None,) else F.coalesce(F.col("from_state").isin(*froms), F.lit(False))
        legal = legal | ((F.col("to_state") == to) & from_ok)
    return e.where(~legal).select("seq", "version_id", "event", "from_state", "to_state")


def open_candidate_conflicts(versions: DataFrame) -> DataFrame:
    """Sets with more than one draft or validated version: set_id, candidates."""
    return versions.groupBy("set_id").agg(F.count_if(F.col("lifecycle").isin("draft", "validated")).alias("candidates")).where("candidates > 1")


def number_versions(drafts: DataFrame) -> DataFrame:
    """``version`` 1, 2, 3 … within a set, by created_at and seq."""
    return drafts.withColumn("version", F.row_number().over(W.partitionBy("set_id").orderBy("created_at", "seq")).cast("long"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The row of the greatest version of each set."""
    return versions.groupBy("set_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "set_id"]), "version").alias("l")).select("set_id", "l.*")


def active_by_scope(intervals: DataFrame, kind: str = "", key: str = "", as_of: datetime.datetime | None = None) -> DataFrame:
    """The activation a scope has now, or had at ``as_of``."""
    k, y = (kind or "").strip().lower() or "global", (key or "").strip() or "default"
    df = intervals.where((F.col("scope_kind") == k) & (F.col("scope_key") == y))
    if as_of is None:
        return df.where("deactivated_at is null")
    at = F.lit(as_of)
    return df.where((F.col("activated_at") <= at) & (F.col("deactivated_at").isNull() | (F.col("deactivated_at") > at)))


def activation_as_of(rows: DataFrame, intervals: DataFrame, at: str, width: int = 86_400_000_000) -> DataFrame:
    """``rows`` (scope_kind, scope_key, and the time ``at``) with ``activation``, the interval their scope had then, null where it had none.

    ``width`` is in microseconds, see ``as_of``.
    """
    kind, key = scope(F.col("scope_kind"), F.col("scope_key"))
    df = as_of(rows.withColumn("_kind", kind).withColumn("_key", key), intervals.withColumns({"_kind": F.col("scope_kind"), "_key": F.col("scope_key")}), ["_kind", "_key"], F.unix_micros(at), F.unix_micros("activated_at"), [F.col("seq")], width, "_found")
    own = F.struct(*[F.col(f"_found.{c}").alias(c) for c in intervals.columns])
    held = F.col("_found.deactivated_at").isNull() | (F.col("_found.deactivated_at") > F.col(at))
    return df.select(*rows.columns, F.when(F.col("_found").isNotNull() & held, own).alias("activation"))


def activations_of(intervals: DataFrame, version_id: str) -> DataFrame:
    return intervals.where(F.col("version_id") == version_id).orderBy("activated_at", "seq")


def active_scopes(intervals: DataFrame) -> DataFrame:
    """version_id, scopes: where each version is active, sorted."""
    return intervals.where("deactivated_at is null").groupBy("version_id").agg(F.array_sort(F.collect_set(F.struct("scope_kind", "scope_key"))).alias("scopes"))


def has_other_active(intervals: DataFrame) -> DataFrame:
    """``other_active``: another activation of the same version is open."""
    n = F.count_if(F.col("deactivated_at").isNull()).over(W.partitionBy("version_id"))
    return intervals.withColumn("other_active", n - F.col("deactivated_at").isNull().cast("int") > 0)


def list_versions(versions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Versions with their active scopes, newest first."""
    return versions.join(active_scopes(intervals), "version_id", "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<struct<scope_kind:string,scope_key:string>>"))).orderBy(F.desc("created_at"), F.desc("version_id"))


def get_version(versions: DataFrame, intervals: DataFrame, version_id: str) -> DataFrame:
    return list_versions(versions.where(F.col("version_id") == version_id.strip()), intervals.where(F.col("version_id") == version_id.strip()))


def list_sets(versions: DataFrame) -> DataFrame:
    """set_id, config_key, versions, created_at, oldest first."""
    return versions.groupBy("set_id").agg(F.min("config_key").alias("config_key"), F.count("*").alias("versions"), F.min("created_at").alias("created_at")).orderBy("created_at", "set_id")


def get_set(versions: DataFrame, set_id: str | None = None, config_key: str | None = None, version_id: str | None = None) -> DataFrame:
    """The set with an id, a key, or a version."""
    given = [(c, v) for c, v in (("set_id", set_id), ("config_key", config_key), ("version_id", version_id)) if v]
    if len(given) != 1:
        raise ValueError("give one of set_id, config_key and version_id")
    column, value = given[0]
    hit = versions.where(F.col(column) == value.strip()).select("set_id").distinct()
    return list_sets(versions.join(hit, "set_id", "left_semi"))


def scope_filter(df: DataFrame, kind: str | None, key: str | None) -> DataFrame:
    """Rows of a scope; kind and key are both given or neither."""
    kind, key = (kind or "").strip().lower(), (key or "").strip()
    if bool(kind) != bool(key):
        raise ValueError("scope kind and scope key go together")
    return df.where((F.col("scope_kind") == kind) & (F.col("scope_key") == key)) if kind else df


def runtime_projections(versions: DataFrame, intervals: DataFrame, scope: tuple[str, str] | None = None) -> DataFrame:
    """Open activations with what their version says, by scope, time and version."""
    rest = [c for c in versions.columns if c not in ("set_id", "config_key", "version", "created_at", "updated_at", "lifecycle")]
    df = scope_filter(intervals, *(scope or (None, None))).where("deactivated_at is null").select(*INTERVAL)
    return df.join(versions.select(*rest), "version_id").select(*INTERVAL, *[c for c in rest if c != "version_id"]).orderBy("scope_kind", "scope_key", "activated_at", "version_id")


def ingestion_bindings(runtimes: DataFrame, scope: tuple[str, str] | None = None) -> DataFrame:
    """A row for each binding of each runtime: binding_name, topic, fields and the runtime without rules."""
    rest = [c for c in runtimes.columns if c not in ("bindings", "rules")]
    df = scope_filter(runtimes, *(scope or (None, None))).select(F.explode("bindings").alias("b"), *rest)
    return df.select(F.col("b.name").alias("binding_name"), F.col("b.topic").alias("topic"), *rest).orderBy("scope_kind", "scope_key", "topic", "binding_name", "activated_at", "version_id")


def compact_runtimes(runtimes: DataFrame) -> DataFrame:
    """Runtimes without document, sorted."""
    return runtimes.select(*[c for c in runtimes.columns if c not in ("bindings", "fields", "rules", "metadata")]).orderBy("scope_kind", "scope_key", "activated_at", "version_id")


def runtime_changes(intervals: DataFrame) -> DataFrame:
    """change, at, scope and version: ``activated`` at each start, ``cleared`` at each end that no start of the scope replaces."""
    df = _beside(intervals, "activated_at", F.col("activated_at"), False).withColumnRenamed("beside", "_next")
    on = df.select(F.lit("activated").alias("change"), F.col("activated_at").alias("at"), *RUNTIME_KEY)
    off = df.where("deactivated_at is not null and (_next is null or deactivated_at < _next)").select(F.lit("cleared").alias("change"), F.col("deactivated_at").alias("at"), *RUNTIME_KEY)
    return on.unionByName(off)


def check_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): rows need an event name, an id and a time."""
    bad = blank(F.col("event")) | blank(F.col("event_id")) | F.col("occurred_at").isNull()
    trimmed = df.where(~bad).withColumn("event", unicode_trim(F.col("event"))).withColumn("event_id", unicode_trim(F.col("event_id")))
    return trimmed, df.where(bad)
