"""Tenant-scoped reads: calendars, two-key deduplication, chains, versioned configuration and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartage.functions.staging import cut


def of_tenant(df: DataFrame, tenant: object, column: str = "company_id") -> DataFrame:
    """The tenant predicate, the first of every query, so that it reaches the scan."""
    return df.where(F.col(column) == F.lit(tenant))


def day_reason(day: Column, first: Column, last: Column, blocked: Column, booked: Column, capacity: Column) -> Column:
    """Why a day can't be booked; null if it can.  Window rules come before capacity rules."""
    return F.when(day < first, "too_soon").when(day > last, "too_far").when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.coalesce(booked, F.lit(0)) >= capacity, "full")


def calendar(tenants: DataFrame, booked: DataFrame, overrides: DataFrame, start: str, end: str, today: str, default_capacity: int = 2, min_days: int = 2, max_days: int = 120) -> DataFrame:
    """One row per tenant and day.  ``booked`` has (company_id, day, n), ``overrides`` (company_id, day, max_moves, is_blocked)."""
    spine = tenants.select("company_id", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    now = F.lit(today).cast("date")
    joined = spine.join(booked, ["company_id", "day"], "left").join(overrides, ["company_id", "day"], "left")
    reason = day_reason(F.col("day"), F.date_add(now, min_days), F.date_add(now, max_days), F.col("is_blocked"), F.col("n"), F.coalesce("max_moves", F.lit(default_capacity)))
    return joined.select("company_id", "day", F.coalesce("n", F.lit(0)).alias("booked"), reason.isNull().alias("available"), reason.alias("reason"))


def flag_duplicates(rows: DataFrame, order: str, ref: str, print_col: str, known_refs: DataFrame | None = None, tenant: str | None = None, known_prints: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``duplicate``: by reference where there is one, else by fingerprint, in file order.

    A row with a reference repeats one seen before or known.  A row without one repeats the fingerprint of an earlier
    row that has no reference or was kept, or a known one.  Each question is one smallest place per key, aggregated
    before the shuffle.  The joins back have one row a key on one side, so Spark splits a frequent key's rows at run time; rows
    without a fingerprint are spread by their place.  ``rows`` is read three times, once for each kind of first place and once for the result.
    """
    scope = [tenant] if tenant else []
    first = rows.where(F.col(ref).isNotNull()).groupBy(*scope, ref).agg(F.min(order).alias("__first"))
    if known_refs is not None:
        first = _marked(first, known_refs, [*scope, ref]).select(*scope, ref, F.when(F.col("__known").isNull(), F.col("__first")).alias("__first"))
    # A row without a reference asks under its place, which no reference has beside the false flag.
    has = F.col(ref).isNotNull()
    asking = rows.withColumns({"__has": has, "__at": F.when(~has, F.xxhash64(order))})
    same = [*(F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in scope), F.col(f"r.{ref}") == F.col(f"f.{ref}"), F.coalesce(F.col("r.__at"), F.lit(0)) == F.col("f.__at")]
    repeats = F.col("r.__has") & (F.col("f.__first").isNull() | (F.col(f"r.{order}") > F.col("f.__first")))
    named = asking.alias("r").join(first.withColumn("__at", F.lit(0).cast("long")).alias("f"), same, "left").select("r.*", repeats.alias("__repeats")).drop("__at")
    spread = F.coalesce(F.when(F.col(print_col).isNotNull(), F.lit(0).cast("long")), F.xxhash64(order))
    stand = named.where(~F.col("__repeats") & F.col(print_col).isNotNull())
    earliest = stand.groupBy(*scope, print_col).agg(F.min(order).alias("__first"))
    if known_prints is not None:
        earliest = _marked(earliest, known_prints, [*scope, print_col]).select(*scope, print_col, F.when(F.col("__known").isNull(), F.col("__first")).alias("__first"), F.lit(True).alias("__met"))
    else:
        earliest = earliest.withColumn("__met", F.lit(True))
    same = [*(F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in scope), F.col(f"r.{print_col}") == F.col(f"f.{print_col}"), F.col("r.__at") == F.col("f.__at")]
    again = F.col("f.__met").isNotNull() & (F.col("f.__first").isNull() | (F.col(f"r.{order}") > F.col("f.__first")))
    met = named.withColumn("__at", spread).alias("r").join(earliest.withColumn("__at", F.lit(0).cast("long")).alias("f"), same, "left")
    return met.select(*(F.col(f"r.`{c}`") for c in rows.columns), F.when(F.col("r.__has"), F.col("r.__repeats")).otherwise(again).alias("duplicate"))


def _marked(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``__known``: true where ``known`` has the keys, null keys being equal; else null."""
    side = known.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.lit(True).alias("__known")).distinct()
    return rows.join(side, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], "left").drop(*(f"__k_{k}" for k in keys))


def chain_heads(links: DataFrame, key: str, successor: str, max_hops: int = 50) -> DataFrame:
    """(key, head, hops), one row per key: the end of its chain of successors, or the last link whose successor is a row.

    Pointers and counts are doubled, so 50 hops are 7 joins of narrow rows.  A longer chain gives the link reached after
    ``max_hops``, a cycle the link that the walk comes to a second time; only walks that are still open then are
    followed with the links they have passed.
    """
    own = links.select(F.col(key).alias("key"), F.col(successor).alias("next"))
    there = own.select(F.col("key").alias("next")).distinct()
    own = cut(own.join(there.withColumn("__there", F.lit(True)), "next", "left").select("key", F.when(F.col("__there"), F.col("next")).alias("next")))
    step = own.select("key", F.coalesce("next", "key").alias("to"), F.col("next").isNotNull().cast("int").alias("n"))
    done, bits = None, max_hops
    while bits:
        if bits & 1:
            done = step if done is None else _then(done, step)
        bits >>= 1
        if bits:
            step = _then(step, step)
    done = cut(done)
    more = done.where(F.col("n") == max_hops).join(own.where("next IS NOT NULL").select(F.col("key").alias("to")), "to", "left_semi").select("key")
    out = done.select("key", F.col("to").alias("head"), F.col("n").alias("hops"))
    if more.isEmpty():
        return out
    walks = _walks(more, own, max_hops)
    return out.join(walks.select("key"), "key", "left_anti").unionByName(walks)


def _then(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, to, n): the walk ``a`` and from its end the walk ``b``."""
    after = b.select(F.col("key").alias("to"), F.col("to").alias("__to"), F.col("n").alias("__n"))
    return a.join(after, "to").select("key", F.col("__to").alias("to"), (F.col("n") + F.col("__n")).alias("n"))


def _walks(keys: DataFrame, links: DataFrame, max_hops: int, stride: int = 8) -> DataFrame:
    """(key, head, hops) of keys whose walks have passed ``max_hops`` links or a cycle, from paths of ``stride`` links."""
    none = F.array().cast(f"array<{links.schema['key'].dataType.simpleString()}>")
    ahead = links.select("key", F.when(F.col("next").isNull(), none).otherwise(F.array("next")).alias("path"))
    reach = 1
    while reach < stride:
        more = ahead.select(F.col("key").alias("end"), F.col("path").alias("more"))
        ahead = ahead.withColumn("end", F.coalesce(F.try_element_at("path", F.lit(-1)), "key")).join(more, "end")
        ahead = ahead.select("key", F.when(F.size("path") == reach, F.concat("path", "more")).otherwise(F.col("path")).alias("path"))
        reach *= 2
    ahead = cut(ahead.select(F.col("key").alias("end"), F.col("path").alias("more")))
    walk = keys.select("key", F.array("key").alias("walk"))
    for _ in range(-(-max_hops // stride)):
        walk = walk.withColumn("end", F.element_at("walk", -1)).join(ahead, "end").select("key", F.concat("walk", "more").alias("walk"))
    walk = walk.select("key", F.slice("walk", 1, max_hops + 1).alias("walk"))
    # From its first repeated link on a walk only repeats, so that link comes after all the different ones.
    walk = walk.withColumn("hops", F.least(F.size(F.array_distinct("walk")), F.size("walk") - 1))
    return walk.select("key", F.element_at("walk", F.col("hops") + 1).alias("head"), "hops")


def new_version(configs: DataFrame, incoming: DataFrame, key: str = "company_id") -> DataFrame:
    """Append ``incoming`` as the next active version of each key; the version before is retired, not changed."""
    latest = configs.groupBy(key).agg(F.max("version").alias("__v"))
    added = incoming.join(latest, key, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v").withColumn("is_active", F.lit(True))
    touched = incoming.select(key).distinct().withColumn("__new", F.lit(True))
    old = configs.join(touched, key, "left").withColumn("is_active", F.col("is_active") & F.col("__new").isNull()).drop("__new")
    return old.unionByName(added, allowMissingColumns=True)


def merge_overrides(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by key; a change whose other columns are all null clears the row.  Idempotent."""
    rest = [c for c in current.columns if c not in keys]
    kept = current.join(changes.select(*keys), keys, "left_anti")
    put = changes.where(" OR ".join(f"`{c}` IS NOT NULL" for c in rest)) if rest else changes
    return kept.unionByName(put.select(*current.columns))


def latest_generation(chunks: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Only the newest generation of each parent's chunks."""
    newest = chunks.groupBy(parent).agg(F.max("generation").alias("generation"))
    return chunks.join(newest, [parent, "generation"], "left_semi")


def revert_batch(rows: DataFrame, batch: str) -> DataFrame:
    """All rows but the imported ones of one batch."""
    return rows.where(~((F.col("source") == "import") & F.col("import_batch_id").eqNullSafe(batch)))


def month_grid(months: DataFrame, month: str = "month") -> DataFrame:
    """(month, cell, day): the days of each month in weeks of seven from Sunday; cells before and after the month have no day."""
    first = F.trunc(F.col(month), "month")
    lead = F.dayofweek(first) - 1
    days = F.dayofmonth(F.last_day(first))
    cells = (F.ceil((lead + days) / 7) * 7).cast("int")
    at = months.select(first.alias("month"), lead.alias("lead"), days.alias("days"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    nth = F.col("cell") - F.col("lead")
    return at.select("month", "cell", F.when((nth >= 0) & (nth < F.col("days")), F.date_add("month", nth)).alias("day"))


def backfill_plan(stored: DataFrame, wanted: DataFrame, parent: str = "parent_id") -> DataFrame:
    """(parent, plan): current where the stored pieces (index, hash) are the wanted ones in order, else index or remove.

    A parent's pieces meet in one array, so a parent must be a document, not a tenant.
    """
    pieces = lambda df, name: df.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content_hash"))).alias(name))
    both = pieces(stored, "had").join(pieces(wanted, "want"), parent, "full")
    return both.select(parent, F.when(F.col("want").isNull(), "remove").when(F.col("had").eqNullSafe(F.col("want")), "current").otherwise("index").alias("plan"))


def upload_plan(files: DataFrame, stored: str, deleted: str, cap: int = 200) -> DataFrame:
    """(doc_id, step) of the ``files`` (doc_id, source, h) that are not ``stored``: duplicate, revive, create or, beyond ``cap`` live ones, refused.

    Places inside a source are running counts over the blocks of 1000 ids before and inside the block, so no source is one task's.
    """
    old = files.where(stored).groupBy("source", "h").agg(F.bool_or(~F.expr(deleted)).alias("live"))
    live = old.groupBy("source").agg(F.count_if("live").alias("n")).select(F.col("source").alias("__s"), "n")
    new = files.where(f"NOT ({stored})")
    first = new.groupBy("source", "h").agg(F.min("doc_id").alias("first"))
    known = first.alias("a").join(old.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.h") == F.col("b.h")), "left").select("a.source", "a.h", "first", "live")
    u = new.alias("u").join(known.alias("k"), F.col("u.source").eqNullSafe(F.col("k.source")) & (F.col("u.h") == F.col("k.h"))).select("u.doc_id", "u.source", "first", "live")
    step = F.when(F.coalesce("live", F.lit(False)) | (F.col("doc_id") > F.col("first")), "duplicate").when(F.col("live").isNotNull(), "revive").otherwise("create")
    g = u.select("doc_id", "source", step.alias("step"), F.call_function("div", F.col("doc_id"), F.lit(1000)).alias("block"))
    adds = F.when(F.col("step") != "duplicate", 1).otherwise(0)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = g.groupBy("source", "block").agg(F.sum(adds).alias("x")).select(F.col("source").alias("__t"), F.col("block").alias("__b"), F.coalesce(F.sum("x").over(before), F.lit(0)).alias("before"))
    inside = g.withColumn("inside", F.sum(adds).over(Window.partitionBy("source", "block").orderBy("doc_id")))
    met = inside.join(blocks, F.col("source").eqNullSafe(F.col("__t")) & (F.col("block") == F.col("__b"))).join(F.broadcast(live), F.col("source").eqNullSafe(F.col("__s")), "left")
    full = F.coalesce("n", F.lit(0)) + F.col("before") + F.col("inside") > cap
    return met.select("doc_id", F.when((F.col("step") != "duplicate") & full, "refused").otherwise(F.col("step")).alias("step"))
