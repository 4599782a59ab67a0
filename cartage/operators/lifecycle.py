"""States of quotes and documents, edits and their revisions, payments, requests and entries, as columns and joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quote_status(status: Column, valid_until: Column, now: Column) -> Column:
    """A sent quote whose time has run out is expired."""
    return F.when((status == "sent") & (valid_until < now), "expired").otherwise(status)


def quote_step(status: Column, action: Column, valid_until: Column, now: Column, low: Column, high: Column, own_low: Column | None = None, own_high: Column | None = None) -> Column:
    """Struct: status after ``action`` (approve, accept, decline), error (null where it is allowed), lead status, whether a booking is made,
    the range after it (amount_min_cents, amount_max_cents) and whether this step has adjusted it.

    ``low`` and ``high`` are the range that an approval sets: a bound that is not given stays the quote's own (``own_low``,
    ``own_high``), and the range of both must be positive and in order.
    """
    at = quote_status(status, valid_until, now)
    mine = [F.lit(None).cast("long") if c is None else c for c in (own_low, own_high)]
    new = [F.coalesce(given, own) for given, own in zip((low, high), mine, strict=True)]
    given = low.isNotNull() | high.isNotNull()
    bad_range = given & ~F.coalesce((new[0] > 0) & (new[1] >= new[0]), F.lit(False))
    error = (
        F.when(action == "approve", F.when(status != "draft", "only drafts can be approved").when(bad_range, "invalid range"))
        .when(at == "expired", "expired").when(at != "sent", "not on offer")
    )
    after = F.when(error.isNotNull(), at).when(action == "approve", "sent").when(action == "accept", "accepted").otherwise("declined")
    done = lambda what: error.isNull() & (action == what)
    adjusted = done("approve") & given
    bounds = [F.when(adjusted, n).otherwise(own) for n, own in zip(new, mine, strict=True)]
    return F.struct(
        after.alias("status"), error.alias("error"), F.when(done("accept"), "booked").when(done("decline"), "lost").alias("lead_status"), done("accept").alias("booked"),
        bounds[0].alias("amount_min_cents"), bounds[1].alias("amount_max_cents"), adjusted.alias("adjusted"),
    )


def edit_refusal(status: Column, reviewed: Column) -> Column:
    """Why a customer may not change a quote; null if they may."""
    return F.when(status == "accepted", "booked already").when(status != "sent", "closed").when(reviewed, "the company confirms changes")


def checkout(status: Column, deposit: Column) -> Column:
    """Struct: error (null where a payment can start) and amount in cents."""
    error = F.when(status == "accepted", "accepted already").when(status != "sent", "not payable").when(deposit <= 0, "no deposit")
    return F.struct(error.alias("error"), F.when(error.isNull(), deposit).alias("amount_cents"))


def payment_kind(kind: Column, paid: Column) -> Column:
    """A provider's event type as succeeded, failed, expired or ignored; a success counts only if the session is paid."""
    # The provider's event types.
    won = kind.isin("checkout.session.completed", "checkout.session.async_payment_succeeded")
    return F.when(won & (paid == "paid"), "succeeded").when(kind == "checkout.session.async_payment_failed", "failed").when(kind == "checkout.session.expired", "expired").otherwise("ignored")


def document_status(kind: Column, length: Column, duplicate: Column, embedded: Column, passages: Column) -> Column:
    """Struct: status and reason of an ingested document; without all vectors it is ready for keywords only."""
    reason = F.when(kind.isNull(), "unknown kind").when(length < 80, "too little text").when(duplicate, "same text as another document").when(passages == 0, "no passages")
    return F.struct(F.when(reason.isNull(), "ready").otherwise("failed").alias("status"), reason.alias("reason"), (reason.isNull() & (embedded < passages)).alias("keyword_only"), reason.isNotNull().alias("can_retry"))


def changes(current: Mapping[str, Column], supplied: Mapping[str, Column]) -> Column:
    """A map of the supplied fields that differ from the current ones, as text; null means not supplied, lists compare in order."""
    differs = [F.when(new.isNotNull() & ~new.eqNullSafe(current[f]), F.struct(F.lit(f).alias("key"), new.cast("string").alias("value"))) for f, new in supplied.items()]
    return F.map_from_entries(F.array_compact(F.array(*differs)))


def overridden(rows: DataFrame, supplied: Mapping[str, Column]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(new, F.col(f)) for f, new in supplied.items()})


def revise(quotes: DataFrame, edits: DataFrame, key: str, new_key: Column) -> tuple[DataFrame, DataFrame]:
    """(quotes with the edited ones superseded and pointing to their revision, the revisions): history is only added to.

    ``edits`` has the key and the fields that change; quotes that are not sent are left alone.
    """
    fields = [c for c in edits.columns if c != key]
    put = edits.select(key, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__edit"))
    both = quotes.join(put, key, "left").withColumn("__do", F.coalesce(F.col("__edit"), F.lit(False)) & (F.col("status") == "sent"))
    old = both.withColumns({"superseded_by": F.when(F.col("__do"), new_key).otherwise(F.col("superseded_by")), "status": F.when(F.col("__do"), "superseded").otherwise(F.col("status"))})
    new = both.where("__do").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in fields}).withColumn("supersedes", F.col(key)).withColumn(key, new_key)
    drop = [f"__{c}" for c in fields] + ["__edit", "__do"]
    return old.withColumn("supersedes", F.lit(None).cast(quotes.schema[key].dataType)).drop(*drop), new.drop(*drop)


def public_view(status: Column, fields: Mapping[str, Column]) -> Column:
    """What anyone with the link sees: drafts hide the price and everything else that is named."""
    return F.struct(status.alias("status"), *(F.when(status != "draft", c).alias(n) for n, c in fields.items()))


def quote_actions(status: Column) -> Column:
    """What the page offers for a quote, in order; nothing once it is no longer on offer."""
    return F.when(status == "sent", F.array(*map(F.lit, ("change_date", "edit_move", "accept_quote")))).otherwise(F.array().cast("array<string>"))


def accept_label(deposit: Column) -> Column:
    return F.when(deposit > 0, F.concat(F.lit("Accept & pay "), money(deposit, True), F.lit(" deposit"))).otherwise(F.lit("Accept & book my move"))


def argument_problems(supplied: Column, allowed: Sequence[str], required: Sequence[str], forbidden: Sequence[str]) -> Column:
    """Struct of three lists of names in a call's arguments: forbidden ones, unknown ones, missing ones."""
    names = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.struct(F.array_sort(F.array_intersect(supplied, names(forbidden))).alias("forbidden"), F.array_sort(F.array_except(supplied, names([*allowed, *forbidden]))).alias("unknown"), F.array_sort(F.array_except(names(required), supplied)).alias("missing"))


def request_problems(zip_code: Column, state: Column, floor: Column, flights: Column, day: Column, today: Column, items: Column, email: Column | None = None) -> Column:
    """Names of the fields of a request that can't be taken, in order."""
    rules = [("zip", zip_code.rlike(r"^\d{5}(-\d{4})?$")), ("state", F.upper(state).rlike("^[A-Z]{2}$")), ("floor", floor.between(1, 100)), ("stairs_flights", flights.between(0, 20)), ("move_date", day >= today), ("special_items", F.size(items) <= 20)]
    rules += [("email", email.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))] if email is not None else []
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f)) for f, ok in rules)))


def draft_problems(title: Column, category: Column, content: Column, keywords: Column) -> Column:
    """Names of the fields of an entry's draft that are missing or too long."""
    limits = [("category", category, 50), ("title", title, 200), ("content", content, 4000)]
    bad = [F.when((F.length(F.trim(F.coalesce(c, F.lit("")))) == 0) | (F.length(F.trim(c)) > n), F.lit(f)) for f, c, n in limits]
    return F.array_compact(F.array(*bad, F.when(F.length(F.trim(keywords)) > 500, F.lit("keywords"))))


def entry_step(old: DataFrame, new: DataFrame, key: str, indexed: Sequence[str]) -> DataFrame:
    """(key, step): create, delete, reindex where an indexed field differs, visibility where only is_active does, else keep."""
    o = old.select(key, F.struct(*indexed).alias("__o"), F.col("is_active").alias("__oa"))
    n = new.select(key, F.struct(*indexed).alias("__n"), F.col("is_active").alias("__na"))
    both = o.join(n, key, "full")
    return both.select(key, F.when(F.col("__o").isNull(), "create").when(F.col("__n").isNull(), "delete").when(~F.col("__o").eqNullSafe(F.col("__n")), "reindex").when(~F.col("__oa").eqNullSafe(F.col("__na")), "visibility").otherwise("keep").alias("step"))


def swap_generation(stored: DataFrame, fresh: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Stored chunks with those of the parents in ``fresh`` replaced by a next generation; older generations go."""
    latest = stored.groupBy(parent).agg(F.max("generation").alias("__g"))
    put = fresh.join(latest, parent, "left").withColumn("generation", F.coalesce("__g", F.lit(0)) + 1).drop("__g")
    return stored.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(put.select(*stored.columns))


def promote(models: DataFrame, company: str, version: str, chosen: DataFrame) -> DataFrame:
    """Models with the chosen (company, version) active and the one active before retired; a retired model is never made active again."""
    pick = chosen.select(company, F.col(version).alias("__v"))
    able = models.join(pick, company, "left").withColumn("__hit", F.coalesce((F.col(version) == F.col("__v")) & (F.col("status") != "retired"), F.lit(False)))
    works = able.groupBy(company).agg(F.bool_or("__hit").alias("__works"))
    out = able.join(works, company)
    return out.withColumn("status", F.when(F.col("__hit"), "active").when(F.col("__works") & (F.col("status") == "active"), "retired").otherwise(F.col("status"))).drop("__v", "__hit", "__works")


def money(cents: Column, whole: bool = False) -> Column:
    """$1,234.56, or $1,235 without cents."""
    return F.concat(F.lit("$"), F.format_number(F.round(cents / 100) if whole else cents / 100, 0 if whole else 2))


def title_of(filename: Column) -> Column:
    """A document's title from its file's name: no folder, no extension, signs as single blanks."""
    bare = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,8}$", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"[_\-\s]+", " ")), 1, 200)


def extension_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"(\.[^./\\]+)$", 1))


def first_hop(forwarded: Column) -> Column:
    return F.trim(F.split(forwarded, ",").getItem(0))


def merged_settings(old: Column, new: Column) -> Column:
    """JSON objects of text values, the new one's fields before the old one's."""
    kind = "map<string,string>"
    have, put = F.coalesce(F.from_json(old, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(new, kind), F.create_map().cast(kind))
    return F.map_concat(F.map_filter(have, lambda k, v: ~F.map_contains_key(put, k)), put)


def setting(settings: Column, name: str, default: object, kind: str) -> Column:
    """A field of a JSON object as ``kind``; the default where it is missing or can't be read."""
    return F.coalesce(F.get_json_object(settings, f"$.{name}").try_cast(kind), F.lit(default).cast(kind))
