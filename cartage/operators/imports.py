"""Sheets of text to judged, typed and identified rows, and the batches in which they are kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartage.functions import fields, parse
from cartage.functions.fields import BY_NAME, IDENTIFYING, OUTCOMES, REQUIRED, Spec
from cartage.functions.staging import cut, staged
from cartage.operators import relational

ISSUES = "array<struct<field:string,message:string>>"
#: Worst first, as a preview shows them.
STATUSES = ("error", "warning", "duplicate", "ok")


def file_options(rows: DataFrame, mapping: Mapping[str, str], position: str = "row_number", date_order: str | None = None, decimal_style: str | None = None) -> DataFrame:
    """One row: date_order and decimal_style (null where the file leaves them open), date_ambiguous, money_ambiguous, ambiguous_money_fields.

    An answer that is given counts.  Else dates follow the column of the move's date, and all amounts the first money
    column, in the mapping's order, that decides; they are ambiguous only if none does.
    """
    money = [f for f in mapping if f in BY_NAME and BY_NAME[f].kind == "money"]
    found = {"__date": parse.date_order(mapping["move_date"], position) if "move_date" in mapping else F.lit(None).cast("string")}
    found |= {f"__{f}": parse.decimal_style(mapping[f], position) for f in money}
    one = rows.agg(*(c.alias(n) for n, c in found.items()))
    sure = lambda c: F.when(F.col(c) != "ambiguous", F.col(c))
    style = F.coalesce(F.lit(decimal_style), *(sure(f"__{f}") for f in money), F.lit(None).cast("string"))
    unsure = F.array_compact(F.array(*(F.when(F.col(f"__{f}") == "ambiguous", F.lit(f)) for f in money))).cast("array<string>")
    order = F.coalesce(F.lit(date_order), sure("__date"))
    return one.select(
        order.alias("date_order"), style.alias("decimal_style"), (order.isNull() & F.col("__date").isNotNull()).alias("date_ambiguous"),
        (style.isNull() & (F.size(unsure) > 0)).alias("money_ambiguous"), F.when(F.lit(decimal_style is None), unsure).otherwise(F.array().cast("array<string>")).alias("ambiguous_money_fields"),
    )


def typed(spec: Spec, x: Column, date_order: str, decimal_style: str) -> tuple[Column, Column]:
    """(value, whether there is nothing to read).  A value that can't be read or is out of bounds is null."""
    blank = parse.clean(x) == ""
    match spec.kind:
        case "date":
            value = parse.parse_date(x, date_order)
        case "money":
            value, blank = parse.parse_money_cents(x, decimal_style), parse.amount(x).isin("", "-")
        case "int":
            value, blank = parse.parse_int(x), F.translate(parse.clean(x), ",", "") == ""
        case "float":
            value, blank = parse.parse_hours(x), F.translate(parse.clean(x), ",", "") == ""
        case "bool":
            value = parse.parse_bool(x)
        case "enum":
            value = parse.parse_enum(x, dict(spec.values or {}))
        case "state":
            value = parse.parse_state(x)
        case "zip":
            value = parse.parse_zip(x)
        case "list":
            return parse.parse_list(x), F.lit(True)
        case _:
            return parse.parse_text(x), F.lit(True)
    if spec.low is not None:
        value = parse.let(value, lambda v: F.when(v.between(spec.low, spec.high), v))
    return value, blank


def business_issues(values: Mapping[str, Column], flagged: Mapping[str, Column], today: str) -> list[Column]:
    """Rules of every row, however it came: required fields, an outcome, no date to come.  Null where kept."""
    issue = lambda field, text: F.struct(F.lit(field).cast("string").alias("field"), F.lit(text).alias("message"))
    value = lambda f: values.get(f, F.lit(None))
    out = [F.when(value(f).isNull() & ~flagged.get(f, F.lit(False)), issue(f, f"{BY_NAME[f].label} is required and is missing")) for f in REQUIRED]
    out.append(F.when(value(OUTCOMES[0]).isNull() & value(OUTCOMES[1]).isNull(), issue(None, "neither hours nor a final total: no outcome")))
    return [*out, F.when(value("move_date") > F.lit(today).cast("date"), issue("move_date", "Move date is in the future"))]


def validate(rows: DataFrame, mapping: Mapping[str, str], today: str, date_order: str = "iso", decimal_style: str = "dot", position: str = "row_number") -> DataFrame:
    """(row_number, status, a column for each mapped field, errors, warnings, external_ref, fingerprint), one row per row.

    Required fields and outcomes that can't be read are errors, others are warnings and their value is dropped; a row
    with errors has no values and no identity.  Columns that are not mapped are ignored.
    """
    known = {f: h for f, h in mapping.items() if f in BY_NAME}
    read = {f: typed(BY_NAME[f], F.col(f"`{h}`"), date_order, decimal_style) for f, h in known.items()}
    own = {"row_number": F.col(position)} | {f"raw_{f}": F.col(f"`{h}`") for f, h in known.items()} | {f: v for f, (v, _) in read.items()}
    step = staged(rows, own, [])
    blank = {f: typed(BY_NAME[f], F.col(f"raw_{f}"), date_order, decimal_style)[1] for f in known}
    step = step.withColumns({f"bad_{f}": F.when(F.col(f).isNull(), ~blank[f]).otherwise(F.lit(False)) for f in known})
    for side in ("origin", "destination"):
        if f"{side}_line1" in known:
            step = step.withColumn(f"{side}_building_key", parse.building_key(F.col(f"{side}_line1"), F.col(f"{side}_zip") if f"{side}_zip" in known else F.lit(None).cast("string")))
    said = {f: F.when(F.col(f"bad_{f}"), F.struct(F.lit(f).alias("field"), F.concat(F.lit(f"{BY_NAME[f].label} '"), F.col(f"raw_{f}"), F.lit("' can't be read or is out of bounds")).alias("message"))) for f in known}
    critical = [f for f in known if f in REQUIRED + OUTCOMES]
    rules = business_issues({f: F.col(f) for f in known}, {f: F.col(f"bad_{f}") for f in known}, today)
    unknown = [F.struct(F.lit(f).alias("field"), F.lit("unknown field is ignored").alias("message")) for f in mapping if f not in BY_NAME]
    step = staged(step, {
        "errors": F.array_compact(F.array(*(said[f] for f in critical), *rules)).cast(ISSUES),
        "warnings": F.array_compact(F.array(*(said[f] for f in known if f not in critical), *unknown)).cast(ISSUES),
    })
    good = F.size("errors") == 0
    ident = [F.col(f) if f in known else F.lit(None).cast("string") for f in IDENTIFYING]
    prints = parse.fingerprint(*(F.bround(c, 2) if f in known and BY_NAME[f].kind == "float" else c for f, c in zip(IDENTIFYING, ident, strict=True)))
    keys = [c for c in step.columns if c.endswith("_building_key")]
    ref = F.when(good, F.col("external_ref")) if "external_ref" in known else F.lit(None).cast("string")
    return step.select(
        "row_number", F.when(~good, "error").when(F.size("warnings") > 0, "warning").otherwise("ok").alias("status"),
        *(F.when(good, F.col(c)).alias(c) for c in [*(f for f in known if f != "external_ref"), *keys]), "errors", "warnings", ref.alias("external_ref"), F.when(good, prints).alias("fingerprint"),
    )


def judge(rows: DataFrame, mapping: Mapping[str, str], today: str, known: DataFrame | None = None, **options: str) -> DataFrame:
    """``validate`` with repeats, in the file or of ``known`` (external_ref, row_hash), as duplicates without values."""
    judged = cut(validate(rows, mapping, today, **options))  # reading a sheet costs far more than keeping it
    refs = known.where("external_ref IS NOT NULL").select("external_ref") if known is not None else None
    prints = known.where("row_hash IS NOT NULL").select(F.col("row_hash").alias("fingerprint")) if known is not None else None
    # Rows with errors have neither reference nor fingerprint, so they repeat nothing.
    again = relational.flag_duplicates(judged, "row_number", "external_ref", "fingerprint", refs, known_prints=prints)
    values = [c for c in judged.columns if c not in ("row_number", "status", "errors", "warnings", "external_ref", "fingerprint")]
    skipped = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("already imported, skipped").alias("message")))
    return again.select("row_number", F.when(F.col("duplicate"), "duplicate").otherwise(F.col("status")).alias("status"), *(F.when(~F.col("duplicate"), F.col(c)).alias(c) for c in values), "errors", F.when(F.col("duplicate"), skipped).otherwise(F.col("warnings")).alias("warnings"), "external_ref", "fingerprint")


def counts(judged: DataFrame) -> DataFrame:
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return judged.agg(F.count(F.lit(1)).alias("total"), is_("ok", "warning").alias("importable"), is_("warning").alias("warnings"), is_("error").alias("rejected"), is_("duplicate").alias("duplicates"))


def preview(judged: DataFrame, limit: int = 200) -> DataFrame:
    """The rows that need a decision first; ``limit`` is the report's."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return judged.orderBy(rank, "row_number").limit(limit)


def identity(ref: Column, print_col: Column) -> tuple[Column, Column]:
    """(external_ref, row_hash): a job's own number or else its fingerprint, never both."""
    ref = F.nullif(ref, F.lit(""))
    return ref, F.when(ref.isNull(), print_col)


def batch_rows(judged: DataFrame, company: str, batch: str, today: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one provenance row).  The provenance row has importable = 0 where there is nothing to write."""
    ref, row_hash = identity(F.col("external_ref"), F.col("fingerprint"))
    kept = judged.where(F.col("status").isin("ok", "warning"))
    rows = kept.select(F.lit(company).alias("company_id"), F.lit(batch).alias("import_batch_id"), F.lit("import").alias("source"), *(c for c in kept.columns if c not in ("status", "errors", "warnings", "external_ref", "fingerprint")), ref.alias("external_ref"), row_hash.alias("row_hash"))
    stamp = counts(judged).select(F.lit(company).alias("company_id"), F.lit(batch).alias("import_batch_id"), "*", F.lit(today).cast("date").alias("imported_on"), F.lit(None).cast("date").alias("reverted_on"))
    return rows, stamp


def revert(history: DataFrame, batches: DataFrame, batch: str, today: str) -> tuple[DataFrame, DataFrame, Column]:
    """(history without the batch's imported rows, batches with the stamp, an aggregate over ``batches``: not_found, conflict or reverted).

    A batch that was reverted before is a conflict and changes nothing more: its rows are gone and its stamp stays.
    """
    hit = F.col("import_batch_id") == batch
    was = F.bool_or(hit & F.col("reverted_on").isNotNull())
    verdict = F.when(F.count_if(hit) == 0, "not_found").when(was, "conflict").otherwise("reverted")
    return relational.revert_batch(history, batch), batches.withColumn("reverted_on", F.when(hit, F.coalesce("reverted_on", F.lit(today).cast("date"))).otherwise(F.col("reverted_on"))), verdict


def revert_verdicts(asked: DataFrame, batches: DataFrame, batch: str) -> DataFrame:
    """``asked`` (a column ``batch``) with what a revert of each comes to: not_found, conflict or reverted."""
    known = batches.groupBy(F.col("import_batch_id").alias(batch)).agg(F.bool_or(F.col("reverted_on").isNotNull()).alias("__was"))
    verdict = F.when(F.col("__was").isNull(), "not_found").when(F.col("__was"), "conflict").otherwise("reverted")
    return asked.join(known, batch, "left").select(*asked.columns, verdict.alias("verdict"))


def suggested(sheet: DataFrame) -> DataFrame:
    """(field, header, confidence, filled, total): what a sheet's headers suggest, and how many of its rows fill each of them."""
    found = list(fields.suggest(sheet.columns))
    filled = [F.count(F.nullif(F.trim(F.col(f"`{h}`").cast("string")), F.lit(""))) for _, h, _ in found]
    each = [F.struct(F.lit(f).alias("field"), F.lit(h).alias("header"), F.lit(c).alias("confidence"), n.alias("filled")) for (f, h, c), n in zip(found, filled, strict=True)]
    return sheet.agg(F.count(F.lit(1)).alias("total"), F.array(*each).alias("each")).select(F.inline("each"), "total")


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null fields of ``changes``; the fingerprint is made anew only for rows without a job number."""
    new = [c for c in changes.columns if c != key]
    put = changes.select(key, *(F.col(c).alias(f"__{c}") for c in new))
    out = rows.join(put, key, "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in new})
    touched = F.lit(False)
    for c in new:
        touched = touched | F.col(f"__{c}").isNotNull()
    own = parse.fingerprint(*(F.bround(F.col(f), 2) if BY_NAME[f].kind == "float" else F.col(f) for f in IDENTIFYING if f in rows.columns))
    return out.withColumn("row_hash", F.when(touched & F.col("external_ref").isNull(), own).otherwise(F.col("row_hash"))).select(*rows.columns)


def dollars_to_cents(x: Column) -> Column:
    return F.bround(x * 100).cast("long")


def strict_jobs(rows: DataFrame, position: str = "row_number") -> DataFrame:
    """The legacy sheet: ISO dates, positive numbers, a crew of 1 to 10.  Good rows have no errors; nothing is deduplicated."""
    size, packing = F.lower(F.trim("home_size")), F.lower(F.trim(F.coalesce("packing_service", F.lit("none"))))
    day = F.when(F.trim("move_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim("move_date")))
    hours, miles, total = (F.col(c).try_cast("double") for c in ("actual_hours", "distance_miles", "actual_total_dollars"))
    crew = F.col("actual_crew_size").try_cast("int")
    sizes, packs = sorted(set(fields.HOME_SIZES.values())), sorted(set(fields.PACKING.values()))
    rules = [("move_date", day.isNotNull()), ("home_size", size.isin(*sizes)), ("packing_service", packing.isin(*packs)), ("distance_miles", miles > 0), ("actual_hours", hours > 0), ("actual_crew_size", crew.between(1, 10)), ("actual_total_dollars", total > 0)]
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f)) for f, ok in rules)))
    return rows.select(F.col(position).alias("row_number"), day.alias("move_date"), size.alias("home_size"), packing.alias("packing_service"), miles.alias("distance_miles"), hours.alias("actual_hours"), crew.alias("actual_crew_size"), dollars_to_cents(total).alias("actual_total_cents"), errors.alias("errors"))


def samples(rows: DataFrame, position: str = "row_number", n: int = 3) -> DataFrame:
    """(header, values): what the first ``n`` rows have in each column, without nulls."""
    heads = [c for c in rows.columns if c != position]
    first = rows.orderBy(position).limit(n)
    cells = first.select(position, F.explode(F.create_map(*[x for c in heads for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])).alias("header", "value"))
    return cells.groupBy("header").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(position, "value")))), lambda s: s["value"]).alias("values"))
