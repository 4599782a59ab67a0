"""Deterministic pricing of a service job as column expressions on whole numbers (no joins, no Python)."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartage.functions.staging import staged

TEN_THOUSANDTHS = 10_000


@dataclass(frozen=True)
class PricingConfig:
    """Fixed values of the default tariff; dollars and hours."""

    base_hours: dict[str, float] = field(default_factory=lambda: {"studio": 3.0, "1br": 4.0, "2br": 5.5, "3br": 7.5, "4br": 9.0, "5br_plus": 11.0})
    crew: dict[str, int] = field(default_factory=lambda: {"studio": 2, "1br": 2, "2br": 3, "3br": 3, "4br": 4, "5br_plus": 5})
    rate: dict[int, float] = field(default_factory=lambda: {2: 140.0, 3: 190.0, 4: 240.0, 5: 290.0})
    packing: dict[str, float] = field(default_factory=lambda: {"none": 1.0, "partial": 1.25, "full": 1.5})
    items: dict[str, float] = field(default_factory=lambda: {"piano": 1.5, "safe": 1.0, "pool_table": 1.0})
    item_default: float = 0.5
    min_hours: float = 3.0
    per_flight: float = 0.4
    elevator: float = 0.3
    travel_base: float = 50.0
    per_mile: float = 2.0
    weekend: float = 1.10
    month_end: float = 1.10
    month_end_from: int = 25
    peak: float = 1.05
    peak_months: tuple[int, ...] = (5, 6, 7, 8, 9)
    spread: float = 0.12

    def problems(self) -> list[str]:
        """What makes this tariff unusable: sizes without crew or hours, crews without a rate."""
        out = [f"no crew for {s}" for s in self.base_hours if s not in self.crew]
        return out + [f"no rate for a crew of {c}" for c in sorted(set(self.crew.values()) - set(self.rate))]


def units(x: float | int, per: int = TEN_THOUSANDTHS) -> int:
    """``x`` in whole units of 1 / ``per``; by its decimal digits, not its binary value."""
    return int((Decimal(str(x)) * per).to_integral_value(ROUND_HALF_UP))


def div(a: Column, b: int) -> Column:
    """Whole division of numbers that are not negative."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def lookup(table: dict, key: Column, per: int = TEN_THOUSANDTHS) -> Column:
    """The value of ``key`` in units; null for an unknown key."""
    out = F.lit(None).cast("long")
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(units(v, per)).cast("long")).otherwise(out)
    return out


def access_hours(floor: Column, flights: Column, elevator: Column, cfg: PricingConfig) -> Column:
    """Nothing at ground level; a flat time with an elevator; else a time for each flight climbed.  In units of hours."""
    climbs = F.greatest(flights, floor - 1).cast("long")
    return F.when((floor <= 1) & (flights == 0), F.lit(0).cast("long")).when(elevator, F.lit(units(cfg.elevator)).cast("long")).otherwise(F.lit(units(cfg.per_flight)) * climbs)


def cents(amount: Column, per: int) -> Column:
    """Units of 1 / ``per`` dollars to cents, half up; also for negative amounts (half away from zero)."""
    unit = per // 100
    whole = div(F.abs(amount) + unit // 2, unit)
    return F.when(amount < 0, -whole).otherwise(whole)


def dollar_cents(amount: Column, per: int) -> Column:
    """Units of 1 / ``per`` dollars to cents of whole dollars, half up."""
    return div(amount + per // 2, per) * 100


def date_multiplier(day: Column, cfg: PricingConfig) -> Column:
    """In millionths."""
    parts = [(F.weekday(day) >= 5, cfg.weekend), (F.dayofmonth(day) >= cfg.month_end_from, cfg.month_end), (F.month(day).isin(*cfg.peak_months), cfg.peak)]
    a, b, c = (F.when(on, F.lit(units(by, 100)).cast("long")).otherwise(F.lit(100).cast("long")) for on, by in parts)
    return a * b * c


def item_hours(items: Column, cfg: PricingConfig) -> Column:
    """Units of hours for special items: each counts the default, known ones their own; by counts, without a fold."""
    extra = [(F.size(items) - F.size(F.array_remove(items, k))).cast("long") * (units(v) - units(cfg.item_default)) for k, v in cfg.items.items()]
    return sum(extra, F.size(items).cast("long") * units(cfg.item_default))


def priced(rows: DataFrame, name: str, home_size: Column, packing: Column, items: Column, origin: dict[str, Column], destination: dict[str, Column], miles: Column, day: Column, cfg: PricingConfig | None = None) -> DataFrame:
    """``rows`` with a struct ``name``: crew_size, estimated_hours, line_items, subtotal_cents, adjustment_multiplier, total_cents, amount_min_cents, amount_max_cents.

    ``origin`` and ``destination`` have floor, flights, elevator.  Null where the size, packing or distance is unknown.
    All steps are exact whole numbers of small units (ten-thousandths of hours and dollars, a trillionth of a dollar at
    the end), which run as plain machine arithmetic; amounts may reach nine million dollars.
    """
    cfg = cfg or PricingConfig()
    own = rows.columns
    c = lambda n: F.col(f"__{n}")
    # Small steps: a generated method of more than 8000 bytes is not compiled by the JVM.
    given = {"__size": home_size, "__packing": packing, "__items": F.coalesce(items, F.array().cast("array<string>")), "__day": day}
    step = staged(rows, given | {"__miles": F.round(miles * TEN_THOUSANDTHS).cast("long")})
    for at, s in enumerate((origin, destination)):
        step = staged(step, {f"__access{at}": access_hours(s["floor"], s["flights"], s["elevator"], cfg)})
    step = staged(step, {"__base": lookup(cfg.base_hours, c("size")), "__crew": lookup(cfg.crew, c("size"), 1).cast("int")})
    step = staged(step, {"__factor": date_multiplier(c("day"), cfg)})
    raw = (c("base") + c("access0") + c("access1") + item_hours(c("items"), cfg)) * lookup(cfg.packing, c("packing"), 100)
    step = staged(step, {"__raw": raw})
    halves = F.greatest(div(2 * c("raw") + 999_999, 1_000_000), F.lit(units(cfg.min_hours, 2)).cast("long"))  # half hours, up
    step = staged(step, {"__halves": halves, "__travel": F.lit(units(cfg.travel_base)) + div(F.lit(units(cfg.per_mile)) * c("miles") + TEN_THOUSANDTHS // 2, TEN_THOUSANDTHS)})
    labour = div(c("halves") * lookup(cfg.rate, c("crew")), 2)
    step = staged(step, {"__labour": labour, "__sub": labour + c("travel"), "__total": (labour + c("travel")) * c("factor")})
    low, high = (c("total") * units(1 + sign * cfg.spread, 100) for sign in (-1, 1))
    item = lambda code, amount: F.struct(F.lit(code).alias("code"), amount.alias("amount_cents"))
    gap = c("total") - c("sub") * 1_000_000
    lines = F.array_compact(F.array(item("labor", cents(c("labour"), TEN_THOUSANDTHS)), item("travel", cents(c("travel"), TEN_THOUSANDTHS)), F.when(c("factor") != 1_000_000, item("date_adjustment", cents(gap, 10**10)))))
    step = staged(step, {"__lines": lines})
    out = F.struct(
        c("crew").alias("crew_size"), (c("halves") / 2).alias("estimated_hours"), c("lines").alias("line_items"), cents(c("sub"), TEN_THOUSANDTHS).alias("subtotal_cents"), (c("factor") / 1_000_000).alias("adjustment_multiplier"),
        cents(c("total"), 10**10).alias("total_cents"), dollar_cents(low, 10**12).alias("amount_min_cents"), dollar_cents(high, 10**12).alias("amount_max_cents"),
    )
    return step.select(*(F.col(f"`{x}`") for x in own), F.when(c("raw").isNotNull() & c("miles").isNotNull(), out).alias(name))


def exclusion_reason(actual: Column, miles: Column, floor: Column, flights: Column, predicted: Column) -> Column:
    """Why a job can't train a correction; the first reason counts, null means usable."""
    ratio = F.try_divide(actual, predicted)
    return (
        F.when(actual.isNull(), "no_actual_hours")
        .when((actual < 0.5) | (actual > 48), "implausible_hours")
        .when(miles.isNull(), "no_distance")
        .when(floor.isNull() & flights.isNull(), "no_access")
        .when(predicted.isNull() | (predicted <= 0), "unpriceable")
        .when((ratio < 0.25) | (ratio > 4), "implausible_ratio")
    )


def deposit_cents(kind: Column, value: Column, minimum: Column) -> Column:
    """none, fixed or percent of the smallest price; under a dollar nothing, never more than the smallest price."""
    amount = F.when(kind == "fixed", value.cast("long")).when(kind == "percent", F.bround(minimum * value / 100).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(amount < 100, F.lit(0).cast("long")).otherwise(F.least(amount, minimum.cast("long")))
