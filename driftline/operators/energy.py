"""Demand, eligibility, replenishment, power: row-level decisions as column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY, AIR = 9.80665, 1.204


def demand(soc: Column, capacity: Column, consumption: Column, remaining_km: Column, planned_km: Column, travelled_km: Column, energy_kwh: Column, safe_soc: Column, reserve_km: Column, range_km: Column) -> dict[str, Column]:
    """need, reason, warning and what they rest on. Conditions hold in the order given; the first decides."""
    invalid = (
        F.when(soc.isNull(), "MISSING_DATA").when((soc < 0) | (soc > 100), "INVALID_STATE").when(remaining_km < 0, "INVALID_STATE").when(consumption <= 0, "INVALID_STATE")
        .when(energy_kwh.isNotNull() & ((energy_kwh < 0) | capacity.isNull() | (energy_kwh > capacity)), "INVALID_STATE")
    )
    energy = F.coalesce(energy_kwh, capacity * soc / 100.0)
    guard = F.when(energy_kwh.isNotNull(), F.try_divide(energy_kwh, capacity) * 100.0).otherwise(soc)
    below = F.coalesce(guard <= F.coalesce(safe_soc, F.lit(15.0)) + 5.0, F.lit(False))
    trip = F.coalesce(remaining_km, F.greatest(F.lit(0.0), planned_km - travelled_km))
    reserve = F.coalesce(reserve_km, F.greatest(F.lit(1.0), trip * 0.15))
    reach = F.coalesce(range_km, F.try_divide(energy * 1000.0, consumption))
    short = F.coalesce(reach < trip + reserve, F.lit(False))
    lost = F.coalesce(reach < trip, F.lit(False))
    need = invalid.isNull() & (below | short)
    reason = (
        F.when(invalid.isNotNull(), invalid).when(~(below | short), "SUFFICIENT_SOC_RANGE").when(below & short, "LOW_SOC_AND_INSUFFICIENT_RANGE").when(below, "LOW_SOC")
        .when(lost, "DESTINATION_NOT_REACHABLE").otherwise("INSUFFICIENT_POST_DESTINATION_RESERVE")
    )
    warning = F.when(invalid.isNotNull(), "UNAVAILABLE").when(lost, "CRITICAL").when(need, "ADVISORY").when(reach.isNotNull() & trip.isNotNull(), "SAFE").otherwise("UNAVAILABLE")
    return {"need": need, "reason": reason, "warning": warning, "energy_kwh": energy, "range_km": reach, "trip_km": trip, "reserve_km": reserve}


def allowed_services(charging: Column, swapping: Column) -> Column:
    return F.array_compact(F.array(F.when(charging, "CHARGING"), F.when(swapping, "SWAP")))


def resolved_service(charging: Column, swapping: Column) -> Column:
    return F.when(charging & ~swapping, "CHARGING").when(swapping & ~charging, "SWAP")


def requested_services(source: Column, need: Column, requested: Column, allowed: Column) -> Column:
    """What a request is expanded to: automatic ones by need, a driver's as asked; always within what is allowed."""
    auto = F.when(~need, F.array().cast("array<string>")).when(F.array_contains(allowed, "SWAP"), F.array(F.lit("CHARGING"), F.lit("SWAP"))).otherwise(F.array(F.lit("CHARGING")))
    asked = F.when(requested == "ANY", allowed).otherwise(F.array(requested))
    return F.array_intersect(F.when(source == "AUTO", auto).otherwise(asked), allowed)


def capacity_of(service: Column, charging_slots: Column, swap_slots: Column, batteries: Column) -> Column:
    return F.when(service == "SWAP", F.least(swap_slots, batteries)).otherwise(charging_slots)


def feasible(distance_km: Column, range_km: Column, margin_km: float = 0.5) -> Column:
    return F.coalesce((range_km > 0) & (range_km != float("inf")) & (distance_km + margin_km <= range_km), F.lit(False))


def eligibility(reachable: Column, compatible: Column, status: Column, service: Column, swap_slots: Column, batteries: Column, capacity: Column, wait_min: Column, in_range: Column, longest_wait: float = 90.0) -> Column:
    """The first of eight reasons that holds."""
    return (
        F.when(~reachable, "UNREACHABLE").when(~compatible, "INCOMPATIBLE").when(F.coalesce(status != "OPEN", F.lit(True)), "OFFLINE")
        .when((service == "SWAP") & (swap_slots > 0) & (batteries <= 0), "NO_SWAP_BATTERY").when(capacity <= 0, "FULL")
        .when(wait_min.isNotNull() & (wait_min > longest_wait), "EXCESSIVE_QUEUE").when(~in_range, "INSUFFICIENT_SOC_TO_REACH").otherwise("ELIGIBLE")
    )


def replenishment(service: Column, energy: Column, capacity: Column, per_km: Column, there_km: Column, onward_km: Column, reserve_km: Column, swap_min: Column, power_kw: Column) -> dict[str, Column]:
    """status, arrival, target, added (kWh), duration_s. Charging is fast up to 80 % and half as fast above."""
    arrival = energy - there_km * per_km
    required = F.when(onward_km.isNotNull(), (onward_km + reserve_km) * per_km).otherwise(capacity * 0.8)
    target = F.when(service == "SWAP", capacity * 0.9).otherwise(F.greatest(arrival, required))
    bad = energy.isNull() | capacity.isNull() | per_km.isNull() | there_km.isNull() | (capacity <= 0) | (per_km <= 0)
    never = (arrival < -1e-9) | (required > capacity + 1e-9) | ((service == "SWAP") & onward_km.isNotNull() & (target < required - 1e-9))
    added = F.greatest(F.lit(0.0), F.least(capacity, target) - arrival)
    knee = capacity * 0.8
    fast = F.greatest(F.lit(0.0), F.least(target, knee) - F.least(arrival, knee))
    charge = F.when(added == 0, 0.0).otherwise(60.0 + 3600.0 * (fast + (added - fast) / 0.5) / (power_kw * 0.9))
    ok = F.coalesce(~bad & ~never, F.lit(False))
    status = F.when(F.coalesce(bad, F.lit(True)), "UNAVAILABLE").when(never, "INFEASIBLE").otherwise("AVAILABLE")
    duration = F.when(service == "SWAP", swap_min * 60.0).otherwise(charge)
    return {"status": status, "arrival": F.when(ok, arrival), "target": F.when(ok, target), "added": F.when(ok, added), "duration_s": F.when(ok, duration)}


def power_kw(speed: Column, accel: Column, slope: Column, mass: Column, drag: float = 0.3, area: float = 2.2, roll: float = 0.01, drive: float = 0.9, regen: float = 0.6, most_kw: float = 100.0, aux_kw: float = 0.5) -> Column:
    """Longitudinal power at the battery: drag, rolling, inertia and slope; recovery is limited to half the most power."""
    angle = F.atan(slope)
    force = 0.5 * AIR * drag * area * speed * speed + roll * mass * GRAVITY * F.cos(angle) + mass * accel + mass * GRAVITY * F.sin(angle)
    wheel = force * speed / 1000.0
    return F.when(wheel >= 0, wheel / max(0.01, drive)).otherwise(F.greatest(wheel * regen, F.lit(-0.5 * most_kw))) + aux_kw


def expected_queue_wait(queue: Column, service_min: Column, active: Column) -> Column:
    return F.try_divide(queue * service_min, active)




def reserve(trip_km: Column, given_km: Column) -> Column:
    """The given reserve, else 15 % of the trip and at least 1 km; null for an unknown trip."""
    return F.coalesce(given_km, F.when(trip_km.isNotNull(), F.greatest(F.lit(1.0), trip_km * 0.15)))


def effective_consumption(wh_per_km: Column, car: Column) -> Column:
    return F.coalesce(wh_per_km, F.when(car, 150.0).otherwise(45.0)).cast("double")


def soc_after(soc: Column, used_kwh: Column, capacity: Column) -> Column:
    """Charge in percent after using (or, below zero, gaining) energy, within 0 to 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), soc - F.try_divide(used_kwh * 100.0, capacity)))


def installed_capacity(modules: Column, module_kwh: Column, listed_kwh: Column) -> Column:
    """Whole numbers of modules decide; anything else leaves the listed capacity."""
    return F.when((modules > 0) & (modules == F.floor(modules)), modules * module_kwh).otherwise(listed_kwh).cast("double")


def can_charge(capable: Column, slots: Column, plug: Column, plugs: Column) -> Column:
    return F.coalesce(capable & (slots > 0) & F.array_contains(plugs, plug), F.lit(False))


def can_swap(capable: Column, slots: Column, family: Column, families: Column) -> Column:
    return F.coalesce(capable & (slots > 0) & F.array_contains(families, family), F.lit(False))


def refreshed_duration(service: Column, estimated_s: Column, swap_min: Column) -> Column:
    """Newer state changes how long a swap takes; charging keeps its estimate."""
    return F.when(service == "SWAP", swap_min * 60.0).otherwise(estimated_s)


def step_energy(v0: Column, v1: Column, seconds: Column, mass: Column) -> tuple[Column, Column]:
    """(kW at mid-speed, kWh) of a step of at most an hour on level ground; longer steps have none."""
    kw = F.when((seconds > 0) & (seconds <= 3600), power_kw((v0 + v1) / 2, (v1 - v0) / seconds, F.lit(0.0), mass))
    return kw, kw * seconds / 3600.0


def delay_consistent(delay: Column, free_kmh: Column, kmh: Column, tolerance: float) -> Column:
    """Whether a delay factor is free speed over speed, up to rounding."""
    return F.coalesce(F.abs(delay - F.try_divide(free_kmh, kmh)) <= tolerance, F.lit(False))
