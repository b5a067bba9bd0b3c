"""Usage counters by user and calendar period, and the limits that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Europe/Rome"


def _local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def periods(ts: Column, zone: str = ZONE) -> Column:
    """The two counter keys of an instant (UTC): day and month where the users are."""
    local = _local(ts, zone)
    return F.array(F.concat(F.lit("giorno#"), F.date_format(local, "yyyy-MM-dd")), F.concat(F.lit("mese#"), F.date_format(local, "yyyy-MM")))


def next_resets(ts: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """When both counters start again, as instants (UTC): the next local midnight and the first of the next local month."""
    local = _local(ts, zone)
    day = F.date_add(F.to_date(local), 1).cast("timestamp")
    month = F.add_months(F.trunc(local, "month"), 1).cast("timestamp")
    return F.to_utc_timestamp(day, zone), F.to_utc_timestamp(month, zone)


def counters(usage: DataFrame, zone: str = ZONE) -> DataFrame:
    """(user_id, period, requests, cost) of usage(user_id, ts, cost): each record counts for its day and for its month, in one pass."""
    rows = usage.select("user_id", "cost", F.explode(periods(F.col("ts"), zone)).alias("period"))
    return rows.groupBy("user_id", "period").agg(F.count("*").alias("requests"), F.round(F.sum("cost"), 2).alias("cost"))


def token_cost(tokens_in: Column, tokens_cached: Column, tokens_out: Column, prices: dict[str, float]) -> Column:
    """Cost of a request: tokens by kind times their price for a million."""
    return ((tokens_in - tokens_cached) * prices["in"] + tokens_cached * prices["cached"] + tokens_out * prices["out"]) / 1_000_000


def tiers(text: str | None) -> dict[str, tuple[int, float]]:
    """"name:requests:cost,..." → limits by tier; entries that do not read are left out."""
    out = {}
    for entry in (text or "").split(","):
        name, _, rest = entry.strip().partition(":")
        try:
            requests, cost = rest.split(":")
            out[name.strip().lower()] = int(requests), float(cost)
        except ValueError:
            continue
    return out


def limits(groups: str | list[str] | None, known: dict[str, tuple[int, float]], default: tuple[int, float]) -> tuple[int, float]:
    """The most generous limits of a user's groups; the default without a known group."""
    own = [known[g.lower()] for g in ([groups] if isinstance(groups, str) else groups or []) if g.lower() in known]
    return (max(r for r, _ in own), max(c for _, c in own)) if own else default
