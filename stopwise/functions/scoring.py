"""Scores of transfers and journeys, and sizes of map markers, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stopwise.functions.timecols import clock_minutes

# fixed values: busiest station's trains per day, largest marker, minutes to change trains
BUSIEST_PER_DAY = 2000
LARGEST_MARKER = 70
CHANGE_MINUTES = 2
# fixed values: yearly share of regional trains at most 0, 5, 10, 15 minutes late
REGIONAL_PUNCTUALITY = {0: 0.95, 5: 0.95, 10: 0.97, 15: 0.99}


def marker_size_per_day(stops: Column, days: Column) -> Column:
    return stops / days / BUSIEST_PER_DAY * LARGEST_MARKER


def marker_size_relative(stops: Column, largest: Column) -> Column:
    return stops / largest * LARGEST_MARKER


def planned_transfer(arrival: Column, departure: Column) -> Column:
    """Minutes between two ``HH:mm`` times, over midnight if need be."""
    return F.pmod(clock_minutes(departure) - clock_minutes(arrival), F.lit(1440))


def transfer_doable(planned: Column, ar_delay: Column, dp_delay: Column, minimum: int = 3) -> Column:
    return (planned + dp_delay - ar_delay) > minimum


def connection_score(ar: Column, dp: Column, transfer: Column, change: int = CHANGE_MINUTES) -> Column:
    """Chance that a transfer works.

    ``ar[m]`` is the chance of arriving at most m minutes late and ``dp[m]`` that
    the departure is at least m minutes late; both have the same length n.
    Either the train arrives in time for any departure, or it arrives one minute
    later and the departure is late enough too, and so on. Transfers of n minutes
    or more, and negative ones, count as safe.
    """
    n = F.size(ar)
    a0 = F.greatest(transfer - change, F.lit(0)).cast("int")
    d0 = F.greatest(change - transfer, F.lit(0)).cast("int")
    steps = F.greatest(n - 1 - F.greatest(a0, d0), F.lit(0))
    extra = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), lambda k: k < steps), F.lit(0.0),
        lambda total, k: total + (F.get(ar, a0 + 1 + k) - F.get(ar, a0 + k)) * F.get(dp, d0 + 1 + k))
    score = F.get(ar, a0) * F.get(dp, d0) + extra
    return F.when(transfer.between(0, n - 1), F.least(score, F.lit(1.0))).otherwise(F.lit(1.0))


def percent(score: Column) -> Column:
    """Half-even rounding to a whole percentage."""
    return F.bround(score * 100, 0).cast("int")


def journey_score(scores: Column) -> Column:
    """Product of the transfer scores in percent; a journey without transfers has 100."""
    return percent(F.aggregate(scores, F.lit(1.0), lambda product, s: product * s))


def banded_score(transfer: Column, ar_over: dict[int, Column], dp_over: dict[int, Column]) -> Column:
    """Score by bands of the transfer time.

    ``ar_over[m]`` / ``dp_over[m]`` are the chances of a delay above m minutes
    (5, 10, 15). Missing chances are replaced by the regional yearly mean.
    """
    fill = lambda over: {m: F.coalesce(over[m], F.lit(1 - REGIONAL_PUNCTUALITY[m])) for m in (5, 10, 15)}
    ar, dp = fill(ar_over), fill(dp_over)
    between_5_10, between_10_15 = ar[5] - ar[10], ar[10] - ar[15]
    miss_short = between_5_10 * (1 - dp[5]) + between_10_15 * (1 - dp[10]) + ar[15] * (1 - dp[15])
    miss_medium = between_10_15 * (1 - dp[5]) + ar[15] * (1 - dp[10])
    miss_long = ar[15] * (1 - dp[5])
    return (F.when(transfer > 17, F.lit(1.0)).when(transfer > 12, 1 - miss_long)
            .when(transfer > 7, 1 - miss_medium).otherwise(1 - miss_short))
