"""From planned and changed times to one clean row per stop event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stopwise.functions import textcols, timecols

OBSTACLE_COLUMNS = [f"obstacles_priority_{p}" for p in (24, 37, 63, 65, 70, 80)]
ENDS = ("ar", "dp")


def is_cancelled(status: Column) -> Column:
    return status.eqNullSafe("c")


def add_delays(stops: DataFrame, clamp: str = "unless_on_time") -> DataFrame:
    """Delays in minutes and the flags ``happened`` and ``cancelled`` for both ends.

    ``clamp='unless_on_time'`` sets both delays to 0 wherever ``dp_delay >= -1``
    is not true, also for a missing departure. ``clamp='only_early'`` does so
    for known departures more than a minute early only.
    """
    raw = {e: timecols.minutes_between(F.col(f"{e}_ct"), F.col(f"{e}_pt")) for e in ENDS}
    if clamp == "unless_on_time":
        keep = F.coalesce(raw["dp"] >= -1, F.lit(False))
    elif clamp == "only_early":
        keep = F.coalesce(raw["dp"] >= -1, F.lit(True))
    else:
        raise ValueError(f"unknown clamp {clamp}")
    columns: dict[str, Column] = {}
    for end in ENDS:
        cancelled = is_cancelled(F.col(f"{end}_cs"))
        columns[f"{end}_happened"] = ~cancelled & raw[end].isNotNull()
        columns[f"{end}_cancelled"] = cancelled
        columns[f"{end}_delay"] = F.when(keep, raw[end]).otherwise(F.lit(0)).cast("int")
    return stops.withColumns(columns)


def coalesce_platform(stops: DataFrame) -> DataFrame:
    return stops.withColumn("pp", F.coalesce("ar_pp", "dp_pp"))


def with_delays(stops: DataFrame, clamp: str = "unless_on_time") -> DataFrame:
    return add_delays(coalesce_platform(stops), clamp)


def planned_time(prefer: str = "ar") -> Column:
    """Planned arrival, or departure where the train starts."""
    return F.coalesce("ar_pt", "dp_pt") if prefer == "ar" else F.coalesce("dp_pt", "ar_pt")


def time_features(stops: DataFrame) -> DataFrame:
    when = planned_time()
    return stops.withColumns({
        "minute": timecols.minute_of_day(when),
        "day": timecols.weekday_from_monday(when),
        "stay_time": timecols.stay_minutes(F.col("ar_pt"), F.col("dp_pt")),
    })


def calendar_features(stops: DataFrame) -> DataFrame:
    when = planned_time()
    return stops.withColumns({
        "month": F.month(when), "dayofweek": timecols.weekday_from_monday(when), "hour": F.hour(when)})


def fill_obstacles(stops: DataFrame) -> DataFrame:
    return stops.fillna(0.0, subset=OBSTACLE_COLUMNS)


def status_flags(stops: DataFrame, limit: int = 5) -> DataFrame:
    """``on_time`` stays null where the delay is null."""
    return stops.withColumns({
        **{f"{e}_on_time": F.col(f"{e}_delay") <= limit for e in ENDS},
        **{f"{e}_is_cancelled": is_cancelled(F.col(f"{e}_cs")) for e in ENDS}})


def threshold_flags(stops: DataFrame, limits: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """``delay <= first limit`` and ``delay > limit`` per limit, for both ends."""
    columns = {}
    for end in ENDS:
        delay = F.col(f"{end}_delay")
        columns[f"{end}_within_{limits[0]}"] = delay <= limits[0]
        for limit in limits:
            columns[f"{end}_over_{limit}"] = delay > limit
    return stops.withColumns(columns)


# --- raw plan and change records -----------------------------------------------------

LINE_FIELDS = "f string, t string, o string, c string, n string"
PLAN_FIELDS = "pt string, pp string, ps string, ppth string, hi string, pde string, dc string, l string"
MESSAGE_FIELDS = "id string, t string, c string, ts string"
CHANGE_FIELDS = f"ct string, clt string, cpth string, cs string, cp string, m array<struct<{MESSAGE_FIELDS}>>"


def _struct(fields: str) -> str:
    return f"struct<{fields}>"


PLAN_SCHEMA = (f"id string, station string, tl array<{_struct(LINE_FIELDS)}>, "
               f"ar array<{_struct(PLAN_FIELDS)}>, dp array<{_struct(PLAN_FIELDS)}>")
CHANGE_SCHEMA = (f"id string, ar array<{_struct(CHANGE_FIELDS)}>, dp array<{_struct(CHANGE_FIELDS)}>, "
                 f"m array<{_struct(MESSAGE_FIELDS)}>")


def is_one(flag: Column) -> Column:
    """The feeds mark a true flag with the text 1."""
    return F.coalesce(flag == "1", F.lit(False))


def flatten_plan(plan: DataFrame, stop: str = "stop") -> DataFrame:
    """``hash_id`` and a nested stop to one flat row; missing parts give defaults."""
    ids = textcols.split_stop_id(F.col(f"{stop}.id"))
    line = F.get(F.col(f"{stop}.tl"), F.lit(0))
    columns = [F.col("hash_id"), ids["dayly_id"].alias("dayly_id"),
               timecols.parse_compact_ts(ids["date_text"]).alias("date_id"),
               ids["stop_id"].alias("stop_id"), F.col(f"{stop}.station").alias("station")]
    columns += [line[name].alias(name) for name in ("f", "t", "o", "c", "n")]
    for end in ENDS:
        event = F.get(F.col(f"{stop}.{end}"), F.lit(0))
        columns += [
            timecols.parse_compact_ts(event["pt"]).alias(f"{end}_pt"),
            textcols.parse_path(event["ppth"]).alias(f"{end}_ppth"),
            event["pp"].alias(f"{end}_pp"), event["ps"].alias(f"{end}_ps"),
            is_one(event["hi"]).alias(f"{end}_hi"), event["pde"].alias(f"{end}_pde"),
            is_one(event["dc"]).alias(f"{end}_dc"), event["l"].alias(f"{end}_l")]
    return plan.select(*columns)


def apply_change(flat: DataFrame, change: str = "change") -> DataFrame:
    """Changed time and path win over the plan; a column ``change`` may be null as a whole."""
    columns = {}
    for end in ENDS:
        event = F.get(F.col(f"{change}.{end}"), F.lit(0))
        columns[f"{end}_ct"] = F.coalesce(timecols.parse_compact_ts(event["ct"]), F.col(f"{end}_pt"))
        columns[f"{end}_clt"] = timecols.parse_compact_ts(event["clt"])
        columns[f"{end}_cpth"] = F.coalesce(textcols.parse_path(event["cpth"]), F.col(f"{end}_ppth"))
        columns[f"{end}_cs"] = F.coalesce(event["cs"], F.col(f"{end}_ps"))
        columns[f"{end}_cp"] = F.coalesce(event["cp"], F.col(f"{end}_pp"))
    return flat.withColumns(columns)


def join_changes(plan: DataFrame, change: DataFrame) -> DataFrame:
    """Every planned stop with its change, if any."""
    return plan.join(change.select("hash_id", "change"), "hash_id", "left")


def parse_stops(plan: DataFrame, change: DataFrame) -> DataFrame:
    """Raw records (JSON text in ``stop`` / ``change``) to flat stop events."""
    plans = plan.select("hash_id", F.from_json("stop", PLAN_SCHEMA).alias("stop"))
    changes = change.select("hash_id", F.from_json("change", CHANGE_SCHEMA).alias("change"))
    flat = flatten_plan(plans)
    return apply_change(join_changes(flat, changes)).drop("change")


def flatten_messages(changes: DataFrame) -> DataFrame:
    """Messages at arrival, departure and stop level as parallel arrays."""
    columns = [F.col("hash_id")]
    sources = {"ar": F.get(F.col("change.ar"), F.lit(0))["m"], "dp": F.get(F.col("change.dp"), F.lit(0))["m"],
               "stop": F.col("change.m")}
    for level, messages in sources.items():
        columns += [
            F.transform(messages, lambda m: m["id"]).alias(f"{level}_m_id"),
            F.transform(messages, lambda m: m["t"]).alias(f"{level}_m_t"),
            F.transform(messages, lambda m: timecols.parse_compact_ts(m["ts"])).alias(f"{level}_m_ts"),
            F.transform(messages, lambda m: m["c"].cast("int")).alias(f"{level}_m_c")]
    return changes.select(*columns)


def messages_long(changes: DataFrame) -> DataFrame:
    """One row per message with the level it was sent at."""
    level = lambda name, messages: F.transform(messages, lambda m: F.struct(F.lit(name).alias("level"), m.alias("m")))
    nothing = F.array().cast(f"array<struct<level:string,m:struct<id:string,t:string,c:string,ts:string>>>")
    parts = [F.coalesce(level(n, m), nothing) for n, m in (
        ("ar", F.get(F.col("change.ar"), F.lit(0))["m"]), ("dp", F.get(F.col("change.dp"), F.lit(0))["m"]),
        ("stop", F.col("change.m")))]
    rows = changes.select("hash_id", F.explode(F.concat(*parts)).alias("e"))
    return rows.select("hash_id", "e.level", F.col("e.m.id").alias("id"), F.col("e.m.t").alias("t"),
                       F.col("e.m.c").cast("int").alias("c"), timecols.parse_compact_ts(F.col("e.m.ts")).alias("ts"))
