"""Date and time functions; whatever depends on the present takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days until the next action, by status; the hours at which a window starts and their zone; the longest delay.
NEXT_ACTION_DAYS = {"applied": 7, "followed_up": 10}
WINDOW_HOURS = (7, 12, 17, 22)
MAX_DELAY_MINUTES = 1440
ZONE = "Europe/Paris"


def parse_time(value: Column) -> Column:
    """ISO, milliseconds or mail dates; null for anything else."""
    text = F.nullif(F.trim(value), F.lit(""))
    mail = F.regexp_replace(text, r"^[A-Za-z]{3}, ", "")
    return F.coalesce(
        F.when(text.rlike(r"^\d{12,14}$"), F.timestamp_millis(F.when(text.rlike(r"^\d{12,14}$"), text).try_cast("long"))),
        F.try_to_timestamp(F.regexp_replace(text, " UTC$", "Z")),
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")),
    )


def next_action(status: Column, day: Column) -> Column:
    days = F.coalesce(*[F.when(status == s, F.lit(n)) for s, n in NEXT_ACTION_DAYS.items()])
    return F.date_add(day, days)


def days_before(as_of: Column, n: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(n))


def last_window(moment: Column, zone: str = ZONE) -> Column:
    """The latest window start at or before the moment, as local time in ``zone``."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), moment.cast("timestamp_ntz"))
    day, hour = F.date_trunc("day", local), F.hour(local)
    start = F.make_dt_interval(F.lit(-1), F.lit(WINDOW_HOURS[-1]))
    for h in WINDOW_HOURS:
        start = F.when(hour >= h, F.make_dt_interval(F.lit(0), F.lit(h))).otherwise(start)
    return (day + start).cast("timestamp_ntz")


def worker_stale(last_tick: Column, as_of: Column, zone: str = ZONE) -> Column:
    """No tick since a window that began more than half an hour ago; a worker without tick is stale."""
    window = last_window(as_of, zone)
    local = lambda x: F.convert_timezone(F.lit("UTC"), F.lit(zone), x.cast("timestamp_ntz"))
    late = local(as_of) - window > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))
    return F.coalesce(late & (local(last_tick) < window), F.lit(True))


def overdue(day: Column, today: Column) -> Column:
    return day <= today


def source_backoff(interval_minutes: Column, failures: Column) -> Column:
    return F.least(interval_minutes * F.pow(F.lit(2.0), failures), F.lit(float(MAX_DELAY_MINUTES)))


def http_backoff_ms(attempt: Column) -> Column:
    """Before jitter of up to a quarter."""
    return 1000 * F.pow(F.lit(4.0), attempt)


def _spoken(minutes: Column) -> Column:
    """Minutes, hours below two days, or days, each rounded."""
    hours = F.round(minutes / 60).cast("long")
    days = F.round(hours / 24).cast("long")
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return F.when(minutes < 60, say(minutes, "min")).when(hours < 48, say(hours, "h")).otherwise(say(days, "j"))


def _minutes(later: Column, earlier: Column) -> Column:
    return F.round((F.unix_micros(later) - F.unix_micros(earlier)) / 60_000_000).cast("long")


def ago(moment: Column, as_of: Column) -> Column:
    minutes = _minutes(as_of, moment)
    return F.when(moment.isNull(), "jamais").when(minutes < 1, "à l'instant").otherwise(F.concat(F.lit("il y a "), _spoken(minutes)))


def until(moment: Column, as_of: Column) -> Column:
    """Time left, or for how long it has been due."""
    minutes, late = _minutes(moment, as_of), _minutes(as_of, moment)
    due = F.when(late < 1, "maintenant").otherwise(F.concat(F.lit("dû depuis "), _spoken(late)))
    return F.when(moment.isNull(), "—").when(moment <= as_of, due).otherwise(F.concat(F.lit("dans "), _spoken(minutes)))


def api_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def midpoint(a: Column, b: Column) -> Column:
    return F.timestamp_micros(F.floor((F.unix_micros(a) + F.unix_micros(b)) / 2))
