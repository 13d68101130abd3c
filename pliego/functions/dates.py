"""Times: epoch milliseconds in, labels and deadlines out. The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
RETENTION_DAYS, FIRST_REMINDER, REPEAT, SNOOZE = 30, 7 * DAY, 30 * DAY, 7 * DAY
#: Spanish month names as the library's labels write them (fixed values).
SHORT_MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sept", "oct", "nov", "dic")
LONG_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def at(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def _month(ms: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.month(at(ms)))


def class_date(ms: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(at(ms)).cast("string"), _month(ms, SHORT_MONTHS))


def default_name(ms: Column) -> Column:
    return F.concat_ws(" ", F.lit("Escaneo"), class_date(ms), F.year(at(ms)).cast("string"), F.date_format(at(ms), "HH.mm"))


def day_stamp(ms: Column) -> Column:
    return F.date_format(at(ms), "dd/MM/yyyy")


def long_date(ms: Column) -> Column:
    return F.concat_ws(" de ", F.dayofmonth(at(ms)).cast("string"), _month(ms, LONG_MONTHS), F.year(at(ms)).cast("string"))


def short_date(ms: Column, now: Column) -> Column:
    today = F.concat(F.lit("Hoy, "), F.date_format(at(ms), "h:mm a"))
    return F.when(F.to_date(at(ms)) == F.to_date(at(now)), today).otherwise(F.concat_ws(" ", class_date(ms), F.year(at(ms)).cast("string")))


def days_left(trashed: Column, now: Column) -> Column:
    """Days until a trashed row goes for good."""
    return F.greatest(F.lit(0), F.ceil((trashed + RETENTION_DAYS * DAY - now) / DAY)).cast("long")


def days_left_label(days: Column) -> Column:
    return F.when(days <= 1, "mañana").otherwise(F.concat(F.lit("en "), days.cast("string"), F.lit(" días")))


def expired(trashed: Column, now: Column) -> Column:
    return trashed < now - RETENTION_DAYS * DAY


def reminder(documents: Column, created: Column, changed: Column, last: Column, snoozed: Column, now: Column) -> Column:
    """struct(never, days) if it is time for a backup, else null. created: the least time of a document; changed: the latest."""
    absent = lambda c: F.coalesce(c, F.lit(0)) == 0
    quiet = (documents == 0) | (~absent(snoozed) & (now - snoozed < SNOOZE))
    again = (changed > last) & (now - last >= REPEAT)
    told = lambda never, since: F.struct(F.lit(never).alias("never"), F.floor((now - since) / DAY).cast("long").alias("days"))
    return F.when(quiet, None).when(~absent(last), F.when(again, told(False, last))).when(now - created >= FIRST_REMINDER, told(True, created))


def backoff(failures: Column) -> Column:
    """Milliseconds to wait after so many failures."""
    return F.when(failures < 5, F.lit(0)).otherwise(F.least(30_000 * F.pow(F.lit(2.0), failures - 5), F.lit(900_000.0))).cast("long")


def dos_date(ms: Column) -> Column:
    t = at(ms)
    day = F.shiftleft(F.greatest(F.year(t) - 1980, F.lit(0)), 9).bitwiseOR(F.shiftleft(F.month(t), 5)).bitwiseOR(F.dayofmonth(t))
    time = F.shiftleft(F.hour(t), 11).bitwiseOR(F.shiftleft(F.minute(t), 5)).bitwiseOR(F.floor(F.second(t) / 2).cast("int"))
    return F.struct(day.alias("day"), time.alias("time"))


def pdf_date(ms: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(at(ms), "yyyyMMddHHmmss"))
