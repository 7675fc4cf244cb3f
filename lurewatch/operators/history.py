"""Sender history: who wrote when, as a table and as of each message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurewatch.operators.skew import prefix_before, salted_lookup


def build_history(log: DataFrame, key: str) -> DataFrame:
    """received, sent_to, first and last seen per address or domain. Partial sums run before the shuffle."""
    return log.where(F.col(key) != "").groupBy(key).agg(
        F.count_if(F.col("direction") == "received").alias("received"),
        F.count_if(F.col("direction") == "sent").alias("sent_to"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def histograms(log: DataFrame, key: str) -> DataFrame:
    """Counts of received mail per hour and per weekday (Monday 0). 31 sums per key, no collected lists."""
    got = log.where((F.col("direction") == "received") & (F.col(key) != ""))
    hours = [F.count_if(F.hour("ts") == h).alias(f"h{h}") for h in range(24)]
    days = [F.count_if(F.weekday("ts") == d).alias(f"d{d}") for d in range(7)]
    wide = got.groupBy(key).agg(*hours, *days)

    def as_map(prefix, n):
        pairs = F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"{prefix}{i}").alias("value")) for i in range(n)])
        return F.map_from_entries(F.filter(pairs, lambda p: p.value > 0))
    return wide.select(key, as_map("h", 24).alias("hours"), as_map("d", 7).alias("weekdays"))


def reply_rate() -> Column:
    return F.when(F.col("received") > 0, F.least(F.lit(1.0), F.col("sent_to") / F.col("received"))).otherwise(F.lit(0.0))


def dormant_days(as_of: Column) -> Column:
    """Silence before as_of, only when it dwarfs the sender's own rhythm: over max(120, 8 x the usual gap in days)."""
    def whole_days(a, b):
        return F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000)
    span = whole_days(F.col("first_seen"), F.col("last_seen"))
    gap = whole_days(F.col("last_seen"), as_of)
    usual = span / F.greatest(F.col("received") - 1, F.lit(1))
    return F.when((F.col("received") >= 3) & (span > 0) & (gap > F.greatest(F.lit(120.0), usual * 8)), gap)


def unusual_hour(hours: Column, hour: Column) -> Column:
    """At least eight received messages and none within an hour of this one. Midnight does not wrap around."""
    seen = F.map_keys(hours)
    total = F.aggregate(F.map_values(hours), F.lit(0).cast("bigint"), lambda a, n: a + n)
    near = F.exists(seen, lambda h: F.abs(h - hour) <= 1)
    return F.coalesce((total >= 8) & ~near, F.lit(False))


def signals(probe: DataFrame, addresses: DataFrame, domains: DataFrame, as_of: Column) -> DataFrame:
    """History signals for (address, domain, hour) probes: two left joins, absent parties count as unknown."""
    a = addresses.select("address", F.col("received").alias("a_received"), F.col("sent_to").alias("a_sent"),
                         F.col("first_seen").alias("a_first"))
    out = salted_lookup(salted_lookup(probe, a, "address"), domains, "domain")
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("a_received", "a_sent", "received", "sent_to")})
    first = F.coalesce("a_first", "first_seen")
    return out.withColumns({
        "sender_known": (F.col("a_received") + F.col("a_sent")) > 0,
        "domain_known": (F.col("received") + F.col("sent_to")) > 0,
        "first_contact": (F.col("received") + F.col("sent_to")) == 0,
        "ever_corresponded": F.col("sent_to") > 0,
        "reply_rate": F.round(reply_rate(), 3),
        "days_known": F.when(first.isNotNull(), F.greatest(F.lit(0), F.floor(
            (F.unix_micros(as_of) - F.unix_micros(first.cast("timestamp"))) / 86_400_000_000))),
        "dormant_days": dormant_days(as_of),
        "unusual_hour": unusual_hour(F.col("hours"), F.col("hour")),
    })


def history_asof(df: DataFrame, keys: list[str], ts: Column, received: Column, sent: Column, bucket: Column | None = None) -> DataFrame:
    """Counts, first and last sighting and the hours seen, over strictly earlier rows of the same keys.

    Hours travel as a 24-bit mask, so the running state stays five numbers per row.
    """
    micros = F.unix_micros(ts)
    mask = F.call_function("shiftleft", F.lit(1), F.hour(ts))
    out = prefix_before(df, keys, micros, bucket, {
        "hist_received": ("sum", received), "hist_sent": ("sum", sent), "hist_first": ("min", micros),
        "hist_last": ("max", micros), "hist_hours": ("bit_or", F.when(received > 0, mask).otherwise(F.lit(0)))})
    return out


REPLY_RATE = 0.05  # fixed value: answers per received message that make a correspondent


def message_history(df: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """History columns the floors read, as of each message, per mailbox and sending domain. `sent` holds the owners' own
    mail as (mailbox, registrable, sent_at); without it nobody counts as a correspondent.

    The running state is built from four narrow columns; the wide rows are shuffled once, by their unique id.
    """
    narrow = df.select("message_id", "sent_at", F.concat_ws("|", "mailbox", "registrable").alias("_k"))
    if sent is not None:
        narrow = narrow.unionByName(sent.select("sent_at", F.concat_ws("|", "mailbox", "registrable").alias("_k")), allowMissingColumns=True)
    got = F.col("message_id").isNotNull().cast("bigint")
    out = history_asof(narrow, ["_k"], F.col("sent_at"), got, F.lit(1).cast("bigint") - got, F.date_trunc("hour", F.col("sent_at"))).where("message_id IS NOT NULL")
    out = df.join(out.drop("_k", "sent_at"), "message_id")
    now, day = F.unix_micros("sent_at"), 86_400_000_000
    known = F.col("hist_received") > 0
    span = F.floor((F.col("hist_last") - F.col("hist_first")) / day)
    gap = F.floor((now - F.col("hist_last")) / day)
    usual = span / F.greatest(F.col("hist_received") - 1, F.lit(1))
    around = F.shiftright(F.call_function("shiftleft", F.lit(7), F.hour("sent_at")), 1)
    return out.withColumns({
        "first_contact": ~known,
        "corresponded": F.col("hist_sent") > 0,
        "established": known & ((F.col("hist_received") >= 5) | (F.col("hist_sent") >= REPLY_RATE * F.col("hist_received"))) & (F.floor((now - F.col("hist_first")) / day) >= 30),
        "dormant_days": F.when((F.col("hist_received") >= 3) & (span > 0) & (gap > F.greatest(F.lit(120.0), usual * 8)), gap),
        "unusual_hour": (F.col("hist_received") >= 8) & (F.col("hist_hours").bitwiseAND(around) == 0),
        "history_scanned": F.lit(True),
    })


def no_history(df: DataFrame) -> DataFrame:
    """Corpus work: these mailboxes are not ours, so history stays out."""
    false = F.lit(False)
    return df.withColumns({
        "hist_received": F.lit(0).cast("bigint"), "first_contact": false, "corresponded": false, "established": false,
        "dormant_days": F.lit(None).cast("bigint"), "unusual_hour": false, "history_scanned": false})
