"""Folds over change logs: what row triggers would have kept up to date.

Each works on an ordered log of changes. Histories are cut into segments (see
``ordered``), so one key may own any share of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewarden.operators.ordered import SEGMENT, with_segments
from tablewarden.runtime import cut_lineage

COMPLETED, PENDING, PURCHASE = "completed", "pending", "purchase"


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def fold_credits(
    changes: DataFrame, key: str, order: list[str], status: str, amount: str, user: str,
    done: str = COMPLETED, previous: DataFrame | None = None, segments: int | None = None,
) -> DataFrame:
    """Credits per user: an amount counts whenever its key changes into ``done``.

    ``order`` must tell the changes of a key apart; its first column cuts the
    history. ``previous`` holds ``(key, status)`` from before the log. A NULL
    amount counts as 0.
    """
    here = Window.partitionBy("__key", SEGMENT).orderBy(*_cols(order))
    is_done, opens, closes = F.col("__done"), F.col("__n") == 1, F.col("__next").isNull()
    rows = with_segments(changes, order[:2], segments).select(
        F.col(f"`{key}`").alias("__key"), F.col(f"`{user}`").alias("__user"), SEGMENT, *_cols(order),
        F.coalesce(F.col(f"`{status}`") == done, F.lit(False)).alias("__done"),
        F.coalesce(F.col(f"`{amount}`"), F.lit(0)).alias("__amount"),
    ).withColumns({
        "__before": F.lag("__done").over(here),
        "__n": F.row_number().over(here),
        "__next": F.lead(F.lit(1)).over(here),
    })
    # the grouping contains the partitioning of the window: no further shuffle
    parts = rows.groupBy("__key", SEGMENT, "__user").agg(
        F.sum(F.when(is_done & ~F.col("__before"), F.col("__amount"))).alias("__inside"),
        F.max(F.when(opens, F.struct(is_done.alias("done"), "__amount"))).alias("__opens"),
        F.max(F.when(closes, F.struct(SEGMENT, is_done.alias("done")))).alias("__closes"),
    )
    # looked at twice, and small: the log is only read once
    parts = cut_lineage(parts)
    # one row per segment of a key, however many users it has had
    ends = parts.groupBy("__key", SEGMENT).agg(F.max("__closes").alias("__closes"))
    earlier = Window.partitionBy("__key").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        F.col("__key").alias("__of"), F.col(SEGMENT).alias("__at"), F.max("__closes").over(earlier).alias("__from")
    )
    here = F.col("__key").eqNullSafe(F.col("__of")) & (F.col(SEGMENT) == F.col("__at"))
    settled = parts.join(ends, here).select("__key", "__user", "__inside", "__opens", "__from")
    was_done = F.col("__from.done")
    if previous is not None:
        known = previous.select(F.col(f"`{key}`").alias("__key"), (F.col(f"`{status}`") == done).alias("__known"))
        known = known.withColumnRenamed("__key", "__of")
        settled = settled.join(known, F.col("__key").eqNullSafe(F.col("__of")), "left")
        was_done = F.coalesce(was_done, F.col("__known"))
    at_border = F.col("__opens.done") & ~F.coalesce(was_done, F.lit(False))
    gained = F.coalesce("__inside", F.lit(0)) + F.coalesce(F.when(at_border, F.col("__opens.__amount")), F.lit(0))
    touched = F.col("__inside").isNotNull() | at_border
    return (
        settled.where(F.coalesce(touched, F.lit(False)))
        .groupBy(F.col("__user").alias(user)).agg(F.sum(gained).alias("credits"))
    )


def last_status(changes: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The newest status of every key, reduced map-side."""
    newest = F.max_by(F.col(f"`{status}`"), F.struct(*_cols(order)))
    return changes.groupBy(F.col(f"`{key}`")).agg(newest.alias(status))


def fold_referrals(
    referrals: DataFrame, changes: DataFrame, *, referred: str = "referred_id", created: str = "created_at",
    user: str = "user_id", at: str = "transaction_at", change_id: str = "id", status: str = "status",
    kind: str = "type", credits: str = "credits", segments: int | None = None,
) -> DataFrame:
    """Close pending referrals by the first completed purchase with credits.

    A purchase counts from the creation of the referral on. The referral gets
    ``status``, ``bonus_awarded``, ``date_activated`` and ``first_purchase_id``;
    referrals that are not pending, or were awarded, stay as they are.

    Referrals and purchases of a user are put in one time line and each referral
    looks ahead in it, so no pair of them is ever formed.
    """
    waiting = (F.col("status") == PENDING) & ~F.coalesce(F.col("bonus_awarded"), F.lit(False))
    is_open = F.coalesce(waiting, F.lit(False))
    buys = changes.where((F.col(status) == COMPLETED) & (F.col(kind) == PURCHASE) & (F.col(credits) > 0))
    line = (
        referrals.where(is_open).select(
            F.col(referred).alias("__user"), F.col(created).alias("__at"), F.struct("*").alias("__referral")
        )
        .unionByName(
            buys.select(
                F.col(user).alias("__user"), F.col(at).alias("__at"),
                F.struct(F.col(at).alias("at"), F.col(change_id).alias("id")).alias("__buy"),
            ),
            allowMissingColumns=True,
        )
    )
    # of purchases at one moment the smaller numbers come first, and referrals before any of them
    cut = with_segments(line.withColumn("__tie", F.col("__buy.id")), ["__at", "__tie"], segments)
    # backwards in time; a purchase at the moment of creation still counts
    here = Window.partitionBy("__user", SEGMENT).orderBy(
        F.desc("__at"), F.col("__buy").isNull(), F.desc("__buy.id")
    )
    ahead = F.last("__buy", ignorenulls=True).over(here)
    looked = cut.withColumn("__ahead", ahead).where(F.col("__referral").isNotNull())
    first_buy = cut.groupBy("__user", SEGMENT).agg(F.min("__buy").alias("__first"))
    later = Window.partitionBy("__user").orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    beyond = first_buy.select("__user", SEGMENT, F.min("__first").over(later).alias("__beyond"))
    buy = F.coalesce("__ahead", "__beyond")
    met = looked.join(beyond, ["__user", SEGMENT], "left").select("__referral.*", buy.alias("__buy"))
    closed = met.withColumns({
        "status": F.when(F.col("__buy").isNotNull(), COMPLETED).otherwise(F.col("status")),
        "bonus_awarded": F.when(F.col("__buy").isNotNull(), True).otherwise(F.col("bonus_awarded")),
        "date_activated": F.col("__buy.at"),
        "first_purchase_id": F.col("__buy.id"),
    }).drop("__buy")
    return closed.unionByName(referrals.where(~is_open), allowMissingColumns=True)


def fold_views(
    changes: DataFrame, key: str, order: list[str], value: str, start: int = 0, segments: int | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """View counters: an update without a new value, or with the stored one, adds 1.

    Counters begin at ``start``, or at what ``previous``, ``(key, view_count)``, says. Any other value is stored. After an update with value c the counter is c or
    c + 1, so between two such updates only one bit is carried: with
    d = c - (previous c) - (updates without value in between), the bit is kept
    for d = 1, flipped for d = 0 and cleared otherwise. That makes a segment a
    handful of sums, whatever its length, and a key one small fold over them.
    """
    log = with_segments(changes, order[:2], segments)
    key = f"`{key}`"
    here = Window.partitionBy(key, SEGMENT).orderBy(*_cols(order))
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("__v")
    rows = log.select(F.col(key), SEGMENT, *[c for c in _cols(order)], F.col(f"`{value}`").cast("bigint").alias("__v"))
    rows = rows.withColumn("__plain", F.sum(F.when(v.isNull(), 1).otherwise(0)).over(so_far))
    rows = rows.withColumn(
        "__last", F.last(F.when(v.isNotNull(), F.struct("__v", "__plain")), ignorenulls=True).over(earlier)
    )
    d = v - F.col("__last.__v") - (F.col("__plain") - F.col("__last.__plain"))
    rows = rows.withColumn("__d", d).withColumn("__set", F.count(v).over(so_far))
    rows = rows.withColumn("__flips", F.count(F.when(F.col("__d") == 0, 1)).over(so_far))
    leads = v.isNotNull() & F.col("__last").isNull()
    clears = ~F.col("__d").isin(0, 1)
    parts = rows.groupBy(key, SEGMENT).agg(
        F.max("__plain").alias("plain"),
        F.max(F.when(leads, v)).alias("first"),
        F.max(F.when(leads, F.col("__plain"))).alias("plain_first"),
        F.max_by(v, F.when(v.isNotNull(), F.col("__set"))).alias("last"),
        F.max(F.when(v.isNotNull(), F.col("__plain"))).alias("plain_last"),
        F.coalesce(F.max(clears), F.lit(False)).alias("cleared"),
        (F.max("__flips") - F.coalesce(F.max(F.when(clears, F.col("__flips"))), F.lit(0))).alias("flips"),
    )

    def step(counter: Column, s: Column) -> Column:
        entered = F.when(counter + s["plain_first"] == s["first"], 1).otherwise(0)
        bit = (F.when(s["cleared"], 0).otherwise(entered) + s["flips"]) % 2
        return F.when(s["first"].isNull(), counter + s["plain"]).otherwise(
            s["last"] + bit + s["plain"] - s["plain_last"]
        )

    # at most one element per segment
    line = F.array_sort(F.collect_list(F.struct(
        SEGMENT, "plain", "first", "plain_first", "last", "plain_last", "cleared", "flips"
    )))
    lines = parts.groupBy(key).agg(line.alias("__line"))
    begin = F.lit(start).cast("bigint")
    if previous is not None:
        known = previous.select(F.col(key).alias("__of"), F.col("view_count").cast("bigint").alias("__begin"))
        lines = lines.join(known, F.col(key).eqNullSafe(F.col("__of")), "left")
        begin = F.coalesce("__begin", begin)
    return lines.select(key, F.aggregate("__line", begin, step).alias("view_count"))


def fold_updated_at(changes: DataFrame, key: str, at: str) -> DataFrame:
    """The time of the last change of every key."""
    return changes.groupBy(f"`{key}`").agg(F.max(f"`{at}`").alias("updated_at"))
