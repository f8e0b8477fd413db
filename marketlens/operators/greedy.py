"""Greedy admission over a whole history, without holding a user's events together.

An event is admitted when the last admitted one of its user is more than the span before it. So the event
that would follow an admitted one is known for each event alone: the first one later than its time plus
the span. These jumps are found in cells of time (a small part of the span), so a user with most of all
events is spread over cells; the admitted events are what the jumps reach from the user's first event.
They are followed by doubling: n rounds of joins on single events reach 2**n of them, and no
more are in the whole range of time than its length divided by the span.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.frames import kept

CELLS = 64  # cells of a span
NODE = ["u", "t", "i"]


def seconds(ts):
    """A timestamp in whole seconds, the nearest (half to even), as the rule counts them; flooring would move half of all times."""
    return F.rint(F.unix_micros(ts) / F.lit(1e6)).cast("long")


def jumps(events, span):
    """u, t, i of each event and nt, ni of the first event of the user after t + span; null where there is none."""
    width = max(1, span // CELLS)
    cell = lambda t: F.floor(t / width)
    own = events.select(*NODE, cell(F.col("t")).alias("c"), F.lit(0).alias("ask"))
    asked = events.select("u", (F.col("t") + span).alias("t"), "i", cell(F.col("t") + span).alias("c"), F.lit(1).alias("ask"))
    # within a cell: from late to early, questions before events of the same time, so an event is strictly later
    inside = Window.partitionBy("u", "c").orderBy(F.desc("t"), F.desc("ask"), F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    event = F.when(F.col("ask") == 0, F.struct("t", "i"))
    found = own.unionByName(asked).withColumn("next", F.last(event, ignorenulls=True).over(inside)).where("ask = 1")
    # beyond the cell: the first event of the next cell that has any; one row a cell
    first = own.groupBy("u", "c").agg(F.min(F.struct("t", "i")).alias("first"))
    cells = first.unionByName(asked.select("u", "c").distinct(), allowMissingColumns=True).groupBy("u", "c").agg(F.first("first", ignorenulls=True).alias("first"))
    later = Window.partitionBy("u").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("u", "c", F.last("first", ignorenulls=True).over(later).alias("beyond"))
    found = found.join(cells, ["u", "c"]).withColumn("next", F.coalesce("next", "beyond"))
    return found.select("u", (F.col("t") - span).alias("t"), "i", F.col("next.t").alias("nt"), F.col("next.i").alias("ni"))


def admitted(events, days=7):
    """user_id and event_id of admitted events (user_id, ts, event_id), ties in order of ids.

    Null users are one user; events without time or id are never admitted; repeated rows count once.
    """
    span = days * 86400
    nobody = F.lit(-(2**63)).cast("long")
    rows = events.select(F.coalesce(F.col("user_id").cast("long"), nobody).alias("u"), seconds(F.col("ts")).alias("t"), F.col("event_id").cast("long").alias("i"))
    rows = kept(rows.where("t is not null and i is not null").distinct())
    heads = rows.groupBy("u").agg(F.min(F.struct("t", "i")).alias("x")).select("u", "x.t", "x.i")
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    most = (ends["b"] - ends["a"]) // max(span, 1) + 2 if ends["a"] is not None else 0  # events of a user that can be admitted
    all_jumps = jumps(rows, span).where("nt is not null")
    # only first events and those that some jump leads to can be reached
    nodes = heads.unionByName(all_jumps.select("u", F.col("nt").alias("t"), F.col("ni").alias("i"))).distinct()
    jump = kept(all_jumps.join(nodes, NODE, "left_semi"))
    reached, done = kept(heads), 1
    while done < most:
        step = reached.join(jump, NODE).select("u", F.col("nt").alias("t"), F.col("ni").alias("i"))
        reached, done = kept(reached.unionByName(step)), 2 * done
        if done < most:
            on = jump.select("u", F.col("t").alias("nt"), F.col("i").alias("ni"), F.col("nt").alias("mt"), F.col("ni").alias("mi"))
            jump = kept(jump.join(on, ["u", "nt", "ni"]).select(*NODE, F.col("mt").alias("nt"), F.col("mi").alias("ni")))
    return reached.select(F.nullif("u", nobody).alias("user_id"), F.col("i").alias("event_id"))
