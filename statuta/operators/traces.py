"""Order of activities as observed: logs of events become sequences by case, cut into sessions where nothing happens for long.

No task holds all events of a case: the log is sorted into ranges by (case, time, event), so that a case with very many
events has several ranges, and what a range needs of those before it, the last event, how many sessions began and how many
events there were, comes from one row a case and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.functions import strings as S
from statuta.plans.lineage import cut

#: What stands before the first activity of a session.
START = "<start>"


def sessions(events: DataFrame, case: str, time: str, event: str, activity: str, gap_seconds: float) -> DataFrame:
    """(case, session, place, activity, time, event, before): each event's place in its session and the activity before it.

    Events of a case follow each other by (time, event), whenever they arrived: late rows fall where their time says. A
    session, counted from 1 by case, ends where the next event comes more than gap_seconds later. place counts from 1 within
    the session; before is START at place 1. Rows without a case or a time take no part; a null activity counts as ''.
    Rows equal in case, time and event keep apart in either order.
    """
    rows = events.where(F.col(case).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(case).alias("case"), F.col(time).alias("time"), F.col(event).alias("event"), F.coalesce(F.col(activity), F.lit("")).alias("activity"))
    # written, so that later steps see the same ranges
    dealt = cut(rows.repartitionByRange("case", "time", "event", "activity").withColumn("part", F.spark_partition_id()))
    by = ["time", "event", "activity"]
    last = Window.partitionBy("case").orderBy("part")
    ends = dealt.groupBy("case", "part").agg(F.max(F.struct(*by)).alias("end"), F.count(F.lit(1)).alias("n"))
    ends = ends.select("case", "part", F.lag("end").over(last).alias("end"), F.coalesce(F.sum("n").over(last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    here = Window.partitionBy("case", "part").orderBy(*by)
    told = dealt.join(ends, ["case", "part"])
    told = told.select("*", F.coalesce(F.lag(F.struct(*by)).over(here), F.col("end")).alias("was"), (F.row_number().over(here) + F.col("ahead")).alias("at"))
    opens = F.col("was").isNull() | (F.col("time") - F.col("was.time") > F.make_dt_interval(secs=F.lit(gap_seconds)))
    told = cut(told.select("case", "part", *by, "at", opens.alias("opens"), F.when(~opens, F.col("was.activity")).otherwise(START).alias("before")))
    begun = told.groupBy("case", "part").agg(F.count_if("opens").alias("n"), F.max(F.when(F.col("opens"), F.col("at"))).alias("opened"))
    begun = begun.select("case", "part", *(F.coalesce(f, F.lit(0)).alias(c) for f, c in ((F.sum("n").over(last.rowsBetween(Window.unboundedPreceding, -1)), "sessions"), (F.max("opened").over(last.rowsBetween(Window.unboundedPreceding, -1)), "opened"))))
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    out = told.join(begun, ["case", "part"])
    session = F.count_if("opens").over(so_far) + F.col("sessions")
    first = F.coalesce(F.max(F.when(F.col("opens"), F.col("at"))).over(so_far), F.col("opened"))
    return out.select("case", session.alias("session"), (F.col("at") - first + 1).alias("place"), "activity", "time", "event", "before")


def follows(log: DataFrame) -> DataFrame:
    """(one, two, n) of a sessions() table: how often activity two came directly after one, START being before the first."""
    return log.groupBy(F.col("before").alias("one"), F.col("activity").alias("two")).agg(F.count(F.lit(1)).alias("n"))


def order_words(text: Column) -> Column:
    """(one, two) of a text "... one before two ...": the words around the first "before" with a word on both sides, else null."""
    words = F.filter(F.split(F.lower(text), f"{S.BLANK}+"), lambda x: x != "")
    at = F.array_position(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), F.lit("before")).cast("int")
    return F.when(at > 0, F.struct(F.get(words, at - 1).alias("one"), F.get(words, at + 1).alias("two")))


def observed_order(rules: DataFrame, log: DataFrame) -> DataFrame:
    """(rule_id, case, session, first, second) where a session breaks a rule "x before y": it has both, and x does not come first.

    rules is (rule_id, text); x and y are the words that order_words() finds, sought among the tokens of the lower-cased
    activities. first and second are the first places of x and y in the session, equal where one activity has both words.
    Rules without such words are passed over. A session keeps one row for each of its activities, by a partial aggregate,
    so neither long sessions nor frequent activities gather in one place.
    """
    said = rules.select("rule_id", order_words(F.col("text")).alias("w")).where("w is not null").select("rule_id", "w.one", "w.two")
    first = log.groupBy("case", "session", "activity").agg(F.min("place").alias("place"))
    words = first.select("case", "session", "place", F.explode(S.tokens(F.lower("activity"))).alias("word"))
    words = words.groupBy("case", "session", "word").agg(F.min("place").alias("place"))
    a = words.join(said.withColumnRenamed("one", "word"), "word").select("rule_id", "two", "case", "session", F.col("place").alias("first"))
    b = words.select("case", "session", F.col("word").alias("two"), F.col("place").alias("second"))
    return a.join(b, ["case", "session", "two"]).where("first >= second").select("rule_id", "case", "session", "first", "second")
