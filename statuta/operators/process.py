"""Process models as tables, and violations of rules by them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import strings as S
from statuta.plans.lineage import cut

# Element names of process models, and words that tell of an order.
TASKS = ["task", "userTask", "serviceTask", "sendTask", "receiveTask", "manualTask", "businessRuleTask", "scriptTask", "subProcess", "callActivity"]
EVENTS = ["startEvent", "endEvent", "intermediateCatchEvent", "intermediateThrowEvent", "boundaryEvent"]
GATEWAYS = ["exclusiveGateway", "parallelGateway", "inclusiveGateway", "complexGateway", "eventBasedGateway"]


def model_schema() -> str:
    node = "array<struct<_id:string,_name:string>>"
    tags = ", ".join(f"{t}: {node}" for t in [*TASKS, *EVENTS, *GATEWAYS])
    lane = "array<struct<_id:string,_name:string,flowNodeRef:array<string>>>"
    return f"process struct<_id: string, laneSet: struct<lane: {lane}>, {tags}, sequenceFlow: array<struct<_id:string,_sourceRef:string,_targetRef:string>>>"


def parse_models(rows: DataFrame, xml_col: str = "xml") -> DataFrame:
    """p: the process of each XML text, prefixes ignored."""
    return rows.withColumn("p", S.once(F.from_xml(xml_col, model_schema(), {"ignoreNamespace": "true"})["process"]))


def _nodes(models: DataFrame, tags: list[str]) -> DataFrame:
    each = F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"p.{t}"), F.array().cast("array<struct<_id:string,_name:string>>")), _named(t)) for t in tags]))
    return models.select(F.col("p._id").alias("process_id"), F.explode(each).alias("n")).select("process_id", "n.*")


def _named(tag: str):
    return lambda x: F.struct(x["_id"].alias("node_id"), x["_name"].alias("name"), F.lit(tag).alias("kind"))


def activities(models: DataFrame) -> DataFrame:
    return _nodes(models, TASKS)


def events_gateways(models: DataFrame) -> DataFrame:
    return _nodes(models, [*EVENTS, *GATEWAYS])


def lanes(models: DataFrame) -> DataFrame:
    """(process_id, lane_id, name, node_id): a row a member, or one with a null member for an empty lane."""
    each = models.select(F.col("p._id").alias("process_id"), F.explode("p.laneSet.lane").alias("l"))
    return each.select("process_id", F.col("l._id").alias("lane_id"), F.col("l._name").alias("name"), F.explode_outer("l.flowNodeRef").alias("node_id"))


def flows(models: DataFrame) -> DataFrame:
    return models.select(F.col("p._id").alias("process_id"), F.posexplode("p.sequenceFlow").alias("pos", "f")).select("process_id", "pos", F.col("f._id").alias("flow_id"), F.col("f._sourceRef").alias("source"), F.col("f._targetRef").alias("target"))


def depths(starts: DataFrame, edges: DataFrame, compact: int = 20) -> DataFrame:
    """(process_id, node_id, depth, rank) of all nodes that edges reach from the starts; all processes advance together.

    rank is the place of a node within its depth in breadth-first order: starts by id, others by the rank of the node
    that reaches them first and by pos, the place of the edge. Each round joins the frontier with the edges, leaves out
    what was visited and is written as a table; cycles end, since a node is visited once. There are as many rounds as the
    longest of all shortest paths has edges; every `compact` rounds what was visited is written as one table, so that a
    long path does not make the plan longer.
    """
    edges = cut(edges.select("process_id", "source", "target", "pos"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("process_id").orderBy(*by))
    seen = frontier = cut(starts.select("process_id", "node_id", F.lit(0).alias("depth")).distinct().withColumn("rank", rank("node_id")))
    for depth in itertools.count(1):
        ahead = frontier.join(edges.select("process_id", F.col("source").alias("node_id"), "target", "pos"), ["process_id", "node_id"]).groupBy("process_id", F.col("target").alias("node_id")).agg(F.min(F.struct("rank", "pos")).alias("by"))
        frontier = cut(ahead.join(seen, ["process_id", "node_id"], "left_anti").select("process_id", "node_id", F.lit(depth).alias("depth"), rank("by", "node_id").alias("rank")))
        if not frontier.limit(1).count():
            return seen
        seen = seen.unionByName(frontier)  # tables written by the rounds
        if depth % compact == 0:
            seen = cut(seen)


def task_order(starts: DataFrame, edges: DataFrame, tasks: DataFrame, whole: int = 100) -> DataFrame:
    """(process_id, node_id, name, place): tasks in breadth-first order; unreached ones are left out.

    A process of at most `whole` edges, starts and tasks is one row and ordered in it, with one shuffle for all; the others,
    if there are any, advance together by depths(), in the same order.
    """
    edges = cut(edges.select("process_id", "source", "target", "pos").where("process_id is not null and source is not null and target is not null"))
    sizes = edges.select("process_id").unionByName(starts.select("process_id")).unionByName(tasks.select("process_id")).groupBy("process_id").count()
    large = cut(sizes.where((F.col("count") > whole) & F.col("process_id").isNotNull()).select("process_id"))
    if not large.limit(1).count():
        return _ordered_rows(starts, edges, tasks)
    kept, rest = (lambda x: x.join(large, "process_id", "left_anti")), (lambda x: x.join(large, "process_id", "left_semi"))
    reached = depths(rest(starts), rest(edges)).join(tasks, ["process_id", "node_id"])
    by_rounds = reached.withColumn("place", F.row_number().over(Window.partitionBy("process_id").orderBy("depth", "rank"))).select("process_id", "node_id", "name", "place")
    return _ordered_rows(kept(starts), kept(edges), kept(tasks)).unionByName(by_rounds)


def _ordered_rows(starts: DataFrame, edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """task_order() of processes that are one row each: a queue of nodes, to which each node adds those its edges reach and no node did before."""
    node = edges.schema["source"].dataType
    none = {"source": F.lit(None).cast(node), "target": F.lit(None).cast(node), "pos": F.lit(None).cast(edges.schema["pos"].dataType), "node_id": F.lit(None).cast(node), "name": F.lit(None).cast(tasks.schema["name"].dataType)}
    of_kind = lambda kind, rows: rows.select("process_id", F.lit(kind).alias("kind"), *[F.col(c) if c in rows.columns else x.alias(c) for c, x in none.items()])
    every = of_kind(0, starts.select("process_id", "node_id")).unionByName(of_kind(1, edges)).unionByName(of_kind(2, tasks.select("process_id", "node_id", "name")))
    gather = lambda kind, x: F.collect_list(F.when(F.col("kind") == kind, x))
    one = every.where("process_id is not null").groupBy("process_id").agg(
        F.array_sort(F.array_distinct(gather(0, F.col("node_id")))).alias("queue"),
        F.sort_array(gather(1, F.struct("pos", "target", "source"))).alias("edges"),
        gather(2, F.struct("node_id", "name")).alias("tasks"),
    ).where(F.size("tasks") > 0)
    most = F.size(F.array_union("queue", F.col("edges.target")))
    reach = lambda q, i: F.array_except(F.transform(F.filter("edges", lambda e: e["source"] == F.get(q, i - 1)), lambda e: e["target"]), q)
    # where most is 0, nothing starts: the sequence is (1), and no edge leaves a node that is not there
    one = one.select("process_id", "tasks", S.once(F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.col("queue"), lambda q, i: F.concat(q, reach(q, i)))).alias("queue"))
    placed = F.transform("tasks", lambda t: F.struct(F.array_position("queue", t["node_id"]).alias("at"), t["node_id"].alias("node_id"), t["name"].alias("name")))
    each = one.select("process_id", F.posexplode(F.sort_array(F.filter(placed, lambda t: t["at"] > 0))).alias("no", "t"))
    return each.select("process_id", "t.node_id", "t.name", (F.col("no") + 1).alias("place"))


def best_match(rules: DataFrame, named: DataFrame, text_col: str) -> DataFrame:
    """Per rule (rule_id, process_id, text) the most similar name of its process: rule_id, best, best_name; ties to the first name."""
    pairs = rules.where(F.coalesce(F.trim(text_col), F.lit("")) != "").join(named, "process_id")
    scored = pairs.withColumn("s", S.jaccard(S.tokens(F.lower(text_col)), S.tokens(F.lower(F.coalesce("name", F.lit(""))))))
    return scored.groupBy("rule_id").agg(F.max(F.struct("s")).alias("m"), F.min(F.struct((-F.col("s")).alias("n"), "name")).alias("b")).select("rule_id", F.col("m.s").alias("best"), F.col("b.name").alias("best_name"))


def missing_action(rules: DataFrame, tasks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rules whose action no task of the process is like: (rule_id, process_id, kind, best, best_name)."""
    found = rules.where(F.coalesce(F.trim("action"), F.lit("")) != "").join(best_match(rules, tasks, "action"), "rule_id", "left")
    return found.where(F.coalesce("best", F.lit(0.0)) < threshold).select("rule_id", "process_id", F.lit("missing_action").alias("kind"), F.coalesce("best", F.lit(0.0)).alias("best"), "best_name")


def incorrect_actor(rules: DataFrame, lane_rows: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rules whose actor no lane of the process is like; processes without lanes are passed over."""
    named = lane_rows.select("process_id", "name").distinct()
    found = rules.where(F.coalesce(F.trim("actor"), F.lit("")) != "").join(named.select("process_id").distinct(), "process_id", "left_semi").join(best_match(rules, named, "actor"), "rule_id", "left")
    return found.where(F.coalesce("best", F.lit(0.0)) < threshold).select("rule_id", "process_id", F.lit("incorrect_actor").alias("kind"), F.coalesce("best", F.lit(0.0)).alias("best"), "best_name")


def out_of_order(rules: DataFrame, ordered: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rules "x before y" whose action is in the process and whose words stand in its tasks in another order.

    The action must be like some ordered task, above the threshold (no action is like a task without a name alone). The
    text is split at blanks; of its words "before" the first that has a word on both sides counts, and these are sought
    in the task names. The first task of each counts, and the rule is broken where that of the word before does not come
    first. Processes of one task are passed over.
    """
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    rest = F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))
    at = F.array_position(rest, F.lit("before")).cast("int")
    said = rules.where(F.contains(F.lower("text"), F.lit("before"))).select("rule_id", "process_id", F.lower(F.coalesce("action", F.lit(""))).alias("action"), words.alias("words"))
    said = said.withColumn("at", at).where("at > 0").select("rule_id", "process_id", "action", F.get("words", F.col("at") - 1).alias("one"), F.get("words", F.col("at") + 1).alias("two"))
    named = S.tokens(F.lower(F.coalesce("name", F.lit(""))))
    pairs = said.join(ordered, "process_id").withColumn("like", S.jaccard(S.tokens(F.col("action")), named))
    has = lambda w: F.array_contains(named, F.col(w))
    found = pairs.groupBy("rule_id", "process_id").agg(F.min(F.when(has("one"), F.col("place"))).alias("first"), F.min(F.when(has("two"), F.col("place"))).alias("second"), F.count(F.lit(1)).alias("tasks"), F.max("like").alias("like"))
    return found.where(F.col("like") > threshold).where("tasks >= 2 and first >= second").select("rule_id", "process_id", F.lit("out_of_order").alias("kind"))


def violation_report(rules: DataFrame, violations: DataFrame) -> DataFrame:
    """Per rule and process of rules: has_violations, the number and kinds of violations; false, 0 and none where there are none."""
    found = violations.groupBy("rule_id", "process_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    both = rules.select("rule_id", "process_id").join(found, ["rule_id", "process_id"], "left")
    return both.select("rule_id", "process_id", F.col("n").isNotNull().alias("has_violations"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kinds", F.lit("")).alias("kinds"))
