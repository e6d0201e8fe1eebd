"""Context packs: candidates scored, the best that fit a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Scores by role of a candidate; some fall with its place.
ROLE_SCORES = {"target": (120.0, 0, 0), "neighbor": (86.0, 0, 0), "hyperedge": (84.0, 0, 0), "page": (100.0, 1, 99), "search": (92.0, 1, 99), "node": (76.0, 1, 30), "edge": (70.0, 1, 25), "group": (68.0, 1, 20)}


def role_score(role: Column, place: Column) -> Column:
    score = F.lit(None).cast("double")
    for name, (base, step, most) in ROLE_SCORES.items():
        score = F.when(role == name, base - step * F.least(place, F.lit(most))).otherwise(score)
    return score


def candidates(items: DataFrame) -> DataFrame:
    """(id, score, title, tokens) of (id, role, place, title, tokens): the best score of each id."""
    return items.withColumn("score", role_score(F.col("role"), F.col("place"))).groupBy("id").agg(F.max("score").alias("score"), F.min("title").alias("title"), F.max("tokens").alias("tokens"))


def fit(items: DataFrame, budget: int, used: int = 0, group: str | None = None) -> DataFrame:
    """items(id, score, title, tokens) with ``included``: in order of score and title each is taken if it still fits; later, smaller ones may.

    What is left only shrinks, so once an item of some number of tokens does not
    fit, no later one of that number does: those taken are the first few of each
    number. Only these, budget / tokens of each at most, are gathered and folded,
    so a group's fold is bounded by the budget, not by its rows. Items without
    tokens fit whenever anything does; items of unknown size never do.
    """
    base = items if group else items.withColumn("_g", F.lit(1))
    g, left = group or "_g", budget - used
    tokens = F.col("tokens").cast("long")
    order = F.row_number().over(Window.partitionBy(g, tokens).orderBy(F.desc("score"), "title", "id"))
    sized = base.where((tokens > 0) & (tokens <= left)).withColumn("_at", order).where((F.col("_at") <= max(left, 1)) & (F.col("_at") * tokens <= left))
    gathered = sized.groupBy(g).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "title", "id", tokens.alias("tokens")))).alias("x"))
    start = F.struct(F.lit(used).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))
    folded = F.aggregate(
        "x", start, lambda a, r: F.when(a["used"] + r["tokens"] <= budget, F.struct((a["used"] + r["tokens"]).alias("used"), F.array_append(a["kept"], r["id"].cast("string")).alias("kept"))).otherwise(a)
    )
    kept = gathered.select(F.col(g).alias("_group"), F.explode(folded["kept"]).alias("_id")).withColumn("_taken", F.lit(True))
    mine = F.col(g).eqNullSafe(F.col("_group")) & (F.col("id").cast("string") == F.col("_id"))
    free = (tokens <= 0) & F.lit(left >= 0)
    out = base.join(kept, mine, "left").withColumn("included", F.coalesce(F.col("_taken"), free, F.lit(False))).drop("_group", "_id", "_taken")
    return out if group else out.drop("_g")


def full_text(pages: DataFrame, cap: int) -> DataFrame:
    """Pages in order of path until the cap: the page that crosses it is cut, later ones are left out.

    Lengths, not texts, are summed, in two levels: within ranges of paths, and over
    the ranges' totals (one row a partition). The ranges are checkpointed, since a
    second evaluation could cut them elsewhere.
    """
    sized = pages.select("id", "path", F.length("text").alias("n")).repartitionByRange("path", "id").withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sized.groupBy("_range").agg(F.sum("n").alias("n")).select("_range", earlier(Window.orderBy("_range")).alias("_from")).where(F.col("_from") < cap)
    begun = sized.join(F.broadcast(ranges), "_range")
    placed = begun.withColumn("before", F.col("_from") + earlier(Window.partitionBy("_range").orderBy("path", "id"))).where(F.col("before") < cap)
    return pages.join(placed.select("id", "before"), "id").select("id", "path", F.substring(F.col("text"), F.lit(1), (F.lit(cap) - F.col("before")).cast("int")).alias("text"))


def overview(nodes: DataFrame, budget: int = 1_500, limit: int = 5_000, pinned: list[str] | None = None) -> DataFrame:
    """(id) of nodes(id, community_id, degree, source_class): all up to ``limit``, else the pinned ones and the best of the communities with most first-party nodes, ``budget`` in all."""
    if nodes.limit(limit + 1).count() <= limit:
        return nodes.select("id")
    sizes = nodes.groupBy("community_id").agg(F.count_if(F.col("source_class") == "first_party").alias("own"))
    order = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("degree"), "id"))
    top = nodes.withColumn("rn", order).where(F.col("rn") <= budget).join(sizes, "community_id")
    first = F.col("id").isin(*(pinned or [""]))
    return top.orderBy(F.desc(first), F.desc("own"), "community_id", "rn").limit(budget).select("id")


def task_score(tasks: DataFrame, target: str = "", goal: str = "", task_id: str | None = None) -> DataFrame:
    """tasks (id, title, goal, target, status, decisions, follow_ups, changed_paths) that a pack takes, with score and reason."""
    low = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    t, g = " ".join(target.lower().split()), " ".join(goal.lower().split())
    near = lambda c: (c != "") & (c.contains(t) | F.contains(F.lit(t), c))
    direct = (near(low(F.col("target"))) | F.exists("changed_paths", lambda p: near(low(p)))) if t else F.lit(False)
    said = low(F.concat_ws(" ", "goal", "title", F.array_join("decisions", " ")))
    rules = [
        (F.col("id").eqNullSafe(F.lit(task_id)) if task_id else F.lit(False), 126, "active memory task"), (direct & (F.col("status") == "completed"), 108, "directly related memory task"), (direct, 116, "directly related memory task"),
        (said.contains(g) if g else F.lit(False), 96, "memory task matches goal"), (F.col("status").isin("active", "blocked") & (F.size("follow_ups") > 0), 90, "unresolved memory follow-ups"), (F.size("decisions") > 0, 82, "recent memory decisions"),
    ]
    score, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for test, points, why in reversed(rules):
        score, reason = F.when(test, points).otherwise(score), F.when(test, why).otherwise(reason)
    return tasks.withColumn("score", score).withColumn("reason", reason).where("score is not null")


def shrink_first(items: DataFrame, budget: int, used: int = 0, least: int = 80) -> DataFrame:
    """items (id, score, title, excerpt, tokens) of which the first, if it alone is over the budget, has its excerpt cut to three characters for each token left (160 at least); it is not cut below ``least`` tokens."""
    left = budget - used
    first = items.orderBy(F.desc("score"), "title", "id").limit(1).select(F.col("id").alias("_first"))
    cut = F.when(F.length("excerpt") <= max(160, left * 3), F.col("excerpt")).otherwise(F.concat(F.substring("excerpt", 1, max(160, left * 3) - 3), F.lit("...")))
    wanted = F.col("_first").isNotNull() & (F.col("tokens") > left) & F.lit(left >= least) & (F.length("excerpt") > 0)
    shorter = F.least(F.col("tokens"), F.ceil(F.length(cut) / 4.0).cast("long"))
    return items.join(F.broadcast(first), items["id"] == F.col("_first"), "left").withColumns({"tokens": F.when(wanted & (shorter <= left), shorter).otherwise(F.col("tokens")), "excerpt": F.when(wanted & (shorter <= left), cut).otherwise(F.col("excerpt"))}).drop("_first")


def render(items: DataFrame, form: str = "markdown") -> DataFrame:
    """(id, text): included items (id, kind, title, excerpt, score) as Markdown, as llms entries or as JSON."""
    if form == "json":
        return items.select("id", F.to_json(F.struct("id", "kind", "title", "excerpt", "score")).alias("text"))
    head = F.concat(F.lit("### "), "title", F.lit(" ("), "kind", F.lit(")\n\n")) if form == "markdown" else F.concat(F.lit("- "), "title", F.lit(": "))
    return items.select("id", F.concat(head, F.coalesce("excerpt", F.lit(""))).alias("text"))
