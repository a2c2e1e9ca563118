"""How far one skill is from another in a concept tree, and what the walk costs.

skills: skill, parent (a concept), difficulty (1 to 5), also (array of skills
beside it). concepts: concept, parent (null at the root). Both are dimension
tables; pairs of skills are made once and joined from then on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.session import settled

# Weeks by kind of relation, scale by difficulty, strength by status.
BASE_WEEKS = {"identical": 0.0, "sibling": 1.0, "family": 1.5, "domain": 2.5, "discipline": 6.0, "unrelated": 9.0}
DIFFICULTY_SCALE = {1: 0.5, 2: 0.75, 3: 1.0, 4: 1.4, 5: 1.9}
HELD = {"MATCHED": 1.0, "INFERRED": 0.75, "WEAK": 0.4}


def _lookup(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def ancestors(concepts: DataFrame) -> DataFrame:
    """concept, ancestor and level (1 is the parent) of all ancestors, each at its least level; a tree of any depth, and cycles.

    Pointers are doubled: after step i every concept has its ancestors within 2**i levels and knows the one
    at that distance, whose ancestors the next step takes over. A concept on a cycle is its own ancestor.
    """
    above = concepts.where("parent is not null and concept is not null").groupBy("concept").agg(F.min("parent").alias("parent"))
    known = settled(above.select("concept", F.col("parent").alias("ancestor"), F.lit(1).alias("level")))
    jump, reach, n = settled(above.select("concept", F.col("parent").alias("far"))), 1, known.count()
    while jump.limit(1).count():
        onward = known.select(F.col("concept").alias("far"), F.col("ancestor").alias("a"), (F.col("level") + reach).alias("l"))
        more = jump.join(onward, "far").select("concept", F.col("a").alias("ancestor"), F.col("l").alias("level"))
        known = settled(known.unionByName(more).groupBy("concept", "ancestor").agg(F.min("level").alias("level")))
        if (now := known.count()) == n:  # all that is above has been met, cycles too
            break
        twice = jump.select(F.col("concept").alias("far"), F.col("far").alias("farther"))
        jump, reach, n = settled(jump.join(twice, "far").select("concept", F.col("farther").alias("far"))), 2 * reach, now
    return known


def closure(skills: DataFrame, concepts: DataFrame) -> DataFrame:
    """skill, ancestor, level (0 is the parent); a concept counts at its least level."""
    own = skills.where("parent is not null").select("skill", F.col("parent").alias("concept"))
    up = own.join(ancestors(concepts), "concept").select("skill", "ancestor", "level")
    walk = own.select("skill", F.col("concept").alias("ancestor"), F.lit(0).alias("level")).unionByName(up)
    return walk.groupBy("skill", "ancestor").agg(F.min("level").alias("level"))


def concept_depths(concepts: DataFrame) -> DataFrame:
    """concept and how many concepts are above it."""
    above = ancestors(concepts).groupBy("concept").agg(F.count(F.lit(1)).alias("depth"))
    return concepts.select("concept").join(above, "concept", "left").select("concept", F.coalesce("depth", F.lit(0)).alias("depth"))


def relations(skills: DataFrame, concepts: DataFrame) -> DataFrame:
    """a, b, kind, common, shared_depth, steps of every pair: the lowest common ancestor and how it is reached decide the kind."""
    up = closure(skills, concepts)
    left, right = up.select(F.col("skill").alias("a"), "ancestor", F.col("level").alias("up")), up.select(F.col("skill").alias("b"), "ancestor", F.col("level").alias("down"))
    lowest = left.join(right, "ancestor").groupBy("a", "b").agg(F.min(F.struct("up", "down", "ancestor")).alias("m"))
    ids = skills.select("skill", "also")
    pairs = ids.select(F.col("skill").alias("a"), F.col("also").alias("also_a")).join(F.broadcast(ids.select(F.col("skill").alias("b"), F.col("also").alias("also_b"))), F.lit(True))
    p = pairs.join(lowest, ["a", "b"], "left").select("*", F.col("m.up").alias("up"), F.col("m.down").alias("down"), F.col("m.ancestor").alias("common"))
    p = p.join(concept_depths(concepts).select(F.col("concept").alias("common"), F.col("depth").alias("shared_depth")), "common", "left")
    beside = F.coalesce(F.array_contains("also_a", F.col("b")), F.lit(False)) | F.coalesce(F.array_contains("also_b", F.col("a")), F.lit(False))
    kind = (
        F.when(F.col("a") == F.col("b"), "identical")
        .when(F.col("common").isNull(), "unrelated")
        .when(beside, "sibling")
        .when(F.col("shared_depth") == 0, "discipline")
        .when((F.col("up") == 0) & (F.col("down") == 0), "sibling")
        .when((F.col("up") <= 1) & (F.col("down") <= 1) & (F.col("shared_depth") >= 2), "family")
        .otherwise("domain")
    )
    steps = F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce(F.col("up") + F.col("down") + 2, F.lit(99)))
    return p.select("a", "b", kind.alias("kind"), "common", F.coalesce("shared_depth", F.lit(-1)).cast("int").alias("shared_depth"), steps.cast("int").alias("steps"))


def neighbours(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """The nearest skills of each; only related ones."""
    near = Window.partitionBy("a").orderBy("steps", F.desc("shared_depth"), "b")
    own = pairs.where(~F.col("kind").isin("identical", "unrelated", "discipline"))
    return own.withColumn("place", F.row_number().over(near)).where(F.col("place") <= limit)


def band(weeks: Column) -> Column:
    return F.when(weeks <= 1.2, "sibling").when(weeks <= 2.0, "family").when(weeks <= 3.5, "domain").otherwise("discipline")


def human(weeks: Column) -> Column:
    """Weeks as one would say them."""
    whole, months = F.floor(weeks), weeks / 4.345
    return (
        F.when(weeks <= 0, "already there")
        .when(weeks < 0.85, "a few days")
        .when(weeks < 1.3, "~1 week")
        .when(weeks < 4.4, F.concat_ws("", F.concat_ws("-", whole.cast("string"), (whole + 1).cast("string")), F.lit(" weeks")))
        .when(months < 1.3, "~1 month")
        .when(months < 2.0, "6-8 weeks")
        .otherwise(F.concat(F.floor(months).cast("string"), F.lit("+ months")))
    )


def bridges(targets: DataFrame, held: DataFrame, pairs: DataFrame, skills: DataFrame, pins: DataFrame) -> DataFrame:
    """For each target (doc_id, skill) the cheapest walk from what the document holds (doc_id, skill, strength): springboard, kind, weeks, pinned. A pinned pair (source, target, weeks) stands before every computed one; a skill is not its own springboard."""
    scale = _lookup(DIFFICULTY_SCALE, F.coalesce("difficulty", F.lit(3)), 1.0)
    wanted = targets.join(F.broadcast(skills.select("skill", "difficulty", F.lit(True).alias("known"))), "skill", "left").withColumn("scale", scale).drop("difficulty")
    source = held.where("strength > 0").select("doc_id", F.col("skill").alias("source"), "strength")
    walks = wanted.where("known").join(source, "doc_id").where("source <> skill")
    walks = walks.join(F.broadcast(pairs.select(F.col("a").alias("source"), F.col("b").alias("skill"), "kind")), ["source", "skill"])
    walks = walks.join(F.broadcast(pins.select("source", F.col("target").alias("skill"), F.col("weeks").alias("pin"))), ["source", "skill"], "left")
    weeks = F.coalesce("pin", _lookup(BASE_WEEKS, F.col("kind"), 9.0) * F.col("scale")) * (F.lit(1.25) - F.lit(0.35) * F.col("strength"))
    walks = walks.withColumn("weeks", F.bround(F.greatest(weeks, F.lit(0.25)), 1)).withColumn("shown", F.when(F.col("pin").isNotNull(), band(F.col("weeks"))).otherwise(F.col("kind")))
    best = walks.groupBy("doc_id", "skill").agg(F.min(F.struct(F.col("pin").isNull().alias("computed"), "weeks", "source", "shown")).alias("w"))
    out = wanted.join(best, ["doc_id", "skill"], "left")
    none = F.bround(F.lit(BASE_WEEKS["unrelated"]) * F.col("scale"), 1)
    told = out.select("doc_id", "skill", F.col("w.source").alias("springboard"), F.coalesce("w.shown", F.lit("unrelated")).alias("kind"), F.coalesce("w.weeks", none).alias("weeks"), F.coalesce(~F.col("w.computed"), F.lit(False)).alias("pinned"))
    return told.withColumn("human", human(F.col("weeks")))


def combined(bridges: DataFrame) -> DataFrame:
    """Weeks for all of a document's gaps: the longest in full, each further one at 0.6 of the rate before."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weeks"), "skill")) - 1
    return bridges.withColumn("_i", place).groupBy("doc_id").agg(F.bround(F.sum(F.col("weeks") * F.pow(F.lit(0.6), F.col("_i"))), 1).alias("weeks"))
