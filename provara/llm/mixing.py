"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets. Sources by code point, null last, weigh 3, 1, 2, repeating, and share
``share`` times all words by weight; no target exceeds ``most`` times its
source's words, and what is cut off is shared again by weight (water filling).

Copies. Each row of a source would take target / source words copies. The whole
part is taken by all; the fractional part is rounded dependently: two rows pass
words between them, in a random direction that keeps both expectations, until
one fraction is 0 or 1. Rows meet in groups of about ``FAN``; what each group
leaves over meets again, level by level, in a reduction tree, so a source's
words stay within one row's words of its target. Random numbers are hashes of the
rows, so reruns agree.

Repeated rows (doc_id, source and text alike) are one unit: of n rows with
fraction p, floor(n p) take one more copy, and what is left over is rounded with
the other units as one row's fraction. Null texts and texts without words have
size 0 and take 0 words. A null source is a source of its own, and a null doc_id
unlike any other. Rows of one size are ordered by their hash. Texts are counted by
a pattern, so a long one needs no more than its bytes. In mixed() columns of docs
travel as one struct, so none of their names can clash. An empty table gives no rows.

The windows of targets() run over one row for each source, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.llm import shared

WEIGHTS = (3, 1, 2)
FAN = 48


def words(text: str = "text"):
    """Number of words of a text column."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(shared.WORD)).cast("long")


def _unit_key() -> list[Column]:
    about = [F.isnull("source"), "source", F.isnull("doc_id"), "doc_id"]
    return [
        F.xxhash64(*about, shared.body()).alias("key"),
        F.xxhash64(F.lit("second"), shared.body(), *about).alias("key2"),
    ]


def units(docs: DataFrame) -> DataFrame:
    """source, doc_id, key and key2 (128 bits of source, doc_id and text), size and n_rows of each unit."""
    rows = docs.select("doc_id", "source", *_unit_key(), words().alias("size"))
    return rows.groupBy("source", "doc_id", *shared.KEY, "size").agg(F.count(F.lit(1)).alias("n_rows"))


def targets(parts: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n_units and target: one row a source."""
    sums = parts.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(place - 1, F.lit(len(weights))).cast("int") + 1).cast("double")
    capped = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    from_here = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum(F.col("source_size")).over(everything) * F.lit(share) - before) / from_here
    leveled = capped.withColumn("level", level)
    # the first source by ratio that stays under its cap sets the level of all that do
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.coalesce("source", F.lit("")), "level"))).over(everything)
    return leveled.withColumn("chosen", chosen).select("source", "source_size", "n_units", F.least("cap", F.coalesce(F.col("chosen.level") * F.col("weight"), F.col("cap"))).alias("target"))


_ITEM = (
    "struct<unit: struct<doc_id: bigint, key: bigint, key2: bigint, n_rows: bigint, extra: bigint>,"
    " size: double, p: double>"
)
_ROOM = "(1 - a.c.p) * a.c.size"  # what the carried row can still take in
_HELD = "a.c.p * a.c.size"  # and give away
_X_HELD, _X_ROOM = "x.p * x.size", "(1 - x.p) * x.size"


def _with_p(item: str, p: str) -> str:
    return f"named_struct('unit', {item}.unit, 'size', {item}.size, 'p', {p})"


def _pivot(level: int) -> str:
    """SQL that folds an array of items into one in which at most one fraction is left."""
    chance = f"(shiftrightunsigned(xxhash64(a.c.unit.key, x.unit.key, {level}), 11) / 9007199254740992D)"
    into = f"{chance} * (least({_ROOM}, {_X_HELD}) + least({_HELD}, {_X_ROOM})) < least({_HELD}, {_X_ROOM})"
    c = f"if({into}, if({_ROOM} <= {_X_HELD}, 1D, a.c.p + {_X_HELD} / a.c.size), if({_HELD} <= {_X_ROOM}, 0D, a.c.p - {_X_ROOM} / a.c.size))"
    x = f"if({into}, if({_X_HELD} <= {_ROOM}, 0D, x.p - {_ROOM} / x.size), if({_X_ROOM} <= {_HELD}, 1D, x.p + {_HELD} / x.size))"
    moved = f"named_struct('c', {_with_p('a.c', c)}, 'x', {_with_p('x', x)})"
    settled = "(m.c.p <= 0 or m.c.p >= 1)"
    step = f"element_at(transform(array({moved}), m -> named_struct('done', array_append(a.done, if({settled}, m.c, m.x)), 'c', if({settled}, m.x, m.c))), 1)"
    nothing = "named_struct('done', array_append(a.done, a.c), 'c', x)"
    start = f"named_struct('done', cast(array() as array<{_ITEM}>), 'c', element_at(items, 1))"
    return f"aggregate(slice(items, 2, size(items)), {start}, (a, x) -> if(a.c.p <= 0 or a.c.p >= 1, {nothing}, {step}), a -> array_append(a.done, a.c))"


def copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, doc_id, key, key2, size, n_rows, source_size, target, copies and extra, one row a unit.

    Each of the unit's n_rows rows is taken ``copies`` times, and ``extra`` of them once more.
    """
    with shared.Scratch(docs.sparkSession) as tables:
        return _copies(tables, docs, weights, share, most)


def _copies(tables: shared.Scratch, docs: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    parts = tables.keep(units(docs))
    goals = tables.keep(targets(parts, weights, share, most))
    side = shared.hinted(goals.withColumnRenamed("source", "goal_source"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("rate") + 1e-12)
    rows = parts.join(side, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rows = rows.withColumn("rate", rate).withColumn("whole", whole)
    # what the unit's rows take beyond whole copies, in copies
    mass = F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.col("rate") - whole, F.lit(0.0)) * F.col("n_rows"))
    rows = rows.withColumn("mass", mass).withColumn("extra", F.floor(F.col("mass") + 1e-12).cast("long"))
    rows = rows.withColumn("p", F.col("mass") - F.col("extra"))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-12, 0.0).otherwise(F.col("p")))
    out = ("source", "doc_id", *shared.KEY, "size", "n_rows", "source_size", "target", "copies", "extra")
    done = [rows.where("p = 0").withColumn("copies", F.col("whole").cast("long")).select(*out)]
    about = ("source", "source_size", "target", "whole")
    item = F.struct(
        F.struct("doc_id", *shared.KEY, "n_rows", "extra").alias("unit"), F.col("size").cast("double").alias("size"), "p"
    )
    groups = F.ceil(F.col("n_units") / FAN).cast("long")
    left = rows.where("p > 0").select(*about, groups.alias("groups"), item.cast(_ITEM).alias("i"))
    most_units = goals.agg(F.max("n_units")).first()[0] or 0
    level = 0
    while most_units > 0:
        final = most_units <= FAN
        group = F.pmod(F.xxhash64("i.unit.key", F.lit(level)), F.greatest(F.col("groups"), F.lit(1)))
        ordered = F.struct((-F.col("i.size")).alias("o"), F.xxhash64("i.unit.key", F.lit(~level)).alias("h"), "i")
        items = F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x.i)
        met = left.groupBy(*about, "groups", group.alias("group")).agg(items.alias("items"))
        folded = tables.keep(met.select(*about, "groups", F.explode(F.expr(_pivot(level))).alias("i")))
        settled = folded if final else folded.where("i.p <= 0 or i.p >= 1")
        chance = F.shiftrightunsigned(F.xxhash64("i.unit.key", F.lit("last")), 11) / F.lit(float(1 << 53))
        p = F.col("i.p")
        one_more = F.when(p >= 1, 1).when(p <= 0, 0).otherwise((chance < p).cast("int"))
        told = settled.select(*about, "i.unit.*", F.round("i.size").cast("long").alias("size"), one_more.alias("more"))
        told = told.withColumn("extra", F.col("extra") + F.col("more"))
        done.append(told.withColumn("copies", F.col("whole").cast("long")).select(*out))
        if final:
            break
        left = folded.where("i.p > 0 and i.p < 1").withColumn("groups", F.ceil(F.col("groups") / FAN))
        most_units = -(-most_units // FAN)
        level += 1
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows of docs, each as often as its copies say; columns as in docs."""
    key = list(shared.KEY)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_unit_key())
    with shared.Scratch(docs.sparkSession) as tables:
        many = tables.keep(copies(docs, weights, share, most).select(*key, F.col("n_rows").alias("n"), "copies", "extra"))
        met = shared.dealt(rows, many.where("copies > 0 or extra > 0"), key, many)
        alike = (F.col("extra") == 0) | (F.col("extra") == F.col("n"))
        settled = met.where(alike).withColumn("times", F.col("copies") + (F.col("extra") > 0).cast("int"))
        settled = settled.select("row", "times")
        parted = many.where(~alike)
        if parted.limit(1).count():
            settled = settled.unionByName(tables.keep(_parted(met.where(~alike)).select("row", "times")))
    return shared.repeated(settled, "times").select("row.*")


def _parted(met: DataFrame) -> DataFrame:
    """Of each unit's n rows, ``extra`` with times = copies + 1 and the others with copies.

    Rows are numbered within parts of SALT_ROWS rows or so, and each part is told how many of its rows take one more.
    """
    key = list(shared.KEY)
    rows = shared.written(met.withColumn("rid", F.monotonically_increasing_id()))
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / shared.SALT_ROWS)).cast("int")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("held"), F.first("extra").alias("extra"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("extra") - F.coalesce(F.sum("held").over(before), F.lit(0))
    quota = sizes.select(*key, "part", F.greatest(F.least(room, F.col("held")), F.lit(0)).alias("quota"))
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy("rid"))
    told = rows.withColumn("place", place).join(quota, [*key, "part"])
    return told.withColumn("times", F.col("copies") + (F.col("place") <= F.col("quota")).cast("int"))
