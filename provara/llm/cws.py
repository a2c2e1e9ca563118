"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are words, weighted by their number in the text. For each sample k and
term, r and c follow Gamma(2, 1) and beta is uniform, all from a hash of term
and k; with weight w, t = floor(ln w / r + beta) and
ln a = ln c - r * (t - beta + 1). The term of least a is the sample, and
(term, t) its value: two texts share a value with the probability of their
generalised Jaccard similarity, sum of least weights over sum of greatest.
The share of equal values is the likeness. Gamma quantiles come from tables
(r of 2**9 steps; ln c of 2**10 steps, interpolated, with the series for the
lowest step), which a rule below makes.

Rows meet their next row (descending doc_id, then hash of the text) in one
shuffle: the range partitions of the keys alone give the least key of each bucket,
rows find their bucket among these, and the first row of each bucket is also sent
to the bucket before it (of the first bucket, to the last). Keys have the text's
hash beside doc_id, so one doc_id of many rows is cut like any others. Words of a
text are sorted and counted within its row; sampling groups a row's terms where
they are. Buckets have a bounded number of bytes, so their number grows with the table.

Null texts count as empty. Texts without a word have one term, the empty one,
so they are alike among themselves only. Null doc_ids come last; rows of one
doc_id follow by the hash of their text. Of n repeated rows all but one are the next
of another such row; they are worked on as two rows, and told n times. A lone row
is its own next. A text is never cut: a task needs some forty times the bytes of its
longest text. Of docs only doc_id and text are read, so other columns may have any
name. An empty table gives no rows. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provara.llm import shared

SAMPLES = 64
#: Samples taken at once: the code made for many at once is long, and runs slower.
AT_ONCE = 8
#: Text of a bucket, and rows below which a bucket is not cut for the sake of more tasks.
BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 50
_R_BITS, _C_BITS, _BETA_BITS = 9, 10, 12


def gamma2_quantile(p: float) -> float:
    """x with 1 - (1 + x) * exp(-x) = p, by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - (1 + mid) * math.exp(-mid) < p else (low, mid)
    return (low + high) / 2


def _tables() -> tuple[Column, Column]:
    r = [gamma2_quantile((i + 0.5) / (1 << _R_BITS)) for i in range(1 << _R_BITS)]
    inner = [math.log(gamma2_quantile(i / (1 << _C_BITS))) for i in range(1, 1 << _C_BITS)]
    c = [0.0, *inner, math.log(gamma2_quantile(1 - 0.3 / (1 << _C_BITS)))]
    return F.lit(r), F.lit(c)


def _sample(k: Column) -> Column:
    """One long to take the least of: ln a in the high bits, 31 bits for (term, t) in the low ones."""
    h, r_table, c_table = F.xxhash64("term", k), F.col("r_table"), F.col("c_table")
    r = F.get(r_table, F.shiftrightunsigned(h, 64 - _R_BITS).cast("int"))
    beta = F.shiftrightunsigned(h, 52 - _BETA_BITS + 2).bitwiseAND(F.lit((1 << _BETA_BITS) - 1))
    beta = beta / F.lit(float(1 << _BETA_BITS))
    step = F.shiftrightunsigned(h, 30).bitwiseAND(F.lit((1 << _C_BITS) - 1)).cast("int")
    part = h.bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    lowest = F.lit(0.5) * F.log((part + 1e-10) * F.lit(2.0 / (1 << _C_BITS)))
    low = F.get(c_table, step)
    ln_c = F.when(step == 0, lowest + F.exp(lowest) / 3).otherwise(low + part * (F.get(c_table, step + 1) - low))
    t = F.floor(F.col("ln_w") / r + beta)
    ln_a = ln_c - r * (t - beta + 1)
    value = F.col("term").bitwiseXOR(t * F.lit(1_000_003)).bitwiseAND(F.lit((1 << 31) - 1))
    ln_a = F.greatest(ln_a + 64, F.lit(0.0)) * F.lit(float(1 << 25))
    return F.shiftleft(ln_a.cast("long"), 31).bitwiseOR(value)


_ORDER = ("none", "down", *shared.KEY, "repeat")


def _distinct(docs: DataFrame) -> DataFrame:
    """doc_id, text, the columns of _ORDER and n, the number of rows that one row stands for."""
    key = list(shared.KEY)
    rows = docs.select("doc_id", shared.body().alias("text"), *shared.text_key(), *_unique())
    counts = rows.groupBy("u", "u2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = shared.written(counts)
    own = ("doc_id", "text", *key)
    if shared.few(counts):
        alone = rows.join(F.broadcast(counts.select("u", "u2")), ["u", "u2"], "left_anti")
        several = rows.join(F.broadcast(counts), ["u", "u2"])
    else:
        alone = shared.dealt(rows, counts, ["u", "u2"], counts, "left_anti")
        several = shared.dealt(rows, counts, ["u", "u2"], counts)
    one = several.groupBy("u", "u2").agg(F.first(F.struct(*own)).alias("row"), F.first("n").alias("n"))
    stands = F.array(F.struct((F.col("n") - 1).alias("n"), F.lit(0).alias("repeat")), F.struct(F.lit(1).cast("long").alias("n"), F.lit(1).alias("repeat")))
    one = one.select("row.*", F.explode(stands).alias("s")).select(*own, "s.n", "s.repeat")
    alone = alone.select(*own, F.lit(1).cast("long").alias("n"), F.lit(1).alias("repeat"))
    down = F.bitwise_not("doc_id").alias("down")
    return alone.unionByName(one).select("doc_id", "text", "n", F.isnull("doc_id").alias("none"), down, *key, "repeat")


def _unique() -> list[Column]:
    return [c.alias(name) for c, name in zip(shared.row_key(), ("u", "u2"), strict=True)]


def _with_next(docs: DataFrame) -> DataFrame:
    """bucket, place in it, doc_id, text, n, next_text and halo (a copy that only serves as another's next row)."""
    rows = _distinct(docs)
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    wide = min(4 * shared.n_inputs(docs), -(-size[0] // BUCKET_ROWS))
    buckets = max(1, wide, -(-(size[1] or 0) // BUCKET_BYTES))
    order = F.struct(*_ORDER)
    least = rows.select(*_ORDER).repartitionByRange(buckets, *_ORDER).groupBy(F.spark_partition_id()).agg(F.min(order).alias("o"))
    lows = shared.written(least.agg(F.sort_array(F.collect_list("o")).alias("lows")).coalesce(1))
    # a constant of this query: one key for each bucket
    rows = rows.withColumn("order", order).withColumn("lows", lows.scalar()).withColumn("bucket", F.lit(0))
    for d in range(buckets.bit_length() - 1, -1, -1):  # binary search
        at = F.col("bucket") + (1 << d)
        rows = rows.withColumn("bucket", F.when(F.get("lows", at) <= F.col("order"), at).otherwise(F.col("bucket")))
    n_lows = F.size("lows")
    own = F.struct("bucket", F.lit(False).alias("halo"))
    sent_back = F.struct(F.pmod(F.col("bucket") + n_lows - 1, n_lows).alias("bucket"), F.lit(True).alias("halo"))
    is_first = F.get("lows", F.col("bucket")) == F.col("order")
    dest = F.explode(F.when(is_first, F.array(own, sent_back)).otherwise(F.array(own)))
    sent = rows.select("doc_id", "text", "n", "order", dest.alias("dest"))
    sent = sent.select("doc_id", "text", "n", "order", "dest.*").repartition(buckets, "bucket")
    # with doc_id and n in the order, all who read this read the same columns, and the texts are shuffled once
    by = Window.partitionBy("bucket").orderBy("halo", "order", "doc_id", "n")
    next_text = F.lead("text").over(by).alias("next_text")
    return sent.select("bucket", F.row_number().over(by).alias("place"), "doc_id", "text", "n", next_text, "halo")


def edited(text: str = "text", next_text: str = "next_text") -> Column:
    """The last floor(n / 2) code points of a text replaced by the first as many, or all, of the next."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col(next_text), F.lit(1), half))


def weighed(text: Column) -> Column:
    """Array of (term, w): the hash of each distinct word, and how often the text has it."""
    none = F.array(F.xxhash64(F.lit("")))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))

    def let(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def counted(s: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(s) - 1)
        firsts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def pairs(f: Column) -> Column:
            ends = F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(s)))
            return F.zip_with(f, ends, lambda a, z: F.struct(F.get(s, a).alias("term"), (z - a).alias("w")))

        return let(firsts, pairs)

    return let(hashes, lambda h: let(F.when(F.size(h) > 0, h).otherwise(none), counted))


def sampled(texts: DataFrame, keys: tuple[str, ...], samples: int = SAMPLES) -> DataFrame:
    """keys and values, the array of samples, of rows (keys, body); no shuffle if rows are dealt by one of the keys already."""
    r_table, c_table = _tables()
    terms = texts.select(*keys, F.explode(weighed(F.col("body"))).alias("t"))
    # under a condition the tables stay columns: as constants they would be copied into every use of them
    held = {"r_table": F.when(F.col("w") > 0, r_table), "c_table": F.when(F.col("w") > 0, c_table)}
    terms = terms.select(*keys, "t.term", "t.w").withColumns({"ln_w": F.log("w"), **held})
    runs = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // AT_ONCE) - 1))).alias("run")
    terms = terms.select("*", runs)
    several = range(min(AT_ONCE, samples))
    least = terms.groupBy(*keys, "run").agg(*(F.min(_sample(F.col("run") * AT_ONCE + j)).alias(f"s{j}") for j in several))
    mask = F.lit((1 << 31) - 1)
    values = F.array(*(F.col(f"s{j}").bitwiseAND(mask) for j in several))
    ordered = F.sort_array(F.collect_list(F.struct("run", values.alias("values"))))
    found = least.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda x: x.values)).alias("values"))
    return found.select(*keys, F.slice("values", 1, samples).alias("values"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def written_out(values: Column) -> Column:
    """Eight hex digits a sample."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, one row for each row of docs."""
    with shared.Scratch(docs.sparkSession) as tables:
        return shared.repeated(tables.keep(_fingerprints(docs, samples)), "n").drop("n", "repeat")


def _fingerprints(docs: DataFrame, samples: int) -> DataFrame:
    rows = _with_next(docs)
    plain = F.struct(F.lit(0).alias("side"), F.col("text").alias("body"))
    changed = F.struct(F.lit(1).alias("side"), edited().alias("body"))
    sides = rows.select("bucket", "place", F.explode(F.when(F.col("halo"), F.array(plain)).otherwise(F.array(plain, changed))).alias("s"))
    sides = sides.select("bucket", (F.col("place").cast("long") * 2 + F.col("s.side")).alias("slot"), "s.body")
    order = Window.partitionBy("bucket").orderBy("slot")
    found = sampled(sides, ("bucket", "slot"), samples)
    # the slots of a bucket are text, edited text, text, edited text, ..., and the text of the halo
    own, next_ = F.lead("values").over(order).alias("own"), F.lead("values", 2).over(order).alias("next")
    near = found.select("bucket", "slot", "values", own, next_).where("slot % 2 = 0 and next is not null")
    near = near.select(
        "bucket",
        (F.col("slot") / 2).cast("int").alias("place"),
        written_out(F.col("values")).alias("fingerprint"),
        written_out(F.col("own")).alias("edited_fingerprint"),
        likeness(F.col("values"), F.col("own"), samples).alias("near_edited"),
        likeness(F.col("values"), F.col("next"), samples).alias("near_next"),
    )
    told = rows.where("not halo").select("bucket", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited(), 256).alias("edited_sha256"), "n")
    out = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n")
    return told.join(near, ["bucket", "place"]).select(*out)
