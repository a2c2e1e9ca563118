"""Texts, dimension tables and profiles in; answers out.

No file fails a whole read: what cannot be read becomes a row with quality 0
and a warning.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType

from provara.operators import text

_PROOF = StructType([StructField(n, StringType()) for n in ("skill_id", "source", "kind", "where", "detail")])
_NAMES = ArrayType(StringType())
_REPO = StructType(
    [StructField(n, StringType()) for n in ("name", "description", "url")] + [StructField("stars", LongType()), StructField("pushed_at", StringType()), StructField("languages", _NAMES), StructField("manifests", _NAMES), StructField("readme_skills", _NAMES), StructField("code_skills", _NAMES)]
)
PROFILE = StructType(
    [StructField(n, StringType()) for n in ("source", "handle", "url", "status", "message")] + [StructField("fetched_at", DoubleType()), StructField("skills", MapType(StringType(), ArrayType(_PROOF))), StructField("repos", ArrayType(_REPO))]
)

# Shapes of accounts, and those that are no one's.
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?)"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/([A-Za-z0-9%-]{3,100})"
RESERVED = (
    "about", "features", "pricing", "enterprise", "explore", "topics", "collections",
    "trending", "events", "sponsors", "readme", "orgs", "settings", "marketplace",
    "apps", "login", "join", "search", "new", "notifications", "issues", "pulls",
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's stem), path, text, quality, warnings of every file. Files that are not UTF-8 text, and empty ones, stay with quality 0."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    # Spark's scan leaves out files without bytes; the listing, which is on the driver anyway, has them.
    listed = spark.createDataFrame([(unquote(p),) for p in found.inputFiles()], "listed string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    files = listed.join(found, plain(F.col("listed")) == plain(F.col("path")), "left").select(F.coalesce("path", "listed").alias("path"), F.when(F.col("path").isNull(), F.lit(b"")).otherwise(F.col("content")).alias("content"))
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")) & ~F.startswith(F.hex(F.substring("content", 1, 4)), F.lit("25504446")), F.col("content").cast("string"))
    docs = files.select(stem.alias("doc_id"), "path", body.alias("raw"))
    t = docs.select("doc_id", "path", text.repaired(F.col("raw")).alias("text"), F.col("raw").isNull().alias("broken"))
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 25))
    warnings = F.filter(F.array(F.when(F.col("broken"), "not readable as text"), F.when(~F.col("broken") & ~text.usable(F.col("text")), "little usable text")), lambda w: w.isNotNull())
    return t.select("doc_id", "path", "text", F.when(F.col("broken"), 0.0).otherwise(text.parse_quality(F.col("text"), F.lit(0), n, F.lit(False))).alias("quality"), warnings.alias("warnings"))


def read_map(spark: SparkSession, path: str, value: str = "string", at: str | None = None) -> DataFrame:
    """key and value of a JSON object (or of the object under one of its keys); keys that start with an underscore are comments."""
    kind = f"map<string, {value}>"
    whole = spark.read.text(path, wholetext=True)
    found = F.from_json("value", f"struct<`{at}`: {kind}>")[at] if at else F.from_json("value", kind)
    return whole.select(F.explode(found).alias("key", "value")).where(~F.startswith("key", F.lit("_")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def proofs(profiles: DataFrame) -> DataFrame:
    """handle, skill and what each proof is, one of each skill and kind."""
    p = profiles.select("source", "handle", F.explode("skills").alias("skill", "found")).select("source", "handle", "skill", F.explode("found").alias("e"))
    return p.groupBy("source", "handle", "skill", F.col("e.kind").alias("kind")).agg(F.min(F.struct("e.where", "e.detail")).alias("e")).select("source", "handle", "skill", "kind", "e.where", "e.detail")


def repositories(profiles: DataFrame) -> DataFrame:
    """One row for each repository, with the skills that only its README claims."""
    r = profiles.select("handle", F.explode("repos").alias("r")).select("handle", "r.*")
    return r.withColumn("readme_only", F.array_sort(F.array_except(F.coalesce("readme_skills", F.array().cast("array<string>")), F.coalesce("code_skills", F.array().cast("array<string>")))))


def best_repository(repositories: DataFrame) -> DataFrame:
    return repositories.groupBy("handle").agg(F.max(F.struct(F.size("code_skills").alias("n"), "stars", "name")).alias("b")).select("handle", F.col("b.name").alias("name"))


def handles(raw: Column) -> Column:
    """struct(github, linkedin): the first account of each in a text that is not redacted."""
    hub = F.filter(F.regexp_extract_all(raw, F.lit(GITHUB), F.lit(1)), lambda h: ~F.lower(h).isin(*RESERVED))
    return F.struct(F.get(hub, F.lit(0)).alias("github"), F.get(F.regexp_extract_all(raw, F.lit(LINKEDIN), F.lit(1)), F.lit(0)).alias("linkedin"))


def dependencies(name: Column, body: Column) -> Column:
    """Names of packages in a manifest, by its file name: keys of package.json, line starts of requirement lists and pyproject.toml, every bare token of other kinds; none of files that are no manifest."""
    low, none = F.lower(name), F.array().cast("array<string>")
    groups = ("dependencies", "devDependencies", "peerDependencies")
    parsed = F.from_json(body, "struct<" + ", ".join(f"{g}: map<string, string>" for g in groups) + ">")
    keys = F.concat(*(F.coalesce(F.map_keys(parsed[g]), none) for g in groups))
    lines = F.transform(F.split(body, "\r?\n"), lambda x: F.regexp_replace(F.trim(F.substring_index(x, "#", 1)), r'^[",]+', ""))
    starts = F.transform(F.filter(lines, lambda x: x.rlike(r"^[A-Za-z0-9]")), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    tokens = F.regexp_extract_all(body, F.lit(r"([A-Za-z][A-Za-z0-9._/-]{2,60})"), F.lit(1))
    found = F.when(low == "package.json", keys).when(low.isin("requirements.txt", "pipfile", "pyproject.toml"), starts).when(low.isin("pom.xml", "build.gradle", "composer.json", "gemfile", "cargo.toml", "go.mod"), tokens)
    return F.array_sort(F.array_distinct(F.coalesce(found, none)))


def main_languages(repositories: DataFrame, share: float = 0.05) -> DataFrame:
    """handle, name, language of at least the share of bytes; languages: map of bytes."""
    x = repositories.select("handle", "name", "languages", F.aggregate(F.map_values("languages"), F.lit(0).cast("double"), lambda s, v: s + v).alias("total"))
    return x.select("handle", "name", "total", F.explode("languages").alias("language", "bytes")).where(F.col("bytes") >= share * F.col("total")).select("handle", "name", "language")


def exported(handle: str, named: DataFrame, packages: DataFrame, languages: DataFrame) -> DataFrame:
    """A list of names (name) as proofs of one account: by package, else language, else the name itself."""
    k = F.lower(F.trim("name"))
    rows = named.select("name", k.alias("k")).join(F.broadcast(packages.select(F.lower("key").alias("k"), F.col("value").alias("p"))), "k", "left").join(F.broadcast(languages.select(F.lower("key").alias("k"), F.col("value").alias("l"))), "k", "left")
    return rows.select(F.lit(handle).alias("handle"), F.coalesce("p", "l", "k").alias("skill"), F.lit("export").alias("kind")).distinct()


def write_cache(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").partitionBy("source").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_json(df: DataFrame, **nested: tuple[DataFrame, str]) -> DataFrame:
    """One JSON answer a document: its row, with the rows of each nested frame (frame, column to order by) as a list."""
    out = df
    for name, (frame, order) in nested.items():
        inner = [c for c in frame.columns if c != "doc_id"]
        lists = frame.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in inner if c != order]))).alias(name))
        out = out.join(lists, "doc_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out.select("doc_id", F.to_json(F.struct("*")).alias("json"))
