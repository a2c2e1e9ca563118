"""What a client may ask of one analysed pool: a function for each question, each a frame (or a value) over the pool's frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provara.operators import fusion, judgement, redaction, taxonomy, text, views


class NoPool(LookupError):
    """A question that needs a pool, before there is one."""


def moved(p: DataFrame, before: float, after: float) -> DataFrame:
    """Rank of each document at two blends of the channels."""
    one, two = (fusion.ranked(p, a).select("doc_id", F.col("rank").alias(n)) for a, n in ((before, "rank"), (after, "then_rank")))
    return one.join(two, "doc_id").withColumn("moved", F.col("rank") - F.col("then_rank"))


@dataclass
class Service:
    """cells and subs as in operators/fusion.py; verdicts and support as in operators/judgement.py; skills, concepts and pins as in operators/taxonomy.py."""

    cells: DataFrame | None = None
    subs: DataFrame | None = None
    names: DataFrame | None = None
    skills: DataFrame | None = None
    concepts: DataFrame | None = None
    pins: DataFrame | None = None

    def analyze(self, cells: DataFrame, subs: DataFrame, verdicts: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
        """Takes a pool, with its multipliers where they are known, and ranks it."""
        if verdicts is not None and support is not None:
            cells = judgement.adjusted(cells, judgement.adjustments(verdicts, support))
        self.cells, self.subs = cells, subs
        return self.rank()

    def _primitives(self) -> DataFrame:
        if self.cells is None or self.subs is None:
            raise NoPool("analyze a pool first")
        return fusion.primitives(self.cells, self.subs)

    def health(self) -> dict:
        return {"status": "ok", "pool": 0 if self.subs is None else self.subs.count()}

    def rank(self, alpha: float = 0.5, gate: bool = False, blind: bool = False) -> DataFrame:
        r = fusion.ranked(self._primitives(), alpha, gate)
        if blind:
            return r.join(redaction.aliases(self.subs.select("doc_id"), "doc_id"), "doc_id")
        return r if self.names is None else r.join(self.names, "doc_id", "left")

    def feedback(self, shortlist: int = 5, limit: int = 20, doc_id: int | None = None) -> DataFrame:
        """Steps worth taking of those below the shortlist, or of one document."""
        if not (1 <= shortlist <= 50 and 1 <= limit <= 100):
            raise ValueError("shortlist is 1 to 50, limit 1 to 100")
        p = self._primitives()
        steps = views.roadmap(self.cells, p)
        if doc_id is not None:
            return steps.where(F.col("doc_id") == doc_id)
        return steps.join(F.broadcast(views.rejected(fusion.ranked(p), shortlist, limit).select("doc_id", "short")), "doc_id")

    def chat(self, question: str, alpha: float = 0.5, gate: bool = False) -> tuple[str, DataFrame]:
        """The question's intent and the rows that answer it. Documents are named by their ids, skills by theirs."""
        spark = self._primitives().sparkSession
        asked = spark.range(1).select(text.intent(F.lit(question)).alias("i"), views.top_asked(F.lit(question), F.lit(self.subs.count())).alias("n")).first()
        ranked = self.rank(alpha, gate)
        ids = self.subs.where(F.rlike(F.lit(question), F.concat(F.lit(r"(^|[^A-Za-z0-9])\Q"), F.col("doc_id").cast("string"), F.lit(r"\E([^A-Za-z0-9]|$)")))).select("doc_id", F.instr(F.lit(question), F.col("doc_id").cast("string")).alias("at"))
        if asked.i == "TOP_N":
            return asked.i, ranked.where(F.col("rank") <= asked.n)
        if asked.i == "WHO_HAS":
            named = self.cells.select("skill").distinct().where(F.contains(F.lower(F.lit(question)), F.lower("skill"))).orderBy(F.desc(F.length("skill"))).limit(1)
            return asked.i, ranked.join(self.cells.join(F.broadcast(named), "skill").where(F.col("status").isin("MATCHED", "INFERRED")).select("doc_id", "skill", "status"), "doc_id")
        if asked.i == "MISSING":
            return asked.i, views.missing(self.cells).join(F.broadcast(ids.select("doc_id")), "doc_id")
        if asked.i == "COMPARE":
            two = [r.doc_id for r in ids.orderBy("at").limit(2).collect()]
            return asked.i, fusion.compared(self.cells, *two) if len(two) == 2 else ranked.limit(0)
        return asked.i, views.explained(self.cells).join(F.broadcast(ids.select("doc_id")), "doc_id")

    def taxonomy(self, skill: str) -> DataFrame:
        """Nearest skills of one."""
        return taxonomy.neighbours(taxonomy.relations(self.skills, self.concepts)).where(F.col("a") == skill)

    def relate(self, a: str, b: str) -> DataFrame:
        """Kind of relation from a to b, and the weeks it takes one who holds a firmly."""
        pairs = taxonomy.relations(self.skills, self.concepts)
        row = lambda s: self.skills.where(F.col("skill") == s).select(F.lit(0).alias("doc_id"), "skill", F.lit(1.0).alias("strength"))
        walk = taxonomy.bridges(row(b).select("doc_id", "skill"), row(a), pairs, self.skills, self.pins)
        return walk.join(pairs.where(F.col("a") == a).select(F.col("b").alias("skill"), F.col("kind").alias("relation"), "steps"), "skill")
