"""Identity out of texts: ordered patterns, protected spans, greedy choice of spans, placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from provara.operators.fusion import placed

# Category, pattern, placeholder, in order; years inside EDUCATION; addresses of code, which stay.
CODE_URL = r"(?:https?://)?(?:www\.)?github\.com/[\w.-]+(?:/[\w.-]+)?/?"
YEAR_SPAN = r"\b(19[89]\d|20[0-4]\d)\s*[-–—to]+\s*((?:19[89]\d|20[0-4]\d)|present)\b"
CATEGORIES = (
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b", 0, "[EMAIL]"),
    ("linkedin", r"(?:https?://)?(?:www\.)?linkedin\.com/in/[\w%-]+/?", re.I, "[LINKEDIN]"),
    ("personal", r"\b(?:date of birth|d\.?o\.?b\.?|nationality|marital status|religion|caste|gender|sex|age)\s*:?\s*[^\n]{0,40}", re.I, "[PERSONAL DETAIL]"),
    ("address", r"\b\d{1,4}[\w\s.,-]{4,40}\b(?:street|road|rd\.?|lane|ln\.?|avenue|ave\.?|nagar|colony|sector|block|apartment|flat|house)\b[^\n]{0,30}", re.I, "[ADDRESS]"),
    ("institution", r"\b(?:[A-Z][\w&.'-]*\s+){0,4}(?:University|Universität|Institute of Technology|Institute|College|Polytechnic|School of Engineering|Academy|Vidyalaya|Vidyapeeth)(?:\s+(?:of|at|for)\s+(?:[A-Z][\w&.'-]*\s*){1,3})?", re.I, "[INSTITUTION]"),
    ("institution", r"\b(?:IIT|NIT|BITS|IIIT|VIT|SRM|MIT|BMS|RVCE|PES|MSRIT|DTU|NSUT|VJTI|COEP)(?:[\s-]+[A-Z][a-z]+)?\b", 0, "[INSTITUTION]"),
    ("grad_year", r"\b(?:class of|batch of|graduat\w*(?:\s+in)?|expected(?:\s+graduation)?)\s*:?\s*(19[89]\d|20[0-4]\d)\b", re.I, "[GRADUATION YEAR]"),
    ("gender", r"\b(?:male|female|non[- ]binary|transgender|he/him|she/her|they/them|mr\.?|mrs\.?|ms\.?|miss)\b", re.I, "[GENDER MARKER]"),
    ("phone", r"(?<![\w])(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,5}[\s.-]?\d{3,5}(?![\w])", 0, "[PHONE]"),
    ("pincode", r"\b\d{6}\b", 0, "[POSTCODE]"),
)
PLACEHOLDERS = {kind: shown for kind, _, _, shown in CATEGORIES} | {"name": "[CANDIDATE]"}
KINDS = tuple(dict.fromkeys(kind for kind, *_ in CATEGORIES)) + ("name",)

SCHEMA = StructType([StructField("text", StringType()), StructField("spans", ArrayType(StructType([StructField("category", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])))])
_TYPE = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("category", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
# of what a match of a pattern must hold one, in small letters; texts without are not searched by the pattern itself
MUST_HOLD = {
    CATEGORIES[0][1]: ("@",),
    CATEGORIES[1][1]: ("linkedin.com/in/",),
    CATEGORIES[4][1]: ("universit", "institute", "college", "polytechnic", "school of engineering", "academy", "vidyalaya", "vidyapeeth"),
}
_CODE_HOST = "github.com/"
#: Letters that patterns take for i, s and k but lower() does not.
_ODD = "İıſK"
_COMPILED = [(kind, re.compile(pattern, flags), MUST_HOLD.get(pattern, ("",))) for kind, pattern, flags, _ in CATEGORIES]
_CODE_URL, _YEAR_SPAN = re.compile(CODE_URL, re.I), re.compile(YEAR_SPAN, re.I)


def _candidates(text: str, name: str | None, education: tuple[int, int] | None) -> Iterator[tuple[int, int, str, bool]]:
    """start, end, kind and whether the span may lie in a protected one."""
    if education:
        low, high = education
        yield from ((low + m.start(), low + m.end(), "grad_year", True) for m in _YEAR_SPAN.finditer(text[low:high]))
    for part in filter(lambda p: len(p) >= 3, [name, *name.split()] if name else []):
        yield from ((*m.span(), "name", False) for m in re.finditer(rf"(?<!\w){re.escape(part)}(?!\w)", text, re.I))
    small, odd = text.lower(), any(x in text for x in _ODD)
    for kind, pattern, held in _COMPILED:
        if odd or any(h in small for h in held):
            yield from ((*m.span(), kind, False) for m in pattern.finditer(text))


def redact_text(text: str | None, name: str | None = None, education: tuple[int, int] | None = None) -> dict:
    """The text with placeholders, and the spans of the given text that they stand for: the earliest first, of equal starts the longest."""
    text = text or ""
    shelter = [m.span() for m in _CODE_URL.finditer(text)] if _CODE_HOST in text.lower() or any(x in text for x in _ODD) else []
    hits = [(a, b, kind) for a, b, kind, free in _candidates(text, name, education) if free or not any(a < d and c < b for c, d in shelter)]
    hits.sort(key=lambda h: (h[0], -h[1]))
    out, spans, done = [], [], 0
    for a, b, kind in hits:
        if a >= done:
            out += (text[done:a], PLACEHOLDERS[kind])
            spans.append({"category": kind, "start": a, "end": b})
            done = b
    return {"text": "".join([*out, text[done:]]), "spans": spans}


@F.arrow_udf(SCHEMA)
def _redacted(texts: pa.Array, names: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), names.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)
    return pa.array([redact_text(t, n, None if a is None or z is None else (a, z)) for t, n, a, z in rows], _TYPE)


def redacted(text: Column, name: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """struct(text, spans). start and end bound the EDUCATION section, inside which spans of years go too. A null text counts as empty."""
    none = F.lit(None)
    return _redacted(text, none.cast("string") if name is None else name, (none if start is None else start).cast("int"), (none if end is None else end).cast("int"))


def masked(text: Column, name: Column | None = None) -> Column:
    """For display: addresses of code go as well."""
    shown = F.when(text.rlike(r"(?Ui)github\.com/"), F.regexp_replace(text, f"(?Ui){CODE_URL}", "[PORTFOLIO]")).otherwise(text)
    return redacted(shown, name)["text"]


def audit(spans: Column) -> Column:
    """'2 email, 1 phone', most frequent first."""
    kinds = F.transform(spans, lambda s: s["category"])
    counts = F.transform(F.array_distinct(kinds), lambda k: F.struct((-F.size(F.filter(kinds, lambda x: x == k))).alias("n"), k.alias("k")))
    return F.array_join(F.transform(F.array_sort(counts), lambda c: F.concat_ws(" ", (-c["n"]).cast("string"), c["k"])), ", ")


def aliases(pool: DataFrame, order: str) -> DataFrame:
    """pool with 'Candidate NN' by position in the given order, whose values are each other's unlike."""
    alias = F.format_string("Candidate %02d", F.col("_at"))
    return placed(pool, "_at", F.col(order)).withColumn("alias", alias).drop("_at")
