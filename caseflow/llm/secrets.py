"""Secret scans: base patterns, and multipart credentials whose weak parts count only together.

A credential often has several parts: an access identifier, a secret, an endpoint. Alone, a long token or
a URL means nothing and is not reported. Parts of all documents are joined on document and position: a
weak part is reported if a complementary one, weak or of the base patterns, that has no character in
common with it begins within ``SCOPE`` code points. A weak part inside another part belongs to that one: the
path of a URL is no secret beside the URL. The join is one of intervals cut into bins of that width. A
bin holds the parts of a class that begin in it, so no more than its code points, and a part looks into
its own bin and the next on both sides.

Patterns look at a character a bounded number of times, at the start of its run only, and spans are
compared in sorted order, so a text takes time in proportion to its length and its parts, however long it
is. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import digest, stored, table, texts
from caseflow.llm.spans import SPAN, listed, of_kind, spans

SCOPE = 400

ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of at least 32: shorter runs fail anyway.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"

#: Weak parts. An identifier: capitals and digits mixed; a secret: 20 characters and more with a digit, a
#: small and a capital letter; an endpoint: a URL, or a host with its port.
WEAK_ID = r"(?<![A-Za-z0-9+/_=-])(?=[A-Z]*+[0-9])(?=[0-9]*+[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9+/_=-])"
#: The length first; then a digit, a small and a capital letter, each sought in the run's own characters.
WEAK_SECRET = (
    r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*+[0-9])"
    r"(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+"
)
#: Schemes of up to 64 characters; hosts as the domain name system allows: labels of 63, 127 of them.
ENDPOINT = (
    r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{0,63}://[^\x20\x09-\x0D"'<>]+|"""
    r"(?<![A-Za-z0-9.-])[A-Za-z0-9][A-Za-z0-9-]{0,62}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+:[0-9]{2,5}(?![0-9])"
)


@dataclass(frozen=True)
class Part:
    """A pattern and the class of credential part that it finds; ``base`` ones are always reported."""

    kind: str
    pattern: str
    group: str
    base: bool


PARTS = (
    Part("assign", ASSIGN, "secret", True),
    Part("access", ACCESS, "id", True),
    Part("hex", HEX, "secret", True),
    Part("weak_id", WEAK_ID, "id", False),
    Part("weak_secret", WEAK_SECRET, "secret", False),
    Part("endpoint", ENDPOINT, "endpoint", False),
)
#: Which classes complete which.
COMPLEMENTS = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}


def _passes(text: Column, part: Part, matches: Column) -> Column:
    """Whether each match is long enough."""
    if part.kind == "assign":
        values = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(2))
        return F.transform(values, lambda v: F.length(v) >= 8)
    least = {"access": 16, "hex": 32}.get(part.kind, 1)
    return F.transform(matches, lambda m: F.length(m) >= least)


def parts_found(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, key) with ``base`` and ``weak``: sorted arrays of spans; without text."""
    text = F.col("text")

    def all_of(base: bool) -> Column:
        own = [
            spans(text, p.pattern, p.kind, rank, lambda matches, p=p: _passes(text, p, matches))
            for rank, p in enumerate(PARTS)
            if p.base == base
        ]
        return F.array_sort(F.concat(*own))

    return docs.select("doc_id", "key", all_of(True).alias("base"), all_of(False).alias("weak"))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, linked): the weak spans of a document with a complement that starts within ``scope``.

    The complement has no character in common with the part. Weak spans inside another span, as the value
    of an assignment or the path of a URL, are that span's; of equal ones the first kind stays.
    """
    group = F.create_map(*[F.lit(x) for p in PARTS for x in (p.kind, p.group)])
    base_kinds = [p.kind for p in PARTS if p.base]
    is_base = F.col("part.kind").isin(*base_kinds)
    # Of the spans that begin no later, the one that reaches furthest holds this one if any does.
    earlier = Window.partitionBy("key").orderBy("part.start", F.col("part.end").desc(), "part.rank")
    reach = F.max("part.end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    every = (
        parts.where(F.size("weak") > 0)
        .select("key", F.explode(F.concat("base", "weak")).alias("part"))
        .distinct()
        .withColumn("reach", reach)
        .where(is_base | F.col("reach").isNull() | (F.col("reach") < F.col("part.end")))
        .select(
            "key",
            "part",
            group[F.col("part.kind")].alias("group"),
            F.floor(F.col("part.start") / scope).alias("bin"),
        )
    )
    bins = every.groupBy("key", "bin", "group").agg(
        F.collect_list(F.struct("part.start", "part.end")).alias("others")
    )
    near = bins.select(
        "key", F.col("group").alias("other"), "others", F.explode(F.sequence(F.col("bin") - 1, F.col("bin") + 1)).alias("bin")
    )
    complete = reduce(
        lambda a, b: a | b,
        [(F.col("group") == g) & F.col("other").isin(*others) for g, others in COMPLEMENTS.items()],
    )
    start, end = F.col("part.start"), F.col("part.end")
    close = F.exists(
        "others",
        lambda o: (F.abs(start - o["start"]) <= scope) & ((o["start"] >= end) | (o["end"] <= start)),
    )
    return (
        every.where(~is_base)
        .join(near, ["key", "bin"])
        .where(complete & close)
        .groupBy("key")
        .agg(F.array_sort(F.collect_set("part")).alias("linked"))
    )


def secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, base, linked, spans) for each document: arrays of spans.

    ``base`` are those of the base patterns; ``linked`` weak parts with a complement; ``spans`` both,
    sorted. A null or empty text has none, and a text of any length is read whole. Repeated rows get the same
    spans each; a null id stays null; an empty table gives no rows; further columns are ignored.
    """
    rows = texts(docs, text_column=text_column).withColumn("key", F.xxhash64("doc_id", "text"))
    parts = stored(parts_found(rows))
    joined = parts.join(linked_parts(parts), "key", "left").withColumn(
        "linked", F.coalesce("linked", F.array().cast(SPAN))
    )
    both = F.array_sort(F.concat("base", "linked"))
    return joined.select("doc_id", "base", "linked", both.alias("spans"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        digest(listed(F.col("base"))).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
