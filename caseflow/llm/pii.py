"""Personal data: base patterns, and terms that reveal a found entity by co-occurrence.

Information content decides what else must go. An entity is a value the base patterns find, such as one
e-mail address; its information content is -log p over the documents of the corpus. A term in a document
that holds it reveals it as far as their pointwise mutual information reaches that content: PMI(t; c) = IC(c) means
that the term occurs with this entity only. Terms with PMI >= IC / ALPHA are added, wherever they stand in
a document that holds the entity. Counts cover every document. Every entity is judged, however rare:
p(c | t) enters with its lower bound at even odds, so that what few distinct texts say counts less, and
copies of a text say nothing new.

An added term is generalised where the corpus allows it: its classes are the words that share its first
letters, in LEVELS from narrow to wide, and the narrowest class is taken that stands in so many documents that it
could not reveal any entity of the document even if all documents of that entity held it. A term
without such a class is removed.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.common import digest, stored, table, texts
from caseflow.llm.spans import SPAN, found, greatest_before, let, listed, of_kind, spans

#: Disclosure threshold: a term may carry at most 1 / ALPHA of an entity's information content.
ALPHA = 1.1
#: How many first letters the classes of a term keep; a class holds longer words only.
LEVELS = (2, 3, 4, 5, 6, 8, 12)

# Each pattern is the plain one written so that it needs no backtracking: a match starts where its first
# run starts, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<![\p{L}\p{M}0-9])\p{L}{4,40}(?![\p{L}\p{M}0-9])"
KINDS = (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))
TERM_RANKS = {"term_removed": len(KINDS), "term_generalised": len(KINDS) + 1}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: every second one from the right is doubled."""
    size = F.length(digits)

    def added(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((size - at) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), added) % 10 == 0


def _passes(kind: str, matches: Column) -> Column:
    def test(match: Column) -> Column:
        if kind == "ip":
            parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
            return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
        digits = _digits(match)
        if kind == "card":
            fits = F.length(digits).between(14, 19)
            return F.when(fits, _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(digits).between(10, 15)
        return F.lit(True)

    return F.transform(matches, test)


def base_spans(text: Column, frame: DataFrame) -> DataFrame:
    """``frame`` with ``base``, the sorted spans of the base patterns in ``text``."""
    own = [
        spans(text, pattern, kind, rank, lambda matches, kind=kind: _passes(kind, matches))
        for rank, (kind, pattern) in enumerate(KINDS)
    ]
    return frame.withColumn("base", F.array_sort(F.concat(*own)))


def mentions(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text, key) to (doc_id, key, base, entities, text), the text only beside base spans."""

    def entity(span: Column) -> Column:
        size = (span["end"] - span["start"]).cast("int")
        return F.xxhash64(span["kind"], F.substring("text", span["start"].cast("int") + 1, size))

    return base_spans(F.col("text"), rows).select(
        "doc_id",
        "key",
        "base",
        F.array_distinct(F.transform("base", entity)).alias("entities"),
        F.when(F.size("base") > 0, F.col("text")).alias("text"),
    )


def holders(found_rows: DataFrame) -> DataFrame:
    """(key, docs, text, base, entities): the documents that hold entities, repeated rows once with their number."""
    return (
        found_rows.where(F.size("base") > 0)
        .groupBy("key")
        .agg(F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("text", "base", "entities")])
    )


def circles(held: DataFrame) -> DataFrame:
    """(key, text_hash, docs, circle, n_entity): which entities each document holds.

    Entities of exactly the same documents have the same counts with every term; they are one circle.
    """
    each = held.select(
        "key", F.xxhash64("text").alias("text_hash"), "docs", F.explode("entities").alias("entity")
    )
    marks = [F.bit_xor(F.xxhash64("key", F.lit(salt))) for salt in (0, 1)]
    alike = each.groupBy("entity").agg(
        F.sum("docs").alias("n_entity"), F.xxhash64(F.count("*"), *marks).alias("circle")
    )
    return each.join(alike, "entity").drop("entity").distinct()


def occurrences(held: DataFrame) -> DataFrame:
    """(key, term, start, end): every whole word of the documents."""
    text = F.col("text")
    places = spans(text, TERM, "term", 0, lambda m: F.transform(m, lambda _: F.lit(True)))
    words = held.select("key", F.explode(F.arrays_zip(places.alias("at"), found(text, TERM).alias("m"))).alias("w"))
    return words.select(
        "key", F.lower("w.m").alias("term"), F.col("w.at.start").alias("start"), F.col("w.at.end").alias("end")
    )


def apart(words: DataFrame, held: DataFrame) -> DataFrame:
    """The ``words`` (key, start, end, ...) that share no character with a base span of their document.

    A merge of both by place: a base span that starts before or with the word ends before it, and the next one
    starts after it.
    """
    own = words.columns
    base = held.join(words.select("key").distinct(), "key", "left_semi").select("key", F.explode("base").alias("b"))
    both = words.withColumn("base", F.lit(False)).unionByName(
        base.select("key", "b.start", "b.end", F.lit(True).alias("base")), allowMissingColumns=True
    )
    place = Window.partitionBy("key").orderBy("start", F.col("base").desc(), "end")
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    later = place.rowsBetween(1, Window.unboundedFollowing)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(earlier)
    next_start = F.first(F.when(F.col("base"), F.col("start")), ignorenulls=True).over(later)
    return (
        both.withColumn("reach", F.coalesce(reach, F.lit(0)))
        .withColumn("next", F.coalesce(next_start, F.col("end")))
        .where(~F.col("base") & (F.col("reach") <= F.col("start")) & (F.col("next") >= F.col("end")))
        .select(*own)
    )


def distinct_words(text: Column) -> Column:
    return F.array_distinct(F.transform(found(text, TERM), F.lower))


def wider(words: Column, letters: int) -> Column:
    """The classes of ``letters`` first letters of an array of words; no word ends in an asterisk."""
    longer = F.filter(words, lambda w: F.length(w) > letters)
    return F.array_distinct(F.transform(longer, lambda w: F.concat(F.substring(w, 1, letters), F.lit("*"))))


def document_counts(rows: DataFrame) -> DataFrame:
    """(term, n): in how many documents each word, and each class of words, occurs."""

    def names(words: Column) -> Column:
        return F.concat(words, *[wider(words, letters) for letters in LEVELS])

    every = let(distinct_words(F.col("text")), names)
    return rows.select(F.explode(every).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def likely(both: Column, n: Column, texts_: Column) -> Column:
    """Lower bound at even odds of p(c | t), observed as ``both`` of ``n`` documents in ``texts_`` distinct ones.

    It is the median of Beta(k, n - k + 1), (k - 1/3) / (n + 1/3) to a hundredth, where copies are left out of k
    and, in proportion, of n: one meeting of one gives 1/2, four of four 0.85.
    """
    return (texts_ - 1 / 3) / (texts_ * n / both + 1 / 3)


def most(n_entity: Column, total: int, alpha: float) -> Column:
    """In how many documents a term may occur that reveals an entity of ``n_entity``, if all of them hold it."""
    return n_entity * F.pow(float(total) / n_entity, F.lit(1 - 1 / alpha)) * (1 + 1e-9)


def disclosing(counts: DataFrame, total: int, held: DataFrame, around: DataFrame, alpha: float) -> DataFrame:
    """(key, term): for each document the words that carry over 1 / alpha of the content of an entity in it.

    The share carried is PMI(t; c) / IC(c) = 1 + log p(c | t) / IC(c), with the lower bound of p(c | t). Both
    counts are of documents, wherever the word stands. A word of so many documents that it could not pass
    if all those of the entity had it is left out first.
    """
    largest = around.agg(F.max("n_entity")).first()[0] or 0
    rare = counts.where(F.col("n") <= most(F.lit(float(max(1, largest))), total, alpha))
    words = held.select("key", F.explode(distinct_words(F.col("text"))).alias("term"))
    met = stored(
        words.join(rare, "term")
        .join(around, "key")
        .where(F.col("n") <= most(F.col("n_entity"), total, alpha))
    )
    content = F.log(F.lit(float(total)) / F.col("n_entity"))
    bound = 1 + F.log(likely(F.col("both"), F.col("n"), F.col("texts"))) / content
    revealed = (
        met.groupBy("circle", "term", "n", "n_entity", "text_hash")
        .agg(F.sum("docs").alias("both"))
        .groupBy("circle", "term", "n", "n_entity")
        .agg(F.sum("both").alias("both"), F.count("*").alias("texts"))
        .where((content > 0) & (bound >= 1 / alpha))
        .select("circle", "term")
    )
    return met.select("key", "circle", "term").join(revealed, ["circle", "term"]).select("key", "term").distinct()


def generalised(
    terms: DataFrame, counts: DataFrame, total: int, around: DataFrame, alpha: float
) -> DataFrame:
    """(key, term, label): ``terms`` with the narrowest class that is safe in their document, else null.

    A class is safe if it stands in more documents than a term that reveals the most frequent entity of the
    document could, which holds for the rarer ones all the more. It is chosen once for each term and
    frequency, in a table stored before it meets the documents.
    """
    needs = around.groupBy("key").agg(F.max("n_entity").alias("need"))
    asked = stored(terms.join(needs, "key"))
    names = F.concat(*[wider(F.array("term"), letters) for letters in LEVELS])
    chosen = stored(
        asked.select("term", "need")
        .distinct()
        .withColumn("label", F.explode(names))
        .join(counts.select(F.col("term").alias("label"), "n"), "label")
        .where(F.col("n") > most(F.col("need"), total, alpha))
        .groupBy("term", "need")
        .agg(F.max_by("label", F.length("label")).alias("label"))
    )
    return asked.join(chosen, ["term", "need"], "left").select("key", "term", "label")


#: What stands for a base span in a sanitised text; a removed term leaves nothing, a generalised one its class.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
LABELLED = SPAN.replace("kind:string", "kind:string,label:string")


def found_personal_data(docs: DataFrame, text_column: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, key, base, added, spans, labels) for each document: arrays of spans, and what stands for each of ``spans``.

    ``key`` is a hash of id and text. A null or empty text has no spans, a text of any length is read whole.
    Repeated rows get the same spans each; a null id stays null; an empty table gives no rows; further
    columns are ignored.
    """
    rows = texts(docs, text_column=text_column).withColumn("key", F.xxhash64("doc_id", "text"))
    found_rows = stored(mentions(rows))
    held = stored(holders(found_rows))
    around = stored(circles(held))
    total, counts = max(2, rows.count()), stored(document_counts(rows))
    terms = disclosing(counts, total, held, around, alpha)
    revealed = stored(generalised(terms, counts, total, around, alpha))
    kind = F.when(F.col("label").isNull(), "term_removed").otherwise("term_generalised")
    rank = F.create_map(*[F.lit(x) for pair in TERM_RANKS.items() for x in pair])
    marked = occurrences(held.join(revealed.select("key").distinct(), "key", "left_semi")).join(
        revealed, ["key", "term"]
    )
    added = (
        apart(stored(marked), held)
        .withColumn("kind", kind)
        .withColumn("rank", rank[F.col("kind")])
        .select("key", F.struct("start", "rank", "end", "kind", F.coalesce("label", F.lit("")).alias("label")).alias("span"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("span")).cast(LABELLED).alias("added"))
    )
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    named = F.transform("base", lambda s: s.withField("label", label[s["kind"]])).cast(LABELLED)
    every = F.array_sort(F.concat(named, F.coalesce("added", F.array().cast(LABELLED))))
    return (
        found_rows.select("doc_id", "key", "base")
        .join(added, "key", "left")
        .withColumn("every", every)
        .select(
            "doc_id",
            "key",
            "base",
            F.transform(F.coalesce("added", F.array().cast(LABELLED)), lambda s: s.dropFields("label")).alias("added"),
            F.transform("every", lambda s: s.dropFields("label")).cast(SPAN).alias("spans"),
            F.transform("every", lambda s: s["label"]).alias("labels"),
        )
    )


def rewritten(text: Column, spans_: Column, labels: Column) -> Column:
    """``text`` with sorted spans replaced by their labels; a span that starts inside an earlier one goes with it."""

    def piece(span: Column, before: Column, label: Column) -> Column:
        gap = F.substring(text, before.cast("int") + 1, (span["start"] - before).cast("int"))
        return F.when(span["start"] >= before, F.concat(gap, label)).otherwise(F.lit(""))

    ends = F.transform(spans_, lambda s: s["end"])
    steps = F.arrays_zip(spans_.alias("span"), greatest_before(ends).alias("before"), labels.alias("label"))
    pieces = F.transform(steps, lambda r: piece(r["span"], r["before"], r["label"]))
    rest = F.substring(text, F.array_max(ends).cast("int") + 1, F.length(text))
    return F.when(F.size(spans_) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def sanitised(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``docs`` with the spans found replaced in the text; the other columns and a null text stay.

    Only the rows with spans are joined with the texts. An empty text stays empty, texts of any length are
    read whole, of overlapping spans the first is replaced and the others up to their ends; repeated rows
    are replaced alike, and an empty table gives no rows.
    """
    spans_found = found_personal_data(docs, text_column)
    marked = stored(
        spans_found.where(F.size("spans") > 0).select("key", "spans", "labels").dropDuplicates(["key"])
    )
    carried = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.xxhash64(
            docs[id_column].cast("long"), F.coalesce(docs[text_column].cast("string"), F.lit(""))
        ).alias("key"),
    )
    text = F.col(f"row.`{text_column}`")
    new = F.when(F.col("spans").isNull(), text).otherwise(rewritten(text, F.col("spans"), F.col("labels")))
    joined = carried.join(marked, "key", "left")
    return joined.select(
        *[
            new.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[of_kind(F.col("base"), kind).alias(f"n_{kind}") for kind, _ in KINDS],
        digest(listed(F.col("base"))).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
