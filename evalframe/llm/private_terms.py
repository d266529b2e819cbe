"""Personal data by patterns, and the terms that give it away by co-occurrence; DataFrame expressions only.

Base spans are the leftmost, non-overlapping matches of one pattern per kind that pass the kind's rule. Every value found is
a protected entity. All words of a document that are no part of a base span are terms of each entity in it, however far
apart they stand; over all documents are counted how many hold the term, the entity, and both. A term reveals an entity
when most documents with the term hold the entity and the term gives a share of the entity's own information: pointwise
mutual information over -log2 p(entity), which is 1 for a term found only with the entity, however frequent that is. The
documents with both, at least `min_documents`, times the bits of the pair have to reach `bits`: so little is the chance that
a term which has nothing to do with the entity stands with it so often. Every occurrence of such a term in a document with
the entity is a span of its own. `sanitised` puts the name of its kind in the place of each span, which generalises the
value; overlapping spans are replaced once, by the first. An entity in every document has no information to give away.

Positions are code points, the end is exclusive. A null text is empty. Rows are told apart by id and text together, so
repeated rows get equal results and rows with a null id theirs. An empty table gives no rows. Other columns are not read;
`sanitised` passes them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evalframe.functions.let import let
from evalframe.llm.shared import written

KINDS = ["email", "ip", "card", "phone"]
MIN_DOCUMENTS = 2  # in one document every word that stands nowhere else would be a term
SHARE = 0.5  # of the documents with the term that hold the entity
INFORMATION = 0.5  # of the entity's own
BITS = 6.0  # of all documents with both together
BLOCK = 256  # matches placed together: appending to one array of all would take the square of their number

# The patterns; their groups are possessive where nothing could be given back anyway, so that no text exhausts the stack.
# An email address can only begin where a run of its letters begins or where the match before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Cheap conditions without which a pattern cannot match.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}]{2,}+"

_SPAN = "array<struct<start:int,end:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """start, end and value of all matches: what stands between them is what splitting leaves."""
    cut = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    none = F.array().cast(_SPAN)

    def step(state: Column, match: Column) -> Column:
        start = state["at"] + match["gap"]
        end = start + F.length(match["value"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(
            start.alias("start"), end.alias("end"), match["value"].alias("value"))).alias("out"))

    def block(state: Column, matches: Column) -> Column:
        placed = F.aggregate(matches, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return let(placed, lambda p: F.struct(
            p["at"].alias("at"), F.array_append(state["out"], p["out"]).alias("out")))

    def blocks(found: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(found), F.lit(BLOCK))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.when(F.size(found) == 0, none).otherwise(F.flatten(F.aggregate(
            F.transform(firsts, lambda i: F.slice(found, i, F.lit(BLOCK))), begin, block, lambda state: state["out"])))

    return let(F.filter(cut, lambda m: m["value"].isNotNull()), blocks)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    turned = F.reverse(_digits(value))

    def step(total: Column, i: Column) -> Column:
        digit = F.substr(turned, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
        return F.forall(parts, lambda part: (F.length(part) <= 3) & (part.try_cast("int") <= 255))
    if kind == "card":
        return F.when(count.between(16, 19), _luhn(value)).otherwise(False)
    return count.between(8, 15)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(_SPAN)
    hint = F.instr(text, HINTS[kind]) > 0 if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
    return F.when(hint, F.filter(located(text, PATTERNS[kind]), lambda s: _passes(kind, s["value"]))).otherwise(none)


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _entities(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.xxhash64(F.lit(kind), F.lower(s["value"])))


def _replaced(kind: str) -> Column:
    spans = F.coalesce(F.col(kind), F.array().cast(_SPAN))
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("name")))


def found(documents: DataFrame, key: str, text: str) -> DataFrame:
    """_row, key, one column of base spans for each kind, the distinct `_entities`, and where there are any the `_terms`."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.xxhash64(F.col(key), content).alias("_row"), F.col(key).alias("key"), content.alias("_text"),
        *(base_spans(content, kind).alias(kind) for kind in KINDS))
    values = F.array_distinct(F.flatten(F.array(*(_entities(kind) for kind in KINDS))))
    spans = F.flatten(F.array(*(F.col(kind) for kind in KINDS)))
    rows = rows.withColumn("_entities", values).withColumn("_spans", spans)
    free = F.filter(located(F.col("_text"), WORD), lambda w: ~F.exists(
        "_spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    terms = F.transform(free, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value")))
    return rows.withColumn("_terms", F.when(F.size("_entities") > 0, terms).otherwise(F.array().cast(_SPAN))).drop(
        "_spans", "_text")


def revealing(
    rows: DataFrame, documents: DataFrame, text: str, min_documents: int = MIN_DOCUMENTS, share: float = SHARE,
    bits: float = BITS, information: float = INFORMATION,
) -> DataFrame:
    """_row and `term`: the spans of the terms that exceed the thresholds, by the counts of all documents."""
    holding = written(rows.where(F.size("_entities") > 0).select("_row", "_entities", "_terms").dropDuplicates(["_row"]), "terms")
    pairs = holding.select("_entities", F.explode(F.array_distinct("_terms.value")).alias("term")).select(
        F.explode("_entities").alias("entity"), "term")
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_documents)
    per_entity = holding.select(F.explode("_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    content = F.coalesce(F.col(text), F.lit(""))
    held = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower(content), F.lit(WORD), F.lit(0)))).alias("term"))
    per_term = held.groupBy("term").agg(F.count("*").alias("n_term"))
    total = documents.agg(F.count("*").alias("n_all"))
    judged = together.join(per_term, "term").join(per_entity, "entity").crossJoin(total)  # one row
    own = F.log2(F.col("n_all") / F.col("n_entity"))
    mutual = own + F.log2(F.col("n_both") / F.col("n_term"))
    flagged = judged.where((F.col("n_both") >= share * F.col("n_term")) & (own > 0) & (mutual >= information * own) & (
        F.col("n_both") * mutual >= bits)).select("entity", "term")
    places = holding.select("_row", "_entities", F.explode("_terms").alias("_w")).select(
        "_row", F.explode("_entities").alias("entity"), F.col("_w.value").alias("term"), "_w.start", "_w.end")
    return places.join(flagged, ["entity", "term"]).groupBy("_row").agg(F.sort_array(F.collect_set(F.struct(
        "start", "end", F.col("term").alias("value")))).alias("term"))


def spans(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_ of each base kind and of terms, base_sha256 and spans of every row."""
    rows = written(found(documents, key, text), "base-spans")
    terms = revealing(rows, documents, text)
    whole = rows.drop("_entities", "_terms").join(terms, "_row", "left").withColumn("term", F.coalesce("term", F.array().cast(_SPAN)))
    base = F.concat(*(_named(kind, F.col(kind)) for kind in KINDS))
    return whole.select(
        "key", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _named("term", F.col("term"))), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"))


def sanitised(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The rows as they came, each span replaced by the name of its kind in angle brackets."""
    rows = written(found(documents, key, text), "base-spans")
    terms = revealing(rows, documents, text)
    every = F.flatten(F.array(*(_replaced(kind) for kind in [*KINDS, "term"])))
    marked = rows.drop("_entities", "_terms", "key").join(terms, "_row", "left").select("_row", F.array_sort(every).alias("pii")).where(
        F.size("pii") > 0).dropDuplicates(["_row"])
    content = F.coalesce(F.col(text), F.lit(""))
    # the row as it came is one column, so that none of its names can clash
    joined = documents.select(
        F.struct("*").alias("came"), F.xxhash64(F.col(key), content).alias("_row")).join(marked, "_row", "left")
    came = F.col("came").getField(text)

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.substr(came, state["at"] + 1, span["start"] - state["at"]), span["name"]))
            .otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("pii", begin, step, lambda s: F.concat(s["out"], F.substr(came, s["at"] + 1)))
    return joined.select(*(
        F.when(F.col("pii").isNotNull(), clean).otherwise(came).alias(text) if c == text else F.col("came").getField(c).alias(c)
        for c in documents.columns))
