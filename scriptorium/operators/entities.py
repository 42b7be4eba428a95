"""Entities: rule-based detection, normal forms, duplicates, statistics, boosted search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as ft

# Names and their normal forms.
FRENCH_MONTHS = "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre".split()
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15, "xvi": 16, "xvii": 17, "xviii": 18, "xix": 19, "xx": 20, "xxi": 21}
PLACES = {
    "usa": "etats-unis",
    "u.s.a.": "etats-unis",
    "united states": "etats-unis",
    "uk": "royaume-uni",
    "u.k.": "royaume-uni",
    "united kingdom": "royaume-uni",
    "grande-bretagne": "royaume-uni",
    "great britain": "royaume-uni",
    "germany": "allemagne",
    "deutschland": "allemagne",
}
ORGANISATIONS = {
    "onu": "nations-unies",
    "un": "nations-unies",
    "united nations": "nations-unies",
    "nations unies": "nations-unies",
    "nato": "otan",
    "ue": "union-europeenne",
    "eu": "union-europeenne",
    "european union": "union-europeenne",
    "union europeenne": "union-europeenne",
}
TYPE_WEIGHTS = {"PERSON": 1.5, "EVENT": 1.4, "LOCATION": 1.3, "ORGANIZATION": 1.2, "DATE": 1.1, "CONCEPT": 1.0}


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _date_form(date: Column) -> Column:
    part = lambda pattern, n: F.regexp_extract(date, pattern, n)
    number = lambda month: F.lpad(F.array_position(ft.literal_array(FRENCH_MONTHS), month).cast("string"), 2, "0")
    roman, century = r"^([ivx]+)e?\s*siecle$", r"^(\d{1,2})e?\s*siecle$"
    years, full, month = r"^(\d{4})\s*[-–]\s*(\d{4})$", r"^(\d{1,2})\s+([a-z]+)\s+(\d{4})$", r"^([a-z]+)\s+(\d{4})$"
    known = lambda m: F.array_contains(ft.literal_array(FRENCH_MONTHS), m)
    return (
        F.when(date.rlike(roman) & _lookup(ROMAN, part(roman, 1)).isNotNull(), F.concat(F.lit("siecle-"), _lookup(ROMAN, part(roman, 1)).cast("string")))
        .when(date.rlike(century), F.concat(F.lit("siecle-"), F.regexp_replace(part(century, 1), "^0", "")))
        .when(date.rlike(years), F.concat_ws("-", part(years, 1), part(years, 2)))
        .when(date.rlike(full) & known(part(full, 2)), F.concat_ws("-", part(full, 3), number(part(full, 2)), F.lpad(part(full, 1), 2, "0")))
        .when(date.rlike(month) & known(part(month, 1)), F.concat_ws("-", part(month, 2), number(part(month, 1))))
        .otherwise(date)
    )


def normal_form(name: Column, kind: Column) -> Column:
    """Lower case, no accents, no leading article, single spaces; then by type: dates to ISO, titles off persons, aliases of places and organisations."""
    base = ft.fold_accents(F.coalesce(name, F.lit("")))
    base = F.regexp_replace(F.regexp_replace(base, r"^(le |la |les |l'|l’)", ""), r"^(the |a |an )", "")
    base = F.trim(F.regexp_replace(base, r"\s+", " "))
    person = F.regexp_replace(F.regexp_replace(base, r"^(m\.|mme|mlle|dr\.?|prof\.?|mr\.?|mrs\.?|ms\.?|sir|lady)\s+", ""), r"\s+(jr\.?|sr\.?|ii|iii|iv)$", "")
    person = F.trim(F.regexp_replace(person, r"\s+-\s+", "-"))
    place = F.coalesce(_lookup(PLACES, base), base)
    organisation = F.coalesce(_lookup(ORGANISATIONS, F.regexp_replace(base, r"[.']", "")), base)
    return F.when(kind == "DATE", _date_form(base)).when(kind == "PERSON", person).when(kind == "LOCATION", place).when(kind == "ORGANIZATION", organisation).otherwise(base)


def same_entity(a: Column, b: Column, kind: Column) -> Column:
    """Of two normal forms: equal; or for persons the shorter name's parts all among the longer's; or for other names (not places, dates) of over three letters all words of the shorter."""
    parts = lambda x: F.filter(F.split(x, r"[\s-]+"), lambda p: F.length(p) > 1)
    within = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    pa, pb, wa, wb = parts(a), parts(b), F.split(a, " "), F.split(b, " ")
    person = F.when(F.size(pa) <= F.size(pb), within(pa, pb)).otherwise(within(pb, pa))
    other = (F.length(a) > 3) & (F.length(b) > 3) & F.when(F.size(wa) <= F.size(wb), within(wa, wb)).otherwise(within(wb, wa))
    given = (a != "") & (b != "")
    return given & ((a == b) | F.when(kind == "PERSON", person).when(kind.isin("LOCATION", "DATE"), False).otherwise(other))


def detect(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, name, kind): dates (full, month and year, year ranges), and runs of two capitalised words and more."""
    text = ft.present("text")
    dates = F.regexp_extract_all(text, F.lit(r"(\d{1,2}\s+\p{Ll}+\s+\d{4}|\d{4}\s*[-–]\s*\d{4})"), 1)
    names = F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)+)"), 1)
    both = F.concat(F.transform(dates, lambda d: F.struct(d.alias("name"), F.lit("DATE").alias("kind"))), F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("PERSON").alias("kind"))))
    return docs.select(key, F.explode_outer(both).alias("e")).filter("e is not null").select(key, "e.name", "e.kind")


def without_copies(mentions: DataFrame, name: str = "name", kind: str = "kind", context: str = "context") -> DataFrame:
    """Of the mentions with one type and normal form that with the longest context, equal ones by name."""
    formed = mentions.withColumn("normalized", normal_form(F.col(name), F.col(kind)))
    best = formed.groupBy(kind, "normalized").agg(F.max(F.struct(F.length(context).alias("n"), F.col(context), F.col(name))).alias("b"), F.count(F.lit(1)).alias("mentions"))
    return best.select(kind, "normalized", F.col(f"b.{name}").alias(name), F.col(f"b.{context}").alias(context), "mentions")


def boosted(hits: DataFrame, mentions: DataFrame, query_entities: DataFrame) -> DataFrame:
    """score = 0.7 similarity + 0.3 * sum(match * type weight) / entities of the query; a match is 1 if names are equal, 0.7 if one holds the other.

    Equal names are an equi join; partial ones are sought among the query's few entities only.
    """
    weights = _lookup(TYPE_WEIGHTS, F.col("kind"))
    asked = query_entities.select("query_id", "normalized", "kind").distinct()
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    own = mentions.select("id", F.col("normalized").alias("own")).distinct()
    near = hits.select("query_id", "id").join(own, "id").join(asked, "query_id").filter(F.col("own").contains(F.col("normalized")) | F.col("normalized").contains(F.col("own")))
    match = F.when(F.col("own") == F.col("normalized"), 1.0).otherwise(0.7)
    best = near.groupBy("query_id", "id", "normalized", "kind").agg(F.max(match).alias("match"))
    boosts = best.groupBy("query_id", "id").agg(F.sum(F.col("match") * weights).alias("boost"))
    joined = hits.join(boosts, ["query_id", "id"], "left").join(sizes, "query_id", "left")
    return joined.withColumn("score", 0.7 * F.col("similarity") + 0.3 * F.coalesce(F.try_divide("boost", "n"), F.lit(0.0))).drop("boost", "n")
