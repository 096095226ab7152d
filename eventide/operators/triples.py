"""Country facts from RDF-style triples and the country node upsert.

A country is a subject of type Country with an English label; its ISO code is taken when there
is one, and its capital together with the capital's English label.

As the language test on the capital's label also removes countries without a capital, the
capital part is an inner join by default; ``capital_optional=True`` keeps countries without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.operators.graph import upsert_by_key

COUNTRY_TYPE = "Country"


def _pred(triples: DataFrame, p: str) -> DataFrame:
    return triples.filter(F.col("p") == p)


def country_bindings(triples: DataFrame, lang: str = "en", capital_optional: bool = False) -> DataFrame:
    """Rows ``(uri, name, iso_code, capital)``, one per solution of the pattern."""
    labels = _pred(triples, "label").filter(F.col("lang") == lang)
    countries = _pred(triples, "type").filter(F.col("o") == COUNTRY_TYPE).select(F.col("s").alias("uri"))
    names = labels.select(F.col("s").alias("uri"), F.col("o").alias("name"))
    iso = _pred(triples, "isoCode").select(F.col("s").alias("uri"), F.col("o").alias("iso_code"))
    capitals = (_pred(triples, "capital").select(F.col("s").alias("uri"), F.col("o").alias("cap_uri"))
                .join(labels.select(F.col("s").alias("cap_uri"), F.col("o").alias("capital")), "cap_uri")
                .drop("cap_uri"))
    return (countries.join(names, "uri")
            .join(iso, "uri", "left")
            .join(capitals, "uri", "left" if capital_optional else "inner")
            .select("uri", "name", "iso_code", "capital"))


def star(triples: DataFrame, properties: dict[str, Column]) -> DataFrame:
    """``(s, facts)``: per subject the objects of several properties, in one shuffle of the store. ``properties`` maps
    a name to the condition of its triples; a triple counts for the first it meets, others are left out before.

    The facts are one list of (name, object), so that plans that read the result twice share its shuffle."""
    name = F.coalesce(*[F.when(cond, F.lit(k)) for k, cond in properties.items()])
    return (triples.select("s", "o", name.alias("name")).filter(F.col("name").isNotNull() & F.col("o").isNotNull() & F.col("s").isNotNull())
            .groupBy("s").agg(F.collect_list(F.struct("name", "o")).alias("facts")))


def values(name: str) -> Column:
    """The objects of one property of :func:`star`."""
    return F.transform(F.filter("facts", lambda f: f["name"] == name), lambda f: f["o"])


def country_star(triples: DataFrame, lang: str = "en", capital_optional: bool = False) -> DataFrame:
    """:func:`country_bindings` with one aggregation per subject for the whole star of properties.

    A subject's types, labels, codes and capitals are gathered together, so the store is shuffled once,
    and one join gives the capitals their labels. Each combination of values of properties with
    several is a solution, as a join gives it."""
    p, o = F.col("p"), F.col("o")
    subjects = star(triples, {"kind": (p == "type") & (o == COUNTRY_TYPE), "label": (p == "label") & (F.col("lang") == lang),
                              "code": p == "isoCode", "capital": p == "capital"})
    countries = (subjects.select(F.col("s").alias("uri"), values("kind").alias("kinds"), values("label").alias("names"),
                                 values("code").alias("codes"), values("capital").alias("capitals"))
                 .filter((F.size("kinds") > 0) & (F.size("names") > 0)))
    labels = subjects.select(F.col("s").alias("cap_uri"), values("label").alias("cap_names")).filter(F.size("cap_names") > 0)
    met = (countries.withColumn("cap_uri", F.explode_outer("capitals")).join(labels, "cap_uri", "left")
           .groupBy("uri").agg(F.first("kinds").alias("kinds"), F.first("names").alias("names"), F.first("codes").alias("codes"),
                               F.flatten(F.collect_list("cap_names")).alias("found")))
    capital = F.explode_outer("found") if capital_optional else F.explode("found")
    return (met.select("uri", "names", "codes", "found", F.explode("kinds").alias("kind"))
            .select("uri", "codes", "found", F.explode("names").alias("name"))
            .select("uri", "name", "found", F.explode_outer("codes").alias("iso_code"))
            .select("uri", "name", "iso_code", capital.alias("capital")))


def latest_countries(bindings: DataFrame) -> DataFrame:
    """One binding per country name: the last in ``(uri, iso_code, capital)`` order wins."""
    order = F.struct("uri", "iso_code", "capital")
    return (bindings.groupBy("name")
            .agg(F.max_by(F.struct("iso_code", "capital", "uri"), order).alias("b"))
            .select("name", "b.iso_code", "b.capital", "b.uri"))


def merge_countries(existing: DataFrame, bindings: DataFrame) -> DataFrame:
    """MERGE country nodes by name: create with type/region defaults, else overwrite facts."""
    return upsert_by_key(existing, latest_countries(bindings), "name", ["iso_code", "capital", "uri"],
                         {"type": F.lit(COUNTRY_TYPE), "region": F.lit("Unknown")})
