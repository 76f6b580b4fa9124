"""Codes to names: document types, issuers, addresses, and numbers that titles name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: subtype codes of acts, series and sources, and what they are called ----
DOC_TYPES = {
    "ZAKON": "zakon", "ZAKONUST": "zakon", "VYHLASKA": "vyhlaska", "NARIZENI": "narizeni", "OPATRSEN": "opatreni",
    "DEKRET": "dekret", "DEKRETUST": "dekret",
}
OTHER_TYPE = "jiny_predpis"
ISSUERS = {
    "fs": ({"pokyny_d": "Finanční správa (Pokyny D)", "pokyny_mf": "Finanční správa (Pokyny MF)"}, "Finanční správa"),
    "celni": ({"mi": "Celní správa (Metodické informace)", "vp": "Celní správa (Vnitřní pokyny)"}, "Celní správa"),
}
SOURCES = {
    "mf_chj": ("metodika", "MF ČR (CHJ)"), "cus_podnikatele": ("cus_podnikatele", "Ministerstvo financí ČR – ČÚS"),
    "predpis_eu": ("predpis_eu", "EUR-Lex / Rada a Komise EU"),
}
SITE = "https://e-sbirka.cz"
IRI_MARK = "esel-esb:eli/cz"
COURTS = ("Ústavní soud", "Krajský soud")
OWN_NUMBER = r"č\.?\s*(\d+[a-z]?)\s*/\s*(\d{4})"
REPLACED_NUMBER = r"p[uů]vodn[ěe][^0-9]{0,40}č\.?\s*(\d+[a-z]?)\s*/\s*(\d{4})"
# ---- end of fixed values ----


def _case(of: Column, table: dict[str, str], other: str | None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), of), F.lit(other))


def doc_type(subtype: Column, other: str | None = OTHER_TYPE) -> Column:
    """Type of an act by its subtype; `other` for unknown ones and null."""
    return F.when(subtype.isNull(), F.lit(other)).otherwise(_case(subtype, DOC_TYPES, other))


def issuer(series: Column, family: str) -> Column:
    """Issuer of a guidance series of a family; without or with an unknown series the family's own name."""
    names, other = ISSUERS[family]
    return F.when(series.isNull(), F.lit(other)).otherwise(_case(series, names, other))


def decision_type(source: Column) -> Column:
    return F.when(source == "soudni_prezkum", "soudni_prezkum_uohs").otherwise("rozhodnuti_uohs")


def source_meta(source: Column) -> Column:
    """struct(doc_type, issuer) of a source, null fields for unknown ones."""
    return F.struct(_case(source, {k: v[0] for k, v in SOURCES.items()}, None).alias("doc_type"), _case(source, {k: v[1] for k, v in SOURCES.items()}, None).alias("issuer"))


def act_url(iri: Column) -> Column:
    """Address of a version: what follows the last mark of its IRI, or nothing if that has none."""
    return F.when(F.contains(iri, F.lit("eli/cz")), F.concat(F.lit(SITE), F.substring_index(iri, IRI_MARK, -1)))


def court(case_number: Column) -> Column:
    """The constitutional court if the number has its sign, whatever the spaces and case; else a regional one."""
    bare = F.regexp_replace(F.upper(case_number), " ", "")
    return F.when(F.contains(case_number, F.lit("ÚS")) | F.contains(bare, F.lit("US")), COURTS[0]).otherwise(COURTS[1])


def _number(title: Column, pattern: str) -> Column:
    found = F.regexp_extract(title, "(?iu)" + pattern, 1)
    year = F.regexp_extract(title, "(?iu)" + pattern, 2)
    return F.when(found != "", F.concat(F.lower(found), F.lit("/"), year))


def numbers(title: Column) -> Column:
    """All numbers, as number/year, that a title names."""
    found = F.regexp_extract_all(title, F.lit("(?iu)" + OWN_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: _number(x, OWN_NUMBER)))


def replaced_number(title: Column) -> Column:
    """The number/year that a title says it was before; null if none."""
    return _number(title, REPLACED_NUMBER)


def archive_key(key: Column, version: Column, *rest: Column) -> Column:
    """key#hist- and the last 40 characters of the version.

    Without a version what follows is empty, so that two such rows of a key clash, or, given the row's other values, their
    digest.
    """
    other = F.sha1(F.concat_ws("|", *[c.cast("string") for c in rest])) if rest else F.lit("")
    return F.concat(key, F.lit("#hist-"), F.coalesce(F.nullif(F.right(version, F.lit(40)), F.lit("")), other))
