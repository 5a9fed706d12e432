"""Content-addressed identities, IRIs and local names as column expressions. Nulls give nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.vocab import DOMAIN


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_hash(text: Column | str, digits: int = 12) -> Column:
    """The first hexadecimal digits of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(F.encode(col(text), "UTF-8"), 256), 1, digits)


def doc_iri(hid: Column | str, domain: str = DOMAIN) -> Column:
    return F.concat(F.lit(f"{domain}/doc/"), col(hid))


def chunk_iri(doc: Column | str, hid: Column | str) -> Column:
    return F.concat(col(doc), F.lit("/chunk/"), col(hid))


def namespace(iri: Column | str, ontology: bool = False) -> Column:
    """An IRI as a namespace: without '#' at its end, then '#' for an ontology, '/' for data."""
    return F.concat(F.regexp_replace(col(iri), "#+$", ""), F.lit("#" if ontology else "/"))


def local_name(iri: Column | str) -> Column:
    """What follows the last '#' if there is one, else the last '/'."""
    c = col(iri)
    return F.when(F.instr(c, "#") > 0, F.substring_index(c, "#", -1)).when(F.instr(c, "/") > 0, F.substring_index(c, "/", -1)).otherwise(c)


def clean_local_name(name: Column | str) -> Column:
    """Word characters of any script, '-' and '.'; anything else is one '_'; never empty."""
    c = F.regexp_replace(F.regexp_replace(col(name), r"(?U)[^\w\-.]", "_"), "_+", "_")
    return F.when(col(name).isNotNull(), F.coalesce(F.nullif(F.btrim(c, F.lit("_")), F.lit("")), F.lit("entity")))


def facts_filename(spec: Column | str) -> Column:
    """The last two parts of a path or IRI that aren't empty name its file; null goes to current.ttl."""
    c = col(spec)
    parts = F.filter(F.slice(F.split(c, "/"), F.greatest(-F.size(F.split(c, "/")), F.lit(-2)), F.lit(2)), lambda x: x != "")
    return F.when(c.isNull(), F.lit("current.ttl")).otherwise(F.concat(F.lit("facts_"), F.array_join(parts, "_"), F.lit(".ttl")))


def ontology_filename(name: Column | str, version: Column | str) -> Column:
    return F.concat(F.lit("ontology_"), col(name), F.lit("_"), col(version), F.lit(".ttl"))


def suffix(path: Column | str) -> Column:
    """The suffix of the file name with its dot, '' if it has none or only a leading dot."""
    return F.regexp_extract(F.substring_index(col(path), "/", -1), r"^.+(\.[^.]+)$", 1)


def stem(path: Column | str) -> Column:
    name = F.substring_index(col(path), "/", -1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def trailing_number(path: Column | str) -> Column:
    """The last dot-separated part of the stem if it is all digits, else 0."""
    return F.coalesce(F.regexp_extract(F.substring_index(stem(path), ".", -1), r"^(\d+)$", 1).try_cast("int"), F.lit(0))


def excerpt(text: Column | str, n: int = 1000) -> Column:
    return F.concat(F.substring(col(text), 1, n), F.lit(" ..."))


def recursion_limit(max_visits: int, head_chunks: int | None = None, floor: int = 1000, estimate: int = 30) -> int:
    return max(floor, max_visits * (head_chunks or estimate) * 10)
