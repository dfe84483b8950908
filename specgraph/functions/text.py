"""Column functions that normalise ids, types and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ontology as O


def normalize_id(c: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, other white space stripped at the ends."""
    return F.regexp_replace(F.translate(F.lower(c), "- ", "__"), r"^\s+|\s+$", "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table; null where the key is not in it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def member_role(kind: Column, roles: dict[str, tuple[str, ...]]) -> Column:
    return lookup(kind, {k: role for role, kinds in roles.items() for k in kinds})


def normalize_relation(c: Column) -> Column:
    """A known relation, the one a synonym stands for, or the name cleaned of other characters; RELATED_TO where nothing is left."""
    clean = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), " -", "__")
    custom = F.nullif(F.regexp_replace(clean, "[^A-Z0-9_]", ""), F.lit(""))
    return F.when(clean.isin(*O.RELATIONS), clean).when(lookup(clean, O.RELATION_SYNONYMS).isNotNull(), lookup(clean, O.RELATION_SYNONYMS)).when(clean.isin(*O.BLOCKED_RELATIONS), "RELATED_TO").otherwise(F.coalesce(custom, F.lit("RELATED_TO")))


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
