"""JSON objects whose keys are data: rows from objects keyed by name, whatever fields each record has.

Values stay variants until a field is asked for, so records of one file may
differ in their fields and in the types of a field, and nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(t: DataFrame, json: str, key: str = "key", value: str = "value", pos: str | None = None) -> DataFrame:
    """``t`` without ``json``, with a row for each entry of its JSON object or array: key (null in arrays) and value, a variant; ``pos``: its place.

    ``json`` is text or a variant. Null, broken and scalar JSON has no entries.
    """
    kept = [c for c in t.columns if c != json]
    parsed = F.col(f"`{json}`") if dict(t.dtypes)[json] == "variant" else F.try_parse_json(F.col(f"`{json}`"))
    # under names of their own, so that none clashes with an entry's
    rows = t.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)), parsed.alias("_v"))
    # scalars have no entries
    holds = rows.filter(F.schema_of_variant("_v").rlike("^(OBJECT|ARRAY)"))
    each = holds.lateralJoin(t.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return each.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)), F.col("key").alias(key), F.col("value").alias(value), *([F.col("pos").alias(pos)] if pos else []))


def field(value: str | Column, path: str, kind: str) -> Column:
    """A field of a variant as a type; null where it is missing or another type that does not cast."""
    return F.try_variant_get(value, path, kind)


def nested(t: DataFrame, json: str, names: Sequence[str], path: str | None = None, value: str = "value") -> DataFrame:
    """Rows from objects in objects: a column of ``names`` for the key of each level, and the innermost value.

    ``path``: where in each outer value the next object is, as ``$.documents``; itself if None.
    """
    out, source = t, json
    for i, name in enumerate(names):
        out = entries(out, source, name, value)
        if i + 1 < len(names):
            out = out.withColumn("_inner", F.try_variant_get(value, path or "$", "variant")).drop(value)
            source = "_inner"
    return out
