"""Run configuration documents: JSON text merged key by key, later sources first in line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from harborlane.functions.times import compact_text

VARIANT_MAP = "map<string,variant>"
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` uses it.

    A filter over a computed column is moved below it, into a join's condition too, and has the whole
    expression in every place where it names the column; a lambda's variable stays a variable.
    """
    return F.transform(F.array(value), then)[0]


def json_map(text: Column) -> Column:
    """Top-level keys of a JSON object; null for null, empty, malformed or non-object text.

    Of a repeated key the last counts. Spark takes that from a setting when it plans the expression,
    so the session is given it here, whoever made it.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set(REPEATED_KEYS, "true")
    return F.try_parse_json(text).try_cast(VARIANT_MAP)


def ignored(text: Column, document: Column) -> Column:
    """Whether there is text that is no document."""
    return has_text(text) & document.isNull()


def has_text(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def variant_of(value: Column) -> Column:
    """A plain column as a variant; SQL null becomes the JSON null."""
    return F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))


def base_conf(**columns: Column) -> Column:
    pairs = [item for name, col in columns.items() for item in (F.lit(name), variant_of(col))]
    return F.create_map(*pairs)


def merge(first: Column, *overrides: Column) -> Column:
    """Merge maps; the value of the last map that has the key wins, null maps add nothing."""
    empty = F.expr("cast(map() as map<string,variant>)")
    merged = F.coalesce(first, empty)
    for override in overrides:
        merged = _merged(merged, F.coalesce(override, empty))
    return merged


def _merged(fields: Column, override: Column) -> Column:
    return once(override, lambda over: F.map_concat(_without_keys_of(fields, over), over))


def _without_keys_of(fields: Column, over: Column) -> Column:
    return F.map_filter(fields, lambda k, v: ~F.map_contains_key(over, k))


def conf_text(conf: Column) -> Column:
    """JSON text with sorted keys, so equal documents are equal text."""

    def by_key(fields: Column) -> Column:
        return once(
            F.sort_array(F.map_keys(fields)),
            lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(fields, k))),
        )

    return F.to_json(once(conf, by_key))


def workflow_name(integration_type: Column) -> Column:
    """``S3ToMongo``, ``s3_to_mongo`` and ``s3tomongo`` all give ``s3_to_mongo``."""
    split = F.lower(F.regexp_replace(integration_type, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.when(split.contains("_"), split).otherwise(
        F.regexp_replace(split, "to", "_to_")
    )


def workflow_run_target(integration_type: Column) -> Column:
    return F.concat(workflow_name(integration_type), F.lit("_ondemand"))


def run_id(tenant: Column, target: Column, source: str, at: Column, integration_id: Column) -> Column:
    """``{tenant}_{target}_{source}_{time}_{integration}``; the last part keeps ids unique."""
    return F.concat_ws(
        "_",
        F.coalesce(tenant, F.lit("unknown")),
        target,
        F.lit(source),
        compact_text(at),
        F.substring(F.rpad(at.cast("string"), 21, ".0"), 21, 1),
        integration_id.cast("string"),
    )
