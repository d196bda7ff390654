"""A query over nested columns, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .queries import KEY, _token, table
from .sanitizer import Sanitizer


def nested_columns(spark, sf_dir):
    """Customers as nested records: fields by parent and name, items by their array, map entries by their keys."""
    k, name = F.col("c_custkey"), F.col("c_name")
    text = k.cast("string")
    made = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(
            F.struct(name.alias("name"), k.alias("id")).alias("user"),
            F.struct(name.alias("name")).alias("service"),
            F.array(F.concat(F.lit("a"), text), F.lit("-"), F.when(k % 3 > 0, F.concat(F.lit("b"), text))).alias("emails"),
            F.array((k / 4).alias("x")).alias("coordinates"),
            F.create_map(F.lit("user-name"), name, F.lit("colour"), F.lit("blue")).alias("tags"),
            F.array(F.struct(F.struct(F.concat(F.lit("10.0.0."), text).alias("address"), F.lit("x").alias("kind")).alias("source"))).alias("events"),
        ).alias("record"),
    )
    r = Sanitizer(KEY).transform_nested(made)
    return r.select(
        "c_custkey", F.col("record.user.name").alias("user_name"), F.col("record.user.id").alias("user_id"), F.col("record.service.name").alias("service_name"), F.array_join("record.emails", "|", "null").alias("emails"),
        F.array_join("record.coordinates", "|").alias("coordinates"), F.col("record.tags")["user-name"].alias("tag_user"), F.col("record.tags")["colour"].alias("tag_colour"),
        F.col("record.events")[0]["source"]["address"].alias("address"), F.col("record.events")[0]["source"]["kind"].alias("kind"),
    )


QUERIES = {"nested_columns": nested_columns}

_NUMBER = "CASE c_custkey % 4 WHEN 0 THEN (c_custkey // 4)::VARCHAR WHEN 1 THEN (c_custkey // 4) || '.25' WHEN 2 THEN (c_custkey // 4) || '.5' ELSE (c_custkey // 4) || '.75' END"

ORACLES = {
    "nested_columns": f"""
SELECT c_custkey, {_token("users", "USER", "c_name")} AS user_name, {_token("users", "USER", "c_custkey::VARCHAR")} AS user_id, c_name AS service_name,
       {_token("users", "USER", "'a' || c_custkey")} || '|-|' || CASE WHEN c_custkey % 3 > 0 THEN {_token("users", "USER", "'b' || c_custkey")} ELSE 'null' END AS emails,
       {_token("geoLocation", "GEO", _NUMBER)} AS coordinates, {_token("users", "USER", "c_name")} AS tag_user, 'blue' AS tag_colour,
       {_token("ips", "IP", "'10.0.0.' || c_custkey")} AS address, 'x' AS kind
FROM customer""",
}
