"""Nested columns, as the walk of JSON lines has them."""

import json

from pyspark.sql import functions as F

from veilspark.operators.redact import Scanner
from veilspark.plans.sanitizer import Sanitizer

KEY = "0123456789abcdef" * 4
RECORDS = [
    {"user": {"name": "ines"}, "client": {"ip": "10.20.30.40"}, "session": {"id": "s-0001"}, "source": {"address": "10.20.30.42"}, "email": {"address": "ines"}, "service": {"name": "billing"}},
    {"user": {"name": None}, "client": None, "session": {"id": ""}, "source": {"address": "-"}, "email": {"address": "bob"}, "service": {"name": "x"}},
    {"emails": ["ann@mail-corp.com", None, "-"], "coordinates": [12.5, 41.0], "tags": ["new", "old"], "user.name": "ines", "source.ip": "10.20.30.41", "service.name": "billing"},
    {"events": [{"user": {"name": "eve", "seen": [1, 2]}}, {"user": None}], "max_tokens": 5},
]
SCHEMA = (
    "user struct<name:string>, client struct<ip:string>, session struct<id:string>, source struct<address:string>, email struct<address:string>, service struct<name:string>, emails array<string>, coordinates array<double>,"
    " tags array<string>, `user.name` string, `source.ip` string, `service.name` string, events array<struct<user:struct<name:string,seen:array<int>>>>, max_tokens int"
)


def pruned(value):
    """Without nulls, which text forms of rows leave out."""
    if isinstance(value, dict):
        return {k: pruned(v) for k, v in value.items() if v is not None}
    return [pruned(v) for v in value] if isinstance(value, list) else value


def test_records_are_those_of_json_lines(spark):
    s = Sanitizer(KEY, rules=["users", "ips", "sessionCookies", "geoLocation", "secrets"], never_values=["bob"])
    df = spark.read.schema(SCHEMA).json(spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "value string").rdd.map(lambda r: r.value))
    out = s.transform_nested(df.repartition(2).withColumn("i", F.monotonically_increasing_id()))
    got = sorted(json.dumps(pruned(json.loads(r[0])), sort_keys=True) for r in out.drop("i").select(F.to_json(F.struct("*"))).collect())
    # Scanning of what no key asks for is not part of it; these records have no such value.
    scan = Scanner(s.settings).line
    want = sorted(json.dumps(pruned(json.loads(scan(json.dumps(r))[0])), sort_keys=True) for r in RECORDS)
    assert got == want
    assert dict(out.dtypes)["coordinates"] == "array<string>" and dict(out.dtypes)["events"] == dict(df.dtypes)["events"]
    assert sum("<" in g for g in got) == 3


def test_maps_nulls_and_no_rows(spark):
    s = Sanitizer(KEY)
    rows = [(1, {"username": "eve", "Colour": "red", "email": None}, {"a": ("10.0.0.1",)}, None), (2, None, None, [None, {"ip": "10.0.0.2"}]), (3, {}, {}, [])]
    df = spark.createDataFrame(rows, "k int, tags map<string,string>, hosts map<string,struct<client_ip:string>>, deep array<map<string,string>>").coalesce(1)
    got = sorted(s.transform_nested(df).collect())
    ip, user = s.token("ips", "10.0.0.1"), s.token("users", "eve")
    assert got[0].tags == {"username": user, "Colour": "red", "email": None} and got[0].hosts["a"].client_ip == ip and got[0].deep is None
    assert got[1].tags is None and got[1].hosts is None and got[1].deep == [None, {"ip": s.token("ips", "10.0.0.2")}]
    assert got[2].tags == {} and got[2].hosts == {} and got[2].deep == []
    assert s.transform_nested(df.limit(0)).count() == 0
    assert s.transform_nested(df, ["hosts"]).where("k = 1").first().tags["username"] == "eve"
    assert s.transform_nested(df.select("k")).columns == ["k"]
