"""Queries of the redaction operators and the same in SQL, written apart from each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native as N
from ..functions.builtin_rules import BUILTIN, host_rule
from ..operators import report as R
from ..sources.text import explode_lines, lines_of
from .sanitizer import Sanitizer

#: A public key: the queries show results that anyone can compute.
KEY = "0123456789abcdef" * 4
INNER, OUTER = (bytes(b ^ pad for b in bytes.fromhex(KEY).ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _redacted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return Sanitizer(KEY, **options).transform_text(_documents(spark, sf_dir), "text", ["doc_id"])


def _ip_matches(spark, sf_dir) -> DataFrame:
    return R.matches_of(_redacted(spark, sf_dir, rules=["ips"]), ["doc_id", "line_no"])


def _mail_matches(spark, sf_dir, **options) -> DataFrame:
    mail = BUILTIN["users"].patterns[1]
    from dataclasses import replace

    rule = replace(BUILTIN["users"], patterns=(mail,), json_keys=(), json_key_contains=())
    return R.matches_of(_redacted(spark, sf_dir, rules=[rule], **options), ["doc_id", "line_no"])


def line_framing(spark, sf_dir):
    """Lines of each document, and their characters."""
    lines = lines_of(F.coalesce(F.col("text"), F.lit("")))
    chars = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    return _documents(spark, sf_dir).select("doc_id", F.size(lines).cast("long").alias("n_lines"), chars.cast("long").alias("n_chars"))


def ip_counts(spark, sf_dir):
    """Addresses that are redacted, by rule."""
    return R.counts(_ip_matches(spark, sf_dir))


def ip_replacements(spark, sf_dir):
    """Distinct addresses: token, how often, first place."""
    return R.replacements(_ip_matches(spark, sf_dir)).select("rule_id", "original", "replacement", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").cast("long").alias("first_line"))


def ip_first_three(spark, sf_dir):
    """The first three distinct addresses, as a report with that limit has them."""
    return R.replacements(_ip_matches(spark, sf_dir), 3).select("rule_id", "original", "n")


def mail_lines(spark, sf_dir):
    """Lines with mail addresses, after redaction of these alone."""
    from dataclasses import replace

    rule = replace(BUILTIN["users"], patterns=(BUILTIN["users"].patterns[1],), json_keys=(), json_key_contains=())
    df = _redacted(spark, sf_dir, rules=[rule]).where(F.size("redacted.matches") > 0)
    return df.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("redacted.matches").cast("long").alias("n"), F.transform("redacted.matches", lambda m: m["original"]).alias("found")).select("doc_id", "line_no", "n", F.array_join("found", "|").alias("found"))


def mail_replacements_merged(spark, sf_dir):
    """Replacement reports of even and odd documents as one."""
    matches = _mail_matches(spark, sf_dir)  # each part's condition goes down to the files, so no line is scanned twice
    parts = [R.replacements(matches.where(F.pmod(F.coalesce("ord.doc_id", F.lit(0)), F.lit(2)) == k)) for k in (0, 1)]
    return R.merge_replacements(parts).select("original", "replacement", "n", F.col("first.doc_id").alias("first_doc"))


def mail_allowlist(spark, sf_dir):
    """Mail addresses that an exempt list from a table leaves to redact: the list is joined, so it may be large."""
    exempt = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b([a-m][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"))).alias("original")).distinct()
    found = _mail_matches(spark, sf_dir).groupBy("original").agg(F.count("*").alias("n"))
    return found.join(exempt, "original", "left_anti")


def source_tokens(spark, sf_dir):
    """Tokens of a column, by Sanitizer; the key is in no plan."""
    s = Sanitizer(KEY)
    df = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("original"), F.col("source").alias("hostname"))
    return s.transform_columns(df, {"hostname": "hosts"})


def customer_columns(spark, sf_dir):
    """Customers with names and phones replaced, as their columns' names ask for."""
    s = Sanitizer(KEY)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer_name"), F.col("c_custkey").cast("string").alias("customer_id"))
    return s.transform_columns(df)


def native_tokens(spark, sf_dir):
    """Tokens of a column as an expression."""
    return table(spark, sf_dir, "documents").select("doc_id", N.token(bytes.fromhex(KEY), "ips", "IP", F.col("source")).alias("token"))


def luhn_numbers(spark, sf_dir):
    """Card-shaped numbers in documents, and which pass the Luhn check."""
    found = _documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[^0-9.])([0-9](?:[ -]?[0-9]){12,18})"), 1)).alias("number"))
    return found.select("doc_id", "number", N.luhn(F.regexp_replace("number", "[ -]", "")).alias("passes"))


def reserved_addresses(spark, sf_dir):
    """Addresses made of order keys: whether they are reserved."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", (k % 256).cast("string"), (F.floor(k / 7) % 256).cast("string"), (F.floor(k / 3) % 256).cast("string"), (k % 2).cast("string"))
    return o.select("o_orderkey", ip.alias("ip"), N.reserved_ipv4(ip).alias("reserved"))


def account_remainders(spark, sf_dir):
    """Remainders by 97 of account numbers made of customer keys."""
    text = F.concat(F.lit("GB"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(F.col("c_custkey").cast("string"), 14, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.mod97(text).cast("long").alias("remainder"))


def entropy_of_sources(spark, sf_dir):
    """Bits per character of event properties, in thousandths."""
    return table(spark, sf_dir, "events").select("event_id", F.round(N.entropy(F.coalesce("props", F.lit(""))) * 1000).cast("long").alias("millibits"))


def json_lines(spark, sf_dir):
    """Which event properties look like JSON, and the fields' normal names."""
    props = F.coalesce("props", F.lit(""))
    return table(spark, sf_dir, "events").groupBy(N.looks_like_json(props).alias("is_json"), N.normal_key(F.col("event_type")).alias("key")).agg(F.count("*").alias("n"))


def key_catalog(spark, sf_dir):
    """Columns of the tables and the rules that their names ask for."""
    s = Sanitizer(KEY)
    rows = [(name, c, rule) for name in TABLES for c, rule in sorted(s.columns_by_rule(table(spark, sf_dir, name)).items())]
    return spark.createDataFrame(rows, "table_name string, column_name string, rule_id string")


def sanitized_documents(spark, sf_dir):
    """All rules over all lines: characters and matches of each document after redaction."""
    df = _redacted(spark, sf_dir)
    return df.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.size("redacted.matches")).alias("n_matches"), F.sum(F.length("redacted.output")).alias("n_chars"))


def sanitized_pages(spark, sf_dir):
    """All rules over the lines of pages: counts by rule."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return R.counts(R.matches_of(Sanitizer(KEY).transform_text(pages, "html", ["page_id"]), ["page_id", "line_no"]))


def sanitized_conversations(spark, sf_dir):
    """Conversations after redaction, a row a turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return Sanitizer(KEY).sanitize_stream(turns, "text")


def sanitized_json(spark, sf_dir):
    """Event properties through the walk of JSON lines."""
    return Sanitizer(KEY).sanitize_stream(table(spark, sf_dir, "events").select("event_id", "props"), "props")


def aggressive_documents(spark, sf_dir):
    """Counts by rule with the aggressive patterns."""
    return R.counts(R.matches_of(_redacted(spark, sf_dir, aggressive=True), ["doc_id", "line_no"]))


def report_preview(spark, sf_dir):
    """The first 4,096 characters of a run, before and after."""
    out = R.preview(_redacted(spark, sf_dir), "line", ["doc_id", "line_no"], 4096)
    return out.withColumn("line_no", F.col("line_no").cast("long"))


# ---------------------------------------------------------------- one query a rule, over lines made of keys


def _made(spark, sf_dir, source: str, key: str, line, rules: list, **options) -> DataFrame:
    """Rows (key, output): a line for each row of a table, redacted."""
    made = table(spark, sf_dir, source).select(key, Sanitizer(KEY, rules=rules, json=False, **options).column(line).alias("r"))
    return made.select(key, F.col("r.output").alias("output"))


def _digits(number, width: int):
    return F.lpad(number.cast("string"), width, "0")


def _order():
    return F.col("o_orderkey")


def _customer():
    return F.col("c_custkey")


def card_lines(spark, sf_dir):
    """Card numbers: layout, issuer and Luhn check of the rule."""
    digits = F.concat(F.lit("4"), _digits(_order() * 7919 % 10**14, 14), (_order() % 10).cast("string"))
    fours = F.concat_ws(" ", *(F.substring(digits, 4 * k + 1, 4) for k in range(4)))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("paid by "), F.when(_order() % 2 == 0, digits).otherwise(fours), F.lit(" today")), ["paymentInfo"])


def account_lines(spark, sf_dir):
    """Account numbers with right check digits for even keys: the rule's countries and remainder by 97."""
    body = F.concat(F.lit("WEST"), _digits(_customer(), 14))
    right = 98 - N.mod97(F.concat(F.lit("GB00"), body))
    checked = F.concat(F.when(_customer() % 4 == 2, F.lit("QQ")).otherwise(F.lit("GB")), _digits(F.when(_customer() % 2 == 0, right).otherwise(_customer() % 97), 2), body)
    return _made(spark, sf_dir, "customer", "c_custkey", F.concat(F.lit("to "), checked), ["paymentInfo"])


def security_number_lines(spark, sf_dir):
    """Social security and tax numbers: areas, groups and serials that are never given out."""
    text = F.concat_ws("-", _digits(_order() * 31 % 1000, 3), _digits(_order() * 7 % 100, 2), _digits(F.when(_order() % 11 == 0, F.lit(0)).otherwise(_order() * 13 % 10000), 4))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("no "), text), ["govIds"])


def health_number_lines(spark, sf_dir):
    """Health service numbers: the check by 11."""
    d = _digits(_order() * 104_729 % 10**10, 10)
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat_ws(" ", F.lit("id"), F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)), ["govIds"])


def prescriber_lines(spark, sf_dir):
    """Prescriber numbers: the check digit."""
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("by AB"), _digits(_order() * 7919 % 10**7, 7)), ["healthInfo"])


def mac_lines(spark, sf_dir):
    """Hardware addresses in three layouts have tokens of their own."""
    h = F.lower(F.lpad(F.hex(_order() * 2_654_435_761 % 2**47), 12, "0"))
    two = lambda sep: F.concat_ws(sep, *(F.substring(h, 2 * k + 1, 2) for k in range(6)))
    text = F.when(_order() % 3 == 0, two(":")).when(_order() % 3 == 1, two("-")).otherwise(F.concat_ws(".", *(F.substring(h, 4 * k + 1, 4) for k in range(3))))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("nic "), text, F.lit(" up")), ["ips"])


def phone_lines(spark, sf_dir):
    """Numbers behind tel: of 4 to 19 digits; 7 to 15 are a phone number."""
    text = F.substring(F.concat(F.lit("7"), _digits(_order(), 18)), 1, 4)
    text = F.concat(text, F.expr("substring('123456789123456', 1, cast(o_orderkey % 16 as int))"))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("tel:"), text, F.lit(";")), ["phoneNumbers"])


def cookie_lines(spark, sf_dir):
    """Session identifiers of 0 to 15 characters; 8 are needed."""
    text = F.expr("substring(md5(cast(o_orderkey as string)), 1, cast(o_orderkey % 16 as int))")
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("x; sid="), text, F.lit("; y")), ["sessionCookies"])


def home_lines(spark, sf_dir):
    """Users in home paths; the folders themselves are none."""
    name = F.when(_order() % 5 == 0, F.lit(".")).when(_order() % 5 == 1, F.lit("..")).otherwise(F.concat(F.lit("user"), (_order() % 97).cast("string")))
    path = F.when(_order() % 2 == 0, F.concat(F.lit("/home/"), name, F.lit("/x"))).otherwise(F.concat(F.lit("C:\\Users\\"), name, F.lit("\\x")))
    return _made(spark, sf_dir, "orders", "o_orderkey", path, ["paths"])


def account_name_lines(spark, sf_dir):
    """Accounts behind a domain; system accounts and what lies below a path stay."""
    name = F.when(_order() % 7 == 0, F.lit("SYSTEM")).otherwise(F.concat(F.lit("user"), (_order() % 97).cast("string")))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.when(_order() % 3 == 0, F.lit("C:\\dir\\CORP\\")).otherwise(F.lit("by CORP\\")), name, F.lit(" ok")), ["users"])


def place_lines(spark, sf_dir):
    """Pairs of coordinates: only places on earth, and not the origin."""
    lat, lon = _order() * 17 % 200 - 100, _order() * 23 % 400 - 200
    zero = _order() % 13 == 0
    text = F.concat(F.lit("at ("), F.when(zero, F.lit(0)).otherwise(lat).cast("string"), F.lit(".000, "), F.when(zero, F.lit(0)).otherwise(lon).cast("string"), F.lit(".000)"))
    return _made(spark, sf_dir, "orders", "o_orderkey", text, ["geoLocation"])


def host_lines(spark, sf_dir):
    """Names with top-level domains, and file names that look like them."""
    ends = F.array(*map(F.lit, HOST_ENDS))
    name = F.concat(F.lit("a"), (_order() % 89).cast("string"), F.lit("."), F.get(ends, (_order() % len(HOST_ENDS)).cast("int")))
    return _made(spark, sf_dir, "orders", "o_orderkey", F.concat(F.lit("see "), name, F.lit(" now")), ["hosts"])


HOST_ENDS = ("com", "xyz", "ninja", "js", "tar.gz", "go", "internal", "rb", "co.uk", "db", "py")


def host_counts(spark, sf_dir):
    """Hosts of pages' addresses, by a list of domains of one's own."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("line"))
    found = Sanitizer(KEY, rules=[host_rule(("com", "org", "net", "example"))], json=False).transform(pages)
    return R.matches_of(found, ["page_id"]).groupBy("original").agg(F.count("*").alias("n"))


def allowed_addresses(spark, sf_dir):
    """Addresses that are left when an allow list exempts those of a network and one value."""
    found = _redacted(spark, sf_dir, rules=["ips"], never_patterns=[r"10\.\d+\.\d+\.\d+"], never_values=["192.168.1.1"])
    return R.matches_of(found, ["doc_id", "line_no"]).groupBy("original").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_framing, ip_counts, ip_replacements, ip_first_three, mail_lines, mail_replacements_merged, mail_allowlist, source_tokens, customer_columns, native_tokens, luhn_numbers,
        reserved_addresses, account_remainders, entropy_of_sources, json_lines, key_catalog, sanitized_documents, sanitized_pages, sanitized_conversations, sanitized_json, aggressive_documents, report_preview,
        card_lines, account_lines, security_number_lines, health_number_lines, prescriber_lines, mac_lines, phone_lines, cookie_lines, home_lines, account_name_lines, place_lines, host_lines, host_counts, allowed_addresses,
    )
}


# ---------------------------------------------------------------- SQL

_LINES = r"""
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no
       FROM (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END AS t FROM documents WHERE text <> ''))
"""
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Addresses stand between white space or punctuation, so one character on either side tells; each is doubled first, for neighbours share it.
_IPS = rf"""
WITH {_LINES},
p AS (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '([^0-9A-Za-z_.])', '\1\1', 'g'), '(?:^|[^0-9.A-Za-z_])({_OCTET}(?:[.]{_OCTET}){{3}})(?:$|[^0-9A-Za-z_.]|[.](?:$|[^0-9]))', 1)) AS ip FROM l0),
o AS (SELECT *, string_split(ip, '.') AS s FROM p),
m AS (SELECT doc_id, line_no, ip FROM o
      WHERE NOT (s[1] IN ('0', '127') OR (s[1] = '169' AND s[2] = '254') OR s[1]::INT BETWEEN 224 AND 239
                 OR NOT contains(lpad(bin(s[1]::INT), 8, '0') || lpad(bin(s[2]::INT), 8, '0') || lpad(bin(s[3]::INT), 8, '0') || lpad(bin(s[4]::INT), 8, '0'), '01')))
"""
_MAILS = rf"""
WITH {_LINES},
m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')) AS mail,
             generate_subscripts(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}'), 1) AS seq FROM l0)
"""


def _token(rule: str, prefix: str, value: str) -> str:
    inner = f"sha256(unhex('{INNER}{rule.encode().hex()}00') || encode({value}))"
    return f"'<{prefix}:' || substr(sha256(unhex('{OUTER}') || unhex({inner})), 1, 16) || '>'"


def _put(source: str, key: str, before: str, value: str, after: str, taken: str, rule: str, prefix: str, made: str = "") -> str:
    """Lines before || value || after, with the value's token where it is taken."""
    return f"SELECT {key}, {before} || CASE WHEN {taken} THEN {_token(rule, prefix, value)} ELSE {value} END || {after} AS output FROM (SELECT *{made} FROM {source})"


_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END)) % 10 = 0)"
_CARD = ", '4' || lpad((o_orderkey * 7919 % 100000000000000)::VARCHAR, 14, '0') || (o_orderkey % 10)::VARCHAR AS d"
_SPACED = "(CASE WHEN o_orderkey % 2 = 0 THEN d ELSE d[1:4] || ' ' || d[5:8] || ' ' || d[9:12] || ' ' || d[13:16] END)"
_KEYS = ", ".join(f"({i}, '{r.id}', '{k}', {exact})" for i, r in enumerate(BUILTIN.values()) for exact, keys in (("true", r.json_keys), ("false", r.json_key_contains)) for k in keys)
_SSN = (
    ", lpad((o_orderkey * 31 % 1000)::VARCHAR, 3, '0') AS a, lpad((o_orderkey * 7 % 100)::VARCHAR, 2, '0') AS g,"
    " lpad((CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey * 13 % 10000 END)::VARCHAR, 4, '0') AS s"
)

ORACLES: dict[str, str] = {
    "line_framing": rf"WITH {_LINES} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(c, 0)::BIGINT AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(line)) AS c FROM l0 GROUP BY doc_id) USING (doc_id)",
    "ip_counts": f"{_IPS} SELECT 'ips' AS rule_id, count(*) AS n FROM m HAVING count(*) > 0",
    "ip_replacements": f"{_IPS}, f AS (SELECT ip, count(*) AS n, min((doc_id, line_no)) AS first FROM m GROUP BY ip) SELECT 'ips' AS rule_id, ip AS original, {_token('ips', 'IP', 'ip')} AS replacement, n, first[1] AS first_doc, first[2]::BIGINT AS first_line FROM f",
    "ip_first_three": f"{_IPS}, f AS (SELECT ip, count(*) AS n, min((doc_id, line_no)) AS first FROM m GROUP BY ip) SELECT 'ips' AS rule_id, ip AS original, n FROM f ORDER BY first LIMIT 3",
    "mail_lines": f"{_MAILS} SELECT doc_id, line_no::BIGINT AS line_no, count(*) AS n, string_agg(mail, '|' ORDER BY seq) AS found FROM m GROUP BY ALL",
    "mail_replacements_merged": f"{_MAILS} SELECT mail AS original, {_token('users', 'USER', 'mail')} AS replacement, count(*) AS n, min(doc_id) AS first_doc FROM m GROUP BY mail",
    "mail_allowlist": rf"{_MAILS} SELECT mail AS original, count(*) AS n FROM m WHERE mail NOT IN (SELECT unnest(regexp_extract_all(text, '\b([a-m][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}})', 1)) FROM documents WHERE text IS NOT NULL) GROUP BY mail",
    "source_tokens": f"SELECT doc_id, source AS original, CASE WHEN source IN ('', '-') THEN source ELSE {_token('hosts', 'HOST', 'source')} END AS hostname FROM documents",
    "customer_columns": f"SELECT c_custkey, {_token('users', 'USER', 'c_name')} AS customer_name, c_custkey::VARCHAR AS customer_id FROM customer",
    "native_tokens": f"SELECT doc_id, {_token('ips', 'IP', 'source')} AS token FROM documents",
    "luhn_numbers": r"""
WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9.])([0-9](?:[ -]?[0-9]){12,18})', 1)) AS number FROM documents),
d AS (SELECT *, list_transform(regexp_extract_all(reverse(number), '[0-9]'), lambda x: x::INT) AS ds FROM n)
SELECT doc_id, number, list_sum(list_transform(ds, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0 AND list_max(ds) > 0 AS passes FROM d
""",
    "reserved_addresses": r"""
WITH a AS (SELECT o_orderkey, o_orderkey % 256 AS a, o_orderkey // 7 % 256 AS b, o_orderkey // 3 % 256 AS c, o_orderkey % 2 AS d FROM orders)
SELECT o_orderkey, concat_ws('.', a, b, c, d) AS ip, a IN (0, 127) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239
       OR (((a * 256 + b) * 256 + c) * 256 + d) IN (SELECT 4294967296 - (1::BIGINT << k) FROM range(0, 33) t(k)) AS reserved FROM a
""",
    "account_remainders": r"SELECT c_custkey, ((('32142829' || lpad(c_custkey::VARCHAR, 14, '0') || '1611' || lpad((c_custkey % 100)::VARCHAR, 2, '0'))::HUGEINT) % 97)::BIGINT AS remainder FROM customer",
    "entropy_of_sources": r"""
WITH c AS (SELECT event_id, length(props) AS n, unnest(string_split(props, '')) AS ch FROM events WHERE props <> ''),
k AS (SELECT event_id, n, ch, count(*) AS m FROM c WHERE ch <> '' GROUP BY ALL)
SELECT e.event_id, coalesce(round(1000 * h), 0)::BIGINT AS millibits FROM events e LEFT JOIN (SELECT event_id, sum(-(m / n) * log2(m / n)) AS h FROM k GROUP BY event_id) USING (event_id)
""",
    "json_lines": r"SELECT coalesce(trim(props), '')[1:1] IN ('{', '[') AS is_json, regexp_replace(lower(event_type), '[-_.\s]', '', 'g') AS key, count(*) AS n FROM events GROUP BY ALL",
    "key_catalog": rf"""
WITH k(priority, rule_id, key, exact) AS (VALUES {_KEYS}),
n AS (SELECT priority, rule_id, regexp_replace(lower(key), '[-_.\s]', '', 'g') AS key, exact FROM k),
c AS (SELECT table_name, column_name, regexp_replace(lower(column_name), '[-_.\s]', '', 'g') AS name FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)}))
SELECT table_name, column_name, arg_min(rule_id, (CASE WHEN exact THEN 0 ELSE 1 END, priority)) AS rule_id
FROM c JOIN n ON CASE WHEN exact THEN name = key ELSE contains(name, key) END GROUP BY table_name, column_name
""",
    "sanitized_json": "SELECT event_id, CASE WHEN json_valid(props) AND trim(props)[1:1] IN ('{', '[') THEN json(props)::VARCHAR ELSE props END AS props FROM events",
    "card_lines": _put("orders", "o_orderkey", "'paid by '", _SPACED, "' today'", _LUHN, "paymentInfo", "R", _CARD),
    "account_lines": _put(
        "(SELECT *, 98 - (('32142829' || lpad(c_custkey::VARCHAR, 14, '0') || '161100')::HUGEINT % 97) AS fit FROM customer)", "c_custkey", "'to '", "v", "''", "c_custkey % 4 <> 2 AND q = fit", "paymentInfo", "R",
        ", CASE WHEN c_custkey % 2 = 0 THEN fit ELSE c_custkey % 97 END AS q, CASE WHEN c_custkey % 4 = 2 THEN 'QQ' ELSE 'GB' END || lpad((CASE WHEN c_custkey % 2 = 0 THEN fit ELSE c_custkey % 97 END)::VARCHAR, 2, '0') || 'WEST' || lpad(c_custkey::VARCHAR, 14, '0') AS v",
    ),
    "security_number_lines": _put(
        "orders", "o_orderkey", "'no '", "(a || '-' || g || '-' || s)", "''",
        "s <> '0000' AND CASE WHEN a[1:1] = '9' THEN g::INT BETWEEN 70 AND 88 OR g::INT BETWEEN 90 AND 92 OR g::INT BETWEEN 94 AND 99 ELSE a NOT IN ('000', '666') AND g <> '00' END", "govIds", "R", _SSN,
    ),
    "health_number_lines": _put(
        "orders", "o_orderkey", "'id '", "(d[1:3] || ' ' || d[4:6] || ' ' || d[7:10])", "''", "d <> '0000000000' AND (11 - list_sum(list_transform(range(1, 10), lambda i: d[i]::INT * (11 - i))) % 11) % 11 = d[10]::INT",
        "govIds", "R", ", lpad((o_orderkey * 104729 % 10000000000)::VARCHAR, 10, '0') AS d",
    ),
    "prescriber_lines": _put("orders", "o_orderkey", "'by '", "('AB' || d)", "''", "(d[1]::INT + d[3]::INT + d[5]::INT + 2 * (d[2]::INT + d[4]::INT + d[6]::INT)) % 10 = d[7]::INT", "healthInfo", "R", ", lpad((o_orderkey * 7919 % 10000000)::VARCHAR, 7, '0') AS d"),
    "mac_lines": _put(
        "(SELECT *, lower(lpad(to_hex((o_orderkey * 2654435761 % 140737488355328)::BIGINT), 12, '0')) AS h FROM orders)", "o_orderkey", "'nic '", "v", "' up'", "true", "ips", "IP",
        ", CASE o_orderkey % 3 WHEN 2 THEN h[1:4] || '.' || h[5:8] || '.' || h[9:12] ELSE replace(array_to_string(list_transform(range(0, 6), lambda k: h[2 * k + 1 : 2 * k + 2]), ':'), ':', CASE o_orderkey % 3 WHEN 0 THEN ':' ELSE '-' END) END AS v",
    ),
    "phone_lines": _put("orders", "o_orderkey", "'tel:'", "v", "';'", "length(v) BETWEEN 7 AND 15", "phoneNumbers", "PHONE", ", ('7' || lpad(o_orderkey::VARCHAR, 18, '0'))[1:4] || '123456789123456'[1:(o_orderkey % 16)::INT] AS v"),
    "cookie_lines": _put("orders", "o_orderkey", "'x; '", "v", "'; y'", "length(v) >= 12", "sessionCookies", "R", ", 'sid=' || md5(o_orderkey::VARCHAR)[1:(o_orderkey % 16)::INT] AS v"),
    "home_lines": _put(
        "orders", "o_orderkey", "CASE o_orderkey % 2 WHEN 0 THEN '/home/' ELSE 'C:\\Users\\' END", "v", "CASE o_orderkey % 2 WHEN 0 THEN '/x' ELSE '\\x' END", "v NOT IN ('.', '..')", "paths", "R",
        ", CASE o_orderkey % 5 WHEN 0 THEN '.' WHEN 1 THEN '..' ELSE 'user' || (o_orderkey % 97)::VARCHAR END AS v",
    ),
    "account_name_lines": _put(
        "orders", "o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'C:\\dir\\CORP\\' ELSE 'by CORP\\' END", "v", "' ok'", "o_orderkey % 3 <> 0 AND v <> 'SYSTEM'", "users", "USER",
        ", CASE o_orderkey % 7 WHEN 0 THEN 'SYSTEM' ELSE 'user' || (o_orderkey % 97)::VARCHAR END AS v",
    ),
    "place_lines": _put(
        "orders", "o_orderkey", "'at '", "('(' || lat::VARCHAR || '.000, ' || lon::VARCHAR || '.000)')", "''", "abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0)", "geoLocation", "GEO",
        ", CASE o_orderkey % 13 WHEN 0 THEN 0 ELSE o_orderkey * 17 % 200 - 100 END AS lat, CASE o_orderkey % 13 WHEN 0 THEN 0 ELSE o_orderkey * 23 % 400 - 200 END AS lon",
    ),
    "host_lines": _put(
        "orders", "o_orderkey", "'see '", "v", "' now'", f"({list(HOST_ENDS)})[o_orderkey % {len(HOST_ENDS)} + 1] IN ('com', 'xyz', 'ninja', 'internal', 'co.uk')", "hosts", "HOST",
        f", 'a' || (o_orderkey % 89)::VARCHAR || '.' || ({list(HOST_ENDS)})[o_orderkey % {len(HOST_ENDS)} + 1] AS v",
    ),
    "host_counts": r"""
WITH u AS (SELECT regexp_extract(url, '^https?://(?:[^/@]+@)?([^/?#:]+)', 1) AS original FROM pages)
SELECT original, count(*) AS n FROM u WHERE regexp_matches(original, '[.](com|org|net|example)$') GROUP BY original
""",
    "allowed_addresses": f"{_IPS} SELECT ip AS original, count(*) AS n FROM m WHERE NOT (ip LIKE '10.%') AND ip <> '192.168.1.1' GROUP BY ip",
}
