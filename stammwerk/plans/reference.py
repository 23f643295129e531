"""One query per operator family over the whole provided tables, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stammwerk.functions import convert, masking, names, validators
from stammwerk.operators import delivery, duplicates, einvoice, findings, record_parse
from stammwerk.operators.skew import hot_keys, salted_join
from stammwerk.sources.tables import table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2002-01-01"


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def money(c: str) -> F.Column:
    return F.col(c).cast("decimal(18,2)")


# ---- rule shapes: filter, anti join, comparison, alternatives, groups, sums, age ----


@query("SELECT c_custkey, concat_ws(', ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'segment closed' END) AS reason FROM customer WHERE c_acctbal < 0 OR c_mktsegment IN ('BUILDING')")
def rule_filter(spark, root):
    low, shut = F.col("c_acctbal") < 0, F.col("c_mktsegment").isin("BUILDING")
    return table(spark, root, "customer").filter(low | shut).select("c_custkey", F.concat_ws(", ", F.when(low, "negative balance"), F.when(shut, "segment closed")).alias("reason"))


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_orderdate < TIMESTAMP '1997-01-01')")
def rule_orphan(spark, root):
    orders = table(spark, root, "orders").filter("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'")
    return table(spark, root, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)")
def rule_orphan_composite(spark, root):
    items = table(spark, root, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return items.select(*keys).distinct().join(items.filter("l_returnflag = 'R'").select(*keys), keys, "left_anti")


@query("SELECT n_name, o_orderpriority, count(*)::BIGINT AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus <> 'F' AND c_acctbal < o_totalprice GROUP BY ALL")
def rule_multiway(spark, root):
    o, c, n, r = (table(spark, root, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.filter("o_orderstatus <> 'F'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.filter("c_acctbal < o_totalprice").groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE round(c_acctbal) = round(s_acctbal) OR c_custkey = s_suppkey")
def rule_or_join(spark, root):
    """Alternatives become two equi joins and a distinct union; an OR would be a nested loop."""
    c, s = table(spark, root, "customer"), table(spark, root, "supplier")
    near = c.join(s, F.round(c.c_acctbal) == F.round(s.s_acctbal)).select("c_custkey", "s_suppkey")
    return near.unionByName(c.join(s, c.c_custkey == s.s_suppkey).select("c_custkey", "s_suppkey")).distinct()


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags, count(*)::BIGINT AS n FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1")
def rule_grouped(spark, root):
    return table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ", ").alias("flags"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("_d")).filter("_d > 1").drop("_d")


@query("SELECT p_brand, count(*)::BIGINT AS n_parts FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-06-01') GROUP BY p_brand")
def rule_anti_grouped(spark, root):
    used = table(spark, root, "lineitem").filter("l_shipdate >= timestamp_ntz'2001-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, root, "part").join(used, "p_partkey", "left_anti").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))


@query("SELECT o_orderkey, total::DOUBLE AS total, items::DOUBLE AS items FROM (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS items FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS total FROM orders) ON o_orderkey = l_orderkey WHERE abs(total - items) > 0.02")
def rule_reconcile(spark, root):
    items = table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(money("l_extendedprice")).alias("items"))
    orders = table(spark, root, "orders").select("o_orderkey", money("o_totalprice").alias("total"))
    return orders.join(items, "o_orderkey").filter(F.abs(F.col("total") - F.col("items")) > 0.02).select("o_orderkey", F.col("total").cast("double").alias("total"), F.col("items").cast("double").alias("items"))


@query(f"SELECT o_orderkey, date_diff('month', o_orderdate, TIMESTAMP '{AS_OF}')::BIGINT AS months FROM orders WHERE o_orderstatus = 'O' AND date_diff('month', o_orderdate, TIMESTAMP '{AS_OF}') > 48")
def rule_age(spark, root):
    """Month boundaries to a stated day, never the day of the run."""
    at = F.lit(AS_OF).cast("date")
    months = (F.year(at) * 12 + F.month(at) - F.year("o_orderdate") * 12 - F.month("o_orderdate")).cast("bigint")
    return table(spark, root, "orders").filter(F.col("o_orderstatus") == "O").select("o_orderkey", months.alias("months")).filter("months > 48")


_FACTS = {"rule_id": "CUS-RISK-901", "rule_version": "1.0.0", "rule_name": "negative balance", "category": "risk", "severity": "high", "object_area": "customer", "object_type": "customer"}


@query("SELECT md5(concat_ws(chr(31), 'CUS-RISK-901', '1.0.0', c_custkey::VARCHAR)) AS finding_id, 'CUS-RISK-901' AS rule_id, 1 AS severity_rank, c_custkey::VARCHAR AS object_key, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS detail FROM customer WHERE c_acctbal < 0")
def proj_finding(spark, root):
    rows = table(spark, root, "customer").filter("c_acctbal < 0").select("c_custkey", "c_name")
    return findings.as_findings(rows, _FACTS, ["c_custkey"]).select("finding_id", "rule_id", "severity_rank", "object_key", "detail")


# ---- conversions and validators ----


@query("SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 10, '0') AS alpha, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE make_date(2000 + (s_suppkey % 20)::INT, 1 + (s_suppkey % 12)::INT, 1 + (s_suppkey % 28)::INT) END AS day, round(s_acctbal, 2) AS amount FROM supplier")
def conv_all(spark, root):
    k = F.col("s_suppkey")
    day = F.concat_ws(".", (1 + k % 28).cast("string"), (1 + k % 12).cast("string"), (2000 + k % 20).cast("string"))
    cents = F.format_number(F.abs(F.round("s_acctbal", 2)), 2)
    german = F.concat(F.translate(cents, ",.", ".,"), F.when(F.col("s_acctbal") < 0, "-").otherwise(""))
    text = table(spark, root, "supplier").select("s_suppkey", F.concat(F.lit(" "), k.cast("string"), F.lit(" ")).alias("a"), F.when(k % 3 == 0, "00000000").otherwise(day).alias("d"), german.alias("m"))
    return text.select("s_suppkey", convert.conv_alpha(F.col("a"), 10).alias("alpha"), convert.conv_date(F.col("d")).alias("day"), F.round(convert.conv_amount(F.col("m"), True), 2).alias("amount"))


@query("SELECT load_id, count(*)::BIGINT AS n FROM (SELECT load_id, upper(regexp_replace(ean11, '[\\s-]', '', 'g')) AS c FROM mara WHERE trim(coalesce(ean11, '')) <> '') WHERE NOT (regexp_matches(c, '^([0-9]{8}|[0-9]{12,14})$') AND list_sum([substr(c, i::INT, 1)::INT * CASE WHEN (length(c) - i) % 2 = 1 THEN 3 ELSE 1 END for i in generate_series(1, length(c)) if regexp_matches(c, '^[0-9]+$')]) % 10 = 0) GROUP BY load_id")
def val_gtin(spark, root):
    validators.register(spark)
    return table(spark, root, "mara").filter("trim(coalesce(ean11, '')) <> ''").filter(~validators.call("gtin_valid", F.col("ean11"))).groupBy("load_id").agg(F.count(F.lit(1)).alias("n"))


_IBAN = "('DE' || lpad((98 - (((c_custkey * 7919 % 100000000)::HUGEINT * 10000000000 + c_custkey) * 1000000 + 131400) % 97)::VARCHAR, 2, '0') || lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') || lpad(c_custkey::VARCHAR, 10, '0'))"


@query(f"SELECT c_custkey, {_IBAN} AS iban, CASE WHEN c_custkey % 5 = 0 THEN 'length' WHEN c_custkey % 7 = 0 THEN 'check digits' ELSE '' END AS reason FROM customer")
def val_iban(spark, root):
    """Numbers built from keys, with right check digits; every fifth one is cut, every seventh one is broken."""
    validators.register(spark)
    k = F.col("c_custkey")
    bank, account = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"), F.lpad(k.cast("string"), 10, "0")
    check = F.lpad((98 - (F.concat(bank, account, F.lit("131400")).cast("decimal(38,0)") % 97)).cast("int").cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), check, bank, account)
    bad = F.when(k % 5 == 0, F.substring(iban, 1, 21)).when(k % 7 == 0, F.concat(F.lit("DE"), F.lpad(((check.cast("int") + 1) % 100).cast("string"), 2, "0"), bank, account)).otherwise(iban)
    return table(spark, root, "customer").select("c_custkey", iban.alias("iban"), validators.call("iban_reason", bad).alias("reason"))


@query("SELECT schluessel, CASE WHEN trim(coalesce(plz, '')) = '' THEN 'missing' WHEN coalesce(land, '') = '' THEN 'no country' ELSE 'structure' END AS reason FROM candidates WHERE NOT (trim(coalesce(plz, '')) <> '' AND coalesce(land, '') = 'DE' AND regexp_matches(trim(plz), '^[0-9]{5}$'))")
def val_postcode(spark, root):
    validators.register(spark)
    return table(spark, root, "candidates").select("schluessel", validators.call("postal_code_reason", F.col("land"), F.col("plz")).alias("reason")).filter("reason <> ''")


@query("SELECT row_id FROM (SELECT row_id, regexp_replace(upper(maktx), '[^A-Z0-9]', '', 'g') AS c FROM makt WHERE maktx IS NOT NULL) WHERE c = '' OR c IN (" + ", ".join(f"'{w}'" for w in validators.PLACEHOLDERS) + ") OR (length(c) > 1 AND replace(c, left(c, 1), '') = '')")
def val_placeholder(spark, root):
    validators.register(spark)
    return table(spark, root, "makt").filter(validators.call("is_placeholder_text", F.col("maktx"))).select("row_id")


@query(r"SELECT schluessel, CASE WHEN c = '' THEN 'missing' WHEN NOT regexp_matches(c, '^DE[0-9]{9}$') THEN CASE WHEN starts_with(c, 'DE') THEN 'structure' ELSE 'not German' END WHEN (11 - list_reduce([10] || [TRY_CAST(substr(c, i::INT, 1) AS INT) for i in generate_series(3, 10)], lambda p, d: CAST(2 * (CASE WHEN (d + p) % 10 = 0 THEN 10 ELSE (d + p) % 10 END) % 11 AS INT))) % 10 = TRY_CAST(substr(c, 11, 1) AS INT) THEN '' ELSE 'check digit' END AS reason FROM (SELECT schluessel, upper(regexp_replace(coalesce(ustid, ''), '[\s-]', '', 'g')) AS c FROM candidates)")
def val_vat(spark, root):
    """All numbers; those of other countries are only told apart, as SQL would need every country's rule."""
    validators.register(spark)
    german = F.startswith(validators.call("compact", F.col("ustid")), F.lit("DE")) | (validators.call("compact", F.col("ustid")) == "")
    return table(spark, root, "candidates").select("schluessel", F.when(german, validators.call("vat_id_reason", F.col("land"), F.col("ustid"))).otherwise("not German").alias("reason"))


# ---- delivery checks ----


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, count(*)::BIGINT - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dv_dupkey(spark, root):
    return delivery.duplicate_keys(table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'region' AS table_name, (SELECT count(*) FROM region)::BIGINT AS n_rows, 5::BIGINT AS reported, 'ok' AS state UNION ALL SELECT 'nation', (SELECT count(*) FROM nation)::BIGINT, 30::BIGINT, 'differs' UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)::BIGINT, NULL, 'unreported'")
def dv_rowcount(spark, root):
    return delivery.row_counts({t: table(spark, root, t) for t in ("region", "nation", "orders")}, {"region": 5, "nation": 30})


@query("SELECT mandt AS client, count(*)::BIGINT AS n_rows, CASE WHEN mandt IN ('100', '900') THEN 'expected' ELSE 'unexpected' END AS state FROM mara GROUP BY mandt UNION ALL SELECT '900', 0, 'missing' WHERE NOT EXISTS (SELECT 1 FROM mara WHERE mandt = '900')")
def dv_clients(spark, root):
    return delivery.clients(table(spark, root, "mara"), "mandt", ["100", "900"])


@query("WITH c AS (SELECT system_id || '.maktx' AS column_name, length(maktx) AS l, count(*) AS n FROM makt WHERE length(maktx) > 0 GROUP BY ALL), t AS (SELECT column_name, max(l) AS m, sum(n) AS f FROM c GROUP BY 1), x AS (SELECT t.column_name, m, f, sum(CASE WHEN l = m THEN n END) AS a, coalesce(sum(CASE WHEN l < m AND l >= m - 3 THEN n END), 0) / 3.0 AS b FROM c JOIN t USING (column_name) GROUP BY ALL) SELECT column_name, m::INT AS max_length, a::BIGINT AS n_at_max, f::BIGINT AS n_filled FROM x WHERE f >= 100 AND a >= 5 AND a >= f * 0.02 AND m >= 10 AND a >= 3 * b")
def dv_pileup(spark, root):
    """Each old system is judged on its own."""
    return delivery.length_pile_ups(table(spark, root, "makt"), ["maktx"], source="system_id")


@query("SELECT sha256, count(*)::BIGINT AS n, min(file_id) AS first_file FROM source_file WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dv_files(spark, root):
    return delivery.same_content(table(spark, root, "source_file"))


_LIMITS = "(" + ", ".join(map(str, delivery.EXPORT_LIMITS)) + ")"


@query(f"SELECT file_id, coalesce(raw_row_count, 0) AS n_rows, coalesce(rejected_rows, 0) AS n_rejected, CASE WHEN coalesce(rejected_rows, 0) > 0.05 * coalesce(raw_row_count, 0) THEN 'blocking' ELSE 'export limit' END AS state FROM source_file WHERE coalesce(rejected_rows, 0) > 0.05 * coalesce(raw_row_count, 0) OR raw_row_count IN {_LIMITS}")
def dv_parse(spark, root):
    return delivery.reject_ratio(table(spark, root, "source_file"))


@query(f"SELECT file_id, n_rows, 0::BIGINT AS n_rejected, 'export limit' AS state FROM (SELECT o_custkey AS file_id, 499 + count(*)::BIGINT AS n_rows FROM orders GROUP BY 1) WHERE n_rows IN {_LIMITS}")
def dv_export_limit(spark, root):
    """Counts around the smallest known limit."""
    files = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg((F.count(F.lit(1)) + 499).alias("raw_row_count")).withColumn("rejected_rows", F.lit(0).cast("bigint"))
    return delivery.reject_ratio(files)


@query("SELECT table_name, unnest(list_filter([CASE WHEN dated < n THEN 'undocumented' END, CASE WHEN dates > 1 THEN 'differing' END], lambda x: x IS NOT NULL)) AS state, n AS n_files, first_date, last_date FROM (SELECT upper(trim(table_name)) AS table_name, count(*)::BIGINT AS n, count(extraction_date) AS dated, count(DISTINCT extraction_date) AS dates, min(extraction_date) AS first_date, max(extraction_date) AS last_date FROM source_file GROUP BY 1)")
def dv_dates(spark, root):
    return delivery.cut_off_dates(table(spark, root, "source_file").withColumn("table_name", F.upper(F.trim("table_name"))))


@query("SELECT system_id, table_name, problem, problem <> 'unknown columns' AND lower(tier) = 'must' AS blocking, fields FROM (SELECT system_id, table_name, tier, 'missing key' AS problem, list_sort(missing_key_fields) AS fields FROM ingested_table WHERE len(missing_key_fields) > 0 UNION ALL SELECT system_id, table_name, tier, 'empty', [] FROM ingested_table WHERE coalesce(row_count_before_filter, row_count) = 0 UNION ALL SELECT system_id, table_name, tier, 'empty after filter', [] FROM ingested_table WHERE row_count = 0 AND row_count_before_filter > 0 UNION ALL SELECT system_id, table_name, tier, 'unknown columns', list_sort(list_distinct([c for c in columns_seen if NOT list_contains(coalesce(known_fields, []), c)])) FROM ingested_table WHERE len([c for c in columns_seen if NOT list_contains(coalesce(known_fields, []), c)]) > 0)")
def dv_usability(spark, root):
    return delivery.usability(table(spark, root, "ingested_table"))


@query("WITH s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_totalprice < 1000 THEN 1 WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 3 END AS position FROM orders) SELECT position, CASE position WHEN 0 THEN 'cancelled' WHEN 1 THEN 'small' WHEN 2 THEN 'low' ELSE 'remaining' END AS stage, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def ei_waterfall(spark, root):
    return delivery.waterfall(table(spark, root, "orders"), [("cancelled", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 1000), ("low", F.col("o_orderpriority") == "5-LOW")])


@query("SELECT system_id, list_sort([c for c in columns_seen if NOT list_contains(known_fields, c)]) AS unknown FROM (SELECT * FROM ingested_table WHERE len([c for c in columns_seen if NOT list_contains(known_fields, c)]) > 0)")
def cov_unknown(spark, root):
    seen = table(spark, root, "ingested_table").select("system_id", F.array_sort(F.array_except("columns_seen", "known_fields")).alias("unknown"))
    return seen.filter(F.size("unknown") > 0)


# ---- electronic invoices ----


def _billing(spark, root):
    rows = table(spark, root, "orders")
    return einvoice.billing_documents(
        rows, client=F.lit("100"), company=F.concat(F.lit("C"), (F.col("o_custkey") % 5).cast("string")), document=F.col("o_orderkey"), customer=F.col("o_custkey"), day=F.col("o_orderdate"),
        amount=F.round(F.col("o_totalprice"), 2), cancelled=F.col("o_orderstatus") == "P", credit=F.col("o_orderpriority") == "1-URGENT", code=F.substring("o_orderpriority", 1, 1),
    )


_BILLING = "b AS (SELECT '100' AS client, 'C' || (o_custkey % 5) AS company, o_orderkey::VARCHAR AS document, o_custkey::VARCHAR AS customer, o_orderdate::DATE AS day, round(o_totalprice, 2)::DECIMAL(18,2) AS amount, o_orderstatus = 'P' AS cancelled, o_orderpriority = '1-URGENT' AS credit, substr(o_orderpriority, 1, 1) AS code FROM orders), s AS (SELECT *, CASE WHEN cancelled THEN 'cancelled' WHEN credit THEN 'credit' WHEN abs(amount) <= 5000 THEN 'small' WHEN code = '5' THEN 'exempt' END AS stage, NOT (cancelled OR abs(amount) <= 5000 OR code = '5') AS duty FROM b)"


def _staged(spark, root):
    return einvoice.staged(_billing(spark, root), einvoice.standard_stages(5000.0, F.col("code") == "5"))


@query(f"WITH {_BILLING} SELECT client, company, document, customer, day, amount::DOUBLE AS amount, cancelled, credit, code FROM b")
def ei_docs_sd(spark, root):
    return _billing(spark, root).drop("source").withColumn("amount", F.col("amount").cast("double"))


@query("SELECT l_orderkey::VARCHAR AS document, l_suppkey::VARCHAR AS customer, min(l_shipdate)::DATE AS day, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice, 2)::DECIMAL(18,2))::DOUBLE AS amount, bool_or(l_linestatus = 'F' AND l_quantity > 45) AS cancelled, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice, 2)::DECIMAL(18,2)) < 0 AS credit FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2")
def ei_docs_fi(spark, root):
    """Lines as accounting lines: debits less credits per document and customer, without those that come from billing."""
    c = {"document": F.col("l_orderkey"), "customer": F.col("l_suppkey"), "day": F.col("l_shipdate"), "amount": F.round(F.col("l_extendedprice"), 2), "debit": F.col("l_returnflag") != "R", "cancelled": (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)}
    made = einvoice.accounting_documents(table(spark, root, "lineitem"), F.col("l_linenumber") % 3 == 0, **c)
    return made.select("document", "customer", "day", F.col("amount").cast("double").alias("amount"), "cancelled", "credit")


@query(f"WITH {_BILLING} SELECT coalesce(stage, 'remaining') AS stage, count(*)::BIGINT AS n, sum(amount)::DOUBLE AS amount, count(*) FILTER (WHERE duty)::BIGINT AS n_duty FROM s GROUP BY 1")
def ei_exclude(spark, root):
    """Exclusions one after another; credits leave the duty as it is."""
    return einvoice.excluded(_staged(spark, root)).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT o_orderpriority AS code, CASE WHEN lower(trim(substr(o_clerk_said, 1, 3))) IN ('yes') THEN true WHEN lower(trim(substr(o_clerk_said, 1, 3))) IN ('no') THEN false ELSE category IN ('E', 'O') END AS exempt, lower(trim(o_clerk_said)) NOT IN ('yes', 'no') AS approximate FROM (SELECT DISTINCT o_orderpriority, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Yes' WHEN '2' THEN ' no ' ELSE '' END AS o_clerk_said, CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'E' WHEN '4' THEN 'O' ELSE 'S' END AS category FROM orders)")
def ei_exempt(spark, root):
    first = F.substring("o_orderpriority", 1, 1)
    codes = table(spark, root, "orders").select(F.col("o_orderpriority").alias("code"), F.when(first == "1", "Yes").when(first == "2", " no ").otherwise("").alias("exempt"), F.when(first == "5", "E").when(first == "4", "O").otherwise("S").alias("category")).distinct()
    return einvoice.exempt_codes(codes)


@query(f"WITH {_BILLING} SELECT client, customer, count(*)::BIGINT AS documents, sum(amount)::DOUBLE AS volume FROM s WHERE stage IS NULL GROUP BY ALL")
def ei_aggregate(spark, root):
    return einvoice.volumes(_staged(spark, root)).withColumn("volume", F.col("volume").cast("double"))


_YEARLY = "p AS (SELECT min(day) AS a, max(day) AS z FROM b), m AS (SELECT CASE WHEN date_diff('day', a, z) + 1 < 28 THEN round((date_diff('day', a, z) + 1) / 30.44, 2) ELSE (date_diff('month', a, z) + 1)::DOUBLE END AS months FROM p), y AS (SELECT company, count(*)::BIGINT AS documents, any_value(months) AS months, sum(amount)::DOUBLE AS volume, round(sum(amount)::DOUBLE * any_value(CASE WHEN months < 1 OR months >= 12 THEN 1.0 ELSE round(12 / months, 3) END), 2) AS revenue FROM b, m WHERE NOT cancelled GROUP BY company)"


@query(f"WITH {_BILLING}, {_YEARLY} SELECT * FROM y")
def ei_months(spark, root):
    """Revenue per company over the calendar months of all documents, scaled to a year only where the period is shorter."""
    return einvoice.yearly_revenue(_billing(spark, root)).withColumn("volume", F.col("volume").cast("double"))


@query(f"WITH {_BILLING}, {_YEARLY}, k AS (SELECT 'C' || i AS company FROM range(7) t(i)), r AS (SELECT company, CASE WHEN company = 'C1' THEN 5.0 ELSE revenue END AS revenue, CASE WHEN company = 'C1' THEN 'configuration' WHEN revenue IS NOT NULL THEN 'documents' END AS origin FROM k LEFT JOIN y USING (company)) SELECT company, revenue, CASE WHEN revenue > 800000 THEN DATE '2027-01-01' WHEN revenue IS NOT NULL THEN DATE '2028-01-01' END AS due, origin FROM r")
def ei_deadline(spark, root):
    companies = spark.range(7).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("company"))
    return einvoice.deadlines(companies, einvoice.yearly_revenue(_billing(spark, root)), spark.createDataFrame([("c1", 5.0)], "company string, revenue double"))


@query("WITH r AS (SELECT rule_id, min(object_area) AS grp, min(severity) AS severity, count(*)::BIGINT AS n, count(DISTINCT object_key)::BIGINT AS hit FROM findings WHERE run_id = 8 GROUP BY 1), q AS (SELECT *, hit % 7 <> 0 AS checkable, round(hit / 2000, 4) AS quota FROM r) SELECT grp AS \"group\", CASE WHEN NOT bool_or(checkable) THEN 'grey' WHEN bool_or(checkable AND severity = 'critical' AND quota > 0.05) THEN 'red' WHEN bool_or(checkable) THEN 'yellow' ELSE 'green' END AS light, count(*)::BIGINT AS n_rules, sum(n)::BIGINT AS n_findings FROM q GROUP BY 1")
def ei_light(spark, root):
    rows = table(spark, root, "findings").filter("run_id = 8").groupBy("rule_id").agg(F.min("object_area").alias("group"), F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n_findings"), F.count_distinct("object_key").alias("n_hit"))
    return einvoice.lights(rows.withColumn("checkable", F.col("n_hit") % 7 != 0).withColumn("n_base", F.lit(2000)).withColumn("volume_share", F.lit(None).cast("double")))


@query(f"WITH {_BILLING}, v AS (SELECT client, customer, count(*)::BIGINT AS documents, sum(amount) AS volume FROM s WHERE stage IS NULL GROUP BY ALL), h AS (SELECT DISTINCT CASE WHEN c_acctbal < 0 THEN 'R1' ELSE 'R2' END AS rule_id, c_custkey::VARCHAR AS k FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING') SELECT rule_id, count(*)::BIGINT AS customers, sum(documents)::BIGINT AS documents, sum(volume)::DOUBLE AS volume FROM h JOIN v ON customer = k GROUP BY 1")
def ei_hits(spark, root):
    """Volume of the customers that the findings of a rule name, by the first part of the key without its zeros."""
    found = table(spark, root, "customer").filter("c_acctbal < 0 OR c_mktsegment = 'BUILDING'").select(F.when(F.col("c_acctbal") < 0, "R1").otherwise("R2").alias("rule_id"), F.when(F.col("c_custkey") % 2 == 0, "100").alias("mandt"), F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit("/x")).alias("object_key"))
    return einvoice.hit_volumes(found, einvoice.volumes(_staged(spark, root))).withColumn("volume", F.col("volume").cast("double"))


# ---- findings ----

_RUNS = "WITH now AS (SELECT DISTINCT rule_id, finding_id FROM findings WHERE run_id = 8), old AS (SELECT DISTINCT rule_id, finding_id FROM findings WHERE run_id = 7) "


@query(_RUNS + "SELECT coalesce(now.rule_id, old.rule_id) AS rule_id, count(old.finding_id)::BIGINT AS n_before, count(now.finding_id)::BIGINT AS n_now, count(*) FILTER (WHERE old.finding_id IS NULL)::BIGINT AS n_new, count(*) FILTER (WHERE now.finding_id IS NULL)::BIGINT AS n_resolved, count(*) FILTER (WHERE now.finding_id IS NOT NULL AND old.finding_id IS NOT NULL)::BIGINT AS n_unchanged FROM now FULL JOIN old ON now.rule_id = old.rule_id AND now.finding_id = old.finding_id GROUP BY 1")
def fnd_delta(spark, root):
    rows = table(spark, root, "findings")
    return findings.delta_by_rule(rows.filter("run_id = 8"), rows.filter("run_id = 7"))


@query("SELECT data_owner, delta_state, count(*)::BIGINT AS n FROM (SELECT CASE WHEN rule_id = 'QX-VEN-104' THEN 'vendor desk' WHEN category = 'format' THEN 'format desk' WHEN object_area = 'material' THEN 'material desk' ELSE 'data office' END AS data_owner, CASE WHEN finding_id IN (SELECT finding_id FROM findings WHERE run_id = 7) THEN 'unchanged' ELSE 'new' END AS delta_state FROM findings WHERE run_id = 8) GROUP BY ALL")
def fnd_enrich(spark, root):
    rows = table(spark, root, "findings")
    owners = spark.createDataFrame([("rule", "QX-VEN-104", "vendor desk"), ("category", "format", "format desk"), ("area", "material", "material desk")], "kind string, name string, owner string")
    full = findings.with_delta(findings.with_owner(rows.filter("run_id = 8"), owners, "data office"), rows.filter("run_id = 7"))
    return full.groupBy("data_owner", "delta_state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT finding_id, min(reason) AS whitelist_reason FROM (SELECT finding_id, 'agreed' AS reason FROM findings WHERE run_id = 8 AND rule_id = 'QX-MAT-118' UNION ALL SELECT finding_id, 'old plants' FROM findings WHERE run_id = 8 AND regexp_matches(object_key, '^0000.*[12]$') UNION ALL SELECT finding_id, 'client 300' FROM findings WHERE run_id = 8 AND mandt = '300' AND category = category AND rule_id = 'QX-VEN-131') GROUP BY 1")
def fnd_whitelist(spark, root):
    rows = table(spark, root, "findings").filter("run_id = 8")
    entries = [("e1", None, "QX-MAT-118", None, None, None, "agreed", None), ("e2", None, None, None, "0000*[12]", None, "old plants", None), ("e3", None, "QX-VEN-131", None, None, "300", "client 300", "2030-01-01"), ("e4", None, None, None, "*", None, "too late", "2001-01-01")]
    exceptions = spark.createDataFrame(entries, "entry_id string, finding_id string, rule_id string, object_key string, pattern string, mandt string, reason string, expires string").withColumn("expires", F.col("expires").cast("date"))
    return findings.with_exceptions(rows, exceptions, "2025-01-01").filter("whitelisted").groupBy("finding_id").agg(F.min("whitelist_reason").alias("whitelist_reason"))


@query("SELECT finding_id, object_key, loaded_at FROM findings WHERE severity IN ('critical', 'high') AND object_area = 'vendor' AND (object_key ILIKE '%77%' OR rule_name ILIKE '%77%')")
def filter_search(spark, root):
    return findings.search(table(spark, root, "findings"), "77", ("object_key", "rule_name"), severity=["critical", "high"], object_area=["vendor"]).select("finding_id", "object_key", "loaded_at")


@query("SELECT finding_id, rule_id, object_key FROM (SELECT DISTINCT finding_id, rule_id, object_key, severity_rank FROM findings WHERE run_id = 8) ORDER BY severity_rank, rule_id, object_key, finding_id LIMIT 25 OFFSET 50")
def paginate(spark, root):
    rows = table(spark, root, "findings").filter("run_id = 8").select("finding_id", "rule_id", "object_key", "severity_rank").distinct()
    return findings.page(rows, 2, 25).select("finding_id", "rule_id", "object_key")


@query("WITH w AS (SELECT object_area AS area, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS weighted FROM findings WHERE run_id = 8 GROUP BY 1), r AS (SELECT object_area AS area, count(DISTINCT object_key) * 3 AS n_records FROM findings GROUP BY 1) SELECT area, n_records::BIGINT AS n_records, coalesce(weighted, 0)::BIGINT AS weighted, round(100 * (1 - least(coalesce(weighted, 0) / n_records / 3.0, 1.0)), 2) AS score FROM r LEFT JOIN w USING (area)")
def scr_area(spark, root):
    rows = table(spark, root, "findings")
    records = rows.groupBy(F.col("object_area").alias("area")).agg((F.count_distinct("object_key") * 3).alias("n_records"))
    return findings.area_scores(rows.filter("run_id = 8"), records).select("area", "n_records", F.col("weighted").cast("bigint").alias("weighted"), F.col("score").cast("double").alias("score"))


@query("SELECT rule_id, sum(TRY_CAST(json_extract_string(detail, '$.wert') AS DECIMAL(18,2)))::DOUBLE AS effect, count(*)::BIGINT AS n FROM findings WHERE run_id = 8 AND json_valid(detail) GROUP BY 1")
def ei_effect(spark, root):
    """Sums of a number inside the JSON detail, per rule."""
    rows = table(spark, root, "findings").filter("run_id = 8").filter(F.try_parse_json("detail").isNotNull())
    return rows.groupBy("rule_id").agg(F.sum(F.get_json_object("detail", "$.wert").try_cast("decimal(18,2)")).cast("double").alias("effect"), F.count(F.lit(1)).alias("n"))


_EXCEPTED = "coalesce(rule_id = 'QX-MAT-118' AND run_id = 8, false)"


@query(f"WITH a AS (SELECT *, {_EXCEPTED} AS w FROM findings WHERE run_id IN (7, 8)), now AS (SELECT DISTINCT rule_id, finding_id FROM a WHERE run_id = 8 AND NOT w), old AS (SELECT DISTINCT rule_id, finding_id FROM a WHERE run_id = 7 AND NOT w), v AS (SELECT rule_id, max(CASE WHEN run_id = 8 THEN rule_version END) AS vn, max(CASE WHEN run_id = 7 THEN rule_version END) AS vb, count(*) FILTER (WHERE run_id = 8) AS cn, count(*) FILTER (WHERE run_id = 7) AS cb FROM a WHERE NOT w GROUP BY 1), x AS (SELECT rule_id, count(*)::BIGINT AS n FROM old WHERE finding_id IN (SELECT finding_id FROM a WHERE w) GROUP BY 1), d AS (SELECT coalesce(now.rule_id, old.rule_id) AS rule_id, count(old.finding_id)::BIGINT AS n_before, count(now.finding_id)::BIGINT AS n_now, count(*) FILTER (WHERE old.finding_id IS NULL)::BIGINT AS n_new, count(*) FILTER (WHERE now.finding_id IS NULL)::BIGINT AS n_resolved, count(*) FILTER (WHERE now.finding_id IS NOT NULL AND old.finding_id IS NOT NULL)::BIGINT AS n_unchanged FROM now FULL JOIN old ON now.rule_id = old.rule_id AND now.finding_id = old.finding_id GROUP BY 1) SELECT d.*, coalesce(x.n, 0) AS n_newly_excepted, cb = 0 AS only_now, cn = 0 AS only_before, cn > 0 AND cb > 0 AND coalesce(vn, '') <> coalesce(vb, '') AS version_changed FROM d JOIN v USING (rule_id) LEFT JOIN x USING (rule_id)")
def fnd_compare(spark, root):
    """Two runs in full, with exceptions granted in the later one."""
    rows = table(spark, root, "findings").withColumn("whitelisted", F.coalesce((F.col("rule_id") == "QX-MAT-118") & (F.col("run_id") == 8), F.lit(False)))
    return findings.compare_runs(rows.filter("run_id = 8"), rows.filter("run_id = 7"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 40")
def join_residual(spark, root):
    """A true left outer join with a condition beyond equality; customers without a match stay."""
    c, o = table(spark, root, "customer"), table(spark, root, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_totalprice > c.c_acctbal * 40), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_open, bool_and(o_totalprice > 1000) AS all_large, any_value(o_custkey) AS custkey FROM orders GROUP BY 1")
def agg_bool(spark, root):
    return table(spark, root, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_open"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.any_value("o_custkey").alias("custkey"))


# ---- duplicates ----


_SAME = """WITH RECURSIVE h AS (SELECT schluessel AS k, 'v' || regexp_replace(upper(ustid), '[^A-Z0-9]', '', 'g') AS v FROM candidates WHERE regexp_replace(upper(ustid), '[^A-Z0-9]', '', 'g') <> '' UNION SELECT schluessel, 's' || s FROM (SELECT schluessel, regexp_replace(strip_accents(replace(replace(replace(replace(upper(stras), 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE'), 'ẞ', 'SS')), '[^A-Z0-9]', '', 'g') AS s FROM candidates WHERE plz LIKE '1%') WHERE s <> ''),
  f AS (SELECT v, min(k) AS l FROM h GROUP BY v HAVING count(*) > 1), e AS (SELECT DISTINCT k AS a, l AS b FROM h JOIN f USING (v) WHERE k <> l), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(k, l) AS (SELECT a, a FROM b UNION SELECT b.b, r.l FROM r JOIN b ON b.a = r.k), c AS (SELECT k, min(l) AS cluster FROM r GROUP BY k)
"""


@query(_SAME + "SELECT md5(concat_ws(chr(31), 'CUS-DUP-901', '1.0.0', cluster)) AS finding_id, cluster AS object_key, count(*)::BIGINT AS size FROM c GROUP BY cluster")
def dup_findings(spark, root):
    """One finding per cluster over two hard keys: the VAT id, and the street in one postcode region, so clusters chain."""
    rows = table(spark, root, "candidates").select("schluessel", "ustid", F.when(F.col("plz").like("1%"), F.col("stras")).alias("site"))
    found = duplicates.duplicate_clusters(rows, duplicates.Finder(("schluessel",), ("ustid", "site")))
    facts = _FACTS | {"rule_id": "CUS-DUP-901", "category": "duplicate"}
    made = findings.as_findings(found, facts, ["cluster"])
    return made.select("finding_id", "object_key", F.get_json_object("detail", "$.size").cast("bigint").alias("size"))


@query()
def dup_rule(spark, root):
    """The finder as a rule runs it: exact on the VAT id, fuzzy in all five kinds of blocks, one row per cluster; tested against brute force."""
    finder = duplicates.Finder(("schluessel",), ("ustid",), "name", "stras", "plz", "ort", "land", fuzzy=True)
    return duplicates.duplicate_clusters(table(spark, root, "candidates"), finder).select("cluster", "size", "score", "match_type")


@query("SELECT 'postcode' AS strategy, regexp_replace(upper(plz), '[^A-Z0-9]', '', 'g') AS block, count(*)::BIGINT AS n FROM candidates WHERE plz <> '' GROUP BY 2 HAVING count(*) > 1")
def dup_blocks(spark, root):
    rows = table(spark, root, "candidates").withColumn("postcode", names.norm_key(F.col("plz")))
    return duplicates.blocks(rows, "schluessel", ["postcode"]).select("strategy", "block", "n")


_VAT = "WITH v AS (SELECT DISTINCT schluessel AS k, ustid AS v FROM candidates WHERE ustid <> ''), f AS (SELECT v, min(k) AS l FROM v GROUP BY v HAVING count(*) > 1) "


@query(_VAT + "SELECT l AS \"left\", k AS \"right\", 100 AS score FROM v JOIN f USING (v) WHERE k <> l")
def dup_exact(spark, root):
    return duplicates.exact_pairs(table(spark, root, "candidates"), "schluessel", ["ustid"]).select("left", "right", "score")


@query(_VAT + "SELECT k AS key, l AS cluster FROM v JOIN f USING (v)")
def dup_clusters(spark, root):
    return duplicates.clusters(duplicates.exact_pairs(table(spark, root, "candidates"), "schluessel", ["ustid"]))


@query()
def dup_fuzzy(spark, root):
    """Comparison by token-sort ratio inside all five kinds of blocks, which SQL has no equal of; tested against brute force."""
    keys = names.block_keys(F.col("name"), F.col("land"), F.col("plz"), F.col("ort"))
    rows = table(spark, root, "candidates").select("schluessel", names.norm_name(F.col("name")).alias("name"), names.norm_address(F.col("stras"), F.col("plz"), F.col("ort")).alias("address"), *(c.alias(k) for k, c in keys.items()))
    return duplicates.fuzzy_pairs(rows, "schluessel", "name", "address", list(keys)).select("left", "right", "score", "match_type")


# ---- privacy ----


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?', '<iban>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<e-mail>', 'g'), '\\b[A-Z]{2}[0-9]{8,12}\\b', '<vat>', 'g'), '[0-9]{9,}', '<number>', 'g') AS text FROM documents")
def pv_redact(spark, root):
    return table(spark, root, "documents").select("doc_id", masking.redact(F.col("text")).alias("text"))


def _hmac(value: str, key: bytes = b"pepper") -> str:
    """The SQL of an HMAC-SHA256 under a short key."""
    inner, outer = ("".join(f"{k ^ pad:02x}" for k in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({value}))))"


@query(f"SELECT schluessel, CASE WHEN trim(name) = '' THEN name ELSE 'Company ' || upper(substr({_hmac('trim(name)')}, 1, 8)) END AS name, {_hmac('ustid')} AS vat_digest FROM candidates")
def pv_mask(spark, root):
    return table(spark, root, "candidates").select("schluessel", masking.mask(F.col("name"), "company", "pepper").alias("name"), masking.digest(F.col("ustid"), "pepper").alias("vat_digest"))


# ---- files ----


@query("WITH h AS (SELECT file_id, raw_text FROM raw_records WHERE record_no = 1) SELECT r.file_id, (count(*) FILTER (WHERE record_no > 1 AND r.raw_text <> ''))::BIGINT AS n_records, arg_max(line_end, record_no) = '' AS incomplete_last_line FROM raw_records r JOIN h USING (file_id) GROUP BY 1")
def file_records(spark, root):
    return table(spark, root, "raw_records").groupBy("file_id").agg(F.count_if(F.expr("record_no > 1 AND raw_text <> ''")).alias("n_records"), (F.max_by("line_end", "record_no") == "").alias("incomplete_last_line"))


@query("SELECT DISTINCT upper(table_name) AS table_name, regexp_replace(replace(replace(replace(replace(upper(n), 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE'), 'ẞ', 'SS'), '[^A-Z0-9]', '', 'g') AS name, field_name FROM (SELECT table_name, field_name, unnest(list_concat([field_name], coalesce(aliases, []))) AS n FROM registry_field)")
def header_names(spark, root):
    return record_parse.registry_names(table(spark, root, "registry_field")).select("table_name", "name", "field_name")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def join_skewed(spark, root):
    """A join that stays balanced when one key holds a large share: hot keys are cut into splits."""
    items = table(spark, root, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return salted_join(items, orders, "k", hot_keys(items, "k"), F.col("l_linenumber")).select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_custkey")


# ---- more families: ordered unions, samples, top-k, coverage, revenue, file round trips ----


@query("SELECT 1 AS severity_rank, 'A-CUS-001' AS rule_id, c_custkey::VARCHAR AS object_key FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 2, 'A-SUP-001', s_suppkey::VARCHAR FROM supplier WHERE s_acctbal < 0")
def sink_combined(spark, root):
    """All rules as one union in the order of the report."""
    facts = _FACTS | {"rule_id": "A-CUS-001"}
    one = findings.as_findings(table(spark, root, "customer").filter("c_acctbal < 0").select("c_custkey"), facts, ["c_custkey"])
    two = findings.as_findings(table(spark, root, "supplier").filter("s_acctbal < 0").select("s_suppkey"), facts | {"rule_id": "A-SUP-001", "severity": "medium", "object_area": "supplier"}, ["s_suppkey"])
    return one.unionByName(two).orderBy("severity_rank", "rule_id", "object_key").select("severity_rank", "rule_id", "object_key")


@query("SELECT DISTINCT p_type AS value FROM part ORDER BY 1 LIMIT 50")
def distinct_sample(spark, root):
    """The first fifty distinct values: a sampling operator."""
    return table(spark, root, "part").select(F.col("p_type").alias("value")).distinct().orderBy("value").limit(50)


@query("SELECT rule_id, count(*)::BIGINT AS n FROM findings WHERE run_id = 8 GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 15")
def top_rules(spark, root):
    """A top-k report."""
    return table(spark, root, "findings").filter("run_id = 8").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(15)


@query("SELECT object_area, count(*) FILTER (WHERE severity = 'critical')::BIGINT AS n_critical, count(*) FILTER (WHERE severity = 'high')::BIGINT AS n_high, count(DISTINCT object_key)::BIGINT AS n_objects, max(loaded_at) AS latest FROM findings GROUP BY 1")
def summary_counts(spark, root):
    return table(spark, root, "findings").groupBy("object_area").agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "high").alias("n_high"), F.count_distinct("object_key").alias("n_objects"), F.max("loaded_at").alias("latest"))


@query("WITH need AS (SELECT upper(table_name) AS table_name, list(field_name ORDER BY field_name) AS fields FROM registry_field GROUP BY 1) SELECT system_id, [f for f in fields if NOT list_contains(known_fields, f)] AS missing FROM ingested_table i JOIN need n ON n.table_name = upper(i.table_name)")
def cov_matrix(spark, root):
    """Per series the fields of its table that were not delivered."""
    need = table(spark, root, "registry_field").groupBy(F.upper("table_name").alias("table_name")).agg(F.array_sort(F.collect_set("field_name")).alias("fields"))
    seen = table(spark, root, "ingested_table").select("system_id", F.upper("table_name").alias("table_name"), "known_fields")
    return seen.join(need, "table_name").select("system_id", F.array_except("fields", "known_fields").alias("missing"))


@query("WITH c AS (SELECT DISTINCT upper(table_name) AS table_name, system_id, unnest(columns_seen) AS name FROM ingested_table), t AS (SELECT table_name, count(DISTINCT system_id)::BIGINT AS n_files FROM c GROUP BY 1) SELECT c.table_name, name, n_files, count(DISTINCT system_id)::BIGINT AS n_with FROM c JOIN t USING (table_name) GROUP BY ALL HAVING count(DISTINCT system_id) < n_files")
def dv_partial(spark, root):
    columns = table(spark, root, "ingested_table").select(F.upper("table_name").alias("table_name"), F.col("system_id").alias("file_id"), F.explode("columns_seen").alias("name"))
    return delivery.partial_columns(columns)


@query("SELECT 'mara' AS table_name, 'matkl' AS column_name, 9 AS declared, max(length(matkl))::INT AS max_length FROM mara HAVING max(length(matkl)) > 9 UNION ALL SELECT 'mara', 'meins', 2, max(length(meins))::INT FROM mara HAVING max(length(meins)) > 2")
def dv_length(spark, root):
    return delivery.over_declared(table(spark, root, "mara"), {"matkl": 9, "meins": 2}).select(F.lit("mara").alias("table_name"), "column_name", "declared", "max_length")


@query("SELECT process, count(*)::BIGINT AS n FROM findings JOIN (VALUES ('area', 'vendor', 'buying'), ('area', 'customer', 'selling'), ('category', 'duplicate', 'cleansing'), ('rule', 'QX-MAT-118', 'planning')) AS m(kind, name, process) ON (kind = 'area' AND name = object_area) OR (kind = 'category' AND name = category) OR (kind = 'rule' AND name = rule_id) WHERE run_id = 8 GROUP BY 1")
def prc_map(spark, root):
    """Rules belong to processes by area, category or id; each way is an equi join on its own."""
    rows = table(spark, root, "findings").filter("run_id = 8")
    links = spark.createDataFrame([("area", "vendor", "buying"), ("area", "customer", "selling"), ("category", "duplicate", "cleansing"), ("rule", "QX-MAT-118", "planning")], "kind string, name string, process string")
    named = findings.processes_of(rows.select("rule_id", "category", "object_area").distinct(), links)
    return rows.join(named, "rule_id").groupBy("process").agg(F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT n_name, o_totalprice::DECIMAL(18,2) AS v, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey), a AS (SELECT n_name, sum(v) AS volume, count(*)::BIGINT AS documents, (max(m) - min(m) + 1)::BIGINT AS months FROM d GROUP BY 1) SELECT n_name, documents, months, volume::DOUBLE AS volume, round(volume::DOUBLE * 12 / months, 2) AS yearly FROM a")
def ei_revenue(spark, root):
    """Volume per group, scaled from the calendar months it spans to a year."""
    o, c, n = (table(spark, root, t) for t in ("orders", "customer", "nation"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("n_name", money("o_totalprice").alias("v"), month.alias("m"))
    per = rows.groupBy("n_name").agg(F.sum("v").alias("volume"), F.count(F.lit(1)).alias("documents"), (F.max("m") - F.min("m") + 1).cast("bigint").alias("months"))
    return per.select("n_name", "documents", "months", F.col("volume").cast("double").alias("volume"), F.round(F.col("volume").cast("double") * 12 / F.col("months"), 2).alias("yearly"))


@query("WITH hit AS (SELECT DISTINCT ltrim(split_part(lpad(c_custkey::VARCHAR, 10, '0') || '/x', '/', 1), '0') AS k FROM customer WHERE c_acctbal < 0) SELECT count(DISTINCT o_custkey)::BIGINT AS customers, count(*)::BIGINT AS documents, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS volume FROM orders WHERE o_custkey::VARCHAR IN (SELECT k FROM hit)")
def ei_volume(spark, root):
    """Volume of the objects hit by a rule, joined by the first part of the finding's key without leading zeros."""
    keys = table(spark, root, "customer").filter("c_acctbal < 0").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit("/x")).alias("object_key"))
    hit = keys.select(F.ltrim(F.split_part("object_key", F.lit("/"), F.lit(1)), F.lit("0")).alias("k"))
    rows = table(spark, root, "orders").withColumn("k", F.col("o_custkey").cast("string")).join(hit, "k", "left_semi")
    return rows.agg(F.count_distinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("documents"), F.sum(money("o_totalprice")).cast("double").alias("volume"))


@query("SELECT true AS a, false AS b")
def conv_notation(spark, root):
    """The decimal mark of a column, voted by all of its values."""
    prices = F.format_number("p_retailprice", 2)
    text = table(spark, root, "part").select(F.translate(prices, ",.", ".,").alias("a"), prices.alias("b"))
    return convert.comma_votes(text, ["a", "b"])


@query("SELECT schluessel, regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(upper(coalesce(name, '')), 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE'), 'ẞ', 'SS'), 'Æ', 'AE'), 'Ø', 'OE'), 'Œ', 'OE')), '[^A-Z0-9]', '', 'g') AS key FROM candidates")
def norm_key(spark, root):
    return table(spark, root, "candidates").select("schluessel", names.norm_key(F.col("name")).alias("key"))


def _round_trip(spark: SparkSession, kind: str, text: str) -> DataFrame:
    """Writes a small text to the scratch folder and reads it as a delivered file."""
    from pathlib import Path

    from stammwerk.session import Scratch
    from stammwerk.sources import files

    folder = Path(Scratch(spark, "file").path.removeprefix("file://"))
    folder.mkdir(parents=True)
    (folder / "t.txt").write_text(text, encoding="utf-8")
    return files.load(spark, folder / "t.txt").table


@query("SELECT row_id::VARCHAR AS row_id, CASE WHEN row_id % 5 = 0 THEN coalesce(maktx, '') || ';\"' || chr(10) || 'x' ELSE coalesce(maktx, '') END AS maktx FROM makt")
def scan_csv(spark, root):
    """Short texts as delimited files with quoted delimiters, quotes and line breaks, read back by ranges as text."""
    from stammwerk.session import Scratch
    from stammwerk.sources import records

    text = F.when(F.col("row_id") % 5 == 0, F.concat(F.coalesce("maktx", F.lit("")), F.lit(';"\nx'))).otherwise(F.coalesce("maktx", F.lit("")))
    line = F.concat(F.col("row_id").cast("string"), F.lit(';"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    folder = Scratch(spark, "file").path
    table(spark, root, "makt").select(line.alias("value")).write.text(folder)
    found = records.read_records(spark, folder, ";").select("raw_text", F.lit(";").alias("delimiter"), F.lit("cc").alias("types"))
    cells = record_parse.parse(found).filter("reason IS NULL")
    return cells.select(F.col("cells")[0].alias("row_id"), F.col("cells")[1].alias("maktx"))


@query("SELECT r_regionkey::VARCHAR AS \"Key\", r_name AS \"Name\" FROM region")
def scan_framed(spark, root):
    """Regions as a pipe-framed report, read back as text."""
    rows = table(spark, root, "region").orderBy("r_regionkey").collect()  # 5 rows
    return _round_trip(spark, "framed", "Report\n" + "-" * 20 + "\n|Key|Name        |\n" + "-" * 20 + "\n" + "".join(f"|{r.r_regionkey:<3}|{r.r_name:<12}|\n" for r in rows) + "-" * 20 + "\n")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_totalprice % 1 = 0 THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS o_totalprice, strftime(o_orderdate, '%Y%m%d') AS o_orderdate FROM orders")
def scan_parquet(spark, root):
    """Typed columns as canonical text."""
    return convert.typed_to_text(table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderdate"))
