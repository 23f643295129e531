"""Volumes and duties of electronic invoicing, from billing and accounting documents.

Documents of both sources share one form: client, company, document, customer, day, amount, cancelled, credit, code, source. Every figure is one
aggregate over them; a null amount counts as nothing, a null day as no day, a null condition does not hold. Empty tables give no rows, or zeros where a
single row is asked for. Amounts stay decimal, so sums do not depend on order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORM = ["client", "company", "document", "customer", "day", "amount", "cancelled", "credit", "code", "source"]
#: Days under which a period is no month, mean days of a month, and the days from which the duty holds.
LEAST_DAYS, DAYS_A_MONTH = 28, 30.44
DUE_OVER, DUE_UNDER = "2027-01-01", "2028-01-01"


def billing_documents(headers: DataFrame, **columns: Column) -> DataFrame:
    """Documents from billing headers, one row each; columns names FORM's fields, what is missing is null or false."""
    missing = {"cancelled": F.lit(False), "credit": F.lit(False), "source": F.lit("billing")}
    kinds = {"day": "date", "amount": "decimal(18,2)", "cancelled": "boolean", "credit": "boolean"}
    return headers.select(*(columns.get(c, missing.get(c, F.lit(None))).cast(kinds.get(c, "string")).alias(c) for c in FORM))


def accounting_documents(lines: DataFrame, billed: Column | None = None, **columns: Column) -> DataFrame:
    """Documents from accounting lines of customers: one row per document and customer, debits less credits.

    columns: client, company, document, customer, day, amount, debit (boolean), cancelled. Documents that come from billing (`billed`) are left out, where billing
    is delivered too. A document whose credits outweigh its debits is a credit."""
    rows = lines if billed is None else lines.filter(~F.coalesce(billed, F.lit(False)))
    signed = F.coalesce(F.when(columns["debit"], columns["amount"]).otherwise(-columns["amount"]).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    keys = [columns.get(c, F.lit(None)).cast("string").alias(c) for c in ("client", "company", "document", "customer")]
    per = rows.groupBy(*keys).agg(F.min(columns["day"]).cast("date").alias("day"), F.sum(signed).cast("decimal(18,2)").alias("amount"), F.coalesce(F.max(columns.get("cancelled", F.lit(False))), F.lit(False)).alias("cancelled"))
    return per.withColumn("credit", F.col("amount") < 0).withColumn("code", F.lit(None).cast("string")).withColumn("source", F.lit("accounting")).select(*FORM)


def exempt_codes(codes: DataFrame) -> DataFrame:
    """(code, exempt, approximate) of tax codes (code, exempt: yes or no, category): the answer of the assignment, else categories E and O, which is approximate."""
    said = F.lower(F.trim("exempt"))
    answer = F.when(said.isin("yes", "y", "ja", "j", "x", "true", "1"), True).when(said.isin("no", "n", "nein", "false", "0"), False)
    return codes.select("code", F.coalesce(answer, F.upper(F.trim("category")).isin("E", "O"), F.lit(False)).alias("exempt"), answer.isNull().alias("approximate"))


@dataclass(frozen=True)
class Stage:
    """An exclusion; one that only concerns revenue leaves the duty as it is."""

    name: str
    condition: Column
    duty: bool = True


def standard_stages(small: float = 250.0, exempt: Column | None = None) -> list[Stage]:
    stages = [Stage("cancelled", F.col("cancelled")), Stage("credit", F.col("credit"), duty=False), Stage("small", F.abs("amount") <= small)]
    return stages + ([Stage("exempt", exempt)] if exempt is not None else [])


def staged(documents: DataFrame, stages: list[Stage]) -> DataFrame:
    """documents plus stage (the first that holds, null in scope) and duty (whether no stage that concerns the duty holds)."""
    stage, duty = F.lit(None).cast("string"), F.lit(True)
    for s in reversed(stages):
        holds = F.coalesce(s.condition, F.lit(False))
        stage = F.when(holds, s.name).otherwise(stage)
        duty = duty & ~holds if s.duty else duty
    return documents.withColumn("stage", stage).withColumn("duty", duty)


def excluded(rows: DataFrame) -> DataFrame:
    """(stage, n, amount, n_duty) of staged documents in one pass; stage `remaining` for what is in scope."""
    return rows.groupBy(F.coalesce("stage", F.lit("remaining")).alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count_if("duty").alias("n_duty"))


def volumes(rows: DataFrame) -> DataFrame:
    """(client, customer, documents, volume) of the staged documents in scope; the client belongs to the key."""
    return rows.filter("stage IS NULL").groupBy("client", "customer").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("amount"), F.lit(0)).alias("volume"))


def months(first: Column, last: Column) -> Column:
    """Calendar months from first to last; less than four weeks are a part of a month by days; 0 without days."""
    days = F.greatest(F.datediff(last, first), F.lit(0)) + 1
    calendar = ((F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1).cast("double")
    return F.when(first.isNull() | last.isNull(), F.lit(0.0)).when(days < LEAST_DAYS, F.round(days / DAYS_A_MONTH, 2)).otherwise(calendar)


def year_factor(spanned: Column) -> Column:
    """What scales a period to a year: 1 for less than a month, which is no estimate, and for a year or more."""
    return F.when((spanned < 1) | (spanned >= 12), F.lit(1.0)).otherwise(F.round(12 / spanned, 3))


def yearly_revenue(documents: DataFrame) -> DataFrame:
    """(company, documents, months, volume, revenue) over all documents, nothing excluded but the cancelled ones; scaled by the period of all companies."""
    span = documents.agg(months(F.min("day"), F.max("day")).alias("months"))
    per = documents.filter(~F.coalesce("cancelled", F.lit(False))).groupBy("company").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("amount"), F.lit(0)).alias("volume"))
    return per.join(F.broadcast(span)).withColumn("revenue", F.round(F.col("volume").cast("double") * year_factor(F.col("months")), 2)).select("company", "documents", "months", "volume", "revenue")  # one row of span


def deadlines(companies: DataFrame, revenue: DataFrame, configured: DataFrame, threshold: float = 800_000.0) -> DataFrame:
    """(company, revenue, due, origin): configured revenue wins over the one from documents; without any the day stays open.

    companies: company; revenue and configured: company, revenue. Company codes compare in upper case."""
    key = lambda df, name: df.groupBy(F.upper("company").alias("_k")).agg(F.max("revenue").cast("double").alias(name))
    rows = companies.select("company", F.upper("company").alias("_k")).join(key(configured, "_set"), "_k", "left").join(key(revenue, "_found"), "_k", "left")
    amount = F.coalesce("_set", "_found")
    due = F.when(amount > threshold, F.lit(DUE_OVER)).when(amount.isNotNull(), F.lit(DUE_UNDER)).cast("date")
    origin = F.when(F.col("_set").isNotNull(), "configuration").when(F.col("_found").isNotNull(), "documents")
    return rows.select("company", amount.alias("revenue"), due.alias("due"), origin.alias("origin"))


def hit_volumes(findings: DataFrame, customers: DataFrame) -> DataFrame:
    """(rule_id, customers, documents, volume) of the customers that a rule's findings name: the first part of the object key, without leading zeros, and the client
    where the finding has one. customers as from `volumes`."""
    bare = lambda c: F.ltrim(F.trim(c), F.lit("0"))
    hit = findings.select("rule_id", F.coalesce("mandt", F.lit("")).alias("_c"), bare(F.split_part("object_key", F.lit("/"), F.lit(1))).alias("_k")).filter("_k <> ''").distinct()
    rows = customers.select(F.coalesce("client", F.lit("")).alias("client"), bare(F.col("customer")).alias("_k"), "documents", "volume")
    with_client = hit.filter("_c <> ''").join(rows.withColumnRenamed("client", "_c"), ["_c", "_k"])
    without = hit.filter("_c = ''").drop("_c").join(rows.withColumnRenamed("client", "_c"), "_k")
    met = with_client.select("rule_id", "_c", "_k", "documents", "volume").unionByName(without.select("rule_id", "_c", "_k", "documents", "volume")).distinct()
    return met.groupBy("rule_id").agg(F.count(F.lit(1)).alias("customers"), F.sum("documents").alias("documents"), F.sum("volume").alias("volume"))


def lights(rules: DataFrame, quota: float = 0.05, share: float = 0.10) -> DataFrame:
    """(group, light, n_rules, n_findings) from rules: group, severity, checkable, n_findings, n_hit, n_base, volume_share.

    red: a checkable critical rule has findings and its quota is unknown or over the limit, or its volume share is; yellow: any finding; grey: nothing could be
    checked; green otherwise. A group that could not be checked is never green."""
    part = F.when(F.col("n_base") > 0, F.round(F.col("n_hit") / F.col("n_base"), 4))
    checkable = F.coalesce("checkable", F.lit(False))
    hit = checkable & (F.coalesce("n_findings", F.lit(0)) > 0)
    grave = hit & (F.col("severity") == "critical") & (part.isNull() | (part > quota) | F.coalesce(F.col("volume_share") > share, F.lit(False)))
    per = rules.groupBy("group").agg(F.max(checkable).alias("_any"), F.max(hit).alias("_hit"), F.max(grave).alias("_grave"), F.count(F.lit(1)).alias("n_rules"), F.coalesce(F.sum("n_findings"), F.lit(0)).alias("n_findings"))
    light = F.when(~F.col("_any"), "grey").when(F.col("_grave"), "red").when(F.col("_hit"), "yellow").otherwise("green")
    return per.select("group", light.alias("light"), "n_rules", "n_findings")
