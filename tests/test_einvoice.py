from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from stammwerk.operators import einvoice as ei


def docs(spark, rows):
    return spark.createDataFrame(rows, "client string, company string, document string, customer string, day date, amount decimal(18,2), cancelled boolean, credit boolean, code string, source string")


def test_documents(spark):
    lines = spark.createDataFrame([("1", "C", "d1", "k1", date(2024, 1, 2), 100.0, "S", False, "x"), ("1", "C", "d1", "k1", date(2024, 1, 1), 30.0, "H", None, "x"), ("1", "C", "d2", "k2", None, None, "S", True, "x"), ("1", "C", "d3", "k1", date(2024, 1, 1), 9.0, "H", False, None), ("1", "C", "d4", "k1", date(2024, 1, 1), 9.0, "S", False, "b")], "mandt string, bukrs string, belnr string, kunnr string, budat date, dmbtr double, shkzg string, stblg boolean, amount string")
    c = {"client": F.col("mandt"), "company": F.col("bukrs"), "document": F.col("belnr"), "customer": F.col("kunnr"), "day": F.col("budat"), "amount": F.col("dmbtr"), "debit": F.col("shkzg") == "S", "cancelled": F.col("stblg")}
    got = {r.document: (r.amount, r.cancelled, r.credit, r.day) for r in ei.accounting_documents(lines, F.col("amount") == "b", **c).collect()}
    assert got == {"d1": (Decimal("70.00"), False, False, date(2024, 1, 1)), "d2": (Decimal("0.00"), True, False, None), "d3": (Decimal("-9.00"), False, True, date(2024, 1, 1))}
    heads = ei.billing_documents(lines.limit(1), document=F.col("belnr"), amount=F.col("dmbtr"))
    assert heads.columns == ei.FORM and tuple(heads.collect()[0])[5:8] == (Decimal("100.00"), False, False)
    assert ei.accounting_documents(lines.limit(0), **c).count() == 0


def test_stages(spark):
    rows = [("1", "C", "a", "k", None, 1000, True, True, "A", "s"), ("1", "C", "b", "k", None, -500, False, True, "A", "s"), ("1", "C", "c", "k", None, 250, False, False, "A", "s"), ("2", "C", "d", "k", None, 900, False, False, "E", "s"), ("1", "C", "e", "k", None, 900, None, None, None, "s"), ("2", "C", "f", "k", None, None, False, False, "A", "s")]
    rows = [(*r[:5], None if r[5] is None else Decimal(r[5]), *r[6:]) for r in rows]
    staged = ei.staged(docs(spark, rows), ei.standard_stages(exempt=F.col("code") == "E"))
    assert {(r.stage, r.n, r.n_duty) for r in ei.excluded(staged).collect()} == {("cancelled", 1, 0), ("credit", 1, 1), ("small", 1, 0), ("exempt", 1, 0), ("remaining", 2, 2)}
    assert {(r.client, r.customer, r.documents, r.volume) for r in ei.volumes(staged).collect()} == {("1", "k", 1, Decimal(900)), ("2", "k", 1, Decimal(0))}
    codes = spark.createDataFrame([("A", "ja", "S"), ("B", " No", "E"), ("C", None, "e"), ("D", "?", None)], "code string, exempt string, category string")
    assert {tuple(r) for r in ei.exempt_codes(codes).collect()} == {("A", True, False), ("B", False, False), ("C", True, True), ("D", False, True)}


def test_periods_and_deadlines(spark):
    days = spark.createDataFrame([(date(2024, 1, 1), date(2024, 12, 31)), (date(2024, 1, 1), date(2024, 1, 3)), (date(2024, 1, 15), date(2024, 3, 1)), (None, None)], "a date, b date")
    got = days.select(ei.months(F.col("a"), F.col("b")).alias("m")).select("m", ei.year_factor(F.col("m"))).collect()
    assert [tuple(r) for r in got] == [(12.0, 1.0), (0.1, 1.0), (3.0, 4.0), (0.0, 1.0)]
    rows = docs(spark, [("1", "c", "a", "k", date(2024, 1, 1), Decimal(100), False, False, None, "s"), ("1", "D", "b", "k", date(2024, 6, 30), Decimal(50), True, False, None, "s"), ("1", "D", "b", "k", date(2024, 6, 1), Decimal(70), False, False, None, "s")])
    revenue = ei.yearly_revenue(rows)
    assert {(r.company, r.revenue) for r in revenue.collect()} == {("c", 200.0), ("D", 140.0)}
    companies = spark.createDataFrame([("C",), ("D",), ("E",)], "company string")
    configured = spark.createDataFrame([("d", 10.0)], "company string, revenue double")
    assert {(r.company, r.revenue, str(r.due), r.origin) for r in ei.deadlines(companies, revenue, configured, 150).collect()} == {("C", 200.0, "2027-01-01", "documents"), ("D", 10.0, "2028-01-01", "configuration"), ("E", None, "None", None)}


def test_hits_and_lights(spark):
    found = spark.createDataFrame([("R", "1", "000007/x"), ("R", None, "8"), ("R", "1", "7"), ("S", "2", "7"), ("S", "2", None)], "rule_id string, mandt string, object_key string")
    customers = spark.createDataFrame([("1", "0007", 2, 10), ("2", "8", 1, 5), ("1", "8", 1, 1)], "client string, customer string, documents long, volume long")
    assert {tuple(r) for r in ei.hit_volumes(found, customers).collect()} == {("R", 3, 4, 16)}
    rules = [("a", "critical", True, 3, 3, 100, 0.2), ("b", "critical", True, 3, 3, 100, None), ("c", "critical", True, 1, 1, 0, None), ("d", "high", True, 0, 0, 5, None), ("e", "critical", False, 9, 9, 9, 1.0), ("f", "critical", True, 6, 6, 100, None), ("f", "low", None, None, None, None, None)]
    got = ei.lights(spark.createDataFrame(rules, "group string, severity string, checkable boolean, n_findings long, n_hit long, n_base long, volume_share double")).collect()
    assert {r.group: r.light for r in got} == {"a": "red", "b": "yellow", "c": "red", "d": "green", "e": "grey", "f": "red"}
