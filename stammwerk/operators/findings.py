"""Findings: exceptions, status, owner, comparison with the run before, search, pages and score.

Helper tables (exceptions, status, owners) are small state files kept by people; they are joined by key, and Spark broadcasts them only if
their measured size allows. Null never equals anything in a rule's column unless a condition says so. Empty helper tables leave findings as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["rule_id", "rule_version", "rule_name", "category", "category_label", "requirement", "severity", "severity_rank", "object_area", "object_type", "object_key", "mandt", "bukrs", "detail"]
SEVERITIES = ["critical", "high", "medium", "low"]
WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}


def finding_id(rule_id: Column, version: Column, object_key: Column, client: Column | None = None) -> Column:
    """md5 over rule, version and object key; with a client where one delivery holds several, so that their findings stay apart."""
    parts = [rule_id, version, object_key] + ([F.coalesce(client, F.lit(""))] if client is not None else [])
    return F.md5(F.concat_ws("\x1f", *parts))


def as_findings(rows: DataFrame, facts: dict[str, str], keys: list[str], client: str | None = None, company: str | None = None, multi_client: bool = False) -> DataFrame:
    """Rows of a rule as findings: the rule's facts, the joined key (null parts vanish), and the whole row as JSON with its nulls."""
    key = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    own_client = F.col(client).cast("string") if client else F.lit(None).cast("string")
    facts = {"requirement": "", "category_label": facts.get("category", "").capitalize(), **facts, "severity_rank": str(SEVERITIES.index(facts["severity"]))}
    fixed = {c: F.lit(facts.get(c, "")).cast("int" if c == "severity_rank" else "string") for c in COLUMNS if c not in ("object_key", "mandt", "bukrs", "detail")}
    identity = finding_id(fixed["rule_id"], fixed["rule_version"], key, own_client if multi_client else None)
    return rows.select(
        identity.alias("finding_id"), *(c.alias(n) for n, c in fixed.items()), key.alias("object_key"), own_client.alias("mandt"),
        (F.col(company).cast("string") if company else F.lit(None).cast("string")).alias("bukrs"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("detail"),
    )


def glob_to_regex(pattern: Column) -> Column:
    """*, ? and [...] as a regular expression over the whole text; everything else is literal."""
    literal = F.regexp_replace(pattern, r"([\\.^$+(){}|])", r"\\$1")
    return F.concat(F.lit("^(?:"), F.regexp_replace(F.regexp_replace(F.regexp_replace(literal, r"\*", "[\\\\s\\\\S]*"), r"\?", "[\\\\s\\\\S]"), r"\[!", "[^"), F.lit(r")\z"))


def with_exceptions(findings: DataFrame, exceptions: DataFrame, as_of: str) -> DataFrame:
    """Adds whitelisted, whitelist_reason (the smallest that applies) and exception_ids (all that apply).

    exceptions: entry_id, finding_id, rule_id, object_key, pattern, mandt, reason, expires; null conditions apply to everything. Entries
    that name a finding, a rule or an object key are joined by it; only those that name none are compared with all findings, in one broadcast,
    which their number (`broad` entries, at most 10,000) allows."""
    live = exceptions.filter(F.col("expires").isNull() | (F.col("expires") >= F.lit(as_of).cast("date")))
    base = findings.select("finding_id", "rule_id", "object_key", "mandt").distinct()

    def fits(*skip: str) -> Column:
        terms = [F.col(f"w.{c}").isNull() | (F.col(f"w.{c}") == F.col(f"f.{c}")) for c in ("finding_id", "rule_id", "object_key", "mandt") if c not in skip]
        condition = F.col("w.pattern").isNull() | F.regexp_like("f.object_key", glob_to_regex(F.col("w.pattern")))
        for t in terms:
            condition = condition & t
        return condition

    hits = []
    rest = live
    for column in ("finding_id", "object_key", "rule_id"):
        named = rest.filter(F.col(column).isNotNull())
        rest = rest.filter(F.col(column).isNull())
        hits.append(base.alias("f").join(named.alias("w"), (F.col(f"f.{column}") == F.col(f"w.{column}")) & fits(column)).select("f.*", "w.entry_id", "w.reason"))
    if rest.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 exceptions name neither a finding, a rule nor an object key")
    hits.append(base.alias("f").join(F.broadcast(rest).alias("w"), fits()).select("f.*", "w.entry_id", "w.reason"))
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    keys = ["finding_id", "rule_id", "object_key", "mandt"]
    found = every.groupBy(*keys).agg(F.min("reason").alias("whitelist_reason"), F.array_sort(F.collect_set("entry_id")).alias("exception_ids"))
    same = F.col("f.finding_id") == F.col("x.finding_id")
    for k in keys[1:]:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"x.{k}"))
    return findings.alias("f").join(found.alias("x"), same, "left").select("f.*", F.col("x.whitelist_reason").isNotNull().alias("whitelisted"), "x.whitelist_reason", "x.exception_ids")


def with_status(findings: DataFrame, status: DataFrame) -> DataFrame:
    """status: finding_id, status, note; open where none is set, of several entries the greatest counts."""
    one = status.groupBy("finding_id").agg(F.max(F.struct(parse_state(F.col("status")).alias("s"), "note")).alias("_s"))
    return findings.join(one, "finding_id", "left").withColumn("status", F.coalesce("_s.s", F.lit("open"))).withColumn("status_note", F.col("_s.note")).drop("_s")


def with_owner(findings: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """owners: kind (rule, category, area), name, owner. The most specific entry wins."""
    for kind, column in (("rule", "rule_id"), ("category", "category"), ("area", "object_area")):
        part = owners.filter(F.col("kind") == kind).groupBy(F.col("name").alias(column)).agg(F.min("owner").alias(f"_{kind}"))
        findings = findings.join(part, column, "left")
    return findings.withColumn("data_owner", F.coalesce("_rule", "_category", "_area", F.lit(default))).drop("_rule", "_category", "_area")


def with_delta(findings: DataFrame, before: DataFrame | None) -> DataFrame:
    """delta_state against the run before: new, unchanged, or none where there is nothing to compare with."""
    if before is None:
        return findings.withColumn("delta_state", F.lit("none"))
    known = before.select("finding_id").distinct().withColumn("_k", F.lit(True))
    return findings.join(known, "finding_id", "left").withColumn("delta_state", F.when(F.col("_k"), "unchanged").otherwise("new")).drop("_k")


def delta_by_rule(now: DataFrame, before: DataFrame) -> DataFrame:
    """(rule_id, n_before, n_now, n_new, n_resolved, n_unchanged) over distinct ids."""
    mark = lambda df, name: df.select("rule_id", "finding_id").distinct().withColumn(name, F.lit(1))
    both = mark(now, "a").join(mark(before, "b"), ["rule_id", "finding_id"], "full")
    return both.groupBy("rule_id").agg(F.count("b").alias("n_before"), F.count("a").alias("n_now"), F.count_if(F.col("b").isNull()).alias("n_new"), F.count_if(F.col("a").isNull()).alias("n_resolved"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_unchanged"))


def compare_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """delta_by_rule without excepted findings, plus n_newly_excepted, only_now, only_before and version_changed.

    A finding that is gone because it was excepted is no success: it is counted apart, and still as resolved. Both have a column `whitelisted`; null counts as not
    excepted. Of several versions of a rule in one run the greatest counts."""
    live = lambda df: df.filter(~F.coalesce("whitelisted", F.lit(False)))
    delta = delta_by_rule(live(now), live(before))
    version = lambda df, name: live(df).groupBy("rule_id").agg(F.max("rule_version").alias(name), F.lit(True).alias(f"_{name}"))
    excepted = live(before).select("rule_id", "finding_id").distinct().join(now.filter("whitelisted").select("finding_id").distinct(), "finding_id", "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_newly_excepted"))
    full = delta.join(version(now, "vn"), "rule_id", "left").join(version(before, "vb"), "rule_id", "left").join(excepted, "rule_id", "left")
    both = F.col("_vn").isNotNull() & F.col("_vb").isNotNull()
    return full.select(
        *delta.columns, F.coalesce("n_newly_excepted", F.lit(0)).alias("n_newly_excepted"), F.col("_vb").isNull().alias("only_now"), F.col("_vn").isNull().alias("only_before"),
        (both & (F.coalesce("vn", F.lit("")) != F.coalesce("vb", F.lit("")))).alias("version_changed"),
    )


def processes_of(rules: DataFrame, links: DataFrame) -> DataFrame:
    """(process, rule_id) of rules (rule_id, category, object_area): a link (kind: rule, category or area; name; process) takes in every rule it names."""
    names = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in (("area", "object_area"), ("category", "category"), ("rule", "rule_id"))))
    return rules.select("rule_id", F.inline(names)).join(links, ["kind", "name"]).select("process", "rule_id").distinct()


#: The states of a finding, and those that close it.
STATES, CLOSED = ["open", "in_progress", "accepted", "corrected"], ["accepted", "corrected"]


def parse_state(text: Column) -> Column:
    """A state however it was typed: case, blanks, hyphens and underscores do not matter; what is no state counts as open."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[ _-]+", "_")
    return F.when(plain.isin(STATES), plain).otherwise("open")


def search(findings: DataFrame, text: str | None = None, columns: tuple[str, ...] = ("object_key", "rule_name", "detail"), **allowed: list[str]) -> DataFrame:
    for column, values in allowed.items():
        findings = findings.filter(F.col(column).isin(values))
    if text:
        pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        condition = F.lit(False)
        for column in columns:
            condition = condition | F.coalesce(F.col(column).ilike(pattern), F.lit(False))
        findings = findings.filter(condition)
    return findings


def page(findings: DataFrame, number: int, size: int, most: int = 500) -> DataFrame:
    """One page (from 0) in the order of severity, rule, object key and id."""
    size = max(1, min(size, most))
    return findings.orderBy("severity_rank", "rule_id", "object_key", "finding_id").offset(number * size).limit(size)


def area_scores(findings: DataFrame, records: DataFrame) -> DataFrame:
    """(area, n_records, weighted, score): 100 * max(0, 1 - min(weighted / records / 3, 1)); null without records. findings without exceptions."""
    weight = F.lit(0)
    for name, value in WEIGHTS.items():
        weight = F.when(F.col("severity") == name, value).otherwise(weight)
    weighted = findings.groupBy(F.col("object_area").alias("area")).agg(F.sum(weight).alias("weighted"))
    return records.join(weighted, "area", "left").withColumn("weighted", F.coalesce("weighted", F.lit(0))).withColumn("score", F.when(F.col("n_records") > 0, F.round(100 * (1 - F.least(F.col("weighted") / F.col("n_records") / 3, F.lit(1.0))), 2)))
