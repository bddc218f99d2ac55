"""Queries on rule documents: one document per customer, read as the configuration of a device."""

from __future__ import annotations

from pyspark.sql import functions as F

from logferry.operators import rules as RU
from logferry.plans import views as V
from logferry.plans.registry import query

# The same text in both engines: a map with one rule, a list with two, and a system block.
_DOCUMENT = """concat(
    '{"componentLogsConfigurationMap":{"seg_', c_mktsegment, '":{"minimumLogLevel":"DEBUG","diskSpaceLimit":"',
    c_custkey % 50, '","diskSpaceLimitUnit":"MB"}},"componentLogsConfiguration":[{"componentName":"nat_', c_nationkey,
    '","logFileRegex":"^n', c_nationkey, '","logFileDirectoryPath":"/data/', c_nationkey,
    '","deleteLogFileAfterCloudUpload":"true"},{"componentName":"seg_MACHINERY","diskSpaceLimit":7}],',
    '"systemLogsConfiguration":{"upload":"', case when c_custkey % 3 = 0 then 'true' else 'false' end,
    '","minimumLogLevel":"WARN","diskSpaceLimit":"1","diskSpaceLimitUnit":"GB"}}')"""

# Written out from the columns, without reading JSON.
_NORMAL = """normal as (
  select c_custkey, 'seg_' || c_mktsegment as component, 'user' as component_type, null as file_regex, null as dir,
    'DEBUG' as min_level, cast(c_custkey % 50 as varchar) as limit_value, 'MB' as limit_unit, null as delete_after
  from customer where c_mktsegment <> 'MACHINERY'
  union all
  select c_custkey, 'nat_' || c_nationkey, 'user', '^n' || c_nationkey, '/data/' || c_nationkey, null, null, null, 'true' from customer
  union all
  select c_custkey, 'seg_MACHINERY', 'user', null, null, null, '7', null, null from customer
  union all
  select c_custkey, 'System', 'system', null, null, 'WARN', '1', 'GB', null from customer where c_custkey % 3 = 0)"""


def documents(spark, sf_dir):
    return V.table(spark, sf_dir, "customer").select("c_custkey", F.expr(_DOCUMENT).alias("config"))


def normal(spark, sf_dir):
    return RU.normalize_rules(documents(spark, sf_dir), ["c_custkey"])


_COLUMNS = ["c_custkey", "component", "component_type", "file_regex", "dir", "min_level"]


@query("normalize_rules", f"""with {_NORMAL}
  select c_custkey, component, component_type, file_regex, dir, min_level, limit_value, limit_unit, delete_after from normal""")
def normalize_rules(spark, sf_dir):
    return normal(spark, sf_dir).select(*_COLUMNS, "limit_value", "limit_unit", "delete_after")


def loggers(spark, sf_dir):
    """Every nation's component has a logger of its own, and so has one segment."""
    n = V.table(spark, sf_dir, "nation")
    own = n.select(
        F.concat(F.lit("nat_"), "n_nationkey").alias("component"), F.lower("n_name").alias("file_stem"),
        F.concat(F.lit("/var/"), "n_name").alias("dir"),
    )
    segment = V.table(spark, sf_dir, "customer").select("c_mktsegment").distinct().where("c_mktsegment = 'BUILDING'")
    return own.unionByName(
        segment.select(
            F.concat(F.lit("seg_"), "c_mktsegment").alias("component"), F.lit("build.er").alias("file_stem"),
            F.lit("/var/seg").alias("dir"),
        )
    )


@query("default_rules", rf"""with {_NORMAL}
  select c_custkey, component, component_type,
    case when component_type = 'system' then '^\Qmain\E\w*.log' when file_regex is not null then file_regex
      when component = 'seg_BUILDING' then '^\Qbuild.er\E\w*.log' else '^\Q' || component || '\E\w*.log' end as file_regex,
    case when component_type = 'system' then '/logs' when dir is not null then dir
      when component = 'seg_BUILDING' then '/var/seg' else '/logs' end as dir,
    coalesce(min_level, 'INFO') as min_level,
    cast(limit_value as bigint) * case limit_unit when 'MB' then 1048576 when 'GB' then 1073741824 else 1024 end as max_bytes,
    coalesce(delete_after = 'true', false) as delete_after
  from normal""")
def default_rules(spark, sf_dir):
    full = RU.default_rules(normal(spark, sf_dir), loggers(spark, sf_dir), "/logs", "main")
    return full.select(*_COLUMNS, "max_bytes", "delete_after")


@query("size_limit_bytes", """
  select o_orderkey, o_orderkey * case o_orderpriority when '1-URGENT' then 1048576 when '2-HIGH' then 1073741824 else 1024 end
    as max_bytes from orders""")
def size_limit_bytes(spark, sf_dir):
    """Order keys as limits; the priority gives the unit, which may be unknown or missing."""
    p = F.col("o_orderpriority")
    unit = F.when(p == "1-URGENT", "MB").when(p == "2-HIGH", "GB").when(p == "3-MEDIUM", "KB").when(p == "4-NOT SPECIFIED", "TB")
    limit = RU.size_limit_bytes(F.col("o_orderkey").cast("string"), unit)
    return V.table(spark, sf_dir, "orders").select("o_orderkey", limit.alias("max_bytes"))


@query("validate_interval", """
  select c_custkey, case when c_acctbal > 0 then c_acctbal else 300.0 end as interval_sec,
    greatest(c_custkey, cast(floor(case when c_acctbal > 0 then c_acctbal else 300.0 end) as bigint)) as save_interval_sec
  from customer""")
def validate_interval(spark, sf_dir):
    """Account balances as upload intervals, customer keys as save intervals."""
    return V.table(spark, sf_dir, "customer").select(
        "c_custkey", *RU.validate_interval(F.col("c_acctbal"), F.col("c_custkey"))
    )


@query("system_rule_switch", """
  select c_custkey, case when c_custkey % 3 = 0 then 'system' else 'user' end as component_type
  from customer where c_custkey % 3 <> 0 or c_acctbal > 0""")
def system_rule_switch(spark, sf_dir):
    """Every third customer is the system rule; it is on if the account has a balance."""
    kind = F.when(F.col("c_custkey") % 3 == 0, "system").otherwise("user")
    flag = F.when(F.col("c_acctbal") > 0, "true").when(F.col("c_acctbal") < 0, "false")
    rules = V.table(spark, sf_dir, "customer").select("c_custkey", kind.alias("component_type"), flag.alias("upload"))
    return RU.system_rule_switch(rules).drop("upload")
