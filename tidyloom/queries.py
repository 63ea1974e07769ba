"""One query per operator, over the star-schema tables with errors that the
keys determine, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.functions.corrector import compile_corrector
from tidyloom.functions.detector import compile_detector
from tidyloom.operators import cascade, dependency, detection, metrics, profile, refinement, sampling
from tidyloom.operators.names import RID, col, fixed, mask
from tidyloom.plans import cleaner
from tidyloom.plans.agents import OracleLabel, StaticAgent, rule
from tidyloom.plans.model import CleanerPlan, CorrectionRule, Dependency, DetectorRule
from tidyloom.sources.tables import as_text, make_pair, read_literal_csv, with_row_key, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Dirty views. Parts: the size as text, every third with one of two unit
# suffixes. Orders: the priority as text, every eleventh a sentinel, every
# seventeenth empty. Customers: nation and region by name, every thirteenth
# nation replaced by the next, every nineteenth region blank.
PART_SQL = """part_d as (select p_partkey as rid, cast(p_size as varchar) as clean_size,
  case when p_partkey % 3 = 0 then cast(p_size as varchar) || ' oz' when p_partkey % 7 = 0 then cast(p_size as varchar) || ' OZ.' else cast(p_size as varchar) end as size,
  p_name as name, p_brand as brand, p_type as type from part)"""
ORDER_SQL = """orders_d as (select o_orderkey as rid, o_orderpriority as clean_priority,
  case when o_orderkey % 11 = 0 then 'N/A' when o_orderkey % 17 = 0 then '' else o_orderpriority end as priority, o_orderstatus as status from orders)"""
CUSTOMER_SQL = """customer_d as (select c_custkey as rid, cast(c_nationkey as varchar) as nation_id, n.n_name as clean_nation, r.r_name as clean_region,
  case when c_custkey % 13 = 0 then m.n_name else n.n_name end as nation, case when c_custkey % 19 = 0 then '' else r.r_name end as region, c_mktsegment as segment
  from customer c join nation n on c.c_nationkey = n.n_nationkey join nation m on (c.c_nationkey + 1) % 25 = m.n_nationkey join region r on n.n_regionkey = r.r_regionkey)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    dirty = F.when(key % 3 == 0, F.concat(size, F.lit(" oz"))).when(key % 7 == 0, F.concat(size, F.lit(" OZ."))).otherwise(size)
    return table(spark, sf_dir, "part").select(
        key.alias(RID), size.alias("clean_size"), dirty.alias("size"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    dirty = F.when(key % 11 == 0, "N/A").when(key % 17 == 0, "").otherwise(priority)
    return table(spark, sf_dir, "orders").select(key.alias(RID), priority.alias("clean_priority"), dirty.alias("priority"), F.col("o_orderstatus").alias("status"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # fixed lists of the schema, broadcast by size
    own = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("clean_nation"), F.col("r_name").alias("clean_region"))
    following = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("next_nation"))
    c = table(spark, sf_dir, "customer").join(own, F.col("c_nationkey") == F.col("k")).join(following, (F.col("c_nationkey") + 1) % 25 == F.col("k2"))
    key = F.col("c_custkey")
    return c.select(
        key.alias(RID),
        F.col("c_nationkey").cast("string").alias("nation_id"),
        "clean_nation",
        "clean_region",
        F.when(key % 13 == 0, F.col("next_nation")).otherwise(F.col("clean_nation")).alias("nation"),
        F.when(key % 19 == 0, "").otherwise(F.col("clean_region")).alias("region"),
        F.col("c_mktsegment").alias("segment"),
    )


# Profiles


@query(
    """select 'p_type' as col_name, p_type as value, count(*) as n from part group by p_type
    union all select 'p_brand', p_brand, count(*) from part group by p_brand"""
)
def value_profile(spark, sf_dir):
    return profile.value_profile(table(spark, sf_dir, "part"), ["p_type", "p_brand"])


@query("select p_brand as value, min(p_partkey) as first_row from part group by p_brand")
def rep_first_row(spark, sf_dir):
    return profile.first_rows(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", RID), "p_brand").withColumnRenamed(RID, "first_row")


@query(
    f"""with {PART_SQL}, r as (select size as value, min(rid) as rid from part_d group by size order by size limit 12)
    select r.rid, r.value as dirty, clean_size as clean, r.value <> clean_size as is_error from r join part_d p on r.rid = p.rid"""
)
def rep_labels(spark, sf_dir):
    df = parts(spark, sf_dir)
    values = df.select(F.col("size").alias("value")).distinct().orderBy("value").limit(12)
    return profile.labelled(df, df.select(RID, F.col("clean_size").alias("size")), "size", values).withColumnRenamed(RID, "rid")


@query(
    """with c as (select distinct p_partkey, unnest(string_split(lower(p_name), '')) as char from part)
    select char, count(*) as df from c where regexp_matches(char, '^[a-z0-9]$') group by char"""
)
def char_df(spark, sf_dir):
    return profile.character_frequency(table(spark, sf_dir, "part"), "p_name")


@query(
    """with c as (select distinct p_partkey, unnest(string_split(lower(p_name), '')) as char from part),
    d as (select char, count(*) as df from c where regexp_matches(char, '^[a-z0-9]$') group by char),
    v as (select distinct p_name as value from part),
    u as (select distinct value, unnest(string_split(lower(value), '')) as char from v),
    s as (select u.value, max(1.0::double / d.df) as rarest from u join d on u.char = d.char group by u.value)
    select v.value, cast(floor(1000000 * (coalesce(rarest, 0) + case when lower(v.value) like '%x%' then 0.5 else 0 end + case when regexp_matches(lower(v.value), '[a-z]x[a-z]') then 0.5 else 0 end
      + case when regexp_matches(lower(v.value), '[0-9]+x|x[0-9]') then 0.5 else 0 end + case when regexp_matches(lower(v.value), 'xx') then 0.5 else 0 end)) as bigint) as score_e6
    from v left join s on v.value = s.value"""
)
def artifact_score(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    counted = {r["char"]: r["df"] for r in profile.character_frequency(df, "p_name").collect()}  # characters
    score = profile.artifact_score(F.col("value"), counted)
    return df.select(F.col("p_name").alias("value")).distinct().select("value", F.floor(score * 1000000).cast("long").alias("score_e6"))


@query(f"with {CUSTOMER_SQL} select nation as value, bool_or(nation <> clean_nation) as is_error from customer_d group by nation")
def oracle_labels(spark, sf_dir):
    df = customers(spark, sf_dir)
    return profile.oracle_labels(df, df.select(RID, F.col("clean_nation").alias("nation")), "nation")


@query(
    f"""with {CUSTOMER_SQL}, p as (select nation as dirty, clean_nation as clean, count(*) as n, min(rid) as first from customer_d group by 1, 2),
    r as (select *, row_number() over (partition by dirty order by first, clean) as place from p)
    select dirty, cast(sum(n) as bigint) as frequency, min(case when place = 1 then clean end) as clean, count(*) > 1 as ambiguous, count(*) as distinct_clean,
      string_agg(clean, '|' order by place) filter (where place <= 4) as examples from r group by dirty"""
)
def ambiguity_items(spark, sf_dir):
    df = customers(spark, sf_dir)
    return profile.ambiguity_items(df, df.select(RID, F.col("clean_nation").alias("nation")), "nation").withColumn("examples", F.array_join("examples", "|"))


@query(f"with {PART_SQL} select cast(count(*) filter (where size like '%oz' and size <> clean_size) as double) / count(*) filter (where size like '%oz') as precision from part_d")
def oracle_precision(spark, sf_dir):
    df = parts(spark, sf_dir).withColumn("is_error", F.col("size") != F.col("clean_size"))
    return profile.rule_precision(df, compile_detector(rule("col.str.endswith('oz', na=False)").code, F.col("size")))


# Detectors, one query for each word of the rule language


def _marks(name: str, source: Query, key: str, column: str, expression: str, condition: str, sql_table: str, with_sql: str = "") -> None:
    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        return df.select(col(key).alias("rid"), compile_detector(rule(expression).code, col(column)).alias("marked"))

    run.__name__ = name
    query(f"{with_sql} select {key if key != RID else 'rid'} as rid, coalesce({condition}, false) as marked from {sql_table}")(run)


_part = lambda spark, sf_dir: table(spark, sf_dir, "part")
_customer = lambda spark, sf_dir: table(spark, sf_dir, "customer")
_documents = lambda spark, sf_dir: table(spark, sf_dir, "documents")
_pages = lambda spark, sf_dir: table(spark, sf_dir, "pages")
_marks("sentinel_mask", orders, RID, "priority", "col.eq('N/A')", "priority = 'N/A'", "orders_d", f"with {ORDER_SQL}")
_marks("not_equal_mask", orders, RID, "priority", "col.ne('N/A') & (col != '')", "priority <> 'N/A' and priority <> ''", "orders_d", f"with {ORDER_SQL}")
_marks("contains_literal_mask", parts, RID, "size", "col.astype(str).str.contains('oz', regex=False, na=False)", "contains(size, 'oz')", "part_d", f"with {PART_SQL}")
_marks("contains_regex_mask", parts, RID, "size", r"col.str.contains('(?i)[0-9]+ oz\\.?$', na=False)", r"regexp_matches(size, '(?i)[0-9]+ oz\.?$')", "part_d", f"with {PART_SQL}")
_marks("startswith_mask", _part, "p_partkey", "p_type", "col.str.startswith(('PROMO', 'ECONOMY'), na=False)", "starts_with(p_type, 'PROMO') or starts_with(p_type, 'ECONOMY')", "part")
_marks("endswith_mask", _customer, "c_custkey", "c_name", "col.str.endswith('7', na=False)", "c_name like '%7'", "customer")
_marks("match_mask", _part, "p_partkey", "p_brand", "col.str.match('Brand#[12]', na=False)", "regexp_matches(p_brand, '^Brand#[12]')", "part")
_marks("fullmatch_mask", _part, "p_partkey", "p_brand", "col.str.fullmatch('Brand#[0-9]', na=False) | col.str.fullmatch('Brand#[0-9]3', na=False)", "regexp_full_match(p_brand, 'Brand#[0-9]') or regexp_full_match(p_brand, 'Brand#[0-9]3')", "part")
_marks("isin_mask", _customer, "c_custkey", "c_mktsegment", "col.isin(['BUILDING', 'MACHINERY'])", "c_mktsegment in ('BUILDING', 'MACHINERY')", "customer")
_marks("length_mask", _customer, "c_custkey", "c_mktsegment", "(col.str.len() > 8) & ~col.str.lower().eq('household')", "length(c_mktsegment) > 8 and lower(c_mktsegment) <> 'household'", "customer")
_marks("nothing_mask", _customer, "c_custkey", "c_name", "col.isin([])", "false", "customer")
_marks("null_mask", _customer, "c_custkey", "c_name", "col.isna() | col.fillna('').eq('') | ~col.notna()", "c_name is null or c_name = ''", "customer")
_marks("strip_mask", orders, RID, "priority", "col.str.strip().str.upper().eq('')", "trim(priority) = ''", "orders_d", f"with {ORDER_SQL}")
_marks("doc_pattern_mask", _documents, "doc_id", "text", "col.str.contains('(?i)all rights reserved', na=False) | col.str.contains('@[a-z]+[.](com|net|org)', na=False)", "regexp_matches(text, '(?i)all rights reserved') or regexp_matches(text, '@[a-z]+[.](com|net|org)')", "documents")
_marks("page_pattern_mask", _pages, "page_id", "html", "col.str.contains('</body></html>', regex=False, na=False)", "contains(html, '</body></html>')", "pages")


@query(f"with {ORDER_SQL} select rid, priority = 'N/A' or priority = '' as marked from orders_d")
def mask_or(spark, sf_dir):
    df = orders(spark, sf_dir)
    df = df.withColumn("a__priority", compile_detector(rule("col.eq('N/A')").code, F.col("priority"))).withColumn("b__priority", compile_detector(rule("col.eq('')").code, F.col("priority")))
    return detection.union_masks(df, ["priority"], "a__", "b__").select(F.col(RID).alias("rid"), F.col(mask("priority")).alias("marked"))


# Corrections

OZ = CorrectionRule("regex_sub", r"\s*(?:oz|OZ\.)$", "", guard="(?i)oz")
PRIORITY = {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"}


def _fixes(name: str, source: Query, column: str, change: CorrectionRule, sql: str) -> None:
    def run(spark, sf_dir):
        return source(spark, sf_dir).select(F.col(RID).alias("rid"), compile_corrector(change, col(column)).alias("value"))

    run.__name__ = name
    query(sql)(run)


_fixes("code_regex_sub", parts, "size", CorrectionRule("regex_sub", r"^([0-9]+)\s*(?:oz|OZ\.)$", r"\1"), f"with {PART_SQL} select rid, regexp_replace(size, '^([0-9]+)\\s*(?:oz|OZ\\.)$', '\\1', 'g') as value from part_d")
_fixes("code_guard", parts, "size", OZ, f"with {PART_SQL} select rid, case when regexp_matches(size, '(?i)oz') then regexp_replace(size, '\\s*(?:oz|OZ\\.)$', '', 'g') else size end as value from part_d")
_fixes("code_mapping", orders, "priority", CorrectionRule("mapping", mapping=PRIORITY), f"with {ORDER_SQL} select rid, case priority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' when '5-LOW' then 'low' else priority end as value from orders_d")
_fixes("code_constant", orders, "priority", CorrectionRule("constant", value="", guard="^N/A$"), f"with {ORDER_SQL} select rid, case when priority = 'N/A' then '' else priority end as value from orders_d")
_fixes("code_identity", orders, "priority", CorrectionRule("none"), f"with {ORDER_SQL} select rid, priority as value from orders_d")


@query(f"with {PART_SQL} select bool_and(case when regexp_matches(size, '(?i)oz') then regexp_replace(size, '\\s*(?:oz|OZ\\.)$', '', 'g') else size end = clean_size) as passes from part_d")
def gate_code(spark, sf_dir):
    labels = parts(spark, sf_dir).select(F.col("size").alias("dirty"), F.col("clean_size").alias("clean"))  # every row has its clean value here
    return spark.createDataFrame([(cascade.code_gate(labels, OZ),)], "passes boolean")


@query(f"with {PART_SQL} select bool_and(regexp_replace(size, '\\s*oz$', '', 'g') = clean_size) as passes from part_d")
def gate_code_fails(spark, sf_dir):
    labels = parts(spark, sf_dir).select(F.col("size").alias("dirty"), F.col("clean_size").alias("clean"))
    return spark.createDataFrame([(cascade.code_gate(labels, CorrectionRule("regex_sub", r"\s*oz$", "")),)], "passes boolean")


# Dependencies

NATION = Dependency("nation_id", "nation")
REGION = Dependency("nation", "region")
MODES_SQL = """counted as (select nation_id as det, nation as v, count(*) as n from customer_d group by 1, 2),
  modes as (select det, v as mode from (select *, row_number() over (partition by det order by n desc, v) as place from counted) where place = 1)"""
REGION_MODES_SQL = """r_counted as (select nation as det, region as v, count(*) as n from customer_d where region <> '' group by 1, 2),
  r_modes as (select det, v as mode from (select *, row_number() over (partition by det order by n desc, v) as place from r_counted) where place = 1)"""


@query(f"with {CUSTOMER_SQL}, {MODES_SQL} select det, mode from modes")
def fd_mode(spark, sf_dir):
    return dependency.conditional_modes(customers(spark, sf_dir), [NATION]).select("det", "mode")


@query(f"with {CUSTOMER_SQL}, {MODES_SQL} select rid, nation, mode is not null and nation <> mode as marked from customer_d left join modes on nation_id = det")
def fd_deviation(spark, sf_dir):
    return dependency.deviations(customers(spark, sf_dir), [NATION]).select(F.col(RID).alias("rid"), "nation", F.col("d__nation").alias("marked"))


@query(f"with {CUSTOMER_SQL}, {REGION_MODES_SQL} select det, mode from r_modes")
def fd_double_filter(spark, sf_dir):
    df = detection.intra_masks(customers(spark, sf_dir), {"region": rule("col.eq('')").code})
    return dependency.conditional_modes(df, [REGION]).select("det", "mode")


@query(
    f"""with {CUSTOMER_SQL}, t as (select nation_id as det, segment as v, rid % 2 as half from customer_d),
    c as (select det, v, count(*) // 1 as n from (select det, v from t union all select det, v || '-b' from t) group by 1, 2)
    select det, v as mode from (select *, row_number() over (partition by det order by n desc, v) as place from c) where place = 1"""
)
def fd_tie(spark, sf_dir):
    df = customers(spark, sf_dir)
    twice = df.select("nation_id", "segment").unionByName(df.select("nation_id", F.concat("segment", F.lit("-b")).alias("segment")))
    return dependency.conditional_modes(twice, [Dependency("nation_id", "segment")]).select("det", "mode")


@query(
    f"""with {CUSTOMER_SQL}, {MODES_SQL}, {REGION_MODES_SQL}
    select rid, m.mode is not null and nation <> m.mode as nation_marked, r.mode is not null and region <> r.mode as region_marked
    from customer_d left join modes m on nation_id = m.det left join r_modes r on nation = r.det"""
)
def fd_chained(spark, sf_dir):
    df = detection.intra_masks(customers(spark, sf_dir), {"region": rule("col.eq('')").code})
    out = dependency.deviations(df, [NATION, REGION])
    return out.select(F.col(RID).alias("rid"), F.col("d__nation").alias("nation_marked"), F.col("d__region").alias("region_marked"))


@query(
    f"""with {CUSTOMER_SQL}, l as (select rid, nation_id as det, nation as own, clean_nation as clean, nation <> clean_nation as is_error from customer_d),
    c as (select nation_id as det, nation as v, count(*) as n from customer_d group by 1, 2),
    k as (select l.*, c.v, c.n - case when not is_error and c.v = own then 1 else 0 end as n from l left join c on l.det = c.det),
    p as (select *, row_number() over (partition by rid order by n desc, v) as place from k where n > 0)
    select l.rid, coalesce(p.v, l.own) as predicted, coalesce(p.v, l.own) = l.clean as passes from l left join p on l.rid = p.rid and p.place = 1"""
)
def fd_gate_loo(spark, sf_dir):
    df = customers(spark, sf_dir)
    labels = df.select(RID, F.col("clean_nation").alias("clean"), (F.col("nation") != F.col("clean_nation")).alias("is_error"))  # every row has its clean value here
    return dependency.gate_rows(df, labels, NATION).select(F.col(RID).alias("rid"), "predicted", "passes")


MI_SQL = f"""with {CUSTOMER_SQL}, l as (select rid, 'nation_id' as c, nation_id as v from customer_d union all select rid, 'nation', nation from customer_d
    union all select rid, 'region', region from customer_d union all select rid, 'segment', segment from customer_d),
  k as (select a.c, b.c as c2, a.v as x, b.v as y, count(*)::double as k from l a join l b on a.rid = b.rid group by 1, 2, 3, 4 having count(*) >= 2 or a.c = b.c),
  w as (select *, sum(k) over (partition by c, c2, x) as kx, sum(k) over (partition by c, c2, y) as ky, sum(k) over (partition by c, c2) as t from k),
  mi as (select c, c2, greatest(0, sum(k / t * ln(t * k / (kx * ky)))) as mi from w group by 1, 2)"""
MI_COLUMNS = ["nation_id", "nation", "region", "segment"]


@query(f"{MI_SQL} select c as target, c2 as candidate, cast(round(mi * 10000) as bigint) as mi_e4 from mi")
def mi_matrix(spark, sf_dir):
    return dependency.mutual_information(customers(spark, sf_dir), MI_COLUMNS).select("target", "candidate", F.round(F.col("mi") * 10000).cast("long").alias("mi_e4"))


@query(f"{MI_SQL}, m as (select *, max(mi) over (partition by c) as most from mi) select c as target, c2 as candidate from m where c <> c2 and mi / most >= cast(0.45 as double)")
def mi_candidates(spark, sf_dir):
    return dependency.determinant_candidates(customers(spark, sf_dir), MI_COLUMNS).select("target", "candidate")


# The whole cleaner

PART_PLAN = CleanerPlan(("size",), {"size": rule("col.str.contains('(?i)oz', na=False)")}, {"size": OZ})
CUSTOMER_PLAN = CleanerPlan(
    ("nation", "region"),
    {"region": rule("col.eq('')")},
    {"region": CorrectionRule("constant", value="AFRICA", guard="^no region$")},
    detect=(NATION,),
    correct=(NATION, Dependency("nation_id", "region")),
)
APPLIED_SQL = f"""{CUSTOMER_SQL}, {MODES_SQL},
  marked as (select c.*, region = '' as m_region, mode is not null and nation <> mode as m_nation from customer_d c left join modes on nation_id = det),
  n_counted as (select nation_id as det, nation as v, count(*) as n from marked where not m_nation group by 1, 2),
  n_modes as (select det, v as mode from (select *, row_number() over (partition by det order by n desc, v) as place from n_counted) where place = 1),
  g_counted as (select nation_id as det, region as v, count(*) as n from marked where not m_region group by 1, 2),
  g_modes as (select det, v as mode from (select *, row_number() over (partition by det order by n desc, v) as place from g_counted) where place = 1),
  applied as (select k.*, case when m_nation and a.mode is not null and a.mode <> nation then a.mode else nation end as x_nation,
    case when m_region and b.mode is not null and b.mode <> region then b.mode else region end as x_region from marked k left join n_modes a on nation_id = a.det left join g_modes b on nation_id = b.det)"""


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaner.apply_plan(customers(spark, sf_dir), CUSTOMER_PLAN)


@query(f"with {APPLIED_SQL} select rid, x_nation as nation, x_region as region from applied")
def cascade_full(spark, sf_dir):
    return cleaner.corrected(applied(spark, sf_dir), ["nation", "region"], [RID, "nation", "region"]).withColumnRenamed(RID, "rid")


@query(f"with {APPLIED_SQL} select rid, case when m_nation and a.mode <> nation then a.mode end as repair from applied k left join n_modes a on nation_id = a.det")
def fd_correct(spark, sf_dir):
    changed = F.when(F.col("t__nation") == cleaner.BY_DEPENDENCY, F.col("x__nation"))
    return applied(spark, sf_dir).select(F.col(RID).alias("rid"), changed.alias("repair"))


@query(f"with {APPLIED_SQL} select rid, m_nation and x_nation = nation as nation, m_region and x_region = region as region from applied")
def flags(spark, sf_dir):
    return cleaner.flags(applied(spark, sf_dir), ["nation", "region"], [RID]).withColumnRenamed(RID, "rid")


@query(
    f"""with {APPLIED_SQL} select 'nation' as col_name, count(*) filter (where m_nation) as marked, 0::bigint as code, count(*) filter (where m_nation and x_nation <> nation) as dependency,
    count(*) filter (where m_nation and x_nation = nation) as unresolved from applied union all
    select 'region', count(*) filter (where m_region), 0, count(*) filter (where m_region and x_region <> region), count(*) filter (where m_region and x_region = region) from applied"""
)
def trail_counts(spark, sf_dir):
    return cleaner.trail_counts(applied(spark, sf_dir), ["nation", "region"])


@query(
    f"""with {PART_SQL}, a as (select *, regexp_matches(size, '(?i)oz') as m, case when regexp_matches(size, '(?i)oz') then regexp_replace(size, '\\s*(?:oz|OZ\\.)$', '', 'g') else size end as x from part_d)
    select rid, size as dirty, x as value, m and x = size as flagged from a"""
)
def code_cascade(spark, sf_dir):
    return cleaner.apply_plan(parts(spark, sf_dir), PART_PLAN).select(F.col(RID).alias("rid"), F.col("size").alias("dirty"), F.col("x__size").alias("value"), F.col("f__size").alias("flagged"))


# Metrics


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = applied(spark, sf_dir)
    return df.withColumns({"k__nation": F.col("clean_nation"), "k__region": F.col("clean_region"), "k__segment": F.col("segment")})


def _per_column(select: str) -> str:
    rows = [("nation", "nation", "clean_nation", "m_nation", "x_nation"), ("region", "region", "clean_region", "m_region", "x_region"), ("segment", "segment", "segment", "false", "segment")]
    cells = " union all ".join(f"select rid, '{n}' as col_name, {d} as dirty, {c} as clean, {m} as m, {x} as x from applied" for n, d, c, m, x in rows)
    return f"with {APPLIED_SQL}, cells as ({cells}), w as (select *, dirty <> clean as wrong, x <> dirty as changed from cells) {select}"


DETECTION_SQL = """, t as (select col_name, count(*) as cells, count(*) filter (where m and wrong) as tp, count(*) filter (where m and not wrong) as fp,
  count(*) filter (where not m and wrong) as fn, count(*) filter (where not m and not wrong) as tn from w {where} group by col_name),
  r as (select *, case when tp + fn > 0 then case when tp + fp > 0 then tp::double / (tp + fp) else 0.0::double end end as precision, case when tp + fn > 0 then tp::double / (tp + fn) end as recall from t)
  select col_name, cells, tp, fp, fn, tn, precision, recall, case when tp + fn > 0 then case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end end as f1, tp + fn > 0 as measurable from r"""
COLUMNS = ["nation", "region", "segment"]


@query(_per_column(DETECTION_SQL.format(where="")[0:]).replace("wrong, x <> dirty as changed from cells) ,", "wrong, x <> dirty as changed from cells),"))
def metric_detection(spark, sf_dir):
    return metrics.detection_metrics(measured(spark, sf_dir), COLUMNS)


@query(_per_column(DETECTION_SQL.format(where="where rid % 100 <> 0")).replace("from cells) ,", "from cells),"))
def holdout_anti(spark, sf_dir):
    df = measured(spark, sf_dir)
    return metrics.detection_metrics(df, COLUMNS, df.where(F.col(RID) % 100 == 0).select(RID))  # labelled rows are held out


CORRECTION_SQL = """, t as (select col_name, count(*) as cells, count(*) filter (where wrong) as wrong, count(*) filter (where not wrong) as "right",
  count(*) filter (where wrong and x = clean) as hits, count(*) filter (where not wrong and x <> clean) as damage from w group by col_name)
  select *, hits::double / nullif(wrong, 0) as hit_rate, damage::double / nullif("right", 0) as damage_rate from t"""


@query(_per_column(CORRECTION_SQL).replace("from cells) ,", "from cells),"))
def metric_correction(spark, sf_dir):
    return metrics.correction_metrics(measured(spark, sf_dir), COLUMNS)


REPAIR_SQL = """, t as (select col_name, count(*) filter (where wrong) as errors, count(*) filter (where changed) as changes, count(*) filter (where changed and wrong and x = clean) as tp,
  count(*) filter (where m and not changed) as flags from w group by col_name),
  r as (select *, errors > 0 as measurable, case when errors > 0 then tp::double / nullif(changes, 0) end as precision, case when errors > 0 then tp::double / errors end as recall from t)"""


@query(_per_column(REPAIR_SQL + " select *, case when precision is not null and recall is not null then case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end end as f1 from r").replace("from cells) ,", "from cells),"))
def metric_repair(spark, sf_dir):
    return metrics.repair_metrics(measured(spark, sf_dir), COLUMNS)


@query(
    _per_column(
        REPAIR_SQL
        + """, s as (select cast(coalesce(sum(errors) filter (where measurable), 0) as bigint) as errors, cast(coalesce(sum(changes) filter (where measurable), 0) as bigint) as changes,
    cast(coalesce(sum(tp) filter (where measurable), 0) as bigint) as tp, cast(sum(flags) as bigint) as flags from r),
    q as (select *, tp::double / nullif(changes, 0) as precision, coalesce(tp::double / nullif(errors, 0), 0) as recall from s)
    select *, case when precision is not null then case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0::double end end as f1 from q"""
    ).replace("from cells) ,", "from cells),")
)
def metric_total(spark, sf_dir):
    return metrics.repair_total(metrics.repair_metrics(measured(spark, sf_dir), COLUMNS))


# Sources


@query(f"with {CUSTOMER_SQL} select nation, region, segment, count(*) as n from customer_d group by 1, 2, 3")
def csv_round_trip(spark, sf_dir):
    """Written as CSV and read back literally: empty cells stay empty texts."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared}/tidyloom/{spark.sparkContext.applicationId}/customers-{uuid.uuid4().hex[:12]}.csv"
    write_table(customers(spark, sf_dir).select("nation", "region", "segment"), path, "csv")
    return read_literal_csv(spark, path).groupBy("nation", "region", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey as rid, p_name as name, cast(p_size as varchar) as size, p_retailprice is not null as priced from part")
def typed_as_text(spark, sf_dir):
    df = as_text(table(spark, sf_dir, "part"), ["p_name", "p_size", "p_retailprice"], "p_partkey")
    return df.select(F.col(RID).alias("rid"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_retailprice") != "").alias("priced"))


@query("select count(*) as n, count(*) as keys, cast(0 as bigint) as least, count(*) - 1 as most from lineitem")
def row_keys(spark, sf_dir):
    keyed = with_row_key(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return keyed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(RID).alias("keys"), F.min(RID).alias("least"), F.max(RID).alias("most"))


@query("select * from (values ('nation', true), ('region', true), ('segment', false), ('index', false)) v(col_name, target)")
def target_columns(spark, sf_dir):
    df = customers(spark, sf_dir).select(RID, F.col("nation_id").alias("index"), "nation", "region", "segment")
    pair, some = make_pair(df, df, "customers"), make_pair(df, df, "customers", ["nation", "region"])
    return spark.createDataFrame([(c, c in some.targets and c in pair.targets) for c in pair.columns], "col_name string, target boolean")


# Plans and their failures


@query(f"with {APPLIED_SQL} select rid, x_nation as nation, x_region as region from applied")
def plan_round_trip(spark, sf_dir):
    """The plan as it comes back from its JSON."""
    plan = CleanerPlan.from_json(CUSTOMER_PLAN.to_json())
    return cleaner.corrected(cleaner.apply_plan(customers(spark, sf_dir), plan), ["nation", "region"], [RID, "nation", "region"]).withColumnRenamed(RID, "rid")


@query(f"with {PART_SQL} select rid, false as size_marked, brand = 'Brand#13' as brand_marked, true as told from part_d")
def rejected_rule(spark, sf_dir):
    """A rule outside the language leaves its column unmarked, is told, and does nothing to others."""
    log: list[str] = []
    df = detection.intra_masks(parts(spark, sf_dir), {"size": rule("eval('col')").code, "brand": rule("col.eq('Brand#13')").code}, log)
    return df.select(F.col(RID).alias("rid"), F.col("m__size").alias("size_marked"), F.col("m__brand").alias("brand_marked"), F.lit(len(log) == 1).alias("told"))


@query(f"with {PART_SQL} select rid, size like '%oz' as marked, case when size like '%oz' then replace(size, ' oz', '') else size end as value from part_d")
def odd_names(spark, sf_dir):
    """Columns whose names hold dots, dashes and quotes."""
    odd = "PM2.5 `x`-y"
    df = parts(spark, sf_dir).select(RID, F.col("size").alias(odd))
    plan = CleanerPlan((odd,), {odd: rule("col.str.endswith('oz', na=False)")}, {odd: CorrectionRule("regex_sub", " oz$", "")})
    return cleaner.apply_plan(df, plan).select(F.col(RID).alias("rid"), col(mask(odd)).alias("marked"), col(fixed(odd)).alias("value"))


@query(f"with {PART_SQL} select rid, length(size) > 3 or size = '7' as marked from part_d")
def python_detector(spark, sf_dir):
    """A rule outside the compiled language, run as batched Python where that is asked for."""
    code = "def detectar(col):\n    if len(col) == 0:\n        return col.isna()\n    return (col.str.len() > 3) | col.isin(['7'])"
    out = cleaner.masked(parts(spark, sf_dir), CleanerPlan(("size",), {"size": DetectorRule(code)}), python=True)
    return out.select(F.col(RID).alias("rid"), F.col("m__size").alias("marked"))


@query(f"with {PART_SQL} select rid, case when size like '% %' then split_part(size, ' ', 1) else size end as value from part_d")
def python_corrector(spark, sf_dir):
    fix = CorrectionRule("code", code="def corrigir(valor):\n    return re.sub(' .*', '', valor)")
    out = cleaner.apply_plan(parts(spark, sf_dir), CleanerPlan(("size",), {"size": rule("col.str.contains(' ', regex=False, na=False)")}, {"size": fix}), python=True)
    return out.select(F.col(RID).alias("rid"), F.col("x__size").alias("value"))


# Refinement, over all distinct values: the oracle labels every one


def oz_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = parts(spark, sf_dir)
    oracle = profile.oracle_labels(df, df.select(RID, F.col("clean_size").alias("size")), "size")
    return sampling.embedded(df.select(F.col("size").alias("value")).distinct()), oracle


VALUES_SQL = f"{PART_SQL}, v as (select size as value, bool_or(size <> clean_size) as is_error from part_d group by size)"


@query(f"with {VALUES_SQL} select value, value like '%oz' as marked from v")
def rule_classes(spark, sf_dir):
    vectors, _ = oz_values(spark, sf_dir)
    found = refinement.classify(vectors, rule("col.str.endswith('oz', na=False)").code, [r["value"] for r in vectors.select("value").collect()])  # a dictionary of sizes
    return spark.createDataFrame(sorted(found.items()), "value string, marked boolean")


@query(
    f"""with {VALUES_SQL} select case when is_error and not value like '%oz' then 'MISSED ''' || value || ''': it is an error and was not marked'
      when value like '%oz' and not is_error then 'FALSE ALARM ''' || value || ''': it is correct and was marked'
      else 'OK ''' || value || ''': ' || case when value like '%oz' then 'an error, marked' else 'correct, left alone' end end as line from v"""
)
def oracle_feedback(spark, sf_dir):
    vectors, oracle = oz_values(spark, sf_dir)
    known = {r["value"]: r["is_error"] for r in oracle.collect()}
    marked = refinement.classify(vectors, rule("col.str.endswith('oz', na=False)").code, list(known))
    lines = refinement.feedback_text([OracleLabel(v, e, marked[v]) for v, e in known.items()]).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


class Reviser(StaticAgent):
    """Answers every question for a revision with the rule that it was given."""

    def __init__(self, expression: str):
        super().__init__()
        self.expression = expression

    def revise_detector(self, column, rule_now, labels, feedback):
        return rule(self.expression)


def refined(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    vectors, oracle = oz_values(spark, sf_dir)
    out = refinement.refine("size", rule("col.str.endswith('oz', na=False)"), vectors, oracle, {}, Reviser(expression), iterations=2, per_iteration=100_000)
    return spark.createDataFrame([(h["iteration"], h["status"], h["changed"], out.oracle_labels) for h in out.history], "iteration int, status string, changed boolean, labels long")


REFINED_SQL = """with {values}, p as (select count(*) as n, count(*) filter (where is_error and {test})::double / count(*) filter (where {test}) as precision from v)
    select cast(i as int) as iteration, case when i = 2 then 'no_sample' when precision < 0.8 then 'rejected: precision ' || printf('%.2f', precision) else 'kept' end as status,
      i = 1 and precision >= 0.8 as changed, n as labels from p, (values (1), (2)) t(i)"""


@query(REFINED_SQL.format(values=VALUES_SQL, test="(value like '%o%' or value like '%O%')"))
def refinement_kept(spark, sf_dir):
    return refined(spark, sf_dir, "col.str.contains('(?i)o', na=False)")


@query(REFINED_SQL.format(values=VALUES_SQL, test="not value like '%oz'"))
def refinement_rejected(spark, sf_dir):
    """A revision that is right too rarely leaves the rule as it was."""
    return refined(spark, sf_dir, "~col.str.endswith('oz', na=False)")


@query(
    f"""{MI_SQL}, m as (select *, max(mi) over (partition by c) as most from mi), f as (select c, c2 from m where c <> c2 and mi / most >= cast(0.45 as double)),
    wished(dependent, determinant) as (values ('nation', 'nation_id'), ('region', 'nation'), ('segment', 'nation'))
    select dependent, determinant, c is not null as proposed from wished left join f on c = dependent and c2 = determinant"""
)
def fd_proposal(spark, sf_dir):
    """What an agent proposes counts if it is among the candidates and names columns."""
    wished = {"nation": "nation_id", "region": "nation", "segment": "nation"}
    df, agent = customers(spark, sf_dir), StaticAgent(dependencies=wished)
    candidates: dict[str, list[str]] = {}
    for r in dependency.determinant_candidates(df, MI_COLUMNS).collect():  # pairs of columns
        candidates.setdefault(r["target"], []).append(r["candidate"])
    rows = [(c, d, dependency.valid_names(agent.propose_dependency(c, candidates.get(c, []), {}), MI_COLUMNS)) for c, d in wished.items()]
    return spark.createDataFrame(rows, "dependent string, determinant string, proposed boolean")


# Sampling by vectors


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("value"), F.col("embedding").alias("vector"))


@query()
def kmeans_reps(spark, sf_dir):
    picks = sampling.representatives(embeddings(spark, sf_dir))
    return spark.createDataFrame([(i, v) for i, v in enumerate(picks)], "place int, value string")


@query("select cast(row_number() over (order by value) - 1 as int) as place, value from (select distinct c_mktsegment as value from customer)")
def few_reps(spark, sf_dir):
    """No more values than are asked for: all of them."""
    values = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")).distinct()
    return spark.createDataFrame([(i, v) for i, v in enumerate(sampling.representatives(sampling.embedded(values)))], "place int, value string")


@query("select p_type as value, 256 as width, 1.0::double as norm from part group by p_type")
def embedding_norms(spark, sf_dir):
    vectors = sampling.embedded(table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct())
    squares = F.aggregate("vector", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select("value", F.size("vector").alias("width"), F.round(F.sqrt(squares), 5).alias("norm"))


@query(
    """with e as (select cast(vec_id as varchar) as value, embedding::double[] as v from embeddings),
    u as (select unnest(v) as x, generate_subscripts(v, 1) as i from e), c as (select list(a order by i) as v from (select i, avg(x) as a from u group by i)),
    p1 as (select value, e.v from e, c order by list_distance(e.v, c.v) desc, value limit 1),
    p2 as (select e.value, e.v from e, p1 where e.value <> p1.value order by list_distance(e.v, p1.v) desc, e.value limit 1),
    p3 as (select e.value, e.v from e, p1, p2 where e.value not in (p1.value, p2.value) order by least(list_distance(e.v, p1.v), list_distance(e.v, p2.v)) desc, e.value limit 1),
    p4 as (select e.value, e.v from e, p1, p2, p3 where e.value not in (p1.value, p2.value, p3.value)
      order by least(list_distance(e.v, p1.v), list_distance(e.v, p2.v), list_distance(e.v, p3.v)) desc, e.value limit 1)
    select 0 as place, value from p1 union all select 1, value from p2 union all select 2, value from p3 union all select 3, value from p4"""
)
def farthest_point(spark, sf_dir):
    return spark.createDataFrame([(i, v) for i, v in enumerate(sampling.diverse(embeddings(spark, sf_dir), [], 4))], "place int, value string")


@query()
def suspicious_values(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    vectors = sampling.embedded(df.select(F.col("p_type").alias("value")).distinct())
    counted = {r["char"]: r["df"] for r in profile.character_frequency(df, "p_type").collect()}  # characters
    return spark.createDataFrame([(i, v) for i, v in enumerate(sampling.suspicious(vectors, [], 4, counted))], "place int, value string")


@query("select distinct p_type as value, true as once from part where p_type <> 'PROMO'")
def oracle_sampling(spark, sf_dir):
    """More than there are: every value not used before, each once."""
    vectors = sampling.embedded(table(spark, sf_dir, "part").select(F.col("p_type").alias("value")).distinct())
    picked = sampling.oracle_sample(vectors, F.col("value").startswith("E"), ["PROMO"], 1_000, {})
    return spark.createDataFrame([(v, picked.count(v) == 1) for v in picked], "value string, once boolean")
