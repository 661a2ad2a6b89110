"""The expected result of every registered query, in SQL for DuckDB.

``PARTS`` are common table expressions that build on each other; ``_select`` puts the ones a query needs before it.
Amounts are summed as decimals and become doubles only in the last step, like in the Spark queries; dates become text.
"""

from __future__ import annotations

import re


# The words, categories, labels and statuses below are the fixed values that the library states in ``functions`` and
# ``operators``, written out again so that the two can disagree.


def _category(col: str) -> str:
    return (
        f"case when contains({col}, 'Service') then 'Services' when contains({col}, 'Support') then 'Support' "
        f"when contains({col}, 'Product') then 'Products' else 'Need Mapping' end"
    )


def _measure(kind: str) -> str:
    return f"case when Revenue_Type = '{kind}' then Revenue else 0 end"


def _months_left(col: str, last: int) -> str:
    return f"cast({last} - (month(strptime({col}, '%B, %Y')) + 5) % 12 as integer)"


def _extrap(left: str) -> str:
    return (
        f"case when Opportunity_Usage < 0 then 0 else "
        f"cast({left} as decimal(2,0)) * cast(Opportunity_Usage as decimal(28,6)) end"
    )


def _range(col: str) -> str:
    return (
        f"case when {col} < 0 then 'Below < $0' when {col} <= 10000 then '$0 to $10,000' "
        f"when {col} <= 50000 then '$10,000 to $50,000' when {col} <= 100000 then '$50,000 to $100,000' "
        f"when {col} <= 200000 then '$100,000 to $200,000' else '200,000 +' end"
    )


def _merge(a: str, b: str, of_a: str, of_b: str) -> str:
    keys = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in ("Account_No", "Fiscal_Month", "Product_Category"))
    measures = ", ".join(
        f"coalesce({side}.{m}, 0) as {m}" for side, names in (("a", of_a), ("b", of_b)) for m in names.split()
    )
    return (
        f"select {keys}, {measures} from {a} a full join {b} b on a.Account_No = b.Account_No "
        "and a.Fiscal_Month = b.Fiscal_Month and a.Product_Category = b.Product_Category"
    )


_REV = "Revenue Partner_Fee Registration_Fee"
_OPP = "Opportunity_Usage Opportunity_Extrap"
_ALL = f"{_REV} {_OPP} Baseline Target Opportunity_Into_RR"
_SUM_REV = "sum(Revenue) as Revenue, sum(Partner_Fee) as Partner_Fee, sum(Registration_Fee) as Registration_Fee"
_ATTRIBUTES = (
    "m.Fiscal_Quarter, m.Fiscal_Year, m.Month_ID, s.Store as Account_Name, s.Industry, s.Vertical, s.Segment, "
    "s.Store_Manager_Alias, s.Potential_Account, s.Vertical_Manager_Alias, "
    "e.General_Seller, e.Services_Seller, e.Product_Seller"
)


def _lookups(facts: str) -> str:
    return (
        f"select f.*, {_ATTRIBUTES} from {facts} f left join months m on f.Fiscal_Month = m.Fiscal_Month "
        "left join fx_stores s on f.Account_No = s.AccountNo left join fx_sellers e on f.Account_No = e.Store_ID"
    )


def _opps(source: str) -> str:
    return f"""
    select Store_No as Account_No, Opportunity_Est_Date, Product, {_category('Product')} as Product_Category,
           Opportunity_ID, Opportunity_Name, Project_Status, Opportunity_Status, Opportunity_Stage, Opportunity_Usage
    from {source} where Product is not null and Product <> 'Null'"""


def _usage(text: str) -> str:
    return f"try_cast(replace({text}, ',', '') as decimal(28,6))"


PARTS = {
    # The source tables.
    "fx_revenue": """
    select o_custkey as StoreNo,
           case when l_orderkey % 211 = 5 then null when l_orderkey % 223 = 7 then date '1990-01-01'
                else cast(date_trunc('month', l_shipdate) as date) end as Month,
           case l_returnflag when 'A' then 'Actuals' when 'N' then 'Partner Fee' else 'Registration Fee' end
             as Revenue_Type,
           case l_linestatus when 'F' then 'Renewal' else 'New' end as Revenue_Motion,
           case p_type when 'ECONOMY' then 'Service Basic' when 'LARGE' then 'Service Support Plus'
                       when 'MEDIUM' then 'Support Desk' when 'PROMO' then 'Product Promo'
                       when 'SMALL' then 'Product Support' else 'Standard' end as Product_Category,
           o_orderstatus as Motion,
           case when l_shipdate >= date '1999-02-01' then cast(0 as decimal(28,6))
                else cast(l_extendedprice as decimal(28,6)) end as Revenue
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "fx_opps_all": """
    select o_custkey as Store_No,
           case when o_orderkey % 97 = 0 then date '1990-01-01' else cast(o_orderdate as date) end
             as Opportunity_Est_Date,
           case when o_orderpriority = '1-URGENT' then 'Service Plan'
                when o_orderpriority = '2-HIGH' and o_orderkey % 10 = 0 then 'Consulting'
                when o_orderpriority = '2-HIGH' then 'Support Desk'
                when o_orderpriority = '3-MEDIUM' then 'Product Bundle'
                when o_orderpriority = '4-NOT SPECIFIED' then 'Null' end as Product,
           o_orderkey as Opportunity_ID, concat('Opp ', cast(o_orderkey as varchar)) as Opportunity_Name,
           case when o_orderstatus = 'F' then 'Inactive' when o_orderstatus = 'O' then 'Active'
                when o_orderkey % 50 = 0 then null else 'Pending' end as Project_Status,
           o_orderstatus as Opportunity_Status,
           concat('Stage ', cast(o_orderkey % 4 as varchar)) as Opportunity_Stage,
           case when o_orderkey % 41 = 0 then '0' when o_orderkey % 43 = 2 then '0.004' when o_orderkey % 89 = 3 then 'n/a'
                else format('{:,.2f}', cast(o_totalprice - 50000 as decimal(18,2))) end as Opportunity_Usage
    from orders""",
    "fx_opps": "select * from fx_opps_all where Opportunity_Usage <> 'n/a'",
    "fx_targets": """
    select o_custkey as Store_Number,
           case o_orderkey % 3 when 0 then 'Services' when 1 then 'Support' else 'Products' end as Service_Comp_Group,
           case when o_orderkey % 227 = 3 then null when o_orderkey % 229 = 4 then date '1990-01-01'
                else cast(date_trunc('month', o_orderdate) as date) end as Fiscal_Month,
           sum(cast(o_totalprice as decimal(28,6))) as Target
    from orders group by 1, 2, 3""",
    "fx_stores": """
    select c_custkey as AccountNo, c_name as Store, c_mktsegment as Industry, n_name as Vertical,
           case when c_acctbal < 0 then 'SMB' when c_acctbal < 5000 then 'Corporate' else 'Enterprise' end as Segment,
           concat('mgr', cast(c_custkey % 17 as varchar)) as Store_Manager_Alias,
           case when c_custkey % 4 = 0 then 'Yes' else 'No' end as Potential_Account,
           r_name as Vertical_Manager_Alias
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where c_custkey % 53 <> 0""",
    "fx_sellers": """
    select c_custkey as Store_ID, concat('seller', cast(c_custkey % 10 as varchar)) as General_Seller,
           concat('seller', cast(c_custkey % 7 as varchar)) as Services_Seller,
           concat('seller', cast(c_custkey % 5 as varchar)) as Product_Seller
    from customer where c_custkey % 59 <> 0""",
    "fx_calendar": """
    select cast(d as date) as Date_Value, strftime(d, '%B, %Y') as Fiscal_Month,
           concat('Q', cast(((month(d) + 5) % 12) // 3 + 1 as varchar)) as Fiscal_Quarter,
           cast(year(d) + case when month(d) >= 7 then 1 else 0 end as integer) as Fiscal_Year,
           cast(year(d) * 12 + month(d) as integer) as Month_ID
    from range(date '1995-01-01', date '2002-07-01', interval 1 day) t(d)""",
    "days": "select distinct Date_Value, Fiscal_Month, Fiscal_Year, Month_ID from fx_calendar",
    "months": "select distinct Fiscal_Month, Fiscal_Quarter, Fiscal_Year, Month_ID from fx_calendar",
    # Revenue.
    "renamed": """
    select StoreNo as Account_No, Month as Fiscal_Month, Revenue_Type, Revenue_Motion, Product_Category,
           Motion as Account_Motion, Revenue from fx_revenue""",
    "split": f"""
    select * exclude (Revenue), {_measure('Actuals')} as Revenue, {_measure('Partner Fee')} as Partner_Fee,
           {_measure('Registration Fee')} as Registration_Fee from renamed""",
    "categorized": f"select *, {_category('Product_Category')} as Product_Category_2 from split",
    "rev_monthly": f"""
    select Account_No, Fiscal_Month, Product_Category_2 as Product_Category, {_SUM_REV}
    from categorized group by all""",
    "rev": f"""
    select Account_No, d.Fiscal_Month, Product_Category, {_SUM_REV}
    from rev_monthly r left join days d on r.Fiscal_Month = d.Date_Value group by all""",
    "rev_aw": f"""
    select Account_No, d.Fiscal_Month, Product_Category, Revenue, Partner_Fee, Registration_Fee
    from rev_monthly r left join days d on r.Fiscal_Month = cast(strptime(d.Fiscal_Month, '%B, %Y') as date)""",
    # Opportunities.
    "opps_clean_all": _opps("fx_opps_all"),
    "opps_clean": _opps("fx_opps"),
    "opps_live": f"""
    select * replace ({_usage('Opportunity_Usage')} as Opportunity_Usage)
    from opps_clean where {_usage('Opportunity_Usage')} <> 0""",
    "opps_active": "select * from opps_live where Project_Status <> 'Inactive'",
    "opp_monthly": """
    select Account_No, Product_Category, d.Fiscal_Month, sum(Opportunity_Usage) as Opportunity_Usage
    from opps_active o left join days d on o.Opportunity_Est_Date = d.Date_Value group by all""",
    "opp_extrap": f"""
    select *, {_months_left('Fiscal_Month', 11)} as Extrap_Months_Left_For_FY,
           {_extrap(_months_left('Fiscal_Month', 11))} as Opportunity_Extrap from opp_monthly""",
    "detail": f"""
    select *, {_months_left('Fiscal_Month', 12)} as Extrap_Months_Left_For_FY,
           {_extrap(_months_left('Fiscal_Month', 12))} as Opportunity_Extrap
    from (select Account_No, Product_Category, d.Fiscal_Month, Product, Opportunity_Status, Opportunity_Stage,
                 sum(Opportunity_Usage) as Opportunity_Usage
          from opps_live o left join days d on o.Opportunity_Est_Date = d.Date_Value group by all)""",
    # Targets.
    "tgt_rows": """
    select Store_Number as Account_No, Service_Comp_Group as Product_Category, d.Fiscal_Month, Target
    from fx_targets t left join days d on t.Fiscal_Month = d.Date_Value""",
    "tgt": """
    select Account_No, Product_Category, Fiscal_Month, sum(Target) as Target from tgt_rows group by all""",
    # The anchor and what follows it.
    "anchor": """
    select Date_Value as Anchor_Date, Fiscal_Month, Month_ID, Fiscal_Year
    from days where Date_Value = (select max(Month) from fx_revenue where Revenue <> 0)""",
    "future": """
    select distinct d.Fiscal_Month, d.Month_ID from days d, anchor x
    where d.Date_Value > x.Anchor_Date and d.Fiscal_Year = x.Fiscal_Year and d.Fiscal_Month <> x.Fiscal_Month""",
    "base": """
    select Account_No, f.Fiscal_Month, Product_Category, Partner_Fee + Revenue as Baseline
    from rev, future f where rev.Fiscal_Month = (select Fiscal_Month from anchor)""",
    "base_aw": """
    select Account_No, f.Fiscal_Month, Product_Category, Partner_Fee + Revenue as Baseline
    from rev_aw, future f where rev_aw.Fiscal_Month = (select Fiscal_Month from anchor)""",
    "opp_future": """
    select Account_No, Product_Category, d.Fiscal_Month, d.Month_ID, sum(Opportunity_Usage) as Opportunity_Usage
    from opps_active o join days d on o.Opportunity_Est_Date = d.Date_Value, anchor x
    where o.Opportunity_Est_Date > x.Anchor_Date and d.Fiscal_Year = x.Fiscal_Year group by all""",
    "rr_aw": """
    select Account_No, Product_Category, f.Fiscal_Month,
           case when Opportunity_Usage < 0 then 0 else Opportunity_Usage end as Opportunity_Into_RR
    from opp_future o join future f on o.Month_ID <= f.Month_ID""",
    "rr": """
    select Account_No, Product_Category, Fiscal_Month, sum(Opportunity_Into_RR) as Opportunity_Into_RR
    from rr_aw group by all""",
    # Merged.
    "rev_opp": _merge("rev", "opp_extrap", _REV, _OPP),
    "rev_opp_aw": _merge("rev_aw", "opp_extrap", _REV, _OPP),
    "base_tgt": _merge("base", "tgt", "Baseline", "Target"),
    "base_tgt_aw": _merge("base_aw", "tgt_rows", "Baseline", "Target"),
    "expected": _merge("base_tgt", "rr", "Baseline Target", "Opportunity_Into_RR"),
    "expected_aw": _merge("base_tgt_aw", "rr_aw", "Baseline Target", "Opportunity_Into_RR"),
    "facts": _merge("rev_opp", "expected", f"{_REV} {_OPP}", "Baseline Target Opportunity_Into_RR"),
    "facts_aw": _merge("rev_opp_aw", "expected_aw", f"{_REV} {_OPP}", "Baseline Target Opportunity_Into_RR"),
    "rev_summary": _lookups("facts"),
    "rev_summary_aw": _lookups("facts_aw"),
    "ranged": f"""
    select *, {_range('Opportunity_Usage')} as Opportunity_Usage_Range,
           {_range('Opportunity_Extrap')} as Opportunity_Extrap_Range from detail""",
    "opp_summary": _lookups("ranged"),
    # Objectives.
    "dated": """
    select c.Account_No, d.Fiscal_Month, d.Fiscal_Year, d.Month_ID, c.Product_Category_2 as Product_Category,
           c.Revenue, c.Partner_Fee, c.Registration_Fee
    from categorized c left join days d on c.Fiscal_Month = d.Date_Value""",
    "month_totals": """
    select m.Fiscal_Month, m.Fiscal_Year, m.Month_ID, sum(Revenue + Partner_Fee) as Sold,
           sum(Baseline + Opportunity_Into_RR) as Expected
    from facts f left join months m on f.Fiscal_Month = m.Fiscal_Month group by all""",
    "outlook": """
    select t.Fiscal_Month, t.Fiscal_Year, t.Month_ID,
           case when t.Month_ID > x.Month_ID then 'Forecast' else 'Actual' end as Kind,
           case when t.Month_ID > x.Month_ID then Expected else Sold end as Amount
    from month_totals t, anchor x where t.Month_ID is not null or Sold <> 0""",
    # The opportunities of the week before, and both weeks side by side.
    "fx_opps_before": f"""
    select * replace (
        case when Opportunity_ID % 5 = 0
             then 'Stage ' || cast((cast(right(Opportunity_Stage, 1) as integer) + 1) % 4 as varchar)
             else Opportunity_Stage end as Opportunity_Stage,
        case when Opportunity_ID % 3 = 0
             then format('{{:,.2f}}',
                         cast({_usage('Opportunity_Usage')} * cast(0.9 as decimal(2,1)) as decimal(18,2)))
             else Opportunity_Usage end as Opportunity_Usage)
    from fx_opps where Opportunity_ID % 7 <> 0
    union all
    select * replace (-Opportunity_ID as Opportunity_ID) from fx_opps where Opportunity_ID % 11 = 0""",
    "week_now": f"{_opps('fx_opps')}",
    "week_before": f"{_opps('fx_opps_before')}",
    "wow": f"""
    select coalesce(n.Opportunity_ID, b.Opportunity_ID) as Opportunity_ID, cast(25 as integer) as Snapshot_Week,
           coalesce(n.Account_No, b.Account_No) as Account_No,
           coalesce(n.Product_Category, b.Product_Category) as Product_Category,
           n.Opportunity_Status, b.Opportunity_Status as Previous_Opportunity_Status,
           n.Opportunity_Stage, b.Opportunity_Stage as Previous_Opportunity_Stage,
           {_usage('n.Opportunity_Usage')} as Opportunity_Usage,
           {_usage('b.Opportunity_Usage')} as Previous_Opportunity_Usage,
           case when b.Opportunity_ID is null then 'New' when n.Opportunity_ID is null then 'Closed'
                when (n.Opportunity_Stage, n.Opportunity_Status) is distinct from (b.Opportunity_Stage, b.Opportunity_Status)
                     and {_usage('n.Opportunity_Usage')} is distinct from {_usage('b.Opportunity_Usage')}
                     then 'Stage and value changed'
                when (n.Opportunity_Stage, n.Opportunity_Status) is distinct from (b.Opportunity_Stage, b.Opportunity_Status) then 'Stage changed'
                when {_usage('n.Opportunity_Usage')} is distinct from {_usage('b.Opportunity_Usage')} then 'Value changed'
                else 'Same' end as Change_Type
    from week_now n full join week_before b on n.Opportunity_ID = b.Opportunity_ID""",
    "wow_change": """
    select *, coalesce(Opportunity_Usage, 0) - coalesce(Previous_Opportunity_Usage, 0) as Usage_Change from wow""",
}

# A word in a query that names a part stands for it.
_WORDS = re.compile(r"\w+")


def _needed(sql: str, found: set[str]) -> set[str]:
    for name in PARTS.keys() & set(_WORDS.findall(sql)) - found:
        found.add(name)
        _needed(PARTS[name], found)
    return found


def _select(final: str) -> str:
    needed = _needed(final, set())
    ctes = ",\n".join(f"{name} as ({sql.strip()})" for name, sql in PARTS.items() if name in needed)
    return f"with {ctes}\n{final}"


def _all(part: str, doubles: str = "", dates: str = "") -> str:
    """Every column of a part, amounts as doubles and dates as text."""
    casts = [f"cast({c} as double) as {c}" for c in doubles.split()]
    casts += [f"cast({c} as varchar) as {c}" for c in dates.split()]
    return _select(f"select * {'replace (' + ', '.join(casts) + ')' if casts else ''} from {part}")


def _folded(part: str, doubles: str) -> str:
    """Every distinct row of a part with the number of times it is there."""
    casts = ", ".join(f"cast({c} as double) as {c}" for c in doubles.split())
    return _select(f"select * replace ({casts}), count(*) as Copies from {part} group by all")


def _average_baseline(months: int) -> str:
    return _select(f"""
    select a.Account_No, f.Fiscal_Month, a.Product_Category, cast(a.Total as double) / {months} as Baseline
    from (select Account_No, Product_Category, sum(Partner_Fee + Revenue) as Total from dated, anchor x
          where dated.Month_ID <= x.Month_ID and dated.Month_ID > x.Month_ID - {months} group by all) a, future f""")


def _by_month(measures: str) -> str:
    sums = ", ".join(f"cast(sum({m}) as double) as {m}" for m in measures.split())
    return _select(f"select Fiscal_Month, Fiscal_Year, Month_ID, {sums} from dated group by all")


def oracle_sql() -> dict[str, str]:
    by = "Segment, Vertical, General_Seller, Product_Category"
    sliced = "Revenue Partner_Fee Registration_Fee Target Baseline Opportunity_Into_RR"
    return {
        "scan_revenue": _all("fx_revenue", "Revenue", "Month"),
        "peek": "select cast(least(10, count(*)) as bigint) as Rows_Found from customer where c_custkey % 53 <> 0",
        "peek_sample": _select(
            "select * from fx_stores order by md5(concat(" + ", ".join(
                f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in
                "AccountNo Store Industry Vertical Segment Store_Manager_Alias Potential_Account Vertical_Manager_Alias".split())
            + ")) limit 10"),
        "profile_tables": _select(" union all ".join(
            f"select '{table}' as \"Table\", '{c}' as \"Column\", count(*) as \"Rows\", count(*) - count({c}) as Nulls from {part}"
            for table, part, columns in (
                ("opportunities", "fx_opps_all", "Store_No Opportunity_Est_Date Product Opportunity_ID Opportunity_Name "
                 "Project_Status Opportunity_Status Opportunity_Stage Opportunity_Usage"),
                ("stores", "fx_stores", "AccountNo Store Industry Vertical Segment Store_Manager_Alias Potential_Account "
                 "Vertical_Manager_Alias"),
                ("sellers", "fx_sellers", "Store_ID General_Seller Services_Seller Product_Seller"))
            for c in columns.split())),
        "data_quality": _select(" union all ".join(
            f"select '{table}' as \"Table\", '{check}' as \"Check\", count(*) as \"Rows\" from {part} where {failed}"
            for table, part, checks in (
                ("revenue", "fx_revenue", {"Rows": "true", "Undated": "Month is null",
                 "Outside_Calendar": "Month < date '1995-01-01' or Month > date '2002-06-30'",
                 "Unknown_Type": "Revenue_Type is null or Revenue_Type not in ('Actuals', 'Partner Fee', 'Registration Fee')"}),
                ("opportunities", "fx_opps_all", {"Rows": "true", "Undated": "Opportunity_Est_Date is null",
                 "Outside_Calendar": "Opportunity_Est_Date < date '1995-01-01' or Opportunity_Est_Date > date '2002-06-30'",
                 "No_Product": "Product is null or Product = 'Null'",
                 "Unreadable_Usage": f"Opportunity_Usage is not null and {_usage('Opportunity_Usage')} is null"}),
                ("targets", "fx_targets", {"Rows": "true", "Undated": "Fiscal_Month is null",
                 "Outside_Calendar": "Fiscal_Month < date '1995-01-01' or Fiscal_Month > date '2002-06-30'"}),
                ("stores", "fx_stores", {"Rows": "true", "No_Account": "AccountNo is null"}),
                ("sellers", "fx_sellers", {"Rows": "true", "No_Account": "Store_ID is null"}))
            for check, failed in checks.items())),
        "scan_weeks": _select(
            "select * replace (cast(Opportunity_Est_Date as varchar) as Opportunity_Est_Date), cast(24 as integer) as Snapshot_Week "
            "from fx_opps_before union all "
            "select * replace (cast(Opportunity_Est_Date as varchar) as Opportunity_Est_Date), cast(25 as integer) from fx_opps"),
        "rejected_amounts": _select(
            "select * replace (cast(Opportunity_Est_Date as varchar) as Opportunity_Est_Date) from fx_opps_all "
            "where Opportunity_Usage = 'n/a'"),
        "scan_opportunities": _all("fx_opps_all", dates="Opportunity_Est_Date"),
        "scan_targets": _all("fx_targets", "Target", "Fiscal_Month"),
        "scan_stores": _all("fx_stores"),
        "scan_sellers": _all("fx_sellers"),
        "profile_distinct": _select("select distinct Product_Category from fx_revenue"),
        "profile_distinct_targets": _select("select distinct Service_Comp_Group from fx_targets"),
        "revenue_renamed": _all("renamed", "Revenue", "Fiscal_Month"),
        "revenue_measures": _all("split", _REV, "Fiscal_Month"),
        "revenue_categorized": _all("categorized", _REV, "Fiscal_Month"),
        "revenue_categorized_by_rules": _all("categorized", _REV, "Fiscal_Month"),
        "revenue_monthly": _all("rev_monthly", _REV, "Fiscal_Month"),
        "opportunities_clean": _all("opps_clean_all", dates="Opportunity_Est_Date"),
        "opportunity_monthly": _all("opp_monthly", "Opportunity_Usage"),
        "opportunity_extrap": _all("opp_extrap", _OPP),
        "revenue_calendar": _all("rev", _REV),
        "revenue_calendar_as_written": _folded("rev_aw", _REV),
        "revenue_opportunity": _all("rev_opp", f"{_REV} {_OPP}"),
        "revenue_opportunity_as_written": _folded("rev_opp_aw", f"{_REV} {_OPP}"),
        "anchor": _all("anchor", dates="Anchor_Date"),
        "future_months": _all("future"),
        "baseline": _all("base", "Baseline"),
        "baseline_as_written": _folded("base_aw", "Baseline"),
        "targets": _all("tgt_rows", "Target"),
        "baseline_targets": _all("base_tgt", "Baseline Target"),
        "baseline_targets_as_written": _folded("base_tgt_aw", "Baseline Target"),
        "future_opportunities": _all("opp_future", "Opportunity_Usage"),
        "runrate": _all("rr", "Opportunity_Into_RR"),
        "runrate_as_written": _all("rr_aw", "Opportunity_Into_RR"),
        "baseline_targets_runrate": _all("expected", "Baseline Target Opportunity_Into_RR"),
        "baseline_targets_runrate_as_written": _folded("expected_aw", "Baseline Target Opportunity_Into_RR"),
        "all_facts": _all("facts", _ALL),
        "all_facts_joined": _all("facts", _ALL),
        "all_facts_as_written": _folded("facts_aw", _ALL),
        "with_lookups": _all("rev_summary", _ALL),
        "revenue_summary": _all("rev_summary", _ALL),
        "revenue_summary_as_written": _folded("rev_summary_aw", _ALL),
        "opportunity_detail": _all("detail", _OPP),
        "value_range": _all("ranged", _OPP),
        "opportunity_summary": _all("opp_summary", _OPP),
        "view_revenue_summary": _all("rev_summary", _ALL),
        "view_opportunity_summary": _all("opp_summary", _OPP),
        "obj_revenue_by_month": _by_month("Revenue"),
        "obj_fees_by_month": _by_month("Partner_Fee Registration_Fee"),
        "obj_revenue_vs_target": _select("""
            select Fiscal_Month, Month_ID, Product_Category, cast(Revenue as double) as Revenue,
                   cast(Target as double) as Target, cast(Revenue - Target as double) as Variance,
                   cast(Revenue as double) / nullif(cast(Target as double), 0) as Attainment
            from (select m.Fiscal_Month, m.Month_ID, f.Product_Category, sum(f.Revenue) as Revenue,
                         sum(f.Target) as Target
                  from (select Fiscal_Month, Product_Category, Revenue, 0 as Target from rev
                        union all select Fiscal_Month, Product_Category, 0, Target from tgt) f
                  left join months m on f.Fiscal_Month = m.Fiscal_Month group by all)"""),
        "obj_forecast": _select("""
            select Fiscal_Month, Fiscal_Year, Month_ID, Kind, cast(Amount as double) as Amount,
                   cast(sum(Amount) over (partition by Fiscal_Year order by Month_ID) as double) as Year_To_Date
            from outlook"""),
        "obj_slice": _select(
            f"select {by}, grouping({by}) as Grouping_ID, "
            + ", ".join(f"cast(sum({m}) as double) as {m}" for m in sliced.split())
            + f" from rev_summary group by cube ({by})"
        ),
        "obj_baseline_avg_3": _average_baseline(3),
        "obj_baseline_avg_6": _average_baseline(6),
        "obj_wow_changes": _all("wow", "Opportunity_Usage Previous_Opportunity_Usage"),
        "obj_wow_measures": _select("""
            select Opportunity_ID, Snapshot_Week, Change_Type, cast(Opportunity_Usage as double) as Opportunity_Usage,
                   cast(Previous_Opportunity_Usage as double) as Previous_Opportunity_Usage,
                   cast(Usage_Change as double) as Usage_Change,
                   cast(Usage_Change as double) / nullif(cast(Previous_Opportunity_Usage as double), 0)
                     as Usage_Change_Share
            from wow_change"""),
        "obj_wow_totals": _select("""
            select Snapshot_Week, Product_Category, Change_Type, count(*) as Opportunities,
                   cast(sum(Usage_Change) as double) as Usage_Change from wow_change group by all"""),
    }
