"""Domain views over plain tables, in SQL that Spark and other engines read alike.

Building elements come from `part`, relations from `lineitem`, files and runs from `orders`, state changes from `events`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_elements": """select p_partkey as ord, 'E' || cast(p_partkey as string) as global_id,
        case p_partkey % 10 when 0 then 'IfcWall' when 1 then 'IfcDoor' when 2 then 'IfcWindow' when 3 then 'IfcSlab' when 4 then 'IfcBeam'
          when 5 then 'IfcColumn' when 6 then 'IfcSpace' when 7 then 'IfcRoof' when 8 then 'IfcStair' else 'IfcCovering' end as ifc_class,
        p_name as name, case when p_partkey % 17 = 0 then null else 'S' || cast(p_partkey % 40 as string) end as container,
        case when p_partkey % 3 = 0 then null else p_type end as material,
        cast(p_partkey % 97 as double) as x, cast(p_partkey % 89 as double) as y, cast(p_partkey % 3 as double) as z from part""",
    "v_properties": """select global_id, ifc_class, 'Pset_' || substr(ifc_class, 4) || 'Common' as pset, prop, value, ord from (
        select 'E' || cast(p_partkey as string) as global_id,
          case p_partkey % 10 when 0 then 'IfcWall' when 1 then 'IfcDoor' when 2 then 'IfcWindow' when 3 then 'IfcSlab' when 4 then 'IfcBeam'
            when 5 then 'IfcColumn' when 6 then 'IfcSpace' when 7 then 'IfcRoof' when 8 then 'IfcStair' else 'IfcCovering' end as ifc_class, prop, value, p_partkey * 4 + k as ord
        from (
          select p_partkey, 0 as k, case p_partkey % 4 when 0 then 'FireRating' when 1 then 'Fire Rating' when 2 then 'fire_rating' else 'Unknown Prop' end as prop,
            case p_size % 5 when 0 then '2HR' when 1 then '90 min' when 2 then 'REI60' when 3 then '45' else null end as value from part
          union all select p_partkey, 1 as k, 'IsExternal' as prop, case when p_partkey % 2 = 0 then 'true' else 'no' end as value from part
          union all select p_partkey, 2 as k, 'LoadBearing' as prop, case when p_size % 2 = 0 then 'yes' else 'maybe' end as value from part where p_partkey % 3 <> 1
          union all select p_partkey, 3 as k, 'Thermal-Transmittance' as prop, cast(p_size as string) || case p_partkey % 3 when 0 then ' cm' when 1 then '' else ' m' end as value from part where p_partkey % 5 <> 2
        ) t) u""",
    "v_relationships": """select l_orderkey * 8 + l_linenumber as ord, case l_returnflag when 'A' then 'contained_in' when 'R' then 'aggregated_by' else 'connected_to' end as type,
        'E' || cast(l_partkey as string) as source, case when l_returnflag = 'N' then 'E' || cast(l_suppkey as string) else 'S' || cast(l_orderkey % 40 as string) end as target,
        case when l_returnflag = 'N' then 'IfcElement' else 'IfcBuildingStorey' end as target_class from lineitem""",
    "v_spatial": """select 'S' || cast(s_suppkey as string) as storey, s_acctbal as elevation, 'B' || cast(n_nationkey as string) as building, 'T' || cast(r_regionkey as string) as site, r_name as site_name
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "v_files": """select o_orderkey as id, o_custkey as project_id, 'F-' || cast(o_orderkey % 7 as string) || '-' || case o_orderkey % 6 when 0 then 'site_plan' when 1 then 'Inspection check' when 2 then 'bim-model'
          when 3 then 'boq-cost' when 4 then 'PRJ-ORG-V1-L1-DR-A-0001' else 'notes' end || case o_orderkey % 5 when 0 then '.pdf' when 1 then '.ifc' when 2 then '.xlsx' when 3 then '.docx' else '.zzz' end as filename,
        case o_orderkey % 5 when 0 then 'document' when 1 then 'bim_model' when 2 then 'spreadsheet' when 3 then 'document' else null end as category,
        case o_orderkey % 4 when 0 then 'design' when 1 then 'construction' when 2 then 'operation' else null end as phase,
        case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else null end as status, o_totalprice as size_kb, o_orderdate as uploaded_at, o_orderkey % 1000 as checksum from orders""",
    "v_runs": """select o_orderkey as run_id, o_custkey as project_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'queued' end as status,
        case o_orderkey % 5 when 0 then 'parse' when 1 then 'validate' when 2 then 'enrich' when 3 then 'transform' else 'package' end as current_stage, o_orderdate as created_at from orders""",
    "v_transitions": """select event_id, user_id as file_id, ts, case event_type when 'signup' then 'wip' when 'view' then 'wip' when 'click' then 'shared' when 'purchase' then 'published' else 'archived' end as state, value from events""",
    "v_progress": """select event_id, user_id as run_id, ts, case event_id % 5 when 0 then 'parse' when 1 then 'validate' when 2 then 'enrich' when 3 then 'transform' else 'package' end as stage,
        cast(event_id % 5 as int) as idx, cast(event_id % 101 as int) as stage_progress, case when event_type = 'purchase' then 'completed' else 'running' end as stage_status from events""",
    "v_documents": """select doc_id, text, lang, 'doc-' || source || '-' || lang || case doc_id % 4 when 0 then '.pdf' when 1 then '.docx' when 2 then '.xlsx' else '.ifc' end as filename,
        case doc_id % 3 when 0 then 'design' when 1 then 'construction' else 'operation' end as phase, case when doc_id % 11 = 0 then 'failed' else 'completed' end as status from documents""",
}


def needed(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    names = [t for t in TABLES if re.search(rf"\b(from|join) {t}\b", VIEWS[name])]
    sql = re.sub(rf"\b(from|join) ({'|'.join(names)})\b", r"\1 {\2}", VIEWS[name])
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})
