"""Registered queries of the catalogs: XML files made from `part`, 500 records to a file, read back as documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import archives
from ..sources.scratch import scratch_dir, written
from .registry import query
from .tables import table


def _xml(c: str) -> Column:
    out = F.col(c).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _filled(form: str) -> Column:
    """The form with each {column} put in; a part that starts with "column>n: " is left out where the column is not above n."""
    parts = []
    for line in form.strip().splitlines():
        condition, text = line.split(": ", 1) if ": " in line and not line.lstrip().startswith("<") else (None, line)
        pieces = text.replace("{", "\0{").replace("}", "\0").split("\0")
        whole = F.concat(*[_xml(p[1:]) if p.startswith("{") else F.lit(p) for p in pieces if p])
        parts.append(F.when(F.expr(condition.strip()), whole).otherwise("") if condition else whole)
    return F.concat(*parts)


_WEAKNESS = """
<Weakness ID="{p_partkey}" Name="{p_name}" Status="{p_name}" Abstraction="{p_retailprice}"><Description><xhtml:p>{p_type}</xhtml:p><xhtml:p>{p_retailprice} &lt;<xhtml:b>{p_size}</xhtml:b>&gt;</xhtml:p></Description>
p_size > 30: <Extended_Description><xhtml:ul><xhtml:li>{p_brand}</xhtml:li><xhtml:li>{p_name}</xhtml:li></xhtml:ul></Extended_Description>
<Applicable_Platforms><Language Name="{p_brand}" Prevalence="Often"/><Technology Class="{p_type}"/></Applicable_Platforms>
<Modes_Of_Introduction><Introduction><Phase>{p_name}</Phase><Phase>{p_brand}</Phase>
p_size > 20: <Note>{p_type}</Note>
</Introduction></Modes_Of_Introduction>
<Common_Consequences><Consequence><Scope>{p_name}</Scope><Scope>{p_brand}</Scope><Impact>{p_type}</Impact>
p_size > 10: <Note>{p_retailprice}</Note>
</Consequence></Common_Consequences><Detection_Methods><Detection_Method>
p_size > 15: <Method>{p_brand}</Method>
<Description>{p_type}</Description><Effectiveness>{p_name}</Effectiveness></Detection_Method></Detection_Methods>
p_size > 40: <Potential_Mitigations><Mitigation><Phase>{p_retailprice}</Phase><Strategy>{p_brand}</Strategy><Description>{p_name}</Description></Mitigation></Potential_Mitigations>
<Related_Weaknesses><Related_Weakness Nature="{p_retailprice}" CWE_ID="{p_size}" View_ID="1000"/></Related_Weaknesses>
<Taxonomy_Mappings><Taxonomy_Mapping Taxonomy_Name="{p_name}">
p_size > 25: <Entry_ID>{p_brand}</Entry_ID>
<Entry_Name>{p_type}</Entry_Name></Taxonomy_Mapping></Taxonomy_Mappings>
<References><Reference External_Reference_ID="REF-{p_size}" Section="{p_retailprice}"/></References>
<Content_History><Modification><Modification_Date>2024-02-28</Modification_Date></Modification>
p_size > 5: <Modification><Modification_Date>2025-01-31</Modification_Date></Modification>
</Content_History></Weakness>
"""
_PATTERN = """
<Attack_Pattern ID="{p_partkey}" Name="{p_name}" Status="{p_name}"><Description>{p_type}</Description>
p_size > 30: <Likelihood_Of_Attack>{p_name}</Likelihood_Of_Attack>
<Prerequisites><Prerequisite>{p_brand}</Prerequisite><Prerequisite>{p_retailprice}</Prerequisite></Prerequisites>
<Skills_Required><Skill Level="{p_name}">{p_type} <xhtml:i>{p_brand}</xhtml:i></Skill><Skill>{p_size}</Skill></Skills_Required>
<Execution_Flow><Attack_Step><Step>{p_size}</Step><Phase>{p_retailprice}</Phase><Description>{p_type}</Description>
p_size > 20: <Technique>{p_brand}</Technique><Technique>{p_name}</Technique>
</Attack_Step></Execution_Flow>
p_size > 40: <Mitigations><Mitigation>{p_name}</Mitigation></Mitigations>
<Related_Attack_Patterns><Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="{p_size}"/></Related_Attack_Patterns>
p_size > 10: <Notes><Note Type="{p_retailprice}">{p_brand}</Note></Notes>
</Attack_Pattern>
"""
_CITED = '<External_Reference Reference_ID="REF-{p_size}"><Author>Size {p_size}</Author><Title>Title {p_size}</Title></External_Reference>'


def _catalogs(spark: SparkSession, parts: DataFrame, what: archives.Catalog, form: str) -> str:
    """Catalog files of parts, each with its table of references; the folder that holds them."""
    at = f"{scratch_dir(spark)}/catalogs-{uuid.uuid4().hex}"
    parts = parts.withColumn("file", F.floor(F.col("p_partkey") / 500))
    row = lambda rows, order, key, text: rows.select("file", F.lit(order).alias("ord"), F.col(key).cast("long").alias("k"), text.alias("value"))
    files, sizes = parts.select("file").distinct(), parts.select("file", "p_size").distinct()
    head = f'<?xml version="1.0"?>\n<{what.root} xmlns:xhtml="http://www.w3.org/1999/xhtml" Version="4.1"><Records>'
    rows = row(files, 0, "file", F.lit(head)).union(row(parts, 1, "p_partkey", _filled(form))).union(row(files, 2, "file", F.lit("</Records><External_References>")))
    rows = rows.union(row(sizes, 3, "p_size", _filled(_CITED))).union(row(files, 4, "file", F.lit(f"</External_References></{what.root}>")))
    rows.repartition("file").sortWithinPartitions("file", "ord", "k").select("file", "value").write.partitionBy("file").text(at)
    return at


def _weaknesses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    at = _catalogs(spark, table(spark, d, "part"), archives.WEAKNESSES, _WEAKNESS)
    return written(archives.read_catalog(spark, at), "records"), archives.read_references(spark, at)


@query("""
    select 'cwe:CWE-' || p_partkey as doc_id, p_name as title, case when p_size > 5 then '2025-01-31' else '2024-02-28' end as source_modified, '4.1' as source_version, 'REF-' || p_size as first_reference,
        '# CWE-' || p_partkey || ': ' || p_name || chr(10) || chr(10) || 'Status: ' || p_name || chr(10) || 'Abstraction: ' || p_retailprice
        || chr(10) || chr(10) || '## Description' || chr(10) || p_type || chr(10) || chr(10) || p_retailprice || ' <' || p_size || '>'
        || case when p_size > 30 then chr(10) || chr(10) || '## Extended Description' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_name else '' end
        || chr(10) || chr(10) || '## Modes of Introduction' || chr(10) || '- ' || p_name || ', ' || p_brand || case when p_size > 20 then ': ' || p_type else '' end
        || chr(10) || chr(10) || '## Applicable Platforms' || chr(10) || '- Language: ' || p_brand || ' (Often)' || chr(10) || '- Technology: ' || p_type
        || chr(10) || chr(10) || '## Common Consequences' || chr(10) || '- Scope: ' || p_name || ', ' || p_brand || ' | Impact: ' || p_type || case when p_size > 10 then ' | Note: ' || p_retailprice else '' end
        || chr(10) || chr(10) || '## Detection Methods' || chr(10) || '- ' || case when p_size > 15 then p_brand else 'Detection method' end || ' (effectiveness: ' || p_name || '): ' || p_type
        || case when p_size > 40 then chr(10) || chr(10) || '## Potential Mitigations' || chr(10) || '- [' || p_retailprice || '; ' || p_brand || '] ' || p_name else '' end
        || chr(10) || chr(10) || '## Relationships' || chr(10) || '- ' || p_retailprice || ' CWE-' || p_size || ' (view 1000)'
        || chr(10) || chr(10) || '## Taxonomy Mappings' || chr(10) || '- ' || p_name || case when p_size > 25 then ' ' || p_brand else '' end || ': ' || p_type
        || chr(10) || chr(10) || '## References' || chr(10) || '- REF-' || p_size || ': Title ' || p_size || ' (Size ' || p_size || '), ' || p_retailprice as content
    from part
""")
def q_weakness_documents(spark, d):
    docs = archives.documents(*_weaknesses(spark, d))
    return docs.select("doc_id", "title", "content", "source_modified", "source_version", F.get("reference_ids", F.lit(0)).alias("first_reference"))


@query("""
    select 'capec:CAPEC-' || p_partkey as doc_id, 
        '# CAPEC-' || p_partkey || ': ' || p_name || chr(10) || chr(10) || 'Status: ' || p_name || chr(10) || chr(10) || '## Description' || chr(10) || p_type
        || case when p_size > 30 then chr(10) || chr(10) || '## Likelihood of Attack' || chr(10) || p_name else '' end
        || chr(10) || chr(10) || '## Prerequisites' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_retailprice
        || chr(10) || chr(10) || '## Skills Required' || chr(10) || '- (' || p_name || ') ' || p_type || ' ' || p_brand || chr(10) || '- ' || p_size
        || chr(10) || chr(10) || '## Execution Flow' || chr(10) || '- Step ' || p_size || ' [' || p_retailprice || ']: ' || p_type
        || case when p_size > 20 then chr(10) || '  - Technique: ' || p_brand || chr(10) || '  - Technique: ' || p_name else '' end
        || case when p_size > 40 then chr(10) || chr(10) || '## Mitigations' || chr(10) || '- ' || p_name else '' end
        || chr(10) || chr(10) || '## Related Attack Patterns' || chr(10) || '- ChildOf CAPEC-' || p_size
        || case when p_size > 10 then chr(10) || chr(10) || '## Notes' || chr(10) || '- ' || p_retailprice || ': ' || p_brand else '' end as content
    from part
""")
def q_pattern_documents(spark, d):
    at = _catalogs(spark, table(spark, d, "part"), archives.PATTERNS, _PATTERN)
    return archives.documents(written(archives.read_catalog(spark, at, archives.PATTERNS), "records"), archives.read_references(spark, at, archives.PATTERNS)).select("doc_id", "content")


@query("""
    select 'cwe:CWE-' || p_partkey as doc_id, p_retailprice as relation, 'CWE-' || p_size as target from part
    union all select 'cwe:CWE-' || p_partkey, p_name, case when p_size > 25 then p_brand else p_type end from part
""")
def q_catalog_edges(spark, d):
    records = _weaknesses(spark, d)[0]
    known = archives.relationship_edges(records).select("doc_id", F.col("nature").alias("relation"), "target")
    return known.union(archives.taxonomy_entries(records).select("doc_id", "taxonomy", "entry"))


@query("select p_partkey::varchar as id, 'REF-' || p_size as reference_id, case when p_size > 3 then 'Title ' || p_size end as title, p_size > 3 as known from part")
def q_catalog_citations(spark, d):
    """Small sizes are missing from the table of references."""
    records, references = _weaknesses(spark, d)
    small = references.where(F.substring("reference_id", 5, 9).cast("int") > 3)
    return archives.citations(records, small).select("id", "reference_id", "title", "known")


@query("select p_partkey::varchar as id, case when p_size = 1 then 'missing' when p_size = 2 then 'duplicate' when p_size = 3 then 'renamed' else 'selected' end as status from part")
def q_catalog_selection(spark, d):
    """Parts of size 1 are left out of the catalogs, those of size 2 stand in them twice, those of size 3 under another name."""
    parts = table(spark, d, "part")
    changed = parts.withColumn("p_name", F.when(F.col("p_size") == 3, F.concat(F.lit("other "), "p_name")).otherwise(F.col("p_name")))
    at = _catalogs(spark, changed.where("p_size > 1").union(changed.where("p_size = 2")), archives.WEAKNESSES, _WEAKNESS)
    wanted = parts.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return archives.select_records(archives.read_catalog(spark, at), wanted).select("id", "status")
