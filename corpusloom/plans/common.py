"""What the queries and their SQL share: parameters and the CTEs that read the archive's tables."""

from __future__ import annotations

TERMS = ["account", "invoice", "tobacco"]
GROUPS = {
    "court documents": ["deposition"],
    "internal communication": ["email", "letter", "memo", "minutes", "note", "telex"],
    "marketing documents": ["advertisement", "sales material"],
    "news reports": ["press release"],
    "scientific publications": ["publication", "study, chemical"],
}
REGIONS = {"coastal": [114, 115, 117, 119, 123], "overseas": [105, 106, 111, 116]}

BASE = """
    with d as (select distinct * from docs),
    y as (select distinct id as unit_id, year from docs),
    ty as (select distinct doc_id, lower(trim(doc_type)) as doc_type from doc_types where doc_type is not null),
    p as (select distinct * from postings),
    tot as (select unit_id, sum(tf) as total from p where unit = 'docs' and ngram = 1 group by unit_id),
    v as (select ngram, token, cast(coalesce(sum(total), 0) as bigint) as total from (select distinct * from tokens where token is not null) group by all),
    cal as (select cast(unnest(range((select min(year) from docs), (select max(year) from docs) + 1)) as integer) as year),
    w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as words from documents where text is not null),
    tx as (select t.*, y.year, y.collection_id from documents t join (select distinct id, year, collection_id from docs) y on t.doc_id = y.id where text is not null)
"""


def quoted(values) -> str:
    """Values as the inside of a SQL list."""
    return ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)
