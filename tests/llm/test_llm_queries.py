import pytest

from corpusloom.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(name, spark, data, duck, same):
    df = q.QUERIES[name](spark, data)
    if name in q.SQL:
        same(df, duck, q.SQL[name])
    else:
        # no SQL: the columns that are stated, rows without nulls but where something is lost for good, and none twice
        columns, lost = EXPECTED[name]
        assert [f"{c} {t}" for c, t in df.dtypes] == columns.split(", ")
        rows = [tuple(map(repr, r)) for r in df.collect()]
        assert rows and len(set(rows)) == len(rows)
        assert not any(v == "None" for r in rows for c, v in zip(df.columns, r, strict=True) if c not in lost)


EXPECTED = {
    "p1_found": ("field string, doc_id bigint, value string", ()),
    "p1_restored": ("field string, doc_id bigint, value string, damaged boolean, original string", ("original",)),
    "p3_found": ("tid string, page_no int, line_no int, kind string", ()),
    "p3_text": ("tid string, page_no int, para_no int, text string", ()),
    "p6_found": ("name_a string, name_b string", ()),
    "p8_ids": ("doc_id bigint, ids array<int>", ()),
    "p9_found": ("doc_id bigint, item_id bigint", ()),
    "p10_found": ("doc_id_a bigint, doc_id_b bigint", ()),
}
