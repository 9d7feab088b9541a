import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.operators.packed_values import split_packed, unpack_values


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("", []),
        (" ; ;\t", []),
        ("public", ["public"]),
        (" public ;redacted|x", ["public", "redacted", "x"]),
        ('public\t"marked ""draft"""\tsealed', ["public", 'marked "draft"', "sealed"]),
        ("'counsel''s review' | 'a; b'", ["counsel's review", "a; b"]),
        ("counsel's review; it's", ["counsel's review", "it's"]),
        ('[public,"on site / by appointment","x"]', ["public", "on site / by appointment", "x"]),
        ('(a, b, "c | d")', ["a", "b", "c | d"]),
        ("sealed (1998; renewed); b", ["sealed (1998; renewed)", "b"]),
        (r'"say \"so\"", b', ['say "so"', "b"]),
        ('"never closed; b', ['"never closed', "b"]),
        ("open [ bracket; b", ["open [ bracket", "b"]),
        ('a;"";b', ["a", "b"]),
        ("a；b", ["a", "b"]),
        ("{[a; b]; c}", ["a", "b", "c"]),
        ('"a" "b"', ['"a" "b"']),
    ],
)
def test_split(text, values):
    assert split_packed(text) == values


@given(st.lists(st.text(alphabet='abc ;|,"()', min_size=1).map(str.strip).filter(bool), max_size=6), st.sampled_from([";", "|", "\t", ", "]))
def test_round_trip(values, delimiter):
    packed = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_packed(packed) == values


@given(st.text())
def test_never_fails(text):
    assert all(v == v.strip() and v for v in split_packed(text))


def test_very_long():
    assert len(split_packed("a;" * 200_000)) == 200_000
    assert split_packed("(" * 50_000 + "a" + ")" * 50_000) == ["a"]
    assert split_packed("[" * 50_000) == ["[" * 50_000]


def test_rows(spark):
    rows = [(1, "a;b", "x"), (1, "a;b", "y"), (2, None, "x"), (3, "", "x"), (None, "c", "x"), (4, "a;b", "x")]
    df = spark.createDataFrame(rows, "id long, f string, value string")
    got = sorted(map(tuple, unpack_values(df, "id", "f").collect()), key=repr)
    assert got == sorted([(1, 1, "a"), (1, 2, "b"), (4, 1, "a"), (4, 2, "b"), (None, 1, "c")], key=repr)
    assert unpack_values(df.limit(0), "id", "f").count() == 0
