from corpusloom.llm.scan_repair import Lexicon, Stream, confused, damaged_lines, decode, is_number, kinds_of, lines_of, paragraphs, prefix_skeletons, repaired_paragraphs, shown, skeleton

BODY = "the committee found that the harmless seedling was examined by the company in november"


def test_skeletons_meet():
    for a, b in (("modern", "modem"), ("wholesaler", "vvholesaler"), ("zellwood", "zeuwood"), ("daily", "claily"), ("image", "irnage"), ("share", "5hare")):
        assert skeleton(a) == skeleton(b)
        assert confused(a, b)
    assert confused("the", "tbe") == 1
    assert confused("tbe", "cat") is None
    assert confused("same", "same") == 0


def test_skeletons_of_parts():
    for word in ("wholesaler", "ddlid", "iiii", "Radium", "d"):
        heads, tails = prefix_skeletons(word)
        assert heads == [skeleton(word[:k]) for k in range(len(word) + 1)]
        assert tails == [skeleton(word[k:]) for k in range(len(word) + 1)]


def test_numbers():
    for x in ("7", " - 12 - ", "— 3 —", "[4]", "Page 3", "PAGE 2/9", "3 of 12", "xiv", "MX26837465", "TVN 123456789"):
        assert is_number(x), x
    for x in ("20.", "54,368.", "months.", "9 --", "Page", "1.8 —", "", "   "):
        assert not is_number(x), x


def page(lines):
    return "\n".join(lines)


def test_damage(spark):
    words = (BODY + " ").split()
    pages = []
    for p in range(1, 9):
        pages.append(("a", p, page([f"  Minutes of {'tbe' if p == 2 else 'the'} committee", " ".join(words[p:] + words[:p]), " ".join(words[-p:]) + (" seed-" if p == 3 else ""), *(["ling was examined"] if p == 3 else []), f"- {p} -"])))
    pages[4] = ("a", 5, page(["MINUTES OF THE COMMITTEE", "the comrnittee found that the harrnless seedling was ex-", "amined by the company in novernber", "5"]))
    pages[5] = ("a", 6, page(["Minutes of the committee", "the committee found that the harmless seed-", "- 6 -"]))
    pages[6] = ("a", 7, page(["Minutes of the committee", "ling was examined by the c0mpany", "- 7 -"]))
    df = spark.createDataFrame([*pages, pages[0], ("a", 9, None), ("a", 10, ""), ("b", 1, "alone"), (None, 1, "x")], "tid string, page_no int, text string")
    got = {tuple(r) for r in damaged_lines(df).collect()}
    assert {(t, p, n) for t, p, n, k in got if k == "header"} == {("a", p, 1) for p in range(1, 9)}
    assert {p for _, p, _, k in got if k == "number"} == set(range(1, 9))
    assert {(p, n) for _, p, n, k in got if k == "hyphen"} == {(3, 3), (5, 2), (6, 2)}
    assert {(p, n) for _, p, n, k in got if k == "misread"} == {(5, 2), (5, 3), (7, 2)}
    text = {(r["page_no"], r["para_no"]): r["text"] for r in repaired_paragraphs(df).where("tid = 'a'").collect()}
    assert sorted(text) == [(1, 1)]  # no page ends with a full stop, so all are one paragraph
    assert "the committee found that the harmless seedling was examined by the company in november the committee found that the harmless seedling was examined by the company" in text[1, 1]


def test_words_cut_and_run_together(spark):
    pages = [("a", k, "the committee found that the harmless seedling was examined.") for k in range(1, 31)] + [("a", 40, "the commit tee foundthat the seed ling was examined.")]
    df = spark.createDataFrame(pages, "tid string, page_no int, text string")
    text = {r["page_no"]: r["text"] for r in repaired_paragraphs(df).collect()}
    assert text[40] == "the committee found that the seedling was examined."
    assert damaged_lines(df).where("page_no = 40").count() == 0


def test_odd_pages(spark):
    schema = "tid string, page_no int, text string, kind string, line_no int"
    df = spark.createDataFrame([("a", 1, "qq\r\n\r\nyy", "k", 7), ("a", None, "z", "k", 7), ("c", 1, "word " * 30_000, "k", 7), ("d", 1, "l-\n" * 3000, "k", 7)], schema)
    assert damaged_lines(df).where("tid = 'a'").count() == 0
    assert repaired_paragraphs(df).where("tid = 'c'").count() == 1
    assert damaged_lines(df.limit(0)).count() == 0
    assert lines_of("x\r\n\r\ny") == ["x", "", "y"]


def test_paragraphs_are_of_least_cost():
    lines = ["The first one begins here and runs", "on to its end.", "", "Another begins after a blank line and", "goes on.", "But this one follows a short line that"]
    assert paragraphs(lines) == [(0, 2), (2, 4), (4, 5)]
    assert paragraphs(["", " "]) == []
    assert paragraphs(["word and word"] * 5000) == [(0, 5000)]


def test_a_paragraph_has_its_own_measure():
    """Each line of the narrow block is short for the page and ends a sentence, so line by line all would break; as a block
    they fill their own measure. The same line within the wide text ends a paragraph."""
    wide = "This line of the report is as wide as the whole page is, and it goes on"
    narrow = ["Beds were sown in May.", "Pots were sold in June", "and all was well then.", "Rows were cut in fall."]
    assert paragraphs([wide, wide, wide + ".", "", *narrow, "", wide, wide]) == [(0, 3), (3, 7), (7, 9)]
    assert paragraphs([wide, narrow[0], wide[0].upper() + wide[1:], wide]) == [(0, 2), (2, 4)]


def test_a_paragraph_goes_on_over_pages(spark):
    pages = [("a", 1, "First one ends.\n\nThe second goes on and"), ("a", 2, "on over a whole page and"), ("a", 3, "ends here.\n\nThird."), ("b", 4, "Another tid."), ("a", 5, "After a gap.")]
    got = {(r["tid"], r["page_no"], r["para_no"]): r["text"] for r in repaired_paragraphs(spark.createDataFrame(pages, "tid string, page_no int, text string")).collect()}
    assert got == {("a", 1, 1): "First one ends.", ("a", 1, 2): "The second goes on and on over a whole page and ends here.", ("a", 3, 2): "Third.", ("b", 4, 1): "Another tid.", ("a", 5, 1): "After a gap."}


WORDS = {"the": 9000, "found": 900, "that": 4000, "cost": 500, "effective": 300, "cost-effective": 200, "modern": 400, "committee": 600, "plant": 500, "was": 5000}


def joint(text, words=WORDS, pairs=None):
    run = Stream(text, list(range(1, text.count("\n") + 2)))
    path = {a[0]: a for a in decode(run, Lexicon(words, pairs or {}, 50_000.0, 0.05))}
    out, i = [], 0
    while i < len(run.texts):
        out.append(shown(run, path[i]) if i in path else run.texts[i])
        i += path[i][1] if i in path else 1
    return out


def test_arcs_compete():
    assert joint("foundtbat the") == ["found that", "the"]  # run together and misread at once
    assert joint("the comrnit tee was") == ["the", "committee", "was"]  # torn and misread at once
    assert joint("the comm-\nitt ee was") == ["the", "committee", "was"]  # a hyphen and a stray blank in one word
    assert joint("a cost-\neffective plant") == ["a", "cost-effective", "plant"]
    assert joint("a mod-\nem plant") == ["a", "modern", "plant"]
    assert joint("to day", {"to": 900, "day": 100, "today": 5}, {("to", "day"): 90}) == ["to day"]  # neighbours are more frequent than the word
    assert joint("to day", {"to": 900, "day": 1, "today": 500}, {("to", "day"): 1}) == ["today"]


def test_heads_need_no_place_or_length():
    """Many lines of furniture, long ones and one with a full stop are told from body; body that recurs within the page isn't."""
    lines = ["Aa", "Bb.", "Kk", "Pp", "Ee", "body line", "Aa", "more body", "Ff" * 200]
    kinds = kinds_of(lines, {1, 2, 3, 4, 5, 7, 9})
    assert kinds == ["header"] * 5 + ["body"] * 3 + ["header"]
