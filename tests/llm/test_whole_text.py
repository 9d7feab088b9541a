"""Cases that text operators left out by counts or tables of their own."""

from corpusloom.llm.bpe import ByteBPE
from corpusloom.llm.leakage import Passages, leaked_items
from corpusloom.llm.lookalikes import alike_pairs, repairs
from corpusloom.llm.name_variants import given_parts, pieces, probes, variant_pairs
from corpusloom.llm.scan_repair import CONFUSIONS, confused, damaged_lines, repaired_paragraphs, skeleton

SCHEMA = "tid string, page_no int, text string"


def test_splits_and_merges_at_every_size(spark):
    """The same share of damage is repaired in a corpus of any size."""
    sound, hurt = "the committee found that the cost-effective seedling was examined.", "the commit tee foundthat the costeffective seed ling was examined."
    for size in (1, 10):
        pages = [("a", k, hurt if k % 20 == 0 else sound) for k in range(1, 20 * size + 1)]
        df = spark.createDataFrame(pages, SCHEMA)
        assert {r["text"] for r in repaired_paragraphs(df).collect()} == {sound}, size
        assert damaged_lines(df).count() == 0


def test_every_confusion_meets():
    for true, seen in ((a, b) for a, bs in CONFUSIONS.items() for b in bs):
        assert skeleton(true) == skeleton(seen), (true, seen)
        for word in ("{}", "k{}p", "{0}x{0}", "an{}ic"):
            assert skeleton(word.format(true)) == skeleton(word.format(seen)), (true, seen)
            assert confused(word.format(true), word.format(seen)) is not None
    assert skeleton("hybrid") == skeleton("hy6rld")


def test_confusions_of_all_kinds_are_repaired(spark):
    sound = "the hybrid plants of the summer were harvested under supervision."
    pages = [("a", k, sound) for k in range(1, 31)] + [("a", 40, "tlie HY6RID plants of the sunnmer were harve8ted vnder supeivision.")]
    df = spark.createDataFrame(pages, SCHEMA)
    assert {r["text"] for r in repaired_paragraphs(df).where("page_no = 40").collect()} == {sound.replace("hybrid", "HYBRID")}
    assert {r["kind"] for r in damaged_lines(df).where("page_no = 40").collect()} == {"misread"}


def test_copies_never_meet(spark):
    """A text with a hundred thousand equal copies and two variants: the join gives what must come out and nothing in between."""
    copies = spark.range(100_000).selectExpr("id as doc_id", "'the same text' as text")
    variants = spark.createDataFrame([(200_000, "the same text"), (200_001, "the same text")], "doc_id long, text string")
    found = alike_pairs(copies.unionByName(variants))
    assert found.count() == 200_001
    assert found.where("doc_id_b < 200000").count() == 0


def test_mixed_words_without_look_alikes():
    assert repairs("дoм") == {"дoм": "дом"}
    assert repairs("дом") == {}
    assert repairs("naïve Ωmega") == {}


CYRILLIC = "Комитет рассмотрел новый годовой отчёт лаборатории табачной фабрики города Киева зимой прошлого года вместе жёлтыми листами книги учёта дыма пепла шума света и всего прочего"
GREEK = "Η επιτροπή εξέτασε την έκθεση του εργαστηρίου για τον καπνό και βρήκε ότι τα φύλλα ήταν ξηρά πριν από τον χειμώνα της χρονιάς εκείνης στο βόρειο μέρος"
JAPANESE = "委員会は煙草の葉に関する研究所の年次報告書を検討し、冬の前に乾燥していたことを確認した。"


def test_items_of_other_scripts(spark):
    items = [(1, CYRILLIC), (2, GREEK), (3, JAPANESE)]
    swapped = " ".join(w[::-1] for w in CYRILLIC.split())
    texts = ["vor " + " ".join(CYRILLIC.upper().split()[1:22]) + " nach", "x " + GREEK.replace(" ", "\n") + " y", "前文" + JAPANESE[5:28] + "後文", swapped, JAPANESE[:15] + "別" + JAPANESE[20:30], "aya aa paaa " * 20, " ".join(GREEK.split()[:15])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in found.collect()} == {(0, 1), (1, 2), (2, 3)}


def test_sets_of_bounded_words_give_the_same(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(25))) for k in range(40)]
    docs = spark.createDataFrame([(k, "a " + t + " b") for k, t in items] + [(99, "none")], "doc_id long, text string")
    found = leaked_items(docs, spark.createDataFrame(items, "item_id long, text string"), most_words=400)
    assert {tuple(r) for r in found.collect()} == {(k, k) for k in range(40)}


def test_long_streams_go_in_slices():
    text = " ".join(f"w{j}" for j in range(30))
    passages = Passages([(7, text)])
    assert passages.found(["z" * ((1 << 20) - 20) + text + "z" * 1000, None, "", "z" * (1 << 20) + text[:60]]) == [(0, 7)]


def links(spark, names):
    return {tuple(r) for r in variant_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}


def test_slips_in_every_format_are_linked(spark):
    sound = ["Smith, JR", "J. R. Smith", "SMITH,JR", "Smith-JR", "John R. Smith", "Smith, John R, Jr."]
    slips = ["Smtih, JR", "J. R. Smtih", "SMTIH,JR"]
    assert len(links(spark, sound + slips)) == 9 * 8 // 2


def test_people_without_a_middle_initial_are_linked(spark):
    robert = ["Robert Smelting", "Smelting, Robert", "SMELTING, ROBERT", "Robert  Smelting", "Bert Smelting", "Smeltnig, Robert"]
    got = links(spark, robert)
    assert got == {(a, b) for a in robert for b in robert if a < b}


def test_given_names_that_contradict_part_people(spark):
    got = links(spark, ["Krurnell, Henry D", "Henry D. Krurnell", "Hank D. Krurnell", "Krurnell, Harold D", "Harold D. Krurnell"])
    assert ("Henry D. Krurnell", "Krurnell, Henry D") in got
    assert not any(("Henry" in a + b or "Hank" in a + b) and "Harold" in a + b for a, b in got)
    assert given_parts([["henry"], ["harold"], ["harold", "henry"], []]) == [0, 0, 0, 0]
    assert given_parts([["henry"], ["harold"], []]) == [1, 0, -1]


def test_slips_of_slips_end_at_one_head(spark):
    head, slip, far = ["Kestrel Leaf Company", "KESTREL LEAF COMPANY", "Kestrel Leaf Co."], ["Kestrl Leaf Company", "KESTRL LEAF COMPANY"], ["Kest Leaf Company"]
    names = head + slip + far
    assert links(spark, names) == {(a, b) for a in names for b in names if a < b}


def test_probes_meet_every_near_key():
    import random

    draw = random.Random(3)
    for _ in range(3000):
        a = "".join(draw.choice("abc") for _ in range(draw.randint(0, 9)))
        b = list(a)
        for _ in range(draw.randint(0, 2)):
            k = draw.randint(0, len(b))
            b[k : k + draw.randint(0, 1)] = [] if draw.random() < 0.3 else [draw.choice("abcd")]
        b = "".join(b)
        short, long = sorted((a, b), key=len)
        edits = [list(range(len(long) + 1))]
        for i in range(1, len(short) + 1):
            row = [i]
            for j in range(1, len(long) + 1):
                row.append(min(edits[-1][j] + 1, row[-1] + 1, edits[-1][j - 1] + (short[i - 1] != long[j - 1])))
            edits.append(row)
        if edits[-1][-1] <= 2:
            held = {(len(short), i, short[x : x + n]) for i, (x, n) in enumerate(pieces(len(short), 3))}
            assert held & set(probes(long, 2)), (short, long)


def test_very_long_pieces_are_encoded_like_the_library():
    import random

    from tokenizers import Tokenizer

    draw = random.Random(5)
    texts = ["ab" * 60_000, "".join(draw.choice("etaoinshrdlu") for _ in range(150_000)), "\u00fc" * 9_000 + " x", "=" * 50_000, "word " + "the" * 4_000 + "!"]
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    assert ByteBPE("/opt/tokenizers/byte_bpe_50k.json").encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
