import pytest

from corpusloom.llm.mojibake import CHANNELS, decode_values, decode, fillings, fit, gaps, reread

CLEAN = ["Prüfung der Probe", "Société Générale", "Año 1950", "“quoted words” here", "Zoë Brážby", "Отчёт 1950", "Αναφορά 1960", "SOÃLER, JOÃO", "31 °C ± 4%", "name™ survey", "plain"] * 20
ENC = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1252", "cp1251")]


def garble(text, written, read):
    return text.encode(written).decode(read)


@pytest.mark.parametrize("channel", [c for c in CHANNELS if c[1] == "utf-8"])
def test_reread_undoes_a_wrong_reading(channel):
    read, written, times = channel
    text = "Prüfung é"
    try:
        for _ in range(times):
            text = garble(text, written, read)
    except UnicodeDecodeError:
        return
    assert reread(text, *channel) == "Prüfung é"


def test_fit_prefers_words_of_one_script():
    assert fit("Prüfung") == 0 > fit("Prьfung")
    assert fit("O’Brien") == 0 > fit("O«Brien")
    assert fit("SOÃLER") == 0 > fit("FlÃmby")


def test_lattices_with_wildcards():
    lost = gaps("Pr\ufffdfung")
    assert len(lost) == 1
    (gap,) = lost.values()
    assert gap.fits("Prüfung") and not gap.fits("Pruefung") and not gap.fits("Prüfing")
    assert set(gap.keys()) & set(fillings("Prüfung"))
    # half of a character is lost: the lead byte is known, so only what it can begin fits
    both = gaps("MÃ\ufffdller")
    fits = {CHANNELS[k]: g for k, g in both.items() if k < len(CHANNELS)}
    utf8 = fits["cp1252", "utf-8", 1]
    assert utf8.fits("Müller") and not utf8.fits("Mœller")
    assert set(utf8.keys()) & set(fillings("Müller"))
    assert gaps("\ufffd\ufffd\ufffd")[len(CHANNELS)].keys() == []


def test_a_lost_byte_in_a_garbled_span_is_decoded_in_the_search():
    counts, found = {"müller": 50, "hans": 50}, {"MÃ\ufffdller": [("Müller", 50)]}
    assert decode("Hans MÃ\ufffdller", counts, 1000, found) == (True, "Hans Müller")
    assert decode("Hans MÃ\ufffdller", counts, 1000, {}) == (True, None)
    assert decode("Hans MÃ¼ller", counts, 1000, {}) == (True, "Hans Müller")
    assert decode("CONCEIÇÃO-VAREL, JÂ", {"conceição": 40, "varel": 40, "jâ": 37, "j": 900}, 100_000, {}) == (False, "CONCEIÇÃO-VAREL, JÂ")


def test_capitals_that_happen_to_be_valid_bytes_stay():
    assert decode("VÕŽHAM,UC", {"võžham": 40, "uc": 90}, 1_000_000, {}) == (False, "VÕŽHAM,UC")
    assert decode("VÃ•Å½HAM,UC", {"võžham": 40, "uc": 90}, 1_000_000, {}) == (True, "VÕŽHAM,UC")
    assert decode("DÃ´rÃ , WE", {"dôrà": 40}, 1_000_000, {}) == (True, "Dôrà, WE")


def test_many_lost_names_of_another_script(spark):
    """Names without an ASCII letter meet by what is left of them, not all each other."""
    names = ["".join(chr(0x430 + (k * 7 + j * (k % 11 + 3)) % 32) for j in range(9)) for k in range(800)]
    rows = [("f", k, n) for k, n in enumerate(names)] * 2 + [("f", 10_000 + k, n[:4] + "\ufffd" + n[5:]) for k, n in enumerate(names)]
    got = {r["doc_id"]: (r["damaged"], r["original"]) for r in decode_values(spark.createDataFrame(rows, "field string, doc_id long, value string")).collect()}
    assert sum(got[10_000 + k] == (True, n) for k, n in enumerate(names)) >= 0.99 * len(names)
    assert not any(got[k][0] for k in range(len(names)))


def test_damage_is_found_and_undone(spark):
    rows = [("f", k, t) for k, t in enumerate(CLEAN)]
    bad, n = {}, 1000
    for text in dict.fromkeys(CLEAN):
        for written, read in ENC:
            try:
                value = garble(text, written, read)
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            if value != text:
                bad[n] = (value, text)
                n += 1
    bad[n] = ("Pr�fung der Probe", "Prüfung der Probe")
    bad[n + 1] = ("Q��zz", None)
    rows += [("f", k, v) for k, (v, _) in bad.items()]
    got = {r["doc_id"]: (r["damaged"], r["original"]) for r in decode_values(spark.createDataFrame(rows, "field string, doc_id long, value string")).collect()}
    assert not [rows[k] for k in range(len(CLEAN)) if got[k] != (True, None) and got[k] != (False, CLEAN[k])]
    missed = {k: v for k, v in bad.items() if not got[k][0]}
    assert len(missed) <= len(bad) // 10, missed
    right = sum(got[k][1] == t for k, (_, t) in bad.items())
    assert right >= 0.9 * len(bad)
    assert got[n] == (True, "Prüfung der Probe")
    assert got[n + 1] == (True, None)


def test_odd_rows(spark):
    rows = [("f", 1, None), ("f", 2, ""), ("f", 3, "plain"), ("f", 3, "plain"), (None, None, "x"), ("f", 4, "é" * 20_000)]
    df = spark.createDataFrame(rows, "field string, doc_id long, value string")
    got = decode_values(df)
    assert got.count() == 4
    assert got.where("damaged").count() == 0
    assert decode_values(df.limit(0)).count() == 0
    wide = spark.createDataFrame([("f", 1, "PrÃ¼f", 5, "w")], "field string, doc_id long, value string, n int, original string")
    assert tuple(decode_values(wide).first()) == ("f", 1, "PrÃ¼f", True, "Prüf")
