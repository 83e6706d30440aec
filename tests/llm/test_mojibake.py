import pytest

from statloom.llm import mojibake as M

TEXT = "The appraiser’s résumé under § 212.05(1) says “trailers” are exempt—½ of the rate. An additional 4¢ per gallon at 60°F; History.—s. 3. The dealer’s “use” of § 203.14 and the taxpayer’s notice."


NAMES = "Müller & Søn, Großmann Straßenbau, Łódź, Ångström, Façade Pâtisserie, Peña Marítima, Ñandú. SÃO TOMÉ LOGÍSTICA, IMPORTAÇÃO FORÂNEA, AÇÚCAR. ООО «Вектор» and 東海商事"
SPANISH = "La declaración del año según la sección § 212.05; el contribuyente también deberá presentar información."


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", TEXT.replace("212.05", f"{200 + i % 20}.{i % 90 + 10}")) for i in range(60)] + [("en", f"{NAMES}, lot {i}") for i in range(3)] + [("es", f"{SPANISH} {i}") for i in range(20)]
    rows += [("en", None), (None, ""), ("xx", "plain")] + [("en", f"filing {i} without signs") for i in range(1200)]
    return M.fit(spark.createDataFrame(rows, "lang string, text string"))


def garble(text, wrong, times=1):
    for _ in range(times):
        data = text.encode("utf-8")
        text = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in data) if wrong not in ("gbk", "cp932") else data.decode(wrong, "replace")
    return text


@pytest.mark.parametrize("wrong, times", [("cp1252", 1), ("cp1252", 2), ("cp1252", 3), ("latin-1", 1), ("mac_roman", 1), ("cp437", 1), ("cp850", 1), ("cp1251", 1)])
def test_round_trip(model, wrong, times):
    r = M.restore(garble(TEXT, wrong, times), model)
    assert r.found and r.text == TEXT and r.chains


@pytest.mark.parametrize("wrong", ["mac_roman", "cp437", "latin-1"])
def test_one_byte_round_trip(model, wrong):
    r = M.restore(TEXT.encode("cp1252").decode(wrong), model)
    assert r.found and "appraiser’s" in r.text and "§ 212.05" in r.text and "“trailers”" in r.text


def test_a_stretch_only(model):
    text = TEXT + "\n" + garble(TEXT, "cp1252")
    assert M.restore(text, model).text == TEXT + "\n" + TEXT


def test_entities_of_bytes(model):
    text = "Nothing in &Acirc;&sect; 198.75 suggests that the dealer&acirc;&euro;&trade;s freight is taxable."
    assert M.restore(text, model).text == "Nothing in § 198.75 suggests that the dealer’s freight is taxable."


@pytest.mark.parametrize("text", [
    TEXT, "", "plain text", "Müller & Søn, Großmann Straßenbau, Łódź, Ångström, Façade Pâtisserie, Peña Marítima, Ñandú", "SÃO TOMÉ LOGÍSTICA, IMPORTAÇÃO FORÂNEA, AÇÚCAR", "ООО «Вектор» and 東海商事", "Nothing in &sect; 198.75 &mdash; at all",
    "limi‐\nted and ser¬\nvice and bala­\nnce", "ofﬁcer résiimé", "a non breaking blank § 212.05",
])
def test_sound_text_is_left_alone(model, text):
    r = M.restore(text, model)
    assert not r.found and r.text == text


def test_lost_originals_are_found_and_filled_where_sure(model):
    r = M.restore("The appraiser�s notice under � 212.05 is �.", model)
    assert r.found and r.text.startswith("The appraiser’s notice under § 212.05") and r.lost == 1


def test_operator(spark, model):
    df = spark.createDataFrame([("t", 1, garble(TEXT, "cp1252"), 5), ("t", 2, TEXT, 6), ("t", 3, None, 7), ("t", 4, "", 8), ("t", 1, garble(TEXT, "cp1252"), 5)], "src_table string, raw_id long, text string, n_lost int")
    out = M.restore_texts(df, model, ["src_table", "raw_id", "n_lost"])
    assert out.columns == ["src_table", "raw_id", "chains", "n_lost", "outcome", "restored_text"]
    assert [(r.raw_id, r.restored_text) for r in out.collect()] == [(1, TEXT)] * 2
    assert M.restore_texts(df.limit(0), model, ["raw_id"]).count() == 0


def test_long_text(model):
    assert M.restore("x " * 300_000 + "dealerâ€™s", model).text.endswith("dealer’s")


def test_texts_the_model_has_not_seen(spark, model):
    """Recall and precision on sentences whose words are in no dictionary."""
    heads = ["The vessel’s owner", "A guild’s charter", "Harbour masters’ fees", "Each orchard’s yield"]
    tails = ["“wharfage” under § 77.10 is waived—see part 9.", "measured 5½ miles at 40°C beyond the quay", "costs 9¢ a bushel; Note.—s. 12", "follows § 31.4(2) and the “old custom” rule"]
    sound = [f"{h} {t}" for h in heads for t in tails]
    broken = [garble(t, w) for t in sound for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")]
    found = [M.restore(t, model) for t in broken]
    assert sum(r.found for r in found) >= 0.95 * len(broken) and sum(r.text == s for r, s in zip(found, [s for s in sound for _ in range(5)])) >= 0.95 * len(broken)
    assert not any(M.restore(t, model).found for t in sound)


def test_many_layers(model):
    text = garble("the dealer’s “use” of § 203.14", "latin-1", 7)
    assert M.restore(text, model).text == "the dealer’s “use” of § 203.14"


def test_empty_corpus(spark):
    m = M.fit(spark.createDataFrame([], "lang string, text string"))
    assert M.restore("the dealerâ€™s notice", m).text == "the dealer’s notice" and not M.restore("the dealer’s notice", m).found
