import pytest

from attesta.llm import encoding as E

CLEAN = ["Après la migration, le café est prêt.", "Größere Änderungen müssen geprüft werden.", "A configuração não é válida — “nunca”.", "it’s naïve, can’t wait"]
RUSSIAN = ["Сначала остановите cache-jobs, затем очистите queue вручную.", "Команда team-a отвечает за этот модуль."]


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>mac_roman", "utf-8>cp437", "utf-8>cp850", "utf-8>cp1251"])
@pytest.mark.parametrize("text", CLEAN + RUSSIAN)
def test_undo_reverses_garble(chain, text):
    assert E.undo(E.garble(text, chain), chain) == text


def test_orderly_text_has_no_disorder():
    for text in [*CLEAN, *RUSSIAN, "“Â, Ã, É” are allowed", "├── src │ └── a", "≈ 3 √n ± 2 °C", "Ťïdon Dapôśisz", "Ελληνικά 中文 ⚠️", "ATENÇÃO: NÃO", "l’équipe", "x² ½ µs 5 €"]:
        assert sum(map(E.disorder, text.split())) == 0, text


def test_alignment_names_the_encodings():
    assert "utf-8>cp1252" in E.explain("dÃ©jÃ\xa0", "déjà") and E.explain("deja", "déjà") == []
    assert E.align("aé", "éa") is None
    assert "utf-8>cp1252" in E.explain("cafÃƒÂ©", "café")


def test_repair_leaves_clean_sentences_alone():
    text = "Le café est prêt. " + E.garble("Après la pause, l’équipe", "utf-8>cp1252") + ".\nDéjà vu."
    assert E.repair(text, ("utf-8>cp1252",)) == ("Le café est prêt. Après la pause, l’équipe.\nDéjà vu.", pytest.approx(E.repair(text, ("utf-8>cp1252",))[1]))


def test_documents(spark):
    rows, want = [], {}
    for i in range(40):
        rows.append((i, f"{CLEAN[i % 4]} Note {i}. {RUSSIAN[i % 2]}"))
    for k, chain in enumerate(["utf-8>cp1252", "utf-8>cp1252", "utf-8>cp437", "utf-8>cp437", "cp1251>cp1252", "cp1251>cp1252"]):
        source = f"{RUSSIAN[k % 2] if chain.startswith('cp1251') else CLEAN[k % 4]}"
        rows.append((100 + k, f"ok here.\n{E.garble(source, chain)}\nend {k}."))
        want[100 + k] = f"ok here.\n{source}\nend {k}."
    rows += [(201, "Après la migration, le caf� est pr�t."), (202, "Gr��ere Änderungen müssen gepr�ft werden."), (200, "lost �t�"), (300, None), (301, ""), (302, "plain"), (303, "é" * 100_000), (304, "“Â, Ã, É” are allowed in names.")]
    want |= dict.fromkeys((200, 201, 202))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.restored for r in E.garbled_documents(df).collect()}
    assert set(got) == set(want)
    assert got == want


def test_empty_table(spark):
    assert E.garbled_documents(spark.createDataFrame([], "doc_id long, text string, form string")).count() == 0


@pytest.mark.parametrize("text", ["Voilà la chose à faire", "Demandez à team", "Работа Р и Н"])
def test_halves_that_python_takes_for_blanks(text):
    for chain in ("utf-8>cp1252", "utf-8>latin-1"):
        assert E.repair(E.garble(text, chain), ("utf-8>cp1252", "utf-8>latin-1"))[0] == text


def test_half_restored_is_null(spark):
    rows = [(i, "Voilà le café prêt.") for i in range(9)] + [(100 + i, E.garble("Voilà le café prêt.", "utf-8>cp1252")) for i in range(3)]
    rows.append((200, E.garble("Voilà le café prêt.", "utf-8>cp1252") + " dÃ¿¿e"))
    got = {r.doc_id: r.restored for r in E.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {100 + i: "Voilà le café prêt." for i in range(3)} | {200: None}


def test_every_frequent_form_is_a_twin(spark):
    rows = [("gre", "grüße", 9), ("gre", "größe", 6), ("gre", "gr÷ße", 1), ("gre", "gréße", 2)]
    found = spark.createDataFrame([(i, form, key) for key, form, n in rows for i in range(n)], "doc_id long, form string, key string")
    got = {(r.form, r.twin) for r in E.twins(found).collect()}
    assert got == {("größe", "grüße"), ("gr÷ße", "grüße"), ("gr÷ße", "größe"), ("gréße", "grüße"), ("gréße", "größe")}


def test_a_capital_before_a_hard_blank_may_be_orderly():
    assert E.disorder("IRMÃ\u00a0") == E.disorder("É\u00a0:") == 0 < E.disorder("Ã\u00a0")


def test_an_encoding_that_is_in_no_list_is_learned(spark):
    """A table made up for this test: one sign for each letter, which no pair of encodings gives."""
    turned = str.maketrans(dict(zip("éèçàêöüäãí", "¤¦¨¬¯¶§¹ºˇ")))
    clean = ["L’été dernier, la répétition générale était prévue.", "Le café est prêt à être servi.", "Größe und Änderung müssen geprüft werden.", "A configuração não é válida aí.", "La même leçon, très tôt, à part."]
    rows = [(i, f"{clean[i % 5]} Fin {i}.") for i in range(60)]
    rows += [(100 + k, f"{clean[k % 5].translate(turned)} Fin {k}.") for k in range(10)]
    rows += [(200, "Une soirée hantée, ok.".translate(turned)), (201, "5 ¤ and § 3"), (202, "a ¶ mark")]
    got = {r.doc_id: r.restored for r in E.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(100, 110), 200}
    assert got[200] == "Une soirée hantée, ok." and sum(got[100 + k] == f"{clean[k % 5]} Fin {k}." for k in range(10)) >= 6


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "cp1251>cp1252", "utf-8>cp437", "cp1252>mac_roman", "koi8-r>cp1251"])
def test_recall_of_restored_texts(spark, chain):
    """Of planted passages of five sentences each, most come back as they were."""
    sentences = [*CLEAN, *RUSSIAN, "Die Prüfung schlug fehl, weil Zeilen gelöscht wurden.", "La conexión también falló según el equipo.", "Команда проверила все записи заново."]
    rows = [(i, " ".join(sentences[(i + k) % len(sentences)] for k in range(5))) for i in range(90)]
    want = {}
    for k in range(18):
        source = sentences[k % len(sentences)]
        broken = E.garble(source, chain)
        if broken and broken != source and E.undo(broken, chain) == source:
            rows.append((1000 + k, f"Note {k}: see below.\n{broken}\nend"))
            want[1000 + k] = f"Note {k}: see below.\n{source}\nend"
    got = {r.doc_id: r.restored for r in E.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.7 * len(want)
