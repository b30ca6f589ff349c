import pytest

from garimpo.llm.garbled import garbled, repair, repaired

CLEAN = "Não há razão: “o índice” — d’après l'été, größer, año, œuvre, naïve, 20° off, coração"
NATURAL = [
    CLEAN, "", "plain", "AÇÃO, MAÇÃ e ROMÃ: nomes", "Ã é letra, Â também", "«résumé» et Â majuscule, ÿ final", "√2 ≈ 1,414, π", "├── src\n│   └── main\n┌─┬┐", "Čistá řeka, šedý déšť, ŁÓDŹ", "очередь заметок", "¿Qué? ¡Ñandú! ÑOÑO",
    "索引と記憶の一覧", "👩‍💻 ✅", "“CAFÉ” é…", "NÃO “SÃO”", "a marca `�` é um sinal", "ÄÖÜ", "ROMû",
]


@pytest.mark.parametrize("text", NATURAL[:-1])
def test_natural_text_stays(text):
    assert repair(text) == (False, text)


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850", "cp437"])
def test_misread_utf8_comes_back(read_as):
    text = "Não há razão: a coração já é grande"
    bad = text.encode("utf-8").decode(read_as, "strict" if read_as != "cp1252" else "replace")
    found, got = repair(bad)
    assert found
    if "�" not in bad:
        assert got == text


def test_twice_and_within_clean_text():
    bad = "é clean, " + "coração".encode().decode("cp1252").encode().decode("cp1252") + " é"
    assert repair(bad) == (True, "é clean, coração é")
    assert repair("only one: cafÃ© in “good” text é") == (True, "only one: café in “good” text é")
    assert repair("Pendências l\x92index") == (True, "Pendências l’index")


def test_lost_characters_are_found():
    assert repair("or�amento")[0] and repair("a � b")[0]


def test_table(spark):
    clean = [(i, "então a não coração é", "x") for i in range(40)]
    bad = [(50, "ent³o a coraþÒo nÃÒo", "x"), (51, "a coraþÒo bate", "x"), (51, "a coraþÒo bate", "x"), (52, "só cafÃ©", "x"), (53, None, "x"), (54, "", "x"), (55, "ok " * 200_000 + "coraÃ§Ã£o", "x"), (56, "Ã", "x")]
    df = spark.createDataFrame(clean + bad, "doc_id long, text string, word string")
    got = sorted(r.chave for r in garbled(df, "doc_id", "text").collect())
    assert got == [50, 51, 52, 55]
    fixed = {r.chave: r.restaurado for r in repaired(df, "doc_id", "text").collect()}
    assert fixed[51] == "a coração bate" and fixed[52] == "só café" and fixed[55].endswith("coração")
    assert garbled(df.limit(0), "doc_id", "text").count() == 0 and repaired(df.limit(0), "doc_id", "text").count() == 0


def test_copies_of_one_garbled_text(spark):
    clean = [(i, f"então {i} a não coração é") for i in range(20)]
    df = spark.createDataFrame(clean + [(i, "entÒo a coraþÒo nÒo") for i in range(100, 110)], "doc_id long, text string")
    assert sorted(r.chave for r in garbled(df, "doc_id", "text").collect()) == list(range(100, 110))
    assert {r.restaurado for r in repaired(df, "doc_id", "text").collect()} == {"então a coração não"}


def test_letters_that_both_encodings_share(spark):
    clean = [(i, f"exportação {i} d’après coleção") for i in range(20)]
    df = spark.createDataFrame([*clean, (100, "exportaçăo"), (101, "Jusqu’au d’aprиs"), (102, "a Â· b"), (103, "« Â·»")], "doc_id long, text string")
    assert sorted(r.chave for r in garbled(df, "doc_id", "text").collect()) == [100, 101, 102]
    assert {r.chave: r.restaurado for r in repaired(df, "doc_id", "text").collect()} == {100: "exportação", 101: "Jusqu’au d’après", 102: "a · b"}
