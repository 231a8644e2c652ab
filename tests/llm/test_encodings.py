import pytest

from tidemark.llm.encodings import Detector, readings, train, wrong_encodings

SENTENCES = {
    "de": ["Bitte zuerst den Schlüssel prüfen, dann die Änderung zurückstellen.", "Für die Einträge fehlen die Zeitstempel, das müssen wir klären.", "Straßennamen gehören in die Übersetzung."],
    "fr": ["Il faut vérifier la clé avant d’écrire.", "L’exécution est très lente parce que le dépôt est vidé.", "Ça marche, mais des entrées restent inutilisées."],
    "ru": ["Не удаляйте строки, пока источник не подтверждён.", "Ошибка появляется только после попыток.", "Изменение ломает порядок записей."],
    "ja": ["まずブランチが最新か確認してください。", "キューは空なのにカウンタは数を示します。", "エラーは再試行で発生します。"],
    "pl": ["Część testów wciąż czeka.", "Proszę najpierw sprawdzić, czy gałąź jest świeża.", "Błąd pojawia się dopiero po próbach."],
    "en": ["It’s fine… see the “note” — cost: about 3 µs, 2 × less, ≤ 5.", "Please trim the queue – it’s stale.", "Naïve counting costs £5 and 20 °C."],
}


def samples():
    return {k: [v[i % 3] + " " + v[(i + 1) % 3] + f" {i}" for i in range(40)] for k, v in SENTENCES.items()}


@pytest.fixture(scope="module")
def detector():
    return Detector(*train(samples()))


CASES = [
    ("de", "cp1252", "utf-8"), ("de", "latin_1", "utf-8"), ("de", "cp1251", "utf-8"), ("fr", "mac_roman", "utf-8"), ("ru", "cp1252", "cp1251"), ("ru", "koi8_r", "cp1251"), ("ru", "cp1251", "koi8_r"),
    ("pl", "cp1252", "cp1250"), ("pl", "cp437", "utf-8"), ("en", "cp1252", "utf-8"), ("ja", "cp1251", "utf-8"), ("ja", "latin_1", "euc_jp"), ("de", "cp1252", "cp850"),
]


@pytest.mark.parametrize("lang,wrong,right", CASES)
def test_found_and_restored(detector, lang, wrong, right):
    for text in SENTENCES[lang]:
        try:
            raw = text.encode(right)
        except UnicodeEncodeError:
            continue
        bad = "".join(raw[i : i + 1].decode(wrong, "replace") if raw[i : i + 1].decode(wrong, "replace") != "�" else chr(raw[i]) for i in range(len(raw)))
        if bad == text:
            continue
        found, restored, chains = detector.doc("ok, " + bad)
        assert found and restored == "ok, " + text, (bad, restored, chains)


def test_twice(detector):
    text = SENTENCES["fr"][1]
    once = text.encode().decode("latin_1")
    twice = once.encode().decode("latin_1")
    assert detector.doc(twice)[:2] == (True, text)


@pytest.mark.parametrize("text", [t for v in SENTENCES.values() for t in v] + ["", "   ", "plain", "NÃO ALTERE", "½ £ ° © ñ Ñ ¿Qué?", "Âge, Ångström, Øresund", "🚀👩‍💻 مرحبا שלום नमस्ते ไทย", "├── src\n│   └── a.rs", "x" * 100_000, "é" * 50_000])
def test_right_text_is_left(detector, text):
    assert detector.doc(text)[:2] == (False, text)


def test_lost_bytes(detector):
    found, restored, chains = detector.doc("donÔ��t")
    assert found and chains[-1] == "lost"


def test_null(detector):
    assert detector.doc(None) == (False, None, [])


def test_readings_are_distinct():
    seen = [t for t, _, _ in readings("Ã©")]
    assert "é" in seen and len(seen) == len(set(seen)) and "Ã©" not in seen


def test_table(spark):
    rows = [(i, t, k, "x") for k, v in samples().items() for i, t in enumerate(v)]
    rows += [(9001, SENTENCES["de"][0].encode().decode("cp1252", "replace"), " DE ", "x"), (9002, None, "de", "x"), (9003, "", None, "x"), (9001, SENTENCES["de"][0].encode().decode("cp1252", "replace"), None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, garbled string")
    got = wrong_encodings(df)
    assert sorted(r["doc_id"] for r in got.where("garbled").collect()) == [9001, 9001]
    assert {r["doc_id"]: r["restored"] for r in got.where("doc_id > 9000").collect()} == {9001: SENTENCES["de"][0], 9002: None, 9003: ""}
    assert got.count() == len(rows) and wrong_encodings(df.limit(0)).count() == 0
