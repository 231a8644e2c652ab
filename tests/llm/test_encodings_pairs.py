import pytest

from tests.llm.test_encodings import SENTENCES, samples
from tidemark.llm.encodings import MULTI, SINGLE, Detector, readings, train

MORE = {
    "is": ["Það þarf að bíða þar til það er búið.", "Ekki breyta því sem það skráir.", "Við sjáum að það virkar ekki."],
    "zh": ["请先检查分支是否最新。", "测试失败以后再提交一次。", "这个函数没有处理错误的情况。"],
}


@pytest.fixture(scope="module")
def detector():
    more = {k: [v[i % 3] + " " + v[(i + 1) % 3] + f" {i}" for i in range(40)] for k, v in MORE.items()}
    return Detector(*train(samples() | more))


@pytest.mark.parametrize("text,wrong,right", [
    ("カウンタは数を示します", "gbk", "cp932"), ("测试失败以后再提交一次", "cp949", "gbk"), ("Не удаляйте строки", "iso8859_5", "cp1251"), ("Не удаляйте строки", "iso8859_5", "koi8_r"),
    ("Ekki breyta því sem það skráir.", "cp1254", "cp1252"), ("Proszę najpierw sprawdzić", "cp1254", "cp1250"),
])
def test_pairs_of_any_encodings(detector, text, wrong, right):
    bad = text.encode(right).decode(wrong)
    assert bad != text and detector.doc("ok: " + bad)[:2] == (True, "ok: " + text), detector.doc("ok: " + bad)


def test_every_pair_is_a_reading():
    text = "Привет"
    for wrong in SINGLE:
        for right in ["cp1251", "koi8_r", "iso8859_5", "cp866"]:
            try:
                bad = text.encode(right).decode(wrong)
            except UnicodeDecodeError:
                continue
            assert bad == text or text in [t for t, _, _ in readings(bad)], (wrong, right)
    for wrong in MULTI:
        for right in MULTI:
            bad = "日本".encode(right).decode(wrong, "replace")
            assert "�" in bad or bad == "日本" or "日本" in [t for t, _, _ in readings(bad)], (wrong, right)


def test_a_strange_sign_does_not_drop_a_reading(detector):
    text = "カウンタは数を示します鬱"
    assert "鬱" not in detector.known
    for wrong in ("latin_1", "gbk"):
        assert detector.doc(text.encode("euc_jp").decode(wrong))[:2] == (True, text)


@pytest.mark.parametrize("text", [t for v in MORE.values() for t in v] + [v for w in SENTENCES.values() for v in w] + ["麒麟と鳳凰の饗宴", "Þorsteinn Ævarsson", "güneşli ağaç", "Žluťoučký kůň", "Ελληνικά κείμενα", "한국어 문장입니다", "繁體中文說明", "Ünïcödé", "Ελλάδα", "Їжак ґанок"])
def test_right_text_is_left(detector, text):
    assert detector.doc(text)[:2] == (False, text)
