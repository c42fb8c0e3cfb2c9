import pytest

from tessella.llm import mojibake as M

TEXTS = ["Don’t measure — “under load”, naïve résumé…", "Während der Prüfung zeigte größere Mängel", "L’équipe a déjà traité 12 détails à vérifier", "La migración señaló códigos de país", "Usługa odrzuciła źródła, później zwiększyć pamięć", "Сервис отклонил старые ключи потому что очередь была заполнена"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("page", ["cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
def test_utf8_misread(text, page):
    data = text.encode()
    broken = "".join(bytes([b]).decode(page) if b < 128 or bytes([b]).decode(page, "ignore") else chr(b) for b in data)
    bad, restored, whole = M.repair(f"Correct beginning. {broken}")
    assert bad and whole and restored == f"Correct beginning. {text}"


def test_twice():
    broken = TEXTS[1].encode().decode("latin-1").encode().decode("latin-1")
    assert M.repair(broken)[1] == TEXTS[1]


@pytest.mark.parametrize("text, true, read", [(TEXTS[1], "cp1252", "cp437"), (TEXTS[2], "cp1252", "cp850"), (TEXTS[1], "cp1252", "mac_roman"), (TEXTS[5], "cp1251", "koi8_r"), (TEXTS[5], "koi8_r", "cp1251"), (TEXTS[4], "cp1250", "cp1252")])
def test_pages_swapped(text, true, read):
    broken = text.encode(true).decode(read, "replace") if read != "cp1252" else "".join(bytes([b]).decode("cp1252") if bytes([b]).decode("cp1252", "ignore") else chr(b) for b in text.encode(true))
    bad, restored, _ = M.repair(broken)
    assert bad and restored == text


@pytest.mark.parametrize("text", [*TEXTS, None, "", "plain", "├── src\n└── tests", "VERSÃO FINAL – AÇÃO Nº 3", "ATENÇÃO: A MIGRAÇÃO NÃO ACEITA ÍNDICES", "đường Âu Cơ, ÂM THANH", "în română: Â și Ã nu se confundă", "CHÂTEAU D’ÂPRE CÔTE", "x̲ÿ ①② ½ Ⅷ", "🚀 👩‍💻 shipped", "שלום مرحبا", "日本語の文です。", "€51 per month, ±2.0%, 4671 ms ≈ 8230 µs", "▁piece Ġbyte", "ВСЁ ЕЁ ТРЁХ «СССР»", "┌─┬─┐\n│ x │\n├─┼─┤\n└─┴─┘"])
def test_correct_text_stays(text):
    assert M.repair(text) == (False, text, True)


@pytest.mark.parametrize("true", ["euc_jp", "cp932"])
def test_japanese_as_western(true):
    text = "昨日の作業では、古い索引を再作成しました。"
    broken = "".join(bytes([b]).decode("cp1252") if bytes([b]).decode("cp1252", "ignore") else chr(b) for b in text.encode(true))
    assert M.repair(f"Elif: {broken}") == (True, f"Elif: {text}", True)


def test_cyrillic_as_western():
    broken = TEXTS[5].encode("cp1251").decode("cp1252")
    assert M.repair(broken) == (True, TEXTS[5], True)


def test_lost_characters():
    assert M.repair("Ren�e said")[0::2] == (True, False)


def test_table(spark):
    df = spark.createDataFrame([(1, "naÃ¯ve", "x"), (1, "naÃ¯ve", "x"), (2, None, "x"), (3, "", "x"), (4, "fine é", "x"), (5, "a" * 100_000 + "Ã©" * 5, "x")], "doc_id bigint, text string, restored string")
    got = {r.doc_id: (r.restored, r.whole) for r in M.repair_mojibake(df).collect()}
    assert got[1] == ("naïve", True) and set(got) == {1, 5}
    assert M.repair_mojibake(df).where("doc_id = 1").count() == 1
    assert M.repair_mojibake(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, true, read", [
    ("Então foi embora.", "cp1252", "mac_roman"), ("Das Mädchen schön gelöscht.", "cp437", "cp1252"), ("Wir hörten nichts.", "cp850", "cp1252"), ("Alles gelöscht.", "cp1252", "mac_roman"), ("Det må være sant.", "cp1252", "cp850"),
    ("Det kan være sant.", "cp1252", "cp437"), ("VÅR", "cp1252", "mac_roman"), ("Es muy fácil.", "cp1252", "mac_roman"), ("Litt smørbrød.", "cp1252", "cp850"), ("La Bucureşti.", "iso8859_2", "cp1252"),
])
def test_signs_between_letters_are_damage(text, true, read):
    damaged = text.encode(true).decode(read)
    assert damaged != text and M.repair(damaged) == (True, text, True)


def test_ambiguous_sign_is_damage():
    assert M.repair("El n·mero uno.")[0]  # á or ú, by the page


@pytest.mark.parametrize("text", ["Una col·lecció de llibres.", "Two kW·h and 3 N·m.", "Read syl·la·ble aloud.", "He said“hello”and left.", "Er sagte„Hallo“und ging.", "Wait…what?", "From A→B at 20°C, 5 µm and 3µg.", "Il dit «oui» et nº 5.", "The “quoted” word, it’s well–known."])
def test_signs_of_correct_text(text):
    assert M.repair(text) == (False, text, True)


def read_as(data, page):
    return "".join(bytes([b]).decode(page) if b < 128 or bytes([b]).decode(page, "ignore") else chr(b) for b in data)


@pytest.mark.parametrize("rounds", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("page", ["latin-1", *M.UTF8_MISREAD_AS])
def test_any_number_of_rounds(page, rounds):
    for text in TEXTS:
        broken = text
        for _ in range(rounds):
            broken = read_as(broken.encode(), page)
        assert M.repair(f"Correct beginning. {broken}") == (True, f"Correct beginning. {text}", True)


@pytest.mark.parametrize("read", ["cp1252", "latin-1"])
@pytest.mark.parametrize("true, text", [
    ("gbk", "我们今天讨论了系统的问题，但是没有得到结果。"), ("gbk", "数据库的备份在昨天晚上已经完成了，请检查。"), ("euc_kr", "안녕하세요 오늘은 서버 점검을 합니다"), ("euc_kr", "데이터베이스 백업이 완료되었습니다 확인해 주세요"),
    ("big5", "我們今天討論了系統的問題，但是沒有得到結果。"), ("euc_jp", "昨日の作業では、古い索引を再作成しました。"), ("cp932", "昨日の作業では、古い索引を再作成しました。"),
])
def test_east_asian_pages(true, text, read):
    assert M.repair(f"Elif: {read_as(text.encode(true), read)}") == (True, f"Elif: {text}", True)


@pytest.mark.parametrize("text", ["Größe", "Der Schlüssel", "Der Schlüssel ist weg und die Größe stimmt nicht."])
def test_pc_page(text):
    assert M.repair(text.encode("cp1252").decode("cp437")) == (True, text, True)


@pytest.mark.parametrize("true, text", [("gbk", "龍鳳麒麟龜鶴"), ("euc_kr", "漢字混用文"), ("iso8859_7", "καλημέρα σας, λειτουργία"), ("cp1255", "שלום לכולם, בדיקה")])
def test_what_no_page_explains_stays(true, text):
    """Damage that none of the rules reads is told, and the text is left as it came."""
    broken = read_as(text.encode(true), "latin-1")
    assert M.repair(broken) == (True, broken, False)


@pytest.mark.parametrize("seed", range(40))
def test_what_is_restored_reads_wrong_again(seed):
    """A restored text, damaged again along the same page, is the source: nothing is invented."""
    import random

    rng = random.Random(seed)
    page = rng.choice(M.UTF8_MISREAD_AS)
    text = " ".join(rng.choice(TEXTS).split()[k % 3] for k in range(6))
    broken = read_as(text.encode(), page)
    bad, restored, whole = M.repair(broken)
    if bad and whole:
        assert read_as(restored.encode(), page) == broken or restored.encode().decode() == restored and len(restored) < len(broken)
    else:
        assert restored == broken or not whole
