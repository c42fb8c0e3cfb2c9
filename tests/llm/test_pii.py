import pytest

from tessella.llm import pii as P

NAMES = [f"{g} {s}{e}" for g, s in zip(["Elif", "Bram", "Inês", "Otis", "Rosa"] * 4, ["Brem", "Dosq", "Osk", "Ulv", "Lorv"] * 4) for e in ("quist", "zón", "dahl", "wick", "bré")] + ["rook-loom-bot", None, "Cher"]


@pytest.fixture(scope="module")
def people():
    return P.People(NAMES)


def spans(text, people):
    return [(k, text[a:b]) for k, a, b in P.find(text, people)]


@pytest.mark.parametrize("text, expected", [
    ("Ask Elif Bremquist today", [("name", "Elif Bremquist")]),
    ("by Dr. Bremquist, Elif on", [("name", "Bremquist, Elif")]),
    ("E. Bremquist and OTIS ULVWICK", [("name", "E. Bremquist"), ("name", "OTIS ULVWICK")]),
    ("Rosa af Lorvbré-Oskdahl, holder van der Dosqzón, Bram", [("name", "Rosa af Lorvbré-Oskdahl"), ("name", "van der Dosqzón, Bram")]),
    ("Elif K. Oskwick (QA): hi", [("name", "Elif K. Oskwick")]),
    ("Elif asked U0JRC9GSE and Team Ulv", []),
    ("mailto:a.b+c@d-e.example, x", [("email", "a.b+c@d-e.example")]),
    ("to bram19 (at) orbiq dot example or i [at] mail.corp.test", [("email", "bram19 (at) orbiq dot example"), ("email", "i [at] mail.corp.test")]),
    ("git@git.halden.example:x/y.git postgres://u:p@h.example/db @a/b@1.2.3", []),
    ("call +49 (0)30 23125 833 or (212) 555 0180 ext. 325 or 01 99 00 39 28", [("phone", "+49 (0)30 23125 833"), ("phone", "(212) 555 0180 ext. 325"), ("phone", "01 99 00 39 28")]),
    ("old 030/23125-003; +33.1.99.00.33.81; 0049 30 23125733; 020 7946 0428", [("phone", "030/23125-003"), ("phone", "+33.1.99.00.33.81"), ("phone", "0049 30 23125733"), ("phone", "020 7946 0428")]),
    ("Order 7670-370113, Part no. 944-60-2015, 10.109.115.138, 2024-10-08 12:41:52 +0530, v1.2.3", []),
    ("dial five five five, zero one two three four five six now", [("phone", "five five five, zero one two three four five six")]),
    ("passport QQ 12 34 56 C and SSN: 900-12-3456, DNI 00001234X", [("id_number", "QQ 12 34 56 C"), ("id_number", "900-12-3456"), ("id_number", "00001234X")]),
    ("at 12 Foxholt Street,\nVeldhaven before", [("address", "12 Foxholt Street,\nVeldhaven")]),
    ("to 9, rue de la Bergerie, 01064 Saint-Aubrel; Mühlbachstraße 4a is", [("address", "9, rue de la Bergerie, 01064 Saint-Aubrel"), ("address", "Mühlbachstraße 4a")]),
    ("Street of dreams, rue", []),
])
def test_found(text, expected, people):
    assert spans(text, people) == expected


def test_disguises_map_back(people):
    text = "Ｅlif​ Bremquist, bram＠orbiq.example, оtis@nimvora.test end"
    got = spans(text, people)
    assert ("email", "bram＠orbiq.example") in got and ("email", "оtis@nimvora.test") in got and ("name", "Ｅlif​ Bremquist") in got
    assert P.redact(text, P.find(text, people)) == "[NAME], [EMAIL], [EMAIL] end"


def test_table(spark):
    users = spark.createDataFrame([(n, 1) for n in NAMES + NAMES[:3]], "name string, id int")
    data = [("records", "1", "Elif Bremquist, +19375550174", "x"), ("records", "1", "Elif Bremquist, +19375550174", "x"), ("records", "2", None, "x"), ("chunks", "3", "", "x"), ("chunks", "4", "  ", "x"), ("chunks", "5", "word " * 50_000 + "Rosa Lorvbré", "x")]
    df = spark.createDataFrame(data, "tbl string, rec_id string, content string, kind string")
    assert {tuple(r)[:4] for r in P.find_personal_data(df, users).collect()} == {("records", "1", "name", 0), ("records", "1", "phone", 16), ("chunks", "5", "name", 250_000)}
    assert P.find_personal_data(df, users).count() == 3
    got = {r.rec_id: r.replaced for r in P.replace_personal_data(df, users).collect()}
    assert got["1"] == "[NAME], [PHONE]" and got["2"] is None and got["3"] == ""
    assert P.find_personal_data(df.limit(0), users).count() == 0
    assert {r.kind for r in P.find_personal_data(df, users.limit(0)).collect()} == {"phone"}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "PARTS", 2)
        with pytest.raises(ValueError):
            P.people_of(users)
    many = spark.range(300_000).selectExpr("concat('Elif Brem', substr('quistdahlwick', 1 + id % 9, 4)) AS name")
    assert P.people_of(many).given == ["Elif"], "more people than parts"


@pytest.mark.parametrize("text, expected", [
    ("ask Wei Zhang and Priya Natarajan", ["Wei Zhang", "Priya Natarajan"]), ("by José García-Pérez, Omar van der Berg", ["José García-Pérez", "Omar van der Berg"]),
    ("Wei Team, Omar Is here, Ivan THE", []), ("Rue de Rivoli 12, Paris", ["Rue de Rivoli 12, Paris"]), ("to Kungsgatan 12 now", ["Kungsgatan 12"]), ("Keizersgracht 101 b", ["Keizersgracht 101 b"]), ("Nørregade 7, Odense", ["Nørregade 7, Odense"]),
])
def test_beyond_the_table(text, expected, people):
    assert [t for _, t in spans(text, people)] == expected


@pytest.mark.parametrize("n", [10, 60, 75, 300, 5000])
def test_long_addresses(n, people):
    """No address is cut for its length, nor for that of the word it stands in."""
    local = "ab." * (n // 3) + "c"
    assert spans(f"to {local}@orbiq.example now", people) == [("email", f"{local}@orbiq.example")]
    dotted = " dot ".join(["ab"] * (n // 6 + 1))
    assert spans(f"to {dotted} [at] orbiq dot example", people)[0][0] == "email" and spans(f"to: {dotted} [at] orbiq dot example", people)[0][1].startswith("ab")
    assert spans("https://" + "x" * n + ":y@orbiq.example", people) == []
    assert spans("x" * n + ",bram@orbiq.example", people) == [("email", "bram@orbiq.example")]


def test_many_values_in_one_text(people):
    import time

    began = time.monotonic()
    text = "Elif Bremquist bram@orbiq.example,+19375550174; " * 8000
    assert len(P.find(text, people)) == 24000 and len(P.find("a@b.example," * 20_000, people)) == 20_000
    assert time.monotonic() - began < 60
