import re

import pytest

from driftwell.llm import pii as P

TEXTS = [
    "Mail er.34@mail7.example.com or ER.34@MAIL7.example.com, +1 (017) 555-7713; +1 017 555 7713. Card 4929348385146306, "
    "4929-3483-8514-6306, ip 233.254.104.120.",
    "Mr. John Smith met Mrs. Ann Smith and Herr Müller. DE89 3704 0044 0532 0130 00 ssn 123-45-6789 4539578763621486",
    "er.34@mail7.example.com again, Mr Smith, Господин Иванов, Señora García",
    "clean text 12 and 2024-01-02, version 1.2.3, 10:30, 3.14159, $5,000", "", None, "555-123-4567",
]


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return [r for r in P.pii_rows(df).orderBy("doc_id").collect()]


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits))) % 10


def test_nothing_private_is_left(out):
    text = " ".join(r.text or "" for r in out)
    for private in ("er.34", "mail7", "555-7713", "555 7713", "4929348385146306", "4929-3483", "233.254", "John", "Smith", "Ann ",
                    "Müller", "3704", "123-45", "Иванов", "García", "555-123"):
        assert private not in text
    assert (out[3].text, out[4].text, out[5].text) == (TEXTS[3], "", None)


def test_same_entity_same_surrogate_in_its_own_layout(out):
    a, b = re.findall(r"\S+@\S+\.example", out[0].text, re.I)
    local, _, host = a.partition("@")
    assert b == f"{local.upper()}@{host}" and a in out[2].text and re.fullmatch(r"[a-z]{2}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.example", a)
    p, q = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1 \d{3} \d{3} \d{4}", out[0].text)
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q)
    c, d = re.search(r"Card (\d{16}), ([\d-]{19})", out[0].text).groups()
    assert c == d.replace("-", "") and c[0] == "4" and luhn(c) == luhn("4929348385146306")
    assert luhn("4539578763621486") == 0 == luhn(re.search(r"\d{16}", out[1].text)[0])


def test_names_keep_gender_script_and_surname(out):
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+) and Herr (\w+)\.", out[1].text)
    assert m[1] in P.GIVEN["m", "latin"] and m[3] in P.GIVEN["f", "latin"] and m[2] == m[4] != m[5]
    assert f"Mr {m[2]}," in out[2].text and re.search(r"Господин [А-Я][а-я]+,", out[2].text)


def test_account_numbers_stay_valid(out):
    iban = re.search(r"DE\d\d( \d{4}){4} \d\d", out[1].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_counts(out):
    assert (out[0].n_email, out[0].n_phone, out[0].n_card, out[0].n_ip) == (2, 2, 2, 1)
    assert (out[1].n_name, out[1].n_iban, out[1].n_ssn, out[2].n_name) == (3, 1, 1, 3)
    assert sum(out[3][f"n_{k}"] for k in P.KINDS) == 0


def test_collisions_are_resolved(spark, monkeypatch):
    """All short phone numbers: every surrogate space is far too small to be lucky."""
    texts = [f"call {a}-{a}-{b:04}" for a in (212, 415) for b in range(0, 10000, 7)]
    mails = [f"{a}{b}@x.example.org" for a in "abcdefghij" for b in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + mails)], "doc_id long, text string")
    for inline in (10**6, 0):  # written into the plan, or joined
        monkeypatch.setattr(P, "INLINE", inline)
        rows = {r.doc_id: r.text for r in P.pii_rows(df).collect()}
        assert len(rows) == len(set(rows.values())) == len(texts + mails)
        assert not set(rows.values()) & set(texts + mails)
        if inline:
            first = rows
    assert rows == first


LEAKS = [
    ("Herr Hans Peter Müller kam", "name", "Hans Peter Müller"), ("met Ms. Anna-Maria Schmidt.", "name", "Anna Maria Schmidt"),
    ("Mr. O'Brien's car", "name", "O'Brien"), ("MR. JOHN SMITH", "name", "JOHN SMITH"), ("Frau von der Leyen sagte", "name", "Leyen"),
    ("Mr. J. R. Smith and", "name", "Smith"), ("Herr Dr. Weber", "name", "Weber"), ("Mme d'Artagnan", "name", "Artagnan"),
    ("call +14155552671 now", "phone", "4155552671"), ("+4915112345678", "phone", "4915112345678"), ("+4930 1234567", "phone", "1234567"),
    ("call 415 555 2671", "phone", "555 2671"), ("Tel. 030 1234567.", "phone", "1234567"), ("01 23 45 67 89", "phone", "45 67 89"),
    ("card 3782 822463 10005", "card", "822463 10005"), ("3782-822463-10005", "card", "822463 10005"),
    ("an müller@straße.example.org", "email", "ü ß ller"), ("иван@почта.рф", "email", "иван почта рф"),
]


def test_whole_entities_go(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(LEAKS)], "doc_id long, text string")
    for r in P.pii_rows(df).collect():
        text, kind, private = LEAKS[r.doc_id]
        assert [k for k in P.KINDS if r[f"n_{k}"]] == [kind] and r[f"n_{kind}"] == 1, (text, r)
        assert not [x for x in private.split() if x in r.text], (text, r.text)


def test_capitals_are_the_same_name_and_what_is_no_entity_stays(spark):
    clean = ["05-2024 and 1 000 000, 12 345 6789", "MS Office, Miss the bus", "2+2 = 4, pi 3.14159265", "Mr. and Mrs.", "000 and 0.123 45"]
    df = spark.createDataFrame(list(enumerate(["Mr. John Smith, MR. JOHN SMITH, Mr. Smith's", *clean])), "doc_id long, text string")
    first, *rest = [r.text for r in P.pii_rows(df).orderBy("doc_id").collect()]
    m = re.fullmatch(r"Mr\. (\w+ (\w+)), MR\. (\w+ \w+), Mr\. (\w+)'s", first)
    assert m[1].upper() == m[3] and m[2] == m[4] and rest == clean


def test_another_key_gives_other_surrogates(spark):
    df = spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string")
    assert P.pii_rows(df, "other").first().text != P.pii_rows(df).first().text == P.pii_rows(df).first().text


def test_native(spark, docs):
    assert "Python" not in P.pii_rows(docs)._jdf.queryExecution().toString()
