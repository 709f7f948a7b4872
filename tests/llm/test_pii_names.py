"""One surname, one surrogate; scripts; mentions; the rounds against a plain model."""

import re

import pytest

from driftwell.llm import pii as P


def texts_of(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in P.pii_rows(df, **more).orderBy("doc_id").collect()]


def code(n):
    """A surname of its own for every number."""
    return "Q" + "".join("abcdefghij"[int(d)] for d in str(n)) + "x"


@pytest.mark.parametrize("n", [100_000])
def test_surnames_keep_together_however_many(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", f"concat('Q', translate(cast(id AS string), '0123456789', 'abcdefghij'), 'x') AS s")
    df = df.selectExpr("doc_id", "concat('Mr ', s, ' met Mr John ', s, ' and Dr. ', s) AS text")
    got = P.pii_rows(df).select("text").collect()
    found = [re.fullmatch(r"Mr (\S+) met Mr (\S+) (\S+) and Dr\. (\S+)", r.text) for r in got]
    assert all(m and m[1] == m[3] == m[4] for m in found)
    assert len({m[1] for m in found}) == n and len({m[2] for m in found}) == 1
    assert not {m[1] for m in found} & {code(i) for i in range(n)}


def test_given_names_are_distinct_and_their_own_entity(spark):
    names = [f"{a}{b}o" for a in "BCDFGHJKLM" for b in "aeiou"]
    out = texts_of(spark, [f"Mr {x} Smith and Mr {x} Jones" for x in names])
    pairs = [re.fullmatch(r"Mr (\S+) (\S+) and Mr (\S+) (\S+)", t).groups() for t in out]
    assert all(a == c for a, _, c, _ in pairs) and len({a for a, *_ in pairs}) == len(names)
    assert len({b for _, b, *_ in pairs}) == 1 and len({d for *_, d in pairs}) == 1


SCRIPTS = [
    ("Mr Παπαδόπουλος", "Greek"), ("Κύριος Νίκος Παπάς", "Greek"), ("Mr Иванов", "Cyrillic"), ("Mr 王小明", "Han"), ("Mrs 김영희", "Hangul"),
    ("Mr たなか", "Hiragana"), ("Mr タナカ", "Katakana"), ("Mr אברהם", "Hebrew"), ("السيد محمد", "Arabic"), ("Mr शर्मा", "Devanagari"),
]


def test_scripts_stay(spark):
    import unicodedata

    out = texts_of(spark, [f"{t}." for t, _ in SCRIPTS])
    for (text, script), new in zip(SCRIPTS, out, strict=True):
        title, name = new.rstrip(".").split(" ", 1)
        assert title == text.split(" ")[0] and name != text.split(" ", 1)[1], new
        known = {"Han": "CJK"}.get(script, script).upper()
        assert all(unicodedata.name(c).startswith(known) for c in name if unicodedata.category(c).startswith("L")), new


def test_titles_and_mentions(spark):
    out = texts_of(spark, ["Dr. Weber came. Weber's car, Weberei, WEBER and weber. Herr Prof. Dr. Weber left, Frau Eva von Weber too.", "Weber alone"])
    m = re.fullmatch(
        r"Dr\. (\S+) came\. (\S+)'s car, Weberei, WEBER and weber\. Herr Prof\. Dr\. (\S+) left, Frau (\S+) (\S+) too\.", out[0])
    assert m and m[1] == m[2] == m[3] == m[5] != "Weber" and out[1] == "Weber alone"
    assert texts_of(spark, ["Drive 3 Dr Weber", "Professor of law", "Dr. of"])[1:] == ["Professor of law", "Dr. of"]


def test_the_session_names_the_key(spark):
    text = ["Mr Smith, a@b.example.org"]
    first = texts_of(spark, text)
    spark.conf.set(P.KEY_SETTING, "another")
    assert texts_of(spark, text) != first and texts_of(spark, text) == texts_of(spark, text, key="another")
    spark.conf.unset(P.KEY_SETTING)
    assert texts_of(spark, text) == first


def test_rounds_as_a_plain_model(spark):
    """Attempts are given out as a loop over all entities says."""
    entities = [("phone", f"{n:03}") for n in range(0, 300, 2)] + [("surname", code(i).lower()) for i in range(50)]
    df = spark.createDataFrame(entities, "kind string, norm string")
    made = {}

    def surrogates(attempts):
        ask = [(k, n, a) for (k, n), a in attempts.items() if (k, n, a) not in made]
        if ask:
            rows = spark.createDataFrame(ask, "kind string, norm string, attempt int")
            rows = rows.withColumn("s", P.surrogate(rows.kind, rows.norm, rows.attempt, "k"))
            made.update({(r.kind, r.norm, r.attempt): r.s for r in rows.collect()})
        return {(k, n): made[k, n, a] for (k, n), a in attempts.items()}

    attempts = dict.fromkeys(entities, 0)
    while True:
        held, again = {}, []
        now = surrogates(attempts)
        for (k, n), a in sorted(attempts.items(), key=lambda x: (x[1], x[0][1])):
            s = now[k, n]
            if (k, s) in attempts or (k, s) in held:
                again.append((k, n))
            held.setdefault((k, s), n)
        if not again:
            break
        for e in again:
            attempts[e] += 1
    got = {(r.kind, r.norm): (r.attempt, r.surrogate) for r in P.resolve(df, "k").collect()}
    assert got == {e: (a, now[e]) for e, a in attempts.items()}
    assert max(attempts.values()) > 0 and len(set(now.values())) == len(entities)
