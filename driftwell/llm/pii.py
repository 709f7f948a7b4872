"""Keyed surrogates for personal data, as DataFrame expressions.

A text is split at the entities one pattern finds; each entity is replaced by a
surrogate of its kind derived from a keyed digest of its normal form. The same
entity therefore gets the same surrogate everywhere, in any spelling, and the
original's layout (digit groups, letter case, title, script) is kept.

A person's name is two entities, the surname and the given names with their
gender, so that "Mr X" and "Mr John X" share a surname whatever else happens;
where a document has a titled name, the surname alone is replaced there too.

Distinctness is checked, not hoped for: the distinct entities of all documents
get their surrogates, and those whose surrogate belongs to another entity, or
is itself an entity of the documents, move to their next attempt until none is
left. Only entities on a later attempt need a lookup while texts are rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, packed_row, written

KEY = "driftwell-demonstration-key"
#: The setting of a session that names its key; without it the demonstration key above is used.
KEY_SETTING = "spark.driftwell.surrogate.key"
#: Entities on a later attempt that may be written into the plan; more are joined.
INLINE = 1000
ROUNDS = 40

# Titles by gender, given names by gender and script, and syllables by script.
# In capitals, MS is a title only with its full stop.
MALE_TITLES = "Mr|Mister|Herr|Herrn|Monsieur|Señor|Sr|Signor|Господин|Κύριος|Κύριο|السيد|MR|MISTER|HERR|MONSIEUR|SEÑOR|SR|SIGNOR|ГОСПОДИН"
FEMALE_TITLES = (
    "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Госпожа|Κυρία|السيدة|MRS|MS(?=\\.)|MISS|FRAU|MADAME|MME|SEÑORA|SRA|SIGNORA|ГОСПОЖА"
)
#: Say nothing about gender; alone they count with a full stop or in full, as others' abbreviations are common.
OTHER_TITLES = "Dr(?=\\.)|Prof(?=\\.)|Professor|Doctor|Доктор|Профессор"
PARTICLES = "von|van|vom|zu|zum|zur|der|den|dem|de|del|della|dello|degli|di|da|das|do|dos|du|des|la|las|le|los|ter|ten|af|av|bin|ibn|ben|abu|al|el"
GIVEN = {
    ("m", "latin"): "Adrian Bruno Caspar Dario Emil Fabian Gregor Hugo Ivo Jonas Kilian Leon Marius Nils Oscar Pascal".split(),
    ("f", "latin"): "Alma Berta Clara Daria Elena Fiona Greta Helena Irma Jana Karla Lena Mira Nora Olivia Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Назар Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Алла Берта Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лариса Мария Нина Ольга Полина Раиса".split(),
}
SYLLABLES = {
    "cyrillic": "бар вел гор дан жел зор кал лин мар нов пол рас сол тур фед чер".split(),
    "greek": "βα γε δι ζο κα λε μι νο πα ρε σι το φα χε ψι θο".split(),
    "arabic": "با تا جا حا دا را زا سا شا صا عا فا قا كا لا ما".split(),
    "hebrew": "בא גד דו הר זי חן טל ים כר לב מי נו סע פז רם שי".split(),
    "devanagari": "का गा चा जा टा ता दा ना पा बा मा रा ला वा सा हा".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 차 카 타 파 하 고 노".split(),
    "han": "林 陈 周 吴 郑 冯 蒋 沈 韩 杨 朱 秦 许 何 吕 张".split(),
    "hiragana": "か さ た な は ま や ら わ き し ち に ひ み り".split(),
    "katakana": "カ サ タ ナ ハ マ ヤ ラ ワ キ シ チ ニ ヒ ミ リ".split(),
    "latin": "bar cor den fal gar hol jen kel lin mor nov pel ras sil tor ven".split(),
}
#: Male and female endings of given names that are made of syllables.
ENDINGS = {"latin": ("o", "a"), "cyrillic": ("ий", "ия"), "greek": ("ς", "α")}

# Patterns of entities.
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63})+"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IPV4 = r"(?<!\d)(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
GROUPED_CARD = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}"
CARD = rf"(?<!\d)(?:\d{{13,19}}|{GROUPED_CARD})(?!\d)"
# After a plus sign any grouping of 7 to 15 digits; with an area code; and national layouts.
PHONE = "|".join(
    (
        r"(?<!\d)\+\d(?:[ ./-]?\(?\d\)?){6,14}(?!\d)",
        r"(?:\+\d{1,3}[ .-]?|(?<!\d))(?:\(\d{1,5}\)|(?<=\+\d[ .-]|\+\d\d[ .-]|\+\d\d\d[ .-])\d{1,5}|(?<!\d)\d{3}(?=[.-]\d{3}[.-]))(?:[ .-]?\d{2,5}){2,4}(?!\d)",
        r"(?<![\d.,])(?<!\d[ -])(?:\d{3} \d{3}[ -]\d{4}|0\d{2,4}[ /-]\d{5,9}|0\d{2,4}(?:[ /-]\d{2,5}){2,4}|0\d(?:[ .-]\d\d){4})(?!\d)",
    )
)
# A name word may have initials before it, hyphens and apostrophes inside (but not a possessive s), particles in front.
NAME_WORD = r"\p{Lu}(?:['’](?!s(?!\p{L}))\p{L}|[\p{L}\p{M}])[\p{L}\p{M}]*(?:(?:-|['’](?!s(?!\p{L})))\p{L}[\p{L}\p{M}]*)*"
# Letters without case tell no name from other words: the word after the title, two where words are spaced.
PLAIN_NAME = r"(?:\p{IsHan}{2,4}|[\p{IsHiragana}\p{IsKatakana}]{2,8}|\p{IsHangul}{2,4}|(?:(?!\p{IsHan}|\p{IsHiragana}|\p{IsKatakana}|\p{IsHangul})\p{Lo})[\p{Lo}\p{M}]+(?: [\p{Lo}][\p{Lo}\p{M}]+)?)"
NAME_PART = rf"(?:(?:\p{{Lu}}\.[ -]?|(?:Dr|Prof|St)\. )*(?:(?:{PARTICLES}) )*(?:(?:[dl]['’]|(?:al|el)-)?{NAME_WORD}))"
TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES}"
NAME = rf"(?<!\p{{L}})(?:{TITLES})\.? (?:{NAME_PART}(?: {NAME_PART})*|{PLAIN_NAME})"
#: The titles a name begins with; they stay.
PREFIX = rf"^(?:(?:{TITLES}|Dr|Prof)\.? )+"
ENTITY = "|".join((EMAIL, IBAN, IPV4, SSN, CARD, PHONE, NAME))
#: A text without any of these holds no entity.
HINT = rf"@|\d[-./)]?[ -]?\(?\d|(?:{TITLES})\.? \p{{L}}"
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "name")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; expressions would otherwise repeat it wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def kind_of(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(rf"^(?:\d{{13,19}}|{GROUPED_CARD})$"), "card")
        .when(m.rlike(r"^[+(\d]"), "phone")
        .otherwise("name")
    )


def normal_form(m: Column, kind: Column) -> Column:
    """What all spellings of one entity share; of a name the words without titles and particles."""
    words = F.split(F.lower(F.regexp_replace(m, PREFIX, "")), " ")
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.array_join(F.filter(words, lambda w: ~w.isin(*PARTICLES.split("|"))), " "))
        .otherwise(F.regexp_replace(m, r"(?!^\+)\D", ""))
    )


def gender_of(m: Column) -> Column:
    titles = F.regexp_extract(m, PREFIX, 0)
    return F.when(titles.rlike(rf"(?:^| )(?:{FEMALE_TITLES})[. ]"), "f").when(titles.rlike(rf"(?:^| )(?:{MALE_TITLES})[. ]"), "m").otherwise("n")


def parts_of(m: Column, kind: Column) -> Column:
    """The entities (kind, norm) of a match: a name's surname and, if there are any, its given names with their gender."""

    def of(norm: Column) -> Column:
        part = lambda k, n: F.struct(k.alias("kind"), n.alias("norm"))
        given = F.regexp_replace(norm, r" ?\S+$", "")
        both = F.array(part(F.lit("surname"), F.substring_index(norm, " ", -1)), part(F.lit("given"), F.concat_ws(" ", gender_of(m), given)))
        return F.when(kind != "name", F.array(part(kind, norm))).when(given == "", F.slice(both, 1, 1)).otherwise(both)

    return let(normal_form(m, kind), of)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _digits(digest: Column) -> Column:
    return F.translate(digest, "abcdef", "047158")


def _letters(digest: Column) -> Column:
    return F.translate(digest, "0123456789", "ghijkmnpqr")


def _masked(text: Column, digest: Column) -> Column:
    """Digits and letters replaced one for one, everything else kept; position by position."""
    doubled = F.concat(digest, F.reverse(digest))
    streams = F.struct(_digits(doubled).alias("d"), _letters(doubled).alias("l"))

    def swapped(stream: Column) -> Column:
        letter = lambda i: F.substring(stream["l"], i % 128 + 1, F.lit(1))
        return F.transform(
            F.split(text, ""),
            lambda c, i: F.when(c.rlike(r"^\d$"), F.substring(stream["d"], i % 128 + 1, F.lit(1)))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(letter(i)))
            .when(c.rlike(r"^[\p{L}\p{M}]$"), letter(i))
            .when(c.rlike(r"^\p{N}$"), F.substring(stream["d"], i % 128 + 1, F.lit(1)))
            .otherwise(c),
        )

    return F.array_join(let(streams, swapped), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo ten; the last digit counts singly."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int"))
        ),
    ) % F.lit(10)


def _card(norm: Column, digest: Column) -> Column:
    """Issuer digit and Luhn remainder kept, so valid numbers stay valid."""
    n = F.length(norm)
    made = F.concat(F.substring(norm, 1, 1), F.substring(_digits(digest), F.lit(1), n - 2))
    last = lambda body: F.pmod(_luhn(norm) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return let(made, lambda body: F.concat(body, last(body).cast("string")))


def _iban(norm: Column, digest: Column) -> Column:
    """Country kept, account masked, check digits computed for it."""
    country = F.substring(norm, 1, 2)

    def checked(account: Column) -> Column:
        rest = F.aggregate(
            F.split(F.concat(account, country, F.lit("00")), ""),
            F.lit(0),
            lambda s, c: F.when(c == "", s)
            .when(c.rlike(r"\d"), (s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97)
            .otherwise((s * 100 + F.ascii(c) - 55) % 97),
        )
        return F.concat(country, F.lpad((F.lit(98) - rest).cast("string"), 2, "0"), account)

    return let(_masked(F.substring(norm, F.lit(5), F.length(norm) - 4), digest), checked)


def _at(values: Column, n: int, digest: Column, place: int) -> Column:
    """One of ``n`` values by two digits of the digest."""
    return F.get(values, F.conv(F.substring(digest, place, 2), 16, 10).cast("int") % n)


def _by_script(text: Column, table: dict[str, list[str]], other: Column) -> Column:
    """The list of the script that ``text`` has letters of."""
    out = other
    for script, values in reversed(table.items()):
        if script != "latin":
            out = F.when(text.rlike(rf"\p{{Is{script.capitalize()}}}"), F.array(*map(F.lit, values))).otherwise(out)
    return out


def _spelled(text: Column, body) -> Column:
    """``body`` of a function that makes a run of syllables in the script of ``text``; Latin for any that is not listed."""
    latin = F.array(*map(F.lit, SYLLABLES["latin"]))
    return let(
        _by_script(text, SYLLABLES, latin),
        lambda s: body(lambda digest, *at: F.concat(*[_at(s, 16, digest, a) for a in at])),
    )


def _surname(norm: Column, attempt: Column, digest: Column) -> Column:
    """Four syllables; from the second attempt on ten, which makes 2^40 names of each script."""
    return _spelled(norm, lambda run: F.concat(
        run(digest, 1, 3, 5, 7), F.when(attempt > 0, F.concat(F.lit("-"), run(digest, 9, 11, 13, 15, 17, 19))).otherwise("")
    ))


def _given(norm: Column, attempt: Column, digest: Column) -> Column:
    """A listed name of the gender; later made of syllables, three and then eight."""
    known, given = F.substring(norm, 1, 1), F.substring(norm, F.lit(3), F.length(norm))
    man = F.when(known == "n", F.substring(digest, 40, 1) < "8").otherwise(known == "m")
    none = F.array(F.lit(""), F.lit(""))
    ending = _by_script(given, {k: list(v) for k, v in ENDINGS.items()}, F.when(given.rlike(r"\p{IsLatin}"), F.array(*map(F.lit, ENDINGS["latin"]))).otherwise(none))

    def listed(gender: str) -> Column:
        cased = {k: [x.lower() for x in v] for (g, k), v in GIVEN.items() if g == gender}
        return _by_script(given, cased, F.when(given.rlike(r"\p{IsLatin}"), F.array(*map(F.lit, cased["latin"]))))

    names = F.when(man, listed("m")).otherwise(listed("f"))
    built = _spelled(given, lambda run: F.concat(run(digest, 9, 11, 13), F.when(attempt > 1, run(digest, 15, 17, 19, 21, 23)).otherwise("")))
    made = F.concat(built, F.get(ending, F.when(man, 0).otherwise(1)))
    return F.concat_ws(" ", known, F.coalesce(F.when(attempt == 0, _at(names, 16, digest, 1)), made))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normal form for an entity's normal form and attempt."""
    local, host = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)

    def made(digest: Column) -> Column:
        more = F.when(attempt > 0, F.substring(_digits(digest), 33, 6)).otherwise("")
        email = F.concat(
            _masked(local, digest), more, F.lit("@"),
            _masked(F.regexp_replace(host, r"\.[^.]*$", ""), _digest(key, F.lit("host"), host)), F.lit(".example"),
        )
        octet = lambda i: (F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("int") % 254 + 1).cast("string")
        return (
            F.when(kind == "email", email)
            .when(kind == "iban", _iban(norm, digest))
            .when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)]))
            .when(kind == "card", _card(norm, digest))
            .when(kind == "surname", _surname(norm, attempt, digest))
            .when(kind == "given", _given(norm, attempt, digest))
            # An international number keeps its zone digit, whatever its spelling.
            .when(norm.startswith("+"), F.concat(F.substring(norm, 1, 2), F.substring(_digits(digest), F.lit(1), F.length(norm) - 2)))
            .otherwise(F.substring(_digits(digest), F.lit(1), F.length(norm)))
        )

    return let(_digest(key, kind, norm, attempt.cast("string")), made)


def titled(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def laid_out(m: Column, kind: Column, found: Column) -> Column:
    """The surrogate in the layout of the text it replaces."""
    name = F.regexp_replace(m, PREFIX, "")
    local, new_local, new_host = F.substring_index(m, "@", 1), F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    signless = F.ltrim(found, F.lit("+"))
    spaced = F.aggregate(
        F.filter(F.split(m, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("i")),
        lambda a, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct(F.concat(a["s"], F.substring(signless, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i"))),
        lambda a: a["s"],
    )
    return (
        F.when(kind == "email", F.concat(F.when(local == F.upper(local), F.upper(new_local)).otherwise(new_local), F.lit("@"), new_host))
        .when(kind == "ip", found)
        .when(kind == "name", F.concat(F.regexp_extract(m, PREFIX, 0), F.when(name == F.upper(name), F.upper(found)).otherwise(found)))
        .otherwise(spaced)
    )


def _collisions(named: DataFrame) -> DataFrame:
    """Entities whose surrogate another one keeps, or that is an entity itself."""
    originals = named.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("taken"))
    order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "norm")
    told = named.withColumn("nth", F.row_number().over(order)).join(originals, ["kind", "surrogate"], "left")
    return told.filter((F.col("nth") > 1) | F.col("taken"))


def resolve(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind``, ``norm``, ``attempt``, ``surrogate``: distinct surrogates for distinct entities."""
    first = entities.withColumn("attempt", F.lit(0))
    with_surrogate = lambda df: df.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
    named = written(with_surrogate(first), "entities")
    for _ in range(ROUNDS):
        again = written(_collisions(named).select("kind", "norm"), "collisions")
        if again.isEmpty():
            forget(again)
            return named
        moved = named.join(again.withColumn("moves", F.lit(1)), ["kind", "norm"], "left")
        moved = moved.withColumn("attempt", F.col("attempt") + F.coalesce(F.col("moves"), F.lit(0))).drop("moves")
        before, named = named, written(with_surrogate(moved.drop("surrogate")), "entities")
        forget(before, again)
    raise RuntimeError(f"surrogates still collide after {ROUNDS} attempts: a kind has more entities than surrogates")


def secret_key(docs: DataFrame, key: str | None) -> str:
    return key or docs.sparkSession.conf.get(KEY_SETTING, KEY)


def replace_entities(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and a count of entities by kind in ``pii``.

    ``key`` is the session's setting ``KEY_SETTING`` unless given. All other
    columns stay as they are (a column named ``pii`` is replaced); rows and
    their order inside a partition too. Null texts stay null, empty ones empty;
    entities repeated in or across rows get one surrogate; an empty table gives
    no rows. A surname that stands alone in a document that also has it with a
    title is replaced too (three letters at least, in the same spelling); such
    mentions are not counted.
    """
    key = secret_key(docs, key)
    rows = docs.select(packed_row(docs), F.col("text").cast("string").alias("text"))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    described = F.transform(matches(F.col("text")), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    parts = lambda e: parts_of(e["m"], e["kind"])
    entities = (
        rows.filter(hinted)
        .select(F.explode(described).alias("e"))
        .select(F.explode(parts(F.col("e"))).alias("p"))
        .select("p.kind", "p.norm")
        .distinct()
    )
    resolved = resolve(entities, key)
    later = written(resolved.filter("attempt > 0").select("kind", "norm", "attempt"), "attempts")
    forget(resolved)
    n = later.count()
    marked = rows.withColumn("found", F.when(hinted, described))
    if not n:
        marked = marked.withColumn("later", F.lit(None).cast("map<string,int>"))
    elif n <= INLINE:
        known = [F.lit(x) for r in later.collect() for x in (f"{r['kind']}|{r['norm']}", r["attempt"])]
        marked = marked.withColumn("later", F.create_map(*known))
    else:
        # Texts with the same entities share a key, so no row identity is needed; texts without any are spread by their own.
        key_of = F.when(F.size("found") > 0, F.md5(F.to_json("found"))).otherwise(F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))
        told = marked.withColumn("key", key_of)
        per_key = (
            told.filter(F.size("found") > 0)
            .select("key", F.explode("found").alias("e"))
            .select("key", F.explode(parts(F.col("e"))).alias("p"))
            .select("key", "p.kind", "p.norm")
            .distinct()
            .join(later, ["kind", "norm"])
            .groupBy("key")
            .agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("later"))
        )
        marked = told.join(per_key, "key", "left")

    def made(part: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("later", F.concat_ws("|", part["kind"], part["norm"])), F.lit(0))
        return let(attempt, lambda n: surrogate(part["kind"], part["norm"], n, key))

    def replaced(e: Column) -> Column:
        """The new text, and of a name the surname it had and has."""

        def of(new: Column) -> Column:
            first, given = F.get(new, F.lit(0)), F.get(new, F.lit(1))
            name = F.concat_ws(" ", titled(F.substring(given, F.lit(3), F.length(given))), titled(first))
            whole = F.when(e["kind"] == "name", name).otherwise(first)
            old = F.when(e["kind"] == "name", F.substring_index(e["m"], " ", -1))
            return let(whole, lambda w: F.struct(laid_out(e["m"], e["kind"], w).alias("b"), old.alias("old"), titled(first).alias("new")))

        return let(F.transform(parts(e), made), of)

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda e: e["kind"] == kind)), F.lit(0))

    def mentions_replaced(between: Column) -> Column:
        names = F.filter("made", lambda e: F.length(e["old"]) >= 3)
        alone = lambda e: F.concat(F.lit(r"(?<![\p{L}\p{M}])"), e["old"], F.lit(r"(?![\p{L}\p{M}])"))
        done = F.aggregate(names, between, lambda t, e: F.regexp_replace(t, alone(e), F.when(e["old"] == F.upper(e["old"]), F.upper(e["new"])).otherwise(e["new"])))
        return F.when(F.size(names) > 0, done).otherwise(between)

    marked = marked.withColumn("made", F.transform("found", replaced))
    rebuilt = F.array_join(
        F.transform(
            F.arrays_zip(F.split("text", ENTITY, -1).alias("a"), F.col("made").alias("b")),
            lambda z: F.concat(mentions_replaced(z["a"]), F.coalesce(z["b"]["b"], F.lit(""))),
        ),
        "",
    )
    text = F.when(F.size("found") > 0, rebuilt).otherwise(F.col("text")).alias("text")
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[of_kind(k) for k in KINDS]))
    kept = [text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "pii"]
    return marked.select(*kept, counts.alias("pii"))


def pii_rows(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the rewritten text and the number of entities of each kind."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = replace_entities(source, key)
    return out.select("doc_id", "text", *[F.col("pii")[k].cast("long").alias(f"n_{k}") for k in KINDS])
