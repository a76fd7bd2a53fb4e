"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern, made canonical (so that one phone number or address written
in two ways is one entity), and mapped by a keyed hash to a value of the same type and format: same letters
where letters were, digits where digits were, same script, gender, country code, issuer digit
and check digit, private addresses to private ones. A person's name is mapped word by word, so
that full names, surnames alone and mentions without a title further on in the text agree. The
mapping is one table for the corpus; its surrogates are pairwise distinct and never an entity
of the corpus, which rounds of collision checks see to; where a format is used up, surrogates
grow beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

# Titles, those that tell a gender first, particles of names, the letters of the scripts, country codes, and the entity patterns.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Signor", "Sr", "Don", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Sra", "Srta", "Doña", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Doctor", "Doktor", "Docteur", "Prof", "Professor", "Professeur", "Dra", "Mx", "доктор", "профессор", "δρ")
PARTICLES = ("von", "van", "vom", "zu", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten")
SCRIPTS = {
    "latin": ("bcdfglmnprstvz", "aeiou", {"m": ("n", "r", "s", "d"), "f": ("a", "ia", "ine", "elle"), "n": ("er", "man", "ton", "eux")}),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", {"m": ("н", "р", "в", "м"), "f": ("а", "ина", "ова", "ия"), "n": ("енко", "ко", "ых", "их")}),
    "greek": ("βγδζκλμνπρστφχ", "αειου", {"m": ("ος", "ης", "ας", "ων"), "f": ("α", "η", "ια", "ου"), "n": ("ιδη", "ακη", "ου", "εα")}),
}
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
GROUP = r"[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{GROUP}:){{7}}{GROUP}|{GROUP}(?::{GROUP}){{0,5}}::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![\w:])"
CARD = r"(?<![\d+.])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\d)"
ABROAD = r"(?<![\d+])\+\d{1,3}(?:[ ./-]?\(?\d{1,5}\)?){2,5}(?!\d)"
PHONE = rf"{ABROAD}|(?<![\d+])(?:\(\d{{3}}\)[ .-]?|\d{{3}}[.-])\d{{3}}[ .-]\d{{4}}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.?"
WORD = rf"(?!{TITLE}(?!\p{{L}}))\p{{Lu}}[\p{{L}}\p{{M}}]+(?:['’-][\p{{L}}\p{{M}}]+)*"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLE}\x20)+(?:\p{{Lu}}\.\x20?)*{WORD}(?:\x20(?:(?:{'|'.join(PARTICLES)})\x20)*(?:\p{{Lu}}\.\x20)*{WORD}){{0,3}}"
PATTERN = "|".join((EMAIL, IP, IP6, CARD, SSN, PHONE, NAME))
TYPES = ("email", "ip", "card", "phone", "ssn", "name")
#: After so many attempts an entity's format counts as used up: surrogates then grow.
NARROW = 8
LOWER = "abcdefghijklmnopqrstuvwxyz"
PIECES = r"\p{L}[\p{L}\p{M}'’-]*|[^\p{L}]+"


def kind(mention: Column) -> Column:
    """Of a mention: email, ip, ip6, card, phone, ssn or name; null for sixteen digits that aren't a card's."""
    digits = F.length(_digits(mention))
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^(?:{TITLE}\x20)"), "name")
        .when(mention.rlike(rf"^{IP}$"), "ip")
        .when(mention.contains("::") | (F.length(mention) - F.length(F.replace(mention, F.lit(":"))) == 7), "ip6")
        .when(mention.rlike(rf"^{SSN}$"), "ssn")
        .when(mention.startswith("+"), F.when(digits.between(8, 15), "phone"))
        .when(digits >= 15, F.when(_valid(_digits(mention)), "card"))
        .otherwise("phone")
    )


def gender(mention: Column) -> Column:
    """f, m or n, by the titles of a name."""
    has = lambda titles: mention.rlike(rf"^(?:{TITLE}\x20)*(?:{'|'.join(titles)})\.?\x20")
    return F.when(has(FEMALE), "f").when(has(MALE), "m").otherwise("n")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _bare(word: Column) -> Column:
    """A word of a name without the genitive's ending, in lower case."""
    return F.regexp_replace(F.lower(word), "['’]s$", "")


def script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "name.cyrillic").when(word.rlike(r"\p{IsGreek}"), "name.greek").otherwise("name.latin")


def _groups(address: Column) -> Column:
    """An IPv6 address as its eight groups of four digits."""
    part = lambda i: F.filter(F.split(F.get(F.split(F.lower(address), "::"), i), ":"), lambda g: g != "")
    left, right = part(0), F.coalesce(part(1), F.array().cast("array<string>"))
    groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    return F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")


def canonical(mention: Column, of: Column) -> Column:
    phone = F.when(mention.startswith("+"), F.regexp_replace(F.concat(F.lit("+"), _digits(mention)), r"^\+1(\d{10})$", "$1")).otherwise(_digits(mention))
    return F.when(of == "email", F.lower(mention)).when(of == "ip", mention).when(of == "ip6", _groups(mention)).when(of == "phone", phone).when(of.startswith("name"), _bare(mention)).otherwise(_digits(mention))


def _byte(h: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) % 64
    return F.conv(F.substr(h, (at * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str | tuple[str, ...], b: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in letters)), (b % len(letters) + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """The check digit that makes digits plus it valid."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return ((10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _valid(digits: Column) -> Column:
    return _luhn(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1))


def surrogate(of: Column, entity: Column, sex: Column, key: str, attempt: int) -> Column:
    """The attempt-th surrogate of a canonical entity; the hash is keyed, so it can't be inverted without the key."""
    h = F.sha2(F.concat_ws("|", F.lit(key), of, entity, F.lit(str(attempt))).cast("binary"), 512)
    more = max(0, attempt - NARROW + 1)
    digit = lambda i, least=0: (_byte(h, i) % (10 - least) + least).cast("string")
    text = lambda parts: F.array_join(parts, "")
    grown = [digit(32 + k) for k in range(more)] or [F.lit("")]
    chars = F.split(entity, "")
    last = F.length(entity) - F.length(F.substring_index(entity, ".", -1))
    email = text(F.transform(chars, lambda c, i: F.when(i >= last, c).when(c.rlike("[a-z]"), F.substr(F.lit(LOWER), _byte(h, i) % 26 + 1, F.lit(1))).when(c.rlike("[0-9]"), digit(i)).otherwise(c)))
    if more:
        email = F.concat(*(F.substr(F.lit(LOWER), _byte(h, 40 + k) % 26 + 1, F.lit(1)) for k in range(more)), email)
    address = F.concat_ws(":", *(F.lower(F.lpad(F.hex(_byte(h, 2 * k) * 256 + _byte(h, 2 * k + 1)), 4, "0")) for k in range(6)))
    private = entity.rlike(r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
    octets = [_byte(h, k).cast("string") for k in range(1, 4)]
    ip = F.concat_ws(".", F.when(private, F.lit("10")).otherwise((_byte(h, 0) % 90 + 30).cast("string")), *octets)
    if more:
        ip = F.concat(F.when(private, F.lit("fd00:0000:")).otherwise(F.lit("2001:0db8:")), address)
    body = F.concat(F.substring(entity, 1, 1), text(F.transform(F.sequence(F.lit(1), F.length(entity) - 2), lambda i: digit(i))), *grown)
    card = F.concat(body, _luhn(body))
    code = F.when(entity.startswith("+"), F.length(F.regexp_extract(F.substr(entity, F.lit(2)), COUNTRY, 0)) + 1).otherwise(0)
    phone = F.concat(text(F.transform(chars, lambda c, i: F.when(i < code, c).when(i == code, digit(i, 2)).otherwise(digit(i)))), *grown)
    ssn = F.concat(text(F.transform(chars, lambda c, i: F.when(i == 0, digit(i, 1)).otherwise(digit(i)))), *grown)
    out = F.when(of == "email", email).when(of == "ip", ip).when(of == "ip6", F.concat(F.lit("2001:0db8:"), address)).when(of == "card", card).when(of == "ssn", ssn).when(of == "phone", phone)
    for name, (consonants, vowels, endings) in SCRIPTS.items():
        stem = F.concat(*(x for k in range(3 + attempt // 2) for x in (_pick(consonants, _byte(h, 2 * k)), _pick(vowels, _byte(h, 2 * k + 1)))))
        end = F.lit(None).cast("string")
        for g, choices in endings.items():
            end = F.when(sex == g, _pick(choices, _byte(h, 63))).otherwise(end)
        out = out.when(of == f"name.{name}", F.concat(stem, end))
    return out


def _cased(word: Column, replacement: Column) -> Column:
    """A name's surrogate as the word is written: shouted or not, with its genitive."""
    genitive = F.regexp_extract(word, "['’][sS]$", 0)
    shout = (F.upper(word) == word) & (F.length(word) > 1)
    return F.concat(F.when(shout, F.upper(replacement)).otherwise(F.initcap(replacement)), genitive)


def render(mention: Column, of: Column, replacement: Column) -> Column:
    """The surrogate written as the mention is: its case and punctuation."""
    chars = F.split(mention, "")
    email = F.when(F.length(mention) != F.length(replacement), replacement).otherwise(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substr(replacement, i + 1, F.lit(1)))).otherwise(F.substr(replacement, i + 1, F.lit(1)))), ""))
    own = _digits(mention)
    # a number of the American plan may be written with its country code
    fresh = F.concat(F.when((of == "phone") & mention.startswith("+") & ~replacement.startswith("+"), F.lit("1")).otherwise(F.lit("")), _digits(replacement))
    seen = lambda i: F.length(_digits(F.substr(mention, F.lit(1), i + 1)))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(fresh, seen(i), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substr(fresh, F.length(own) + 1))
    return F.when(of == "email", email).when(of.startswith("ip"), replacement).when(of.startswith("name"), _cased(mention, replacement)).otherwise(digits)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate) for distinct (type, entity) with a gender: surrogates distinct, none an entity itself.

    Each round hashes the entities that are left; of those with one surrogate the least takes
    it. A few in a million are left after the first round, and as formats grow with the rounds,
    they end. An empty table gives an empty table.
    """
    entities = common.materialize(entities, "pii-entities")
    taken = entities.select("type", F.col("entity").alias("surrogate"))
    pending, done, attempt = entities, None, 0
    while not pending.isEmpty():
        tried = pending.withColumn("surrogate", surrogate(F.col("type"), F.col("entity"), F.col("gender"), key, attempt))
        free = tried.join(taken, ["type", "surrogate"], "left_anti")
        won = common.materialize(free.groupBy("type", "surrogate").agg(F.min("entity").alias("entity")).select("type", "entity", "surrogate"), "pii-map")
        done = won if done is None else done.union(won)
        taken = taken.union(won.select("type", "surrogate"))
        pending = common.materialize(pending.join(won, ["type", "entity"], "left_anti"), "pii-pending")
        attempt += 1
    return done if done is not None else entities.select("type", "entity", F.col("entity").alias("surrogate"))


def _parts(mentions: Column) -> Column:
    """For each mention its parts in turn: a name word by word, else the whole; with the type (null: stays) and the gender."""
    words = lambda m: F.transform(F.split(m, " "), lambda w: F.struct(w.alias("part"), F.when(w.rlike(rf"^{WORD}$") & ~w.rlike(rf"^{TITLE}$"), script(w)).alias("type"), gender(m).alias("gender")))
    whole = lambda m: F.array(F.struct(m.alias("part"), kind(m).alias("type"), F.lit("n").alias("gender")))
    return F.transform(mentions, lambda m: F.when(kind(m) == "name", words(m)).otherwise(whole(m)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with entities in the text replaced, and entities map<string, int>: how many of each type.

    Null text stays null, text without entities stays as it is; a column entities gives way,
    others may have any name. Equal entities get equal surrogates wherever they are and however
    written; different ones of a type never do. In a text with a titled name, its words are
    replaced without a title as well. Rows with one text share their replacements; repeated rows
    stay. Empty in, empty out.
    """
    text = F.col(f"`{text_col}`")
    keyed = docs.select(common.row_of(docs), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    found = keyed.select("a", "b", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("mentions")).where(F.size("mentions") > 0)
    found = common.materialize(found.groupBy("a", "b").agg(F.first("mentions").alias("mentions"), F.count("*").alias("_spread_n")), "pii-mentions")
    each = found.select("a", "b", F.posexplode(_parts(F.col("mentions"))).alias("pos", "parts")).select("a", "b", "pos", F.posexplode("parts").alias("at", "p")).select("a", "b", "pos", "at", "p.*")
    each = common.materialize(each.withColumn("entity", canonical(F.col("part"), F.col("type"))), "pii-parts")
    entities = each.where("type is not null").groupBy("type", "entity").agg(F.min("gender").alias("g"), F.max("gender").alias("h"))
    names = assign(entities.select("type", "entity", F.when(F.col("g") == F.col("h"), F.col("g")).otherwise("n").alias("gender")), key)
    written = common.spread_join(each, names, ["type", "entity"], "left")
    of, fresh = F.col("type"), F.col("surrogate")
    written = written.select("a", "b", "pos", "at", "entity", of, fresh, F.when(fresh.isNull(), F.col("part")).otherwise(render(F.col("part"), of, fresh)).alias("new"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ")
    known = F.collect_set(F.when(of.startswith("name"), F.struct(F.col("entity").alias("word"), fresh.alias("to"))))
    mentions = written.groupBy("a", "b", "pos").agg(joined.alias("new"), F.max(F.substring_index(F.regexp_replace(of, "ip6", "ip"), ".", 1)).alias("type"), known.alias("known"))
    by_text = mentions.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "type"))).alias("new"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    rows = common.spread_join(keyed, by_text, ["a", "b"], "left", found.select("a", "b", "_spread_n"))
    new, people = F.col("new"), F.map_from_entries("known")

    def untitled(segment: Column) -> Column:
        """The text between mentions with the words of the names that are known in it."""
        swap = lambda w: F.coalesce(F.when(w.rlike(r"^\p{Lu}"), _cased(w, F.try_element_at(people, _bare(w)))), w)
        return F.array_join(F.transform(F.regexp_extract_all(segment, F.lit(PIECES), F.lit(0)), swap), "")

    between = F.split("text", PATTERN, -1)
    between = F.when(F.size("known") > 0, F.transform(between, untitled)).otherwise(between)
    rebuilt = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(new, i)["new"], F.lit("")))), "")
    types = F.coalesce(F.transform(new, lambda x: x["type"]), F.array().cast("array<string>"))
    counts = F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*(F.size(F.filter(types, lambda x: x == F.lit(t))) for t in TYPES)))
    fresh_text = F.when(new.isNull(), F.col("text")).otherwise(rebuilt)
    return rows.select(*((fresh_text if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() != "entities"), counts.alias("entities"))


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    out = pseudonymize(common.documents(spark, sf_dir).select("doc_id", "text"), key="tidelog")
    return out.select("doc_id", *(F.col("entities")[t].cast("long").alias(f"n_{t}") for t in TYPES), "text")
