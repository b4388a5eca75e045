r"""Personal data replaced by surrogates (operator 3), with DataFrame functions only.

Entities are e-mail addresses, phone numbers, payment cards and other runs of 13 to 19 digits, bank accounts, social
security numbers, IP addresses and names after a form of address. Each distinct entity of the corpus gets one
surrogate from a keyed hash of its normal form, so all its mentions, however written, change in the same way.
A surrogate keeps type and format: letters stay letters and digits digits, separators stay where they are, a
number that passes the Luhn test passes it again, addresses stay addresses, names keep their number of
words, script and case, and first names the gender of the form of address. A name that a form of address has
introduced is replaced wherever the same text repeats it; a last name alone changes to the last word of its full
name's surrogate. Phone numbers keep their country code, sound bank accounts get sound check digits.

Not found: names without any form of address in their text, national phone numbers other than the written patterns,
and IPv6 addresses. Names in scripts other than Latin and Cyrillic get Latin surrogates; mail domains become one
reserved domain with the same ending.

Surrogates are checked against each other and against all originals of their kind: of several entities
with the same surrogate one keeps it, the others, and any surrogate that is someone's original, are drawn again
until no clash is left. From the eighth draw on a surrogate is made longer, so this ends.

Equal texts are treated once and joined back by a hash of the text, so a document needs no key of its own.

Edge cases: null texts stay null, empty ones empty, both without entities; repeated rows get the same result; entities
that occur a thousand times in a text are replaced each time; rows with null or repeated ids are kept as they are; an
empty table gives an empty result; other columns are ignored. A private key is a parameter; without it surrogates
cannot be recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import materialize, table
from hindcast.llm.registry import query

DEFAULT_KEY = "set a private key"
LONGER_FROM, MOST_DRAWS = 8, 60
#: fixed values: forms of address by gender of the name that follows
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "госпожа", "г-жа"]
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "господин", "г-н"]
EITHER = ["Dr", "Prof"]
#: fixed values: first names by gender and script, last-name syllables by script
FIRST = {
    ("f", "latin"): ["Alma", "Bella", "Carla", "Dora", "Elena", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Lena", "Maria", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Albert", "Bruno", "Carlos", "David", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Julian", "Konrad", "Leo", "Martin", "Noel", "Oskar", "Pablo"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София", "Тамара", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Фёдор"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "zu"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ха"],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ADDRESS = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_TITLES = "|".join(sorted(FEMALE + MALE + EITHER, key=len, reverse=True))
#: fixed values: what counts as an entity, in the order of preference at one place
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_ADDRESS}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": rf"\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\))?(?:[ .-]?(?!{_ADDRESS}(?!\.?\d))\d{{2,4}}){{2,5}}(?!\d)" + r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])(?:\d{4}[ -]){3}\d{4}(?![\dA-Za-z])|(?<![\dA-Za-z])\d{13,19}(?![\dA-Za-z])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
KINDS = list(PATTERNS)
#: the same without what must stand around them, for a mention that has been cut out already
BARE = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]+\.)+[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": _ADDRESS,
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone": r"\+\d.*|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}",
    "card": r"[\d -]+",
}
#: fixed values: country codes of two digits; 1 and 7 have one, all others three
CODES_OF_TWO = r"2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: all kinds in one pattern, so a text is read once
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _kind(raw: Column) -> Column:
    """The kind of a mention. Every mention has one: what is none of the others is a name."""
    kind = F.lit("name")
    for name in reversed(BARE):
        kind = F.when(raw.rlike(f"^(?:{BARE[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, rf"^(?:{_TITLES})\.? ", 0)


def _normal(raw: Column, kind: Column) -> Column:
    """The form that all spellings of one entity share."""
    name = F.lower(F.substr(raw, F.length(_title(raw)) + 1))
    digits = F.regexp_replace(raw, r"\D", "")
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ip", raw)
        .when(kind == "name", name)
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
        .otherwise(digits)
    )


def _gender(raw: Column) -> Column:
    word = F.regexp_replace(_title(raw), r"[. ]+$", "")
    return F.when(word.isin(FEMALE), "f").when(word.isin(MALE), "m").otherwise("")


def _hex_digits(key: str, *parts: Column) -> Column:
    """128 hex digits that only the key holder can compute."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 512)


def _number(digits: Column, at: Column, size: int = 2) -> Column:
    """A number from the hash, at a place that wraps around."""
    return F.conv(F.substr(digits, (at * size) % (128 - size) + 1, F.lit(size)), 16, 10).cast("int")


def _letters(text: Column, digits: Column, keep: str) -> Column:
    """Letters and digits replaced in kind, characters of ``keep`` and all others left."""
    small, large, numbers = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def change(c: Column, i: Column) -> Column:
        n = _number(digits, i)
        pick = lambda alphabet: F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
        new = F.when(c.rlike("[a-z]"), pick(small)).when(c.rlike("[A-Z]"), pick(large)).when(c.rlike("[0-9]"), pick(numbers)).when(c.rlike(r"\p{L}"), pick(small))
        return F.when(c.isin(*keep), c).otherwise(F.coalesce(new, c)) if keep else F.coalesce(new, c)

    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn_rest(digits: Column) -> Column:
    """Luhn sum of digits modulo 10."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda s, x: s + x) % 10


def _iban_rest(account: Column) -> Column:
    """The number that letters (10 to 35) and digits spell, modulo 97."""
    places = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda c: F.instr(F.lit(places), c) - 1
    add = lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.split(account, ""), F.lit(0), add)


def _surrogate(key: str, kind: Column, normal: Column, gender: Column, draw: Column) -> Column:
    """The replacement's normal form; names come out in title case."""
    hashed = _hex_digits(key, kind, normal, draw.cast("string"))
    longer = F.when(draw >= LONGER_FROM, _letters(F.lit("00000000"), F.reverse(hashed), "")).otherwise("")
    other = _letters(normal, hashed, "")
    local = F.regexp_extract(normal, "^([^@]+)@", 1)
    tld = F.regexp_extract(normal, r"\.([a-z]+)$", 1)
    # short local parts get letters, so that there are enough of them; the domain is a reserved one
    filled = F.concat(local, F.repeat(F.lit("x"), F.greatest(F.lit(0), F.lit(8) - F.length(local))))
    email = F.concat(_letters(filled, hashed, ""), F.lower(F.regexp_replace(longer, "0", "1")), F.lit("@mail.example."), tld)
    octet = lambda k: (_number(hashed, F.lit(k)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", F.lit("10"), octet(1), octet(2), octet(3))
    # drawn anew it comes from all of the address space, and an address cannot be longer
    wide_ip = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    stem = F.substr(other, F.lit(1), F.length(other) - 1)
    lacking = _luhn_rest(F.concat(stem, F.lit("0")))
    valid = F.concat(stem, ((F.lit(10) - lacking) % 10).cast("string"))
    card = F.when(_luhn_rest(normal) == 0, valid).otherwise(other)
    country, account = F.substr(normal, F.lit(1), F.lit(2)), F.concat(F.substr(other, F.lit(5)), longer)
    check = F.lpad((F.lit(98) - _iban_rest(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    sound = _iban_rest(F.concat(F.substr(normal, F.lit(5)), F.substr(normal, F.lit(1), F.lit(4)))) == 1
    iban = F.concat(country, F.when(sound, check).otherwise(F.substr(other, F.lit(3), F.lit(2))), account)
    # a country code stays, so the number remains one of that country; a national number keeps its first digit
    code = F.regexp_extract(normal, rf"^(\+(?:[17]|{CODES_OF_TWO}|\d{{1,3}})|\d)", 1)
    phone = F.concat(code, F.substr(other, F.length(code) + 1))

    words = F.split(normal, " ")
    last = F.element_at(words, -1)
    alone = F.size(words) == 1
    cyrillic = normal.rlike(r"\p{IsCyrillic}")
    # the last name follows from itself alone; a draw again changes the first name, or the last one if it stands alone
    last_hash = _hex_digits(key, F.lit("last"), last, F.when(alone | (draw >= LONGER_FROM), draw.cast("string")).otherwise("0"))
    syllable = lambda script, at: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES[script]]), _number(last_hash, F.lit(at), 1) + 1)
    build = lambda script: F.initcap(F.concat(*[syllable(script, at) for at in range(5)]))
    last_name = F.when(cyrillic, build("cyrillic")).otherwise(build("latin"))

    def first_name(word: Column, at: Column) -> Column:
        n = _number(hashed, at, 2)
        pool = lambda g, script: F.element_at(F.array(*[F.lit(x) for x in FIRST[g, script]]), n % 16 + 1)
        female = (gender == "f") | ((gender == "") & (n % 2 == 0))
        return F.when(female & cyrillic, pool("f", "cyrillic")).when(female, pool("f", "latin")).when(cyrillic, pool("m", "cyrillic")).otherwise(pool("m", "latin"))

    firsts = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), first_name)
    name = F.concat_ws(" ", F.array_join(F.concat(firsts, F.array(last_name)), " "))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.when(draw < 2, ip).otherwise(wide_ip))
        .when(kind == "card", F.concat(card, longer))
        .when(kind == "iban", iban)
        .when(kind == "name", name)
        .when(kind == "phone", F.concat(phone, longer))
        .otherwise(F.concat(other, longer))
    )


def _rendered(raw: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate in the format of one mention."""
    whole = F.split(raw, "")

    def fill(pattern: str, source: Column) -> Column:
        def place(c: Column, i: Column) -> Column:
            before = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), f"[^{pattern}]", ""))
            return F.when(c.rlike(f"[{pattern}]"), F.substr(source, before + 1, F.lit(1))).otherwise(c)

        kept = F.array_join(F.transform(whole, place), "")
        used = F.length(F.regexp_replace(raw, f"[^{pattern}]", ""))
        return F.concat(kept, F.substr(source, used + 1))

    name_part = F.substr(raw, F.length(_title(raw)) + 1)
    shouted = (name_part == F.upper(name_part)) & (F.length(name_part) > 1)
    return (
        F.when(kind == "email", F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate))
        .when(kind == "ip", surrogate)
        .when(kind == "name", F.concat(_title(raw), F.when(shouted, F.upper(surrogate)).otherwise(surrogate)))
        .when(kind == "iban", fill("A-Z0-9", surrogate))
        .otherwise(fill("0-9", F.regexp_replace(surrogate, r"^\+", "")))
    )


def _draw(entities: DataFrame, key: str, draw: Column) -> DataFrame:
    drawn = _surrogate(key, F.col("kind"), F.col("normal"), F.col("gender"), draw)
    return entities.select("kind", "normal", "gender", draw.alias("draw"), drawn.alias("surrogate"))


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, gender) to distinct surrogates that are nobody's original."""
    originals = entities.select(F.col("kind").alias("_kind"), F.col("normal").alias("_normal"))
    now = materialize(_draw(entities, key, F.lit(0)))
    for draw in range(1, MOST_DRAWS):
        clash = F.lower(F.col("surrogate"))
        first = now.groupBy("kind", clash.alias("clash")).agg(F.min_by("normal", F.struct("draw", "normal")).alias("keeper"))
        judged = now.withColumn("clash", clash).join(first, ["kind", "clash"])
        real = originals.withColumn("real", F.lit(True))
        judged = judged.join(real, (F.col("kind") == F.col("_kind")) & (F.col("clash") == F.col("_normal")), "left")
        judged = materialize(
            judged.select("kind", "normal", "gender", "draw", "surrogate", ((F.col("normal") != F.col("keeper")) | F.col("real").isNotNull()).alias("again"))
        )
        if judged.filter("again").isEmpty():
            return judged.select("kind", "normal", "surrogate")
        now = materialize(judged.filter("not again").drop("again").unionByName(_draw(judged.filter("again"), key, F.lit(draw))))
    raise RuntimeError("surrogates still clash after the last draw")


def _with_names(raws: Column) -> Column:
    """The pattern for one text: all entities, then the names that a form of address introduces in it, full and last
    ones, wherever they stand alone. Names consist of letters, apostrophes, hyphens and spaces only."""
    names = F.transform(F.filter(raws, lambda r: _title(r) != ""), lambda r: F.substr(r, F.length(_title(r)) + 1))
    parts = F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, F.element_at(F.split(n, " "), -1)))))
    longest_first = F.array_sort(parts, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    alone = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest_first, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, alone).otherwise(F.lit(ANY))


def _owned(each: DataFrame) -> DataFrame:
    """Lone last names belong to the full name that the same text has with them (the first by letter), and
    ``lone`` says that they show its last word only."""
    name = F.col("kind") == "name"
    full = each.filter(name & F.col("normal").contains(" "))
    owners = full.groupBy(F.col("mark").alias("_mark"), F.element_at(F.split("normal", " "), -1).alias("_last")).agg(F.min("normal").alias("_owner"))
    joined = each.join(owners, name & (F.col("mark") == F.col("_mark")) & (F.col("normal") == F.col("_last")), "left")
    return joined.withColumns({"lone": F.col("_owner").isNotNull(), "normal": F.coalesce("_owner", "normal")}).drop("_mark", "_last", "_owner")


def replace_personal_data(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities and a count per kind."""
    texts = docs.select("doc_id", "text").withColumn("mark", F.sha2("text", 256))
    seen = texts.select("mark", "text", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("raws")).filter("size(raws) > 0")
    pattern = _with_names(F.col("raws"))
    raws = F.when(pattern == ANY, F.col("raws")).otherwise(F.regexp_extract_all("text", pattern, F.lit(0)))
    found = materialize(seen.select("mark", F.nullif(pattern, F.lit(ANY)).alias("pattern"), raws.alias("raws")).dropDuplicates(["mark"]))
    each = found.select("mark", F.posexplode("raws").alias("place", "raw"))
    kind = _kind(F.col("raw"))
    each = materialize(each.withColumn("kind", kind).withColumn("normal", _normal(F.col("raw"), F.col("kind"))).withColumn("gender", _gender(F.col("raw"))))
    each = materialize(_owned(each))
    # a name met with several forms of address takes the gender that comes first by letter
    entities = materialize(each.groupBy("kind", "normal").agg(F.min(F.nullif(F.when(F.col("kind") == "name", F.col("gender")), F.lit(""))).alias("g")).select("kind", "normal", F.coalesce("g", F.lit("")).alias("gender")))
    surrogates = distinct_surrogates(entities, key)
    own = F.when(F.col("lone"), F.element_at(F.split("surrogate", " "), -1)).otherwise(F.col("surrogate"))
    mention = F.struct("place", _rendered(F.col("raw"), F.col("kind"), own).alias("new"), "kind")
    replaced = (
        each.drop("gender").join(surrogates, ["kind", "normal"])
        .groupBy("mark")
        .agg(F.sort_array(F.collect_list(mention)).alias("mentions"))
        .join(found.select("mark", "pattern"), "mark")
    )
    # dealt by hash at every size: the texts move once, whether few of them or many hold entities
    joined = texts.join(materialize(replaced).hint("shuffle_hash"), "mark", "left")
    gaps = F.split("text", F.coalesce("pattern", F.lit(ANY)), -1)
    news = F.concat(F.transform("mentions", lambda m: m["new"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(gaps, news, lambda gap, new: F.concat(gap, new)), "")
    # a text is never rebuilt from parts that do not fit together
    whole = F.assert_true(F.size("mentions") + 1 == F.size(gaps), F.lit("mentions and the text between them differ in number"))
    rebuilt = F.when(whole.isNull(), rebuilt)
    count = lambda name: F.coalesce(F.size(F.filter("mentions", lambda m: m["kind"] == name)), F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        F.when(F.col("mentions").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
        F.coalesce(F.size("mentions"), F.lit(0)).cast("long").alias("n_entities"),
        *[F.when(F.col("mentions").isNull(), F.lit(0).cast("long")).otherwise(count(name)).alias(f"n_{name}") for name in KINDS],
    )


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark, sf_dir):
    return replace_personal_data(table(spark, sf_dir, "documents"))
