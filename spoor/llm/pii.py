"""Personal data replaced by surrogates, with DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, payment cards, IPv4 addresses,
national numbers, long hexadecimal secrets and names behind a form of address.
An entity's canonical form (case, separators and form of address put aside) gets
one surrogate in the whole corpus, drawn from a keyed hash: same length and kinds
of characters for codes, a valid address for IPv4, a valid check digit where the
card had one, a name of the same gender and script for names. So coreference
holds between spellings and documents. Draws that meet another entity's
surrogate, or any entity of the corpus, are drawn again until all are distinct.

Defined results: null text stays null; empty texts and texts without an entity
are returned as they are; repeated rows stay; ties between entities for one
surrogate go to the smaller canonical form; an empty table gives an empty
result; all other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

#: Forms of address, by the gender that they tell; "" tells none.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "г-жа", "κα"],
}
#: Given names and family names to draw from, by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("latin", "f"): "Ada Berta Clara Diana Elena Flora Greta Helena Ida Julia Karla Laura Marta Nina Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία".split(),
}
FAMILY = {
    "latin": "Abel Bach Clement Dorn Ebert Falk Garner Holm Jansen Keller Lindt Marlow Norden Osten Pryor Quast Roland Stern Thorn Ulmer Vogel Weiss Yorke Zander".split(),
    "cyrillic": "Белых Серых Долгих Седых Черных Крутых Гладких Коротких Бондаренко Ткаченко Савченко Мельник".split(),
    "greek": "Αγγέλου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παύλου Πέτρου Χρήστου Θεοδώρου Μιχαήλ".split(),
}
#: Alphabets whose letters are replaced within themselves.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
HEX = "0123456789abcdef"

_W = r"[\p{L}\p{N}._%+\-]"
_TITLE = "(?:" + "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=lambda t: (-len(t), t))) + ")"
PATTERNS = {
    "email": rf"(?<!{_W}){_W}++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .\-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
    "card": r"(?<![\p{L}\d])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\p{L}\d])",
    "national": r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\p{L}\d\-])",
    "secret": r"(?<![\p{L}\d])(?:(?=[a-f]*+\d)[0-9a-f]{32,}|(?=[A-F]*+\d)[0-9A-F]{32,})(?![\p{L}\d])",
    "name": rf"(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?<![\p{{L}}\d]){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(PATTERNS.values())
#: What every entity has some of; one character settles most places of a text.
HINT = rf"[0-9@]|(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?<![\p{{L}}\d]){_TITLE}\.? \p{{Lu}}"

_DRAWS = 64  # draws for one entity; far more than a free domain needs


def _kind(e: Column) -> Column:
    """An entity's type; first that fits."""
    tests = [("email", F.contains(e, F.lit("@"))), ("secret", e.rlike(r"^[0-9a-fA-F]{32,}$")), ("phone", e.rlike(r"^[+(]")), ("ip", e.rlike(r"^\d+\.\d+\.\d+\.\d+$")), ("national", e.rlike(r"^\d{3}-\d{2}-\d{4}$")), ("card", e.rlike(r"^[\d \-]+$"))]
    return reduce(lambda w, t: w.when(t[1], F.lit(t[0])), tests[1:], F.when(tests[0][1], F.lit(tests[0][0]))).otherwise(F.lit("name"))


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^{_TITLE}\.? ", 0)


def _gender(e: Column) -> Column:
    bare = F.rtrim(F.regexp_replace(_title(e), r"\.", ""))
    return F.when(bare.isin(*TITLES["f"]), "f").otherwise("m")


def _canon(kind: Column, e: Column) -> Column:
    """What spellings of one entity share."""
    digits = F.regexp_replace(e, r"\D", "")
    code = F.regexp_extract(e, r"^\+(\d+)", 1)  # kept in the surrogate
    rest = F.lower(e.substr(F.length(_title(e)) + 1, F.length(e)))
    return (
        F.when(kind == "phone", F.concat(code, F.lit("|"), digits.substr(F.length(code) + 1, F.length(e))))
        .when(kind.isin("card", "national"), digits)
        .when(kind == "name", F.concat(_gender(e), F.lit("|"), rest))
        .otherwise(F.lower(e))
    )


def entity(e: Column) -> Column:
    kind = _kind(e)
    return F.struct(kind.alias("kind"), _canon(kind, e).alias("canon"))


def _number(stream: Column, at: Column, below: Column | int) -> Column:
    """The at-th pseudo-random number of a hex stream of 64 digits, below a bound."""
    place = (at * 3) % 59 + 1
    return (F.conv(stream.substr(place, F.lit(6)), 16, 10).cast("int") % (F.lit(below) if isinstance(below, int) else below)).cast("int")


def _shaped(text: Column, stream: Column, alphabets=ALPHABETS) -> Column:
    """Each letter and digit replaced within its alphabet; all else stays."""
    def one(c: Column, i: Column) -> Column:
        w = None
        for a in alphabets:
            new = F.substring(F.lit(a), _number(stream, i, len(a)) + 1, F.lit(1))
            hit = F.contains(F.lit(a), c)
            w = F.when(hit, new) if w is None else w.when(hit, new)
        return w.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a digit string, last digit undoubled."""
    odd = F.length(digits) % 2
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == odd, twice(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x) % 10


def _checked(old: Column, new: Column) -> Column:
    """Last digit set so that the new number passes the check if and only if it did before."""
    zero = F.concat(new.substr(F.lit(1), F.length(new) - 1), F.lit("0"))
    good = (10 - _luhn(zero)) % 10
    own = new.substr(F.length(new), F.lit(1)).try_cast("int")
    last = F.when(_luhn(old) == 0, good).otherwise(F.when(own == good, (own + 1) % 10).otherwise(own))
    return F.concat(new.substr(F.lit(1), F.length(new) - 1), last.cast("string"))


def _named(canon: Column, stream: Column, attempt: Column) -> Column:
    """Given name and family name, or family name alone, of the canon's gender and script; spelt freely once lists run dry."""
    who, rest = F.substring(canon, 1, 1), canon.substr(F.lit(3), F.length(canon))
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), _number(stream, F.lit(at), len(names)) + 1)
    given, family = None, None
    for (s, g), names in GIVEN.items():
        hit = (script == s) & (who == g)
        given = F.when(hit, pick(names, 1)) if given is None else given.when(hit, pick(names, 1))
    for s, names in FAMILY.items():
        family = F.when(script == s, pick(names, 2)) if family is None else family.when(script == s, pick(names, 2))
    listed = F.when(rest.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)
    return F.when(attempt < 4, listed).otherwise(F.initcap(_shaped(rest, stream)))


def surrogate(kind: Column, canon: Column, attempt: Column, stream: Column) -> Column:
    """A draw for a canonical form, from its stream of pseudo-random hex digits."""
    at = F.instr(canon, "@")
    dot = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    mail = F.concat(_shaped(canon.substr(F.lit(1), dot), stream), canon.substr(dot + 1, F.length(canon)))
    octets = F.concat_ws(".", *[(_number(stream, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    bar = F.instr(canon, "|")
    shape = _shaped(canon, stream)
    first = F.concat(F.substring(canon, 1, 1), shape.substr(F.lit(2), F.length(canon)))
    return (
        F.when((kind == "email") & (at > 0), mail)
        .when(kind == "ip", octets)
        .when(kind == "phone", F.concat(canon.substr(F.lit(1), bar), _shaped(canon.substr(bar + 1, F.length(canon)), stream)))
        .when(kind == "card", _checked(canon, first))
        .when(kind == "secret", _shaped(canon, stream, [HEX]))
        .when(kind == "name", _named(canon, stream, attempt))
        .otherwise(shape)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, s for the distinct (kind, canon) rows; all s differ, and none is an entity of the corpus.

    Each round draws for those still without; a draw is taken by the smallest
    canon that has it, unless it is taken or real. The table is of distinct
    entities and every step a join or map-side minimum.
    """
    real = stage(entities.select("kind", "canon").distinct())
    # what a surrogate must differ from: names without the gender
    bare = F.when(F.col("kind") == "name", F.col("canon").substr(F.lit(3), F.length("canon"))).otherwise(F.col("canon"))
    banned = real.select("kind", bare.alias("taken"))
    left, done = real, None
    for attempt in range(_DRAWS):
        drawn = left.withColumn("stream", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canon", F.lit(attempt)), 256))
        drawn = drawn.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), F.col("stream"))).drop("stream")
        drawn = drawn.withColumn("taken", F.lower("s"))
        firsts = drawn.groupBy("kind", "taken").agg(F.min("canon").alias("canon"))
        firsts = firsts.join(banned, ["kind", "taken"], "left_anti").select("kind", "canon")
        got = stage(drawn.join(firsts, ["kind", "canon"], "left_semi"))
        done = got if done is None else done.union(got)
        banned = banned.union(got.select("kind", "taken"))
        left = left.join(got.select("kind", "canon"), ["kind", "canon"], "left_anti")
        if attempt:
            left = stage(left)
        if left.isEmpty():
            return done.select("kind", "canon", "s")
    raise ValueError(f"no free surrogate after {_DRAWS} draws; the domain is too small for its entities")


def rendered(e: Column, kind: Column, s: Column) -> Column:
    """A surrogate in the spelling of an occurrence: its separators, its case, its form of address."""
    digits = F.regexp_replace(s, r"\D", "")
    before = lambda i: F.length(F.regexp_replace(e.substr(F.lit(1), i + 1), r"\D", ""))
    numbers = F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike(r"\d"), digits.substr(before(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.zip_with(F.split(e, ""), F.split(s, ""), lambda c, x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)), "")
    return F.when(kind.isin("phone", "card", "national"), numbers).when(kind == "name", F.concat(_title(e), s)).when((kind == "ip") | (e == F.lower(e)), s).when(e == F.upper(e), F.upper(s)).otherwise(cased)


def replaced(docs: DataFrame, key: str = "surrogates", count: str | None = None) -> DataFrame:
    """The table with surrogates in `text`; `count` names a column for the number of occurrences.

    Only texts with an entity move, keyed by themselves; the others pass.
    """
    names = docs.columns
    t = F.col("text")
    has = F.coalesce(t.rlike(HINT) & t.rlike(ANY), F.lit(False))  # the second is asked where the first holds
    plain = docs.filter(~has).select(*names, *([F.lit(0).cast("long").alias(count)] if count else []))
    held = docs.filter(has).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), t.alias("t")).withColumn("found", F.regexp_extract_all("t", F.lit(ANY), F.lit(0)))
    each = held.select("t", F.explode(F.array_distinct("found")).alias("e")).withColumn("x", entity(F.col("e"))).select("t", "e", "x.kind", "x.canon")
    table = surrogates(each, key)
    by_text = each.join(table, ["kind", "canon"]).groupBy(F.xxhash64("t").alias("k"), F.md5("t").alias("k2"))
    maps = by_text.agg(F.map_from_entries(F.collect_set(F.struct("e", rendered(F.col("e"), F.col("kind"), F.col("s")).alias("new")))).alias("new"))
    met = held.withColumns({"k": F.xxhash64("t"), "k2": F.md5("t")}).join(maps, ["k", "k2"])
    gaps = F.split("t", ANY, -1)
    news = F.transform("found", lambda e: F.element_at("new", e))
    text = F.array_join(F.zip_with(gaps, news, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    done = met.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names], *([F.size("found").cast("long").alias(count)] if count else []))
    return plain.union(done)
