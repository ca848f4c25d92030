"""PII surrogates: detected entities get keyed, type-consistent replacements.

Entities: e-mail addresses, IPv4 addresses, phone numbers (international ones with + or 00 in any grouping, national ones with
an area code in parentheses, with a leading 0 or as three groups), card numbers (16 digits, or 13 to 19 with a valid check digit),
given names of the lists below with the surname that follows, and such a surname wherever else it stands alone in the same text:
it gets the surname of the surrogate of the first person who has it there. A surrogate is worked out from a keyed hash (SHA-256 of key, type,
attempt and the entity in lower case) character by character: a digit stays a digit, a vowel a
vowel of its script (Latin or Cyrillic), a consonant a consonant, capitals stay capitals, all else stays
as it is, so lengths and formats hold. E-mail keeps the top-level domain, a phone number its country code,
a card number that passes its check digit passes it again, an IPv4 part stays below 256, and a given name
becomes another of the same gender and script (a keyed rotation of the list, which is one to one).

One entity has one surrogate wherever it occurs (coreference). The table of distinct entities is
checked: where two entities of a type share a surrogate, or a surrogate is itself an entity of
the corpus, the losers (all but the lowest, or all) move on to their next attempt until no
collision is left; after RETRIES attempts the attempt's number is added to it as well, which leaves the format
and keeps distinctness.

Rows: null text stays null, an empty one empty. Whole texts are searched. Repeated rows are treated
alike, and all columns of the input are kept; those named like a column of the result are dropped
from the input. A row without doc_id is treated like any other. A text without entities does not move.
"""

from functools import reduce

from pyspark.sql import functions as F

from .common import LOWER, UPPER, apart, stored

# fixed values: common given names by gender and script
NAMES = {
    "f_latin": ["Alice", "Anna", "Carmen", "Charlotte", "Claire", "Elena", "Emily", "Emma", "Hannah", "Julia", "Laura",
                "Lucia", "Maria", "Marie", "Olivia", "Sarah", "Sofia", "Sophie"],
    "m_latin": ["Antonio", "Carlos", "Daniel", "David", "Hans", "James", "Jean", "John", "Juan", "Klaus", "Louis", "Lukas",
                "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas"],
    "f_cyrillic": ["Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"],
    "m_cyrillic": ["Александр", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
}
ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
             "áéíóúàèìòùäëïöü", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ"]
_NAME = "|".join(n for names in NAMES.values() for n in names)
_INITIAL = "[" + "".join(sorted({n[0] for names in NAMES.values() for n in names if n.isascii()})) + "А-Я]"
PATTERNS = {  # in order of precedence; none has a capturing group
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.)+[A-Za-z]{2,24}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?:[ \-]?[0-9]{1,3})?|(?<!\+)(?:[0-9]{13,19}|"
            r"[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5}|[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,3}))(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[1-9]|00[1-9][0-9]{0,2}[ \-.])(?:[ \-.]?\(?[0-9]\)?){6,14}(?![0-9])|"
             r"(?<![0-9A-Za-z+.\-])(?:\([0-9]{2,5}\)[ \-.]?[0-9]{3,4}[ \-.]?[0-9]{3,5}|0[0-9]{1,4}[ /\-][0-9]{3,4}[ \-]?[0-9]{3,5}|"
             r"[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4})(?![0-9A-Za-z]|[\-.][0-9])|"
             r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ \-.]?(?:\([0-9]{2,4}\)[ \-.]?)?[0-9]{2,4}(?:[ \-.][0-9]{2,4}){1,4}(?![0-9])",
    "name": rf"(?={_INITIAL})(?<![\p{{L}}])(?:{_NAME})(?:[ ]\p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}])",
}
NUMBER = r"(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "card", "phone")) + ")"
ANY = f"(?:{PATTERNS['email']})|{NUMBER}|(?:{PATTERNS['name']})"
RETRIES = 12
# country code of a phone number, or the zero before an area code
COUNTRY = r"^((?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})|0)"


def holds_entity(text):
    """Whether a text has a match of ANY. Texts without "@" or a digit, which are most, are spared the patterns that need one."""
    found = text.contains("@") & text.rlike(PATTERNS["email"]) | text.rlike("[0-9]") & text.rlike(NUMBER) | text.rlike(PATTERNS["name"])
    return F.coalesce(found, F.lit(False))


def kind_of(entity):
    """Type of a match: the first pattern that it matches as a whole."""
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("name"))


def lower_form(entity):
    return F.translate(entity, UPPER, LOWER)


def _numbers(key, kind, attempt, entity):
    """64 numbers below 65536 from the keyed hash, as an array."""
    hashed = [F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), F.lit(str(k)), entity), 256) for k in range(4)]
    hexed = F.concat(*hashed)
    return F.transform(F.sequence(F.lit(0), F.lit(63)),
                       lambda i: F.conv(F.substring(hexed, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _swapped(char, number):
    """Another character of the same alphabet."""
    return reduce(lambda out, a: F.when(F.contains(F.lit(a), char), F.substring(
        F.lit(a), F.pmod(number, F.lit(len(a))) + 1, F.lit(1))).otherwise(out), ALPHABETS, char)


def _letters(text, numbers, start=0):
    """Every character of ``text`` swapped by its number."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, k: _swapped(c, F.get(numbers, (k + start) % 64))), "")


def _checked(digits_text):
    """Luhn sum modulo 10 of the digits of a text."""
    digits = F.reverse(F.split(F.regexp_replace(digits_text, "[^0-9]", ""), "(?<=.)(?=.)"))
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(digits, lambda d, k: F.when(k % 2 == 1, double(d.cast("int"))).otherwise(d.cast("int"))),
                       F.lit(0), lambda s, d: s + d) % 10


def surrogate(key, kind, attempt, entity):
    """Column of the surrogate of an entity at an attempt."""
    numbers = F.col("numbers")
    tld = F.regexp_extract(entity, r"(\.[A-Za-z]+)$", 1)
    email = F.concat(_letters(F.left(entity, F.length(entity) - F.length(tld)), numbers), tld)
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda p, k: (F.get(numbers, k) % 254 + 1).cast("string")), ".")
    country = F.regexp_extract(entity, COUNTRY, 1)
    phone = F.concat(country, _letters(F.substr(entity, F.length(country) + 1), numbers))
    body = _letters(F.left(entity, F.length(entity) - 1), numbers)
    last = F.pmod(F.lit(10) - _checked(F.concat(body, F.lit("0"))), F.lit(10))
    other = F.when(_checked(entity) == 0, last).otherwise((last + 1 + F.get(numbers, F.lit(63)) % 9) % 10)
    card = F.concat(body, other.cast("string"))
    given = F.regexp_extract(entity, r"^(\p{L}+)", 1)
    rest = F.substr(entity, F.length(given) + 1)
    named = given
    for names in NAMES.values():
        place = F.array_position(F.array(*map(F.lit, names)), given).cast("int")
        # the rotation does not depend on the name, so that names stay distinct
        step = 1 + sum(key.encode()) % (len(names) - 1)
        named = F.when(place > 0, F.get(F.array(*map(F.lit, names)), (place - 1 + step) % len(names))).otherwise(named)
    name = F.concat(named, _letters(rest, numbers))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).otherwise(name)
    return F.when(attempt < RETRIES, out).otherwise(F.concat(out, attempt.cast("string")))


def _with_surrogate(entities, key):
    """entities (kind, entity, attempt) with their surrogates; the hash sees the lower-case form."""
    return (entities.withColumn("numbers", _numbers(key, F.col("kind"), F.col("attempt"), F.col("entity")))
            .withColumn("surrogate", surrogate(key, F.col("kind"), F.col("attempt"), F.col("entity"))).drop("numbers"))


def surrogates(entities, key):
    """kind, entity, attempt and collision-free surrogate of distinct (kind, entity) rows in lower-case form.

    A given name alone is rotated within its list, which cannot collide with another name but is
    itself a name that may occur; it counts as settled.
    """
    # entities are short and their surrogates cost much: dealt by number, they are not merged to one task for their few bytes
    entities = entities.repartition(int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("entity"))
    # names keep their case: the lists are written with capitals
    settled = entities.where("kind = 'name' AND entity NOT LIKE '% %'").withColumn("attempt", F.lit(0))
    settled = stored(_with_surrogate(settled, key), "pii-names")
    real = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    now = stored(_with_surrogate(entities.where("NOT (kind = 'name' AND entity NOT LIKE '% %')")
                                 .withColumn("attempt", F.lit(0)), key), "pii-attempt")
    while True:
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        marked = (now.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
                  .withColumn("lost", F.col("real").isNotNull() | (F.struct("attempt", "entity") != F.col("first")))
                  .select("kind", "entity", "attempt", "surrogate", "lost"))
        marked = stored(marked, "pii-marked")
        if marked.where("lost").isEmpty():
            return marked.drop("lost").unionByName(settled.select("kind", "entity", "attempt", "surrogate"))
        again = marked.where("lost").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        now = stored(marked.where("NOT lost").drop("lost").unionByName(
            _with_surrogate(again, key).select("kind", "entity", "attempt", "surrogate")), "pii-attempt")


def entity_form(kind, value):
    """What makes two mentions one entity: letters' case is ignored but in names."""
    return F.when(kind == "name", value).otherwise(lower_form(value))


def mentions(docs):
    """One row per entity of a text: row (of the text), place, text before it, the value, its kind and entity."""
    pieces = F.split("text", ANY)
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    rows = (docs.select("row", pieces.alias("pieces"), found.alias("found"))
            .select("row", F.posexplode(F.arrays_zip("pieces", "found"))))
    kind = F.when(F.col("value").isNotNull(), kind_of(F.col("value")))
    # a number of other than 16 digits that fails the check digit is no card and stays with the text before it
    none = F.coalesce((F.col("kind") == "card") & (F.length(F.regexp_replace("value", "[^0-9]", "")) != 16)
                      & (_checked(F.col("value")) != 0), F.lit(False))
    return (rows.select("row", F.col("pos").alias("place"), F.col("col.pieces").alias("piece"), F.col("col.found").alias("value"))
            .withColumn("kind", kind).withColumn("none", none)
            .select("row", "place", F.when(F.col("none"), F.concat("piece", "value")).otherwise(F.col("piece")).alias("piece"),
                    *[F.when(~F.col("none"), F.col(c)).alias(c) for c in ("value", "kind")])
            .withColumn("entity", entity_form(F.col("kind"), F.col("value"))))


def _cased(surrogate, value):
    """The surrogate with capitals where the mention has them (mentions of one entity may differ in case)."""
    chars = F.filter(F.split(surrogate, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, k: F.when(
        F.substring(value, k + 1, F.lit(1)).rlike("[A-Z]"), F.translate(c, LOWER, UPPER)).otherwise(c)), "")


def replaced(docs, key="surrogates"):
    """``docs`` with entities replaced in ``text``; adds n_entities and the list ``entities`` (kind, value, surrogate).

    Input columns of these two names give way; others may have any name.
    """
    original = docs.drop("n_entities", "entities")
    docs, _ = apart(original, "text")
    has = holds_entity(F.col("text"))
    rows = stored(docs.where(has).withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    parts = stored(mentions(rows), "pii-mentions")
    table = surrogates(parts.where("value IS NOT NULL").select("kind", "entity").distinct(), key)
    known = parts.where("value IS NOT NULL").join(table.select("kind", "entity", "surrogate"), ["kind", "entity"])
    known = known.withColumn("surrogate", F.when(F.col("kind") == "name", F.col("surrogate"))
                             .otherwise(_cased(F.col("surrogate"), F.col("value"))))
    every = known.unionByName(parts.where("value IS NULL").withColumn("surrogate", F.lit(None).cast("string")))
    surname = lambda c: F.get(F.split(F.col(c), " "), F.lit(1))
    person = F.when((F.col("kind") == "name") & F.col("value").contains(" "), F.struct(
        "place", surname("value").alias("surname"), surname("surrogate").alias("new")))
    every = every.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", "kind", "value", "surrogate"))).alias("parts"),
        F.array_sort(F.collect_list(person)).alias("people"))
    kind = "struct<kind:string,value:string,surrogate:string>"

    def one(kind_of_it, value, new):
        return F.struct(kind_of_it.alias("kind"), value.alias("value"), new.alias("surrogate")).cast(kind)

    def words(piece):
        """The words of a piece and what is between them, surnames of the text's people with their surrogates."""
        def word(w):
            new = F.get(F.col("people.new"), F.array_position(F.col("people.surname"), w).cast("int") - 1)
            return one(F.when(new.isNotNull(), F.lit("name")), w, new)
        return F.when(F.size("people") == 0, F.array(one(F.lit(None), piece, F.lit(None)))).otherwise(
            F.transform(F.regexp_extract_all(piece, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), word))

    split = F.flatten(F.transform("parts", lambda p: F.concat(
        words(p["piece"]), F.array(one(p["kind"], p["value"], p["surrogate"])))))
    every = every.select("row", split.alias("all"))
    text = F.array_join(F.transform("all", lambda p: F.coalesce(p["surrogate"], p["value"], F.lit(""))), "")
    listed = F.filter("all", lambda p: p["surrogate"].isNotNull())
    new = every.select("row", text.alias("new_text"), listed.alias("entities"))
    out = rows.join(new, "row").select(
        *[F.col("new_text").alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.size("entities").alias("n_entities"), "entities")
    same = docs.where(~has).select(*docs.columns, F.lit(0).alias("n_entities"), F.array().cast(f"array<{kind}>").alias("entities"))
    return out.unionByName(same).toDF(*original.columns, "n_entities", "entities")
