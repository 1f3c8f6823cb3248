"""Personal data replaced by surrogates of the same kind and format.

Entities: e-mail addresses, phone, card and social security numbers, IPv4 addresses, IBANs, access keys,
secrets behind names such as ``password=``, and names of persons behind a title, with every other
capitalised mention of the same name words in that text. What is replaced is a *unit*: the whole entity, or one word of a name. A unit's surrogate follows from a secret key, its kind
and its normal form, so every mention of it, in any document and layout, gets the same one.

* Numbers keep layout, length, country code and (cards) a valid check digit; addresses of private
  networks stay private; secrets keep their letter cases and digits.
* Names keep script and upper and title case. A name word is one unit, whatever titles and places it has: it is a
  given name if it ever stands before another name word behind a title, with the gender these titles tell in all
  texts together (none if they differ), else a family name.
* Collision check: all distinct units and their surrogates are compared. A surrogate that another unit has, or that
  is a unit of the texts itself, is drawn again, until none is left; so distinct units stay distinct.

Only units, and of those only the few that were drawn again or whose role their text alone does not tell, are
shuffled; texts are read twice and never moved unless these few are too many to broadcast. Only built-in functions run.

NULL texts stay NULL and empty ones empty; repeated rows get the same surrogates; an empty table gives an
empty result; all other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.storage import broadcast_if_small, cut

# Titles of persons by the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Signor", "Господин", "Κύριος"],
    "u": ["Dr", "Prof"],
}
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + ")"
# No title, and without a possessive 's.
_NAME_WORD = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}|['’-](?![sS](?!\p{{L}}))(?=\p{{L}}))+"
_TITLES = rf"(?:{_TITLE}\.? )++"

_SECRET = r"(?i:password|passwd|secret|token|api_key|apikey)\s{0,2}[=:]{1,3}\s{0,2}"

PATTERNS = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    # To the closing quote, else to the next blank; what has no letter or digit is no secret.
    *(rf"(?<={_SECRET}{q})(?=[^{q}\n]*[\p{{L}}0-9])[^{q}\n]+(?:(?<=\\){q}[^{q}\n]+)*(?={q})" for q in "\"'"),
    rf"(?<={_SECRET}[\"']?)(?![=:])(?=[^\s\"']*[\p{{L}}0-9])[^\s\"']+(?:[\"'](?=[\p{{L}}0-9])[^\s\"']+)*",
    r"(?<![\w+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)",
    r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])",
    r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    rf"(?<!\p{{L}}){_TITLES}{_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
]
ENTITY = "|".join(PATTERNS)
# No entity is without one of these.
GATE = rf"[0-9@]|(?i:password|passwd|secret|token|api_?key)|{_TITLE}\.? \p{{Lu}}"

_CONSONANTS = {"latin": "bcdfghklmnprstvz", "cyrillic": "бвгдзклмнпрстфхц", "greek": "βγδζθκλμνπρστφχξ"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_ENDINGS = {
    "latin": {"f": ["a", "ia", "ina", "elle"], "m": ["o", "us", "an", "ek"], "u": ["y", "is", "en", "el"], "family": ["son", "er", "ard", "well"]},
    "cyrillic": {"f": ["а", "ия", "ина", "ела"], "m": ["ий", "ан", "ор", "ек"], "u": ["ша", "ень", "ис", "ель"], "family": ["ов", "енко", "ин", "ский"]},
    "greek": {"f": ["α", "ια", "ινα", "ελη"], "m": ["ος", "ας", "ης", "ιος"], "u": ["ις", "ω", "υ", "ον"], "family": ["ιδης", "οπουλος", "ακης", "ογλου"]},
}

UNIT = "struct<kind: string, value: string>"


def _mentions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.rlike(GATE), found).otherwise(F.array().cast("array<string>"))


def _titled_words(mentions: Column) -> Column:
    """Name words behind titles, with a bit for the gender that a given name's title tells."""
    def words(mention: Column) -> Column:
        found, bit = _name_words(mention), _gender_bit(mention)
        return F.transform(found, lambda w, k: F.struct(F.lower(w).alias("value"), F.when(k == F.size(found) - 1, F.lit(0)).otherwise(bit).alias("bits")))

    return F.flatten(F.transform(F.filter(mentions, _titled), words))


def _known_names(words: Column) -> Column:
    """Each name word of a text with the bits of all its mentions."""
    values = F.array_distinct(F.transform(words, lambda w: w["value"]))
    def bits(value: Column) -> Column:
        return F.aggregate(F.filter(words, lambda w: w["value"] == value), F.lit(0), lambda s, w: s.bitwiseOR(w["bits"]))

    return F.map_from_entries(F.transform(values, lambda v: F.struct(v, bits(v))))


def _with_names(names: Column) -> Column:
    """Pattern of entities and of all capitalised mentions of the text's name words, longer words first."""
    words = F.array_join(F.sort_array(F.map_keys(names), asc=False), "|")
    word = F.concat(F.lit(r"(?=\p{Lu})(?iu:"), words, F.lit(r")(?![\p{L}\p{N}_])"))
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}_])"), word, F.lit("(?: "), word, F.lit(")*"))


def _found(docs: DataFrame, body: Column) -> DataFrame:
    """``docs`` with ``__mentions`` in order and ``__names``, the name words known in the text."""
    out = docs.withColumn("__mentions", _mentions(body)).withColumn("__words", _titled_words(F.col("__mentions")))
    out = out.withColumn("__names", _known_names(F.col("__words"))).drop("__words")
    every = F.regexp_extract_all(body, _with_names(F.col("__names")), F.lit(0))
    return out.withColumn("__mentions", F.when(F.size("__names") > 0, every).otherwise(F.col("__mentions")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _titled(mention: Column) -> Column:
    return mention.rlike(rf"^{_TITLE}\.? ")


def _kind(mention: Column, names: Column) -> Column:
    has = mention.rlike
    known = F.map_keys(names)
    return (
        F.when(_titled(mention), "name")
        .when((F.size(names) > 0) & F.forall(F.split(mention, " "), lambda w: F.array_contains(known, F.lower(w))), "name")
        .when(has(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"), "email")
        .when(has(r"^AKIA[0-9A-Z]{16}$"), "key")
        .when(has(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(has(r"^\+|\(") & has(r"^[+0-9 ().-]+$") & (F.length(_digits(mention)) >= 5), "phone")
        .when(has(r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(has(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(has(r"^(?:[0-9][ -]?){12,18}[0-9]$"), "card")
        .when(has(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{12,}$"), "iban")
        .otherwise("secret")
    )


def _gender_bit(mention: Column) -> Column:
    """1 behind a woman's title, 2 behind a man's, 4 behind others."""
    out = F.lit(4)
    for gender, bit in (("m", 2), ("f", 1)):
        out = F.when(_title(mention).rlike(rf"(?:^| )(?:{'|'.join(TITLES[gender])})\.? "), F.lit(bit)).otherwise(out)
    return out


def _title(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^(?:{_TITLE}\.? )*", 0)


def _name_words(mention: Column) -> Column:
    return F.split(F.regexp_replace(mention, rf"^(?:{_TITLE}\.? )+", ""), " ")


def _settled(kind: Column, bits: Column) -> Column:
    """Kind of a unit; that of a name tells its role by the bits of all its mentions."""
    gender = bits.bitwiseAND(F.lit(3))
    role = F.when(bits == 0, "name_family").when(gender == 1, "name_f").when(gender == 2, "name_m").otherwise("name_u")
    return F.when(kind == "name", role).otherwise(kind)


def _space(kind: Column) -> Column:
    """Units of one space differ by value alone: names are one, whatever their role."""
    return F.when(kind.startswith("name"), "name").otherwise(kind)


def _units(mention: Column, names: Column) -> Column:
    """Units of a mention in normal form: numbers as digits, the rest in lower case where case does not tell."""
    kind = _kind(mention, names)
    value = (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", F.right(_digits(mention), F.lit(10)))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    def unit(kind: Column, value: Column, bits: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), F.coalesce(bits, F.lit(0)).alias("bits"))

    named = F.transform(_name_words(mention), lambda w: unit(F.lit("name"), F.lower(w), F.element_at(names, F.lower(w))))
    return F.when(kind == "name", named).otherwise(F.array(unit(kind, value, F.lit(0))))


def _draw(seed: Column, k: Column | int, n: int) -> Column:
    """The ``k``-th of a unit's random numbers below ``n``."""
    return F.pmod(F.xxhash64(seed, F.lit(k) if isinstance(k, int) else k), F.lit(n)).cast("int")


def _pick(letters: str, seed: Column, k: Column) -> Column:
    return F.substring(F.lit(letters), _draw(seed, k, len(letters)) + 1, F.lit(1))


def _same_classes(value: Column, seed: Column, lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Digits for digits, letters for letters of the same case."""
    def other(c: Column, k: Column) -> Column:
        return (F.when(c.rlike("[0-9]"), _pick("0123456789", seed, k)).when(c.rlike("[a-z]"), _pick(lower, seed, k))
                .when(c.rlike("[A-Z]"), _pick(lower.upper(), seed, k)).when(c.rlike(r"\p{L}"), _pick(lower, seed, k)).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a number whose last digit is its check digit."""
    reverse = F.split(F.reverse(digits), "")
    def part(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(reverse, part), F.lit(0), lambda s, v: s + v) % 10


def _card(value: Column, seed: Column) -> Column:
    body = F.concat(F.left(value, F.lit(1)), _same_classes(F.substring(value, F.lit(2), F.length(value) - 2), seed))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.concat(body, F.when(_luhn(value) == 0, check).otherwise(_draw(seed, 99, 10)).cast("string"))


def _ip(value: Column, seed: Column) -> Column:
    part = [F.split_part(value, F.lit("."), F.lit(k)) for k in range(1, 5)]
    new = [_draw(seed, k, 222).cast("int") + 1 for k in range(4)]
    octet = [x.cast("string") for x in new]
    middle = F.when(value.rlike(r"^(10|127)\."), F.concat_ws(".", part[0], octet[1], octet[2], octet[3]))
    middle = middle.when(value.rlike(r"^(192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."), F.concat_ws(".", part[0], part[1], octet[2], octet[3]))
    # First octets of private networks are not drawn: 10 and 127 become 11 and 128, 172 and 192 become 173 and 193.
    public = F.when(new[0].isin(10, 127, 172, 192), new[0] + 1).otherwise(new[0]).cast("string")
    return middle.otherwise(F.concat_ws(".", public, octet[1], octet[2], octet[3]))


def _phone(value: Column, seed: Column) -> Column:
    """No number begins with 0 or 1 where the original did not."""
    first = F.when(value.rlike("^[2-9]"), _pick("23456789", seed, F.lit(50))).otherwise(F.left(value, F.lit(1)))
    return F.concat(first, _same_classes(F.substring(value, F.lit(2), F.length(value)), seed))


def _email(value: Column, seed: Column, key: str) -> Column:
    """One surrogate for each domain, under a name reserved for examples."""
    domain = F.split_part(value, F.lit("@"), F.lit(2))
    host = F.sha2(F.concat(F.lit(f"{key}|domain|"), domain), 256)
    label = F.concat(_pick("abcdefghijklmnopqrstuvwxyz", host, F.lit(0)), F.substring(host, 1, 7))
    return F.concat(_same_classes(F.split_part(value, F.lit("@"), F.lit(1)), seed), F.lit("@"), label, F.lit(".example"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(kind: Column, value: Column, seed: Column, attempt: Column) -> Column:
    """Syllables and an ending of the gender; later draws are longer, so names never run out."""
    role = F.substring(kind, F.lit(6), F.length(kind))
    out = None
    for script, consonants in _CONSONANTS.items():
        count = F.lit(2) + F.floor(attempt / 4).cast("int")
        syllables = F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(
            _pick(consonants, seed, 2 * k), _pick(_VOWELS[script], seed, 2 * k + 1)))  # noqa: B023
        ending = F.lit("")
        for name, options in _ENDINGS[script].items():
            ending = F.when(role == name, F.element_at(F.array(*map(F.lit, options)), _draw(seed, 1, len(options)) + 1)).otherwise(ending)
        made = F.concat(F.array_join(syllables, ""), ending)
        out = made if out is None else F.when(_script(value) == script, made).otherwise(out)
    return out


def _surrogate(unit: Column, key: str) -> Column:
    """Normal form of the surrogate of ``unit`` with fields kind, value, seed, attempt."""
    kind, value, seed, attempt = unit["kind"], unit["value"], unit["seed"], unit["attempt"]
    hexadecimal = value.rlike("^[0-9a-f]+$")
    # Short secrets can run out: later draws are longer.
    more = F.substring(seed, F.lit(1), F.floor(attempt / 4).cast("int"))
    return (
        F.when(kind == "email", _email(value, seed, key)).when(kind == "phone", _phone(value, seed))
        .when(kind == "card", _card(value, seed)).when(kind == "ip", _ip(value, seed))
        .when(kind == "key", F.concat(F.lit("AKIA"), _same_classes(F.substring(value, 5, 16), seed)))
        .when(kind == "iban", F.concat(F.left(value, F.lit(2)), _same_classes(F.substring(value, F.lit(3), F.length(value)), seed)))
        .when(kind == "secret", F.concat(F.when(hexadecimal, _same_classes(value, seed, "abcdef")).otherwise(_same_classes(value, seed)), more))
        .when(kind.startswith("name_"), _name(kind, value, seed, attempt))
        .otherwise(_same_classes(value, seed))
    )


def _seeded(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    seed = F.sha2(F.concat_ws("|", F.lit(key), _space(kind), value, attempt.cast("string")), 256)
    return F.struct(kind.alias("kind"), value.alias("value"), attempt.alias("attempt"), seed.alias("seed"))


def _drawn(units: DataFrame, key: str) -> DataFrame:
    """``(kind, value, attempt, made)`` from ``(kind, value, attempt)``."""
    seeded = units.select(_seeded(F.col("kind"), F.col("value"), F.col("attempt"), key).alias("u"))
    return seeded.select("u.kind", "u.value", "u.attempt", _surrogate(F.col("u"), key).alias("made"))


def redrawn(units: DataFrame, key: str) -> DataFrame:
    """``(kind, value, attempt)`` of units whose first surrogate cannot stay; ``units`` are distinct.

    A surrogate must differ from all units of its kind and, of units with one surrogate, the least keeps it.
    Each round settles the winners and draws again for the rest.
    """
    real = units.select(_space(F.col("kind")).alias("k"), F.col("value").alias("v"))
    open_, settled = units.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = _drawn(open_, key).withColumn("space", _space(F.col("kind")))
        drawn = drawn.join(real, (F.col("space") == F.col("k")) & (F.col("made") == F.col("v")), "left").withColumn("taken", F.col("v").isNotNull()).drop("k", "v")
        if settled is not None:
            used = settled.select(_space(F.col("kind")).alias("k"), F.col("made").alias("m"))
            drawn = drawn.join(used, (F.col("space") == F.col("k")) & (F.col("made") == F.col("m")), "left")
            drawn = drawn.withColumn("taken", F.col("taken") | F.col("m").isNotNull()).drop("k", "m")
        drawn = cut(drawn, "drawn")
        free = drawn.where(~F.col("taken"))
        first = free.groupBy("space", "made").agg(F.min("value").alias("value"))
        won = free.join(first, ["space", "made", "value"], "left_semi").select("kind", "value", "attempt", "made")
        settled = won if settled is None else settled.unionByName(won)
        settled = cut(settled, "settled")
        lost = cut(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "lost")
        if lost.isEmpty():
            return settled.where(F.col("attempt") > 0).select("kind", "value", "attempt")
        open_ = lost


def _fill(mention: Column, digits: Column) -> Column:
    """The mention's layout with its last digits replaced by ``digits``, all others kept."""
    chars = F.split(mention, "")
    n_all, n_new = F.length(_digits(mention)), F.length(digits)

    def other(c: Column, k: Column) -> Column:
        before = F.length(_digits(F.left(mention, k + 1))) - (n_all - n_new)
        return F.when(c.rlike("[0-9]") & (before > 0), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars, other), "")


def _cased(word: Column, made: Column) -> Column:
    return F.when(word == F.upper(word), F.upper(made)).otherwise(F.concat(F.upper(F.left(made, F.lit(1))), F.substring(made, F.lit(2), F.length(made))))


def _spaced(mention: Column, made: Column) -> Column:
    """Blanks of the mention put back into a surrogate without blanks."""
    chars = F.split(mention, "")
    def other(c: Column, k: Column) -> Column:
        at = F.length(F.replace(F.left(mention, k + 1), F.lit(" "), F.lit("")))
        return F.when(c == " ", c).otherwise(F.substring(made, at, F.lit(1)))

    return F.array_join(F.transform(chars, other), "")


def _replacement(mention: Column, names: Column, changed: Column | None, key: str) -> Column:
    def drawn(u: Column) -> Column:
        kind, attempt = _settled(u["kind"], u["bits"]), F.lit(0)
        if changed is not None:
            other = F.element_at(changed, F.concat_ws("|", u["kind"], u["value"]))
            kind, attempt = F.coalesce(other["kind"], kind), F.coalesce(other["attempt"], attempt)
        return _seeded(kind, u["value"], attempt, key)

    made = F.transform(F.transform(_units(mention, names), drawn), lambda u: _surrogate(u, key))
    kind, first = _kind(mention, names), F.element_at(made, 1)
    named = F.concat(_title(mention), F.array_join(F.zip_with(_name_words(mention), made, _cased), " "))
    return (F.when(kind == "name", named).when(kind.isin("phone", "card", "ssn"), _fill(mention, first))
            .when(kind == "iban", _spaced(mention, first)).otherwise(first))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with surrogates in the text column; with ``report`` also ``n_entities`` and ``entity_kinds``."""
    body = F.col(f"`{text}`")
    names = F.col("__names")
    found = _found(docs.select(body.alias("__text")), F.col("__text"))
    found = found.select(F.xxhash64("__text").alias("h"), F.explode(F.transform("__mentions", lambda m: _units(m, names))).alias("us"))
    found = cut(found.select("h", F.explode("us").alias("u")).select("h", "u.kind", "u.value", "u.bits").distinct(), "units")
    units = found.groupBy("kind", "value").agg(F.bit_or("bits").alias("bits"))
    units = cut(units.select(_settled(F.col("kind"), F.col("bits")).alias("kind"), "value"), "distinct-units")
    again = cut(redrawn(units, key), "redrawn")
    # Units drawn again and names of another role than their text alone tells, by the texts that hold them; a text's
    # set is bounded by the text.
    persons = units.where(_space(F.col("kind")) == "name").join(again, ["kind", "value"], "left")
    persons = persons.select("value", F.col("kind").alias("as"), F.coalesce("attempt", F.lit(0)).alias("attempt"))
    persons = found.where(F.col("kind") == "name").join(persons, "value")
    persons = persons.where((F.col("attempt") > 0) | (F.col("as") != _settled(F.col("kind"), F.col("bits"))))
    others = found.where(F.col("kind") != "name").join(again, ["kind", "value"]).withColumn("as", F.col("kind"))
    entry = F.struct(F.concat_ws("|", "kind", "value").alias("k"), F.struct(F.col("as").alias("kind"), "attempt").alias("v"))
    changes = cut(persons.select("h", entry.alias("e")).unionByName(others.select("h", entry.alias("e"))), "changed-units")
    changed, table = None, docs
    if not changes.isEmpty():
        by_text = changes.groupBy("h").agg(F.map_from_entries(F.collect_set("e")).alias("__changed"))
        by_text = broadcast_if_small(cut(by_text.withColumnRenamed("h", "__h"), "changed-by-text"))
        table = docs.join(by_text, F.xxhash64(body) == F.col("__h"), "left")
        changed = F.col("__changed")
    table = _found(table, body)
    gaps = F.when(F.size(names) > 0, F.split(body, _with_names(names), -1)).otherwise(F.split(body, ENTITY, -1))
    new = F.transform("__mentions", lambda m: _replacement(m, names, changed, key))
    padded = F.concat(new, F.array(F.lit("")))
    joined = F.array_join(F.zip_with(gaps, padded, lambda g, m: F.concat(g, m)), "")
    columns = [
        F.when(F.size("__mentions") > 0, joined).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns
        if not (report and c in ("n_entities", "entity_kinds"))
    ]
    if report:
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("__mentions", lambda m: _kind(m, names)))), ",")
        columns += [F.greatest(F.size("__mentions"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("entity_kinds")]
    return table.select(*columns)
