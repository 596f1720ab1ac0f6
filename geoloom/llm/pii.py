"""Personal data: detection and surrogate generation with DataFrame functions only.

Each distinct entity (its type and its normal form) gets one surrogate, derived
from a keyed digest: the same entity always gets the same one (coreference),
digits stay digits and letters letters, names keep gender and script.  Digests
may collide, so surrogates are checked against each other and against all real
entities, and those that clash are derived anew until all are distinct.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import drop, save

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Herr|Frau|Fräulein|Señor|Señora|Señorita|Doña|Monsieur|Madame|Mademoiselle|Mme|Mlle|Signor|Signora|Господин|Госпожа|Κύριος|Κυρία"
#: (group, type, pattern); the first that matches at a place counts. Groups have names: each pattern also stands alone.
_GROUPED = [
    ("mail", "email", r"\b[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}\b"),
    ("key", "secret", r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,255}\b|\bsk-[A-Za-z0-9]{20,64}\b|(?<=[=: \"'])(?=[A-Za-z_-]{0,128}+[0-9])(?=[A-Za-z0-9_-]{8})(?<=(?i:password|passwd|secret|api[_-]?key|token) ?[=:] ?[\"']?)[A-Za-z0-9_-]{8,128}+"),
    ("number", "iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("number", "card", r"(?<![\w.+-])\d{4}(?<card>[ -]?)\d{4}\k<card>\d{4}\k<card>\d{1,7}(?![\w-])"),
    ("number", "ssn", r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("number", "ip", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)"),
    ("number", "phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}(?<phone>[.-])\d{3}\k<phone>\d{4}(?![\w-])"),
    ("colon", "ipv6", r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]|\.\d)"),
    ("title", "name", rf"\b(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?:[ -]\p{{Lu}}\p{{Ll}}{{1,30}})?"),
]
TYPES = [(kind, pattern) for _, kind, pattern in _GROUPED]
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)
#: What every match of a group's patterns contains: a group is looked for only in texts that hold its hint.
HINTS = {
    "mail": "@",
    "key": r"AKIA|gh[pousr]_|sk-|(?i:password|passwd|secret|api[_-]?key|token)",
    "number": r"[A-Z]\d\d|\d{4}[ -]?\d{4}|\d-\d\d-\d|\d\.\d{1,3}\.\d|\+\d|\(\d{3}\)|\d{3}[.-]\d{3}",
    "colon": r"[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:|::",
    "title": "Mr|Ms|Mx|Miss|Dr|Prof|Herr|Frau|Fräulein|Señor|Doña|Monsieur|Madame|Mademoiselle|Mme|Mlle|Signor|Госп|Κυρ|Κύρ",
}
#: Titles of women and of men; after any other title the given name's ending decides, and without one it is a man's.
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Fräulein|Señora|Señorita|Doña|Madame|Mademoiselle|Mme|Mlle|Signora|Госпожа|Κυρία)\b"
NEUTRAL = r"^(?:Dr|Prof|Professor|Mx)\b"
FEMALE_NAME = r"(?:a|ie|ine|elle|ette|lyn|beth|а|я|α|η)$"
#: By script: first letters, syllables, endings of men's and of women's given names, of surnames.
SCRIPTS = {
    "latin": (list("BDFGHKLMNPRSTV"), ["al", "an", "ar", "el", "en", "er", "il", "in", "ol", "on", "or", "um"], ["bert", "fred", "rik", "mund", "ton", "vin"], ["a", "ina", "elle", "ia", "essa", "ora"], ["berg", "field", "man", "ner", "ston", "wick"]),
    "cyrillic": (list("БДГКЛМНПРСТВ"), ["ал", "ан", "ар", "ел", "ен", "ер", "ил", "ин", "ол", "он", "ор", "ум"], ["мир", "слав", "тон", "дрей", "мен", "вин"], ["а", "ина", "ела", "ия", "еса", "ора"], ["ский", "енко", "ович", "ман", "нер", "ик"]),
    "greek": (list("ΒΔΓΚΛΜΝΠΡΣΤΦ"), ["αλ", "αν", "αρ", "ελ", "εν", "ερ", "ιλ", "ιν", "ολ", "ον", "ορ", "υμ"], ["ιος", "ανος", "ων", "ης", "ιππος", "ας"], ["α", "ινη", "ελα", "ια", "εσα", "ορα"], ["ιδης", "πουλος", "ακης", "ου", "ας", "ινος"]),
}
#: The round of new derivations from which surrogates grow, by a digit or syllable a round, so that any number of entities finds room.
LONGER = 3


def find(text: Column) -> Column:
    """All that the patterns match in a text, in order, as an array of strings.

    Of the groups of patterns only those are tried whose hint the text holds.
    """
    out = F.array().cast("array<string>")
    for groups in reversed(list(product(*((g, None) for g in HINTS)))):  # more groups outside fewer
        wanted = [f"(?:{p})" for g, _, p in _GROUPED if g in groups]
        if wanted:
            held = reduce(lambda a, b: a & b, [F.col("_hints").getItem(i) for i, g in enumerate(groups) if g])
            out = F.when(held, F.regexp_extract_all(text, F.lit("|".join(wanted)), F.lit(0))).otherwise(out)
    return out


def hints(text: Column) -> Column:
    """For each group of patterns whether the text holds its hint."""
    return F.array(*(F.contains(text, F.lit(h)) if h == "@" else text.rlike(h) for h in HINTS.values()))


def kind_of(entity: Column) -> Column:
    """The type of a matched string, that of the first pattern that matches all of it; null for what fails its check sum."""
    out = F.lit("secret")  # what stands behind a keyword matches only in its context
    for name, pattern in reversed(TYPES):
        if name != "secret":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    wrong = ((out == "card") & (_luhn(digits) != 0)) | ((out == "iban") & (_mod97(F.regexp_replace(entity, "[ -]", "")) != 1))
    return F.when(~wrong, out)


def normal(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share: digits of numbers, lower case of addresses, the words of a name."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    plain = F.regexp_replace(entity, "[ -]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", plain).when(kind.isin("email", "ipv6"), F.lower(entity)).otherwise(entity)


def _hex(digest: Column, i: Column, modulus: int) -> Column:
    """Number below ``modulus`` from four hex digits of the digest, from position i on, around."""
    four = F.substring(F.concat(digest, digest), F.pmod(i * 3, F.lit(60)) + 1, F.lit(4))
    # another factor for each turn around the digest, so that far places differ
    return F.pmod(F.conv(four, 16, 10).cast("long") * (2 * i + 1) + i, F.lit(modulus))


def _like(plain: Column, digest: Column) -> Column:
    """Every letter another letter of its case and every digit another digit, as the digest says."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("[0-9]"), _hex(digest, i, 10).cast("string"))
            .when(c.rlike("[A-Z]"), F.substring(F.lit(upper), _hex(digest, i, 26).cast("int") + 1, F.lit(1)))
            .when(c.rlike("[a-z]"), F.substring(F.lit(lower), _hex(digest, i, 26).cast("int") + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(plain, ""), one), "")


def _hex_like(plain: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(plain, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), _hex(digest, i, 16).cast("int") + 1, F.lit(1))).otherwise(c)), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def _mod97(iban: Column) -> Column:
    """Remainder by 97 of an account number whose first four characters stand last and whose letters count 10 to 35."""
    chars = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _pick(options: list[str], digest: Column, i: int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _hex(digest, F.lit(i), len(options)).cast("int") + 1)


def surrogate(kind: Column, plain: Column, digest: Column, longer: Column) -> Column:
    """A replacement of the same type and format, in normal form; longer than that by so many digits or syllables."""
    like = _like(plain, digest)
    each = lambda pick: F.array_join(F.transform(F.array_repeat(F.lit(""), longer), lambda _, i: pick(F.sha2(digest, 256), i)), "")
    more = each(lambda d, i: _hex(d, i, 10).cast("string"))
    code = F.when(F.length(plain) > 10, F.substring(plain, F.lit(1), F.length(plain) - 10)).otherwise(F.lit(""))  # a country's code
    rest = F.substring(like, F.length(code) + 1, F.length(plain))
    phone = F.concat(code, (F.lit(2) + _hex(digest, F.lit(17), 8)).cast("string"), F.substring(rest, F.lit(2), F.length(plain)), more)
    card = F.concat(F.substring(plain, 1, 1), F.substring(like, F.lit(2), F.length(plain) - 2), more)
    sum_10 = F.pmod(10 - _luhn(F.concat(card, F.lit("0"))), F.lit(10))
    wrong = F.pmod(sum_10 + 1 + _hex(digest, F.lit(18), 9), F.lit(10))
    card = F.concat(card, F.when(_luhn(plain) == 0, sum_10).otherwise(wrong).cast("string"))
    # no real address has octets above 255
    ip = F.array_join(F.transform(F.split(plain, r"\."), lambda o, i: F.when(longer > 0, F.lit(256) + _hex(digest, i, 744)).otherwise(F.lit(1) + _hex(digest, i, 254)).cast("string")), ".")
    domain = F.substring_index(plain, "@", -1)
    top = F.substring_index(domain, ".", -1)
    email = F.concat(more, F.substring(like, F.lit(1), F.length(plain) - F.length(top)), top)
    own = F.concat(F.substring(like, F.lit(5), F.length(plain)), more)  # the account; its check digits follow from it
    iban = F.concat(F.substring(plain, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(plain, 1, 2), F.lit("00"), own))).cast("string"), 2, "0"), own)
    key = F.when(plain.rlike("^AKIA"), F.concat(F.lit("AKIA"), F.substring(like, F.lit(5), F.length(plain)))).when(plain.rlike("^(?:gh[pousr]_|sk-)"), F.concat(F.substring_index(F.regexp_replace(plain, "-", "_"), "_", 1), F.substring(plain, F.length(F.substring_index(F.regexp_replace(plain, "-", "_"), "_", 1)) + 1, F.lit(1)), F.substring(like, F.length(F.substring_index(F.regexp_replace(plain, "-", "_"), "_", 1)) + 2, F.length(plain)))).when(plain.rlike("^[0-9a-f]+$"), _hex_like(plain, digest)).otherwise(like)
    part = None
    for script, (first, middle, men, women, families) in SCRIPTS.items():
        test = {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}[script]
        stem = F.concat(_pick(first, digest, 1), _pick(middle, digest, 2), _pick(list("bdfgklmnprstv") if script == "latin" else [c.lower() for c in first], digest, 3), _pick(middle, digest, 4))
        end = F.when(kind == "male", _pick(men, digest, 5)).when(kind == "female", _pick(women, digest, 6)).otherwise(_pick(families, digest, 7))
        made = F.concat(stem, each(lambda d, i, middle=middle: F.element_at(F.array(*map(F.lit, middle)), _hex(d, i, len(middle)).cast("int") + 1)), end)
        part = made if part is None else F.when(plain.rlike(test), made).otherwise(part)  # other scripts get Latin names
    return F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email).when(kind == "iban", iban).when(kind == "secret", F.concat(key, more)).when(kind == "ssn", F.concat(like, more)).when(kind == "ipv6", F.concat(_hex_like(plain, digest), more)).otherwise(part)


def _derive(rows: DataFrame, key: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "plain", F.col("round").cast("string")), 256)
    return rows.withColumn("digest", digest).withColumn("surrogate", surrogate(F.col("kind"), F.col("plain"), F.col("digest"), F.greatest(F.col("round") - (LONGER - 1), F.lit(0)))).drop("digest")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, plain, surrogate) of distinct (kind, plain) rows: surrogates of one kind differ from each other and from every real one."""
    current = save(_derive(entities.withColumn("round", F.lit(0)), key))
    while True:  # ends: from LONGER on every round has ten times the room
        # of those that share a surrogate, the one of the earliest round and smallest form keeps it
        first = current.groupBy("kind", "surrogate").agg(F.min(F.struct("round", "plain")).alias("owner"))
        real = current.select("kind", F.col("plain").alias("surrogate"), F.lit(True).alias("real"))
        judged = current.join(first, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        good = (F.col("owner.plain") == F.col("plain")) & F.col("real").isNull()
        judged = judged.withColumn("good", good).drop("owner", "real")
        if judged.where("not good").limit(1).count() == 0:
            return current.drop("round")
        again = _derive(judged.where("not good").select("kind", "plain", (F.col("round") + 1).alias("round")), key)
        new = save(judged.where("good").select("kind", "plain", "round", "surrogate").union(again.select("kind", "plain", "round", "surrogate")))
        drop(current)
        current = new


def _name_parts(entity: Column) -> tuple[Column, Column, Column]:
    """(title with what follows it, given name or empty, surname) of a name."""
    title = F.regexp_extract(entity, r"^(\S+ )", 1)
    rest = F.regexp_replace(entity, r"^\S+ ", "")
    two = rest.rlike("[ -]")
    return title, F.when(two, F.regexp_extract(rest, "^([^ -]+)", 1)).otherwise(F.lit("")), F.regexp_extract(rest, "([^ -]+)$", 1)


def _laid_out(kind: Column, entity: Column, new: Column) -> Column:
    """The surrogate in the mention's own format: its digits go where the mention's digits stand, and those it has more to the end."""
    rest = lambda drop: F.substring(new, F.length(F.regexp_replace(entity, drop, "")) + 1, F.length(new))
    at = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    numbers = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(new, at(i), F.lit(1))).otherwise(c)), "")
    at_plain = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[ -]", ""))
    blocks = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[ -]"), c).otherwise(F.substring(new, at_plain(i), F.lit(1)))), "")
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(numbers, rest("[^0-9]"))).when(kind == "iban", F.concat(blocks, rest("[ -]"))).otherwise(new)


def replace_pii(docs: DataFrame, key: str = "geoloom", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows with the personal data in ``text_col`` replaced; all other columns stay.

    ``count_col`` names a column for the number of mentions, which comes last and
    takes the place of one of that name.  Null and empty texts stay as they are,
    with no mention; empty tables give none; repeated rows are repeated, with
    the same surrogates.  Texts are searched once, and only the mentions of rows
    that have any are shuffled.  Numbers like cards or accounts whose check sum
    fails are none.  Names are found behind a title, which gives the gender
    (``FEMALE``; behind ``NEUTRAL`` ones the given name's ending does); given
    names and surnames have surrogates of their own, so "Mrs Ann Lee" and "Mrs
    Lee" share the surname's.
    """
    cols = [c for c in docs.columns if c != count_col]
    text = docs[text_col].cast("string")
    # fields by their place: names that differ in case only can't be stored side by side
    marked = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(cols) if c != text_col), F.lit(0).alias("_")).alias("_row"), text.alias("_text"))
    marked = marked.withColumn("_hints", hints(F.col("_text"))).withColumn("_found", F.coalesce(find(F.col("_text")), F.array().cast("array<string>"))).drop("_hints")
    marked = marked.withColumn("_kinds", F.transform("_found", kind_of)).withColumn("_n", F.size(F.filter("_kinds", lambda k: k.isNotNull())).cast("long"))
    # stored, so that the search is not repeated for the rows without and with mentions
    marked = save(marked.withColumn("_id", F.monotonically_increasing_id()))
    back = lambda df, new: df.select(*((new if c == text_col else F.col("_row").getField(f"c{i}")).alias(c) for i, c in enumerate(cols)), *([F.col("_n").alias(count_col)] if count_col else []))
    plain = marked.where("_n = 0")
    hit = marked.where("_n > 0")
    mention = hit.select("_id", F.posexplode(F.arrays_zip("_found", "_kinds")).alias("_pos", "_m")).select("_id", "_pos", F.col("_m._found").alias("_entity"), F.col("_m._kinds").alias("_kind"))
    title, given, family = _name_parts(F.col("_entity"))
    woman = F.col("_entity").rlike(FEMALE) | (F.col("_entity").rlike(NEUTRAL) & given.rlike(FEMALE_NAME))
    gender = F.when(woman, "female").otherwise("male")
    part = lambda kind, value: F.struct(kind.alias("kind"), value.alias("plain"))
    parts = F.when(F.col("_kind") == "name", F.filter(F.array(part(gender, given), part(F.lit("family"), family)), lambda x: x["plain"] != "")).otherwise(F.array(part(F.col("_kind"), normal(F.col("_kind"), F.col("_entity")))))
    # one row a distinct mention first: what is repeated a million times is worked on once
    distinct = mention.where("_kind is not null").select("_entity", "_kind").distinct().select("_entity", "_kind", F.posexplode(parts).alias("_part", "_p")).select("_entity", "_kind", "_part", F.col("_p.kind").alias("kind"), F.col("_p.plain").alias("plain"))
    distinct = save(distinct)
    table = surrogates(distinct.select("kind", "plain").distinct(), key)
    joined = distinct.join(table, ["kind", "plain"]).groupBy("_entity", "_kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "surrogate"))), lambda x: x["surrogate"]), " ").alias("_new"))
    made = joined.select("_entity", "_kind", F.when(F.col("_kind") == "name", F.concat(title, "_new")).otherwise(_laid_out(F.col("_kind"), F.col("_entity"), F.col("_new"))).alias("_new"))
    # what is no entity stands for itself
    news = mention.join(made, ["_entity", "_kind"], "left").groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_new", "_entity").alias("_new")))), lambda x: x["_new"]).alias("_news"))
    pieces = F.transform(F.split("_text", PATTERN, -1), lambda gap, i: F.concat(gap, F.coalesce(F.get("_news", i), F.lit(""))))
    return back(plain, F.col("_text")).union(back(hit.join(news, "_id"), F.array_join(pieces, "")))
