"""Surrogates for personal data, in DataFrame functions only.

Detected entities (mail addresses, phone numbers, IPv4 addresses, payment card numbers, names after a gendered
title) are replaced by keyed surrogates of the same type and format: digits for digits, letters for letters of
the same script and case, everything else as it was. A name keeps its title, and its gender and script (Latin,
Cyrillic, Greek, Arabic, Han); an address keeps its domain's last label; a card number stays valid by its check digit.

All mentions of an entity get the same surrogate, whatever their format (coreference): surrogates belong to the
entity's normal form. Names are replaced word by word, given names by gender and surnames without it, so that
"Mr John Smith" and "Mr Smith" keep their common surname; where a text holds a titled full name, its mentions
without the title are replaced as well. A single word without a title is not taken for a name.

A surrogate table over the distinct entities of the whole corpus is checked until no two entities of a type share a
surrogate and no surrogate is itself an entity of the corpus (distinctness; the words of all names are one type).
An entity that loses a clash is dealt anew from the next attempt's key. Every second attempt makes mail addresses
longer by a letter and name words by a syllable, so these never run out of room. Numbers keep their length: they
would run out only when the corpus holds all of a type's numbers (4 billion for the smallest). Only distinct entities
are shuffled for it, and only texts with a mention are put together anew.

Defined results: null stays null; an empty text and a text without entities stay as they are; repeated rows get
equal results; other columns stay; columns that begin with ``_pii_`` are taken by the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stage

MALE = r"Mr\.?|Sir|Herr|Monsieur|Señor|Sr\.|Don|Господин|Г-н|Κύριος|السيد"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Madame|Mme|Señora|Sra\.|Doña|Госпожа|Г-жа|Κυρία|السيدة"
CAPITAL = r"\p{Lu}[\p{Ll}'’-]+"
ARABIC = r"\p{IsArabic}{2,}"
NAME = rf"(?:{CAPITAL}(?:\x20{CAPITAL})?|{ARABIC}(?:\x20{ARABIC})?|\p{{IsHan}}{{2,4}})"
#: In the order of precedence; the combined pattern tries them in turn at each place.
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("male", rf"(?<![\p{{L}}])(?:{MALE})\x20{NAME}"),
    ("female", rf"(?<![\p{{L}}])(?:{FEMALE})\x20{NAME}"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
TITLE = rf"^(?:{MALE}|{FEMALE})\x20"
#: Sounds of a script in turn, and how given names end for men, for women, and surnames for both.
SCRIPTS = {
    "Cyrillic": (["бвгдзклмнпрстфхш", "аеиоу"], [["ан", "ей", "им", "ор"], ["ана", "ина", "ия", "ея"]], [["ов", "ин", "ев", "ский"], ["ова", "ина", "ева", "ская"]]),
    "Greek": (["βγδζκλμνπρστφχ", "αεηιου"], [["ος", "ης", "ας", "ων"], ["α", "η", "ια", "ινα"]], [["ος", "ης", "ας", "ιδης"], ["ου", "η", "α", "ιδου"]]),
    "Arabic": (["بتجدرسصعفقكلمن", "اوي"], [["ن", "د", "ر", "م"], ["ة", "اء", "ى", "ية"]], [["ي", "ان", "ين", "ر"], ["ي", "ان", "ين", "ر"]]),
    "Latin": (["bcdfghjklmnprstvz", "aeiou"], [["o", "an", "ek", "us"], ["a", "ina", "elle", "ia"]], [["d", "l", "m", "r"], ["d", "l", "m", "r"]]),
}
#: Endings of surnames that women bear.
OF_WOMEN = {"Cyrillic": "(?:а|я)$", "Greek": "(?:α|ά|η|ή|ου|ού)$"}
HAN_FIRST, HAN_REST = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗", "明华建文军平志伟东海强晓生光林辉春国金成秀英玉兰芳丽红梅雪云珍凤娟静萍霞敏燕琴素"


def kind_of(mention: Column) -> Column:
    """Which kind a whole mention is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def entity_of(kind: Column, mention: Column) -> Column:
    """The normal form that mentions of one entity share."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "card", digits)
        .when(kind == "phone", F.substring(digits, -10, 10))
        .when(kind == "ip", mention)
        .otherwise(F.regexp_replace(mention, TITLE, ""))
    )


def _keyed(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """64 bytes in hexadecimal, keyed."""
    seed = F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("|0")), 256), F.sha2(F.concat(seed, F.lit("|1")), 256))


def _number(dealt: Column, i) -> Column:
    """The i-th byte, from 0 and round again."""
    return F.conv(F.substring(dealt, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), (n % len(chars) + 1).cast("int"), F.lit(1))


def _alike(text: Column, dealt: Column) -> Column:
    """Digits for digits and letters for letters of the same case, one by one."""
    at = lambda i: _number(dealt, i)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: (
        F.when(c.rlike("[0-9]"), _pick("0123456789", at(i)))
        .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", at(i)))
        .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", at(i)))
        .otherwise(c))), "")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes 15 digits a valid card number."""
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, doubled(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return ((10 - total % 10) % 10).cast("string")


def _name_word(kind: Column, word: Column, dealt: Column, extra: Column) -> Column:
    """One word of a name, of the same script; given names end as those of the gender do."""
    at = lambda i: _number(dealt, i)
    more = lambda piece: F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), extra), piece), "")).otherwise("")

    def of(script: str) -> Column:
        sounds, given, family = SCRIPTS[script]
        stem = F.concat(*[_pick(sounds[j % 2], at(F.lit(j))) for j in range(5)])
        stem = F.concat(stem, more(lambda i: F.concat(_pick(sounds[1], at(i * 2 + 10)), _pick(sounds[0], at(i * 2 + 11)))))
        ends = [F.array(*map(F.lit, e)) for e in (*given, *family)]
        women = word.rlike(OF_WOMEN[script]) if script in OF_WOMEN else F.lit(False)
        end = F.when(kind == "given_male", ends[0]).when(kind == "given_female", ends[1]).when(women, ends[3]).otherwise(ends[2])
        return F.initcap(F.concat(stem, F.element_at(end, (at(F.lit(7)) % 4 + 1).cast("int"))))

    han = F.concat(
        _pick(HAN_FIRST, at(F.lit(0))),
        F.array_join(F.transform(F.sequence(F.lit(2), F.length(word) + extra), lambda i: _pick(HAN_REST, at(i))), ""))
    out = of("Latin")
    for script in ("Arabic", "Greek", "Cyrillic"):
        out = F.when(word.rlike(rf"\p{{Is{script}}}"), of(script)).otherwise(out)
    return F.when(word.rlike(r"\p{IsHan}"), han).otherwise(out)


def surrogate_of(kind: Column, entity: Column, dealt: Column, attempt: Column) -> Column:
    """The surrogate of an entity's normal form from its keyed bytes."""
    extra = F.floor(attempt / 2).cast("int")
    alike = _alike(entity, dealt)
    last = F.regexp_extract(entity, r"\.[A-Za-z]+$", 0)
    longer = F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), extra), lambda i: _pick(
        "abcdefghijklmnopqrstuvwxyz", _number(dealt, 64 - i % 32))), "")).otherwise("")
    host = F.concat(longer, F.substring(alike, F.lit(1), F.length(entity) - F.length(last)), last)
    card = F.concat(F.substring(entity, 1, 1), F.substring(alike, 2, 14))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(dealt, i) % 254 + 1).cast("string")), ".")
    # Area and exchange codes do not begin with 0 or 1.
    phone = F.concat(_pick("23456789", _number(dealt, F.lit(0))), F.substring(alike, 2, 2), _pick("23456789", _number(dealt, F.lit(3))), F.substring(alike, 5, 6))
    return (
        F.when(kind == "email", host).when(kind == "card", F.concat(card, _check_digit(card)))
        .when(kind == "ip", octets).when(kind == "phone", phone).otherwise(_name_word(kind, entity, dealt, extra)))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for the distinct (kind, entity), free of clashes; words of names are one type."""
    kind_space = F.when(F.col("kind").isin("given_male", "given_female", "surname"), "name").otherwise(F.col("kind"))
    known = stage(entities.distinct().withColumn("space", kind_space))
    real = known.select("space", F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
    done, todo = None, known.withColumn("attempt", F.lit(0))
    while True:
        # Written first: the lambdas below would work the digests out again for every character.
        keyed = stage(todo.withColumn("dealt", _keyed(key, F.col("kind"), F.col("entity"), F.col("attempt"))))
        dealt = stage(keyed.select("space", "kind", "entity", "attempt", surrogate_of(
            F.col("kind"), F.col("entity"), F.col("dealt"), F.col("attempt")).alias("surrogate")))
        first = dealt.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "entity")).alias("winner"))
        fresh = dealt.join(first, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        if done is not None:
            fresh = fresh.join(done.select("space", "surrogate", F.lit(True).alias("used")), ["space", "surrogate"], "left")
        else:
            fresh = fresh.withColumn("used", F.lit(None).cast("boolean"))
        fresh = stage(fresh.withColumn(
            "good", (F.col("winner") == F.struct("kind", "entity")) & F.col("real").isNull() & F.col("used").isNull()))
        good = fresh.where("good").select("space", "kind", "entity", "surrogate")
        done = good if done is None else done.union(good)
        todo = fresh.where("NOT good").select("space", "kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done.drop("space")


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for (kind, entity): names are put together from the surrogates of their words."""
    named = F.col("kind").isin("male", "female")
    entities = stage(entities.distinct())
    words = F.split("entity", " ")
    names = entities.where(named).select(
        "kind", "entity", F.when(F.size(words) > 1, words[0]).alias("given"), F.element_at(words, -1).alias("family"))
    given_kind = F.concat(F.lit("given_"), F.col("kind"))
    parts = (
        entities.where(~named).select("kind", "entity")
        .union(names.where("given IS NOT NULL").select(given_kind, "given")).union(names.select(F.lit("surname"), "family")))
    table = stage(surrogates(parts, key))
    of = lambda kinds, name, new: table.where(kinds).select("kind", F.col("entity").alias(name), F.col("surrogate").alias(new))
    family = of(F.col("kind") == "surname", "family", "new_family").drop("kind")
    given = of(F.col("kind").startswith("given_"), "given", "new_given").withColumn("kind", F.substring_index("kind", "_", -1))
    whole = names.join(family, "family").join(given, ["kind", "given"], "left").select(
        "kind", "entity", F.concat_ws(" ", "new_given", "new_family").alias("surrogate"))
    return table.where(~F.col("kind").startswith("given_") & (F.col("kind") != "surname")).union(whole)


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one mention."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    all_digits = F.when(kind == "phone", F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), surrogate)).otherwise(surrogate)
    # The n-th digit of the mention becomes the n-th digit of the surrogate.
    chars = F.split(mention, "")
    numbered = F.aggregate(
        chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["n"] + 1).alias("n"), F.concat(
            acc["out"], F.substring(all_digits, acc["n"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(acc["n"].alias("n"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: acc["out"])
    # Letters keep the case of the mention.
    ahead = F.length(surrogate) - F.length(mention)
    cased = F.concat(F.left(surrogate, ahead), F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("[A-Z]"), F.upper(F.substring(surrogate, ahead + i + 1, F.lit(1)))).otherwise(F.substring(surrogate, ahead + i + 1, F.lit(1)))), ""))
    return (
        F.when(kind.isin("card", "phone"), numbered).when(kind == "email", cased).when(kind == "ip", surrogate)
        .otherwise(F.concat(F.regexp_extract(mention, TITLE, 0), surrogate)))


def _full_names(mentions: Column) -> Column:
    """The distinct titled names of two words."""
    titled = F.filter(mentions, lambda m: m.rlike(rf"{TITLE}\S+\x20\S+$"))
    return F.array_distinct(F.transform(titled, lambda m: F.regexp_replace(m, TITLE, "")))


def pseudonymise(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities`` (mentions) and ``n_distinct`` (entities)."""
    own = [c for c in docs.columns if c not in ("n_entities", "n_distinct")]
    text = F.col(text_col)
    # The texts are searched once; what follows works on the mentions, and on the texts that hold some.
    named = docs.select(*own).withColumn(text_col, text.cast("string"))
    found = stage(named.withColumn("_pii_found", F.coalesce(
        F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))))
    none = F.lit(0).cast("long")
    rest = found.where(F.size("_pii_found") == 0).select(*own, none.alias("n_entities"), none.alias("n_distinct"))
    given_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("|", F.length(given_id).cast("string"), given_id, F.col(id_col).isNull().cast("string"), text)))
    hit = found.where(F.size("_pii_found") > 0).withColumn("_pii_names", _full_names(F.col("_pii_found"))).withColumn("_pii_key", row)
    # Names hold letters, apostrophes and hyphens only, which stand for themselves in a pattern.
    plain = F.concat(
        F.lit(rf"{PATTERN}|(?<![\p{{L}}])(?=[\p{{Lu}}\p{{IsArabic}}])(?:"), F.array_join("_pii_names", "|"), F.lit(r")(?![\p{L}'’-])"))
    hit = hit.withColumn("_pii_pattern", F.when(F.size("_pii_names") > 0, plain))
    again = F.when(F.col("_pii_pattern").isNull(), F.col("_pii_found")).otherwise(
        F.regexp_extract_all(text, F.col("_pii_pattern"), F.lit(0)))
    mentions = hit.select("_pii_key", F.posexplode(again).alias("i", "mention")).distinct()
    told_kind = kind_of(F.col("mention"))
    mentions = mentions.withColumn("kind", told_kind).withColumn("entity", entity_of(F.coalesce("kind", F.lit("male")), F.col("mention")))
    # A full name without its title is the one that stands first with a title in the same text.
    titled = mentions.where("kind IN ('male', 'female')").groupBy("_pii_key", "entity").agg(F.min_by("kind", "i").alias("titled"))
    bare = mentions.where("kind IS NULL").drop("kind").join(titled, ["_pii_key", "entity"]).select(
        "_pii_key", "i", "mention", F.col("titled").alias("kind"), "entity")
    mentions = stage(mentions.where("kind IS NOT NULL").select("_pii_key", "i", "mention", "kind", "entity").union(bare))
    table = entity_surrogates(mentions.select("kind", "entity"), key)
    told = mentions.join(table, ["kind", "entity"]).select(
        "_pii_key", "i", "kind", "entity", _rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
    told = told.groupBy("_pii_key").agg(
        F.sort_array(F.collect_list(F.struct("i", "new"))).alias("_pii_new"),
        F.size(F.collect_set(F.struct("kind", "entity"))).cast("long").alias("n_distinct"))
    joined = hit.join(told, "_pii_key")
    gaps = F.when(F.col("_pii_pattern").isNull(), F.split(text, PATTERN, -1)).otherwise(F.split(text, F.col("_pii_pattern"), F.lit(-1)))
    put = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("_pii_new"), i)["new"], F.lit("")))), "")
    return rest.union(joined.select(
        *[put.alias(c) if c == text_col else F.col(c) for c in own], F.size("_pii_new").cast("long").alias("n_entities"), "n_distinct"))
