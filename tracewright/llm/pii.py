"""Surrogates for personal data, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import fresh_name
from tracewright.session import cut_lineage

MAX_ROUNDS = 100

# What counts as an entity. Parts are no longer than addresses and names can be, and no group repeats without bound,
# so a text of any length is matched with a bounded stack. Alternatives are tried in this order; the first that fits names the type.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TITLES_M = "Mr|Herr|Herrn|Monsieur|M|Señor|Sr|Don|Sir|Lord|г-н|господин"
_TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Señorita|Doña|Lady|г-жа|госпожа"
_TITLES_N = "Dr|Prof|Mx"
_NAME = r"\p{Lu}[\p{L}'’-]{1,63}+(?![\p{L}'’-])"
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "ip": rf"(?=[0-9])(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])",
    "iban": r"(?=[A-Z])(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?=[0-9])(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?=[0-9])(?<![\w+])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w)",
    "phone": r"(?=[0-9+(])(?<![\w.+-])(?:\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"
    r"|(?:\+[0-9]{1,3}[ .-]?)?(?:[0-9]{1,2}[ .-]){4}[0-9]{2})(?![\w-])",
    "name": rf"(?=[DFHLMPSг])(?<!\p{{L}})(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_N})\.?[ ]{_NAME}(?:[ ]{_NAME}){{0,2}}",
}
ENTITY = "|".join(PATTERNS.values())
SPARKS = "[0-9@]"  # every entity but a name holds one of these
GIVEN = {
    "latin m": "James Robert Daniel Lukas Felix Jonas Antoine Julien Mathieu Carlos Diego Javier Samuel Peter Victor Martin",
    "latin f": "Emily Sarah Laura Hannah Lena Clara Camille Juliette Manon Lucia Elena Carmen Alice Julia Nina Teresa",
    "latin n": "Alex Robin Sam Charlie Kim Noa Andrea Sascha Dominique Claude Camille Jordan Taylor Casey Morgan Jamie",
    "cyrillic m": "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей",
    "cyrillic f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана",
    "cyrillic n": "Саша Женя Валя Паша Слава Юля Митя Шура",
}
FAMILY = {
    "latin": "Baker Carter Fisher Mason Porter Turner Weaver Keller Brandt Vogel Winter Lambert Moreau Girard Rousseau Navarro Molina Ortega Campos Rivas "
    "Sutton Harlow Whitley Langley",
    "cyrillic": "Волков Соколов Орлов Лебедев Морозов Зайцев Киселёв Макаров Титов Белов",
}
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def kind_of(value: Column) -> Column:
    """The type of a whole match of ENTITY."""
    out = None
    for name, pattern in PATTERNS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("phone")


def canonical(kind: Column, value: Column) -> Column:
    """What two mentions of one entity share: letter case of e-mail and separators of numbers do not matter.

    A country code set apart from a phone number stays apart, by a blank.
    """
    country = F.regexp_extract(value, r"^[+]([0-9]{1,3})[ .(-]", 1)
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    phone = F.when(country == "", bare).otherwise(F.concat(country, F.lit(" "), bare.substr(F.length(country) + 1, F.length(bare))))
    return F.when(kind == "email", F.lower(value)).when(kind.isin("ip", "name"), value).when(kind == "phone", phone).otherwise(bare)


def _draw(size: Column | int, *parts: Column) -> Column:
    """A keyed number from 0 to size - 1."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % (F.lit(size) if isinstance(size, int) else size)


def _pick(words: str, *parts: Column) -> Column:
    found = words.split()
    return F.element_at(F.array(*map(F.lit, found)), (_draw(len(found), *parts) + 1).cast("int"))


def _positions(value: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)))


def _scrambled(value: Column, *parts: Column) -> Column:
    """Every letter and digit replaced by another of its kind; the rest stays."""

    def one(i: Column) -> Column:
        c = value.substr(i, F.lit(1))
        drawn = [*parts, i.cast("string")]
        letter = (_draw(26, *drawn) + 1).cast("int")
        return (
            F.when(c.rlike("[0-9]"), _draw(10, *drawn).cast("string"))
            .when(c.rlike("[a-z]"), F.lit(LOWER).substr(letter, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.lit(UPPER).substr(letter, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(_positions(value), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""

    def weigh(i: Column) -> Column:
        d = digits.substr(i, F.lit(1)).cast("int")
        twice = d * 2
        second = (F.length(digits) - i) % 2 == 1
        return F.when(second, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(_positions(digits), weigh), F.lit(0), lambda a, b: a + b)


def _name(value: Column, seed: list[Column], attempt: Column) -> Column:
    """Title and number of words stay; given names match the title's gender, all names the script."""
    title = F.regexp_extract(value, r"^(\S+ )", 1)
    words = F.size(F.split(value, " ")) - 1
    male, female = (title.rlike(rf"^(?:{t})\.? $") for t in (_TITLES_M, _TITLES_F))
    cyrillic = value.rlike(r" \p{IsCyrillic}")

    def given(script: str, at: str) -> Column:
        seeds = [*seed, F.lit(at)]
        return F.when(male, _pick(GIVEN[f"{script} m"], *seeds)).when(female, _pick(GIVEN[f"{script} f"], *seeds)).otherwise(
            _pick(GIVEN[f"{script} n"], *seeds)
        )

    def whole(script: str) -> Column:
        # With every four attempts one more family name joins, so there are always names left.
        family = F.array_join(
            F.transform(
                F.sequence(F.lit(0), F.floor(attempt / 4).cast("int")), lambda i: _pick(FAMILY[script], *seed, F.lit("f"), i.cast("string"))
            ),
            "-",
        )
        first = F.when(words > 1, F.concat(given(script, "1"), F.lit(" "))).otherwise("")
        second = F.when(words > 2, F.concat(given(script, "2"), F.lit(" "))).otherwise("")
        return F.concat(title, first, second, family)

    return F.when(cyrillic, whole("cyrillic")).otherwise(whole("latin"))


def _seed(kind: Column, value: Column, attempt: Column, key: str) -> list[Column]:
    return [F.lit(key), kind, value, attempt.cast("string")]


def variable_part(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The letters and digits of a canonical value that its surrogate replaces one by one, replaced."""
    part = (
        F.when(kind == "email", F.regexp_extract(value, "^([^@]*)@", 1))
        .when(kind == "card", value.substr(F.lit(2), F.length(value) - 2))
        .when(kind == "iban", value.substr(F.lit(3), F.length(value)))
        .when(kind == "phone", F.regexp_extract(value, "([0-9]*)$", 1))
        .when(kind.isin("ip", "name"), "")
        .otherwise(value)
    )
    return _scrambled(part, *_seed(kind, value, attempt, key))


def surrogate(kind: Column, value: Column, attempt: Column, part: Column, key: str) -> Column:
    """A keyed replacement of a canonical value around its ``variable_part``: same type, script, gender and format."""
    seed = _seed(kind, value, attempt, key)
    domain = F.regexp_extract(value, r"@(.*)\.", 1)
    mail_domain = _scrambled(domain, F.lit(key), F.lit("domain"), domain)
    email = F.concat(part, F.lit("@"), mail_domain, F.regexp_extract(value, r"(\.[^.]*)$", 1))
    octets = F.transform(F.split(value, r"\."), lambda _, i: (_draw(254, *seed, i.cast("string")) + 1).cast("string"))
    body = F.concat(value.substr(F.lit(1), F.lit(1)), part)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = (check + 1 + _draw(9, *seed, F.lit("check"))) % 10
    card = F.concat(body, F.when(_luhn_sum(value) % 10 == 0, check).otherwise(wrong).cast("int").cast("string"))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "name", _name(value, seed, attempt))
        .when(kind == "iban", F.concat(value.substr(F.lit(1), F.lit(2)), part))
        .when(kind == "phone", F.concat(F.regexp_extract(value, "^([0-9]+ )", 1), part))
        .otherwise(part)
    )


def dressed(kind: Column, mention: Column, replacement: Column) -> Column:
    """``replacement`` in the dress of the mention: its separators, or its capitals."""

    def one(i: Column) -> Column:
        c = mention.substr(i, F.lit(1))
        before = F.length(F.regexp_replace(mention.substr(F.lit(1), i), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), bare.substr(before, F.lit(1))).otherwise(c)

    bare = F.regexp_replace(replacement, " ", "")
    numbers = F.array_join(F.transform(_positions(mention), one), "")
    capitals = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(replacement)).otherwise(replacement)
    return F.when(kind == "email", capitals).when(kind.isin("ip", "name"), replacement).otherwise(numbers)


def assign(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no two values share one, and none equals a real value.

    Each round offers a keyed candidate for every open value. A candidate that
    is a real value or already given fails; of values with one candidate the
    smallest gets it; the others draw again. Few are left after one round.
    """
    still = values.select("kind", "value").withColumn("attempt", F.lit(0))
    real = values.select("kind", F.col("value").alias("surrogate"))
    given = None
    for _ in range(MAX_ROUNDS):
        named = [F.col("kind"), F.col("value"), F.col("attempt")]
        # The exchange deals a few files out and keeps the part from being worked out again wherever it is used.
        parted = still.withColumn("part", variable_part(*named, key)).repartition("kind", "value")
        offered = parted.withColumn("surrogate", surrogate(*named, F.col("part"), key)).drop("part")
        taken = real if given is None else real.unionByName(given.select("kind", "surrogate"))
        marked = offered.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left")
        best = marked.filter("taken is null").groupBy("kind", "surrogate").agg(F.min("value").alias("winner"))
        settled = cut_lineage(
            marked.join(best, ["kind", "surrogate"], "left")
            .select("kind", "value", "attempt", "surrogate", F.coalesce(F.col("winner") == F.col("value"), F.lit(False)).alias("won"))
        )
        won = settled.filter("won").select("kind", "value", "surrogate")
        given = won if given is None else given.unionByName(won)
        still = settled.filter("not won").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if still.isEmpty():
            return given
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity of the text replaced, and the column n_entities.

    E-mail and IP addresses, account, card, social security and phone numbers,
    IBANs and titled names are replaced by surrogates that depend on ``key`` and
    the entity alone, so mentions of one entity agree in the whole table and
    different entities stay apart (per type). Luhn checks stay right or wrong;
    a country code that is set apart, the first digit of a card and top-level
    domains stay; an e-mail domain maps to one domain everywhere.

    Null texts stay null with n_entities 0; a column n_entities is replaced;
    other columns and repeated rows stay; an empty table gives no rows. Texts
    without an entity are never shuffled. Others meet their replacements by a
    digest of the text, so copies are worked out once.
    """
    plain = docs.drop("n_entities")
    joint, parts = fresh_name(plain, "_digest"), fresh_name(plain, "_parts")
    text = F.col(text_col)
    # The quick test first: few texts without a digit or an at sign need the whole pattern.
    has = F.coalesce((text.rlike(SPARKS) & text.rlike(ENTITY)) | text.rlike(PATTERNS["name"]), F.lit(False))
    digest = F.sha2(text, 256)
    matches = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    found = cut_lineage(plain.select(text).filter(has).select(digest.alias("digest"), matches.alias("matches")).dropDuplicates(["digest"]).withColumn("kinds", F.transform("matches", kind_of)))
    listed = found.select("digest", F.posexplode(F.arrays_zip("matches", "kinds")).alias("at", "entity"))
    mentions = listed.select("digest", "at", F.col("entity.matches").alias("mention"), F.col("entity.kinds").alias("kind"))
    mentions = mentions.withColumn("value", canonical(F.col("kind"), F.col("mention")))
    table = assign(cut_lineage(mentions.select("kind", "value").distinct()), key)
    replaced = mentions.join(table, ["kind", "value"]).select(
        "digest", F.struct("at", dressed(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new")).alias("part")
    )
    by_text = replaced.groupBy("digest").agg(F.array_sort(F.collect_list("part")).alias(parts)).withColumnRenamed("digest", joint)
    hit = plain.filter(has).withColumn(joint, digest).join(by_text, joint)
    between = F.split(text, ENTITY, -1)
    together = F.transform(between, lambda gap, i: F.concat(gap, F.coalesce(F.get(parts, i)["new"], F.lit(""))))
    changed = hit.withColumn("n_entities", F.size(parts).cast("long")).withColumn(text_col, F.array_join(together, ""))
    untouched = plain.filter(~has).withColumn("n_entities", F.lit(0).cast("long"))
    return untouched.unionByName(changed.select(*untouched.columns))
