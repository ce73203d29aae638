"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one regular expression. A surrogate depends on a secret
key and the entity's normal form alone, so an entity has one surrogate in every
document and in every way of writing it, and keeps type, layout, script, letter
case, country code, check digit and, for names with a title, gender. Surrogates
of different entities are compared over the whole corpus; where two agree, or one
is a real entity, the later takes another one, until all differ.

Texts are shuffled once, to meet their surrogates; everything before works on
distinct entities, counted with map-side combine. A text of many copies is one
row there and is split by the join like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowscribe.session import cut

#: Titles by gender, given names by gender and script, syllables of family names.
TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "Г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Г-жа"]}
GIVEN = {
    "m": {"latin": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"], "cyrillic": ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман"]},
    "f": {"latin": ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Rosa", "Sofia"], "cyrillic": ["Алла", "Вера", "Дарья", "Елена", "Жанна", "Инна", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Юлия"]},
}
SYLLABLES = {"latin": ["ba", "bel", "cor", "da", "den", "fa", "gor", "ha", "ken", "la", "lin", "mar", "mo", "nel", "or", "ras"], "cyrillic": ["ба", "бел", "вор", "да", "ден", "жа", "гор", "за", "кен", "ла", "лин", "мар", "мо", "нел", "ор", "рас"]}

_TITLE = "|".join(t for titles in TITLES.values() for t in sorted(titles, key=len, reverse=True))
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Kind -> expression, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+)?",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![\p{L}\p{N}])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,4})(?![0-9])",
    "phone": r"(?:(?<![0-9.+])\+[0-9]{1,3}[ .\-]?|(?<![0-9.+(]))\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9.+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity holds one of these; texts without any are not searched further.
HINT = rf"[0-9@]|sk-|ghp_|AKIA|[a-f]{{32}}|[A-F]{{32}}|(?:{_TITLE})\.? "
ROUNDS = 20


def replace_entities(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; ``found`` names a column for their number.

    All other columns stay as they are, whatever their names. A null text stays
    null, with 0 entities; texts without entities are unchanged. Repeated rows
    are replaced alike. An empty table gives an empty table.
    """
    value = F.col(text).cast("string")
    entity = F.lit(ENTITY)
    has_entity = F.when(F.col("text").rlike(HINT), F.col("text").rlike(ENTITY)).otherwise(False)
    texts = docs.select(value.alias("text")).filter(has_entity)
    # Copies of a text are one row from here on; what is written is no text, only its entities.
    places = texts.select(F.sha2("text", 256).alias("key"), F.regexp_extract_all("text", entity, F.lit(0)).alias("found"))
    places = cut(places.groupBy("key").agg(F.first("found").alias("found")), "entities")
    rows = places.select("key", F.posexplode("found").alias("pos", "entity"))
    entities = rows.groupBy("entity").count().select("entity", kind_of(F.col("entity")).alias("kind"))
    entities = cut(entities.withColumn("norm", normal(F.col("entity"), F.col("kind"))), "entities")
    chosen = _distinct_choice(entities, key)
    attempts = entities.join(chosen, ["kind", "norm"]).select("entity", surrogate(F.col("entity"), F.col("kind"), F.col("norm"), F.col("attempt"), key).alias("surrogate"))
    spelled = rows.join(attempts, "entity").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "surrogate"))).alias("list"))
    spelled = spelled.select(F.col("key").alias("_key"), F.transform("list", lambda s: s.surrogate).alias("_surrogates"))
    # Texts without entities and nulls are dealt by a key of their own, not to one task.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), value.alias("text"))
    packed = packed.withColumn("key", F.when(has_entity, F.sha2("text", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("row"))))
    joined = packed.join(spelled, F.col("key") == F.col("_key"), "left")
    gaps = F.split("text", ENTITY, -1)
    parts = F.zip_with(gaps, F.concat("_surrogates", F.array(F.lit(""))), lambda gap, s: F.concat(gap, s))
    new = F.when(F.col("_surrogates").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    out = joined.select(F.col("row").withField(f"`{text}`", new).alias("row"), F.coalesce(F.size("_surrogates"), F.lit(0)).alias("count"))
    out = out.withColumn("count", F.greatest("count", F.lit(0)))
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("count").cast("long").alias(found)] if found else []))


def kind_of(entity: Column) -> Column:
    """The first kind whose expression matches the whole entity."""
    out = F.lit(list(KINDS)[-1])
    for kind, pattern in reversed(list(KINDS.items())):
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def normal(entity: Column, kind: Column) -> Column:
    """What all ways of writing an entity have in common."""
    plain = F.upper(F.regexp_replace(entity, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("email", "secret"), F.lower(entity)).when(kind == "name", F.regexp_replace(F.lower(entity), r"\.", "")).when(kind == "ip", entity).otherwise(plain)


def _distinct_choice(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm and attempt, with attempts such that all surrogates differ from each other and from all entities."""
    rows = entities.groupBy("kind", "norm").agg(F.min("entity").alias("entity")).withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("norm").alias("made")).distinct().withColumn("taken", F.lit(True))
    for _ in range(ROUNDS):
        made = normal(surrogate(F.col("entity"), F.col("kind"), F.col("norm"), F.col("attempt"), key), F.col("kind"))
        rows = cut(rows.withColumn("made", made), "surrogates")
        first = rows.groupBy("kind", "made").agg(F.min("norm").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        judged = rows.join(first, ["kind", "made"], "left").join(real, ["kind", "made"], "left")
        clash = F.coalesce("taken", F.lit(False)) | (F.col("first").isNotNull() & (F.col("first") != F.col("norm")))
        rows = cut(judged.select("kind", "norm", "entity", "attempt", clash.alias("clash")), "surrogates")
        if rows.filter("clash").isEmpty():
            return rows.select("kind", "norm", "attempt")
        rows = rows.select("kind", "norm", "entity", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise ValueError("no distinct surrogates found; a kind has more entities than surrogates")


def surrogate(entity: Column, kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity: type and layout kept, content from a keyed digest of its normal form."""
    digest = lambda *parts: F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    own = digest(kind, norm, attempt.cast("string"))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    host = F.left(domain, F.length(domain) - F.length(top))
    email = F.concat(shaped(local, own), F.lit("@"), shaped(host, digest(F.lit("host"), F.lower(domain))), top)
    country = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[^0-9])", 0)
    phone = F.concat(country, shaped(F.substring(entity, F.length(country) + 1, F.length(entity)), own))
    iban = F.concat(F.left(entity, F.lit(2)), shaped(F.substring(entity, F.lit(3), F.length(entity)), own))
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.lit(1) + _byte(own, i) % 254).cast("string"))
    hexes = F.transform(F.split(entity, ""), lambda c, i: F.when(entity.rlike("[A-F]"), F.upper(F.hex(_byte(own, i) % 16))).otherwise(F.lower(F.hex(_byte(own, i) % 16))))
    secret = F.when(entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.array_join(hexes, "")).when(
        entity.rlike("^(?:AKIA|sk-|ghp_)"), F.concat(F.regexp_extract(entity, "^(?:AKIA|sk-|ghp_)", 0), shaped(F.regexp_replace(entity, "^(?:AKIA|sk-|ghp_)", ""), own))
    )
    return (
        F.when(kind == "email", email).when(kind == "name", _name(entity, attempt, digest)).when(kind == "secret", secret)
        .when(kind == "iban", iban).when(kind == "card", _checked(entity, shaped(entity, own)))
        .when(kind == "phone", phone).when(kind == "ip", F.array_join(octets, ".")).otherwise(shaped(entity, own))
    )


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def shaped(value: Column, digest: Column) -> Column:
    """Digits become digits and letters letters of the same case and script; the n-th of them takes the digest's n-th byte."""

    def step(state, c):
        byte = _byte(digest, state.n)
        letter = lambda first, count: F.chr(F.lit(ord(first)) + byte % count)
        wide = lambda first: F.substring(F.lit("".join(chr(ord(first) + i) for i in range(32))), byte % 32 + 1, F.lit(1))
        new = (
            F.when(c.rlike("[0-9]"), letter("0", 10)).when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), wide("А")).otherwise(wide("а")))
            .when(c.rlike(r"\p{Lu}"), letter("A", 26)).when(c.rlike(r"\p{L}"), letter("a", 26)).otherwise(c)
        )
        return F.struct(F.concat(state.out, new).alias("out"), (state.n + c.rlike(r"[\p{L}\p{N}]").cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(F.split(value, ""), start, step, lambda s: s.out)


def _luhn(number: Column) -> Column:
    """Sum of a number's digits for its check digit, every second one from the right doubled."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _checked(old: Column, new: Column) -> Column:
    """``new`` with a right check digit if ``old`` has one."""
    zeroed = F.concat(F.left(new, F.length(new) - 1), F.lit("0"))
    right = F.concat(F.left(new, F.length(new) - 1), ((F.lit(10) - _luhn(zeroed) % 10) % 10).cast("string"))
    return F.when(_luhn(old) % 10 == 0, right).otherwise(new)


def _name(entity: Column, attempt: Column, digest) -> Column:
    title = F.regexp_extract(entity, rf"^(?:{_TITLE})\.? ", 0)
    rest = F.substring(entity, F.length(title) + 1, F.length(entity))
    words = F.split(rest, "[ -]")
    family, given = F.element_at(words, -1), F.when(F.size(words) > 1, words[0])
    between = F.regexp_extract(rest, "[ -]", 0)
    male = title.rlike(rf"^(?:{'|'.join(TITLES['m'])})\.? ")
    cyrillic = rest.rlike(r"\p{IsCyrillic}")

    def pick(options: dict, of: Column, i) -> Column:
        at = lambda names: F.element_at(F.array(*map(F.lit, names)), _byte(of, i) % len(names) + 1)
        return F.when(cyrillic, at(options["cyrillic"])).otherwise(at(options["latin"]))

    first_of = digest(F.lit("given"), F.lower(given))
    first = F.when(male, pick(GIVEN["m"], first_of, F.lit(0))).otherwise(pick(GIVEN["f"], first_of, F.lit(0)))
    own = digest(F.lit("family"), F.lower(family), attempt.cast("string"))
    last = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: pick(SYLLABLES, own, i)), ""))
    return F.concat(title, F.when(F.size(words) > 1, F.concat(first, between)).otherwise(""), last)
