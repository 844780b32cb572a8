"""PII surrogates: keyed, type-consistent replacements for detected entities.

Detection is a set of ordered patterns, linear in the text; card and account
numbers count only if their check digits are right. A mention consists of one
part, or of two if it names a person in full: given name and family name are
entities of their own, so "Mr Ann Lee" and "Mr Lee" stay one family.

Every distinct entity of a type gets one surrogate, a keyed function of (type,
normal form, attempt). Digits stay digits and letters letters of their case;
check digits are made right again; names are built from syllables of their
script, given names with an ending of the gender that the title tells. Where two
entities would share a surrogate, or a surrogate would equal an entity of the
corpus, in normal form, all but the first try again with the next attempt, until
none clashes: distinct entities stay distinct, and equal ones stay equal
everywhere. Each mention is then written in its own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let
from ..session import materialize
from .rows import join_keys, keyed

KEY = "cairn-surrogates-1"

MALE, FEMALE, EITHER = "Mr|Herr|M|Sr", "Mrs|Ms|Miss|Frau|Mme|Sra", "Dr"
WORD = r"\p{Lu}\p{L}+(?:['’\-]\p{L}+)*+"
#: Entity types in order of precedence: where two could match at one place, the first does.
PATTERNS = {
    # A possessive run from its left end on: a long run without @ is read once, not once from each of its letters.
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "credential": r"(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_?key)\s*+[=:]\s*+\"?[A-Za-z0-9_\-]{8,}+\"?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ \-.]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ \-.]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z\-])[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-]?){3}[0-9]{1,7}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE}|{EITHER})\.? {WORD}(?: {WORD})?+",
}
ANY = "|".join(f"({p})" for p in PATTERNS.values())

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
NUMBERS = ("card", "phone", "ssn", "iban")
NAMES = ("given_m", "given_f", "given_u", "family")

#: For each script: consonants, vowels, and the endings of male, female and other given names and of family names.
SYLLABLES = {
    r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу", (("н", "р", "с"), ("на", "ла", "ра"), ("ль", "ни"), ("ев", "ин", "ко"))),
    r"\p{IsGreek}": ("βγδζκλμνπρστ", "αεηιου", (("ος", "ης", "ας"), ("α", "η", "ω"), ("ι", "ον"), ("ου", "ίδης", "άκης"))),
    "": ("bdfgklmnprstvz", "aeiou", (("n", "r", "s", "ld"), ("na", "la", "ra", "sa"), ("el", "in"), ("er", "man", "sen", "tt"))),
}


def entity_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0))


def entity_type(entity: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        hit = entity.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("card")


def luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10; 0 for a valid number."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda t, d: t + d) % 10


def mod97(text: Column) -> Column:
    """A string of digits and capitals, A = 10 to Z = 35, as one number modulo 97."""
    values = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(DIGITS + UPPER), c) - 1)
    return F.aggregate(values, F.lit(0), lambda t, v: (t * F.when(v > 9, 100).otherwise(10) + v) % 97)


def is_entity(kind: Column, entity: Column) -> Column:
    """Whether the check digits of a card or account number are right; true for other types."""
    bare = F.regexp_replace(entity, r"[ \-]", "")
    iban = mod97(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))) == 1
    return F.when(kind == "card", luhn(bare) == 0).when(kind == "iban", iban).otherwise(True)


def parts_of(kind: Column, entity: Column) -> Column:
    """array<struct<kind, before, core, after>> of a mention: cores are replaced, labels, titles and domains around them stay."""
    part = lambda k, before, core, after: F.struct(k.alias("kind"), before.alias("before"), core.alias("core"), after.alias("after"))
    cut = lambda pattern: [F.regexp_extract(entity, pattern, i) for i in (1, 2, 3)]
    none = F.lit("")
    title, given, family = cut(rf"^((?:{MALE}|{FEMALE}|{EITHER})\.? )(?:({WORD}) )?({WORD})$")
    gender = F.when(title.rlike(rf"^(?:{MALE})\.? $"), "given_m").when(title.rlike(rf"^(?:{FEMALE})\.? $"), "given_f").otherwise("given_u")
    person = F.when(given == "", F.array(part(F.lit("family"), title, family, none))).otherwise(F.array(part(gender, title, given, F.lit(" ")), part(F.lit("family"), none, family, none)))
    credential = cut(r"^((?:password|passwd|secret|token|api_?key)\s*+[=:]\s*+\"?)([A-Za-z0-9_\-]+)(\"?)$")
    email = cut(r"^()([^@]*@[^.]*)(\..*)$")
    out = F.when(kind == "name", person).when(kind == "credential", F.array(part(kind, *credential))).when(kind == "email", F.array(part(kind, *email)))
    out = out.when(kind == "secret", F.array(part(kind, F.lit("AKIA"), F.substring(entity, 5, 99), none)))
    return out.otherwise(F.array(part(kind, none, entity, none)))


def normal_form(kind: Column, core: Column) -> Column:
    """What decides that two mentions are one entity: numbers without spacing, mails and names without case."""
    bare = F.regexp_replace(core, r"[^0-9A-Z+]", "")
    return F.when(kind.isin(*NUMBERS), bare).when(kind.isin("email", *NAMES), F.lower(core)).otherwise(core)


def _pick(options, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def _byte(digest: Column, i) -> Column:
    """The i-th byte of a digest in hex."""
    return F.conv(F.substr(digest, F.lit(2) * i + 1, F.lit(2)), 16, 10).cast("int")


def keyed_chars(text: Column, seed: Column) -> Column:
    """Each digit by a digit and each letter by a letter of its case; 32 characters take the bytes of one digest."""
    row = lambda c, letters, n: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))

    def swap(c: Column, n: Column) -> Column:
        return F.when(c.between("0", "9"), row(c, DIGITS, n)).when(c.between("a", "z"), row(c, LOWER, n)).when(c.between("A", "Z"), row(c, UPPER, n)).otherwise(c)

    def all_of(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / 32).cast("int"))
        return F.flatten(F.transform(starts, lambda b: let(F.sha2(F.concat_ws("|", seed, b.cast("string")).cast("binary"), 256), lambda d: F.transform(F.slice(chars, b * 32 + 1, F.lit(32)), lambda c, j: swap(c, _byte(d, j))))))

    return F.array_join(let(F.split(text, ""), all_of), "")


def name_mark(kind: Column, normal: Column, attempt: Column, seed: Column) -> Column:
    """A name in lower case: syllables of its script and an ending of its kind; each attempt adds a syllable, up to 12."""

    def made(digest: Column) -> Column:
        out = None
        for script, (consonants, vowels, endings) in SYLLABLES.items():
            syllables = F.transform(F.sequence(F.lit(1), F.least(attempt + 2, F.lit(12))), lambda i: F.concat(_pick(consonants, _byte(digest, i * 2)), _pick(vowels, _byte(digest, i * 2 + 1))))  # noqa: B023
            end = F.when(kind == NAMES[0], _pick(endings[0], _byte(digest, F.lit(0))))
            for k, e in zip(NAMES[1:], endings[1:], strict=True):
                end = end.when(kind == k, _pick(e, _byte(digest, F.lit(0))))
            name = F.concat(F.array_join(syllables, ""), end)
            out = F.when(normal.rlike(script), name) if out is None else out.when(normal.rlike(script), name)
        return out

    return let(F.sha2(seed.cast("binary"), 256), made)


def surrogate(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity, in normal form."""
    seed = F.concat_ws("|", F.lit(key), kind, normal, attempt.cast("string"))
    swapped = keyed_chars(normal, seed)
    card = let(F.concat(F.substring(normal, 1, 1), F.substr(swapped, F.lit(2), F.char_length(normal) - 2)), lambda body: F.concat(body, (F.pmod(10 - luhn(F.concat(body, F.lit("0"))), F.lit(10))).cast("string")))
    lead = F.when(normal.startswith("+"), 2).otherwise(1)
    phone = F.concat(F.substr(normal, F.lit(1), lead), F.substr(swapped, lead + 1, F.char_length(normal)))
    country = F.substring(normal, 1, 2)
    iban = let(F.substring(swapped, 5, 99), lambda body: F.concat(country, F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body))
    digest = F.sha2(seed.cast("binary"), 256)
    quads = F.concat_ws(".", *[(F.pmod(_byte(digest, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)])
    out = F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ip", quads)
    return out.when(kind.isin(*NAMES), name_mark(kind, normal, attempt, seed)).otherwise(swapped)


def written(kind: Column, core: Column, mark: Column) -> Column:
    """A surrogate in the format of one mention: the spacing of numbers, the case of mails and names."""
    chars = F.split(core, "")
    # The order of a character among those that count; numbers are short by their patterns.
    order = lambda i: F.char_length(F.regexp_replace(F.substr(core, F.lit(1), i), r"[^0-9A-Z+]", ""))
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Z+]"), F.substr(mark, order(i) + 1, F.lit(1))).otherwise(c)), "")
    mail = let(F.split(mark, ""), lambda m: F.array_join(F.transform(chars, lambda c, i: F.when(c.between("A", "Z"), F.upper(F.get(m, i))).otherwise(F.get(m, i))), ""))
    name = F.when(F.upper(core) == core, F.upper(mark)).otherwise(F.concat(F.upper(F.substring(mark, 1, 1)), F.substring(mark, 2, 999)))
    return F.when(kind.isin(*NUMBERS), number).when(kind == "email", mail).when(kind.isin(*NAMES), name).otherwise(mark)


def surrogate_table(entities: DataFrame, key: str = KEY, rounds: int = 50) -> DataFrame:
    """``kind, normal, mentions, mark, masked`` for entities(kind, normal): marks that clash with no other and no entity.

    An entity without a free surrogate after all rounds (its format has fewer
    forms than there are entities) is masked by a digest of its own.
    """
    known = materialize(entities.groupBy("kind", "normal").agg(F.count("*").alias("mentions")), "entities")
    taken = known.select("kind", F.col("normal").alias("mark"))
    fixed, open_ = None, known.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        made = materialize(open_.withColumn("mark", surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key)), "marks")
        first = made.groupBy("kind", "mark").agg(F.min("normal").alias("normal"))
        used = taken if fixed is None else taken.unionByName(fixed.select("kind", "mark"))
        free = materialize(first.join(used, ["kind", "mark"], "left_anti"), "free")
        good = made.join(free, ["kind", "mark", "normal"], "left_semi").select("kind", "normal", "mentions", "mark")
        fixed = materialize(good if fixed is None else fixed.unionByName(good), "fixed")
        left = made.join(free, ["kind", "mark", "normal"], "left_anti")
        open_ = materialize(left.select("kind", "normal", "mentions", (F.col("attempt") + 1).alias("attempt")), "open")
        if open_.isEmpty():
            return fixed.withColumn("masked", F.lit(False))
    mask = F.sha2(F.concat_ws("|", F.lit(key), "kind", "normal").cast("binary"), 256)
    return fixed.withColumn("masked", F.lit(False)).unionByName(open_.select("kind", "normal", "mentions", mask.alias("mark"), F.lit(True).alias("masked")))


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, n_entities, kinds, text`` for each row of docs(doc_id, text); text has surrogates for its entities.

    Mentions that differ in spacing (numbers) or case (mails, names) are one
    entity and get one surrogate, each written in its own format. A full name
    counts once. kinds are the sorted distinct types found. Names of scripts
    other than Cyrillic and Greek get Latin syllables.

    A null text stays null with no entities; an empty one stays empty. A null
    doc_id is an ordinary document and repeated rows have equal results.
    Entities at the same place never overlap: the first pattern in order wins.
    An empty table gives an empty table. Other columns are ignored.
    """
    rows = keyed(docs).withColumn("found", entity_array(F.col("text")))
    mentions = rows.where(F.size("found") > 0).select("did", "tkey", F.posexplode("found").alias("at", "entity")).distinct().withColumn("kind", entity_type(F.col("entity")))
    mentions = materialize(mentions.withColumn("real", is_entity(F.col("kind"), F.col("entity"))), "mentions")
    parts = mentions.where("real").select("did", "tkey", "at", F.posexplode(parts_of(F.col("kind"), F.col("entity"))).alias("order", "p")).select("did", "tkey", "at", "order", "p.*")
    parts = materialize(parts.withColumn("normal", normal_form(F.col("kind"), F.col("core"))), "parts")
    table = materialize(surrogate_table(parts.select("kind", "normal"), key), "surrogates")
    placed = join_keys(parts, table, ["kind", "normal"], "mentions")
    new = F.concat("before", F.when(F.col("masked"), F.col("mark")).otherwise(written(F.col("kind"), F.col("core"), F.col("mark"))), "after")
    whole = placed.groupBy("did", "tkey", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order", new.alias("new")))), lambda x: x["new"]), "").alias("new"))
    whole = mentions.select("did", "tkey", "at", "kind").where("real").join(whole, ["did", "tkey", "at"]).unionByName(mentions.where("not real").select("did", "tkey", "at", F.lit(None).cast("string").alias("kind"), F.col("entity").alias("new")))
    gathered = whole.groupBy("did", "tkey").agg(F.sort_array(F.collect_list(F.struct("at", "new", "kind"))).alias("m"))
    joined = rows.drop("found").join(gathered, ["did", "tkey"], "left")
    kinds = F.filter(F.transform("m", lambda x: x["kind"]), lambda k: k.isNotNull())
    woven = F.array_join(F.transform(F.split(F.col("text"), ANY), lambda p, i: F.concat(p, F.coalesce(F.get("m", i)["new"], F.lit("")))), "")
    return joined.select(
        "doc_id",
        F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"),
        F.when(F.col("m").isNull(), F.col("text")).otherwise(woven).alias("text"),
    )


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.greatest("n_entities", F.lit(0)).alias("n_entities"), F.array_join("kinds", ",").alias("kinds"), "text")
