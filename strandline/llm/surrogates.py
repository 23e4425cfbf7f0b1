"""Surrogates for personal data: detected entities get keyed replacements of the same type and format.

An entity is a type and a canonical value (case and separators aside), so all mentions of it, anywhere, get one
surrogate (coreference); a keyed digest (HMAC-SHA-512) of the entity decides it, so it can't be undone or recomputed
without the key and is the same in every run. Surrogates of different entities differ, and none is itself a value found
in the data: candidates that clash are drawn again until no clash is left (distinctness). Where a format has no room
left, such as one-letter mailboxes of one domain, later draws are longer than the value.

Patterns are bounded or possessive, so a text costs time in proportion to its length whatever it holds. Bounds: 256
characters before an address's @, 20 labels after it.

Only DataFrame functions. One cheap test leaves out texts that can't hold an entity; only texts that do are shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Stage, table

#: Key of the registered query, unless the session sets this. Anybody can read it: for data that matters set a secret one.
KEY_SETTING = "spark.strandline.surrogate.key"
TEST_KEY = "published key for synthetic tables"
#: Draws in the value's own format; those after them are longer by a character each.
IN_FORMAT = 4

# Titles, by the gender that they tell.
MALE_TITLES = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "M", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof")

_TITLES = "|".join(sorted({x for t in (*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES) for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+"
# Beginnings of keys that services issue, and what follows them; words that a secret is assigned to;
# countries whose account numbers are a whole number of fours; country codes of telephones.
KEYS = (
    ("(?:AKIA|ASIA)", "[0-9A-Z]{16}"),
    ("gh[oprsu]_", "[0-9A-Za-z]{20,255}"),
    ("github_pat_", "[0-9A-Za-z_]{20,255}"),
    ("glpat-", "[0-9A-Za-z_-]{20,64}"),
    ("xox[abeoprs]-", "[0-9A-Za-z-]{10,250}"),
    ("AIza", "[0-9A-Za-z_-]{35}"),
    ("sk-", "[0-9A-Za-z_-]{20,250}"),
    ("[rs]k_(?:live|test)_", "[0-9A-Za-z]{10,250}"),
    ("npm_", "[0-9A-Za-z]{36}"),
    ("hf_", "[0-9A-Za-z]{30,40}"),
)
_PREFIX = "|".join(p for p, _ in KEYS)
_KEY = "|".join(p + rest for p, rest in KEYS)
_ASSIGNED = r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?"
_FOURS = "AD|AL|AT|AZ|BA|BE|CY|CZ|DO|EE|ES|GE|GT|HU|KZ|LB|LT|LU|MD|PK|PL|RO|SA|SE|SK|SV|TN|VG|XK"
_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_END = "(?![0-9A-Za-z])"
_HEX = r"(?=[A-Fa-f]{0,127}+[0-9])[0-9A-Fa-f]{32,128}"
#: Tried in this order at each place. Only the card's pattern has groups that are counted.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@(?:[A-Za-z0-9-]{1,63}+\.){1,20}[A-Za-z]{2,63}",
    "secret": rf"(?<![0-9A-Za-z])(?:{_HEX}|{_KEY}){_END}|(?<=[:= \"'])(?=[0-9A-Za-z+/_.-]{{0,63}}[0-9])(?=[0-9A-Za-z+/_.-]{{8}})(?<={_ASSIGNED})[0-9A-Za-z+/_.-]{{7,127}}[0-9A-Za-z+/_=-]",
    "iban": rf"(?<![0-9A-Za-z])(?:(?:{_FOURS})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}{_END}|[A-Z]{{2}}[0-9]{{2}}(?:(?: ?[A-Z0-9]{{4}}){{3,7}}(?:[A-Z0-9]{{1,3}}| (?=[A-Z]{{0,2}}[0-9])[A-Z0-9]{{1,3}})?|(?: ?[A-Z0-9]{{4}}){{2}} ?[0-9]{{3}}){_END})",
    "card": rf"(?<![0-9A-Za-z])(?:[0-9]{{4}}([ -]?)[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{4}}|3[47][0-9]{{2}}([ -]?)[0-9]{{6}}\2[0-9]{{5}}|3(?:0[0-5]|[689][0-9])[0-9]([ -]?)[0-9]{{6}}\3[0-9]{{4}}|(?:5[0678]|6[237])[0-9]{{2}}([ -]?)[0-9]{{4}}\4[0-9]{{4}}\4[0-9]{{4}}\4[0-9]{{1,3}}|4[0-9]{{12}}(?:[0-9]{{6}})?){_END}",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{0,3}[0-9])[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}:(?::[0-9A-Fa-f]{1,4}){1,6}|[Ff][Ee]80:(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": rf"(?<![0-9A-Za-z])(?:(?:\+[0-9]{{1,3}}[ -]?)?(?:\([0-9]{{2,4}}\) ?|[0-9]{{3}}[ -])[0-9]{{3}}[ -][0-9]{{4}}|[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}}|\+[1-9](?:[ .-]?\(?[0-9]\)?){{7,14}}){_END}",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "person": rf"(?<![\p{{L}}0-9])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?",
}
#: No entity begins within a word, so places there fail at once.
ANY = f"(?<![0-9A-Za-z])(?:{'|'.join(f'(?:{p})' for p in PATTERNS.values())})"
_FIRST = "".join(sorted({t[0] for t in _TITLES.split("|")}))
#: Every entity holds a digit or an @, or begins with a title or a key's beginning; the first look is at one or two letters.
POSSIBLE = rf"[0-9@]|(?=A[KSI]|g[hil]|xo|[rs]k|np|hf|[{_FIRST}])(?:{_PREFIX}|(?<![\p{{L}}])(?:{_TITLES})\.? \p{{Lu}})"

# Letters that syllables of invented names are made of, and the endings that tell a gender.
SYLLABLES = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"male": "n", "female": "a", "other": "e"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"male": "н", "female": "а", "other": "е"}),
    "greek": ("βγδζκλμνπρστ", "αειου", {"male": "ς", "female": "α", "other": "ι"}),
}


def kind_of(value: Column) -> Column:
    """The kind of a mention; what no pattern matches alone was found by the word that it is assigned to."""
    out = F.when(value.rlike(f"^(?:{PATTERNS['person']})$"), "person").otherwise("secret")
    for name, pattern in reversed([p for p in PATTERNS.items() if p[0] != "person"]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^({_TITLES})\.? ", 1)


def canonical(kind: Column, value: Column) -> Column:
    """What makes mentions the same entity: letters in lower case; numbers without separators; issued keys as they are; of persons the name, and
    the gender that the title tells."""
    title = _title(value)
    gender = F.when(F.upper(title).isin(*(t.upper() for t in MALE_TITLES)), "male").when(F.upper(title).isin(*(t.upper() for t in FEMALE_TITLES)), "female").otherwise("other")
    name = F.lower(F.regexp_replace(value, rf"^(?:{_TITLES})\.? ", ""))
    bare = F.regexp_replace(value, "[^0-9A-Za-z]", "")
    country = F.regexp_extract(value, rf"^\+({_CODE})", 1)
    bare = F.when((kind == "phone") & (country != ""), F.concat_ws(":", country, F.substring(bare, F.length(country) + 1, F.length(bare)))).otherwise(bare)
    return F.when(kind == "person", F.concat_ws(":", gender, name)).when((kind == "secret") & ~value.rlike("^[0-9A-Fa-f]{32,128}$"), value).when(kind.isin("email", "secret", "ipv6"), F.lower(value)).when(kind == "ip", value).otherwise(F.upper(bare))


def _digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal."""
    block = key.encode()
    block = (hashlib.sha512(block).digest() if len(block) > 128 else block).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\x1f", kind, value, attempt.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _disguised(value: str, digest: str) -> str:
    """SQL: each digit of value becomes another digit, each letter a letter, as the digest's bytes tell."""
    byte = f"cast(conv(substr({digest}, 1 + 2 * (i % 64), 2), 16, 10) as int)"
    return f"""array_join(transform(split({value}, ''), (c, i) ->
        CASE WHEN c RLIKE '[0-9]' THEN substr('0123456789', 1 + {byte} % 10, 1)
             WHEN c RLIKE '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', 1 + {byte} % 26, 1)
             WHEN c RLIKE '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {byte} % 26, 1)
             ELSE c END), '')"""


def _hex(value: str, digest: str) -> str:
    return f"substr(concat({digest}, {digest}), 1, length({value}))"


def _word(name: str, digest: str, last: str, n: int = 3) -> str:
    """SQL: an invented word of n syllables in the script of name."""

    def letters(script: str) -> str:
        consonants, vowels, ends = SYLLABLES[script]
        parts = []
        for k in range(n):
            at = f"cast(conv(substr({digest}, {1 + 8 * k}, 4), 16, 10) as int)"
            parts += [f"substr('{consonants}', 1 + {at} % {len(consonants)}, 1)", f"substr('{vowels}', 1 + ({at} div {len(consonants)}) % {len(vowels)}, 1)"]
        ending = "CASE " + " ".join(f"WHEN {last} = '{g}' THEN '{e}'" for g, e in ends.items()) + " ELSE '' END"
        return f"concat({', '.join(parts)}, {ending})"

    return f"CASE WHEN {name} RLIKE '\\\\p{{IsCyrillic}}' THEN {letters('cyrillic')} WHEN {name} RLIKE '\\\\p{{IsGreek}}' THEN {letters('greek')} ELSE {letters('latin')} END"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, attempt) with s added, the canonical surrogate."""
    more = f"substr(translate(d, 'abcdef', '012345'), 100, greatest(0, attempt - {IN_FORMAT - 1}))"
    out = entities.withColumn("d", _digest(key, F.col("kind"), F.col("canon"), F.col("attempt")))
    # parts that other entities share keep their own surrogate: an address's domain, a person's last and given name
    out = out.withColumn("part", F.when(F.col("kind") == "email", F.regexp_extract("canon", "@(.*)[.][a-z]+$", 1)).when(F.col("kind") == "person", F.regexp_extract("canon", "([^ :]+)$", 1)))
    out = out.withColumn("dp", _digest(key, F.lit("part"), F.coalesce("part", F.lit("")), F.lit(0)))
    out = out.withColumn("given", F.regexp_extract("canon", "^[a-z]+:([^ ]+) ", 1)).withColumn("gender", F.regexp_extract("canon", "^([a-z]+):", 1))
    out = out.withColumn("dg", _digest(key, F.col("gender"), F.col("given"), F.col("attempt")))
    octet = lambda k, n, low: f"cast({low} + cast(conv(substr(d, {1 + 8 * k}, 8), 16, 10) as bigint) % {n} as string)"
    luhn = "(10 - aggregate(sequence(1, length(x) - 1), 0L, (a, i) -> a + CASE WHEN (length(x) - i) % 2 = 1 THEN (2 * cast(substr(x, i, 1) as int)) div 10 + (2 * cast(substr(x, i, 1) as int)) % 10 ELSE cast(substr(x, i, 1) as bigint) END) % 10) % 10"
    out = out.withColumn("x", F.expr(f"""concat(CASE
        WHEN kind IN ('card', 'ssn') THEN concat(substr(canon, 1, 1), substr({_disguised('canon', 'd')}, 2))
        WHEN kind = 'phone' AND canon LIKE '%:%' THEN concat(substring_index(canon, ':', 1), ':', {_disguised("substring_index(canon, ':', -1)", 'd')})
        WHEN kind = 'phone' THEN {_disguised('canon', 'd')}
        WHEN kind = 'iban' THEN concat(substr(canon, 1, 2), substr({_disguised('canon', 'd')}, 3)) END, {more})"""))
    return out.select("kind", "canon", "attempt", F.expr(f"""CASE
        WHEN kind = 'email' THEN concat({_disguised("substring_index(canon, '@', 1)", 'd')}, {more}, '@', {_disguised('part', 'dp')}, regexp_extract(canon, '([.][a-z]+)$', 1))
        WHEN kind = 'secret' AND canon RLIKE '^[0-9a-f]{{32,128}}$' THEN concat({_hex('canon', 'd')}, {more})
        WHEN kind = 'secret' THEN concat(regexp_extract(canon, '^({_PREFIX})', 1), {_disguised(f"regexp_replace(canon, '^({_PREFIX})', '')", 'd')}, {more})
        WHEN kind = 'ipv6' THEN concat(substr(canon, 1, 1), array_join(transform(split(substr(canon, 2), ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE substr(d, 1 + i, 1) END), ''))
        WHEN kind = 'ip' THEN concat_ws('.', {octet(0, 223, 1)}, {octet(1, 256, 0)}, {octet(2, 256, 0)}, {octet(3, 254, 1)})
        WHEN kind = 'card' THEN concat(substr(x, 1, length(x) - 1), cast({luhn} as string))
        WHEN kind = 'person' THEN concat(gender, ':', CASE WHEN given <> '' THEN concat({_word('given', 'dg', 'gender')}, ' ') ELSE '' END,
            CASE WHEN attempt = 0 OR given <> '' AND attempt < {IN_FORMAT} THEN {_word('part', 'dp', "''", 4)} ELSE {_word('part', 'd', "''", 5)} END)
        ELSE x END""").alias("s"))  # fmt: skip


def assign(stage: Stage, entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, canon, s): different entities of a kind have different surrogates, none of which is an entity. An entity
    whose candidate clashes draws again, the least of those with one candidate excepted. After IN_FORMAT draws each one
    is a character longer, so that the share that clashes falls at least tenfold a round."""
    known = stage.write(entities.select("kind", "canon"), "entities")
    now = stage.write(surrogates(known.withColumn("attempt", F.lit(0)), key), "assigned0")
    for k in range(rounds):
        keepers = now.groupBy("kind", "s").agg(F.min("canon").alias("canon"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lose = now.join(keepers.select("kind", "s", F.col("canon").alias("keeper")), ["kind", "s"]).filter("canon <> keeper").select("kind", "canon")
        real = known.select("kind", F.col("canon").alias("s"))
        again = stage.write(lose.unionByName(now.join(real, ["kind", "s"], "left_semi").select("kind", "canon")).distinct(), f"again{k}")
        if again.isEmpty():
            return now
        moved = surrogates(now.join(again, ["kind", "canon"], "left_semi").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), key)
        now = stage.write(now.join(again, ["kind", "canon"], "left_anti").unionByName(moved), f"assigned{k + 1}")
        stage.drop(f"assigned{k}")
        stage.drop(f"again{k}")
    raise ValueError("surrogates still clash; the key leaves no room")


def _in_format() -> str:
    """SQL: the canonical surrogate s written as the mention v is: separators, country code and case kept."""
    digits = """array_join(transform(split(v, ''), (c, i) -> CASE WHEN c RLIKE '[0-9A-Za-z]'
        THEN substr(replace(s, ':', ''), length(regexp_replace(substr(v, 1, i + 1), '[^0-9A-Za-z]', '')), 1) ELSE c END), '')"""
    digits = f"concat({digits}, substr(replace(s, ':', ''), 1 + length(regexp_replace(v, '[^0-9A-Za-z]', ''))))"
    name = "initcap(substring_index(s, ':', -1))"
    title = f"regexp_extract(v, '^((?:{_TITLES})\\\\.? )', 1)"
    return f"""CASE
        WHEN kind = 'person' THEN concat({title}, CASE WHEN v = upper(v) THEN upper({name}) ELSE {name} END)
        WHEN kind = 'ip' THEN s
        WHEN kind = 'secret' AND NOT v RLIKE '^[0-9A-Fa-f]{{32,128}}$' THEN s
        WHEN kind IN ('email', 'secret', 'ipv6') THEN CASE WHEN v = upper(v) AND v <> lower(v) THEN upper(s) ELSE s END
        ELSE {digits} END"""


def replace_personal_data(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced and n_entities added, the number of mentions; key is a secret of any length.

    Null and empty texts, and texts without an entity, are unchanged. Equal texts get the same result, repeated rows
    among them; ids don't matter. Empty table: no rows. Other columns pass through, whatever their names; a column of
    docs that is called n_entities is replaced."""
    stage = Stage(spark)
    others = [c for c in docs.columns if c.lower() not in ("text", "n_entities")]
    row = F.struct(*(docs[f"`{c}`"] for c in others)) if others else F.lit(None)
    rows = docs.select(row.alias("_row"), docs["text"].cast("string").alias("t"))
    possible = F.coalesce(F.col("t").rlike(POSSIBLE), F.lit(False))
    hashes = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")]
    found = rows.filter(possible).select(*hashes, F.regexp_extract_all("t", F.lit(ANY), F.lit(0)).alias("found")).filter(F.size("found") > 0)
    found = found.groupBy("h1", "h2").agg(F.first("found").alias("found"))
    mentions = found.select("h1", "h2", F.posexplode("found").alias("i", "v")).withColumn("kind", kind_of(F.col("v")))
    mentions = stage.write(mentions.withColumn("canon", canonical(F.col("kind"), F.col("v"))), "mentions")
    assigned = assign(stage, mentions.select("kind", "canon").distinct(), key)
    told = mentions.join(assigned.select("kind", "canon", "s"), ["kind", "canon"]).select("h1", "h2", "i", F.expr(_in_format()).alias("r"))
    books = stage.write(told.groupBy("h1", "h2").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda x: x["r"]).alias("book")), "books")

    joined = rows.filter(possible).select("_row", "t", *hashes).join(books, ["h1", "h2"], "left")
    joined = joined.withColumn("p", F.when(F.col("book").isNotNull(), F.split("t", ANY, -1)))
    rebuilt = F.expr("array_join(transform(p, (x, i) -> concat(x, coalesce(get(book, i), ''))), '')")
    columns = [F.col("_row")[c].alias(c) for c in others]
    done = joined.select(*columns, F.when(F.col("book").isNull(), F.col("t")).otherwise(rebuilt).alias("text"), F.coalesce(F.size("book"), F.lit(0)).cast("long").alias("n_entities"))
    rest = rows.filter(~possible).select(*columns, F.col("t").alias("text"), F.lit(0).cast("long").alias("n_entities"))
    return done.unionByName(rest)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    return replace_personal_data(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), key)
