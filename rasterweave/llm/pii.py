"""Surrogates for personal data, in DataFrame functions only.

Entities are found by patterns: secrets (access keys, and values assigned to
passwords, tokens and the like), e-mail addresses, keys of 32 to 64 hexadecimal
digits, IPv4 and IPv6 addresses, telephone numbers, social security numbers,
IBANs, account and card numbers, and names that follow a form of address or "My
name is".  A name of several words that a text introduces so is also found where
it stands alone in the same text.

What stays of an entity without prefix, case, blanks and separators is its
canonical form: all spellings of one entity get the same surrogate in the whole
table, and words of names are mapped one by one, so that "Mrs Anna Smith" and
"Mrs Smith" keep their common part (coreference).  A surrogate has the type,
length, separators, case and script of its entity: digits for digits, letters
for letters of the same alphabet, vowels for vowels in names; addresses keep
valid octets and the lengths of octets, e-mail addresses their last label and one
surrogate a domain, telephone numbers their country code, accounts their first
digit and IBANs their country, and both a right check digit where they had one.
The first of several words of a name gets an ending of the gender that its form
of address tells (in any of its rows; where they disagree, the male one).

Distinctness: within a form (which places hold what) the surrogate is a keyed
permutation of all that has the form: a Feistel network whose halves are added
letter by letter.  So no two entities share a surrogate, however full a space
is, no draw has to be repeated, and the same key gives the same surrogates in
another table.  The permutation is conjugated to a shift, so that no entity is
its own surrogate (unless its form has one member only).  A surrogate may be
another entity of the corpus: in a space that is full no other choice is left.
The table of surrogates is checked for collisions nevertheless.

Defined cases: a null text stays null, an empty one empty, with 0 entities;
repeated rows are treated alike; very long texts are searched whole; an empty
table gives an empty result; columns of the input are kept, and ``n_entities``
and ``entities`` replace columns of those names.  Letters of alphabets that are
not among ``ALPHABETS`` stay.  No table with found entities outlives the call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Forms of address and the gender they tell.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "г-н", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "Госпожа")
EITHER = ("Dr", "Prof")
TITLE = r"(?:(?:" + "|".join(MALE + FEMALE + EITHER) + r")\.?|[Mm]y name is) "
NAME = r"\p{Lu}\p{L}+(?:[ \-]\p{Lu}\p{L}+){0,2}"
ASSIGNED = r"(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[\"']? ?[=:] ?[\"']?"
#: Patterns by type, in order of precedence; all begin where a word may.
PATTERNS = {
    "secret": r"(?:AKIA[0-9A-Z]{16}|gh[opsur]_[0-9A-Za-z]{36,255})(?![\p{L}\d])|" + ASSIGNED + r"(?=[^\s\"']{0,128}\d)[^\s\"',;<>]{6,128}",
    "email": r"[\p{L}\d._%+\-]+@[A-Za-z\d\-]+(?:\.[A-Za-z\d\-]+)*\.[A-Za-z]{2,}",
    "key": r"[0-9a-fA-F]{32,64}(?![\p{L}\d])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![:.])(?=[a-fA-F:]{0,40}\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}|(?:[0-9a-fA-F]{1,4}:){1,7}:)(?![\p{L}\d:])",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{2,4}(?:[ .\-]\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![.\-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![\d\-]|\.\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d\-])",
    "iban": r"[A-Z]{2}\d{2}(?=(?:[A-Z ]{0,12}\d){8})(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
    "account": r"(?<![.\-])\d(?:[ \-]?\d){12,18}(?![\d\-:\p{L}])",
    "name": TITLE + NAME,
}
START = r"(?<![\p{L}\d])"


def _any(more: str = "") -> str:
    return START + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + more


ANY = _any(")")
#: Cheap test that every entity passes: two digits near each other, a mark of a
#: kind, or a form of address.
HINT = r"\d[ .()\-]{0,3}\d|@|::|" + START + r"(?:[0-9a-fA-F]{32}|AKIA|gh[opsur]_|" + ASSIGNED + "|" + TITLE + r"\p{Lu})"
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdef"
#: Letters are replaced within their set.
ALPHABETS = (DIGITS, LETTERS, LETTERS.upper(), "абвгдежзийклмнопрстуфхцчшщъыьэюя", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي")
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "àáâãäåèéêëìíîïòóôõöùúûü", "çñ", *ALPHABETS[5:])
#: Endings that tell the gender, by script; their last letters differ.
ENDINGS = {"latin": ("na", "ton", "le"), "cyrillic": ("на", "тон", "ль")}


def _type_of(value: Column) -> Column:
    out = F.lit("secret")
    # A name alone has letters only; what is left was assigned to a secret.
    out = F.when(F.regexp_like(value, F.lit(f"^(?:{TITLE})?{NAME}$")), "name").otherwise(out)
    for kind, pattern in reversed(list(PATTERNS.items())):
        if kind != "name":
            out = F.when(F.regexp_like(value, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return F.when(F.regexp_like(value, F.lit(f"^{ASSIGNED}(?:[0-9a-f]+|[0-9A-F]+)$")), "key").otherwise(out)


def _prefix(kind: Column, value: Column) -> Column:
    """What stands before the entity proper and stays."""
    return F.when(kind == "name", F.regexp_extract(value, f"^{TITLE}", 0)).when(kind.isin("secret", "key"), F.regexp_extract(value, f"^{ASSIGNED}", 0)).otherwise("")


def _canonical(kind: Column, value: Column) -> Column:
    bare = F.substring(value, F.length(_prefix(kind, value)) + 1, F.length(value))
    plain = F.lower(F.regexp_replace(bare, r"[ .()\-+]", ""))
    # The country code is set off, to be kept.
    phone = F.concat(F.regexp_replace(F.regexp_extract(value, r"^\+(\d{1,3})[^\d]", 1), "$", "#"), F.regexp_replace(F.regexp_replace(value, r"^\+\d{1,3}(?=[^\d])", ""), r"[^\d]", ""))
    iban = F.upper(F.regexp_replace(value, " ", ""))
    return F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind == "ip", value).when(kind == "name", F.lower(bare)).when(kind == "secret", bare).when(kind == "phone", phone).when(kind == "iban", iban).otherwise(plain)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _symbol(token: Column, v: Column, m: Column, pool: Column, base: Column) -> Column:
    """A place of an entity: its token, and which of the m tokens that may stand
    there it is (of pool, or of the numbers from base); m = 1 stays as it is."""
    return F.struct(token.alias("c"), v.cast("int").alias("v"), m.cast("int").alias("m"), pool.alias("pool"), base.cast("int").alias("base"))


def _fixed(token: Column) -> Column:
    return _symbol(token, F.lit(0), F.lit(1), F.lit(""), F.lit(0))


def _number(token: Column, low: Column | int, m: Column | int) -> Column:
    low, m = (F.lit(x) if isinstance(x, int) else x for x in (low, m))
    return _symbol(token, token.cast("int") - low, m, F.lit(""), low)


def _letter(c: Column, sets: tuple[str, ...]) -> Column:
    out = _fixed(c)
    for pool in reversed(sets):
        at = F.instr(F.lit(pool), c)
        out = F.when((c != "") & (at > 0), _symbol(c, at - 1, F.lit(len(pool)), F.lit(pool), F.lit(0))).otherwise(out)
    return out


def _letters(text: Column, sets: tuple[str, ...]) -> Column:
    return F.transform(F.split(text, ""), lambda c: _letter(c, sets))


def _parts(kind: Column, canon: Column) -> Column:
    """What of an entity is permuted, each part by itself: tweak, syms."""
    part = lambda tweak, syms: F.struct(tweak.alias("tweak"), syms.alias("syms"))
    one = lambda syms: F.array(part(F.lit(""), syms))
    local, domain = F.regexp_extract(canon, "^(.*)@", 1), F.regexp_extract(canon, "@(.*)[.]", 1)
    email = F.array(part(F.lit("domain"), _letters(domain, ALPHABETS)), part(domain, _letters(local, ALPHABETS)))
    octet = lambda o: F.when(o == ".", _fixed(o)).when(F.length(o) == 3, _number(o, 100, 156)).when(F.length(o) == 2, _number(o, 10, 90)).otherwise(_number(o, 0, 10))
    ip = F.transform(F.regexp_extract_all(canon, F.lit(r"\d+|\."), F.lit(0)), octet)
    code = F.instr(canon, "#")
    digit = lambda c, i: F.when(i < code, _fixed(c)).when(i > code, _number(c, 0, 10)).when(c >= "2", _number(c, 2, 8)).otherwise(_number(c, 0, 2))
    phone = F.transform(F.split(canon, ""), digit)
    # The last digit of an account as its distance from the check digit.
    off = F.pmod(F.substring(canon, -1, 1).cast("int") - _check_digit(F.substring(canon, F.lit(1), F.length(canon) - 1)), F.lit(10))
    last = F.when(off == 0, _fixed(F.lit("0"))).otherwise(_number(off.cast("string"), 1, 9))
    body = F.transform(F.split(F.substring(canon, F.lit(1), F.length(canon) - 1), ""), lambda c, i: F.when(i == 0, _fixed(c)).otherwise(_number(c, 0, 10)))
    iban = F.transform(F.split(canon, ""), lambda c, i: F.when(i < 4, _fixed(c)).otherwise(_letter(c, ALPHABETS)))
    kept = F.when(F.regexp_like(canon, F.lit("^(?:AKIA|gh[opsur]_)")), 4).otherwise(0)
    secret = F.transform(F.split(canon, ""), lambda c, i: F.when(i < kept, _fixed(c)).otherwise(_letter(c, ALPHABETS)))
    words = F.transform(F.split(canon, "[ -]"), lambda w: part(F.lit(""), _letters(w, SOUNDS)))
    return (
        F.when(kind == "email", email).when(kind == "name", words).when(kind == "ip", one(ip)).when(kind == "phone", one(phone))
        .when(kind == "account", one(F.concat(body, F.array(last)))).when(kind == "iban", one(iban)).when(kind == "secret", one(secret))
        .when(kind.isin("key", "ipv6"), one(_letters(canon, (DIGITS, HEX)))).otherwise(one(_letters(canon, (DIGITS, LETTERS))))
    )


def _permuted(part: Column, secret: Column) -> Column:
    """A part's text after the keyed permutation of its form: four rounds, a shift
    of the last place, and the four rounds undone."""
    syms, n = part["syms"], F.size(part["syms"])
    half = F.floor(n / 2).cast("int")
    sizes = F.transform(syms, lambda s: s["m"])
    seed = F.concat_ws("|", secret, part["tweak"], F.array_join(F.transform(syms, lambda s: F.concat(s["m"].cast("string"), s["pool"], F.when(s["m"] == 1, s["c"]).otherwise(""))), ","))
    last = F.aggregate(syms, F.struct(F.lit(0).alias("i"), F.lit(-1).alias("at")), lambda a, s: F.struct((a["i"] + 1).alias("i"), F.when(s["m"] > 1, a["i"]).otherwise(a["at"]).alias("at")))["at"]
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(w).alias("w")) for r, w in ((1, 1), (2, 1), (3, 1), (4, 1), (0, 1), (4, -1), (3, -1), (2, -1), (1, -1))])

    def step(v: Column, s: Column) -> Column:
        left = F.pmod(s["r"], F.lit(2)) == 1
        other = F.when(s["r"] == 0, F.array().cast("array<int>")).when(left, F.slice(v, half + 1, F.greatest(n - half, F.lit(0)))).otherwise(F.slice(v, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", seed, s["r"].cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")), 256)

        def moved(d: Column) -> Column:
            def place(x: Column, i: Column) -> Column:
                m = F.get(sizes, i)
                add = F.conv(F.substring(d, F.pmod(i, F.lit(15)) * 4 + 1, F.lit(4)), 16, 10).cast("int") + i
                shifted = F.when(i == last, F.pmod(x + 1 + F.pmod(add, F.greatest(m - 1, F.lit(1))), m)).otherwise(x)
                return F.when(s["r"] == 0, shifted).when((i < half) == left, F.pmod(x + s["w"] * add, m)).otherwise(x)

            return F.transform(v, place)

        return _bound(digest, moved)

    values = F.aggregate(steps, F.transform(syms, lambda s: s["v"]), step)
    token = lambda s, x: F.when(s["m"] == 1, s["c"]).when(s["pool"] != "", F.substring(s["pool"], x + 1, F.lit(1))).otherwise((s["base"] + x).cast("string"))
    return F.array_join(F.zip_with(syms, values, token), "")


def _check_digit(digits: Column) -> Column:
    """Luhn's check digit for a number without it."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = F.aggregate(F.transform(F.reverse(F.split(digits, "")), part), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _iban_check(iban: Column) -> Column:
    """The two check digits, as a number, that an IBAN should have."""
    turned = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00")), "")
    add = lambda r, c: F.when(F.regexp_like(c, F.lit(r"^\d$")), F.pmod(r * 10 + c.cast("int"), F.lit(97))).when(c != "", F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(r)
    return 98 - F.aggregate(turned, F.lit(0), add)


def _surrogate(kind: Column, canon: Column, gender: Column, key: str) -> Column:
    out = F.transform(_parts(kind, canon), lambda p: _permuted(p, F.concat(F.lit(f"{key}|"), kind)))

    def made(o: Column) -> Column:
        email = F.concat(o[1], F.lit("@"), o[0], F.lit("."), F.regexp_extract(canon, "[.]([^.]*)$", 1))
        body = F.substring(o[0], F.lit(1), F.length(o[0]) - 1)
        account = F.concat(body, F.pmod(_check_digit(body) + F.substring(o[0], -1, 1).cast("int"), F.lit(10)).cast("string"))
        off = F.substring(canon, 3, 2).cast("int") - _iban_check(canon)
        iban = F.concat(F.substring(o[0], 1, 2), F.lpad(F.pmod(_iban_check(o[0]) + off, F.lit(100)).cast("string"), 2, "0"), F.substring(o[0], F.lit(5), F.length(o[0])))

        def word(w: Column, i: Column) -> Column:
            end = lambda script: reduce(lambda rest, x: F.when(gender == x[0], x[1]).otherwise(rest), zip("fm", ENDINGS[script], strict=False), F.lit(ENDINGS[script][2]))
            full = F.when((i > 0) | (F.size(o) == 1), w).when(F.regexp_like(w, F.lit(r"\p{IsCyrillic}")), F.concat(w, end("cyrillic"))).otherwise(F.concat(w, end("latin")))
            return F.concat(F.upper(F.substring(full, 1, 1)), F.substring(full, F.lit(2), F.length(full)))

        between = F.concat(F.array(F.lit("")), F.regexp_extract_all(canon, F.lit("[ -]"), F.lit(0)))
        name = F.array_join(F.zip_with(between, F.transform(o, word), lambda b, w: F.concat(b, w)), "")
        return F.when(kind == "email", email).when(kind == "account", account).when(kind == "iban", iban).when(kind == "name", name).otherwise(o[0])

    return _bound(out, made)


def _filled(kind: Column, value: Column, new: Column) -> Column:
    """new in the separators and case of value, after its prefix."""
    keeps = kind.isin("email", "ip", "ipv6")
    plain = F.when(keeps, new).otherwise(F.regexp_replace(new, r"[ .()\-+#]", ""))
    bare = F.substring(value, F.length(_prefix(kind, value)) + 1, F.length(value))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        taken = keeps | F.regexp_like(c, F.lit(r"[\p{L}\d]"))
        n = F.substring(plain, acc["i"], F.lit(1))
        return F.struct(F.concat(acc["out"], F.when(~taken, c).when((F.upper(c) == c) & (F.lower(c) != c), F.upper(n)).otherwise(n)).alias("out"), (acc["i"] + F.when(taken, 1).otherwise(0)).alias("i"))

    filled = F.aggregate(F.split(bare, ""), start, step, lambda acc: acc["out"])
    name = F.when(F.upper(bare) == bare, F.upper(new)).otherwise(new)
    return F.concat(_prefix(kind, value), F.when(kind == "name", name).when(kind == "secret", new).otherwise(filled))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, new, value, surrogate for distinct (kind, value, canon, gender)."""
    gender = F.coalesce(F.max(F.when(F.col("gender") != "", F.col("gender"))), F.lit("")).alias("gender")
    entities = found.groupBy("kind", "canon").agg(gender, F.collect_set("value").alias("values"))
    entities = entities.withColumn("new", _surrogate(F.col("kind"), F.col("canon"), F.col("gender"), key))
    each = entities.select("kind", "canon", "new", F.explode("values").alias("value"))
    return each.withColumn("surrogate", _filled(F.col("kind"), F.col("value"), F.col("new")))


def collisions(table: DataFrame) -> DataFrame:
    """kind, new of surrogates that several entities share."""
    return table.groupBy("kind", "new").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a != b").select("kind", "new")


def with_surrogates(docs: DataFrame, key: str = "rotate-this-key") -> DataFrame:
    """docs with its texts' entities replaced; n_entities and entities (kind and
    surrogate, in order) added."""
    docs = docs.drop("n_entities", "entities")
    hint = F.coalesce(F.regexp_like("text", F.lit(HINT)), F.lit(False))
    # Names of several words are looked for where they stand alone as well.
    named = F.transform(F.regexp_extract_all("text", F.lit(START + PATTERNS["name"]), F.lit(0)), lambda v: F.regexp_replace(v, f"^{TITLE}", ""))
    named = F.array_sort(F.array_distinct(F.filter(named, lambda v: F.regexp_like(v, F.lit("[ -]")))), lambda a, b: F.length(b) - F.length(a))
    names = _bound(named, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(_any("|(?:")), F.array_join(n, "|"), F.lit(r")(?!\p{L}))"))).otherwise(ANY))
    hit = docs.filter(hint).withColumn("__any", names)
    found = F.regexp_extract_all("text", F.col("__any"), F.lit(0))
    # Rows are known by what stands in them; rows that agree get the same text.
    row = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    said = hit.select(row.alias("__row"), F.posexplode(found).alias("pos", "value")).distinct()
    said = stored(said, "pii-found")
    title = F.regexp_extract("value", r"^(\P{Z}+?)\.? ", 1)
    gender = F.when(F.col("kind") != "name", "").when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("")
    values = said.select("value").distinct().withColumn("kind", _type_of(F.col("value"))).withColumn("gender", gender).withColumn("canon", _canonical(F.col("kind"), F.col("value")))
    table = stored(surrogates(values, key), "pii-surrogates")
    if (twice := collisions(table).first()) is not None:
        raise RuntimeError(f"two entities of type {twice['kind']} share a surrogate")
    each = said.join(table.select("value", "kind", "surrogate"), "value").groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "surrogate"))).alias("__new"))
    # Only surrogates and hashes of rows stay in the shared folder.
    each = stored(each, "pii-replacements")
    discard(said)
    discard(table)
    entities = F.transform("__new", lambda e: F.struct(e["kind"].alias("kind"), e["surrogate"].alias("surrogate")))
    parts = F.split("text", F.col("__any"), -1)
    text = _bound(parts, lambda p: F.concat(p[0], F.array_join(F.zip_with(F.col("__new"), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda e, rest: F.concat(e["surrogate"], rest)), "")))
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    joined = hit.withColumn("__row", row).join(each, "__row", "left")
    columns = [F.when(F.col("__new").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    replaced = joined.select(*columns, F.coalesce(F.size("__new"), F.lit(0)).cast("int").alias("n_entities"), F.coalesce(entities, none).alias("entities"))
    # Rows that cannot hold an entity take no part in the join.
    rest = docs.filter(~hint).select("*", F.lit(0).alias("n_entities"), none.alias("entities"))
    return replaced.unionByName(rest)
