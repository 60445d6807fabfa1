"""Surrogates for personal data and secrets, with DataFrame functions only.

Detected entities get keyed replacements of their own kind: the same entity always the same surrogate (coreference),
different entities different ones (distinctness), in the layout of each mention. Cards pass the Luhn test and IBANs
mod 97, addresses stay private or public, social security numbers are such as are issued, keys keep their prefix, names
keep title, gender and script. Surrogates are made per distinct entity of the whole corpus; those that collide with each
other or with a real entity are keyed anew until none does.

Texts are read by the patterns once, whole and all of them; there is no test before that could pass over an entity. That
pass marks the mentions; texts in which it finds full names are read again for these names, wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, UPPER, Scratch, ascii_lower

#: Rounds in which colliding surrogates are keyed anew. What still collides then, as the layout has too few values, gets a
#: surrogate without the layout, so that nothing is left in place and no text ends a job.
MAX_ROUNDS = 6
#: What marks the begin and the end of a mention while a text is cut; a text that has one of these is cut by two passes.
OPENS, CLOSES = "\ue000", "\ue001"

# The patterns of entities (Java).
_WORD = r"[\p{L}\p{N}._%+-]"
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sra|Sr|г-н|г-жа|господин|госпожа)"
_CUE = r"(?:[Nn]ame is |[Nn]ame: |[Aa]uthor: |[Dd]ear |[Rr]egards, |[Ss]incerely, |[Ss]igned, |[Ii] am |меня зовут )"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAPITALISED = r"\p{Lu}\p{Ll}+"
EMAIL = rf"(?<!{_WORD}){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: The short look behind keeps the long one from being tried at every character.
KEYWORD_SECRET = (r"(?<=[=:][ ]{0,1}[\"']{0,1})(?<=(?:(?i:password|passwd|pwd|passwort|passphrase|contrase[ñÑ]a|senha|secret|token|api_key|apikey|api-key)|[Пп]ароль|ПАРОЛЬ)[ ]{0,1}[=:][ ]{0,1}[\"']{0,1})"
                  r"(?![\"' ])[^\s\"',;|]{6,}+")
PREFIXED_SECRET = (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|akia[0-9a-z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|GH[POUSR]_[A-Z0-9]{36,}"
                   r"|sk-[A-Za-z0-9_-]{20,}|SK-[A-Z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|XOX[ABPRS]-[A-Z0-9-]{10,})(?![A-Za-z0-9])")
HEX_SECRET = (r"(?<![A-Za-z0-9])(?:(?=[0-9a-f]{32})(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,64}|(?=[0-9A-F]{32})(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{32,64})(?![A-Za-z0-9])")
SECRET = f"{PREFIXED_SECRET}|{KEYWORD_SECRET}|{HEX_SECRET}"
IP = rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = (r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
         r"|(?<![\w.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")
#: Numbers without a layout of their own count behind a word that says what they are.
SSN = (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?=\d{3}[ ]?\d{2}[ ]?\d{4}(?![\w-]))(?<=[ :#])(?<=(?i:ssn|social security number|social security)[ ]?[:#]?[ ]?)\d{3}[ ]?\d{2}[ ]?\d{4}")
CALLED = r"(?=\d{7,12}(?![\w.-]))(?<=[ :.])(?<=(?i:phone|telephone|tel|mobile|cell|fax|call|whatsapp)[.:]?[ ]?)\d{7,12}"
#: Eight groups, or fewer with a double colon, and a digit somewhere.
_GROUP = r"[0-9A-Fa-f]{1,4}"
IP6 = (rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f:]*::)(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:)(?![\w:]|\.\d)")
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
NAME = (rf"(?=[MDPHFSг])(?<![\w-]){_TITLE}\.? {_CAPITALISED}(?:[ -]{_CAPITALISED})?"
        rf"|(?=\p{{Lu}})(?<= )(?<={_CUE}){_CAPITALISED} {_CAPITALISED}(?: {_CAPITALISED})?")
KINDS = (("email", EMAIL), ("secret", SECRET), ("ip", IP), ("ip6", IP6), ("ssn", SSN), ("iban", IBAN), ("card", CARD), ("phone", PHONE), ("called", CALLED), ("name", NAME))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
MALE, FEMALE = r"^(?:Mr|Herr|Sr|г-н|господин)\b", r"^(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|г-жа|госпожа)\b"
#: Given names that tell the gender where no title does.
MALE_NAMES = "adam alan alexander andreas antonio carlos christian daniel david edward eric felix francesco george hans henry ivan jack james jean john jose juan karl luis marco mark martin michael paul peter pierre robert sergei stefan thomas william иван сергей михаил дмитрий".split()
FEMALE_NAMES = "alice amy anna barbara carla carmen catherine christine clara elena elisabeth emily emma eva françoise helen ingrid isabel jane julia karen laura lucia maria marie martha mary nina olga paula rosa sarah sofia susan teresa мария ольга елена анна".split()
SYLLABLES = {"latin": "ba be bo da de do fa fe fi ga go ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te ti to va ve vi".split(),
             "cyrillic": "ба бе бо ва ве ви го да де до ка ке ко ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се со та те ти".split()}
#: First octets that no public address has.
_NOT_PUBLIC = (10, 100, 127, 169, 172, 192, 198, 203)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; doubled: 1 if the second digit from the right is doubled, 0 if the last is (for a check digit to come)."""
    def one(x, i):
        n = F.coalesce(x.try_cast("int"), F.lit(0))
        return F.when(i % 2 == doubled, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda acc, x: acc + x)


def _mod97(code: Column) -> Column:
    """An IBAN, without blanks and with its first four characters last, modulo 97; letters count from 10."""
    def step(acc, c):
        n = c.try_cast("int")
        return F.when(n.isNotNull(), (acc * 10 + n) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(code, ""), F.lit(0), step)


def _is_iban(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4))) == 1)


def kind_of(m: Column) -> Column:
    """The kind of a match; null for what fails the test of its kind and so is no entity."""
    n = F.length(_digits(m))
    return (F.when(m.rlike(rf"^{_TITLE}\.? \p{{Lu}}") | m.rlike(rf"^{_CAPITALISED} {_CAPITALISED}"), "name").when(m.rlike(f"^(?:{EMAIL})$"), "email")
            .when(m.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$"), "ip").when(m.rlike(r"^\d{3}[- ]?\d{2}[- ]?\d{4}$"), "ssn")
            .when(m.rlike(r"^[0-9A-Fa-f]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6").when(m.rlike(r"^\d{7,12}$"), "phone")
            .when(m.rlike(r"^[0-9A-F]{32,64}$") & m.rlike("[A-F]"), "secret").when(m.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"), F.when(_is_iban(m), "iban"))
            .when(m.rlike(r"^(?:\+|\()[\d ().+-]+$|^(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}$") & (n >= 7), "phone")
            .when(m.rlike(r"^\d[\d -]{11,}$"), F.when(_luhn_sum(_digits(m), 1) % 10 == 0, "card"))
            .when(m.rlike(r"[\p{L}\p{N}]") & ~m.rlike(r"^(.)\1*$"), "secret"))  # signs alone, or one sign repeated, are a mask


def _random(seed: Column) -> Column:
    return F.concat(F.sha2(F.concat(seed, F.lit("|a")), 256), F.sha2(F.concat(seed, F.lit("|b")), 256))


def _nth(random: Column, i: Column) -> Column:
    """A number from 0 to 65535 for the place i (from 0); beyond the 32 that the digits hold they come again, shifted."""
    return F.conv(F.substring(random, (i * 4 + F.floor(i / 31)).cast("int") % 124 + 1, F.lit(4)), 16, 10).cast("int")


def _code_point(first: int, span: int, r: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(r % span + first), 4, "0")), "UTF-16BE")


def _reshaped(value: Column, random: Column) -> Column:
    """value with digits for digits and letters for letters of the same case and script; scripts without one get Latin letters."""
    def as_hex(c, i):
        return F.lower(F.hex(_nth(random, i) % 16))

    def alike(c, i):
        r = _nth(random, i)
        return (F.when(c.rlike(r"^\d$"), (r % 10).cast("string")).when(c.rlike("^[a-z]$"), F.char(r % 26 + 97))
                .when(c.rlike("^[A-Z]$"), F.char(r % 26 + 65)).otherwise(c))

    def in_script(c, i):
        r, capital = _nth(random, i), c.rlike(r"^\p{Lu}$")
        return (F.when(c.rlike(r"^\p{IsCyrillic}$"), F.when(capital, _code_point(0x410, 32, r)).otherwise(_code_point(0x430, 32, r)))
                .when(c.rlike(r"^\p{IsGreek}$"), F.when(capital, _code_point(0x391, 17, r)).otherwise(_code_point(0x3B1, 17, r)))
                .when(c.rlike(r"^\p{IsHan}$"), _code_point(0x4E00, 20_000, r)).when(c.rlike(r"^\p{N}$"), (r % 10).cast("string"))
                .when(capital, F.char(r % 26 + 65)).when(c.rlike(r"^[\p{L}\p{M}]$"), F.char(r % 26 + 97)).otherwise(c))
    # What is asked of the whole value is asked outside of the functions of its characters.
    lower_hex = value.rlike(r"^(?=\d*[a-f])[0-9a-f]+$") & value.rlike(r"\d")
    chars = F.split(value, "")
    return F.array_join(F.when(lower_hex, F.transform(chars, as_hex)).when(value.rlike(r"[^\x00-\x7f]"), F.transform(chars, in_script)).otherwise(F.transform(chars, alike)), "")


def _made_name(random: Column, script: str, syllables: int, ending: Column) -> Column:
    table = F.split(F.lit(" ".join(SYLLABLES[script])), " ")
    parts = [F.element_at(table, _nth(random, F.lit(k)) % len(SYLLABLES[script]) + 1) for k in range(syllables)]
    return F.concat(F.initcap(F.concat(*parts)), ending)


def _number(random: Column, place: int, below: int) -> Column:
    return _nth(random, F.lit(place)) % below


def _address(canon: Column, random: Column) -> Column:
    """A private address for a private one, a loopback address for one of those, else a public one."""
    public = [n for n in range(1, 224) if n not in _NOT_PUBLIC]
    first = F.element_at(F.expr(f"array({', '.join(map(str, public))})"), _number(random, 0, len(public)) + 1)
    private = canon.rlike(r"^(?:10|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
    first = F.when(private, 10).when(canon.startswith("127."), 127).otherwise(first)
    return F.concat_ws(".", *[c.cast("string") for c in (first, _number(random, 1, 256), _number(random, 2, 256), _number(random, 3, 254) + 1)])


def _address6(canon: Column, random: Column) -> Column:
    """An address with hexadecimal digits for its own; link-local and private ones keep their first group."""
    kept = F.regexp_extract(canon, "^(?:fe80|f[cd][0-9a-f]{2}):", 0)
    rest = F.substring(canon, F.length(kept) + 1, F.lit(64))
    return F.concat(kept, F.array_join(F.transform(F.split(rest, ""), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_nth(random, i) % 16)))), ""))


def _security_number(random: Column) -> Column:
    area = _number(random, 0, 898) + 1  # 001 to 899, but for 666
    area = F.when(area == 666, 899).otherwise(area)
    return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lpad((_number(random, 1, 99) + 1).cast("string"), 2, "0"), F.lpad((_number(random, 2, 9_999) + 1).cast("string"), 4, "0"))


def _account(canon: Column, random: Column) -> Column:
    country, own = F.substring(canon, 1, 2), _reshaped(F.substring(canon, 5, 99), random)
    check = 98 - _mod97(F.concat(own, country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), own)


def surrogate(kind: Column, canon: Column, random: Column, key: str) -> Column:
    """The surrogate of an entity in canonical form; random: a column of hexadecimal digits made from the key."""
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    card = _reshaped(F.substring(canon, F.lit(1), F.length(canon) - 1), random)
    card = F.concat(card, ((10 - _luhn_sum(card, 0) % 10) % 10).cast("string"))
    prefix = r"^(akia|gh[pousr]_|sk-|xox[abprs]-)?"
    out = (F.when(kind == "email", F.concat(_reshaped(F.substring_index(canon, "@", 1), random), F.lit("@d"), F.substring(domain, 1, 10), F.lit(".example.com")))
           .when(kind == "ip", _address(canon, random)).when(kind == "ip6", _address6(canon, random)).when(kind == "card", card).when(kind == "iban", _account(canon, random)).when(kind == "ssn", _security_number(random))
           .when(kind == "secret", F.concat(F.regexp_extract(canon, prefix, 0), _reshaped(F.regexp_replace(canon, prefix, ""), random))))
    for g, latin, cyrillic, family in (("m", "n", "н", "ов"), ("f", "a", "я", "ова"), ("n", "o", "й", "ко")):
        out = out.when(kind == f"given-{g}-latin", _made_name(random, "latin", 4, F.lit(latin)))
        out = out.when(kind == f"given-{g}-cyrillic", _made_name(random, "cyrillic", 4, F.lit(cyrillic)))
        out = out.when(kind == f"surname-{g}-cyrillic", _made_name(random, "cyrillic", 5, F.lit(family)))
    return out.when(kind == "surname-latin", _made_name(random, "latin", 5, F.lit("r"))).otherwise(_reshaped(canon, random))


def rendered(mention: Column, kind: Column, sur: Column) -> Column:
    """The surrogate in the layout of a mention, in time linear in a secret's length; the other kinds are short."""
    digits = _digits(mention)
    # Of a phone number what comes before its last ten digits is a country's code, and stays.
    own = F.when(kind == "phone", F.concat(F.left(digits, F.length(digits) - F.length(sur)), sur)).otherwise(sur)
    filled = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c.rlike(r"^\d$"), F.substring(own, F.length(_digits(F.substring(mention, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(
        c == " ", c).otherwise(F.substring(sur, F.length(F.replace(F.substring(mention, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    # A secret's canonical form is in lower case: the mention's case comes back, as a whole or letter by letter.
    cased = F.when(mention.rlike("[A-Z]") & ~mention.rlike("[a-z]"), F.translate(sur, LOWER, UPPER)).otherwise(F.array_join(F.zip_with(
        F.split(mention, ""), F.split(sur, ""), lambda c, x: F.when(c.rlike("^[A-Z]$"), F.upper(x)).otherwise(x)), ""))
    return (F.when(sur.startswith("["), sur).when(kind == "secret", cased).when(kind.isin("card", "phone", "ssn"), filled).when(kind == "iban", spaced)
            .when((kind == "email") & (mention == F.upper(mention)), F.upper(sur)).otherwise(sur))


def entities(scratch: Scratch, mentions: DataFrame, key: str) -> DataFrame:
    """(kind, canon, sur): the surrogate of each distinct entity, no two alike and none equal to an entity.

    Only the number of entities that still collide comes to the driver, once a round.
    """
    # The digits are a column of their own, as they are looked up for every character.
    random = _random(F.concat_ws("|", F.lit(key), "kind", "canon", F.col("attempt").cast("string")))
    sur = surrogate(F.col("kind"), F.col("canon"), F.col("random"), key)

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("random", random).withColumn("sur", sur).drop("random")

    now = scratch.write(keyed(mentions.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))), "entities-0")
    for k in range(1, MAX_ROUNDS + 1):
        kept = now.groupBy("kind", "sur").agg(F.min(F.struct("attempt", "canon")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        twice = now.join(kept.select("kind", "sur", F.col("keeps.canon").alias("keeps")), ["kind", "sur"]).where("canon <> keeps").select("kind", "canon")
        real = now.join(now.select("kind", F.col("canon").alias("sur")), ["kind", "sur"], "left_semi").select("kind", "canon")
        again = scratch.write(twice.unionByName(real).distinct(), f"again-{k}")
        if again.isEmpty():
            break
        rows = now.join(again, ["kind", "canon"], "left_semi").drop("sur").withColumn("attempt", F.col("attempt") + 1)
        plain = F.concat(F.lit("["), "kind", F.lit("-"), F.sha2(F.concat_ws("|", F.lit(key), F.lit("plain"), "kind", "canon"), 256), F.lit("]"))
        redone = keyed(rows) if k < MAX_ROUNDS else rows.withColumn("sur", plain)
        now = scratch.write(now.join(again, ["kind", "canon"], "left_anti").unionByName(redone), f"entities-{k}")
    return now.select("kind", "canon", "sur")


def _among(name: Column, names: list[str]) -> Column:
    return F.array_contains(F.split(F.lit(" ".join(names)), " "), name)


def _pieces(mentions: DataFrame) -> DataFrame:
    """A row per piece of a mention: names fall into title, blanks, given name and surname; others are one piece.

    part: what a piece is keyed as; null for titles, blanks and mentions that are no entity, which stay as they are.
    """
    m, last = F.col("mention"), F.col("piece_no") == F.size("pieces") - 1
    is_name, titled = F.coalesce(F.col("kind") == "name", F.lit(False)), m.rlike(rf"^{_TITLE}\.? ")
    given = F.lower(F.regexp_extract(m, rf"^(?:{_TITLE}\.? )?({_CAPITALISED})[ -]", 1))
    gender = F.when(m.rlike(MALE) | _among(given, MALE_NAMES) & ~m.rlike(FEMALE), "m").when(m.rlike(FEMALE) | _among(given, FEMALE_NAMES), "f").otherwise("n")
    split = F.regexp_extract_all(m, F.lit(rf"^{_TITLE}\.?(?= )|[\s-]+|[^\s-]+"), 0)
    rows = mentions.withColumn("gender", gender).withColumn("titled", titled).withColumn("pieces", F.when(is_name, split).otherwise(F.array(m)))
    rows = rows.select("*", F.posexplode("pieces").alias("piece_no", "piece"))
    kind, piece, cyrillic = F.col("kind"), F.col("piece"), F.col("piece").rlike(r"\p{IsCyrillic}")
    plain = piece.rlike(r"^[\s-]+$") | (F.col("titled") & (F.col("piece_no") == 0))
    name = (F.when(~last, F.concat_ws("-", F.lit("given"), "gender", F.when(cyrillic, "cyrillic").otherwise("latin")))
            .when(cyrillic, F.concat_ws("-", F.lit("surname"), "gender", F.lit("cyrillic"))).otherwise("surname-latin"))
    rows = rows.withColumn("part", F.when(~is_name, kind).when(~plain, name))
    canon = (F.when(kind == "phone", F.right(_digits(piece), F.lit(10))).when(kind.isin("card", "ssn"), _digits(piece))
             .when(kind == "iban", F.replace(piece, F.lit(" "), F.lit(""))).when(kind == "secret", ascii_lower(piece)).otherwise(F.lower(piece)))
    return rows.withColumn("canon", F.when(F.col("part").isNotNull(), canon))


def _sized_side(df: DataFrame, *texts: Column) -> DataFrame:
    """df with a broadcast hint if its rows, with the bytes that these texts have, are few enough."""
    n = df.agg(F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(80)))).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _cut(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, row) with found, the mentions, and gaps, the texts around them; text only where there are none."""
    text = F.coalesce("text", F.lit(""))

    def parts(pattern: str | Column, flat: Column) -> Column:
        """Gaps and mentions in turn."""
        marked = F.regexp_replace(flat, pattern, F.lit(f"{OPENS}$0{CLOSES}"))
        return F.split(marked, f"[{OPENS}{CLOSES}]", -1)

    odd = text.rlike(f"[{OPENS}{CLOSES}]")
    rows = rows.withColumn("odd", odd).withColumn("parts", F.when(~odd, parts(F.lit(ANY), text)))
    every = lambda c, r: F.filter(c, lambda x, i: i % 2 == r)
    found = F.when(F.col("odd"), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(every("parts", 1))
    gaps = F.when(F.col("odd"), F.split(text, ANY, -1)).otherwise(every("parts", 0))
    rows = rows.withColumn("found", found).withColumn("gaps", gaps).drop("parts")
    # Full names, without titles: all that stand in a text are looked for in the whole of it.
    bare = F.array_distinct(F.filter(F.transform("found", lambda m: F.regexp_replace(m, rf"^{_TITLE}\.? ", "")), lambda m: m.rlike(rf"^{_CAPITALISED} {_CAPITALISED}(?: {_CAPITALISED})?$")))
    rows = rows.withColumn("names", bare).withColumn("again", (F.size("names") > 0) & ~F.col("odd"))
    named = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}-])(?:"), F.array_join(F.reverse(F.array_sort("names")), "|"), F.lit(r")(?![\p{L}-])"))
    rows = rows.withColumn("parts", F.when(F.col("again"), parts(named, text)))
    rows = rows.withColumn("found", F.when(F.col("again"), every("parts", 1)).otherwise(F.col("found"))).withColumn("gaps", F.when(F.col("again"), every("parts", 0)).otherwise(F.col("gaps")))
    some = F.size("found") > 0
    return rows.select("doc_id", "row", F.when(~some, F.col("text")).alias("text"), F.when(some, F.col("found")).alias("found"), F.when(some, F.col("gaps")).alias("gaps"))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_entities, kinds (sorted, joined by commas), text.

    text is the whole text with every detected entity replaced; without one it is unchanged. A null text stays null and
    an empty one empty. Rows may repeat and doc_id may be null; other columns are ignored; an empty table gives an
    empty result. Reruns with the same key over the same corpus agree; the key is a secret of the caller. A text is
    rebuilt in time linear in its length, whatever the number of its entities.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    read = scratch.write(_cut(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))), "read")
    mentions = read.where("found is not null").select("row", F.posexplode("found").alias("at", "mention")).withColumn("kind", kind_of(F.col("mention")))
    pieces = scratch.write(_pieces(mentions).select("row", "at", "piece_no", "kind", "part", "piece", "canon"), "pieces")
    known = entities(scratch, pieces.where("part is not null").select(F.col("part").alias("kind"), "canon"), key)
    known = _sized_side(known.withColumnRenamed("kind", "part"), F.col("canon"), F.col("sur"))
    new = pieces.join(known, ["part", "canon"], "left").select(
        "row", "at", "piece_no", "kind", F.coalesce(rendered(F.col("piece"), F.col("part"), F.col("sur")), F.col("piece")).alias("new"))
    # Texts gather by row, so that what is one row's lies in one partition for both groupings.
    by_row = new.repartition("row").groupBy("row", "at").agg(F.max("kind").alias("kind"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("piece_no", "new"))), lambda p: p["new"]), "").alias("new"))
    by_row = scratch.write(by_row.groupBy("row").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda p: p["new"]).alias("new"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("kind").alias("n_entities")), "new")
    done = read.join(_sized_side(by_row, F.array_join("new", "")), "row", "left")
    text = F.array_join(F.zip_with("gaps", F.concat("new", F.array(F.lit(""))), lambda gap, m: F.concat(gap, m)), "")
    return done.select("doc_id", F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"), F.coalesce("kinds", F.lit("")).alias("kinds"),
                       F.when(F.col("gaps").isNull(), F.col("text")).otherwise(text).alias("text"))
