"""Personal data: keyed, type-consistent surrogates, with DataFrame functions only.

Detected mentions are gathered once for each distinct string, turned into entities (the form in which
mentions of one thing agree, such as a phone number's last ten digits), and every entity gets a
surrogate from the key and the entity: digits for digits, letters for letters of the same script and
case, names of the title's gender. A name is two kinds of entities, given names and a family name, so that
"Mrs. Jane Doe" and "Mrs. Doe" share theirs; a full name found after a title is replaced wherever else
in the same text it stands without one. Two entities with one surrogate, or a surrogate that is itself an
entity of the corpus, are drawn again until all differ, so distinct things stay distinct, and one thing
has one surrogate everywhere. Then the mentions are put back in their own format.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import drop_stash, scratch, stash, table

# What a mention looks like, in the order in which alternatives are tried.
_TITLES = "Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Señor|Señora|Sra?|Monsieur|Madame|Mme|Господин|Госпожа|г-н|г-жа"
_HEX4 = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "secret": r"(?<![\p{L}])(?i:password|passwd|secret|api_key|apikey|access_token|auth_token|token)[\"']?(?:\s{0,3}[=:]\s{0,3})[\"']?[^\s\"']{6,}+",
    "key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}}|(?:{_HEX4}:){{1,7}}:|::{_HEX4}(?::{_HEX4}){{0,6}})(?![0-9A-Za-z:]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9\-])[0-9]{4}(?:[ \-]?[0-9]{4}){3}(?![0-9\-])",
    "phone": r"(?<![0-9+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-]?[0-9]{3,4}|(?:\+[0-9]{1,3}[ .\-]?[0-9]|0[0-9])(?:[ .\-][0-9]{2}){4}|\+[1-9][0-9]{7,14})(?![0-9])",
    "token": r"(?<![0-9A-Za-z])(?=[a-fA-F]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}])(?:{_TITLES})\.? (?:(?!(?:Mrs?|Ms|Miss|Mister|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme)\b)(?!\S*@)\p{{Lu}}\p{{Ll}}{{1,30}}[ \-]?){{1,3}}(?<=\p{{Ll}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Words before a secret, and how titles begin and go on.
SECRET_WORDS = ("passw", "secret", "api_key", "apikey", "token")
TITLE = r"[MHFSГг](?:rs?|s|iss|ister|onsieur|adame|me|err|rau|eñora?|ra?|осподин|оспожа|-н|-жа)\.? \p{Lu}"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|г-жа)\b"

# Names by script and gender, and the syllables that family names are built from.
NAMES = {
    ("latin", "f"): "Anna Maria Julia Clara Laura Emma Sofia Elena Marta Alice Nora Lena Irene Rosa Eva Ida".split(),
    ("latin", "m"): "Paul Martin David Thomas Peter Simon Lucas Oscar Hugo Felix Robert Victor Adam Jonas Leon Max".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Вера Нина Софья".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Олег Сергей Антон Максим Виктор".split(),
}
SYLLABLES = {"latin": "ba bel cor dan del fer gar hol jan kel lam mar nor pal ren sal".split(), "cyrillic": "ба вел гор дан дел жар зим кор лам мар нор пал рен сал тим фед".split()}
GIVEN_ENDINGS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий"}
ENDINGS = {("latin", "f"): "son", ("latin", "m"): "son", ("cyrillic", "f"): "ова", ("cyrillic", "m"): "ов"}


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def hinted(text: Column) -> Column:
    """A cheap test that every text with a mention passes: a sign, a digit, the start of a key, a word or a title."""
    out = text.contains("@") | text.rlike("[0-9]") | text.contains("::") | text.contains("AKIA") | text.contains("ASIA")
    return out | text.rlike(f"(?i){'|'.join(SECRET_WORDS)}") | text.rlike(TITLE) | text.rlike("[A-Fa-f]:[A-Fa-f]{1,4}:[A-Fa-f]{1,4}:")


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


_NAME = r"^[^ ]+ "
_VALUE = r"^(?:.*?)[=:]\s{0,3}[\"']?"


def canonical(kind: Column, mention: Column) -> Column:
    """The form in which mentions of one entity agree."""
    return (
        F.when(kind == "phone", F.right(_digits(mention), F.lit(10)))
        .when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "email", F.lower(mention))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.regexp_replace(mention, _VALUE, ""))
        .when(kind == "ip6", F.lower(mention))
        .otherwise(mention)
    )


def name_parts(kinds: DataFrame) -> DataFrame:
    """mention, pos, kind (given or family) and entity of each word of the names in ``kinds``.

    A given name goes with a gender, and a Cyrillic family name too, as its ending tells it.
    """
    name = F.regexp_replace(F.rtrim("mention"), _NAME, "")
    gender = F.when(F.col("mention").rlike(FEMALE), "f ").otherwise("m ")
    words = kinds.where("kind = 'person'").select("mention", gender.alias("gender"), F.split(name, " +").alias("words"))
    each = words.select("mention", "gender", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    family = F.col("pos") == F.col("n") - 1
    marked = ~family | F.col("word").rlike(r"\p{IsCyrillic}")
    return each.select("mention", "pos", F.when(family, "family").otherwise("given").alias("kind"), F.concat(F.when(marked, F.col("gender")).otherwise(""), "word").alias("entity"))


def _stream(key: Column, n: int) -> Column:
    """n*64 hexadecimal digits from a keyed hash."""
    return F.concat(*[F.sha2(F.concat(key, F.lit(f"|{i}")), 256) for i in range(n)])


def _like(form: Column, key: Column) -> Column:
    """Each character of ``form`` drawn anew within its class: digit, letter of the script and case; others stay."""
    # The letters drawn from, 16 for each script and case
    drawn = {"[0-9]": "0123456789012345", r"[a-z]": "abcdefghiklmnopr", r"[A-Z]": "ABCDEFGHIKLMNOPR", r"\p{IsCyrillic}": "абвгдежзиклмнопр", r"\p{Ll}": "abcdefghiklmnopr", r"\p{Lu}": "ABCDEFGHIKLMNOPR"}
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    stream = _stream(key, 5)

    def one(c: Column, i: Column) -> Column:
        nibble = F.conv(F.substring(stream, F.pmod(i, F.lit(320)) + 1, F.lit(1)), 16, 10).cast("int")
        out = c
        for cls, letters in reversed(drawn.items()):
            out = F.when(c.rlike(f"^{cls}$"), F.substring(F.lit(letters), nibble + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(chars, one), "")


def _hexed(form: Column, key: Column) -> Column:
    """Each hexadecimal digit drawn anew, in the case of the letters; others, such as colons, stay."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    stream = _stream(key, 4)
    drawn = F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9A-Fa-f]$"), F.substring(stream, F.pmod(i, F.lit(256)) + 1, F.lit(1))).otherwise(c))
    out = F.array_join(drawn, "")
    return F.when(form.rlike("[A-F]"), F.upper(out)).otherwise(out)


def _nibble(stream: Column, i: int) -> Column:
    return F.conv(F.substring(stream, i, 2), 16, 10).cast("int")


def _pick(values: list[str], stream: Column, i: int) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(_nibble(stream, i), F.lit(len(values))))


def _name(kind: Column, entity: Column, key: Column, attempt: Column) -> Column:
    """A name of the kind, script and gender: given ones from the lists at first, all others built of syllables.

    Every third attempt has a syllable more, so the forms never run out.
    """
    stream = _stream(key, 1)
    more = F.floor(attempt / 3).cast("int")

    def build(script: str, gender: str) -> Column:
        some = F.array(*[_pick(SYLLABLES[script], stream, 2 * i + 1) for i in range(24)])
        ending = F.when(kind == "family", F.lit(ENDINGS[script, gender])).otherwise(F.lit(GIVEN_ENDINGS[script, gender]))
        made = F.initcap(F.concat(F.array_join(F.slice(some, 1, F.least(F.lit(24), F.when(kind == "family", 3).otherwise(2) + more)), ""), ending))
        return F.when((kind == "given") & (attempt == 0), _pick(NAMES[script, gender], stream, 1)).otherwise(made)

    female, cyrillic = entity.startswith("f "), entity.rlike(r"\p{IsCyrillic}")
    return F.when(cyrillic & female, build("cyrillic", "f")).when(cyrillic, build("cyrillic", "m")).when(female, build("latin", "f")).otherwise(build("latin", "m"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    each = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def draw(kind: Column, entity: Column, secret: Column, attempt: Column) -> Column:
    """The surrogate of an entity in its canonical form."""
    key = F.concat_ws("|", secret, kind, entity, attempt.cast("string"))
    stream = _stream(key, 1)
    like = _like(entity, key)
    body = F.left(like, F.length(entity) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    address = F.concat_ws(".", *[F.pmod(_nibble(stream, 2 * i + 1), F.lit(223 if not i else 254)) + 1 for i in range(4)])
    suffix = F.regexp_extract(entity, r"(?:@example|\.example)?\.[^.@]+$", 0)
    email = F.concat(F.left(like, F.length(entity) - F.length(suffix)), suffix)
    return (
        F.when(kind.isin("given", "family"), _name(kind, entity, key, attempt))
        .when(kind == "ip", address)
        .when(kind == "ip6", _hexed(entity, key))
        .when((kind == "card") & (_luhn(entity) == 0), F.concat(body, check))
        .when(kind == "email", email)
        .when(kind == "key", F.concat(F.left(entity, F.lit(4)), F.substring(like, 5, 100)))
        .when(kind == "iban", F.concat(F.left(entity, F.lit(2)), F.substring(like, 3, 100)))
        .when((kind == "token") | (kind == "secret") & entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _hexed(entity, key))
        .otherwise(like)
    )


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, entity (distinct rows) with ``surrogate``: distinct within a kind, and no entity of the kind.

    Each round draws for the entities that have none yet and accepts, of those that drew the same, the one
    that sorts first, unless an accepted one or an entity has it. The rounds shrink fast; a kind whose
    forms run out (as with one-digit secrets) gets longer surrogates from the eighth round on.
    """
    known = stash(entities.select("kind", "entity").distinct(), "entities")
    taken = known.select("kind", F.col("entity").alias("surrogate"))
    open_, accepted, attempt = known, [], 0
    order = Window.partitionBy("kind", "surrogate").orderBy(F.xxhash64("entity"), "entity")
    while True:
        drawn = open_.withColumn("surrogate", draw(F.col("kind"), F.col("entity"), F.lit(secret), F.lit(attempt)))
        if attempt >= 8:
            named = F.col("kind").isin("given", "family")
            drawn = drawn.withColumn("surrogate", F.when(named, F.col("surrogate")).otherwise(F.concat("surrogate", _like(F.lit("0" * (attempt - 7)), F.concat_ws("|", F.lit(secret), "entity", F.lit(attempt).cast("string"))))))
        marked = F.col("kind").isin("given", "family") & F.col("entity").rlike("^[fm] ")
        form = F.when(marked, F.concat(F.left("entity", F.lit(2)), "surrogate")).otherwise(F.col("surrogate"))
        drawn = stash(drawn.withColumn("form", form).withColumn("nth", F.row_number().over(order)), f"drawn{attempt}")
        free = drawn.where("nth = 1").join(taken.select("kind", F.col("surrogate").alias("form")), ["kind", "form"], "left_anti")
        done = stash(free.select("kind", "entity", "surrogate", "form"), f"accepted{attempt}")
        accepted.append(done)
        rest = stash(open_.join(done, ["kind", "entity"], "left_anti"), f"open{attempt}")
        drop_stash(drawn)
        if rest.isEmpty():
            break
        taken = taken.unionByName(done.select("kind", F.col("form").alias("surrogate")))
        open_, attempt = rest, attempt + 1
    out = accepted[0]
    for a in accepted[1:]:
        out = out.unionByName(a)
    return out.select("kind", "entity", "surrogate")


def _render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format."""
    chars = F.filter(F.split(mention, ""), lambda c: c != "")
    n = F.length(_digits(mention))

    def digit(c: Column, i: Column) -> Column:
        at = F.length(_digits(F.substring(mention, F.lit(1), i + 1))) - (n - F.length(surrogate))
        return F.when(c.rlike("^[0-9]$") & (at > 0), F.substring(surrogate, at, F.lit(1))).otherwise(c)

    def spaced(c: Column, i: Column) -> Column:
        return F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.replace(F.substring(mention, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))

    head = F.when(kind == "person", F.regexp_extract(mention, _NAME, 0)).otherwise(F.regexp_extract(mention, _VALUE, 0))
    cased = F.when(F.upper(mention) == mention, F.upper(surrogate)).otherwise(surrogate)
    return (
        F.when(kind.isin("phone", "card", "ssn") & (F.length(surrogate) <= n), F.array_join(F.transform(chars, digit), ""))
        .when((kind == "iban") & (F.length(surrogate) == F.length(F.replace(mention, F.lit(" "), F.lit("")))), F.array_join(F.transform(chars, spaced), ""))
        .when(kind.isin("person", "secret"), F.concat(head, surrogate))
        .when(kind == "email", cased)
        .otherwise(surrogate)
    )


def _bare(text: Column, names: Column) -> tuple[Column, Column]:
    """``text`` with the full names (structs old, new) that stand in it without a title replaced, and how many do."""
    longest = F.array_sort(names, lambda x, y: F.length(y["old"]) - F.length(x["old"]))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(longest, lambda x: x["old"]), "|"), F.lit(r")(?!\p{L})"))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    new = F.map_from_entries(F.transform(names, lambda x: F.struct(x["old"].alias("key"), x["new"].alias("value"))))
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda s, m: F.concat(s, F.coalesce(F.element_at(new, m), F.lit("")))), "")
    some = F.size(names) > 0
    return F.when(some, whole).otherwise(text), F.when(some, F.size(found)).otherwise(0)


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the mentions in ``text`` replaced, and ``n_entities`` (mentions found).

    ``secret`` is the key; who has it can draw the surrogates of a guessed entity again, so it must not be published.

    Null and empty texts and those without mentions stay as they are, with 0. The same key, mention and set
    of entities always give the same surrogate; equal texts get equal results, so rows are told apart by
    their text alone and need no id. Only texts with mentions are shuffled. A column n_entities is replaced.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    # a row's own columns travel in a struct, so that none can clash with those made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    t = F.col("t")
    maybe = F.coalesce(hinted(t), F.lit(False))
    found = rows.where(maybe).withColumn("_m", mentions(t))
    keys = {"_a": F.xxhash64(t), "_b": F.xxhash64(t, F.lit(1))}
    with scratch() as keep:
        listed = keep(stash(found.where(F.size("_m") > 0).select(*[v.alias(k) for k, v in keys.items()], "_m").distinct(), "mentions"))
        single = listed.select(F.explode(F.array_distinct("_m")).alias("mention")).distinct()
        kinds = stash(single.withColumn("kind", kind_of(F.col("mention"))).withColumn("entity", canonical(F.col("kind"), F.col("mention"))), "kinds")
        parts = stash(name_parts(kinds), "nameparts")
        others = kinds.where("kind <> 'person'")
        new = surrogates(others.select("kind", "entity").unionByName(parts.select("kind", "entity")), secret)
        plain_ = others.join(new, ["kind", "entity"]).select("mention", _render(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), F.lit(None).cast("struct<old: string, new: string>").alias("name"))
        words = F.array_sort(F.collect_list(F.struct("pos", "surrogate")))
        named = parts.join(new, ["kind", "entity"]).groupBy("mention").agg(F.array_join(F.transform(words, lambda x: x["surrogate"]), " ").alias("full"), F.count(F.lit(1)).alias("n"))
        old = F.regexp_replace("mention", _NAME, "")
        full = F.when(F.col("n") > 1, F.struct(old.alias("old"), F.col("full").alias("new")))
        named = named.select("mention", F.concat(F.regexp_extract("mention", _NAME, 0), "full").alias("new"), full.alias("name"))
        put = keep(stash(plain_.unionByName(named), "replacements"))
    # the replacements of a text in the order of its mentions; a very common mention is one key of a join, which Spark can split
    each = listed.select("_a", "_b", F.posexplode("_m").alias("pos", "mention")).join(put, "mention")
    by_text = each.groupBy("_a", "_b").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_new"), F.collect_set("name").alias("_names"))
    hit = found.where(F.size("_m") > 0).withColumns(keys).join(by_text, ["_a", "_b"])
    between = F.split(t, ANY, -1)
    whole = F.array_join(F.zip_with(between, F.col("_new"), lambda s, m: F.concat(s, F.coalesce(m["new"], F.lit("")))), "")
    whole, more = _bare(whole, F.col("_names"))
    replaced = hit.select("row", whole.alias("t"), (F.size("_m") + more).alias("n_entities"))
    plain = rows.where(~maybe | (F.size(mentions(t)) == 0)).select("row", "t", F.lit(0).alias("n_entities"))
    out = replaced.unionByName(plain)
    return out.select(*[(t if c == text else F.col("row").getField(c)).alias(c) for c in columns], "n_entities")


#: Setting with the key of the query; without it a key is drawn that nobody keeps.
KEY = "spark.folio.pii.key"


def op3_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_entities and the text with surrogates, of all documents."""
    key = spark.conf.get(KEY, None) or secrets.token_hex(32)
    got = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return got.select("doc_id", F.col("n_entities").cast("long").alias("n_entities"), "text")
