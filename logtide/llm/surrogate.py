"""Personal data and secrets replaced by keyed, type-consistent surrogates, in DataFrame functions only.

One pattern finds all entities of a text. An entity's canonical form (its letters and digits without
punctuation and case) and a key determine its surrogate, so it reads alike wherever and however it is
written; digits stay digits, letters letters, and punctuation, spacing and case are those of the original.
A name is found after a title and exchanged part by part, so a person keeps one surrogate across titles,
full and short forms; in a text that names someone, the parts of the name are exchanged without a title
too. Parts keep their script, and given names the gender that titles tell anywhere in the table.
A table of the distinct entities checks that no two share a surrogate and that none is another one's
original, and tries again where they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Titles that precede a name.
FEMALE, MALE, EITHER = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Sra|Señora|Doña|Г-жа|MRS|MISS|FRAU", "Mr|Herr|Monsieur|Sr|Señor|Don|Г-н|MR|HERR", "Dr|Prof"
_TITLE = rf"(?:{FEMALE}|{MALE}|{EITHER})"
_TITLES = rf"(?:{_TITLE}\.? )++"
#: A capitalised word without a possessive ending.
_WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))\p{L})++"
#: A name ends before the next title; initials belong to it.
_PART = rf"(?:{_WORD}|\p{{Lu}}\.(?= \p{{Lu}}))"
_NAME = rf"(?!{_TITLE}\b){_PART}(?: (?!{_TITLE}\b){_PART})*+"
#: What has a surrogate of its own within a name.
_PIECE = r"\p{L}++(?:['’]\p{L}++)*+"

# What precedes a secret, and the beginnings of keys.
_LABEL = r"(?i:password|passwd|pwd|passphrase|secret|token|(?:api|access|secret|private)[_-]?key)"
_KEY = r"(?:AKIA|ASIA|github_pat_|gh[pousr]_|glpat-|sk[-_]|pk[-_]|xox[abprs]-|AIza|eyJ)"
_SECRET = r"""\s"'`<>(){}\[\],;|"""
_H = "[0-9A-Fa-f]{1,4}"
_BEGIN, _END = r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----", r"-----END [A-Z0-9 ]*?PRIVATE KEY-----"
_SET = r"""["']?\s*+[=:]"""
_ASSIGNED = rf"""(?<!-)(?:(?!{_LABEL}{_SET})[A-Za-z0-9]++[_-])*+{_LABEL}{_SET}\s*+["'`]?"""

#: Kind, pattern of the entity in a text, from where no letter, digit or _ precedes. Of several that match at a place the first counts.
#: Repeated groups without a bound are possessive, so that a search takes neither stack nor quadratic time.
PATTERNS = (
    ("block", rf"{_BEGIN}(?:(?:\s*+[A-Za-z-]++: [^\n]*+)*+(?:\s*+[A-Za-z0-9+/=]++)++\s*+{_END}|(?:\s++[A-Za-z0-9+/=]{{40,}}+)++)"),
    ("secret", rf"{_ASSIGNED}(?=[^{_SECRET}]*[A-Za-z0-9])[^{_SECRET}]{{5,}}[^{_SECRET}.!?:]"),
    ("email", r"(?<![.%+-])[\p{L}\p{N}._%+-]++@(?=[\p{L}\p{N}.-]*\.\p{L}{2})[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("key", rf"{_KEY}[A-Za-z0-9_.=-]{{11,}}[A-Za-z0-9_=]"),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("ip6", rf"(?<!:)(?=[A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?:(?:\.\d{{1,3}}){{3}})?(?![\w:])"),
    ("card", r"(?<![.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<!\.)(?:\+\d[\d ().-]{6,22}\d|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}|(?<![-/])[2-9]\d{9}(?!\.?\d))(?![\w])"),
    ("ssn", r"(?<![.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("name", rf"(?=\p{{Lu}})(?<!{_TITLE}\.? ){_TITLES}{_NAME}"),
)
_START = r"(?<![\p{L}\p{N}_])"
ENTITY = rf"{_START}(?:{'|'.join(f'(?:{p})' for _, p in PATTERNS)})"
#: In a text that names someone, capitalised words are looked at too.
WITH_WORDS = rf"{_START}(?:{'|'.join(f'(?:{p})' for _, p in PATTERNS)}|(?:{_WORD}))"
SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
LATIN, CYRILLIC, GREEK = "abdefgiklmnoprstuvz", "абдефгиклмнопрстувз", "αβδεφγικλμνοπρστυωζ"
#: Attempts after which a surrogate that still collides grows longer, where its kind has no fixed length.
PATIENCE = 5


def kind_of(value: Column) -> Column:
    """The kind of a found entity, from its own form; ``word`` for a capitalised word without a title."""
    only = lambda p: value.rlike(rf"^(?:{p})$")
    first = F.when(only(PATTERNS[0][1]), F.lit("block"))
    for kind, pattern in PATTERNS[1:]:
        first = first.when(only(pattern), F.lit(kind))
    return first.when(only(_WORD), F.lit("word")).otherwise(F.lit("secret"))


def framed(kind: Column, value: Column) -> Column:
    """What stays before, the entity itself, what stays after: a secret's label, a key block's frame, a name's titles."""
    before = F.when(kind == "secret", F.regexp_extract(value, rf"^{_ASSIGNED}", 0)).when(kind == "block", F.regexp_extract(value, rf"^{_BEGIN}(?:\s*+[A-Za-z-]++: [^\n]*+)*+", 0))
    before = before.when(kind == "name", F.regexp_extract(value, rf"^{_TITLES}", 0)).otherwise(F.lit(""))
    after = F.when(kind == "block", F.regexp_extract(value, rf"{_END}$", 0)).otherwise(F.lit(""))
    body = F.substr(value, F.length(before) + 1, F.length(value) - F.length(before) - F.length(after))
    return F.struct(before.alias("before"), body.alias("body"), after.alias("after"))


def canonical(kind: Column, body: Column) -> Column:
    plain = F.upper(F.regexp_replace(body, "[^A-Za-z0-9]", ""))
    mail = F.regexp_replace(F.lower(body), "^[.%+-]+", "")
    ip6 = F.regexp_replace(F.lower(body), "(?<![0-9a-f])0+(?=[0-9a-f])", "")
    return F.when(kind.isin("secret", "key", "block", "ip"), body).when(kind == "email", mail).when(kind == "ip6", ip6).when(kind.isin("name", "word"), F.lower(body)).otherwise(plain)


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, not again for each element that f goes through."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _byte(seed: Column, i: Column) -> Column:
    """The i-th number below 256 of a keyed stream."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(i / 32).cast("string")), 256)
    return F.conv(F.substring(block, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _changes(c: Column) -> Column:
    """Whether a character of an entity is exchanged; punctuation and spaces stay."""
    return c.rlike(r"^(?:[A-Za-z0-9]|[^\x00-\x7F])$")


def _shaped(kind: Column, canon: Column, seed: Column) -> Column:
    """Letters and digits of the canonical form, each exchanged for one of its class; some stay."""
    chars = F.filter(F.split(canon, ""), _changes)
    mark = F.length(F.regexp_replace(F.regexp_extract(canon, rf"^{_KEY}", 0), "[_-]", ""))
    head = F.when(kind.isin("phone", "card"), F.lit(1)).when(kind == "iban", F.lit(2)).when(kind == "key", mark).otherwise(F.lit(0))
    tail = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\.(\p{L}+)$", 1))).otherwise(F.lit(0))
    base16 = canon.rlike("^[0-9a-f]{12,}$") | canon.rlike("^[0-9A-F]{12,}$")

    def one(x, c, i):
        b = _byte(x["seed"], i)
        span = F.when(x["base16"], F.lit(6)).otherwise(F.lit(26))
        first = F.when(c.rlike("[A-Z]"), F.lit(65)).otherwise(F.lit(97))
        new = F.when(c.rlike("[0-9]"), (b % 10).cast("string")).otherwise(F.char(first + b % span))
        return F.when((i < x["head"]) | (i >= F.size(x["chars"]) - x["tail"]), c).otherwise(new)

    known = F.struct(chars.alias("chars"), head.alias("head"), tail.alias("tail"), base16.alias("base16"), seed.alias("seed"))
    return _once(known, lambda x: F.array_join(F.transform(x["chars"], lambda c, i: one(x, c, i)), ""))


def _luhn(number: Column) -> Column:
    """The last digit that gives a number of cards, without it, a valid checksum."""
    digits = F.split(F.reverse(number), "")
    worth = F.transform(digits, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return ((10 - F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10) % 10).cast("string")


def _checked(kind: Column, canon: Column, made: Column) -> Column:
    """A card number's surrogate is as valid as the card number."""
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - 1)
    valid = (kind == "card") & (_luhn(body(canon)) == F.right(canon, F.lit(1)))
    return _once(made, lambda m: F.when(valid, F.concat(body(m), _luhn(body(m)))).otherwise(m))


def _named(canon: Column, gender: Column, key: str, attempt: Column) -> Column:
    """A made-up part of a name in the original's script; a given name ends by gender."""
    syllable = F.array(*map(F.lit, SYLLABLES))
    seed = F.concat_ws("|", F.lit(key), F.lit("name"), canon, attempt.cast("string"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), lambda k: F.get(syllable, _byte(seed, k) % len(SYLLABLES))), "")
    made = F.concat(body, F.when(gender == "f", F.lit("na")).when(gender == "m", F.lit("ro")).otherwise(F.lit("")))
    return F.when(canon.rlike(r"\p{IsCyrillic}"), F.translate(made, LATIN, CYRILLIC)).when(canon.rlike(r"\p{IsGreek}"), F.translate(made, LATIN, GREEK)).otherwise(made)


def surrogate(kind: str, canon: str, key: str, attempt: str, gender: str = "gender") -> Column:
    """The surrogate's canonical form; after a ``+`` what it is longer than the original."""
    kind, canon, attempt, gender = F.col(kind), F.col(canon), F.col(attempt), F.col(gender)
    brief = F.when(F.length(canon) > 200, F.sha2(canon, 256)).otherwise(canon)  # the seed is hashed once for every 32 characters
    seed = F.concat_ws("|", F.lit(key), kind, brief, attempt.cast("string"))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + _byte(seed, i) % 254).cast("string")), ".")
    ip6 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.concat(F.hex(1 + _byte(seed, i) % 15), F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 5, 3)))), ":")
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.char(97 + _byte(seed, 97 + i) % 26)), "")
    longer = F.when((attempt >= PATIENCE) & kind.isin("email", "secret", "key", "block"), F.concat(F.lit("+"), more)).otherwise(F.lit(""))
    return (
        F.when(kind == "name", _named(canon, gender, key, attempt)).when(kind == "ip", ip).when(kind == "ip6", ip6)
        .otherwise(F.concat(_checked(kind, canon, _shaped(kind, canon, seed)), longer))
    )


def rendered(kind: Column, body: Column, new: Column) -> Column:
    """A surrogate written as the original was: its punctuation, spacing and case."""

    def cased(c, put):
        return F.when(kind.isin("secret", "key", "block"), put).when(c.rlike("[A-Z]"), F.upper(put)).when(c.rlike("[a-z]"), F.lower(put)).otherwise(put)

    def filled(marked):
        own = F.filter(marked, lambda x: _changes(x["c"]))
        puts = F.zip_with(own, F.split(F.substring_index(new, "+", 1), ""), lambda x, p: F.struct(x["i"].alias("i"), cased(x["c"], F.coalesce(p, F.lit(""))).alias("c")))
        return F.array_join(F.transform(F.array_sort(F.concat(F.filter(puts, lambda x: x["i"].isNotNull()), F.filter(marked, lambda x: ~_changes(x["c"])))), lambda x: x["c"]), "")

    whole = _once(F.transform(F.split(body, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), filled)
    more = F.when(F.instr(new, "+") > 0, F.substring_index(new, "+", -1)).otherwise(F.lit(""))
    whole = F.when(kind == "email", F.concat(F.substring_index(whole, "@", 1), more, F.lit("@"), F.substring_index(whole, "@", -1))).otherwise(F.concat(whole, more))
    name = F.when((F.length(body) > 1) & (F.upper(body) == body), F.upper(new)).otherwise(F.initcap(new))
    return F.when(kind == "name", name).when(kind.isin("ip", "ip6"), new).otherwise(whole)


def assign(entities: DataFrame, key: str, scratch: Scratch, *, rounds: int = 20) -> DataFrame:
    """(kind, canon, new) for distinct entities (kind, canon, and gender of names), one to one within a kind, no surrogate an original.

    Of entities that share a surrogate the smallest keeps it and the others try the next; an error ends
    the search when ``rounds`` attempts leave some without one.
    """
    entities = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit(""))
    plain = lambda c: F.upper(F.when(F.col("kind").isin("name", "ip", "ip6"), F.col(c)).otherwise(F.regexp_replace(c, r"[^A-Za-z0-9]", "")))
    real = scratch.save(entities.select(F.col("kind").alias("k0"), plain("canon").alias("c0")).distinct(), "originals")
    state = scratch.save(entities.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(rounds):
        made = scratch.save(state.withColumn("new", surrogate("kind", "canon", key, "attempt")), "surrogates")
        shared = made.groupBy("kind", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n"))
        taken = shared.join(real, (F.col("kind") == F.col("k0")) & (plain("new") == F.col("c0")), "left_semi").select("kind", "new", F.lit(None).cast("string").alias("first"))
        clash = scratch.save(shared.filter("n > 1").select("kind", "new", "first").unionByName(taken).select(F.col("kind").alias("g"), F.col("new").alias("s"), "first"), "clashes")
        if not clash.limit(1).count():
            return made.select("kind", "canon", "new")
        lost = made.join(clash, (F.col("kind") == F.col("g")) & (F.col("new") == F.col("s")), "left").groupBy("kind", "canon", "gender", "attempt").agg(
            F.max(F.col("g").isNotNull() & (F.col("first").isNull() | (F.col("first") != F.col("canon")))).alias("again")
        )
        state = scratch.save(lost.select("kind", "canon", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")), "entities")
    raise RuntimeError(f"surrogates still collide after {rounds} attempts; use another key")


def pseudonymize(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities.

    A null text stays null with no entities; an empty one stays empty. Ids may be null or repeat: equal
    texts get equal texts. Other columns are ignored. Texts and entities can be of any length. A word of a
    found name counts as that name wherever the text has it capitalised, even where it means something else.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return replace(rows, key=key).select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


def replace(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, surrogates in the text, and _n_entities added."""
    scratch = Scratch(docs.sparkSession, "surrogates")
    found = F.regexp_extract_all(text_col, F.lit(ENTITY), F.lit(0))
    rows = docs.withColumn("_pii_found", F.when(F.size(found) > 0, found))
    rows = rows.withColumn("_pii_named", F.coalesce(F.exists("_pii_found", lambda v: v.rlike(rf"^{_TITLES}\p{{Lu}}")), F.lit(False)))
    rows = scratch.save(rows.withColumn("_pii_found", F.when(F.col("_pii_named"), F.regexp_extract_all(text_col, F.lit(WITH_WORDS), F.lit(0))).otherwise(F.col("_pii_found"))), "found")
    some = rows.filter("_pii_found is not null").withColumn("_pii_key", F.unhex(F.md5(F.col(text_col).cast("binary"))))
    spans = some.select("_pii_key", F.posexplode("_pii_found").alias("i", "value")).distinct().withColumn("kind", kind_of(F.col("value")))
    spans = scratch.save(spans.withColumn("x", framed(F.col("kind"), F.col("value"))).select("_pii_key", "i", "value", "kind", "x.*"), "spans")
    pieces = _pieces(spans, scratch)
    gender = F.when(F.max("female") & ~F.max("male"), F.lit("f")).when(F.max("male") & ~F.max("female"), F.lit("m")).otherwise(F.lit(""))
    table = assign(pieces.filter("canon is not null").groupBy("kind", "canon").agg(gender.alias("gender")), key, scratch)
    named = table.select(F.col("kind").alias("k"), F.col("canon").alias("c"), "new")
    initial = F.char(65 + _byte(F.concat_ws("|", F.lit(key), F.lit("initial"), F.col("body")), F.lit(0)) % 26)
    put = F.when(F.col("new").isNotNull(), rendered(F.col("kind"), F.col("body"), F.col("new"))).when(F.col("initial"), initial).otherwise(F.col("body"))
    filled = pieces.join(named, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left")
    filled = filled.select("_pii_key", "i", "j", F.concat("before", put, "after").alias("put"), (F.col("new").isNotNull() & (F.col("j") == 0) | F.col("initial") & (F.col("j") == 0)).cast("int").alias("n"))
    puts = filled.groupBy("_pii_key", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "put"))), lambda p: p["put"]), "").alias("put"), F.max("n").alias("n"))
    puts = puts.groupBy("_pii_key").agg(F.array_sort(F.collect_list(F.struct("i", "put"))).alias("_pii_puts"), F.sum("n").alias("_n_entities"))  # bounded by one text
    gaps = F.when(F.col("_pii_named"), F.split(text_col, WITH_WORDS, -1)).otherwise(F.split(text_col, ENTITY, -1))
    changed = some.join(puts.withColumnRenamed("_pii_key", "_pii_k"), F.col("_pii_key") == F.col("_pii_k"))
    text = F.array_join(F.zip_with(gaps, F.transform("_pii_puts", lambda p: p["put"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    done = changed.select(*others, text.alias(text_col), "_n_entities")
    rest = rows.filter("_pii_found is null").select(*others, text_col, F.lit(0).cast("bigint").alias("_n_entities"))
    return done.unionByName(rest)


def _pieces(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """What is exchanged as one: (_pii_key, i, j, kind, canon, body, before, after, female, male, initial).

    A name falls into its parts with what stands between them; a capitalised word is a part of a name where
    its text names it, and else has no canonical form and stays.
    """
    no = F.lit(False)
    plain = spans.filter("kind not in ('name', 'word')").select("_pii_key", "i", F.lit(0).alias("j"), "kind", canonical(F.col("kind"), F.col("body")).alias("canon"), "body", "before", "after", no.alias("female"), no.alias("male"), no.alias("initial"))
    own = F.arrays_zip(F.split("body", _PIECE, -1).alias("gap"), F.regexp_extract_all("body", F.lit(_PIECE), F.lit(0)).alias("part"))
    names = spans.filter("kind = 'name'").select("_pii_key", "i", "before", F.size(F.regexp_extract_all("body", F.lit(_PIECE), F.lit(0))).alias("n"), F.posexplode(own).alias("j", "p"))
    given = (F.col("j") == 0) & (F.col("n") > 1)
    titled = lambda t: given & F.col("before").rlike(rf"(?:^| )(?:{t})\.? ")
    part = F.coalesce("p.part", F.lit(""))
    names = names.select(
        "_pii_key", "i", "j", F.lit("name").alias("kind"), F.when(F.length(part) > 1, F.lower(part)).alias("canon"), part.alias("body"),
        F.concat(F.when(F.col("j") == 0, F.col("before")).otherwise(F.lit("")), "p.gap").alias("before"), F.lit("").alias("after"), titled(FEMALE).alias("female"), titled(MALE).alias("male"), (F.length(part) == 1).alias("initial"),
    )
    names = scratch.save(names, "names")
    known = names.filter("canon is not null").select(F.col("_pii_key").alias("k"), F.col("canon").alias("c")).distinct()
    bare = spans.filter("kind = 'word'").select("_pii_key", "i", F.regexp_extract_all("body", F.lit(_PIECE), F.lit(0)).alias("parts"), F.split("body", _PIECE, -1).alias("gaps"))
    bare = bare.select("_pii_key", "i", F.posexplode(F.arrays_zip(F.col("gaps").alias("gap"), F.col("parts").alias("part"))).alias("j", "p"))
    bare = bare.select("_pii_key", "i", "j", F.lower("p.part").alias("lower"), F.coalesce("p.part", F.lit("")).alias("body"), F.coalesce("p.gap", F.lit("")).alias("before"))
    bare = bare.join(known, (F.col("_pii_key") == F.col("k")) & (F.col("lower") == F.col("c")), "left").select("_pii_key", "i", "j", F.lit("name").alias("kind"), F.col("c").alias("canon"), "body", "before", F.lit("").alias("after"), no.alias("female"), no.alias("male"), no.alias("initial"))
    return scratch.save(plain.unionByName(names).unionByName(bare), "pieces")
