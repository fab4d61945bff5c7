"""Keyed surrogates for personal data, as DataFrame operations.

Mentions are found by one pattern, reduced to the entity behind them (digits of a number, lower
case of an address or a name's word), and every distinct entity of the corpus gets one surrogate from
a keyed digest: so a person, card or address keeps one stand-in in all documents and all ways of
writing it. Surrogates keep the kind and the form: digits stay digits with their punctuation, letters stay in
their case and in their script where that is Latin, Cyrillic, Greek or Armenian (others take Latin letters), card and account
numbers keep their first digit or country and valid check digits, phone numbers with a + or 00 their
country code, addresses a valid form in ranges that no one owns, secrets (keys with a known prefix, and what
follows on token = and the like) their length and alphabet, given names their gender and script. Entities that would
share a surrogate, or be given another entity of the corpus, draw again until none does; listed given names change places among
themselves, one for one, those of both genders apart. Texts are rebuilt from what lies between mentions, so a surrogate is never read again.

A name is a title or a given name of the table, with what initials, particles and capitalised
words follow on it; every such word but titles and particles is replaced. The words of a
document's names are mentions wherever else they stand in that document.

Defined cases: a null text stays null with no mentions; a null id is kept; repeated rows are
treated alike; other columns pass through, but one named like the count is replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

import csv
import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, keep

with (Path(__file__).parent / "given_names.csv").open(encoding="utf-8", newline="") as _file:
    #: Given names by script and gender.
    GIVEN = {(r["script"], r["gender"]): r["names"] for r in csv.DictReader(_file)}
#: The most rows a table of given names may have: it becomes one pattern and is sent to all.
MOST_GIVEN = 100_000
TITLES = "Mr Mrs Ms Dr Herr Frau"
PARTICLES = "von van der den de del della di da dos du la le ter zu zum bin ibn al el"
#: Capitalised at the start of a sentence, and no one's name.
NO_NAMES = "The And Of For In On At To Is Was It She We They You But Or With By From This That Und Die Das Der Ist Mit Et Elle Les Des Los Las Que"
# Letters by script.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"Cyrillic": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"}

# tried once for each run of letters and digits, so that long texts without blanks take no longer than others
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,40}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
IBAN = r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"
# Prefixes of keys, and what a secret is called before it.
SECRET = (
    r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![\w-])"
    r"|(?<=[:=\s\"'])(?=[A-Za-z0-9_+/=-]{12})(?<=(?i:token|secret|password|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?=[A-Za-z_+/=.-]{0,64}\d)[A-Za-z0-9_+/=-]{12,}"
)
CARD = r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w.])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])00[1-9]\d{0,2}[ .-]\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.])\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,4}){0,2}(?!\w)"
# Calling codes of countries, those of one and two digits; the rest have three.
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
KINDS = {"secret": SECRET, "ip": IP, "ip6": IP6, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE}
PRIVATE = "|".join((SECRET, EMAIL, IP, IP6, IBAN, CARD, SSN, PHONE))
LETTER, BLANKS, SPACES = r"[\p{L}\p{M}]", r"[\s\p{Z}]+", r"[ \t\p{Zs}]+"
# A word of a name, whole: capitals inside, after hyphens and apostrophes; not the 's behind it, not the start of an address.
WORD = (
    rf"(?!(?:{'|'.join(NO_NAMES.split())})(?!{LETTER}))(?>(?:\p{{Lu}}['’](?=\p{{Lu}}{LETTER}))?\p{{Lu}}{LETTER}*(?:[-‐‑]\p{{L}}{LETTER}*|['’](?:\p{{Lu}}{LETTER}+|{LETTER}{{3,}}))*)"
    rf"(?!{LETTER})(?![A-Za-z0-9._%+-]{{0,255}}@)"
)
LONG = rf"(?=\p{{L}}['’]?{LETTER}){WORD}"
INITIAL = r"(?:(?:\p{Lu}\.){2,4}|\p{Lu}\.?)"
ALONE = rf"(?<!{LETTER}){LONG}"
#: A mention's words; what else it holds are blanks.
TOKEN = r"[dl]['’](?=\p{Lu})|[^\s\p{Z}]+"


def any_of(words: list[str]) -> str:
    """One pattern of many words that looks at each of their letters once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def walk(at: dict) -> str:
        parts = [("" if c.isalnum() else "\\") + c + walk(below) for c, below in sorted(at.items()) if c]
        return "" if not parts else (parts[0] if len(parts) == 1 and "" not in at else f"(?:{'|'.join(parts)})" + ("?" if "" in at else ""))

    return walk(tree)


def name_pattern(given: list[str]) -> str:
    """Title or given name, more given names and initials over any blanks, then words and particles; further words on the same line."""
    titles = "|".join(t for w in TITLES.split() for t in (w, w.upper()))
    first = rf"{any_of([x for g in given for x in (g, g.upper())])}(?:-\p{{Lu}}{LETTER}*)*"
    link = rf"(?:(?:{'|'.join(PARTICLES.split())}){BLANKS})*(?:[dl]['’])?"
    more = rf"(?:{INITIAL}{SPACES})?(?:(?:{'|'.join(PARTICLES.split())}){SPACES})*(?:[dl]['’])?"
    return rf"(?<!{LETTER})(?:(?:(?:{titles})\.?{BLANKS})+|{first}{BLANKS})(?:(?:{first}|{INITIAL}){BLANKS})*{link}{LONG}(?:{SPACES}{more}{LONG})*"


def kind_of(mention: Column) -> Column:
    kinds = F.when(mention.contains("@"), "email")
    for name, pattern in list(KINDS.items())[1:]:
        kinds = kinds.when(mention.rlike(f"^(?:{pattern})$"), name)
    # secrets are known by what stands before them; whatever else there is begins with a name's words
    return kinds.when(mention.rlike(rf"^(?!.*\s)(?=.*\d)[A-Za-z0-9_+/=-]{{12,}}$"), "secret").otherwise("name")


def bare(word: Column) -> Column:
    """A name's word whatever its case and apostrophe."""
    return F.lower(F.translate(word, "’‐‑", "'--"))


def entity_of(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(mention, r"\D", "")
    called = F.when(mention.startswith("+"), F.concat(F.lit("+"), digits)).when(mention.startswith("00"), F.concat(F.lit("+"), F.substring(digits, 3, 30))).otherwise(digits)
    out = F.when(kind.isin("email", "ip6"), F.lower(mention)).when(kind.isin("ip", "secret"), mention).when(kind == "name", bare(mention))
    return out.when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "phone", called).otherwise(digits)


def draw(seed: Column, at: Column, size: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, at), size if isinstance(size, Column) else F.lit(size)).cast("int")


def disguised(value: Column, seed: Column) -> Column:
    """Every digit and letter drawn anew, within digits and within its script and case."""

    def one(c, i):
        new = F.lit(LATIN)
        for script, letters in SCRIPTS.items():
            new = F.when(c.rlike(rf"\p{{Is{script}}}"), letters).otherwise(new)
        new = F.substring(new, draw(seed, i, F.char_length(new)) + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), draw(seed, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(new)).when(c.rlike(r"\p{L}"), new).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def check_digit(body: Column) -> Column:
    """The digit that makes a number whose other digits are body pass the card check."""
    digits = F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(digits, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def account_check(country: Column, body: Column) -> Column:
    """The two digits behind the country of an account number that make it pass its check: letters count from 10, the whole is 1 modulo 97."""
    digits = F.transform(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(digits, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def hexadecimal(value: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), draw(seed, i, 16) + 1, F.lit(1))), "")


def surrogate_of(kind: Column, entity: Column, seed: Column) -> Column:
    drawn = disguised(entity, seed)
    local = F.element_at(F.split(drawn, "@"), 1)
    domain = F.concat(F.lit("mail"), draw(seed, F.lit("d"), 100_000).cast("string"), F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), draw(seed, F.lit("t"), 3) + 1))
    ip = F.concat_ws(".", F.lit("10"), *[draw(seed, F.lit(f"o{k}"), 256).cast("string") for k in range(3)])
    ip6 = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(F.sha2(F.concat(seed, F.lit("6")), 256), 1, 2)), *[F.substring(F.sha2(F.concat(seed, F.lit("6")), 256), 4 * k + 3, 4) for k in range(7)])
    size = F.char_length(entity)
    # cards of 15 digits keep the two that say so
    body = F.concat(F.when(size == 15, F.substring(entity, F.lit(1), F.lit(2))).otherwise(F.concat(F.substring(entity, 1, 1), F.substring(drawn, 2, 1))), F.substring(drawn, F.lit(3), size - 3))
    card = F.concat(body, F.when(check_digit(F.substring(entity, F.lit(1), size - 1)) == F.substring(entity, -1, 1), check_digit(body)).otherwise(F.substring(drawn, -1, 1)))
    account = F.substring(drawn, 5, 40)
    iban = F.concat(F.substring(entity, 1, 2), account_check(F.substring(entity, 1, 2), account), account)
    prefix = F.regexp_extract(entity, "^(AKIA|gh[pousr]_|sk-)", 1)
    kept = F.char_length(prefix)
    secret = F.when(entity.rlike("^[0-9a-f]+$"), hexadecimal(entity, seed)).otherwise(F.concat(prefix, F.substring(drawn, kept + 1, size)))
    code = F.regexp_extract(entity, CALLING, 1)
    national = F.regexp_replace(F.substring(drawn, F.char_length(code) + 2, F.lit(30)), "^[01]", "5")
    phone = F.when(entity.startswith("+"), F.concat(F.lit("+"), code, national)).otherwise(F.concat(F.substring(entity, 1, 1), F.regexp_replace(F.substring(drawn, 2, 30), "^[01]", "5")))
    longer = F.concat(drawn, F.substring(F.lit(LATIN), draw(seed, F.lit("x"), 26) + 1, F.lit(1)))
    name = F.when((F.char_length(entity) < 6) & entity.rlike("[A-Za-z]$"), longer).otherwise(drawn)
    return F.when(kind == "email", F.concat(local, F.lit("@"), domain)).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "phone", phone).when(kind == "name", name).otherwise(drawn)


def assign(entities: DataFrame, key: str, rounds: int = 200, used: DataFrame | None = None) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities: no two share one, and none gets another's own value; used: (kind, surrogate) that none gets."""
    entities = keep(entities, "entities")
    pending, done = entities.withColumn("attempt", F.lit(0)), None
    for _ in range(rounds):
        seed = F.sha2(F.concat_ws("\n", F.lit(key), "kind", "entity", F.col("attempt").cast("string")), 256)
        tried = pending.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("entity"), seed))
        taken = entities.select("kind", F.col("entity").alias("surrogate"), F.lit(1).alias("real"))
        if used is not None:
            taken = taken.union(used.select("kind", "surrogate", F.lit(1).alias("real")))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate", F.lit(1).alias("real")))
        tried = tried.join(taken.distinct(), ["kind", "surrogate"], "left")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("entity")) == 1
        tried = keep(tried.withColumn("good", F.col("real").isNull() & first), "tried")
        good = tried.where("good").select("kind", "entity", "surrogate")
        done = keep(good if done is None else done.union(good), "surrogates")
        pending = tried.where("not good").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return done
    raise RuntimeError("surrogates are used up")


def given_names(key: str, given: dict[tuple[str, str], str] = GIVEN) -> dict[str, str]:
    """Each given name's stand-in: the next of its gender and script in a keyed order.

    Names of several genders go by themselves, so that no two names have one stand-in. A name that is
    alone in its kind goes with its script's others; alone in that, too, it is drawn like other words.
    """
    kinds: dict[str, set[str]] = {}
    for (script, gender), names in given.items():
        for n in names.split():
            kinds.setdefault(n, set()).add(f"{script} {gender}")
    groups: dict[str, list[str]] = {}
    for n, kind in kinds.items():
        groups.setdefault("+".join(sorted(kind)), []).append(n)
    for kind in [k for k, names in groups.items() if len(names) == 1]:
        others = [k for k in groups if k != kind and k.split(" ")[0] == kind.split(" ")[0]]
        if others:
            groups[max(others, key=lambda k: (len(groups[k]), k))] += groups.pop(kind)
    out: dict[str, str] = {}
    for names in groups.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\n{n}".encode()).digest())
        if len(order) > 1:
            out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def in_case_of(word: Column, new: Column) -> Column:
    """new with capitals where word has them; all capitals stay so."""
    shouted = (F.char_length(word) > 1) & (F.upper(word) == word)
    letters = F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(word, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return F.when(shouted, F.upper(new)).otherwise(F.array_join(letters, ""))


def other_initial(initial: Column, key: str) -> Column:
    """Another letter of the script, the same one for the same letter."""

    def one(c):
        out = F.lit(None).cast("string")
        for letters in (*SCRIPTS.values(), LATIN):
            at = F.greatest(F.instr(F.lit(letters.upper()), c), F.lit(1)) if letters is LATIN else F.instr(F.lit(letters.upper()), c)
            out = F.coalesce(out, F.when(at > 0, F.substring(F.lit(letters.upper()), F.pmod(at + draw(F.sha2(F.concat_ws("\n", F.lit(key), c), 256), F.lit("i"), len(letters) - 1), F.lit(len(letters))) + 1, F.lit(1))))
        return F.when(c == ".", c).otherwise(out)

    return F.array_join(F.transform(F.split(initial, ""), one), "")


def written(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own form."""
    plain = F.regexp_replace(surrogate, r"[^0-9A-Za-z]", "")
    plain = F.when(mention.startswith("00") & surrogate.startswith("+"), F.concat(F.lit("00"), plain)).otherwise(plain)

    def poured(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(plain, F.char_length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)

    return F.when(kind.isin("email", "ip", "ip6", "secret"), surrogate).otherwise(F.array_join(F.transform(F.split(mention, ""), poured), ""))


def replaced(text: Column, pattern: str, forms: Column, rest=lambda piece: F.struct(piece.alias("text"), F.lit(0).alias("n"))) -> Column:
    """(text, n): every match that has a form in its place, what lies between as rest gives it, and how many there were."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    parts = F.transform(parts, lambda p: F.struct(rest(p["between"]).alias("b"), p["match"].alias("match"), F.try_element_at(forms, p["match"]).alias("form")))
    new = F.array_join(F.transform(parts, lambda p: F.concat(p["b"]["text"], F.coalesce(p["form"], p["match"], F.lit("")))), "")
    n = F.aggregate(parts, F.lit(0), lambda a, p: a + p["b"]["n"] + F.when(p["form"].isNotNull(), 1).otherwise(0))
    return F.struct(new.alias("text"), n.alias("n"))


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_mentions", given: DataFrame | None = None) -> DataFrame:
    """All rows and columns of docs with the text rewritten, plus the number of mentions replaced.

    given: a table (script, gender, names) of given names with blanks between them, GIVEN without one.
    """
    table = GIVEN
    if given is not None:
        rows = given.select("script", "gender", "names").limit(MOST_GIVEN + 1).collect()
        table = {}
        for r in rows:
            table[r.script, r.gender] = f"{table.get((r.script, r.gender), '')} {r.names}".strip()
    stand_ins = given_names(key, table)
    listed = sorted({n for names in table.values() for n in names.split()})
    if len(listed) > MOST_GIVEN or (given is not None and len(rows) > MOST_GIVEN):
        raise ValueError(f"more than {MOST_GIVEN} given names")
    name = name_pattern(listed)
    pattern = f"{PRIVATE}|{name}"
    spark = docs.sparkSession
    stand_in = F.broadcast(spark.createDataFrame(pa.table({"entity": pa.array([n.lower() for n in stand_ins], pa.string()), "stand_in": pa.array(list(stand_ins.values()), pa.string())})).dropDuplicates(["entity"]))  # at most MOST_GIVEN rows

    text = F.col(text_col)
    whole = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.struct(m.alias("mention"), F.lit(True).alias("whole")))
    words = F.array_distinct(F.flatten(F.transform(F.split(text, pattern, -1), lambda b: F.regexp_extract_all(b, F.lit(ALONE), F.lit(0)))))
    words = F.when(text.rlike(name), F.transform(words, lambda w: F.struct(w.alias("mention"), F.lit(False).alias("whole")))).otherwise(F.array().cast("array<struct<mention:string,whole:boolean>>"))
    mentions = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"), F.xxhash64(text_col).alias("th"), F.explode(F.concat(whole, words)).alias("m")).select("d", "th", "m.*")
    mentions = keep(mentions.distinct(), "mentions")
    kinds = mentions.where("whole").select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    kinds = keep(kinds.withColumn("entity", F.when(F.col("kind") != "name", entity_of(F.col("kind"), F.col("mention")))), "kinds")

    # The words of names, and the words of the same documents that are among them.
    parts = kinds.where("kind = 'name'").select("mention", F.posexplode(F.regexp_extract_all("mention", F.lit(TOKEN), F.lit(0))).alias("pos", "word"))
    plain = F.regexp_replace("word", r"\.$", "")
    role = F.when(plain.isin([t for w in TITLES.split() for t in (w, w.upper())]), "title").when(F.col("word").rlike(rf"^{INITIAL}$"), "initial").when(F.col("word").rlike(r"^\p{Ll}"), "particle").otherwise("name")
    parts = keep(parts.withColumn("role", role).withColumn("entity", F.when(F.col("role") == "name", bare(F.col("word")))), "parts")
    known = mentions.where("whole").join(parts.where("role = 'name'").select("mention", "entity"), "mention").select("d", "th", "entity").distinct()
    again = mentions.where("not whole").withColumn("entity", bare(F.col("mention"))).join(known, ["d", "th", "entity"]).select("d", "th", "mention", "entity")
    again = keep(again, "again")

    names = parts.where("role = 'name'").select("word", "entity").union(again.select(F.col("mention").alias("word"), "entity")).distinct().join(stand_in, "entity", "left")
    names = keep(names, "names")
    chosen = assign(kinds.where("kind <> 'name'").select("kind", "entity").union(names.where("stand_in IS NULL").select(F.lit("name").alias("kind"), "entity")).distinct(), key, used=stand_in.select(F.lit("name").alias("kind"), F.col("entity").alias("surrogate")))
    drawn = chosen.where("kind = 'name'").select("entity", "surrogate")
    shouted = F.when((F.char_length("word") > 1) & (F.upper("word") == F.col("word")), F.upper("stand_in")).otherwise(F.col("stand_in"))
    names = keep(names.join(drawn, "entity", "left").select("word", F.coalesce(shouted, in_case_of(F.col("word"), F.col("surrogate"))).alias("form")), "forms")

    plain_forms = kinds.where("kind <> 'name'").join(chosen, ["kind", "entity"]).select("mention", written(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("form"))
    new = F.when(F.col("role") == "initial", other_initial(F.col("word"), key)).otherwise(F.coalesce("form", "word"))
    listed = parts.join(names.withColumn("role", F.lit("name")), ["word", "role"], "left").groupBy("mention").agg(F.array_sort(F.collect_list(F.struct("pos", new.alias("form")))).alias("new"))  # the words of one mention
    listed = listed.select("mention", F.array_join(F.transform(F.arrays_zip(F.split("mention", TOKEN, -1).alias("between"), "new"), lambda p: F.concat(p["between"], F.coalesce(p["new"]["form"], F.lit("")))), "").alias("form"))
    forms = mentions.where("whole").select("d", "th", "mention").join(plain_forms.union(listed).hint("rebalance"), "mention")
    forms = forms.select("d", "th", F.lit(True).alias("whole"), "mention", "form").union(again.withColumnRenamed("mention", "word").join(names.hint("rebalance"), "word").select("d", "th", F.lit(False), "word", "form"))
    one = F.struct("mention", "form")
    forms = forms.groupBy("d", "th").agg(F.map_from_entries(F.collect_list(F.when(F.col("whole"), one))).alias("forms"), F.map_from_entries(F.collect_list(F.when(~F.col("whole"), one))).alias("alone"))

    row = F.struct(*[docs[c] for c in docs.columns])
    both = docs.select(row.alias("row"), F.coalesce(docs[id_col], F.lit(NO_ID)).alias("d"), F.xxhash64(docs[text_col]).alias("th")).join(forms, ["d", "th"], "left")
    text = F.col("row").getField(text_col)
    simple = replaced(text, pattern, F.col("forms"))
    nested = replaced(text, pattern, F.col("forms"), lambda piece: replaced(piece, ALONE, F.col("alone")))
    both = both.withColumn("new", F.when(F.col("forms").isNotNull(), F.when(F.size("alone") > 0, nested).otherwise(simple)))
    out = [(F.when(F.col("forms").isNull(), text).otherwise(F.col("new.text")) if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != count_col]
    return both.select(*out, F.coalesce("new.n", F.lit(0)).cast("long").alias(count_col))
