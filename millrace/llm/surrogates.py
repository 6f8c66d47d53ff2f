"""Personal data replaced by surrogates of the same kind, keyed, distinct and consistent.

Addresses, numbers and names found in texts are entities; mentions that differ only in spelling (case
of an address, separators of a number) are one entity.  A keyed digest of the entity draws its
surrogate: digits for digits in the mention's own format, a name of the same gender and script.  All
surrogates are then checked against each other and against the real entities, and drawn again until
no two entities share one, so what was distinct stays distinct and what was the same stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, plain, written

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d])(?!\.\d)"
CARD = r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
MALE, FEMALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Г-н)", r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа)"
NAME = rf"\b(?:{FEMALE}|{MALE})\b\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
#: In this order at one place of a text.
KINDS = {"email": EMAIL, "name": NAME, "card": CARD, "ssn": SSN, "ip": IP, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
FIRST = {
    ("m", "latin"): "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Niels Oskar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Frida Greta Helena Ida Julia Karla Lena Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Адам Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split()}
SYLLABLES = {
    "latin": "ba do fe gi ka lo mu ne pi ra so ta vo we zi lu".split(),
    "cyrillic": "ба до фе ги ка ло му не пи ра со та во ве зи лу".split()}
#: Draws before a full digest settles it.
DRAWS = 12


def kind_of(mention: Column) -> Column:
    found = None
    for kind, pattern in KINDS.items():
        test = mention.rlike(rf"\A(?:{pattern})\z")
        found = F.when(test, kind) if found is None else found.when(test, kind)
    return F.coalesce(found, F.lit("phone"))


def identity(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    name = F.regexp_replace(mention, rf"^(?:{FEMALE}|{MALE})\b\.? ", "")
    gender = F.when(mention.rlike(rf"^{FEMALE}\b"), "f").otherwise("m")
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "name", F.concat(gender, F.lit(":"), name))
        .when(kind == "ip", mention).otherwise(F.regexp_replace(mention, r"\D", "")))


def _draw(kind: Column, entity: Column, secret: str, attempt: Column) -> Column:
    """The surrogate of an entity: an address, a name, or the digits that replace its digits."""
    digest = F.sha2(F.concat_ws("\x00", F.lit(secret), kind, entity, attempt.cast("string")), 512)

    def pick(words: list[str], k: int) -> Column:
        return F.get(F.array(*[F.lit(w) for w in words]), F.conv(F.substring(digest, k + 1, 1), 16, 10).cast("int"))

    def byte(k: int) -> Column:
        return F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")

    cyrillic = entity.rlike(r"\p{IsCyrillic}")

    def name(gender: str, script: str) -> Column:
        syllables = [pick(SYLLABLES[script], k) for k in range(2, 8)]
        return F.concat_ws(" ", pick(FIRST[gender, script], 0), F.initcap(F.concat(*syllables)))

    female = entity.startswith("f:")
    full = (F.when(female & cyrillic, name("f", "cyrillic")).when(female, name("f", "latin"))
            .when(cyrillic, name("m", "cyrillic")).otherwise(name("m", "latin")))
    full = F.when(F.instr(entity, " ") > 0, full).otherwise(F.substring_index(full, " ", -1))
    email = F.concat(pick(FIRST["f", "latin"], 0), F.lit("."), *[pick(SYLLABLES["latin"], k) for k in range(1, 5)],
                     F.lit("."), F.substring(digest, 10, 6), F.lit("@example."), F.regexp_extract(entity, r"([a-z]+)$", 1))
    ip = F.concat_ws(".", F.lit("10"), *[byte(k).cast("string") for k in range(3)])
    digits = F.translate(F.concat(digest, F.sha2(digest, 512)), "abcdef", "012345")
    size = F.length(entity)
    # A card keeps its issuer, a social number moves to the range never issued, a phone keeps its country.
    head = F.when(kind == "card", F.substring(entity, 1, 4)).when(kind == "ssn", F.lit("9")).otherwise(F.substring(entity, 1, 3))
    number = F.concat(head, F.substr(digits, F.lit(1), F.greatest(size - F.length(head), F.lit(0))))
    body = F.substr(number, F.lit(1), size - 1)
    luhn = F.aggregate(F.split(F.reverse(body), ""), F.struct(F.lit(0).alias("s"), F.lit(True).alias("twice")), lambda a, c: F.struct(
        (a["s"] + F.when(a["twice"], F.expr("0") + 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))).alias("s"),
        (~a["twice"]).alias("twice")), lambda a: F.pmod(10 - F.pmod(a["s"], F.lit(10)), F.lit(10)))
    card = F.concat(body, luhn.cast("string"))
    return (F.when(kind == "email", F.lower(email)).when(kind == "name", full).when(kind == "ip", ip)
            .when(kind == "card", card).otherwise(number))


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """``kind, entity, surrogate``: one surrogate for each entity, none twice within a kind and none a real entity.

    Entities that collide draw again; the one with the smallest text keeps a contested surrogate.  If
    ``DRAWS`` rounds leave some (a kind that is nearly full), those get their keyed digest as surrogate.
    """
    real = written(entities.select("kind", "entity").distinct())
    taken = real.select("kind", F.when(F.col("kind") == "name", F.substring("entity", 3, 1_000_000)).otherwise(F.col("entity")).alias("surrogate")).distinct()
    settled, open_ = None, real
    for attempt in range(DRAWS):
        drawn = open_.withColumn("surrogate", _draw(F.col("kind"), F.col("entity"), secret, F.lit(attempt))).join(
            taken.withColumn("used", F.lit(True)), ["kind", "surrogate"], "left")
        if settled is not None:
            drawn = drawn.join(settled.select("kind", "surrogate", F.lit(True).alias("given")), ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("given", F.lit(None).cast("boolean"))
        free = drawn.filter("used IS NULL AND given IS NULL")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won = written(won.select("kind", "entity", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        open_ = written(open_.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return settled
    return settled.unionByName(open_.withColumn("surrogate", F.substring(F.sha2(F.concat(F.lit(secret), "kind", "entity"), 256), 1, 24)))


def _dress(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the mention: its separators, its form of address."""
    digits = F.aggregate(
        F.split(mention, ""), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda a, c: F.when(c.rlike(r"\d"), F.struct(
            (a["i"] + 1).alias("i"), F.concat(a["out"], F.substr(surrogate, a["i"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out"))), lambda a: a["out"])
    title = F.regexp_extract(mention, rf"^((?:{FEMALE}|{MALE})\b\.? )", 1)
    return F.when(kind.isin("email", "ip"), surrogate).when(kind == "name", F.concat(title, surrogate)).when(
        surrogate.rlike(r"\A\d+\z"), digits).otherwise(surrogate)


def replace(documents: DataFrame, secret: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, n_entities``: every row, its personal data replaced.

    Texts without any (null ones too, which stay null) pass through.  Equal texts are worked on once.
    A mention that fills many documents is looked up once for each distinct text that holds it.
    """
    if not secret:
        raise ValueError("surrogates need a secret key")
    docs = plain(documents, doc_id=doc_id, text=text)
    # Every kind needs a digit, an @ or a form of address; most texts are settled by that.
    has = blank(F.col("text")).rlike(rf"[@0-9]|\b(?:{FEMALE}|{MALE})\b") & blank(F.col("text")).rlike(ANY)
    mentions = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    found = written(docs.filter(has).select(F.md5("text").alias("key"), mentions.alias("m")).dropDuplicates(["key"])
                    .select("key", F.posexplode("m").alias("i", "mention"))
                    .withColumn("kind", kind_of(F.col("mention"))).withColumn("entity", identity(F.col("kind"), F.col("mention"))))
    known = assign(found, secret)
    dressed = found.join(known, ["kind", "entity"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        "i", _dress(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("to")))).alias("to"))
    gaps = F.split("text", ANY, -1)
    changed = docs.filter(has).withColumn("key", F.md5("text")).join(dressed, "key").select(
        "doc_id", F.array_join(F.zip_with(gaps, "to", lambda gap, to: F.concat(gap, F.coalesce(to["to"], F.lit("")))), "").alias("text"),
        F.size("to").alias("n_entities"))
    return docs.filter(~has).select("doc_id", "text", F.lit(0).alias("n_entities")).unionByName(changed)
