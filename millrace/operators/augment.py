"""Augment text records with seeded variations.

Copies are made by exploding every row ``factor`` times inside its task, so the input is scanned
once and nothing shuffles.  Method choice and every word draw hash (key, field, copy, position).
Only synonym replacement from a large thesaurus table needs a join; a small one travels as a
literal in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from hashlib import md5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import seeded
from ..functions import text as tx
from ..functions import types as ty
from ..functions.paths import is_object_list, top
from ..functions.wordlists import FILLER_WORDS, SMALL_THESAURUS
from ..session import fits_broadcast
from .project import template_structure

METHODS = ("shuffle", "synonym", "rephrase")
#: Words of a mapping that are put into the plan; a longer one becomes a table, with the same results.
MAX_LITERAL_WORDS = 500
SYNONYM_CHANCE = 0.2
#: Copies of a thesaurus that is too large to broadcast, so that frequent words spread over tasks.
SALTS = 32


def is_eligible(text: Column) -> Column:
    """More than three words."""
    return F.size(tx.tokens(text)) > 3


def shuffle_words(text: Column, base: Column, keep_ends: int = 2, words: Column | None = None) -> Column:
    """Seeded word order; with ``keep_ends`` the first and last words stay, and short texts too."""
    words = tx.tokens(text) if words is None else words
    if not keep_ends:
        return F.array_join(seeded.shuffled(words, base), " ")
    size = F.size(words)
    middle = F.slice(words, keep_ends + 1, F.greatest(size - 2 * keep_ends, F.lit(0)))
    mixed = F.concat(
        F.slice(words, 1, keep_ends), seeded.shuffled(middle, base), F.slice(words, -keep_ends, keep_ends))
    return F.when(size > 2 * keep_ends + 2, F.array_join(mixed, " ")).otherwise(text)


def shuffle_texts(text: Column, base: Column, keep_ends: int = 2) -> Column:
    """What ``shuffle_words`` gives for texts of more than three words, others unchanged; for text columns, read in batches.

    What tasks run is defined inside, so that it travels with the plan: workers need not have this package.
    """
    least = 2 * keep_ends + 2 if keep_ends else 3

    def mixed(text: str, base: str) -> str:
        words = text.split()
        if len(words) <= max(least, 3):
            return text
        start, end = base.encode() + b":", len(words) - keep_ends
        hashes = [md5(start + b"%d" % i, usedforsecurity=False).digest() for i in range(end - keep_ends)]
        order = sorted(range(end - keep_ends), key=hashes.__getitem__)
        return " ".join([*words[:keep_ends], *[words[keep_ends + i] for i in order], *words[end:]])

    @F.pandas_udf("string")
    def changed(texts: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([mixed(t, b) if t else t for t, b in zip(texts, bases)], dtype="object")

    return changed(text, base)


def replace_synonyms(text: Column, base: Column, thesaurus: Mapping[str, Sequence[str]]) -> Column:
    """Each word is replaced, with chance 0.2, by a synonym of its lower-case form."""
    table = F.create_map(*[c for word in sorted(thesaurus) for c in (
        F.lit(word), F.array(*[F.lit(s) for s in thesaurus[word]]))])

    def draw(b: Column, word: Column, i: Column) -> Column:
        # Whether the word is listed is the cheapest test, so it comes first.
        drawn = F.lower(word).isin(*thesaurus) & seeded.happens(seeded.item_hash(b, i), SYNONYM_CHANCE)
        choices = F.try_element_at(table, F.lower(word))
        return F.when(drawn, seeded.pick(choices, seeded.extend(b, i, "which"))).otherwise(word)

    return tx.once(base, lambda b: F.array_join(
        F.transform(tx.word_tokens(text), lambda word, i: draw(b, word, i)), " "))


def rephrase(
    text: Column, base: Column, chance: float = 1.0, min_chars: int = 0, words: Column | None = None
) -> Column:
    """Replace a text by filler: 1 to 3 sentences if it has more than ten words, else one
    sentence with as many words."""
    size = F.size(tx.tokens(text) if words is None else words)
    paragraph = F.array_join(F.transform(
        F.sequence(F.lit(1), (seeded.below(seeded.extend(base, "sentences"), 3) + 1).cast("int")),
        lambda s: filler_sentence(
            (seeded.below(seeded.extend(base, "length", s), 11) + 5).cast("int"), seeded.extend(base, "word", s))), " ")
    new = F.when(size > 10, paragraph).otherwise(filler_sentence(F.greatest(size, F.lit(1)), seeded.extend(base, "word")))
    if chance < 1.0:
        new = F.when(seeded.unit(seeded.extend(base, "whether")) < chance, new).otherwise(text)
    return F.when(F.length(text) >= min_chars, new).otherwise(text) if min_chars else new


def filler_sentence(words: Column, base: Column) -> Column:
    lexicon = F.array(*[F.lit(w) for w in FILLER_WORDS])
    body = F.array_join(F.transform(
        F.sequence(F.lit(1), words), lambda i: seeded.pick(lexicon, seeded.extend(base, i))), " ")
    return F.concat(F.upper(F.substring(body, 1, 1)), F.substr(body, F.lit(2)), F.lit("."))


def augment(
    df: DataFrame,
    key: str,
    factor: int = 2,
    methods: Sequence[str] = METHODS,
    template: str | Mapping | None = None,
    seed: int = 42,
    keep_ends: int = 2,
    thesaurus: Mapping[str, Sequence[str]] | DataFrame | None = None,
    rephrase_chance: float = 1.0,
    rephrase_min_chars: int = 0,
) -> DataFrame:
    """Input columns plus ``copy_no`` (0 = original) and ``method``; ``factor`` rows per record.

    Texts of more than three words are varied: the template's text leaves, at any depth, or every
    top-level text if no template is given.  ``key`` is a unique column and is never varied.
    ``thesaurus`` is a mapping of lower-case words to synonyms, or a table ``(word, synonyms)``.
    """
    unknown = set(methods) - set(METHODS)
    if unknown or not methods:
        raise ValueError(f"Unknown augmentation methods: {sorted(unknown)}" if unknown else "No augmentation methods")
    structure = template_structure(template) if template else {}
    text_columns = _text_columns(df, key, structure)
    # Words are split once per text, before it is copied.
    split = _with_words(df, text_columns) if factor > 1 else df.withColumns(
        {"_words_" + c: F.lit(None).cast("array<string>") for c in text_columns})
    copies = split.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(max(factor, 1) - 1))))
    draw = seeded.below(seeded.seed_text(top(key), "method", seed, F.col("copy_no")), len(methods))
    chosen = F.get(F.array(*[F.lit(m) for m in methods]), draw.cast("int"))
    copies = copies.withColumn("method", F.when(F.col("copy_no") > 0, chosen))
    literal = {}
    for word, synonyms in (thesaurus if isinstance(thesaurus, Mapping) else SMALL_THESAURUS).items():
        distinct = [s for s in dict.fromkeys(s.replace("_", " ") for s in synonyms) if s != word]
        if distinct:
            literal[word] = distinct
    if "synonym" in methods and len(literal) > MAX_LITERAL_WORDS and not isinstance(thesaurus, DataFrame):
        # Too long for an expression: the same words as a table.
        thesaurus = df.sparkSession.createDataFrame(list(literal.items()), "word string, synonyms array<string>")
    joined = isinstance(thesaurus, DataFrame) and "synonym" in methods
    if joined:
        drawn = [_leaf_draws(top(f.name), f.dataType, structure.get(f.name), [F.lit(f.name)], key, seed)
                 for f in df.schema.fields if f.name != key and (not structure or f.name in structure)]
        copies = _join_synonyms(copies, key, F.concat(*drawn), thesaurus, text_columns)

    def vary(text: Column, where: Sequence[Column], column: str | None) -> Column:
        base = {m: seeded.extend(seeded.seed_text(top(key), m, seed, F.col("copy_no")), *where) for m in methods}
        words = top("_words_" + column) if column is not None else tx.tokens(text)
        method = F.col("method")
        new = F.when(method.isNull(), text)
        if "shuffle" in methods and column is not None:
            # Rows of other methods go to Python without their text.
            mixed = shuffle_texts(F.when(method == "shuffle", text), base["shuffle"], keep_ends)
            new = new.when(method == "shuffle", mixed)
        if column is None or set(methods) != {"shuffle"}:  # Otherwise no words are needed, nor copied with the rows.
            new = new.when(F.size(words) <= 3, text)
        if "shuffle" in methods and column is None:
            new = new.when(method == "shuffle", shuffle_words(text, base["shuffle"], keep_ends, words))
        if "synonym" in methods and joined:
            new = new.when(method == "synonym", _merge_words(tx.word_tokens(text), F.filter(
                F.col("_replaced"), lambda s: s["leaf"] == F.concat_ws(".", *[w.cast("string") for w in where]))))
        elif "synonym" in methods:
            new = new.when(method == "synonym", replace_synonyms(text, base["synonym"], literal))
        if "rephrase" in methods:
            new = new.when(method == "rephrase",
                           rephrase(text, base["rephrase"], rephrase_chance, rephrase_min_chars, words))
        return new.otherwise(text)

    out = []
    for f in df.schema.fields:
        column = top(f.name)
        if f.name != key and (not structure or f.name in structure):
            column = _vary_leaves(column, f.dataType, structure.get(f.name), [F.lit(f.name)], vary, f.name)
        out.append(column.alias(f.name))
    return copies.select(*out, "copy_no", "method")


def _text_columns(df: DataFrame, key: str, structure: Mapping) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != key and ty.type_label(f.dataType) == "string"
            and (not structure or f.name in structure)]


def _vary_leaves(
    value: Column, data_type: T.DataType, node: object, where: list[Column],
    vary: Callable[[Column, Sequence[Column], str | None], Column], column: str | None,
) -> Column:
    if ty.type_label(data_type) == "string":
        return vary(value, where, column)
    if isinstance(data_type, T.StructType) and isinstance(node, Mapping):
        return F.when(value.isNotNull(), F.struct(*[
            (_vary_leaves(value.getField(f.name), f.dataType, node[f.name], [*where, F.lit(f.name)], vary, None)
             if f.name in node else value.getField(f.name)).alias(f.name)
            for f in data_type.fields]))
    if isinstance(data_type, T.ArrayType) and is_object_list(node):
        return F.transform(value, lambda x, i: _vary_leaves(
            x, data_type.elementType, node[0], [*where, i], vary, None))
    return value


_DRAWS = "array<struct<leaf:string,pos:int,word:string,which:bigint>>"
_REPLACED = "array<struct<leaf:string,pos:int,word:string>>"


def _leaf_draws(
    value: Column, data_type: T.DataType, node: object, where: list[Column], key: str, seed: int
) -> Column:
    """The words to replace in all text leaves of a column, with leaf and position."""
    none = F.array().cast(_DRAWS)
    if ty.type_label(data_type) == "string":
        base = seeded.extend(seeded.seed_text(top(key), "synonym", seed, F.col("copy_no")), *where)
        leaf = F.concat_ws(".", *[w.cast("string") for w in where])
        words = F.when(is_eligible(value), tx.word_tokens(value)).otherwise(F.array().cast("array<string>"))
        drawn = tx.once(base, lambda b: F.array_compact(F.transform(words, lambda w, i: F.when(
            seeded.happens(seeded.item_hash(b, i), SYNONYM_CHANCE), F.struct(
                leaf.alias("leaf"), i.alias("pos"), F.lower(w).alias("word"),
                seeded.number(seeded.extend(b, i, "which")).alias("which"))))))
        return drawn.cast(_DRAWS)
    if isinstance(data_type, T.StructType) and isinstance(node, Mapping):
        parts = [_leaf_draws(value.getField(f.name), f.dataType, node[f.name], [*where, F.lit(f.name)], key, seed)
                 for f in data_type.fields if f.name in node]
        return F.concat(*parts) if parts else none
    if isinstance(data_type, T.ArrayType) and is_object_list(node):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: _leaf_draws(
            x, data_type.elementType, node[0], [*where, i], key, seed))), none)
    return none


def _with_words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({"_words_" + c: tx.tokens(top(c)) for c in columns})


def _join_synonyms(
    copies: DataFrame, key: str, draws: Column, thesaurus: DataFrame, text_columns: Sequence[str]
) -> DataFrame:
    """Adds ``_replaced``: the drawn words of a record for which a thesaurus table has synonyms.

    Only drawn words leave their row.  They meet the thesaurus by broadcast if its size allows,
    otherwise in a shuffle whose words are salted: a word that makes up a third of the corpus is
    spread over ``SALTS`` tasks.  The replacements come back grouped per record.
    """
    words = _clean_thesaurus(thesaurus)
    empty = F.array().cast(_REPLACED)
    # Only the copies that get synonyms take part in the join, without their words.
    to_vary = copies.filter(F.col("method") == "synonym").drop(*["_words_" + c for c in text_columns])
    others = copies.filter(~F.col("method").eqNullSafe("synonym")).withColumn("_replaced", empty)
    drawn = to_vary.select(top(key).alias("_key"), F.col("copy_no").alias("_copy"), F.inline(draws))
    if fits_broadcast(words):
        met = drawn.join(F.broadcast(words), "word")
    else:
        salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = drawn.withColumn("salt", (F.col("which") % SALTS).cast("int")).join(salted, ["word", "salt"])
    picked = F.get("synonyms", (F.col("which") % F.size("synonyms")).cast("int"))
    per_record = met.groupBy("_key", "_copy").agg(
        F.collect_list(F.struct("leaf", "pos", picked.alias("word"))).alias("_replaced"))
    varied = to_vary.join(
        per_record, (top(key) == F.col("_key")) & (F.col("copy_no") == F.col("_copy")), "left")
    varied = varied.withColumn("_replaced", F.coalesce("_replaced", empty)).drop("_key", "_copy")
    return others.unionByName(_with_words(varied, text_columns))


def _clean_thesaurus(thesaurus: DataFrame) -> DataFrame:
    """Distinct synonyms other than the word itself, with ``_`` read as a space."""
    spaced = F.array_distinct(F.transform("synonyms", lambda s: F.replace(s, F.lit("_"), F.lit(" "))))
    return thesaurus.select("word", F.filter(spaced, lambda s: s != F.col("word")).alias("synonyms")).filter(
        F.size("synonyms") > 0)


def _merge_words(words: Column, replaced: Column) -> Column:
    """A text from its words, some of them replaced by position: the runs of words between
    replacements, joined up again."""

    def joined(ws: Column, new: Column) -> Column:
        def piece(j: Column) -> Column:
            start = F.coalesce(F.get(new, j - 1)["pos"] + 1, F.lit(0))
            end = F.coalesce(F.get(new, j)["pos"], F.size(ws))
            run = F.slice(ws, start + 1, end - start)
            return F.when(j < F.size(new), F.concat(run, F.array(F.get(new, j)["word"]))).otherwise(run)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(new)), piece)), " ")

    by_position = F.sort_array(F.transform(replaced, lambda s: F.struct(s["pos"].alias("pos"), s["word"].alias("word"))))
    return tx.once(words, lambda ws: tx.once(by_position, lambda new: joined(ws, new)))


def augment_count(augmented: DataFrame) -> DataFrame:
    """``record_count, original_count, new_count``."""
    return augmented.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count(F.when(F.col("copy_no") == 0, 1)).alias("original_count"),
        F.count(F.when(F.col("copy_no") > 0, 1)).alias("new_count"))
