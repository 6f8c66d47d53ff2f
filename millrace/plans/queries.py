"""The query catalogue: every operator on whole tables.

Each query takes ``(spark, folder)``, reads ``<folder>/<table>.parquet`` and returns a DataFrame
of plain columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import nested_paths, set_path, suggest_mapping
from ..operators import (
    anonymize, augment, balance, duplicates, edit, generate, mask, near_duplicates as near, personal, profile, project, repair, rules,
    split, textscan, validate, vary)
from ..session import scratch_folder, spread
from ..sources import convert, read, read_records, write, write_splits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYWORDS = ("license", "licensed", "token", "released")
FORBIDDEN = ("license", "token", r"version \d+")
EVENT_RULES = [{"field": "event_type", "type": "Custom Python", "value": "x IN ('view', 'click', 'purchase')"}]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels, NULL where there is none."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """User turns with the assistant turn that follows, NULL where none does; joined on the unique (conversation, turn)."""
    talk = table(spark, folder, "conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("ask"))
    replied = talk.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(replied, ["conv_id", "turn"], "left")


def label_records(spark: SparkSession, folder: str) -> DataFrame:
    """JSON records whose label keys are absent for unlabelled documents."""
    record = F.struct("doc_id", "lang", "source", "quality", "toxic")
    return labelled(spark, folder).select("doc_id", F.parse_json(F.to_json(record)).alias("record"))


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """JSON records without an id; ``code`` is text for signups, a number elsewhere and null for errors."""
    code = (F.when(F.col("event_type") == "signup", F.concat(F.lit('"u'), F.col("user_id"), F.lit('"')))
            .when(F.col("event_type") == "error", "null").otherwise(F.col("user_id").cast("string")))
    text = F.format_string('{"code":%s,"type":"%s"}', code, F.col("event_type"))
    return table(spark, folder, "events").select("event_id", F.parse_json(text).alias("record"))


# -- projections ---------------------------------------------------------------------------------

@query
def template_alpaca(spark, folder):
    distinct = duplicates.drop_duplicates(table(spark, folder, "documents"), ["text"], "doc_id")
    return project.map_to_template(
        distinct, "alpaca", {"instruction": "source", "input": "lang", "output": "text"}, keep=["doc_id"])


@query
def template_instruction(spark, folder):
    return project.map_to_template(
        turn_pairs(spark, folder), "instruction", {"prompt": "ask", "completion": "reply"}, keep=["conv_id", "turn"])


@query
def template_qa(spark, folder):
    return project.map_to_template(labelled(spark, folder), "qa", {"question": "text", "answer": "quality"}, keep=["doc_id"])


@query
def template_llama(spark, folder):
    docs = table(spark, folder, "documents")
    return project.map_to_template(docs, "llama", suggest_mapping(docs.schema, project.template_structure("llama")), keep=["doc_id"])


@query
def template_mistral(spark, folder):
    return project.map_to_template(
        turn_pairs(spark, folder), "mistral", {"instruction": "ask", "response": "nowhere"}, keep=["conv_id", "turn"])


@query
def template_anthropic(spark, folder):
    return project.map_to_template(
        turn_pairs(spark, folder), "anthropic_format", {"input": "ask", "output": "reply"}, keep=["conv_id", "turn"])


def _flat_messages(mapped: DataFrame, n: int) -> DataFrame:
    message = F.col("messages")
    return mapped.select(
        "conv_id", "turn", F.size(message).alias("n_messages"),
        *[message[i]["role"].alias(f"role_{i}") for i in range(n)],
        *[message[i]["content"].alias(f"content_{i}") for i in range(n)])


@query
def template_chat(spark, folder):
    return _flat_messages(project.map_to_template(
        turn_pairs(spark, folder), "chat", {"messages[0].content": "ask", "messages[1].content": "reply"},
        literals="keep", keep=["conv_id", "turn"]), 2)


@query
def template_openai(spark, folder):
    return _flat_messages(project.map_to_template(
        turn_pairs(spark, folder), "openai_fine_tuning",
        {"messages[1].content": "ask", "messages[2].content": "reply"}, keep=["conv_id", "turn"]), 3)


@query
def template_custom(spark, folder):
    own = {"meta": {"id": "", "kind": "event"}, "parts": [{"name": "who", "value": ""}, {"name": "what", "value": ""}]}
    mapped = project.map_to_template(
        table(spark, folder, "events"), own,
        {"meta.id": "event_id", "parts[0].value": "user_id", "parts[1].value": "event_type"}, literals="keep")
    return mapped.select(
        F.col("meta.id").alias("id"), F.col("meta.kind").alias("kind"),
        F.col("parts")[0]["name"].alias("name_0"), F.col("parts")[0]["value"].alias("value_0"),
        F.col("parts")[1]["name"].alias("name_1"), F.col("parts")[1]["value"].alias("value_1"))


@query
def template_native(spark, folder):
    """Leaves with their own types: numbers, booleans and lists, and a list whose positions differ in type."""
    own = {"meta": {"chars": "", "long": "", "words": "", "nothing": ""}, "parts": [{"name": "size", "value": ""}, {"name": "lang", "value": ""}]}
    docs = labelled(spark, folder).select(
        "doc_id", "n_chars", "quality", "lang", (F.col("n_chars") > 1000).alias("long"), F.split("source", "[./-]").alias("words"))
    mapped = project.map_to_template(docs, own, {
        "meta.chars": "n_chars", "meta.long": "long", "meta.words": "words", "meta.nothing": "nowhere",
        "parts[0].value": "quality", "parts[1].value": "lang"}, literals="keep", keep=["doc_id"], types="native")
    part = lambda i: F.col("parts")[i]["value"]
    return mapped.select(
        "doc_id", (F.col("meta.chars") + 1).alias("chars"), F.col("meta.long").alias("long"), F.size("meta.words").alias("n_words"),
        F.element_at("meta.words", 1).alias("word"), F.col("meta.nothing").alias("nothing"),
        *[F.col("parts")[i]["name"].alias(f"name_{i}") for i in range(2)],
        F.variant_get(part(0), "$", "int").alias("value_0"), F.variant_get(part(1), "$", "string").alias("value_1"),
        *[F.schema_of_variant(part(i)).alias(f"type_{i}") for i in range(2)])


@query
def nested_path(spark, folder):
    events = table(spark, folder, "events").withColumn("props", F.parse_json("props"))
    return project.map_to_template(events, "qa", {"question": "props.k", "answer": "props.k.deeper"}, keep=["event_id"])


@query
def nested_list_path(spark, folder):
    docs = table(spark, folder, "documents").withColumn("words", F.split("text", " "))
    return project.map_to_template(docs, "qa", {"question": "words.1", "answer": "words.1000"}, keep=["doc_id"])


@query
def nested_write(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    changed = set_path(set_path(events, "props.k", F.col("props.k") + 1), "props.origin.kind", F.lit("log"))
    return changed.select("event_id", F.col("props.k").alias("k"), F.col("props.origin.kind").alias("kind"))


@query
def input_paths(spark, folder):
    """Paths of a nested input, with the number of records that have a value there."""
    nested = labelled(spark, folder).select(F.struct(
        "doc_id", F.struct("quality", "toxic").alias("label"), F.array(F.struct("lang", "source")).alias("tags")).alias("item"))
    counts = {p: p for p in nested_paths(nested.schema)}
    row = nested.agg(*[F.count(F.get(F.col(p), F.lit(0)) if p.startswith("item.tags.") else F.col(p)).alias(p.replace(".", "_"))
                       for p in counts])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("path"), F.col(p.replace(".", "_")).alias("n")) for p in counts])))


@query
def input_keys(spark, folder):
    return project.available_keys(label_records(spark, folder), "record")


@query
def preview(spark, folder):
    return project.preview(labelled(spark, folder), 100, order_by=["doc_id"])


# -- profile -------------------------------------------------------------------------------------

@query
def profile_orders(spark, folder):
    return profile.profile(table(spark, folder, "orders")).withColumn("mean_length", F.round("mean_length", 4))


@query
def profile_missing(spark, folder):
    return profile.profile(labelled(spark, folder)).select("field", "record_count", "present", "missing", "type")


@query
def profile_null_counts(spark, folder):
    return profile.null_counts(labelled(spark, folder))


@query
def profile_mean_length(spark, folder):
    return profile.mean_lengths(table(spark, folder, "documents")).withColumn("mean_length", F.round("mean_length", 4))


@query
def profile_records(spark, folder):
    return profile.profile_records(event_records(spark, folder), "record", "event_id")


@query
def profile_records_null_only(spark, folder):
    return profile.profile_records(label_records(spark, folder), "record", "doc_id", absent_is_missing=False)


@query
def profile_top_values(spark, folder):
    return profile.top_values(table(spark, folder, "orders"))


@query
def profile_top_texts(spark, folder):
    return profile.top_values(table(spark, folder, "documents"), long_texts=["text"])


@query
def value_counts_top10(spark, folder):
    return profile.field_distribution(table(spark, folder, "part"), "p_brand")


@query
def histogram(spark, folder):
    bins = profile.field_distribution(table(spark, folder, "lineitem"), "l_quantity")
    return bins.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query
def missing_patterns(spark, folder):
    return profile.missing_patterns(labelled(spark, folder))


@query
def unique_counts(spark, folder):
    return profile.unique_counts(table(spark, folder, "lineitem"))


@query
def correlation(spark, folder):
    pairs = profile.correlations(
        table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return pairs.withColumn("correlation", F.round("correlation", 6))


# -- duplicates and drift ------------------------------------------------------------------------

@query
def dup_flags(spark, folder):
    marked = duplicates.mark_duplicates(table(spark, folder, "documents"), ["text"], "doc_id")
    return marked.select("doc_id", "is_duplicate")


@query
def dup_count(spark, folder):
    return duplicates.duplicate_count(table(spark, folder, "documents"), ["text"], "doc_id")


@query
def dup_groups(spark, folder):
    groups = duplicates.duplicate_groups(table(spark, folder, "documents"), ["text"], "doc_id")
    return groups.filter("n > 1").select("first_key", "n")


@query
def dedup_exact(spark, folder):
    return duplicates.drop_duplicates(table(spark, folder, "documents"), ["text"], "doc_id")


@query
def dedup_records(spark, folder):
    """Duplicates over several columns of different types, with NULLs."""
    rows = labelled(spark, folder).select("doc_id", "lang", "quality", "toxic")
    return duplicates.drop_duplicates(rows, None, "doc_id")


@query
def field_drift(spark, folder):
    drift = validate.field_drift(label_records(spark, folder), "record", "doc_id")
    return drift.select("row_key", F.array_join("fields", ",").alias("fields"))


@query
def validate_records(spark, folder):
    return validate.validate_records(event_records(spark, folder), "record", "event_id")


@query
def type_counts(spark, folder):
    return validate.type_counts(event_records(spark, folder), "record", "event_id")


@query
def type_conflicts(spark, folder):
    return validate.type_conflicts(event_records(spark, folder), "record", "event_id")


@query
def not_objects(spark, folder):
    value = F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k")).otherwise(F.col("props"))
    records = table(spark, folder, "events").select("event_id", F.parse_json(value).alias("record"))
    return validate.not_objects(records, "record", "event_id")


# -- rules ---------------------------------------------------------------------------------------

def _check(df: DataFrame, key: str, *rule_list: dict) -> DataFrame:
    return rules.violations(df, list(rule_list), key)


@query
def rule_required(spark, folder):
    return _check(labelled(spark, folder), "doc_id", {"field": "ALL_FIELDS", "type": "Required"})


@query
def rule_type(spark, folder):
    return _check(table(spark, folder, "customer"), "c_custkey",
                  {"field": "c_name", "type": "Type Check", "value": "string"},
                  {"field": "c_acctbal", "type": "Type Check", "value": "boolean"})


@query
def rule_type_variant(spark, folder):
    codes = event_records(spark, folder).select("event_id", F.variant_get("record", "$.code", "variant").alias("code"))
    return _check(codes, "event_id", {"field": "code", "type": "Type Check", "value": "number"})


@query
def rule_regex(spark, folder):
    return _check(table(spark, folder, "part"), "p_partkey",
                  {"field": "p_name", "type": "Regex Match", "value": "^[a-m].*(t|g)$"})


@query
def rule_length(spark, folder):
    return _check(table(spark, folder, "documents"), "doc_id",
                  {"field": "text", "type": "Min Length", "value": "500"},
                  {"field": "text", "type": "Max Length", "value": "5000"})


@query
def rule_value(spark, folder):
    return _check(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey",
                  {"field": "l_linenumber", "type": "Min Value", "value": "2"},
                  {"field": "l_linenumber", "type": "Max Value", "value": "6"})


@query
def rule_custom(spark, folder):
    return _check(table(spark, folder, "events"), "event_id", *EVENT_RULES,
                  {"field": "user_id", "type": "Custom Python", "value": lambda x: x > 20})


@query
def validation_report(spark, folder):
    return validate.validation_report(
        labelled(spark, folder), "doc_id", ("missing", "duplicates", "rules"),
        [{"field": "lang", "type": "Regex Match", "value": "^(en|de)$"}])


@query
def validation_summary(spark, folder):
    df = event_records(spark, folder).join(table(spark, folder, "events").select("event_id", "event_type"), "event_id")
    return validate.summarize(validate.validation_report(
        df, "event_id", ("missing", "types", "duplicates", "rules"), EVENT_RULES, record="record"))


@query
def template_conformance(spark, folder):
    shaped = labelled(spark, folder).select("doc_id", F.col("lang").alias("prompt"), F.col("quality").alias("completion"))
    return repair.template_problems(shaped, "instruction", "doc_id")


# -- edit ----------------------------------------------------------------------------------------

@query
def search_filter(spark, folder):
    return edit.search(table(spark, folder, "customer"), "machine")


@query
def delete_keys(spark, folder):
    flagged = table(spark, folder, "labels").filter("toxic = 1")
    return edit.delete_records(table(spark, folder, "documents"), flagged, "doc_id")


@query
def patch_cells(spark, folder):
    """Negative balances set to zero, then one later edit of the segment."""
    owing = table(spark, folder, "customer").filter("c_acctbal < 0")
    patches = owing.select("c_custkey", F.lit("c_acctbal").alias("field"), F.lit("0").alias("value"), F.lit(1).alias("edit_no")).unionByName(
        owing.select("c_custkey", F.lit("c_mktsegment").alias("field"), F.lit("DRAFT").alias("value"), F.lit(1).alias("edit_no"))).unionByName(
        owing.select("c_custkey", F.lit("c_mktsegment").alias("field"), F.lit("ARREARS").alias("value"), F.lit(2).alias("edit_no")))
    return edit.patch_cells(table(spark, folder, "customer"), patches, "c_custkey")


@query
def append_record(spark, folder):
    return edit.append_record(table(spark, folder, "supplier"), {"s_suppkey": -1, "s_name": "New"})


@query
def bulk_edit(spark, folder):
    return edit.bulk_edit(table(spark, folder, "orders").drop("o_orderdate"), F.col("o_orderstatus") == "F",
                          {"o_orderpriority": F.lit("DONE"), "o_totalprice": F.lit(0.0)})


@query
def row_numbers(spark, folder):
    return edit.row_numbers(table(spark, folder, "documents"), "doc_id")


# -- repair --------------------------------------------------------------------------------------

@query
def repair_nulls(spark, folder):
    return repair.repair(labelled(spark, folder), "qa", "shallow").drop("actions")


@query
def repair_template(spark, folder):
    shaped = labelled(spark, folder).select("doc_id", F.col("lang").alias("prompt"), F.col("quality").alias("completion"), "toxic")
    return repair.repair(shaped, "instruction").drop("actions")


@query
def repair_log(spark, folder):
    shaped = labelled(spark, folder).select("doc_id", F.col("lang").alias("prompt"), F.col("quality").alias("completion"), "toxic")
    return repair.repair_log(repair.repair(shaped, "instruction"), "doc_id")


@query
def repair_count(spark, folder):
    return repair.repaired_count(repair.repair(labelled(spark, folder)))


def _half_chats(spark, folder):
    """Chats without the assistant's turn where the document has no label; lists with NULLs."""
    message = F.struct(F.lit("user").alias("role"), F.col("lang").alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), F.col("quality").cast("string").alias("content"))
    return labelled(spark, folder).select(
        "doc_id",
        F.when(F.col("quality").isNull(), F.array(message)).when(F.col("quality") == 1, F.array(message, answer)).alias("messages"),
        F.array(F.col("source"), F.col("toxic").cast("string")).alias("tags"),
        F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("notes"))


@query
def repair_chat(spark, folder):
    fixed = repair.repair(_half_chats(spark, folder), "chat")
    message = F.col("messages")
    return fixed.select(
        "doc_id", F.size(message).alias("n_messages"),
        F.get(message, F.lit(0))["role"].alias("role_0"), F.get(message, F.lit(0))["content"].alias("content_0"),
        F.get(message, F.lit(1))["role"].alias("role_1"), F.get(message, F.lit(1))["content"].alias("content_1"),
        F.array_join("tags", "|", "NULL").alias("tags"), F.array_join("notes", "|").alias("notes"))


@query
def repair_chat_log(spark, folder):
    return repair.repair_log(repair.repair(_half_chats(spark, folder), "chat"), "doc_id")


# -- augment -------------------------------------------------------------------------------------

def texts(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


THESAURUS = {"the": ("this", "that", "such"), "is": ("was", "remains"), "und": ("sowie",), "que": ("quoi", "lequel")}


@query
def augment_count(spark, folder):
    return augment.augment_count(augment.augment(table(spark, folder, "documents"), "doc_id", 3, ["shuffle"]))


@query
def augment_shuffle(spark, folder):
    return augment.augment(texts(spark, folder), "doc_id", 3, ["shuffle"])


@query
def augment_shuffle_all(spark, folder):
    return augment.augment(
        texts(spark, folder), "doc_id", 2, ["shuffle"], keep_ends=0)


@query
def augment_synonym(spark, folder):
    return augment.augment(texts(spark, folder), "doc_id", 2, ["synonym"], thesaurus=THESAURUS)


@query
def augment_synonym_table(spark, folder):
    """The same from a thesaurus table, here one of part names."""
    parts = table(spark, folder, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    words = parts.filter(F.col("word").rlike("^[a-z]{3,6}$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    thesaurus = words.select("word", F.array(F.upper("word"), F.concat("word", F.lit("s"))).alias("synonyms"))
    return augment.augment(texts(spark, folder), "doc_id", 2, ["synonym"], thesaurus=thesaurus)


@query
def augment_rephrase(spark, folder):
    return augment.augment(table(spark, folder, "benchmark"), "item_id", 2, ["rephrase"])


@query
def augment_methods(spark, folder):
    mixed = augment.augment(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id", 4)
    return mixed.groupBy("copy_no", "method").agg(F.count(F.lit(1)).alias("n"))


@query
def augment_chat(spark, folder):
    """Message contents inside a list, scoped by the template."""
    pairs = turn_pairs(spark, folder).withColumn("pair", F.concat_ws("-", "conv_id", "turn"))
    chats = project.map_to_template(
        pairs, "chat", {"messages[0].content": "ask", "messages[1].content": "reply"}, literals="keep", keep=["pair"])
    varied = augment.augment(chats, "pair", 2, ["shuffle"], template="chat")
    message = F.col("messages")
    return varied.select("pair", "copy_no", "method", *[message[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content")])


# -- anonymize -----------------------------------------------------------------------------------

@query
def detect_sensitive(spark, folder):
    """Sensitive columns of all keyed tables, with the number of values to replace."""
    reports = [anonymize.sensitive_report(table(spark, folder, t)).withColumn("table", F.lit(t))
               for t in ("documents", "events", "customer", "supplier", "part", "pages", "conversations", "orders")]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


@query
def anonymize_detected(spark, folder):
    return anonymize.anonymize(table(spark, folder, "customer"), "c_custkey")


@query
def anonymize_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang")
    return anonymize.anonymize(docs, "doc_id", {"source": "id"})


@query
def anonymize_name_consistent(spark, folder):
    pairs = table(spark, folder, "documents").select("doc_id", "source", F.col("source").alias("again"))
    return anonymize.anonymize(pairs, "doc_id", {"source": "name", "again": "name"}, mode="consistent", secret="s")


@query
def anonymize_types(spark, folder):
    """One column per sensitive type; NULLs stay, empty texts are skipped."""
    kinds = ("email", "phone", "address", "ip", "ssn", "credit_card", "dob")
    base = labelled(spark, folder).select(
        "doc_id", *[F.when(F.col("quality") == 1, F.lit("v")).when(F.col("quality") == 0, F.lit("")).alias(k) for k in kinds])
    return anonymize.anonymize(base, "doc_id", {k: k for k in kinds}, skip_empty=True)


@query
def anonymize_unknown(spark, folder):
    nations = table(spark, folder, "customer")
    return anonymize.anonymize(nations, "c_custkey", {"c_mktsegment": "no_such_provider"}, on_unknown="constant")


@query
def anonymize_count(spark, folder):
    return anonymize.sensitive_report(labelled(spark, folder), {"quality": "id", "source": "name"})


# -- near-duplicates, variations, balance, personal data in values ----------------------------------

@query
def near_duplicates(spark, folder):
    return near.near_duplicates(table(spark, folder, "documents"), ["text"], "doc_id")


@query
def near_duplicates_fields(spark, folder):
    """Pages by their address and source text, three words, at 0.7."""
    return near.near_duplicates(table(spark, folder, "pages"), ["url", "html"], "page_id", words=3, percent=70)


@query
def augment_noise(spark, folder):
    return vary.add_noise(table(spark, folder, "documents"), ["text", "source"], "doc_id", rate=0.02)


@query
def augment_sentences(spark, folder):
    return vary.reorder_sentences(table(spark, folder, "documents"), ["text"], "doc_id")


@query
def balance_largest(spark, folder):
    return balance.balance(table(spark, folder, "labels"), "toxic", "doc_id")


@query
def balance_smallest(spark, folder):
    return balance.balance(table(spark, folder, "documents"), "lang", "doc_id", "smallest", seed=7)


@query
def balance_number(spark, folder):
    """A hundred and one rows of each label; unlabelled documents stay."""
    return balance.balance(labelled(spark, folder), "quality", "doc_id", 101)


@query
def personal_values(spark, folder):
    return personal.detect_personal(table(spark, folder, "documents"), ["text", "source"], "doc_id")


@query
def personal_report(spark, folder):
    return personal.personal_report(table(spark, folder, "documents"), ["text", "lang"], "doc_id")


#: Ordered: the second rule would also take the digits of the first, the fourth those of all.
MASK_RULES = [
    mask.MaskRule(r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]*[A-Za-z])", r"***@\2"),
    mask.MaskRule(r"([0-9]{1,3})[.]([0-9]{1,3})[.][0-9]{1,3}[.][0-9]{1,3}", r"\1.\2.*.*"),
    mask.MaskRule(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", keep_last=4),
    mask.MaskRule(r"[+]?[0-9][0-9 ().-]{6,}[0-9]"),
    mask.MaskRule(r"(?i)(secret|password|token)([\"' :=]+)[A-Za-z0-9+/_.=-]{8,}", r"\1\2[removed]"),
]


@query
def mask_patterns(spark, folder):
    return mask.mask_fields(table(spark, folder, "documents"), ["text"], MASK_RULES)


# -- split and generate --------------------------------------------------------------------------

@query
def split_exact(spark, folder):
    return split.split_dataset(table(spark, folder, "documents"), "doc_id").select("doc_id", "split")


@query
def split_sizes(spark, folder):
    return split.split_counts(split.split_dataset(table(spark, folder, "orders"), "o_orderkey", (0.7, 0.2, 0.1), 7))


@query
def split_hash(spark, folder):
    parts = split.split_dataset(table(spark, folder, "lineitem"), "l_orderkey", exact=False)
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query
def generate_qa(spark, folder):
    """One generated record per document."""
    return generate.generate_for(
        table(spark, folder, "documents"), "doc_id", "qa", {"question": "email", "answer": "date_of_birth"})


@query
def generate_chat(spark, folder):
    made = generate.generate_for(table(spark, folder, "documents"), "doc_id", "chat", auto=False)
    return made.select("row_id", *[F.col("messages")[i][f].alias(f"{f}_{i}") for i in (0, 1) for f in ("role", "content")])


# -- text scans ----------------------------------------------------------------------------------

def _scan(spark, folder):
    return textscan.keyword_scan(table(spark, folder, "documents"), "doc_id", "text", KEYWORDS)


@query
def kw_scan(spark, folder):
    return _scan(spark, folder).select("doc_id", "line_no", "keyword", "line")


@query
def kw_context(spark, folder):
    return textscan.keyword_context(_scan(spark, folder), "doc_id")


@query
def kw_per_text(spark, folder):
    return textscan.keyword_hits_per_text(table(spark, folder, "documents"), "doc_id", "text", KEYWORDS)


@query
def kw_top(spark, folder):
    return textscan.top_keywords(_scan(spark, folder))


@query
def kw_summary(spark, folder):
    return textscan.keyword_summary(table(spark, folder, "documents"), "text", KEYWORDS)


@query
def kw_errors(spark, folder):
    """The default keyword list, on events written as log lines."""
    log = table(spark, folder, "events").select("event_id", F.concat_ws("\n", "event_type", "props").alias("log"))
    return textscan.keyword_scan(log, "event_id", "log").select("event_id", "line_no", "keyword", "line")


@query
def forbidden_scan(spark, folder):
    return textscan.forbidden_scan(table(spark, folder, "documents"), "doc_id", "text", FORBIDDEN)


@query
def hygiene(spark, folder):
    return textscan.hygiene(table(spark, folder, "documents"), "doc_id", "text", max_size_kb=8, forbidden=("license", "token"))


@query
def hygiene_summary(spark, folder):
    return textscan.hygiene_summary(textscan.hygiene(table(spark, folder, "pages"), "page_id", "html"))


@query
def wellformed_json(spark, folder):
    """Event properties, with a stray bracket for one event type."""
    spoilt = F.when(F.col("event_type") == "error", F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return textscan.well_formed(table(spark, folder, "events").select("event_id", spoilt.alias("props")), "event_id", "props", "json")


@query
def wellformed_xml(spark, folder):
    """Whole texts as XML, with a wrong end tag for all languages but one."""
    end = F.when(F.col("lang") == "en", "]]></d>").otherwise("]]></e>")
    wrapped = F.concat(F.lit("<d><![CDATA["), F.col("text"), end)
    return textscan.well_formed(table(spark, folder, "documents").select("doc_id", wrapped.alias("x")), "doc_id", "x", "xml")


@query
def wellformed_yaml(spark, folder):
    """Whole texts as quoted YAML, with a stray bracket for all languages but one."""
    quoted = F.concat(F.to_json(F.struct("text")), F.when(F.col("lang") == "en", "").otherwise("}"))
    return textscan.well_formed(table(spark, folder, "documents").select("doc_id", quoted.alias("y")), "doc_id", "y", "yaml")


@query
def wellformed_summary(spark, folder):
    return textscan.well_formed_summary(textscan.well_formed(table(spark, folder, "documents"), "doc_id", "text", "text"))


# -- formats -------------------------------------------------------------------------------------

def _round_trip(spark: SparkSession, df: DataFrame, fmt: str) -> DataFrame:
    path = scratch_folder(spark)
    write(df, path, fmt)
    return read(spark, path, fmt)


@query
def io_jsonl(spark, folder):
    return _round_trip(spark, labelled(spark, folder), "jsonl")


@query
def io_json(spark, folder):
    return _round_trip(spark, labelled(spark, folder), "json")


@query
def io_csv(spark, folder):
    return _round_trip(spark, labelled(spark, folder), "csv")


@query
def io_csv_headers(spark, folder):
    """A folder of files with their columns in two orders."""
    path, part = scratch_folder(spark), table(spark, folder, "part")
    odd = F.col("p_partkey") % 2 == 1
    write(part.filter(odd), path + "/a", "csv")
    write(part.filter(~odd).select(*reversed(part.columns)), path + "/b", "csv")
    return read(spark, path + "/*", "csv", by_name=True).select(*part.columns)


@query
def io_json_nested_data(spark, folder):
    """Records with a list ``data`` of their own: it stays a field."""
    turns = table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("id")).agg(
        F.collect_list(F.struct("turn", "text")).alias("data"))
    back = _round_trip(spark, turns, "json")
    chars = F.aggregate("data", F.lit(0).cast("bigint"), lambda n, d: n + F.coalesce(F.length(d["text"]), F.lit(0)))
    return back.select("id", F.size("data").cast("bigint").alias("n"), chars.alias("chars"))


@query
def io_tsv(spark, folder):
    return _round_trip(spark, table(spark, folder, "part"), "tsv")


@query
def io_txt(spark, folder):
    """Records written as JSON lines of text, read back as text."""
    return _round_trip(spark, table(spark, folder, "customer").select("c_custkey", "c_name"), "txt")


@query
def io_parquet(spark, folder):
    return _round_trip(spark, table(spark, folder, "documents"), "parquet")


@query
def io_xml(spark, folder):
    nested = table(spark, folder, "supplier").select(
        "s_suppkey", "s_name", "s_acctbal", F.array(F.lit("a"), F.col("s_name")).alias("tags"))
    back = _round_trip(spark, nested, "xml")
    return back.select("s_suppkey", "s_name", "s_acctbal", F.array_join("tags.item", "|").alias("tags"))


@query
def io_yaml(spark, folder):
    """Whole records go through the file; the SQL has no text."""
    return _round_trip(spark, labelled(spark, folder), "yaml").drop("text")


@query
def io_convert(spark, folder):
    """Parquet to JSON Lines to CSV."""
    lines, flat = scratch_folder(spark), scratch_folder(spark)
    convert(spark, f"{folder}/customer.parquet", lines, target_format="jsonl")
    convert(spark, lines, flat, "jsonl", "csv")
    return read(spark, flat, "csv")


@query
def io_records(spark, folder):
    """Records with differing keys, read as they are."""
    path = scratch_folder(spark)
    write(labelled(spark, folder), path, "json")
    records = read_records(spark, path, "json")
    return records.select(F.try_variant_get("record", "$.doc_id", "bigint").alias("doc_id"),
                          F.try_variant_get("record", "$.lang", "string").alias("lang"),
                          F.try_variant_get("record", "$.quality", "int").alias("quality"))


@query
def io_splits(spark, folder):
    path = scratch_folder(spark)
    write_splits(split.split_dataset(table(spark, folder, "customer"), "c_custkey"), path)
    return read(spark, path, "parquet").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query
def io_splits_formats(spark, folder):
    """Whole customers split and written in five formats; what comes back from each part."""
    parts, counted = split.split_dataset(table(spark, folder, "customer"), "c_custkey"), []
    for fmt in ("csv", "tsv", "json", "txt", "xml"):
        path = scratch_folder(spark)
        write_splits(parts, path, fmt)
        for name in ("train", "valid", "test"):
            back = read(spark, f"{path}/split={name}", fmt)
            chars = F.get_json_object("text", "$.c_name") if fmt == "txt" else F.col("c_name")
            counted.append(back.agg(F.lit(fmt).alias("format"), F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"),
                                    F.sum(F.length(chars)).alias("chars")))
    return reduce(DataFrame.unionByName, counted)


@query
def io_statistics(spark, folder):
    path = scratch_folder(spark)
    write(profile.profile(table(spark, folder, "part")), path, "csv")
    return read(spark, path, "csv").select("field", "record_count", "missing", "type")
