"""Queries over the driver's tables, one or more for each operator. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.postcode import format_postcode, valid_postcode
from ..functions.school import clean_year_group, dob_range, parse_year_group, reverse_date, year_group_from_date
from ..functions.similarity import ratio, token_sort_ratio
from ..functions.text import find_numbers, format_name, full_name, remove_diacritics, remove_numbers, remove_punctuation
from ..operators.columns import snake_case_columns
from ..operators.duplicates import exact_groups, find_duplicates
from ..operators.match import Match, exact_match, fuzzy_match, school_age_match, waterfall
from ..operators.updates import get_contextual_updates, get_updates, with_updates

#: Academic year of the queries that need one.
START_YEAR = 2005


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scalar functions ---------------------------------------------------------------------------------------------------


def q_format_name(spark, d):
    return table(spark, d, "part").select("p_partkey", format_name(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" -  "), F.lower("p_brand"))).alias("name"))


def q_find_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", find_numbers("text").alias("has_numbers"), find_numbers("n_chars", convert_to_string=True).alias("count_has"))


def q_remove_numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", remove_numbers("text").alias("text"))


def q_full_name(spark, d):
    return table(spark, d, "part").select("p_partkey", full_name(F.concat(F.lit(" "), F.col("p_brand")), "p_type", F.when(F.col("p_size") > 25, F.col("p_name"))).alias("name"))


def q_full_name_missing(spark, d):
    first = F.when(F.col("p_size") % 3 == 0, F.lit(" NaN")).when(F.col("p_size") % 3 == 2, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", full_name(first, F.when(F.col("p_size") % 5 == 0, F.lit("  ")).otherwise(F.col("p_name"))).alias("name"))


def q_remove_diacritics(spark, d):
    return table(spark, d, "documents").select("doc_id", remove_diacritics("text").alias("text"))


def q_remove_punctuation(spark, d):
    return table(spark, d, "documents").select("doc_id", remove_punctuation("text").alias("text"))


def _postcode() -> Column:
    return F.concat(F.lower(F.substring("c_mktsegment", 1, 2)), F.col("c_nationkey").cast("string"), F.lit("  "), F.substring("c_name", -1, 1), F.lit("bg"))


def q_format_postcode(spark, d):
    return table(spark, d, "customer").select("c_custkey", format_postcode(_postcode(), errors="coerce").alias("postcode"), format_postcode(_postcode(), errors="ignore").alias("kept"))


def q_valid_postcode(spark, d):
    return table(spark, d, "customer").select("c_custkey", valid_postcode(F.upper(F.regexp_replace(_postcode(), "  ", " "))).alias("valid"))


def q_clean_year_group(spark, d):
    text = F.concat(F.lit(" year 0"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", clean_year_group(text, errors="coerce").alias("from_text"), clean_year_group("p_size", errors="ignore").alias("from_number"), parse_year_group(text, errors="coerce").cast("long").alias("number"))


def q_year_group_from_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", year_group_from_date("o_orderdate", START_YEAR, errors="ignore").alias("year_group"))


def q_reverse_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", reverse_date(F.col("o_orderdate").cast("date")).cast("string").alias("reversed"))


def q_dob_range(spark, d):
    ages = dob_range("p_size", START_YEAR, errors="coerce")
    return table(spark, d, "part").select("p_partkey", ages["first"].cast("string").alias("first_day"), ages["last"].cast("string").alias("last_day"))


def q_reverse_timestamp(spark, d):
    at = F.col("o_orderdate") + F.expr("INTERVAL '03:04:05' HOUR TO SECOND")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(reverse_date(at, timestamp=True), "yyyy-MM-dd HH:mm:ss").alias("reversed"))


def q_raise_modes(spark, d):
    """Modes that raise, over values that are all right."""
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit(" sw"), F.substring(size, 1, 1), F.lit("a 1a b"))
    return table(spark, d, "part").where("p_size BETWEEN 1 AND 13").select(
        "p_partkey", format_postcode(code).alias("postcode"), clean_year_group("p_size").alias("year_group"),
        parse_year_group(F.concat(F.lit("yr "), size)).cast("long").alias("number"), dob_range("p_size", START_YEAR)["last"].cast("string").alias("last_day"),
    )


def q_further_education(spark, d):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("FE Level "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("Rec"), F.when(F.col("p_size") % 3 == 0, F.lit(" 2")).otherwise(F.lit(""))))
    return table(spark, d, "part").select("p_partkey", clean_year_group(text, errors="coerce").alias("year_group"), clean_year_group(text, errors="ignore").alias("kept"))


def q_snake_case_columns(spark, d):
    t = table(spark, d, "nation")
    return snake_case_columns(t.select(F.col("n_nationkey").alias("Nation Key (#)"), F.col("n_name").alias("NationName")))


# -- similarity and matching --------------------------------------------------------------------------------------------


def _renamed(part: DataFrame) -> DataFrame:
    """New records: every part under a misspelt name with its words the other way round."""
    name = F.concat_ws(" ", F.reverse(F.split(F.translate("p_name", "e", ""), " ")))
    return part.select(F.col("p_partkey").alias("row_key"), name.alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


def _parts(spark, d, threshold: float = 70) -> Match:
    part = table(spark, d, "part")
    register = part.select("p_partkey", "p_name", "p_size", "p_brand")
    return fuzzy_match(_renamed(part), register, ["size", "brand"], ["p_size", "p_brand"], "name", "p_name", "name, size and brand", threshold, id_col="p_partkey")


def q_fuzzy_score_pairs(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    other = names.select(F.concat_ws(" ", F.reverse(F.split(F.translate("p_name", "e", ""), " "))).alias("other"), F.substring_index("p_name", " ", 1).alias("first"))
    pairs = names.withColumn("first", F.substring_index("p_name", " ", 1)).join(other, "first")
    return pairs.select("p_name", "other", F.bround(ratio("p_name", "other"), 2).alias("ratio"), F.bround(token_sort_ratio("p_name", "other"), 2).alias("token_sort"))


def q_fuzzy_match(spark, d):
    return _parts(spark, d).matched


def q_fuzzy_remaining(spark, d):
    return _parts(spark, d, 92).remaining


def q_reused_records(spark, d):
    return _parts(spark, d).reused().select("p_partkey", "matches")


def _customers(spark, d, verify: bool = False) -> Match:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return exact_match(orders, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), ["o_custkey"], ["c_custkey"], "customer", verify, id_col="c_name")


def q_exact_match(spark, d):
    return _customers(spark, d).matched


def q_exact_match_verify(spark, d):
    return _customers(spark, d, True).matched


def q_exact_remaining(spark, d):
    customer, orders = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return exact_match(customer, orders, ["c_custkey"], ["o_custkey"], "orders", id_col="o_orderkey").remaining


def q_exact_match_null_keys(spark, d):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    customer = table(spark, d, "customer")
    register = customer.select(F.col("c_mktsegment").alias("segment_id")).distinct().select("segment_id", F.nullif(F.col("segment_id"), F.lit("BUILDING")).alias("key"))
    return exact_match(customer.select("c_custkey", segment.alias("segment")), register, ["segment"], ["key"], "segment", id_col="segment_id").matched


def _schools(spark, d) -> Match:
    part = table(spark, d, "part")
    left = _renamed(part).select("row_key", "name", F.concat(F.lit("  "), F.lower("brand")).alias("school"), F.concat(F.lit("Year "), F.col("size").cast("string")).alias("year_group"))
    born = F.make_date(F.lit(START_YEAR - 4) - F.col("p_size"), F.lit(1) + F.col("p_size") % 12, F.lit(15))
    register = part.select("p_partkey", "p_name", F.upper("p_brand").alias("school"), born.alias("dob"))
    return school_age_match(left, register, "school", "school", "name", "p_name", "year_group", "dob", "school and age", id_col="p_partkey", academic_year_start=START_YEAR, threshold=70)


def q_school_age_match(spark, d):
    return _schools(spark, d).matched.withColumn("HEAT: dob", F.col("`HEAT: dob`").cast("string"))


def q_school_age_remaining(spark, d):
    return _schools(spark, d).remaining


def q_waterfall(spark, d):
    part = table(spark, d, "part")
    register = part.select("p_partkey", "p_name", "p_size", "p_brand")
    exact = exact_match(_renamed(part), register, ["name", "size", "brand"], ["p_name", "p_size", "p_brand"], "exact", id_col="p_partkey")
    fuzzy = fuzzy_match(exact.remaining, register, ["size", "brand"], ["p_size", "p_brand"], "name", "p_name", "fuzzy", 80, id_col="p_partkey")
    return waterfall(exact, fuzzy).select("row_key", "name", F.col("`Match Type`").alias("match_type"), F.col("`HEAT: p_partkey`").alias("register_key"))


# -- duplicates, updates, validation ------------------------------------------------------------------------------------


def _duplicates(spark, d, **options):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return find_duplicates(part, "p_name", "p_size", "p_brand", id_col="p_partkey", **options)


def q_dedupe_permissive(spark, d):
    return _duplicates(spark, d, threshold=90)


def q_dedupe_strict(spark, d):
    return _duplicates(spark, d, threshold=75, fuzzy_type="strict")


def q_dedupe_twins_off(spark, d):
    return _duplicates(spark, d, threshold=75, fuzzy_type="strict", twin_protection=False)


def q_dedupe_own_ids(spark, d):
    """A name of two columns, and ids that are made up in the order of the key."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    return find_duplicates(part, ["p_brand", "p_name"], "p_size", "p_brand", threshold=85, fuzzy_type="strict", order_by=["p_partkey"], ordered=True)


def q_exact_dupe_groups(spark, d):
    return exact_groups(table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_brand"), ["p_name", "p_size"])


def _orders(spark, d) -> DataFrame:
    new = F.when(F.col("o_orderstatus") == "F", F.lit("  ")).when(F.col("o_totalprice") > 200000, F.lit(None)).otherwise(F.col("o_orderpriority"))
    old = F.when(F.col("o_totalprice") > 100000, F.lit("5-LOW")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", new.alias("priority"), old.alias("HEAT: priority"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("HEAT: price"))


def q_get_updates(spark, d):
    t = _orders(spark, d)
    return t.select("o_orderkey", get_updates(t, "priority", "HEAT: priority").alias("update"))


def q_contextual_updates(spark, d):
    t = _orders(spark, d)
    return t.select("o_orderkey", get_contextual_updates(t, "priority", "HEAT: priority", ["1-URGENT", "2-HIGH"]).alias("update"))


def q_multi_updates(spark, d):
    return with_updates(_orders(spark, d), ["priority", "price"], {"priority": ["1-URGENT"]}).select("o_orderkey", F.col("`Update: priority`").alias("update_priority"), F.col("`Update: price`").alias("update_price"))


class Found(ValueError):
    """What EventRow finds wrong; ``errors`` as Pydantic's."""

    def __init__(self, found: list[dict]):
        super().__init__(f"{len(found)} error(s)")
        self.found = found

    def errors(self) -> list[dict]:
        return self.found


class EventRow:
    """A model with the methods that validation needs: a value of at least 1 and no purchase below 50."""

    def __init__(self, row: dict):
        self.row = row

    @classmethod
    def model_validate(cls, row: dict) -> EventRow:
        found = []
        if row["value"] is None or row["value"] < 1:
            found.append({"loc": ("value",), "msg": "too small"})
        if row["event_type"] == "purchase" and (row["value"] is None or row["value"] < 50):
            found.append({"loc": (), "msg": "cheap purchase"})
        if found:
            raise Found(found)
        return cls(row)

    def model_dump(self, **_) -> dict:
        return self.row


def q_error_report(spark, d):
    from ..operators.validation import error_report

    events = table(spark, d, "events").select("event_id", "event_type", "value")
    return error_report(events, EventRow, "events").select("event_id", F.col("val_error_count").cast("long").alias("n_errors"), F.col("val_error_details").alias("details"), F.col("validation_status").alias("status"))


def q_error_report_dates(spark, d):
    """Missing numbers reach the model as None, times come back as dates."""
    from ..operators.validation import error_report

    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, d, "events").select("event_id", "event_type", value.alias("value"), "ts")
    return error_report(events, EventRow, "events").select("event_id", F.col("ts").cast("string").alias("day"), F.col("val_error_count").cast("long").alias("n_errors"))


def q_error_report_counts(spark, d):
    from ..operators.validation import error_report, report_counts

    return report_counts(error_report(table(spark, d, "events").select("event_id", "event_type", "value"), EventRow, "events"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
