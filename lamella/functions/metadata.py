"""Document metadata by patterns, one struct column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import digits, first_of, has_any, squeeze, strip, unicode


def _begins(pattern: str) -> str:
    """The plain text that each match of a pattern begins with."""
    return re.match(r"[^\\()\[\].*+?|^${}]*", pattern)[0]


def _extract(text: Column, pattern: str, flags: str = "") -> Column:
    """The first group of the first match, or an empty text; only texts that have the match's beginning are searched."""
    return F.when(~F.contains(text, F.lit(_begins(pattern))), F.lit("")).otherwise(F.regexp_extract(text, unicode(flags + pattern), 1))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, unicode(pattern), group), F.lit(""))


def _all(text: Column, pattern: str, needs: str, group: int = 1) -> Column:
    """All matches; only texts that have ``needs``, a part of each match, are searched for the pattern."""
    return F.when(~F.contains(text, F.lit(needs)), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(unicode(pattern)), group))


def _number(x: Column, kind: str = "bigint") -> Column:
    """Digits of any of the two scripts as a number; null if there are too many."""
    return digits(x).try_cast(kind)


def title(text: Column) -> Column:
    tried = [F.nullif(squeeze(_extract(text, p, "(?s)")), F.lit("")) for p in fv.TITLE_PATTERNS]
    return F.coalesce(*tried, F.nullif(strip(F.substring_index(text, "\n", 1)), F.lit("")))


def tags(text: Column) -> Column:
    return F.filter(F.array(*(F.when(has_any(text, needles), F.lit(tag)) for tag, needles in fv.TAGS)), lambda t: t.isNotNull())


def kept(text: Column, needles: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, needles)), lambda n: F.contains(text, n))


def least_number(text: Column, pattern: str, unit: str) -> Column:
    return F.array_min(F.transform(_all(text, pattern, unit), lambda x: _number(x)))


def fees(text: Column) -> Column:
    """All fees, first occurrence of each (amount, unit)."""

    def of(pattern: str, needs: str, unit: str, kind: str) -> Column:
        return F.transform(_all(text, pattern, needs), lambda x: F.struct(_number(x, "double").alias("amount"), F.lit(unit).alias("unit"), F.lit(kind).alias("type")))

    return F.array_distinct(F.concat(of(fv.BAHT_PATTERN, fv.BAHT, fv.BAHT, "fixed"), of(fv.PERCENT_PATTERN, fv.PERCENT, "%", "percentage"), of(fv.PERCENT_WORD_PATTERN, fv.PERCENT_WORD, "%", "percentage")))


def legal_references(text: Column) -> Column:
    null = F.lit(None).cast("string")

    def ref(kind: str, name: Column = null, year: Column = null, number: Column = null, section: Column = null) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("name"), year.alias("year"), number.alias("number"), section.alias("section"))

    def part(x: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(x, unicode(pattern), group), F.lit(""))

    laws = F.transform(_all(text, fv.LAW_PATTERN, fv.LAW[0], 0), lambda x: ref(fv.LAW, strip(F.regexp_extract(x, unicode(fv.LAW_PATTERN), 1)), part(x, fv.LAW_PATTERN, 2)))
    rules = F.transform(_all(text, fv.MINISTERIAL_PATTERN, fv.MINISTERIAL, 0), lambda x: ref(fv.MINISTERIAL, year=part(x, fv.MINISTERIAL_PATTERN, 2), number=part(x, fv.MINISTERIAL_PATTERN, 1)))
    sections = F.transform(F.array_distinct(F.transform(_all(text, fv.SECTION_PATTERN, fv.SECTION), strip)), lambda x: ref(fv.SECTION, section=x))
    orders = F.transform(_all(text, fv.ORDER_PATTERN, fv.ORDER), lambda x: ref(fv.ORDER, number=x))
    return F.concat(laws, rules, sections, orders)


def channels(text: Column) -> Column:
    def channel(kind: str, name: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.lit(True).alias("available"))

    some = F.array(F.when(has_any(text, fv.QUEUE_MARKS), channel("online", "e-QLands")), F.when(has_any(text, fv.SERVICE_MARKS), channel("e-service", fv.ONLINE_OFFICE)), channel("walk-in", fv.WALK_IN))
    return F.filter(some, lambda c: c.isNotNull())


def document_type(text: Column) -> Column:
    return first_of(F.substring(text, 1, 500), [([k], v) for k, v in fv.DOCUMENT_TYPES], F.lit(fv.OTHER_TYPE))


def metadata(text: Column, path: Column | None = None) -> Column:
    """The whole struct; every group is an expression on the text, so unused groups are pruned."""
    head = F.substring(text, 1, 500)
    marked = F.contains(text, F.lit(fv.VERSION_MARK)) | (F.contains(path, F.lit(fv.VERSION_MARK)) if path is not None else F.lit(False))
    minutes, days = least_number(text, fv.MINUTES_PATTERN, fv.MINUTES_UNIT), least_number(text, fv.DAYS_PATTERN, fv.DAYS_UNIT)
    queue = F.when(has_any(text, fv.QUEUE_MARKS), _first(text, fv.QUEUE_TIME_PATTERN))
    required = F.regexp_count(_extract(text, fv.DOCUMENT_LIST_PATTERN.removeprefix("(?s)"), "(?s)"), F.lit(unicode(r"(?md)^\d+\)")))
    locations = kept(text, fv.SERVICE_LOCATIONS)
    all_fees = fees(text)
    return F.struct(
        document_type(text).alias("document_type"),
        title(text).alias("title"),
        F.struct(F.lit(fv.DEFAULT_ORGANIZATION).alias("primary"), F.coalesce(strip(F.nullif(_extract(text, fv.ORGANIZATION_PATTERN), F.lit(""))), F.lit(fv.DEFAULT_ORGANIZATION)).alias("full"), F.when(F.size(locations) > 0, locations).otherwise(F.array(F.lit(fv.DEFAULT_LOCATION))).alias("service_location")).alias("organization"),
        F.struct(F.when(marked, "N").otherwise("").alias("version"), marked.alias("is_latest"), F.nullif(_extract(text, fv.YEAR_PATTERN), F.lit("")).alias("law_year")).alias("version_info"),
        F.struct(first_of(head, fv.CATEGORIES).alias("level1"), F.lit(None).cast("string").alias("level2"), F.lit(None).cast("string").alias("level3"), tags(text).alias("tags"), first_of(head, [([k], k) for k in fv.SERVICE_CATEGORIES]).alias("service_category")).alias("categories"),
        F.struct(
            F.struct(
                F.when(minutes.isNotNull() | days.isNotNull(), F.struct(minutes.alias("time_minutes"), F.concat(minutes.cast("string"), F.lit(" " + fv.MINUTES_UNIT)).alias("time_display"), F.when(minutes.isNotNull(), fv.MINUTES_UNIT).alias("time_unit"), days.alias("time_days"))).alias("standard"),
                F.when(queue.isNotNull(), F.struct(F.lit("e-QLands").alias("method"), _number(queue).alias("time_minutes"), F.concat(queue, F.lit(fv.QUEUE_NOTE)).alias("time_display"))).alias("alternative"),
            ).alias("processing"),
            F.struct(F.contains(text, F.lit(fv.ANNOUNCEMENT)).alias("requires_announcement"), has_any(text, fv.COURT_MARKS).alias("requires_court_order"), (F.contains(text, F.lit(fv.CONSENT_MARKS[0])) & F.contains(text, F.lit(fv.CONSENT_MARKS[1]))).alias("requires_consent")).alias("requirements"),
            channels(text).alias("channels"),
        ).alias("service"),
        legal_references(text).alias("legal_references"),
        F.struct(all_fees.alias("all_fees"), (F.size(all_fees) > 0).alias("has_fees")).alias("fees"),
        F.struct(required.alias("count"), (required > 0).alias("has_documents")).alias("required_documents"),
        F.struct(
            (F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))).alias("has_tables"), F.regexp_like(text, F.lit(unicode(r"(?md)^\d+\."))).alias("has_lists"), has_any(text, [fv.LAW, fv.SECTION]).alias("has_legal_references"),
            has_any(text, fv.QUEUE_MARKS).alias("has_e_qlands"), has_any(text, fv.SERVICE_MARKS).alias("has_e_service"),
        ).alias("content_features"),
        F.struct(kept(head, fv.PRIMARY_KEYWORDS).alias("primary_keywords")).alias("search_optimization"),
    )
