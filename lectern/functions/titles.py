"""Titles and file names as parts: volumes, ranges, periods, issue ids. Rules are data; no rule runs code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import chinese_number

_NUMBER = "[零〇一二两三四五六七八九十百0-9]+"


def volume(title: Column) -> Column:
    """The number of a volume that a title or heading names; null without one."""
    found = F.regexp_extract(title, f"第({_NUMBER})[卷册集辑]", 1)
    latin = F.regexp_extract(title, r"(?i)\b(?:vol(?:ume|\.)?)\s*([0-9]+)", 1)
    return F.when(found != "", chinese_number(found)).when(latin != "", latin.cast("int"))


def describe(title: Column) -> Column:
    """What a title is: (kind, base, first, last). Kinds in order: period, range, all, volume, plain."""
    period = r"[(（]\s*([0-9]{4})\s*[-—–~至]+\s*([0-9]{4})\s*[)）]"
    between = f"第?({_NUMBER})\\s*[-—–~至]\\s*第?({_NUMBER})[卷册集辑]"
    whole = f"[(（](?:全|共)({_NUMBER})[卷册集辑][)）]"
    base = lambda p: F.trim(F.regexp_replace(title, p, ""))
    part = lambda kind, b, lo, hi: F.struct(F.lit(kind).alias("kind"), b.alias("base"), lo.cast("int").alias("first"), hi.cast("int").alias("last"))
    none = F.lit(None).cast("int")
    return (
        F.when(title.rlike(period), part("period", base(period), F.regexp_extract(title, period, 1), F.regexp_extract(title, period, 2)))
        .when(title.rlike(between), part("range", base(between), chinese_number(F.regexp_extract(title, between, 1)), chinese_number(F.regexp_extract(title, between, 2))))
        .when(title.rlike(whole), part("all", base(whole), F.lit(1), chinese_number(F.regexp_extract(title, whole, 1))))
        .when(volume(title).isNotNull(), part("volume", base(f"[(（]?第{_NUMBER}[卷册集辑][)）]?|(?i:\\bvol(?:ume|\\.)?\\s*[0-9]+)"), volume(title), volume(title)))
        .otherwise(part("plain", F.trim(title), none, none))
    )


@dataclass(frozen=True)
class NameRule:
    """A pattern whose groups fill a template: {1} is the first group, {2:02} the second as two digits."""

    pattern: str
    template: str


def issue_id(name: Column, rules: list[NameRule]) -> Column:
    """The id of the first rule that matches a file name; null if none does or what it gives is no six- or eight-digit id."""
    import re

    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        pieces = []
        for literal, group, width in re.findall(r"([^{]+)|\{([0-9]+)(?::0([0-9]+))?\}", rule.template):
            value = F.lit(literal) if literal else F.regexp_extract(name, rule.pattern, int(group))
            pieces.append(F.lpad(value, int(width), "0") if width else value)
        out = F.when(name.rlike(rule.pattern), F.concat(*pieces)).otherwise(out)
    return F.when(out.rlike("^([0-9]{6}|[0-9]{8})$"), out)


def volumes_of(titles: DataFrame, title: str) -> DataFrame:
    """Titles with their parts, grouped under one base: (base, kind, n, first, last)."""
    d = titles.select(describe(F.col(title)).alias("d")).select("d.*")
    return d.groupBy("base", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
