"""Search filters: normal form, templates of filters that differ in data only, and what can be read from both."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dequote(c: Column) -> Column:
    """Without one pair of outer quotes."""
    return F.regexp_replace(c, r'^"(.*)"$', "$1")


def normalize_filter(c: Column) -> Column:
    """Dequoted, lower case, white space collapsed and trimmed; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(dequote(F.trim(c))), r"\s+", " ")), F.lit(""))


VALUE = re.compile(r"([=<>~])([^()&|!=<>~]+)")
RUNS = re.compile(r"[0-9]+|[^0-9*]+")
PIECES = re.compile(r"[()]|[^()]+")


def masked(text: str) -> str:
    """Values as # (digits) and $ (other characters); attributes, operators, * and brackets stay."""
    plain = re.sub(r"\s+", "", text.split('"', 1)[0])
    return VALUE.sub(lambda m: m[1] + RUNS.sub(lambda r: "#" if r[0][0].isdigit() else "$", m[2]), plain)


def folded(text: str) -> str:
    """Equal neighbouring clauses as one with a plus sign, from the innermost bracket outwards."""
    stack: list[list[tuple[str, bool]]] = [[]]
    for piece in PIECES.findall(text):
        if piece == "(":
            stack.append([])
        elif piece == ")" and len(stack) > 1:
            inner = joined(stack.pop())
            stack[-1].append((f"({inner})", True))
        else:
            stack[-1].append((piece, False))
    while len(stack) > 1:
        inner = joined(stack.pop())
        stack[-1].append((f"({inner}", False))
    return joined(stack[0])


def joined(items: list[tuple[str, bool]]) -> str:
    out = []
    for (item, clause), same in groupby(items):
        n = len(list(same))
        out.append(item + ("+" if n > 1 else "") if clause else item * n)
    return "".join(out)


@lru_cache(200_000)
def generalize(text: str) -> str:
    return folded(masked(text))


def generalize_series(filters: pd.Series) -> pd.Series:
    return filters.map(generalize, na_action="ignore")


def generalize_filter(c: Column | str) -> Column:
    """Template of each normalised filter."""
    return F.pandas_udf(generalize_series, StringType())(c)


def op_symbol(type: Column, template: Column, scope: Column) -> Column:
    """SRCH|template|scope for searches with a filter, else the type, else a question mark."""
    search = F.concat(F.lit("SRCH|"), template, F.lit("|"), F.coalesce(scope.cast("string"), F.lit("-")))
    return F.coalesce(F.when((type == "SRCH") & template.isNotNull(), search), F.nullif(type, F.lit("")), F.lit("?"))


def is_slow_filter(template: Column) -> Column:
    """Negations and substring matches; a presence test is not slow."""
    return template.rlike(r"!|\$\*|#\*|\*\$|\*#")


def qmark_attrs(filter: Column) -> Column:
    """Attributes that the server did not know: (?attr) or (?attr=value) gives what follows the question mark."""
    return F.regexp_extract_all(filter, F.lit(r"\(\?([^)]+)\)"), 1)


def split_attrs(attrs: Column) -> Column:
    """Attribute names in lower case."""
    return F.filter(F.split(F.lower(attrs), r"\s+"), lambda a: a != "")


def session_name_key(name: Column) -> Column:
    """A session's name without trailing k=v words."""
    return F.trim(F.regexp_replace(name, r"(\s+\S+=\S*)+$", ""))


def nat_host_key(accept: Column) -> Column:
    """The host of an accept address: without a bracketed remark and the port."""
    host = F.regexp_replace(F.regexp_replace(accept, r"\s+\(.*$", ""), r":\d+$", "")
    return F.when(host == "", accept).otherwise(host)


def short_account(dn: Column) -> Column:
    """First part of a DN."""
    return F.substring_index(dn, ",", 1)
