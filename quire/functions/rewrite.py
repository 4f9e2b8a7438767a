"""Rewriting links in text: insertion and repair. They need a scan with state, so they run as pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def insert_links(names: dict[str, str], first_only: bool = False):
    """A UDF that links names in text: {shown name: target}.

    One pass of a single alternation, longest name first, over the text outside existing links, so that no link is put
    into a link. A name counts between characters that are no letters, digits or underscores.
    """
    ordered = sorted(names, key=lambda n: (-len(n), n))
    finder = re.compile(r"\[\[.*?\]\]|(?<![\w])(" + "|".join(map(re.escape, ordered)) + r")(?![\w])") if ordered else None

    def one(text: str | None) -> str | None:
        if text is None or finder is None:
            return text
        seen: set[str] = set()

        def put(m: re.Match) -> str:
            name = m[1]
            if name is None or first_only and name in seen:
                return m[0]
            seen.add(name)
            return f"[[{name}]]" if names[name] == name else f"[[{names[name]}|{name}]]"

        return finder.sub(put, text)

    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run


def unnest(text: str | None) -> str | None:
    """Links inside links give way to what they show, innermost first, until there are none.

    Each round drops at least one pair of brackets, so the rounds end.
    """
    if text is None:
        return None
    inner = re.compile(r"(\[\[[^\[\]]*)\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
    while (new := inner.sub(r"\1\2", text)) != text:
        text = new
    return text


@pandas_udf(StringType())
def repair_nested(texts: pd.Series) -> pd.Series:
    return texts.map(unnest)
