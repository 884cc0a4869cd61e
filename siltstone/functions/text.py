"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

LAO = "[຀-໿]"


def collapse(x: Column) -> Column:
    """Drop zero-width characters, make white space runs one space, trim. The relational core of normalisation."""
    x = F.regexp_replace(x, "[​-‍﻿]", "")
    return F.trim(F.regexp_replace(x, "[\\s \u0085  -     　]+", " "))


@F.pandas_udf(StringType())
def normalized(x):
    """Entities, NFC, zero-width characters and white space: what collapse() can't say exactly."""
    import html
    import re
    import unicodedata

    def one(t):
        return None if t is None else " ".join(re.sub("[​-‍﻿]", "", unicodedata.normalize("NFC", html.unescape(t))).split())

    return x.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def markup_text(x):
    """NFC; zero-width spaces separate words and are spaces, byte order marks and soft hyphens go; null is empty."""
    import unicodedata

    marks = {0x200B: " ", 0x00A0: " ", 0xFEFF: None, 0x00AD: None}
    return x.fillna("").map(lambda t: " ".join(unicodedata.normalize("NFC", t).translate(marks).split()))


@F.pandas_udf(StringType())
def match_key(x):
    """normalized(), casefolded, word characters only; null is empty."""
    import html
    import re
    import unicodedata

    def one(t):
        t = re.sub("[​-‍﻿]", "", unicodedata.normalize("NFC", html.unescape(t or "")))
        return re.sub("[^\\w຀-໿]+", "", " ".join(t.split()).casefold())

    return x.fillna("").map(one)


@F.pandas_udf(StringType())
def compact_title(x):
    """NFKC, casefolded, word characters only, without zero-width spaces and soft hyphens."""
    import re
    import unicodedata

    return x.fillna("").map(lambda t: re.sub(r"\W+", "", unicodedata.normalize("NFKC", t).casefold().replace("​", "").replace("­", "")))


@F.pandas_udf(BooleanType())
def titles_agree(a, b):
    """Compacted titles that hold one another or match by 0.82 or more."""
    import re
    import unicodedata
    from difflib import SequenceMatcher

    import pandas as pd

    def compact(t):
        return re.sub(r"\W+", "", unicodedata.normalize("NFKC", t or "").casefold().replace("​", "").replace("­", ""))

    def one(p, q):
        p, q = compact(p), compact(q)
        return bool(p and q) and (p in q or q in p or SequenceMatcher(None, p, q).ratio() >= 0.82)

    return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)])


def clean_lines(x: Column) -> Column:
    """Lines with spaces collapsed; blank lines and repeats of the line before are dropped."""
    lines = F.split(F.regexp_replace(F.regexp_replace(x, "​", ""), " ", " "), "\r\n|\n|\r")
    full = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_replace(s, "[\t\r\f\u000b ]+", " "))), lambda s: s != "")
    kept = F.transform(F.filter(F.transform(full, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda p: (p["i"] == 0) | (p["s"] != F.get(full, p["i"] - 1))), lambda p: p["s"])
    return F.array_join(kept, "\n")


def strip(x: Column) -> Column:
    """Without white space of any script at both ends; trim() knows spaces only."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def lao_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(LAO))


def language_of(x: Column) -> Column:
    """lo where Lao characters are a third of the letters at least, else en."""
    letters = F.regexp_count(x, F.lit("\\p{L}"))
    return F.when(lao_count(x) >= F.greatest(F.lit(1), F.floor(letters / 3)), "lo").otherwise("en")


def usable_title(title: Column, body: Column, least_script: int = 3, script: str = LAO) -> Column:
    """The title, or the body's first full line where the title is blank, broken or lacks the script."""
    broken = F.regexp_count(title, F.lit("�")) / F.greatest(F.length(title), F.lit(1)) > 0.2
    bad = (strip(title) == "") | broken | (F.regexp_count(title, F.lit(script)) < least_script)
    first = F.get(F.filter(F.transform(F.split(body, "\n"), strip), lambda s: s != ""), F.lit(0))
    return F.when(bad, F.coalesce(first, title)).otherwise(strip(title))


def confidence(x: Column) -> Column:
    """Into 0..1; percentages are divided, what is no number is null."""
    v = F.expr("try_cast(NULL AS double)") if x is None else x.try_cast("double")
    v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def stable_id(prefix: str, x: Column, n: int = 16) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(x, 256), 1, n))


def numbered_id(prefix: str, x: Column) -> Column:
    return F.format_string(f"{prefix}-%06d", x.cast("long"))
