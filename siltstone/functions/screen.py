"""Content screens: term hits as arrays in the order of their vocabulary. Every vocabulary is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

_NONE = "array<string>"


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast(_NONE)


def term_hits(x: Column, terms: Sequence[str] = vocab.SCREEN_TERMS) -> Column:
    """Terms that the lower-case text holds."""
    low = F.lower(x)
    return F.filter(_strings(terms), lambda t: F.contains(low, t))


def token_hits(x: Column, tokens: Sequence[tuple[str, str]] = vocab.LAO_TOKENS) -> Column:
    """Labels of the tokens that the text without spaces and hyphens holds."""
    squeezed = F.regexp_replace(x, "[\\s​-]+", "")
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in tokens])
    return F.transform(F.filter(pairs, lambda p: F.contains(squeezed, p["t"])), lambda p: p["n"])


def union_hits(x: Column, tokens=vocab.LAO_TOKENS, terms=vocab.UNION_TERMS) -> Column:
    return F.array_distinct(F.concat(token_hits(x, tokens), term_hits(x, terms)))


def masked(x: Column, phrases: Sequence[str] = vocab.MASKED) -> Column:
    """Each phrase, as it is and in title case, becomes a space; other cases stay."""
    for p in phrases:
        x = F.replace(F.replace(x, F.lit(p), F.lit(" ")), F.lit(p.title()), F.lit(" "))
    return x


def strict_hits(x: Column, phrases=vocab.MASKED, tokens=vocab.LAO_TOKENS, terms=vocab.UNION_TERMS) -> Column:
    return union_hits(masked(x, phrases), tokens, terms)


def context_hits(x: Column, word: str = "ຈີນ", mask: str = vocab.LAO_MASK, compounds=vocab.LAO_TOKENS[1:], contexts=vocab.LAO_CONTEXT, terms=vocab.CONTEXT_TERMS, reach: int = vocab.CONTEXT_REACH) -> Column:
    """Compounds; the bare word if said twice or near a context word; then terms."""
    text = F.regexp_replace(x, mask, " ") if mask else x
    near = "|".join(contexts)
    said = (F.regexp_count(text, F.lit(word)) >= 2) | text.rlike(f"(?:{near}).{{0,{reach}}}{word}|{word}.{{0,{reach}}}(?:{near})")
    bare = F.when(said, _strings([word])).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.concat(token_hits(text, compounds), bare, term_hits(text, terms)))


def direct_hits(x: Column, terms: Sequence[str]) -> Column:
    low = F.lower(x)
    return F.filter(_strings(terms), lambda t: F.contains(low, F.lower(t)))


def keyword_contexts(x: Column, keywords: Sequence[str] = vocab.DIRECT_QUERIES, radius: int = 240) -> Column:
    """array<struct(start, end, keyword, context)> of every occurrence in order; ASCII keywords match in any case.

    Occurrences of one keyword don't overlap; the keyword's places come from the lengths of the parts between them.
    """

    def hits(k: str) -> Column:
        pattern = ("(?i)" if k[0].isascii() else "") + "".join(c if c.isalnum() or ord(c) > 127 else f"\\{c}" for c in k)
        between, n = F.split(x, pattern), len(k)
        places = F.transform(F.slice(between, 1, F.size(between) - 1), lambda s, i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda a, p: a + F.length(p)) + i * n)
        context = lambda s: F.trim(F.substring(x, F.greatest(F.lit(0), s - radius) + 1, F.least(s, F.lit(radius)) + n + radius))
        return F.transform(places, lambda s: F.struct(s.alias("start"), (s + n).alias("end"), F.lit(k).alias("keyword"), context(s).alias("context")))

    parts = [hits(k) for k in keywords]
    return F.array_sort(F.concat(*parts))


def contaminated(x: Column, mark: str = vocab.TEMPLATE_MARK, spam=vocab.SPAM_MARKS, least: int = vocab.LEAST_SPAM) -> Column:
    return F.contains(F.lower(x), F.lit(mark)) & (F.size(term_hits(x, spam)) >= least)


def challenged(x: Column, marks=vocab.CHALLENGE_MARKS, first: int = 8000) -> Column:
    return F.size(term_hits(F.substring(x, 1, first), marks)) > 0


def retrieval_tier(queries: Column) -> Column:
    joined = F.lower(F.array_join(queries, " "))
    some = lambda terms: F.exists(_strings(terms), lambda t: F.contains(joined, t))
    return F.when(some(vocab.TIER2_TERMS), vocab.TIERS[1]).when(some(vocab.TIER1_TERMS), vocab.TIERS[0]).when(joined != "", vocab.TIERS[2]).otherwise(vocab.TIERS[3])


def content_origin(label: Column) -> Column:
    has = lambda *w: F.exists(_strings(w), lambda t: F.contains(label, t))
    return F.when(has("中国媒体", "新华"), "xinhua").when(has("其他媒体", "供稿", "转载"), "syndicated").when(has("本地原创"), "local_original").otherwise("unknown")


def grade_in(label: Column) -> Column:
    found = F.regexp_extract(label, "(?<![A-Z0-9])(A1|A2|B1|B2|C1|C2)(?![A-Z0-9])", 1)
    return F.when(found != "", found).otherwise("C2")


def formal(grade: Column, metadata: Column) -> Column:
    """Quota-eligible evidence: formal grades, or C1 with a second corroboration that is true."""
    second = F.get_json_object(metadata, "$.second_corroboration")
    true = second.isNotNull() & ~second.isin("", "false", "0", "null", "[]", "{}")
    return F.coalesce(grade.isin(*vocab.FORMAL_GRADES) | ((grade == "C1") & true), F.lit(False))


def long_enough(body: Column, kind: str) -> Column:
    gate = F.length(F.trim(body)) >= vocab.BODY_LEAST[kind]
    return gate & (F.regexp_count(body, F.lit("[຀-໿]")) >= 60) if kind == "php_clean" else gate


def family(code: Column) -> Column:
    up = F.upper(code)
    out = None
    for f in vocab.FAMILIES:
        out = F.when(F.startswith(up, F.lit(f)), f) if out is None else out.when(F.startswith(up, F.lit(f)), f)
    return out.otherwise(up)


def segment(body: Column, marker: str = vocab.POPULAR_NEWS, least: int = 60) -> Column:
    """Full lines before the one that holds the marker, if there is one and what stays is long enough; else the body."""
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda s: s != "")
    cut = F.coalesce(F.array_min(F.transform(F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda p: F.contains(F.regexp_replace(p["s"], "[\\s​]+", ""), F.lit(marker))), lambda p: p["i"])), F.lit(-1))
    kept = F.array_join(F.slice(lines, 1, F.greatest(cut, F.lit(0))), "\n\n")
    return F.when((cut >= 0) & (F.length(kept) >= least), kept).otherwise(body)


def column_text(items: Column, columns: Sequence[tuple[float, float]], y_min: float, y_max: float, keep: str = "[຀-໿]") -> Column:
    """Text of a page in column order: items array<struct(x, y, text)>, each column sorted by y and x, debris dropped."""
    words = "|".join(vocab.KEPT_LATIN)

    def column(low: float, high: float) -> Column:
        some = F.filter(items, lambda p: (p["x"] >= low) & (p["x"] < high) & (p["y"] >= y_min) & (p["y"] <= y_max) & (F.trim(p["text"]) != ""))
        ordered = F.array_sort(F.transform(some, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), F.regexp_replace(F.trim(p["text"]), "[ \t]+", " ").alias("t"))))
        good = F.filter(ordered, lambda p: p["t"].rlike(keep) | p["t"].rlike(f"(?i)\\b(?:{words})\\b") | p["t"].rlike("^[\\d\\s.,()/%:+-]+$"))
        return F.array_join(F.transform(good, lambda p: p["t"]), "\n")

    made = [column(low, high) for low, high in columns]
    return F.concat(F.trim(F.array_join(F.filter(F.array(*made), lambda c: c != ""), "\n\n")), F.lit("\n"))
