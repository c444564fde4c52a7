"""Product text: normal spelling, tokens, signatures, categories and brands as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

LETTER = r"[\p{L}\p{N}]"


def java(stems: str) -> str:
    """Pattern of stems that begin a word, for Spark; a stem ending in $ is a whole word."""
    return rf"(?iu)(?<!{LETTER})(?:{stems.replace('$', rf'(?!{LETTER})')})"


def re2(stems: str) -> str:
    """The same for DuckDB, whose expressions have no lookaround; for tests of presence only."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}])(?:{stems.replace('$', rf'(?:$|[^\p{{L}}\p{{N}}])')})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, wherever the optimizer puts the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has(text: Column, stems: str) -> Column:
    return text.rlike(java(stems))


def normalise(text: Column) -> Column:
    """Latin spelling of product names that are often written in Cyrillic."""
    for word, latin in V.SPELLINGS.items():
        text = F.regexp_replace(text, f"(?iu){word}", latin)
    for letter, latin in V.LOOKALIKES.items():
        text = F.regexp_replace(text, rf"(?iu)(?<!{LETTER}){letter}(?=\d)", latin)
    return text


def normalise_sql(text: str) -> str:
    for word, latin in V.SPELLINGS.items():
        text = f"regexp_replace({text}, '(?i){word}', '{latin}', 'g')"
    for letter, latin in V.LOOKALIKES.items():
        text = rf"regexp_replace({text}, '(?i)(^|[^\p{{L}}\p{{N}}]){letter}(\d)', '\1{latin}\2', 'g')"
    return text


def tokenize(text: Column) -> Column:
    """Lower-case tokens without stop words; "S24+" and "S24Plus" are both s24 and plus."""
    return tokens_of(F.lower(normalise(text)))


def tokens_of(low: Column) -> Column:
    """Tokens of a text that is lower-case and normalised."""
    variants = "|".join(V.VARIANTS)
    t = F.regexp_replace(low, rf"({LETTER})\+", "$1 plus ")
    t = F.regexp_replace(t, rf"(\d)({variants})(?!\p{{L}})", "$1 $2 ")
    t = F.regexp_replace(t, rf"(?<!\p{{L}})({variants})(\d)", "$1 $2 ")
    t = F.regexp_replace(t, r"(\d+)(?:st|nd|rd|th)(?!\p{L})", "$1")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}+]+", " ")
    return F.filter(F.split(t, " +"), lambda x: (x != "") & ~x.isin(*V.STOP_WORDS))


def tokenize_sql(text: str) -> str:
    variants = "|".join(V.VARIANTS)
    t = f"lower({normalise_sql(text)})"
    t = rf"regexp_replace({t}, '([\p{{L}}\p{{N}}])\+', '\1 plus ', 'g')"
    t = rf"regexp_replace({t}, '(\d)({variants})([^\p{{L}}]|$)', '\1 \2 \3', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\p{{L}}])({variants})(\d)', '\1\2 \3 ', 'g')"
    t = rf"regexp_replace({t}, '(\d+)(?:st|nd|rd|th)([^\p{{L}}]|$)', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}+]+', ' ', 'g')"
    stop = ", ".join(map(quoted, V.STOP_WORDS))
    return f"list_filter(string_split({t}, ' '), lambda x: x <> '' AND x NOT IN ({stop}))"


def signatures(tokens: Column) -> Column:
    """Tokens and the concatenations of two and of three neighbours, each once."""
    two = F.transform(tokens, lambda x, i: F.concat(x, F.get(tokens, i + 1)))
    three = F.transform(tokens, lambda x, i: F.concat(x, F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.array_distinct(F.filter(F.concat(tokens, two, three), lambda x: x.isNotNull()))


def signatures_sql(tokens: str) -> str:
    two = f"list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || {tokens}[i + 1])"
    three = f"list_transform(range(1, len({tokens}) - 1), lambda i: {tokens}[i] || {tokens}[i + 1] || {tokens}[i + 2])"
    return f"list_distinct(list_concat({tokens}, list_concat({two}, {three})))"


def detect_category(text: Column) -> Column:
    """The first category of which the text has a stem."""
    t = normalise(text)
    out = None
    for name, (_, _, stems) in V.CATEGORIES.items():
        if stems:
            out = F.when(has(t, stems), name) if out is None else out.when(has(t, stems), name)
    return out


def detect_category_sql(text: str) -> str:
    t = normalise_sql(text)
    cases = " ".join(
        f"WHEN regexp_matches({t}, {quoted(re2(stems))}) THEN '{name}'" for name, (_, _, stems) in V.CATEGORIES.items() if stems
    )
    return f"CASE {cases} END"


def brands_in(text: Column) -> Column:
    """Brand families that the text names, in order of precedence; else those of its product lines."""
    return named_in(F.lower(normalise(text)))


def named_in(t: Column) -> Column:
    """Brand families of a text that is lower-case and normalised."""
    none = F.lit(None).cast("string")
    named = F.array(*(F.when(has(t, b + "$"), F.lit(V.BRAND_FAMILY.get(b, b))).otherwise(none) for b in V.BRANDS))
    named = F.array_distinct(F.array_compact(named))
    lines = F.array_compact(F.array(*(F.when(has(t, "|".join(s)), F.lit(b)).otherwise(none) for b, s in V.BRAND_LINES.items())))
    return let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(lines))


def brands_in_sql(text: str) -> str:
    t = f"lower({normalise_sql(text)})"
    case = lambda stems, name: f"CASE WHEN regexp_matches({t}, {quoted(re2(stems))}) THEN '{name}' END"
    named = ", ".join(case(b + "$", V.BRAND_FAMILY.get(b, b)) for b in V.BRANDS)
    lines = ", ".join(case("|".join(s), b) for b, s in V.BRAND_LINES.items())
    # list_distinct keeps no order: the first place of each is kept by hand
    first = f"list_filter([{named}], lambda x, i: x IS NOT NULL AND list_position([{named}], x) = i)"
    return f"CASE WHEN len({first}) > 0 THEN {first} ELSE list_filter([{lines}], lambda x: x IS NOT NULL) END"
