"""Text normal forms and lexical statistics as column expressions, each with its DuckDB twin (`sql_…`).

Patterns spell white space and digits out, so that Java, RE2 and Python agree on every character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's `\s`, line ends as `str.splitlines`, the two lexical token patterns.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
LEXICAL = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?|[^" + WS + "]"
AUDIT = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+(?:\.\p{Nd}+)?|==={0,1}|!==|==|!=|<=|>=|=>|::|\$\p{Nd}+|[^" + WS + "]"
UUID, HEX, NUMBER = r"\b[0-9a-f]{8}-[0-9a-f-]{27,}\b", r"\b[0-9a-f]{8,}\b", r"\b(?:0x[0-9a-f]+|[0-9]+(?:\.[0-9]+)?)\b"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of WS one by one: trimming and translating by characters is far cheaper than the class in a pattern.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LEXICAL_SPACED = LEXICAL.replace(f"[^{WS}]", "[^ ]")
_AUDIT_SPACED = AUDIT.replace(f"[^{WS}]", "[^ ]")


def spaced(c: str | Column) -> Column:
    """The text with every white-space character as a space."""
    return F.translate(_c(c), WS_CHARS, " " * len(WS_CHARS))


def strip(c: str | Column) -> Column:
    return F.btrim(_c(c), F.lit(WS_CHARS))


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normalize_text(c: str | Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.trim(spaced(F.lower(_c(c)))), " {2,}", " ")


def sql_normalize(c: str) -> str:
    return f"regexp_replace(lower({sql_strip(c)}), '[{WS}]+', ' ', 'g')"


def normalize_words(c: str | Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces, stripped."""
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


def sql_words(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def lf(c: str | Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(_c(c), "\r\n|\r", "\n")


def lines(c: str | Column) -> Column:
    """Lines without their ends; a final end adds no empty line."""
    parts = F.split(_c(c), LINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sql_lines(c: str) -> str:
    parts = f"regexp_split_to_array({c}, '{LINE}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def normalize_rows(c: str | Column) -> Column:
    """LF line ends, each line's white space as single spaces, blank lines dropped."""
    cleaned = F.transform(F.split(lf(c), "\n", -1), lambda x: F.regexp_replace(F.trim(spaced(x)), " {2,}", " "))
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def sql_rows(c: str) -> str:
    inner = f"regexp_split_to_array(regexp_replace({c}, '\\r\\n|\\r', chr(10), 'g'), '\\n')"
    return f"array_to_string(list_filter(list_transform({inner}, lambda x: {sql_strip(f"regexp_replace(x, '[{WS}]+', ' ', 'g')")}), lambda x: x <> ''), chr(10))"


def normalize_template(c: str | Column) -> Column:
    """Normalised non-blank lines with UUIDs, long hex runs and numbers, in this order, as marks."""

    def masked(x: Column) -> Column:
        for pattern, mark in ((UUID, "<uuid>"), (HEX, "<hex>"), (NUMBER, "<n>")):
            x = F.regexp_replace(x, pattern, mark)
        return x

    kept = F.filter(F.transform(lines(c), normalize_text), lambda x: x != "")
    return F.array_join(F.transform(kept, masked), "\n")


def sql_template(c: str) -> str:
    x = "x"
    for pattern, mark in ((UUID, "<uuid>"), (HEX, "<hex>"), (NUMBER, "<n>")):
        x = f"regexp_replace({x}, '{pattern}', '{mark}', 'g')"
    return f"array_to_string(list_transform(list_filter(list_transform({sql_lines(c)}, lambda x: {sql_normalize('x')}), lambda x: x <> ''), lambda x: {x}), chr(10))"


def lexical_tokens(c: str | Column, lower: bool = True) -> Column:
    found = F.regexp_extract_all(spaced(c), F.lit(_LEXICAL_SPACED), F.lit(0))
    return F.transform(found, F.lower) if lower else found


def sql_lexical(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '{LEXICAL}'), lambda x: lower(x))"


def lexical_size(c: str | Column) -> Column:
    """Number of lexical tokens, without building the list of lower-cased ones."""
    return F.regexp_count(spaced(c), F.lit(_LEXICAL_SPACED))


def sql_lexical_size(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{LEXICAL}'))"


def audit_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(spaced(c), F.lit(_AUDIT_SPACED), F.lit(0))


def canonical_text(c: str | Column) -> Column:
    """Audit tokens in lower case, joined by a space."""
    return F.lower(F.array_join(audit_tokens(c), " "))


def sql_canonical(c: str) -> str:
    return f"lower(array_to_string(regexp_extract_all({c}, '{AUDIT}'), ' '))"


def let(value: Column, use) -> Column:
    """use(value) with `value` computed once a row. Inside a lambda Spark would compute an expression for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(tokens: Column, n: int) -> Column:
    """The set of runs of n tokens, each joined by U+001F; empty for fewer tokens."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.concat_ws("\x1f", *[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def window_hashes(tokens: Column, n: int) -> Column:
    """The set of 64-bit hashes of runs of n tokens."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]))
        return F.when(F.size(t) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, runs)


def trigrams(c: str | Column) -> Column:
    """Hashed set of lower-cased audit-token trigrams."""
    return window_hashes(F.transform(audit_tokens(c), F.lower), 3)


def sql_windows(tokens: str, n: int) -> str:
    joined = " || chr(31) || ".join(f"({tokens})[i + {k}]" for k in range(n))
    return f"list_distinct(list_transform(range(1, len({tokens}) - {n - 2}), lambda i: {joined}))"


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of sets as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def newline_style(c: str | Column) -> Column:
    """none, lf, crlf, cr or mixed."""
    t = _c(c)
    crlf = F.regexp_count(t, F.lit("\r\n"))
    n, r = F.regexp_count(t, F.lit("\n")) - crlf, F.regexp_count(t, F.lit("\r")) - crlf
    kinds = (crlf > 0).cast("int") + (n > 0).cast("int") + (r > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(n > 0, "lf").otherwise("cr")


def control_ratio(c: str | Column) -> Column:
    """Share of control characters other than tab, LF, FF and CR; 0 for empty texts."""
    t = _c(c)
    bad = F.char_length(t) - F.char_length(F.regexp_replace(t, r"[\x{00}-\x{08}\x{0b}\x{0e}-\x{1f}]", ""))
    return F.when(F.char_length(t) == 0, F.lit(0.0)).otherwise(bad / F.char_length(t))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours in an array; 0 for an empty one."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(items, start, step, lambda s: s["best"])


def content_statistics(c: str) -> list[Column]:
    """The nine statistics of a text; ratios of empty texts are 0."""
    t, all_lines = F.col(c), lines(c)
    kept = F.filter(F.transform(all_lines, normalize_text), lambda x: x != "")
    chars, n = F.char_length(t), F.size(kept)
    letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]", ""))
    hidden = F.char_length(t) - F.char_length(F.regexp_replace(t, r"[\p{C}\p{Z}&&[^ \n\r\t]]", ""))
    part = lambda x, of: F.when(of == 0, F.lit(0.0)).otherwise(x / of)
    return [
        chars.alias("char_count"), F.size(all_lines).alias("line_count"), n.alias("nonempty_line_count"), lexical_size(c).alias("token_count_proxy"),
        part(letters, chars).alias("letter_ratio"), part(chars - hidden, chars).alias("printable_ratio"),
        F.coalesce(F.array_max(F.transform(all_lines, F.char_length)), F.lit(0)).alias("longest_line"),
        F.when(n == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(kept)) / n).alias("repeated_line_ratio"),
        part(longest_run(F.array_sort(kept)), n).alias("top_line_ratio"),
    ]


def sql_statistics(c: str) -> str:
    """The same as a select list over a table with the column `c`."""
    rows, kept = sql_lines(c), f"list_filter(list_transform({sql_lines(c)}, lambda x: {sql_normalize('x')}), lambda x: x <> '')"
    letters = f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    hidden = f"(length({c}) - length(regexp_replace(regexp_replace({c}, '[ \\n\\r\\t]', 'x', 'g'), '[\\p{{C}}\\p{{Z}}]', '', 'g')))"
    return f"""length({c}) AS char_count, len({rows}) AS line_count, len({kept}) AS nonempty_line_count, {sql_lexical_size(c)} AS token_count_proxy,
  CASE WHEN length({c}) = 0 THEN 0.0 ELSE {letters} / length({c}) END AS letter_ratio, CASE WHEN length({c}) = 0 THEN 0.0 ELSE (length({c}) - {hidden}) / length({c}) END AS printable_ratio,
  coalesce(list_max(list_transform({rows}, lambda x: length(x))), 0) AS longest_line,
  CASE WHEN len({kept}) = 0 THEN 0.0 ELSE 1.0::DOUBLE - len(list_distinct({kept})) / len({kept}) END AS repeated_line_ratio,
  CASE WHEN len({kept}) = 0 THEN 0.0 ELSE list_max(map_values(list_histogram({kept}))) / len({kept}) END AS top_line_ratio"""
