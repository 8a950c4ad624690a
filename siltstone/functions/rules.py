"""Rule tables: secrets, injection phrases, generated-file marks, menu and scan noise, path policies.

Reasons are sorted, distinct names in an array; a record with a rejection is rejected, else one with a review reason
waits for review, else it is a candidate.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import text as T

#: Fixed values.
SECRETS = (
    ("private_key", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----"),
    ("github_pat", r"\bghp_[A-Za-z0-9_]{30,}\b"),
    ("openai_key", r"\bsk-[A-Za-z0-9_-]{32,}\b"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
)
LINT_SECRETS = (
    ("private_key", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----"),
    ("assignment", r"""(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[:=]\s*['"][^'"]{16,}['"]"""),
    ("github_pat", r"\bghp_[A-Za-z0-9_]{30,}\b"),
    ("openai_key", r"\bsk-[A-Za-z0-9]{32,}\b"),
)
INJECTION = (r"(?i)\bignore (?:all |any )?(?:previous|prior|earlier) instructions\b", r"(?i)\bsystem prompt\b", r"(?i)\bdeveloper message\b")
GENERATED = (
    r"(?im)^[ \t]*(?:[#/*;!\-]+[ \t]*)?(?:this file (?:is|was) )?(?:auto[- ]?generated|automatically generated|generated file)\b[^\n]{0,120}$",
    r"(?im)^[ \t]*(?:[#/*;!\-]+[ \t]*)?do not edit(?: this file)?[.!]?[ \t]*$",
    r"(?im)^[ \t]*(?:[#/*;!\-]+[ \t]*)?generated by [^\n]{1,120}$",
)
MENU = r"(?im)^(?:home|about|contact|privacy|terms|cookies|subscribe|login|sign in)\s*$"
SCAN_NOISE = r"[|]{3,}|[_]{6,}|(?:\b\w\b\s*){12,}"
PATH_PARTS = ("node_modules", "vendor", "vendored", "third_party", "third-party", "dist", "build", "out", "coverage", ".cache", "__pycache__", "snapshots", "snapshot", "baselines", "baseline", "generated", "minified", "golden", "testdata", "test_data")
FILE_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "composer.lock", "changelog", "changelog.md", "news", "news.md")
CANDIDATE, REVIEW, REJECTED = "filtered_candidate_not_admitted", "human_review_required_not_admitted", "rejected_not_admitted"
#: Suffix of a text for its language, as the rules need one; the lower limits are those of code and of documents.
SUFFIXES = {"python": ".py", "javascript": ".js", "typescript": ".ts", "powershell": ".ps1", "sql": ".sql", "text": ".md"}


def reasons(*rules: tuple[Column, str]) -> Column:
    """Sorted distinct names of the rules that hold; a null condition does not hold."""
    named = [F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for holds, name in rules]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))


def sql_reasons(*rules: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {holds} THEN '{name}' END" for holds, name in rules)
    return f"list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL)))"


def status(reject: Column, review: Column) -> Column:
    return F.when(F.size(reject) > 0, REJECTED).when(F.size(review) > 0, REVIEW).otherwise(CANDIDATE)


def sql_status(reject: str, review: str) -> str:
    return f"CASE WHEN len({reject}) > 0 THEN '{REJECTED}' WHEN len({review}) > 0 THEN '{REVIEW}' ELSE '{CANDIDATE}' END"


def any_match(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def header(c: str) -> Column:
    """The first 40 lines, at most 8,000 characters: where a generated file says so."""
    return F.substring(F.array_join(F.slice(T.lines(c), 1, 40), "\n"), 1, 8000)


def quality(c: str, is_document: Column) -> tuple[Column, Column]:
    """(reject, review) reasons of a text by the default limits. Needs the columns of `content_statistics` beside it."""
    s = {k: F.col(k) for k in ("char_count", "token_count_proxy", "printable_ratio", "longest_line", "nonempty_line_count", "repeated_line_ratio", "top_line_ratio", "letter_ratio")}
    many = s["nonempty_line_count"] >= 20
    low = (s["char_count"] < F.when(is_document, 120).otherwise(60)) | (s["token_count_proxy"] < F.when(is_document, 24).otherwise(12))
    reject = reasons(
        (low, "too_short_or_low_information"), (s["char_count"] > 800_000, "decoded_text_too_large"), (s["printable_ratio"] < 0.995, "non_printable_text"),
        (s["longest_line"] > 20_000, "extreme_line_length"), (many & (s["repeated_line_ratio"] >= 0.72), "repeated_template_or_snapshot"),
        (many & (s["top_line_ratio"] >= 0.5), "single_line_template_dominates"), (any_match(header(c), GENERATED), "generated_file_marker"),
        *[(F.col(c).rlike(p), f"possible_secret:{name}") for name, p in SECRETS], (s["letter_ratio"] < 0.04, "very_low_language_content"),
    )
    review = reasons((many & (s["repeated_line_ratio"] >= 0.48) & (s["repeated_line_ratio"] < 0.72), "high_repeated_line_ratio"), (any_match(F.col(c), INJECTION), "prompt_injection_language"))
    return reject, review


def _found(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p.replace(chr(39), chr(39) * 2)}')"


def sql_quality(c: str, is_document: str) -> tuple[str, str]:
    head = f"substr(array_to_string({T.sql_lines(c)}[:40], chr(10)), 1, 8000)"
    reject = sql_reasons(
        (f"char_count < (CASE WHEN {is_document} THEN 120 ELSE 60 END) OR token_count_proxy < (CASE WHEN {is_document} THEN 24 ELSE 12 END)", "too_short_or_low_information"),
        ("char_count > 800000", "decoded_text_too_large"), ("printable_ratio < 0.995", "non_printable_text"), ("longest_line > 20000", "extreme_line_length"),
        ("nonempty_line_count >= 20 AND repeated_line_ratio >= 0.72", "repeated_template_or_snapshot"), ("nonempty_line_count >= 20 AND top_line_ratio >= 0.5", "single_line_template_dominates"),
        (" OR ".join(_found(head, p) for p in GENERATED), "generated_file_marker"), *[(_found(c, p), f"possible_secret:{n}") for n, p in SECRETS], ("letter_ratio < 0.04", "very_low_language_content"),
    )
    review = sql_reasons(("nonempty_line_count >= 20 AND repeated_line_ratio >= 0.48 AND repeated_line_ratio < 0.72", "high_repeated_line_ratio"), (" OR ".join(_found(c, p) for p in INJECTION), "prompt_injection_language"))
    return reject, review


def row_quality(normal: str, tokens: str, least: int = 240, most: int = 12_000) -> tuple[Column, Column]:
    """(reject, review) reasons of a row text in its normal form `normal` with its token array `tokens`."""
    t, n = F.col(normal), F.size(tokens)
    reject = reasons(
        ((F.char_length(t) < least) | (n < 45), "too_short_or_low_information"), (F.char_length(t) > most, "row_too_large"), (t.rlike(MENU), "menu_or_navigation_noise"),
        (t.rlike(SCAN_NOISE), "ocr_or_template_noise"), ((F.size(F.array_distinct(tokens)) / F.greatest(n, F.lit(1)) < 0.18) & (n > 120), "low_vocabulary_diversity"),
        *[(t.rlike(p), f"possible_secret:{name}") for name, p in SECRETS],
    )
    low = F.lower(t)
    return reject, reasons((low.contains("ignore previous instructions") | low.contains("system prompt"), "prompt_injection_language"))


def sql_row_quality(t: str, tokens: str, least: int = 240, most: int = 12_000) -> tuple[str, str]:
    reject = sql_reasons(
        (f"length({t}) < {least} OR len({tokens}) < 45", "too_short_or_low_information"), (f"length({t}) > {most}", "row_too_large"), (_found(t, MENU), "menu_or_navigation_noise"),
        (_found(t, SCAN_NOISE), "ocr_or_template_noise"), (f"len(list_distinct({tokens})) / greatest(len({tokens}), 1) < 0.18 AND len({tokens}) > 120", "low_vocabulary_diversity"),
        *[(_found(t, p), f"possible_secret:{n}") for n, p in SECRETS],
    )
    return reject, sql_reasons((f"contains(lower({t}), 'ignore previous instructions') OR contains(lower({t}), 'system prompt')", "prompt_injection_language"))


def path_reason(path: str | Column, extra_parts=(), allowed_parts=(), extra_names=(), patterns=()) -> Column:
    """The first rule a path breaks: a refused part, a refused file name, a policy pattern; null if none."""
    p = F.col(path) if isinstance(path, str) else path
    parts = F.filter(F.split(F.lower(p), "/"), lambda x: x != "")
    refused = sorted((set(PATH_PARTS) | {x.lower() for x in extra_parts}) - {x.lower() for x in allowed_parts})
    bad = F.get(F.filter(parts, lambda x: x.isin(refused)), F.lit(0))
    name = F.try_element_at(parts, F.lit(-1))
    out = F.when(bad.isNotNull(), F.concat(F.lit("path marker rejected: "), bad))
    out = out.when(name.isin(sorted(set(FILE_NAMES) | {x.lower() for x in extra_names})), F.concat(F.lit("low-value filename rejected: "), name))
    for x in patterns:
        out = out.when(p.rlike(f"(?i){x}"), F.lit(f"source path policy rejected: {x}"))
    return out


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: `*` and `?` cross `/`; a final `/` takes everything below."""
    glob = glob.replace("\\", "/").lstrip("/")
    below = glob.endswith("/")
    out, i, plain = "", 0, glob.rstrip("/") if below else glob
    while i < len(plain):
        c = plain[i]
        close = plain.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = plain[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}(?:/.*)?$" if below else f"(?s)^{out}$"


def matches_any(path: Column, globs) -> Column:
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")
    return any_match(clean, [glob_pattern(g) for g in globs])


def suffix(path: str | Column) -> Column:
    """Last suffix in lower case, `.d.ts` as one; the bare names of build and licence files stand for themselves."""
    p = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(F.lower(p), r"([^/]*)/*$", 1)
    last = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.when(name.isin("makefile", "readme", "license", "copying", "copyright"), name).when(name.rlike(r"^.+\.d\.ts$"), ".d.ts").otherwise(last)


#: Language of a suffix.
LANGUAGE_OF = {
    "python": (".py", ".pyi"), "javascript": (".js", ".mjs", ".cjs"), "typescript": (".ts", ".tsx", ".d.ts"), "powershell": (".ps1", ".psm1", ".psd1"), "sql": (".sql",), "sql_expected": (".out",),
    "documentation": (".sgml", ".rst", ".md", ".mdx", ".xml", ".html"), "text": (".txt",), "configuration": (".json", ".toml", ".ini", ".yaml", ".yml"), "stylesheet": (".css",),
}


def language_hint(path: str | Column) -> Column:
    s, out = suffix(path), None
    for language, ends in LANGUAGE_OF.items():
        out = F.when(s.isin(*ends), language) if out is None else out.when(s.isin(*ends), language)
    return out.otherwise("other_text")


def family_hint(source: str, path: str) -> Column:
    """Source and the first up to three folders of a path."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    depth = F.least(F.lit(3), F.greatest(F.lit(1), F.size(parts) - 1))
    return F.concat(F.col(source), F.lit(":"), F.when(F.size(parts) == 0, "root").otherwise(F.array_join(F.slice(parts, F.lit(1), depth), "/")))


def classify_member(path: str, size: str, excluded=(), allowed=("*",), suffixes=(), names=(), most_bytes: int = 4 << 20) -> Column:
    """Where an archive member goes: exclusions before allowed paths before size before file type."""
    p = F.col(path)
    name = F.regexp_extract(F.lower(p), r"([^/]*)/*$", 1)
    known = suffix(path).isin(*[s.lower() for s in suffixes] or [""]) | name.isin(*[n.lower() for n in names] or [""])
    out = F.when(matches_any(p, excluded), "excluded_path") if excluded else F.when(F.lit(False), "excluded_path")
    return out.when(~matches_any(p, allowed), "outside_allowlist").when(F.col(size) > most_bytes, "oversize_file").when(~known, "unsupported_type").otherwise("selected")


def safe_path(path: str) -> Column:
    """An archive path with `/` and without leading `./`; null where it is absolute, empty or climbs."""
    p = F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"^(?:\./)+", "")
    return F.when((p == "") | p.startswith("/") | p.rlike(r"(?:^|/)(?:\.\.|\.)(?:/|$)|//"), F.lit(None)).otherwise(p)
