"""Keyword-stuffed and link-list pages.

Two kinds of evidence are joined. Replication: every page is cut into phrase shingles of five words, and the distinct
hosts that carry each phrase are counted over all pages; the share of a page's shingles that are carried by several
hosts says how far it is stitched together from stock phrases. List density: the share of its words that stand in units
(sentences or lines) made of links, tags, menu cells or bare keywords. A page is junk if replicated phrases are a good
part of it and list units most of it, or if replicated list phrases in masked form are most of it by themselves.

Phrases are compared twice. Verbatim: the same five words, whatever they are, in lower case and without the marks between
them. As good texts are copied too, list density has to confirm them. They are as many as the words of the corpus, so
their hashes are written in ranges, counted one range after another; a phrase of which one host is the least and the
greatest has one host only, and is dropped before any join.

Masked: spam repeats the form of its phrases with other topics ("best X discount, X, Y premium"), hardly ever the same
five words. So phrases are also compared with topic words, numbers and link targets masked, and the marks between words
kept. A list phrase has no function word, no name of code and no sign of code in it; one function word may stand in a phrase
that is cut by two line or cell ends. Masked forms are few, so the tables of forms and hosts stay small, and hosts per
form are distinct pairs that combine before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans.staging import Stage, spread
from siltstone.sources.tables import label

SHINGLE = 5
#: Shares of replicated list phrases, alone and where list units are most of the page; hosts that make a phrase replicated.
MOST, PART, LISTED, HOSTS = 0.5, 0.3, 0.5, 3
#: Fewer words in list units, or in replicated list phrases, than this are no evidence.
LEAST_WORDS = 8
#: Hash ranges of verbatim phrases, as a power of two; each is shuffled by itself.
RANGE_BITS = 2
RANGES = [f"same{k}" for k in range(1 << RANGE_BITS)]

#: Frequent function words of the languages met in the corpus.
FUNCTION_WORDS = frozenset(
    """
    the a an of and or to in on at by for from with without into over under near beside beneath between through around
    toward is are was were be been has have had that this these which who whose it its as if when whenever while because
    so but not no never until after before since than then there each every all most can may must only
    der die das den dem des ein eine einer einen und oder ist nicht wird werden wenn dann mit ohne zu zur sonst sich so
    nur bleibt bei jede jeder ob als auf von
    le la les un une des du de et ou est pas ne que qui il elle sur dans pour avec sans ce cette doit avant après quand
    si tant car puis
    el los las una del y o se con por para como debe cuando su hasta así siempre antes después
    lo gli di della e non che per finché da prima poi sempre
    os as um uma do da não enquanto depois fica
    het een en of niet wordt worden dan met zonder te om maar dat pas eerst anders steeds
    и в не на что пока затем только потом может быть лучше сначала с как когда всегда так она он
    """.split()
)
#: A link by its scheme or mark-up, or a bare host name of several parts with a hyphen.
_HOST = r"(?<![\w./@-])[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\.[A-Za-z]{2,}\b(?:/[^\s)\]>]*)?"
_LINK = re.compile(r"https?://|\bwww\.|<a\s|href=|" + _HOST)
_CODE = re.compile(
    r"[{}`$]|\w\(|\)\s*[:;]|==|=>|:=|\s=\s|->|\|\||&&|^\s*(?:def|class|return|import|from|if|else|elif|for|while|try|except|finally|function|export|const|let|var|param|select|where|join|left|group|order|insert|create|update|delete|with|end|begin)\b|\w\.\w+\.\w|^\s*import-",
    re.I,
)
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"\w+_\w+|[a-z]+[A-Z]\w*|[^\W\d]\w*\.[^\W\d]\w+")
_MARK = re.compile(r"^\s*</?\w+(?:\s[^>]*)?/?>\s*$")
_COMMENT = re.compile(r"^\s*(?:#+|//+|--+)\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_LIGHT = FUNCTION_WORDS.__contains__

TEXT, CODE, NOTE, LINKS, LIST = "text", "code", "note", "links", "list"


def _is_link(low: str) -> bool:
    return ("//" in low or "www." in low or "<a" in low or "href" in low or "-" in low and "." in low) and _LINK.search(low) is not None


def unit_kind(unit: str, low: str, words: list[str], light: int) -> str:
    """Kind of one unit, from its text, its lower case, the words of that and how many of them are function words."""
    if "keywords" in low and "name=" in low and "content=" in low:
        return LIST
    n = len(words)
    if _is_link(low):
        return TEXT if light * 4 >= n >= 8 else LINKS
    if unit.count("[") >= 3 and unit.count("] [") >= 2:
        return LIST
    if unit.count(" | ") >= 2 and "$" not in unit and "{" not in unit:
        return TEXT if light * 4 >= n >= 6 else LIST
    if unit.count(" #") >= 2:
        return LIST
    if light and light * 12 >= n >= 3:
        return TEXT
    if _COMMENT.match(unit):
        return NOTE if n <= 8 and "," not in unit else LIST
    if _CODE.search(unit) or 3 * len(_NAME.findall(unit)) >= n:
        return CODE
    if n >= 8 and len(set(words)) == n and unit.rstrip()[-1:] in ".!?。":
        return TEXT
    return LIST


def list_units(text: str) -> tuple[int, int, int]:
    """Words of the page, of its list units, and of its link units.

    A line is cut into sentences unless it is running text throughout, or a table, menu, tag or link line. Short
    comment lines are part of code where the page has as much code; else they are list units behind a comment sign.
    """
    total = listed = links = code = 0
    noted = 0
    for line in text.split("\n"):
        low = line.lower()
        words = _LETTERS.findall(low)
        n = len(words)
        if not n or n <= 2 and _MARK.match(line):
            continue
        light = sum(map(_LIGHT, words))
        if light * 6 >= n >= 5 and " | " not in line and " #" not in line and "keywords" not in low and not _is_link(low):
            total += n
            continue
        if n <= 8 or " | " in line or " #" in line or "keywords" in low or _is_link(low):
            parts = [(line, low, words, light)]
        else:
            parts = []
            for unit in _SENTENCE.split(line):
                own = _LETTERS.findall(unit.lower())
                parts.append((unit, unit.lower(), own, sum(map(_LIGHT, own))))
        for unit, of, own, heavy in parts:
            kind = unit_kind(unit, of, own, heavy)
            total += len(own)
            if kind in (LIST, LINKS):
                listed += len(own)
                links += len(own) * (kind == LINKS)
            elif kind == NOTE:
                noted += len(own)
            elif kind == CODE:
                code += len(own)
    return total, listed + (noted if noted > code else 0), links


#: Links with a scheme, words with what is joined to them, tags of mark-up, line ends with their marks, other marks.
_TOKEN = re.compile(r"https?://[^\s)\]>\"]+|\w+(?:[.\-/@]\w+)*\(?|;?[ \t]*\n[\s>*#/•·‣-]*|</?[A-Za-z][^<>\n]{0,300}>|[^\w\s]+")
_SITE = re.compile(r"(?:www\.\w.*|[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\.[A-Za-z]{2,}(?:/.*)?)")
_FIGURE = re.compile(r"v?\d[\d./-]*|(?=\w*\d)[^\W_]+")
_DOTTED = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)+(?:/.*)?")
_CODE_SIGNS = re.compile(r"[{}=$`+%&~\\]|->|::|.;")
TOPIC, LINK, NAME, FUNCTION, FIGURE = 1, 2, 3, 4, 5
IS_CODE, IS_END = 1, 2
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _token_class(token: str) -> tuple[int, int, int]:
    """Class of a word (0 for marks), the hash of a mark (0 for words), and whether a mark is of code or ends a cell."""
    first = token[0]
    if "\n" in token:
        return 0, 10, IS_END | (IS_CODE if first == ";" else 0)
    if token.startswith(("http:", "https:")):
        return LINK, 0, 0
    if first.isalnum() or first == "_":
        if token.lower() in FUNCTION_WORDS:
            return FUNCTION, 0, 0
        if token[-1] == "(" or "_" in token:
            return NAME, 0, 0
        if _SITE.fullmatch(token):
            return LINK, 0, 0
        if _FIGURE.fullmatch(token):
            return FIGURE, 0, 0
        if first.islower() and not token.islower() and token.isalpha() or _DOTTED.fullmatch(token):
            return NAME, 0, 0
        return TOPIC, 0, 0
    if first == "<" and token[-1] == ">" and len(token) > 2:
        return (LINK if token.startswith(("<a ", "<A ")) else 0), 0, 0
    marks = sum(ord(c) << (11 * k) for k, c in enumerate(token[:2]))
    return 0, marks, (IS_CODE if _CODE_SIGNS.search(token) else 0) | (IS_END if first in "|•·" else 0)


class Phrases:
    """Phrase shingles of texts, with remembered token classes and word hashes."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 4), dtype=np.int64)

    def _add(self, token: str) -> int:
        i = len(self.known)
        if i == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        word = int.from_bytes(blake2b(token.lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
        self.table[i] = (*_token_class(token), word)
        self.known[token] = i
        return i

    def of(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of five-word shingles of a text, the hashes of its distinct list phrases, and their places."""
        return self.both(text)[:3]

    def both(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the hash of the verbatim phrase at each place."""
        found = _TOKEN.findall(text)
        if len(self.known) > 300_000:
            self.known.clear()
        known, codes = self.known, []
        for t in found:
            c = known.get(t)
            codes.append(self._add(t) if c is None else c)
        empty = np.zeros(0, dtype=np.int64)
        table = self.table[np.array(codes, dtype=np.int64)]
        at = np.flatnonzero(table[:, 0])
        n = len(at) - SHINGLE + 1
        if n <= 0:
            return 0, empty, empty, empty
        word = table[at, 0]
        form = np.where(word == FIGURE, TOPIC, word)
        between = lambda v: np.diff(np.cumsum(v)[at], prepend=0)  # noqa: E731  of the marks before each word
        marks, code, ends = between(table[:, 1]), between(table[:, 2] & 1), np.minimum(1, between(table[:, 2] >> 1))
        span = lambda v, k: np.convolve(v, np.ones(k, dtype=np.int64), "valid")
        inner = lambda v: span(v[1:], SHINGLE - 1)
        function = span((word == FUNCTION).astype(np.int64), SHINGLE)
        listed = (span((word == NAME).astype(np.int64), SHINGLE) == 0) & (inner(code) == 0) & (span((word == FIGURE).astype(np.int64), SHINGLE) <= 3)
        listed &= (function == 0) | (function == 1) & (inner(ends) >= 2)
        x = np.zeros(n, dtype=np.uint64)
        for k, f in enumerate(_FACTORS):
            y = (form[k : k + n] + (0 if k == 0 else marks[k : k + n] << 3)).astype(np.uint64) * f
            x ^= (y ^ (y >> np.uint64(29))) * (f | np.uint64(1))
        hashes, places = np.unique(x[listed], return_counts=True)
        same, own = np.zeros(n, dtype=np.uint64), table[at, 3].view(np.uint64) if len(at) else empty.view(np.uint64)
        for k, f in enumerate(_FACTORS):
            same += own[k : k + n] * (f | np.uint64(1))
        same ^= same >> np.uint64(32)
        return n, (hashes ^ (hashes >> np.uint64(32))).view(np.int64), places, same.view(np.int64)


FEATURES = "doc_id long, host string, words long, list_words long, link_words long, phrases long, forms array<long>, places array<long>, " + ", ".join(f"{k} array<long>" for k in RANGES)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    phrases = Phrases()
    for b in batches:
        rows = []
        for doc_id, host, text in zip(b["doc_id"], b["host"], b["text"]):
            total, listed, links = list_units(text or "")
            n, forms, places, same = phrases.both(text or "")
            part = same >> (64 - RANGE_BITS) & (1 << RANGE_BITS) - 1
            rows.append((doc_id, host, total, listed, links, n, forms, places, *(same[part == k] for k in range(1 << RANGE_BITS))))
        yield pd.DataFrame(rows, columns=["doc_id", "host", "words", "list_words", "link_words", "phrases", "forms", "places", *RANGES])


def _verbatim(stage: Stage, found: DataFrame, name: str) -> DataFrame:
    """(row, n): places of each page whose verbatim phrase, of one hash range, at least HOSTS hosts carry.

    Phrases of several hosts are written first, so the places are shuffled once. They are joined by sorting at any size,
    so the cost grows evenly. Hosts, as phrases, are compared by 64-bit hashes.
    """
    mine = found.select("row", "site", F.explode(name).alias("form"))
    several = stage.put_each([lambda: mine.groupBy("form").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("form")], f"{name}-several")
    mine = mine.join(several.hint("merge"), "form").groupBy("form", "row", "site").agg(F.count(F.lit(1)).alias("n"))
    carried = mine.select("form", "site").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= HOSTS).select("form")
    return mine.join(carried, "form").groupBy("row").agg(F.sum("n").alias("n"))


def page_evidence(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, words, list_words, link_words, phrases, list_phrases, replicated, verbatim, junk), one row per document.

    words: of the page; list_words, link_words: in list and in link units; phrases: its five-word shingles, one for each
    place; list_phrases: those of them that are list phrases; replicated: list phrases whose form at least HOSTS hosts
    carry; verbatim: shingles of any kind whose very words at least HOSTS hosts carry. Null and empty texts have no words and are no junk; a null host counts as one host of its own; rows of a
    repeated doc_id are judged each for itself. Whole texts are read, once.
    """
    stage = Stage(spark, "junk")
    pages = documents.where("doc_id is not null").select("doc_id", F.coalesce(label("source"), F.lit("")).alias("host"), "text")
    # A written row number is stable, whatever is computed again.
    found = stage.put(spread(pages, "doc_id").mapInPandas(_features, FEATURES).withColumn("row", F.monotonically_increasing_id()).withColumn("site", F.xxhash64("host")), "features")
    carried = found.select("host", F.explode("forms").alias("form")).distinct().groupBy("form").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= HOSTS).select("form")
    mine = found.select("row", F.explode(F.arrays_zip("forms", "places")).alias("x")).select("row", F.col("x.forms").alias("form"), F.col("x.places").alias("n"))
    shared = mine.join(carried, "form").groupBy("row").agg(F.sum("n").alias("replicated"))
    verbatim = stage.put_each([partial(_verbatim, stage, found, k) for k in RANGES], "verbatim").groupBy("row").agg(F.sum("n").alias("verbatim"))
    own = F.aggregate("places", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = found.select("row", "doc_id", "words", "list_words", "link_words", "phrases", own.alias("list_phrases")).join(shared, "row", "left").join(verbatim, "row", "left").drop("row").na.fill(0, ["replicated", "verbatim"])
    of = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    share, same, density = of("replicated", "phrases"), of("verbatim", "phrases"), of("list_words", "words")
    stitched = (share > MOST) | (F.greatest(share, same) > PART) & (density > LISTED)
    return rows.withColumn("junk", (F.greatest("replicated", "verbatim") + SHINGLE - 1 >= LEAST_WORDS) & (F.col("list_words") >= LEAST_WORDS) & stitched)


def junk_pages(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id) of the junk pages."""
    return page_evidence(spark, documents).where("junk").select("doc_id").distinct()
