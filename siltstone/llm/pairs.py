"""Defective prompt and response pairs, by tagging the clauses of a response with a conditional random field.

A response is cut into clauses: sentences, list items and blocks of code. Each gets binary features from its own words,
its place, and its overlap with the instruction and the given code; a chain model tags it as answer, refusal, echo,
foreign or unfinished. The words that each tag covers decide the defect of the pair. The model is trained on all
records: as they are, and with defects put in, so labels are known by construction. Records are labelled where they are
read; equal sequences of features and tags are folded to one with a weight, which leaves the likelihood as it is, so the
fit meets a small table whatever the number of records.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.crf import ChainCrf
from siltstone.plans.staging import Stage, spread

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Seed of the defects put into records for training.
SEED = 13
#: Clauses of a piece: a longer response serves for training in pieces, each given the tags beside it.
PIECE = 24
#: A sound response of up to so many clauses may also serve three times in a row, as a longer one.
TRIPLED = 8
#: Runs of three letters that a language must have to be known, the records that hold a known run (at least two, and one
#: of so many), and the share of unknown runs that is strange to it.
LEAST_GRAMS, RECORDS_A_GRAM, STRANGE = 1500, 240, 0.25
#: Shares of a response's words that a tag must cover.
ECHO_COVER, REFUSAL_COVER, FOREIGN_COVER = 0.8, 0.5, 0.5

#: Frequent words of each language, and its names in English.
LANGUAGES = {
    "en": "the a an of and or to in on at by for from with without is are was were be been has have had that this which it its as if when while because so but not no until after before since than every each all most can may must you we i",
    "de": "der die das den dem ein eine einer einen und oder ist nicht wird werden wenn dann mit ohne zu zur sonst sich so nur bleibt bei jede jeder jedes ob als auf von es ich kann bitte für",
    "fr": "le la les un une des du de et ou est pas ne que qui il elle sur dans pour avec sans ce cette doit être avant après quand si tant car puis en je on vous nous",
    "es": "el la los las un una de del y o no que se con por para como debe cuando si su hasta así siempre antes después cada basta pero es lo yo",
    "it": "il lo la le gli i un una di del della e che non se si con per quando finché da prima poi sempre va è ogni sono",
    "pt": "o os a as um uma de do da dos e não que se com por para quando enquanto antes depois fica sempre cada deve porque é eu",
    "nl": "de het een en of niet wordt worden als dan met zonder te om is maar dat die pas eerst anders bij steeds van moet elke geeft ik je",
    "ru": "и в не на что если пока затем только потом может быть лучше сначала с как когда всегда так она он то о я вы это",
}
NAMES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian"}
_FREQUENT = {k: frozenset(v.split()) for k, v in LANGUAGES.items()}
_NAMED = {v: k for k, v in NAMES.items()}
_LANGUAGES_OF = {w: tuple(k for k, v in _FREQUENT.items() if w in v) for w in frozenset().union(*_FREQUENT.values())}

#: What stands in for an answer.
STAND_INS = frozenset(
    "todo tbd tba fixme n/a na null nil none nan undefined placeholder answer (no answer) no answer no response (empty) empty (blank) blank (none) [answer] [todo] [empty] pending (pending) to be done to be added coming soon xxx".split()
) | {"no answer", "(no answer)", "no response", "to be done", "to be added", "coming soon", "no content", "not available", "answer pending", "see above", "your answer here", "insert answer here"}

#: Stand-ins that can also be the value asked for.
VALUES = frozenset(("null", "na", "nil", "none", "nan", "undefined", "empty", "blank", "todo", "pending"))

#: What cannot or will not be done. It counts where the one who answers is its subject, not the thing that is asked about.
_LIMITS = re.compile(
    r"\b(?:can(?:'t|not| not)|unable|(?:not|n't) able|won't|will not|declin\w*|refus\w*|rather not|not something|not permit\w*|(?:not|n't) allow\w*|outside (?:of )?what|beyond what|not comfortable|not in a position|no (?:way|ability|permission)|not possible|impossible|against my|inappropriate|(?:not|n't) have the (?:ability|means|permission|right)|(?:not|n't) (?:be )?(?:appropriate|right|proper) for)\b"
)
_SELF = re.compile(r"\b(?:i|i'm|i'd|i'll|i've|me|my|we|we're)\b|\blanguage model\b|\bas an ai\b|\bthis assistant\b")
_NO_SUBJECT = re.compile(r"^(?:(?:sorry|apologies|unfortunately|regrettably)\W+(?:but )?)?(?:cannot|can't|unable to|not able to|won't|will not)\b.*\b(?:help|assist|provide|answer|comply|do (?:that|this|it)|write|complete|support|request)\b")
_TASK = re.compile(r"\b(?:help|assist|provide|complete|answer|write|handle|fulfil+|comply|support|do that|do this|share|create|generate|discuss|request|respond|talk about|produce|make|carry out)\b")
_SORRY = re.compile(r"\b(?:sorry|unfortunately|regrettably|apologi[sz]e|apologies|regret|as an ai|language model|my guidelines|guidelines)\b")
_POLITE = re.compile(r"^(?:hello|hi|thank|thanks|great question|i understand|i hope|if you have other|please consult|perhaps a specialist|try asking|is there something else|let me know|feel free|good question|i appreciate)")
_ASKS_NO = re.compile(r"say no|turns? (?:this|it|that)? ?down|declin|refus|reject the request|politely|why (?:you|it) can(?:'t|not)|(?:reply|answer|response) (?:that )?(?:a|an|the) [\w ]{2,40}(?:gives?|sends?|writes?|returns?)|will not do")
_ASKS_NAMED = re.compile(rf"\b(?:in|into|speak|speaks|to|use) ({'|'.join(NAMES.values())})\b")
_ASKS_LANGUAGE = re.compile(r"\b(?:in|into|to|[Ss]peaks?|[Uu]se) [A-Z][a-z]+(?:ese|ish|ian|ch|ek|ic|man|an|ai|di|rew)\b|\b[Tt]ranslat")
_WORD, _LETTERS = re.compile(r"[a-z0-9]+"), re.compile(r"[^\W\d_]+")
_SQL = r"^\s*(?:SELECT|FROM|WHERE|HAVING|(?:LEFT |RIGHT |INNER |FULL |CROSS )?JOIN|GROUP BY|ORDER BY|INSERT INTO|UPDATE|DELETE FROM|CREATE|WITH|LIMIT|ON|AND)\b"
_CODE = re.compile(_SQL + r"|[{}]|\w\(|\)\s*:|==|=>|:=|\s=\s|^\s*(?:def|class|return|import|function|export|const|let|var|param|select|from|where|join|left|group by|order by|insert|create|update|delete|with|try|except|for|while|if)\b(?!.*[.!?]$)|^\s*(?://|#|--)\s|^\s*\$\w")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_NUMBER = re.compile(r"^\s*(\d+)[.)]\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"'“(]?\w)")
_COUNTS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}
_ANNOUNCED = re.compile(r"\b(one|two|three|four|five|six|seven|eight|nine|ten|\d{1,2})\s+(?:[\w-]+\s+){0,2}?(?:changes|steps|reasons|things|points|parts to|items|fixes|checks|options|cases|stages|ways|edits|rules)\b")
_LEADS = re.compile(r"(?::|\b(?:as follows|listed below|shown below|given below|the following)\.?)$")
_DANGLING = re.compile(r"(?:\b(?:on|and|or|join|where|by|from|select|as|is|in|not|like|between|having|set|values|into)|[=,(+\-*/<>|&.\[{:\\])\s*$", re.I)
#: Words that no sentence ends with, and words that make a phrase a sentence.
_NEEDS_MORE = frozenset("a an the of and or to with without from for by at as if when because so but than that which while until is are was were be been has have had its their his her our your my this these those each every between into onto per nor".split())
_SENTENCE_WORDS = re.compile(r"\b(?:is|are|was|were|be|been|has|have|had|will|would|can|could|must|should|may|might|does|do|did)\b")
_WRAPPER = re.compile(r"</?answer>|[​‌‍﻿]")


#: First letters of the writing systems told apart; Latin has all others.
_SCRIPTS = ((0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x2E80, "east asian"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "east asian"), (0xFB50, "arabic"), (0xFF00, "other"))
_STARTS = [k for k, _ in _SCRIPTS]
_ALPHABET = re.compile(r"[^\W\d_]")


def script_of(text: str) -> str | None:
    """The writing system of most letters of a text; None without letters."""
    if text.isascii():
        return "latin" if _ALPHABET.search(text) else None
    count: Counter = Counter()
    for c in _ALPHABET.findall(text):
        k = bisect_right(_STARTS, ord(c))
        count[_SCRIPTS[k - 1][1] if k else "latin"] += 1
    return count.most_common(1)[0][0] if count else None


@lru_cache(1 << 16)
def _grams_of_word(word: str) -> tuple[str, ...]:
    w = f" {word} "
    return tuple(w[i : i + 3] for i in range(len(w) - 2))


def letter_grams(text: str) -> list[str]:
    """Runs of three letters of the words of a text, word ends included."""
    return [g for x in _LETTERS.findall(text.lower()) for g in _grams_of_word(x)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str], n: int = 3) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def language_of(text: str) -> tuple[str | None, int]:
    """The likeliest language of a text and its number of letters-only words; None where little speaks for any."""
    return _language(_LETTERS.findall(text.lower()))[:2]


def _language(words: list[str]) -> tuple[str | None, int, float]:
    """The likeliest language of words, their number, and the share of frequent English ones among them."""
    if not words:
        return None, 0, 0.0
    hits = dict.fromkeys(_FREQUENT, 0)
    for w in words:
        for k in _LANGUAGES_OF.get(w, ()):
            hits[k] += 1
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    english = hits["en"] / len(words)
    native = 0 if best == "en" else sum(w in _FREQUENT["en"] and w not in _FREQUENT[best] for w in words)  # of words that both have, none counts
    if hits[best] < max(2, 0.12 * len(words)) or best != "en" and hits[best] < 2 * native:
        return ("en" if hits["en"] else None), len(words), english
    return best, len(words), english


def strange_share(text: str, known: frozenset) -> float:
    """Share of letter runs that the records' instructions and answers do not have."""
    grams = letter_grams(text)
    return sum(g not in known for g in grams) / len(grams) if grams else 0.0


class Clause:
    """A clause, and what is read from its text alone, once."""

    __slots__ = ("text", "code", "fenced", "closed", "words", "item", "number", "_grams", "_reading", "_announced", "_lines", "_open")

    def __init__(self, text: str, code: bool, fenced: bool = False, closed: bool = True):
        self.text, self.code, self.fenced, self.closed = text, code, fenced, closed
        self.words = words_of(text) if code or text.isascii() else _LETTERS.findall(text.lower())
        item = None if code else _ITEM.match(text)
        self.item, self.number = item is not None, int(m[1]) if item and (m := _NUMBER.match(text)) else None
        self._grams = self._reading = self._announced = self._lines = self._open = None

    @property
    def grams(self) -> set:
        if self._grams is None:
            self._grams = _grams(self.words)
        return self._grams

    @property
    def announced(self) -> int:
        """The count of things that prose announces; 0 for none."""
        if self._announced is None:
            found = _ANNOUNCED.search(self.text.lower())
            self._announced = (_COUNTS.get(found[1]) or int(found[1])) if found else 0
        return self._announced

    @property
    def lines(self) -> list[str]:
        """The words of each line that has any."""
        if self._lines is None:
            self._lines = [x for t in self.text.split("\n") if (x := " ".join(words_of(t)))]
        return self._lines

    @property
    def open(self) -> bool:
        """Whether a bracket stays open."""
        if self._open is None:
            self._open = _open_brackets(self.text)
        return self._open

    @property
    def reading(self) -> tuple:
        """Of prose: whether it refuses, refuses a task, is sorry, is polite; language, words, script, letters enough,
        share of frequent English words."""
        if self._reading is None:
            plain = self.text.strip().lower().replace("’", "'")
            refuses, sorry = bool(_SELF.search(plain) and _LIMITS.search(plain) or _NO_SUBJECT.search(plain)), bool(_SORRY.search(plain))
            task = refuses and (sorry or bool(_TASK.search(plain)))
            letters = _LETTERS.findall(self.text.lower())
            language, n, english = _language(letters)
            lettered = sum(map(len, letters)) >= 8
            self._reading = (refuses, task, sorry, bool(_POLITE.match(plain)), language, n, script_of(self.text), lettered, english)
        return self._reading


_kept_clause = lru_cache(4096)(Clause)


def _clause(text: str, code: bool, fenced: bool = False, closed: bool = True) -> Clause:
    """A clause, remembered if it is not long: spoiled records repeat most clauses of the sound ones."""
    return _kept_clause(text, code, fenced, closed) if len(text) <= 2000 else Clause(text, code, fenced, closed)


_kept_line = lru_cache(8192)(lambda line: _CODE.search(line) is not None)


def _is_code(line: str) -> bool:
    return _kept_line(line) if len(line) <= 1000 else _CODE.search(line) is not None


def clauses_of(answer: str | None) -> list[Clause]:
    """Sentences, list items and code blocks of a response; an unclosed fence runs to the end."""
    parts = _WRAPPER.sub("", answer or "").split("```")
    out: list[Clause] = []
    for k, part in enumerate(parts):
        if k % 2:
            head, _, body = part.partition("\n")
            text = body if re.fullmatch(r"\s*[\w+#-]*\s*", head) else part
            out.append(_clause(text, True, True, k < len(parts) - 1))
            continue
        code: list[str] = []

        def flush() -> None:
            if code:
                out.append(_clause("\n".join(code), True))
                code.clear()

        for line in part.split("\n"):
            if not line.strip():
                continue
            if _is_code(line) and not line.isupper() or code and (line[:1] in " \t" or re.match(_SQL, line)):
                code.append(line)
                continue
            flush()
            out.extend([_clause(line, False)] if _ITEM.match(line) else [_clause(s, False) for s in _SENTENCE.split(line.strip()) if s.strip()])
        flush()
    return [c for c in out if c.words or c.fenced and not c.closed]


def is_empty(answer: str | None, asked: frozenset | set = frozenset()) -> bool:
    """No content, or only a stand-in for it. A value such as `null` is content where the instruction's words name it."""
    text = _WRAPPER.sub("", answer or "")
    text = re.sub(r"```[\w+#-]*", "", text).strip().lower()
    bare = text.strip(" .!*_-")
    return not re.search(r"\w", text) or (bare in STAND_INS or text in STAND_INS) and not (bare in VALUES and bare in asked)


FEATURES = (
    "any", "code", "item", "prose", "first", "last", "only", "echo most", "echo much", "echo code", "refuses", "refuses a task", "sorry", "polite",
    "asks for no", "refuses as asked", "foreign", "native", "last open fence", "last open bracket", "last dangling code", "last cut prose",
    "last lead", "last short list", "last no return", "short",
)
_AT = {f: i for i, f in enumerate(FEATURES)}


class Prompt:
    """What a response is compared with. `known`: letter runs of the instructions' language, as the records have
    them; too few of them tell nothing."""

    def __init__(self, instruction: str | None, bad_code: str | None, known: frozenset = frozenset()):
        low = (instruction or "").lower()
        words = words_of(low)
        self.words, self.code_lines = set(words), {" ".join(words_of(x)) for x in (bad_code or "").split("\n")} - {""}
        self.grams, self.code_grams = _grams(words), _grams(words_of(bad_code))
        self.language, self.asks_no = language_of(low)[0], bool(_ASKS_NO.search(low))
        self.script, self.known = script_of(low), known if len(known) >= LEAST_GRAMS else frozenset()
        self.read: dict[Clause, int] = {}  # features of clauses met with this prompt
        self.any_asked = bool(_ASKS_LANGUAGE.search(instruction or ""))
        self.asked = {_NAMED[x] for x in _ASKS_NAMED.findall(low)}


def _missing_items(clauses: list[Clause]) -> bool:
    """A count of things is announced, and the numbered list that follows is shorter."""
    for i, c in enumerate(clauses):
        if c.code or c.number is not None or not c.announced:
            continue
        after = [x.number for x in clauses[i + 1 :] if x.number is not None]
        if after or _LEADS.search(c.text.rstrip().lower()) or c.text.rstrip().endswith("here."):
            return (max(after) if after else 0) < c.announced
    return False


def _open_brackets(text: str) -> bool:
    text = re.sub(r"'[^'\n]*'|\"[^\"\n]*\"", "", text)
    return any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}"))


def _ungrouped(code: str) -> bool:
    """A SELECT that lists plain columns beside an aggregate and has neither GROUP BY nor an end."""
    m = re.match(r"\s*select\s+(?:distinct\s+)?(.*?)\bfrom\b", code, re.I | re.S)
    if not m or code.rstrip().endswith(";") or re.search(r"\bgroup by\s+\S|\bover\s*\(", code, re.I):
        return False
    depth, items = 0, [""]
    for c in m[1]:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            items.append("")
        else:
            items[-1] += c
    whole = [bool(re.search(r"\b(?:count|sum|avg|min|max)\s*\(", x, re.I)) for x in items]
    return any(whole) and not all(whole)


def _unused(code: str) -> bool:
    """A function without an end of its own whose last assignment is never read, or that ends at the head of a block."""
    lines = [x.strip() for x in code.split("\n") if x.strip() and not x.strip().startswith("#")]
    if any(re.match(r"(?:return|raise|yield)\b", x) for x in lines):
        return not re.match(r"(?:return|raise|yield|pass)\b", lines[-1]) and bool(re.match(r"\w+\s*=[^=]", lines[-1]))
    names = [m[1] for x in lines if (m := re.match(r"(\w+)\s*=[^=]", x))]
    return lines[-1].endswith(":") or bool(names) and len(re.findall(rf"\b{names[-1]}\b", code)) == 1


def _stops_short(clause: Clause, end: str, others: list[Clause]) -> bool:
    """Prose without an end: it breaks off at a word that needs another, or without the full stop that the response's
    other sentences have. A lone phrase, a name, a link or a list item need no full stop."""
    if end.endswith("...") and clause.words:
        return True
    if re.search(r"[.!?…。)\]`\"'”:;>|]$", end) or re.match(r"\s*[-*•]", end):
        return False
    last = end.split()[-1] if end.split() else ""
    if "://" in last or re.fullmatch(r"[\w-]+(?:[./][\w-]+)+/?", last):
        return False
    if last.lower().rstrip(",") in _NEEDS_MORE or last.endswith((",", "-", "(")):
        return len(clause.words) > 1
    stopped = sum(x.text.rstrip().endswith((".", "!", "?", ":")) for x in others)
    return 2 * stopped > len(others) if others else len(clause.words) >= 6 and _SENTENCE_WORDS.search(end.lower()) is not None


_BIT = {f: 1 << i for f, i in _AT.items()}


def feature_array(masks: tuple[int, ...]) -> np.ndarray:
    """(clauses × FEATURES) of 0 and 1."""
    return (np.array(masks, dtype=np.int64).reshape(-1, 1) >> np.arange(len(FEATURES)) & 1).astype(float)


def features_of(clauses: list[Clause], prompt: Prompt) -> tuple[int, ...]:
    """The features of each clause, as the bits of a number."""
    if not clauses:
        return ()
    out = []
    for c in clauses:
        x = prompt.read.get(c)
        if x is None:
            x = prompt.read[c] = _own_features(c, prompt)
        out.append(x)
    out[0] |= _BIT["first"]
    if len(out) == 1:
        out[0] |= _BIT["only"]
    out[-1] |= _BIT["last"] | _last_marks(clauses[-1], clauses, _missing_items(clauses))
    return tuple(out)


def _own_features(c: Clause, prompt: Prompt) -> int:
    """Features that do not come from a clause's place."""
    on = _BIT
    x = on["any"] | on["code" if c.code else "item" if c.item else "prose"]
    if len(c.words) < 4:
        x |= on["short"]
    if prompt.asks_no:
        x |= on["asks for no"]
    own = c.grams
    share = len(own & prompt.grams) / len(own) if own else float(len(c.words) > 1 and set(c.words) <= prompt.words)
    if share >= 0.8:
        x |= on["echo most"]
    elif share >= 0.5:
        x |= on["echo much"]
    if c.code:
        if prompt.code_lines and c.lines:
            gram_share = len(own & prompt.code_grams) / len(own) if own else 0.0
            if gram_share >= 0.97 or sum(t in prompt.code_lines for t in c.lines) >= 0.95 * len(c.lines):
                x |= on["echo code"]
        return x
    refuses, task, sorry, polite, language, n, script, lettered, native = c.reading
    if refuses:
        # A no that was asked for is an answer, whatever the records have of such.
        x |= on["refuses as asked"] if prompt.asks_no else on["refuses"] | (on["refuses a task"] if task else 0)
    if sorry and not prompt.asks_no:
        x |= on["sorry"]
    if polite:
        x |= on["polite"]
    foreign = False
    if prompt.script and script and script != prompt.script and lettered:
        foreign = True
    elif language and prompt.language and n >= 4 and language != prompt.language:
        foreign = True
    elif prompt.known and n >= 5 and prompt.language == "en" and native < 0.1 and strange_share(c.text, prompt.known) > STRANGE:
        foreign = True
    if foreign and not (language in prompt.asked or prompt.any_asked):
        x |= on["foreign"]
    elif foreign or language and prompt.language and n >= 4:
        x |= on["native"]
    return x


def _last_marks(c: Clause, clauses: list[Clause], short_list: bool) -> int:
    """Features of the last clause: what shows that more had to follow."""
    end, names = c.text.rstrip(), []
    if c.fenced and not c.closed:
        names.append("last open fence")
    if c.open:
        names.append("last open bracket")
    if c.code and not c.fenced:
        lines = [t for t in end.split("\n") if t.strip()]
        final = lines[-1].strip() if lines else ""
        if _DANGLING.search(final) and not final.startswith(("//", "#", "--")) or _ungrouped(end):
            names.append("last dangling code")
        if re.match(r"\s*(?:async )?def ", end) and _unused(end):
            names.append("last no return")
    if not c.code:
        if _stops_short(c, end, [x for x in clauses[:-1] if not x.code]):
            names.append("last cut prose")
        if _LEADS.search(end.lower()):
            names.append("last lead")
    if short_list:
        names.append("last short list")
    return sum(_BIT[n] for n in names)


def reading_of(answer: str | None, clauses: list[Clause], prompt: Prompt) -> tuple[tuple[int, ...], list[int], list[bool]]:
    """Features, words and whether it only leads to what follows, of each clause; nothing for an empty answer."""
    if not clauses or is_empty(answer, prompt.words):
        return (), [], []
    leads = [not c.code and _LEADS.search(c.text.rstrip().lower()) is not None for c in clauses[:-1]]
    return features_of(clauses, prompt), [len(c.words) for c in clauses], [*leads, False]


def defect_of(masks: tuple[int, ...], words: list[int], leads: list[bool], model: PairModel) -> str | None:
    """The defect of a pair, from the words that each tag covers; None for a sound pair."""
    if not masks:
        return "empty"
    tags = model.tag(masks)
    cover, prose, led = Counter(), 0, 0
    for x, n, leading, t in zip(masks, words, leads, tags):
        cover[t] += max(1, n)
        prose += 0 if x & _BIT["code"] else max(1, n)
        led += n if leading and t != ECHO else 0
    total = sum(cover.values())
    if cover[ECHO] and cover[ECHO] >= ECHO_COVER * (total - led):  # a lead-in to what follows says nothing itself
        return "copied"
    if cover[REFUSAL] >= REFUSAL_COVER * total:
        return "refusal"
    if prose and cover[FOREIGN] >= FOREIGN_COVER * prose:
        return "wrong_language"
    return "truncated" if tags[-1] == UNFINISHED else None


#: Sentences from which defects are put into training records.
_OPENERS = ("", "", "Hello! ", "Thank you for asking. ", "I understand the question. ")
_NOES = (
    "I'm sorry, but I can't help with {}.", "I am unable to assist with {}.", "Unfortunately, I cannot provide {}.", "I must decline to answer {}.", "I won't be able to complete {}.",
    "My guidelines do not permit me to write {}.", "Regrettably there is no way for me to handle {}.", "As an AI, I cannot do that for {}.",
)
_CLOSERS = ("", "", " Please consult an expert.", " I hope you understand.", " Try asking something else.", " Let me know if you have other needs.")
_ABROAD = {
    "de": ("Der Wert wird zuerst geprüft und dann in der Datei gespeichert.", "Wenn die Eingabe leer ist, bleibt das Ergebnis ohne Änderung."),
    "fr": ("La fonction vérifie la valeur avant de continuer dans la boucle.", "Il faut enregistrer le résultat quand la liste est vide."),
    "es": ("La función debe revisar el valor antes de continuar con la lista.", "Cuando no hay datos, se devuelve un error y el programa para."),
    "it": ("La funzione controlla il valore prima di salvare la riga.", "Quando la lista è vuota non si cambia il risultato della prova."),
    "pt": ("A função deve ler o valor antes de gravar a linha.", "Quando não há dados, o programa devolve um erro e não continua."),
    "nl": ("De functie moet eerst de waarde lezen en dan de regel bewaren.", "Als het bestand leeg is, wordt er een fout gegeven."),
    "ru": ("Сначала нужно проверить значение, и только потом сохранить строку.", "Если файл пуст, то программа не меняет результат."),
}
_LEAD_INS = ("The steps are:", "Use this code:", "Here is the full version:", "The corrected part looks as follows.", "There are three clear reasons, listed below.", "It takes four steps to do this:")


@lru_cache(2048)
def _stock_clauses(text: str) -> list[Clause]:
    """Clauses of a text made of the fixed sentences only."""
    return clauses_of(text)


def _spoiled(row: tuple, prompt: Prompt, own: list[Clause], rng: random.Random) -> Iterator[tuple[list[Clause], int | list | None]]:
    """Clauses and the tag that replaces `answer`: of all clauses, or for UNFINISHED of the last; or a list."""
    instruction, answer, bad_code = row
    yield own, None
    if 0 < len(own) <= TRIPLED and rng.random() < 0.25:
        yield own * 3, None  # longer sound responses
    topic = " ".join((instruction or "it").split()[2:5]).strip(".,")
    yield clauses_of(rng.choice(_OPENERS) + rng.choice(_NOES).format(topic) + rng.choice(_CLOSERS)), REFUSAL
    copy = rng.choice((instruction, instruction, (instruction or "").upper(), (instruction or "").replace(".", ""), "Question: " + (instruction or "")))
    yield clauses_of(copy), ECHO
    if (bad_code or "").strip():
        yield clauses_of(rng.choice((bad_code, f"```\n{bad_code}\n```"))), ECHO
        led = clauses_of(f"Here is the result:\n\n```\n{bad_code}\n```")
        yield led, [ANSWER] + [ECHO] * (len(led) - 1)
    language = rng.choice(sorted(_ABROAD))
    if language not in prompt.asked:
        said = [_stock_clauses(" ".join(rng.choices(_ABROAD[language], k=rng.randint(1, 4)))) for _ in range(3)]
        yield said[0], FOREIGN
        code = [c for c in own if c.code and c.closed][:1] or [_clause("return value(1)", True, True)]
        yield said[1] + code, [FOREIGN] * len(said[1]) + [ANSWER] * len(code)
        yield said[1] + code + said[2], [FOREIGN] * len(said[1]) + [ANSWER] * len(code) + [FOREIGN] * len(said[2])
    text = answer or ""
    for _ in range(2):
        cut = text[: rng.randint(len(text) // 4, max(len(text) // 4, len(text) - 4))]
        while cut and (not cut[-1].isalnum() or cut[-2:-1] in ".\n"):
            cut = cut[:-1]
        if len(cut) > 30:
            yield clauses_of(cut), UNFINISHED
    n = rng.randint(2, 5)
    counts = rng.choice(("It takes {} steps to do this:", "There are {} reasons, listed below.", "Do these {} things:", "{} changes are needed here.")).format(rng.choice((n, list(_COUNTS)[n - 1])))
    for k, tag in ((n, None), (rng.randint(1, n - 1), UNFINISHED)):
        yield _stock_clauses("\n".join([counts, *(f"{i}. The first part of the value is checked and then kept." for i in range(1, k + 1))])), tag
    yield clauses_of(text.split("\n")[0].split(". ")[0].rstrip(".") + ". " + rng.choice(_LEAD_INS)), UNFINISHED


_LAST_MARKS = sum(b for f, b in _BIT.items() if f.startswith("last "))
_MARKS = _LAST_MARKS | sum(_BIT[f] for f in ("echo most", "echo code", "foreign", "refuses a task"))


@dataclass
class PairModel:
    """The chain model, and the letter runs of the language it was trained on."""

    chain: ChainCrf
    known: frozenset
    _tags: dict = field(default_factory=dict, repr=False)

    def tag(self, masks: tuple[int, ...]) -> list[int]:
        """The tags of a response's clauses. Short responses have few sequences of features, so theirs are remembered."""
        if len(masks) > PIECE:
            return self.chain.tag(feature_array(masks))
        got = self._tags.get(masks)
        if got is None:
            if len(self._tags) >= 50_000:
                self._tags.clear()
            got = self._tags[masks] = self.chain.tag(feature_array(masks))
        return got

    def defect(self, instruction: str | None, answer: str | None, bad_code: str | None) -> str | None:
        return defect_of(*reading_of(answer, clauses_of(answer), Prompt(instruction, bad_code, self.known)), self)


def gram_counts(rows: Iterator[tuple]) -> tuple[Counter, int]:
    """Records by the letter runs of their instructions and sound-looking answers, and all records."""
    seen, n = Counter(), 0
    for instruction, answer, _ in rows:
        own, n = language_of(instruction or "")[0], n + 1
        texts = [instruction or "", *[c.text for c in clauses_of(answer) if not c.code and language_of(c.text)[0] == own]]
        seen.update(set(chain.from_iterable(map(_grams_of_word, {w for t in texts for w in _LETTERS.findall(t.lower())}))))
    return seen, n


def least_records(n: int) -> int:
    """Records of n that must hold a letter run for it to be known."""
    return max(2, -(-n // RECORDS_A_GRAM))


def known_grams(rows: list[tuple]) -> frozenset:
    """Letter runs that enough records hold."""
    seen, n = gram_counts(rows)
    return frozenset(g for g, k in seen.items() if k >= least_records(n))


def labelled(rows: Iterator[tuple], seed: int, known: frozenset) -> Iterator[tuple[tuple[int, ...], list[int]]]:
    """Features and tags of the rows as they are and with defects put in; the text of a row decides which. Rows with
    marks of a defect do not serve as sound ones, nor cuts that leave no mark as cuts."""
    for row in rows:
        yield from _labelled(row, Prompt(row[0], row[2], known), clauses_of(row[1]), seed)


def _labelled(row: tuple, prompt: Prompt, own: list[Clause], seed: int) -> Iterator[tuple[tuple[int, ...], list[int]]]:
    for clauses, tag in _spoiled(row, prompt, own, random.Random(f"{seed} {row[0]} {row[1]}")):
        if not clauses:
            continue
        x = features_of(clauses, prompt)
        if tag is None and any(v & _MARKS for v in x) and not any(v & _BIT["refuses as asked"] for v in x):
            continue
        if tag == UNFINISHED and not x[-1] & _LAST_MARKS:
            continue
        y = tag if isinstance(tag, list) else [ANSWER] * len(clauses) if tag in (None, UNFINISHED) else [tag] * len(clauses)
        if tag == UNFINISHED:
            y[-1] = UNFINISHED
        yield x, y


def folded(pairs: Iterator[tuple[tuple[int, ...], list[int]]]) -> Counter:
    """Weights of distinct (features, tags, tag before, tag after): whole sequences, with -1 for no tag, or pieces."""
    out: Counter = Counter()
    for x, y in pairs:
        for i in range(0, len(x), PIECE):
            j = min(len(x), i + PIECE)
            out[x[i:j], tuple(y[i:j]), y[i - 1] if i else -1, y[j] if j < len(y) else -1] += 1
    return out


def fitted(weights: dict, known: frozenset) -> PairModel:
    """The model of folded sequences; their order does not count."""
    model, keys = ChainCrf(len(FEATURES), len(TAGS)), sorted(weights)
    if keys:
        x, y, before, after = zip(*keys)
        model.fit([feature_array(v) for v in x], y, weights=[weights[k] for k in keys], before=before, after=after)
    return PairModel(model, known)


def train(rows: list[tuple]) -> PairModel:
    """The model from (instruction, answer, bad_code) rows."""
    known = known_grams(rows)
    return fitted(folded(labelled(rows, SEED, known)), known)


READINGS = "id string, received_at timestamp, masks array<int>, words array<int>, leads array<boolean>, x array<int>, y array<int>, before int, after int, n long"


def train_on(spark: SparkSession, rows: DataFrame) -> tuple[PairModel, DataFrame]:
    """The model from all rows with an instruction and an answer, as `train` makes it, and the readings of all rows.

    Letter runs are counted, and answers read and labelled sequences folded, where the texts are; counts are added up by
    Spark. The readings are written, so that no text is read again to be tagged.
    """
    rows, stage = spread(rows, "id"), Stage(spark, "pairs")
    serves = lambda i, a: i is not None and a is not None

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, n = gram_counts((i, a, c) for i, a, c in zip(b["instruction"], b["answer"], b["bad_code"]) if serves(i, a))
            yield pd.DataFrame([("", n), *seen.items()], columns=["gram", "n"])

    counts = stage.put(rows.mapInPandas(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    n = sum(r["n"] for r in counts.where("gram = ''").collect())
    known = frozenset(r["gram"] for r in counts.where((F.col("gram") != "") & (F.col("n") >= least_records(n))).select("gram").collect())
    stage.drop("grams")
    shared, names = spark.sparkContext.broadcast(known), [x.split()[0] for x in READINGS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, weights = [], Counter()
            for key, at, *row in zip(*(b[c] for c in ("id", "received_at", "instruction", "answer", "bad_code"))):
                prompt, own = Prompt(row[0], row[2], shared.value), clauses_of(row[1])
                masks, words, leads = reading_of(row[1], own, prompt)
                out.append((key, at, list(masks), words, leads, None, None, None, None, None))
                if serves(*row[:2]):
                    weights.update(folded(_labelled(row, prompt, own, SEED)))
            out.extend((None, None, None, None, None, list(x), list(y), *ends, n) for (x, y, *ends), n in weights.items())
            frame = pd.DataFrame(out, columns=names).astype({"before": "Int32", "after": "Int32", "n": "Int64"})
            yield frame.assign(received_at=pd.to_datetime(frame["received_at"]))

    found, key = stage.put(rows.mapInPandas(read, READINGS), "readings"), ["x", "y", "before", "after"]
    weights = found.where("n is not null").groupBy(*key).agg(F.sum("n").alias("n")).collect()
    model = fitted({(tuple(r["x"]), tuple(r["y"]), r["before"], r["after"]): r["n"] for r in weights}, known)
    return model, found.where("n is null").select("id", "received_at", "masks", "words", "leads")


def heldout_scores(model: PairModel, rows: list[tuple], seed: int = 99) -> dict[str, tuple[float, float]]:
    """(recall, precision) of each tag over the clauses of rows that the model was not trained on, spoiled anew."""
    got: Counter = Counter()
    for x, y in labelled(rows, seed, model.known):
        got.update(zip(y, model.tag(x)))
    share = lambda k, side: got[k, k] / max(1, sum(n for pair, n in got.items() if pair[side] == k))
    return {TAGS[k]: (share(k, 0), share(k, 1)) for k in range(len(TAGS))}


def defective_pairs(spark: SparkSession, accepted: DataFrame) -> DataFrame:
    """(id, defect_type) of each id whose latest answer is defective: empty, copied, refusal, wrong_language, truncated.

    Null instructions and codes count as empty; a null or empty answer is `empty`; null ids are left out. Whole texts
    are read where they lie, and only (id, time, defect) is shuffled to find the latest row of an id. All rows
    with an instruction and an answer serve for training.
    """
    rows = accepted.where("id is not null").select("id", "received_at", "instruction", "answer", "bad_code")
    model, readings = train_on(spark, rows)
    model = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [defect_of(tuple(x.tolist()), w, v, model.value) for x, w, v in zip(b["masks"], b["words"], b["leads"])]
            yield pd.DataFrame({"id": b["id"], "received_at": b["received_at"], "defect_type": pd.Series(found, dtype=object, index=b.index)})

    tagged = readings.mapInPandas(run, "id string, received_at timestamp, defect_type string")
    last = tagged.groupBy("id").agg(F.max(F.struct("received_at", "defect_type")).alias("l"))
    return last.select("id", F.col("l.defect_type").alias("defect_type")).where("defect_type is not null")


def defect_counts(spark: SparkSession, accepted: DataFrame) -> DataFrame:
    """(defect_type, records)."""
    return defective_pairs(spark, accepted).groupBy("defect_type").agg(F.count(F.lit(1)).alias("records"))
