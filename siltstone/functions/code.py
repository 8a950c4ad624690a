"""Code structure signatures: Python through its syntax tree, other languages by masking tokens."""

from __future__ import annotations

import ast
import hashlib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that keep their meaning in a masked text.
KEYWORDS = frozenset(
    "if else for while return function async await class interface type const let var new true false null undefined select from where join insert into update delete create table begin commit rollback param foreach try catch finally throw raise def import with as and or not in".split()
)
#: Comments, which go first, also where a string holds their signs; and the parts of the text left.
_COMMENT = re.compile(r"/\*(?s:.*?)\*/"), re.compile(r"(?://|#|--)[^\n]*")
_SCANNER = re.compile(
    r"(?P<STR>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`(?:\\.|[^`\\])*`)|(?P<NUM>\b\d+(?:\.\d+)?\b)"
    r"|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>\d+(?:\.\d+)?|==={0,1}|!==|==|!=|<=|>=|=>|::|\$\d+|\S)"
)


def _shape(node: ast.AST) -> str:
    """A tree as text, with one mark for all names of a kind and one for all values of a type."""
    if isinstance(node, ast.Name):
        return f"name:{type(node.ctx).__name__}"
    if isinstance(node, ast.Constant):
        v = node.value
        return "text" if isinstance(v, str) else "number" if isinstance(v, (int, float, complex)) and not isinstance(v, bool) else repr(v)
    out = [type(node).__name__]
    for field, value in ast.iter_fields(node):
        if field in ("name", "arg") and isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.arg)):
            continue
        if isinstance(value, ast.AST):
            out.append(_shape(value))
        elif isinstance(value, list):
            out.append("[" + ",".join(_shape(x) if isinstance(x, ast.AST) else repr(x) for x in value) + "]")
        else:
            out.append(repr(value))
    return "(" + " ".join(out) + ")"


def signature(text: str, language: str) -> str:
    """Structure of a code text; empty for blank ones. Python that does not parse is masked like other languages."""
    if language == "python":
        try:
            return _shape(ast.parse(text)) if text.strip() else ""
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            pass
    bare = reduce(lambda t, comment: comment.sub(" ", t), _COMMENT, text)
    return " ".join(map(_masked, _SCANNER.finditer(bare)))


def _masked(m: re.Match) -> str:
    """What stands for one part of a text: one name for names and values, a keyword or sign as it is."""
    if m.lastgroup == "sign":
        return m[0]
    word = m[0].lower() if m.lastgroup == "name" else ""
    return word if word in KEYWORDS else "ID"


def _hashes(texts: pd.Series, languages: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256(s.encode()).hexdigest() if (s := signature(t, k)).strip() else "" for t, k in zip(texts, languages)], dtype=object)


def structure(text: Column, language: Column) -> Column:
    """SHA-256 of the signature, empty for texts without one."""
    return F.pandas_udf(_hashes, StringType())(text, language)
