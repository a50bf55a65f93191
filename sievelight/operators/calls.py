"""Texts in the shape of tool calls, and the actions that they name.

A text that has a word of such a shape, by one pass of an automaton, is read by a function over Arrow batches: as JSON where it
parses, as fenced blocks, and as markup. Markup is taken apart into pieces; what stands in a tool's element counts as one
text in three ways, with its inner tags left out, as blanks, and replaced by the values of their content attributes, so
that a word that is split by tags, comments or entities is put together again.

Null and blank texts, and plain read-only calls, are none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions import analyzer_rules as A

from .prefilter import met

#: What any text with a detection has.
GATE = r"(?:tool|function|arguments|method|params|invoke|\"args\"|\\u00)"
_FOUND = T.ArrayType(T.StructType([T.StructField("match", T.StringType()), T.StructField("confidence", T.DoubleType())]))
_TOKEN = r"(?i)<!\[CDATA\[|<!--|<\?|<!|<(/?)([^\s<>/]+)(?=[\s/>])"
_ATTRIBUTE = r"""([^\s=]*)\s*=\s*(?:"([^"]*)"?|'([^']*)'?|(\S*))"""


@lru_cache(maxsize=None)
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern)


def _first(pattern: str, text: str) -> str | None:
    m = _re(pattern).search(text)
    return m[0] if m else None


def action(text: str) -> str | None:
    """The first action word, as written or with its parts apart."""
    for t in (text, _re(A.ACTION_BOUNDARY).sub(" ", text)):
        for p in (A.FINANCIAL_ACTION, A.DANGEROUS_COMMAND):
            if found := _first(p, t):
                return found
    return None


def _end_of_tag(text: str, start: int) -> int:
    """The place of the sign that ends a tag, outside of quotes; -1 if there is none."""
    quote = ""
    for m in _re("[\"'>]").finditer(text, start):
        if quote:
            quote = "" if m[0] == quote else quote
        elif m[0] == ">":
            return m.start()
        else:
            quote = m[0]
    return -1


def pieces(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): ``text``, ``open``, ``empty``, ``close`` with a tag's name and inside, ``cut`` for one without an end."""
    at = 0
    while m := _re(_TOKEN).search(text, at):
        yield "text", "", text[at : m.start()]
        sign = m[0].upper()
        if sign in ("<![CDATA[", "<!--", "<?"):
            close = {"<![CDATA[": "]]>", "<!--": "-->", "<?": "?>"}[sign]
            end = text.find(close, m.end())
            if sign == "<![CDATA[":
                yield "text", "", text[m.end() : end if end >= 0 else len(text)]
            at = end + len(close) if end >= 0 else len(text)
            continue
        end = _end_of_tag(text, m.end())
        if m[2] is None:
            at = end + 1 if end >= 0 else len(text)
            continue
        if end < 0:
            yield "cut", m[2].lower(), text[m.start() :]
            return
        inside = text[m.end() : end]
        yield ("close" if m[1] else "empty" if inside.endswith("/") else "open"), m[2].lower(), inside
        at = end + 1
    yield "text", "", text[at:]


def content_attributes(inside: str) -> str:
    """The values of a tag's attributes that hold content, one after the other."""
    return "".join(m[2] or m[3] or m[4] or "" for m in _re(_ATTRIBUTE).finditer(inside.removesuffix("/")) if m[1].strip("/").lower() in A.CONTENT_ATTRIBUTES)


def markup_action_of(text: str) -> str | None:
    """The first action within tool elements."""
    stack: list[str] = []
    ways: tuple[list[str], ...] = ([], [], [])  # inner tags left out, as blanks, as their content attributes
    whole = lambda: next((a for w in ways if (a := action(unescape("".join(w))))), None)
    for kind, name, content in pieces(text):
        inner, tool = bool(stack), bool({name.split(":")[0], name.split(":")[-1]} & set(A.TOOL_TAGS))
        if kind in ("text", "cut") and inner:
            for w in ways:
                w.append(content)
        if kind == "text":
            continue
        if kind == "cut":
            return whole() if inner else action(unescape(content)) if tool else None
        if inner:
            ways[1].append(" ")
        found = (action(name) if inner else None) or (action(unescape(content)) if inner or tool else None)
        if found:
            return found
        if (inner or tool) and kind != "close":
            values = content_attributes(content)
            if found := action(unescape(values)):
                return found
            ways[2].append(values)
            if kind == "open":
                stack.append(name)
        elif kind == "close" and inner and stack[-1] == name and not content.strip():
            stack.pop()
            if not stack:
                if found := whole():
                    return found
                for w in ways:
                    w.clear()
    return whole() if stack else None


def _parsed(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _has_tool_key(value: object) -> bool:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if any(k in A.TOOL_KEYS for k in v) or v.get("role") == "tool":
                return True
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return False


def shaped(text: str) -> bool:
    if _first(A.TOOL_SHAPE, text):
        return True
    ok, value = _parsed(text)
    return ok and _has_tool_key(value)


def named_action(value: object) -> str | None:
    """The action that a call's name names, in an object of a name and arguments."""
    for call in value if isinstance(value, list) else [value]:
        if isinstance(call, dict) and isinstance(call.get("name"), str) and ("args" in call or "arguments" in call):
            if found := action(call["name"]):
                return found
    return None


def only_reads(message: object) -> bool:
    """Whether a JSON-RPC message, or each one of a batch, can't change anything: no other keys than the protocol's, and a
    method of a namespace that reads, or an answer."""
    if isinstance(message, list):
        return bool(message) and all(map(only_reads, message))
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0":
        return False
    keys, method = set(message), message.get("method")
    if "method" not in keys:
        return keys <= set(A.RPC_RESPONSE) and bool(keys & {"result", "error"})
    if not keys <= set(A.RPC_REQUEST) or not isinstance(message.get("params", []), (list, dict)) or not isinstance(method, str) or "_" not in method:
        return False
    space, _, local = method.partition("_")
    return space.lower() in A.RPC_NAMESPACES and _first(A.RPC_CHANGING, local) is None


def _asks_balance(value: object) -> bool:
    try:
        address = value["tool_call"]["arguments"]["address"]
        return value == {"tool_call": {"function": "getBalance", "arguments": {"address": address}}} and re.fullmatch("0x[0-9a-fA-F]{40}", address) is not None
    except (KeyError, TypeError):
        return False


def detection_of(text: str) -> tuple[str, float] | None:
    ok, value = _parsed(text)
    named = markup_action_of(text) or (named_action(value) if ok else None)
    if named is None and not shaped(text) and not any(shaped(b) for b in _re(A.FENCED).findall(text)):
        return None
    money = _first(A.FINANCIAL_ACTION, text) or _first(A.FINANCIAL_ACTION, _re(A.ACTION_BOUNDARY).sub(" ", text))
    if named is None and money is None and ok and ((only_reads(value) and not _first(A.TOOL_SHAPE, text)) or _asks_balance(value)):
        return None
    found = named or money
    return (found, 0.88) if found else ("tool-shaped payload", 0.60)


def _telling(text: str | None) -> bool:
    return bool(text and text.strip()) and bool(met(text, (GATE,)))


def markup_action(text: str | Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: markup_action_of(t) if _telling(t) else None), T.StringType())(F.col(text) if isinstance(text, str) else text)


@F.pandas_udf(_FOUND)
def _hijack(s: pd.Series) -> pd.Series:
    found = [detection_of(x) if _telling(x) else None for x in s]
    return pd.Series([[] if f is None else [{"match": f[0], "confidence": f[1]}] for f in found], dtype=object)


def hijack(text: str | Column) -> Column:
    """Array of one (match, confidence) for a tool-shaped text: 0.88 with an action, else 0.60."""
    return _hijack(F.col(text) if isinstance(text, str) else text)
