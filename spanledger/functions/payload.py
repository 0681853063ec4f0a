"""Model response text and JSON recovery.

Shape handling that built-in JSON functions express stays in expressions. Text whose
JSON is wrapped in prose needs a scan for balanced fragments and goes to Python in
Arrow batches; rows that parse directly never do.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The thinking tag, block types that are not shown, and key parts that mark a secret.
THINKING = r"(?is)<think>.*?</think>"
HIDDEN_TYPES = {"thinking", "reasoning", "redacted_thinking"}
SENSITIVE_PARTS = ["secret", "token", "api_key", "apikey", "authorization", "password"]

_FENCES = re.compile(r"\A```[^\n]*(?:\n|\Z)|(?:\n|\A)[ \t]*```[ \t]*\Z")


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


#: Takes raw control characters inside strings, but no NaN or Infinity.
_DECODER = json.JSONDecoder(strict=False, parse_constant=_refuse)


def _decoded(text: str, at: int = 0, whole: bool = False):
    """The JSON value that starts at ``at``; None where there is none, where it is nested too deep, or where ``whole`` text is left over."""
    try:
        value, end = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None
    return None if whole and text[end:].strip() else value


#: A token of JSON, or one character that starts none.
_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\]|\\.)*")|([\[\]{}:,])|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)', re.DOTALL)
_BRACKET = re.compile(r"[\[{]")


def _walk(text: str, start: int, hidden: list[int]) -> tuple[dict[int, bool], int]:
    """Read one value from the bracket at ``start``: for each bracket met, whether its value was closed, and where reading stopped.

    A value that is not closed when reading stops cannot be closed in any other reading either. Brackets inside strings are added to ``hidden``.
    """
    closed: dict[int, bool] = {}
    stack: list[list] = []  # start, bracket, what may come next
    at = start
    while True:
        token = _TOKEN.match(text, at)
        if token is None:
            return closed, at
        mark, string = token.group(2), token.group(1)
        place = token.end() - 1 if mark else token.start(1) if string else at
        if mark in ("[", "{"):
            if stack and stack[-1][2] not in ("value", "first"):
                return closed, place
            stack.append([place, mark, "first"])
            closed[place] = False
        elif not stack:
            return closed, place
        else:
            top, wants = stack[-1], stack[-1][2]
            if mark in ("]", "}"):
                if (top[1] == "[") != (mark == "]") or wants not in ("first", "end"):
                    return closed, place
                closed[stack.pop()[0]] = True
                if not stack:
                    return closed, token.end()
                stack[-1][2] = "end"
            elif mark == ",":
                if wants != "end":
                    return closed, place
                top[2] = "value" if top[1] == "[" else "key"
            elif mark == ":":
                if wants != "colon":
                    return closed, place
                top[2] = "value"
            elif top[1] == "{" and wants in ("first", "key"):
                if not string:
                    return closed, place
                top[2] = "colon"
            elif wants in ("value", "first"):
                top[2] = "end"
            else:
                return closed, place
            if string:
                hidden += [m.start() for m in _BRACKET.finditer(text, token.start(1), token.end(1))]
        at = token.end()


def _embedded(text: str):
    """The first JSON value that starts at a bracket of the text, none if it is nested too deep. Brackets of a value that stays open are not read again."""
    known: dict[int, bool] = {}
    for bracket in _BRACKET.finditer(text):
        at = bracket.start()
        if at not in known:
            hidden: list[int] = []
            closed, _ = _walk(text, at, hidden)
            known |= closed
            for place in hidden:
                known.pop(place, None)
        if known[at]:
            try:
                return _DECODER.raw_decode(text, at)[0]
            except RecursionError:
                return None
            except ValueError:
                pass
    return None


def recover(text: str | None) -> str | None:
    """Canonical JSON found in model text, or null; also null where it is nested deeper than the decoder goes.

    The text without thinking is read as one value, then its fenced inside, then the first value that starts at a bracket. A text
    that starts like JSON but is damaged is not searched for pieces.
    """
    shown = re.sub(THINKING, "", text or "").strip()
    for body in (shown, _FENCES.sub("", shown).strip()):
        value = _decoded(body, whole=True)
        if value is None and not body.startswith(("{", "[")):
            value = _embedded(body)
        if value is not None:
            try:
                return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
            except RecursionError:
                return None
    return None


@F.pandas_udf(StringType())
def _recover_batch(texts: pd.Series) -> pd.Series:
    return texts.map(recover, na_action="ignore")


def recover_json(text: Column) -> Column:
    """JSON text of a model message; null when none can be recovered."""
    plain = F.try_parse_json(text)
    direct = plain.isNotNull() & text.rlike(r"^\s*[\[{]") & ~text.rlike(r"NaN|Infinity|[\x00-\x1F]")
    return F.when(direct, F.to_json(plain)).otherwise(_recover_batch(F.when(~F.coalesce(direct, F.lit(False)), text)))


def _shown(tree):
    """Visible strings of a content tree in reading order: a block's own text, or else what its content holds."""
    waiting = [tree]
    while waiting:
        match waiting.pop():
            case str() as text:
                yield text.strip()
            case list() as blocks:
                waiting += [block for block in reversed(blocks) if isinstance(block, (str, dict))]
            case {"type": kind} if str(kind or "").strip().lower() in HIDDEN_TYPES:
                pass
            case {"text": str(own)} if own.strip():
                yield own.strip()
            case {"content": str() | list() as inner}:
                waiting.append(inner)


# Where providers put the message, in the order in which the places count.
MESSAGE_PATHS = (("content",), ("output_text",), ("response",), ("text",), ("output",), ("choices", 0, "text"), ("choices", 0, "message", "content"))


def _at(value, path: tuple):
    for step in path:
        known = isinstance(value, list) and len(value) > step if isinstance(step, int) else isinstance(value, dict) and step in value
        if not known:
            return None
        value = value[step]
    return value


def message_text(body: str | None) -> str:
    """Visible text of a provider response in any of the common shapes."""
    value = _decoded(body or "", len(body or "") - len((body or "").lstrip()), whole=True)
    places = (_at(value, path) for path in MESSAGE_PATHS)
    texts = ("\n".join(filter(None, _shown(place))) for place in places if isinstance(place, (str, list)))
    return next(filter(None, texts), "")


@F.pandas_udf(StringType())
def _message_batch(bodies: pd.Series) -> pd.Series:
    return bodies.map(message_text, na_action="ignore")


def response_text(body: Column) -> Column:
    """Message text: the plain chat shape by path, other shapes in Arrow batches."""
    simple = F.get_json_object(body, "$.choices[0].message.content")
    other = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ("content", "output_text", "response", "text", "output")],
                       F.get_json_object(body, "$.choices[0].text"))
    plain = F.coalesce(other.isNull() & simple.isNotNull() & ~F.ltrim(simple).rlike(r"^[\[{]"), F.lit(False))
    return F.when(plain, F.trim(simple)).otherwise(_message_batch(F.when(~plain, body)))


def unwrap_envelope(body: Column) -> Column:
    """Inner value of a one-key result / data / response wrapper."""
    keys = F.json_object_keys(body)
    inner = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ("result", "data", "response")])
    return F.when((F.size(keys) == 1) & inner.rlike(r"^\s*[\[{]"), inner).otherwise(body)


# Fields that the result schema no longer has.
RETIRED_FIELDS = (
    "sections", "quality_flags", "uncertainties", "uncertainty_policy", "key_points", "retrieval_text", "retrieval_hash",
)


def _without(text: str | None, names: frozenset[str]) -> str | None:
    try:
        value = json.loads(text, object_pairs_hook=lambda pairs: {k: v for k, v in pairs if k not in names}) if text else None
        return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def drop_fields(body: Column, names: tuple[str, ...] = RETIRED_FIELDS) -> Column:
    """JSON text without the named fields, whatever object at whatever depth holds them; null for text that is no JSON or nested too deep.

    Objects are filtered while they are read, from the innermost outwards. Text that names none of the fields is only parsed and
    printed again by the JVM.
    """
    gone = frozenset(names)

    @F.pandas_udf(StringType())
    def filtered(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _without(t, gone), na_action="ignore")

    named = F.coalesce(body.rlike('"(?:' + "|".join(re.escape(n) for n in names) + r')"|\\u'), F.lit(False))
    return F.when(named, filtered(F.when(named, body))).otherwise(F.to_json(F.try_parse_json(F.when(~named, body))))


def has_sensitive_key(body: Column) -> Column:
    """Whether any key of the JSON text, at any depth, names a secret."""
    parts = "|".join(p.replace("_", "[-_]") for p in SENSITIVE_PARTS)
    return body.rlike(rf'(?i)"(?:[^"\\]|\\.)*(?:{parts})(?:[^"\\]|\\.)*"\s*:')
