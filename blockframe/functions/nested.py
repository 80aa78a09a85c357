"""Functions of nested values. A subscript text is compiled to a path; nothing is evaluated."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import PlanError
from ..plans.planner import function
from .aggregates import literal

_STEP = re.compile(r"""\[\s*(?:(-?\d+)|"([^"\]]*)"|'([^'\]]*)')\s*\]""")


def steps(text: str) -> list[int | str]:
    """Subscripts of a text such as ["a"][0]."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise PlanError(f"{text!r} is no sequence of subscripts")
        out.append(int(m[1]) if m[1] is not None else m[2] if m[2] is not None else m[3])
        at = m.end()
    if not out:
        raise PlanError("an empty subscript")
    return out


def from_json_text(v, path: list[int | str]):
    """The value at a path of a JSON text, in which Python's words for true, false and null may stand; null where there is none.
    A negative number counts from an array's end. A text may also have comments, unquoted keys and commas before a closing bracket, as JSON5 has."""
    text = v
    for python, js in (("True", "true"), ("False", "false"), ("None", "null")):
        text = F.regexp_replace(text, rf":\s*{python}\b", f": {js}")
    return F.coalesce(at_path(text, path), at_path(plain_json(text), path))


#: a text in quotes, or what stands outside of texts
_QUOTED = r"""("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')"""


def plain_json(text):
    """JSON of a text with comments, unquoted keys and trailing commas; what is in quotes is left alone."""
    text = F.regexp_replace(text, _QUOTED + r"|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/", "$1")
    text = F.regexp_replace(text, _QUOTED + r"|,(?=\s*+[}\]])", "$1")
    # texts get two marks, keys one on either side: two marks vanish, and one is a quotation mark
    text = F.regexp_replace(text, _QUOTED + r"|([\p{L}_$][\p{L}\p{N}_$]*+)(?=\s*+:)", "$1\u0001$2\u0001")
    return F.replace(F.replace(text, F.lit("\u0001\u0001"), F.lit("")), F.lit("\u0001"), F.lit('"'))


def at_path(text, path: list[int | str]):
    back = next((i for i, s in enumerate(path) if isinstance(s, int) and s < 0), len(path))
    where = "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path[:back])
    found = F.get_json_object(text, where) if back else text
    if back == len(path):
        return found
    place = F.json_array_length(found) + F.lit(path[back])
    one = F.when(place >= 0, F.call_function("get_json_object", found, F.concat(F.lit("$["), place.cast("string"), F.lit("]"))))
    return at_path(one, path[back + 1 :]) if back + 1 < len(path) else one


def element(v, kind: T.DataType, path: list[int | str]):
    for i, s in enumerate(path):
        if isinstance(kind, T.StringType):
            return from_json_text(v, path[i:])
        if isinstance(kind, T.StructType):
            if isinstance(s, int):
                s = kind.names[s]
            if s not in kind.names:
                return F.lit(None).cast("string")
            v, kind = v.getField(s), kind[s].dataType
        elif isinstance(kind, T.MapType):
            v, kind = F.try_element_at(v, F.lit(s).cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.ArrayType) and isinstance(s, int):
            v, kind = F.get(v, F.lit(s)) if s >= 0 else F.try_element_at(v, F.lit(s)), kind.elementType
        else:
            return F.lit(None).cast("string")
    return F.to_json(v) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else v.cast("string")


@function("JSON_GET", 2, pack="nested")
def json_get(p, table, tree):
    path = steps(str(literal(tree.args[1])))
    return p.mapped(table, tree, lambda v, k: from_json_text(v.cast("string"), path), T.StringType(), 0)


@function("DICT_GET", 2, pack="nested")
def dict_get(p, table, tree):
    path = steps(str(literal(tree.args[1])))
    return p.mapped(table, tree, lambda v, k: element(v, k, path), T.StringType(), 0)


@function("GET_JSON", 2, pack="nested")
def get_json(p, table, tree):
    path = steps(str(literal(tree.args[1])))
    return p.mapped(table, tree, lambda v, k: from_json_text(v.cast("string"), path).try_cast("int"), T.IntegerType(), -1)
