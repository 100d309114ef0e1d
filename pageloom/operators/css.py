"""CSS selectors compiled on the driver into Catalyst predicates.

A selector becomes a function ``(element, ancestors) -> Column`` where
``element`` is a struct column with ``tag, id_attr, classes, attrs`` and
``ancestors`` is the array of such structs from the root down to the parent
(the node table's ``anc``). Descendant combinators become nested ``exists``
over slices of ``anc``, the child combinator looks at its last entry, so
matching never needs a join.

Supported: type and ``*``, ``.class``, ``#id``, ``[attr]``,
``[attr=v]`` (quoted or bare) and ``~= ^= $= *= |=``, compounds, descendant
and ``>`` combinators, and comma groups.

Selectors that ask for siblings (``+``, ``~``, ``:first-child``,
``:nth-child(an+b)`` and their like, ``:empty``, ``:root``, ``:not()``,
``:is()``) parse too; only the page rows (``pagerow``), whose builder knows
every element's place among its siblings, can answer them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class SelectorError(ValueError):
    pass


@dataclass(frozen=True)
class AttrTest:
    name: str
    op: str | None = None
    value: str | None = None


@dataclass(frozen=True)
class Compound:
    tag: str | None = None
    ids: tuple = ()
    classes: tuple = ()
    attrs: tuple = ()
    pseudos: tuple = ()     # Pseudo


@dataclass(frozen=True)
class Pseudo:
    name: str
    step: int = 0           # a and b of an+b
    shift: int = 0
    inner: tuple = ()       # Compounds of :not() and :is()


@dataclass(frozen=True)
class Complex:
    parts: tuple            # Compound, left to right
    combinators: tuple      # one of ' ', '>', '+', '~' between parts


@dataclass(frozen=True)
class Selector:
    text: str
    alternatives: tuple = field(default_factory=tuple)


_NONASCII = "\\u00a0-\\uffff"
_IDENT = rf"-?(?:[_a-zA-Z{_NONASCII}]|\\.)(?:[-\w{_NONASCII}]|\\.)*"
_TOKEN = re.compile(
    rf"""
    (?P<ws>\s+)
  | (?P<comb>[>+~])
  | (?P<comma>,)
  | (?P<star>\*)
  | (?P<tag>{_IDENT})
  | \#(?P<id>(?:[-\w{_NONASCII}]|\\.)+)
  | \.(?P<cls>{_IDENT})
  | (?P<attr>\[\s*(?P<aname>{_IDENT})\s*(?:(?P<aop>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\])
  | ::?(?P<pseudo>[-a-zA-Z]+)(?:\((?P<pargs>[^()]*)\))?
  | (?P<bad>.)
    """,
    re.VERBOSE,
)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


# name -> the same test as an+b of another name, for the names without arguments
_FIXED_PLACE = {"first-child": ("nth-child", 1), "last-child": ("nth-last-child", 1),
                "first-of-type": ("nth-of-type", 1), "last-of-type": ("nth-last-of-type", 1)}
_PLACES = ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type")
_PLAIN = ("only-child", "only-of-type", "empty", "root")
_AN_B = re.compile(r"(?:(?P<a>[+-]?\d*)n)?\s*(?P<b>[+-]?\s*\d+)?$", re.IGNORECASE)


def _pseudo(name: str, args: str | None, selector: str) -> Pseudo:
    name = name.lower()
    if name in _FIXED_PLACE and args is None:
        return Pseudo(_FIXED_PLACE[name][0], 0, _FIXED_PLACE[name][1])
    if name in _PLAIN and args is None:
        return Pseudo(name)
    if name in _PLACES and args is not None:
        text = {"odd": "2n+1", "even": "2n"}.get(args.strip().lower(), args.strip())
        m = _AN_B.match(text)
        if text and m:
            a = m.group("a")
            step = 0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)
            return Pseudo(name, step, int((m.group("b") or "0").replace(" ", "")))
    if name in ("not", "is", "where", "matches") and args and args.strip():
        inner = parse(args)
        if all(len(cx.parts) == 1 for cx in inner.alternatives):
            return Pseudo("not" if name == "not" else "is", inner=tuple(cx.parts[0] for cx in inner.alternatives))
    raise SelectorError(f"unsupported pseudo-class :{name} in {selector!r}")


def asks_for_siblings(sel: Selector) -> bool:
    """Does the selector need more than an element and its ancestors?"""
    return any(set(cx.combinators) & {"+", "~"} or any(p.pseudos for p in cx.parts) for cx in sel.alternatives)


def parse(selector: str) -> Selector:
    """Parse a selector string; raises :class:`SelectorError` if invalid."""
    if selector is None or not selector.strip():
        raise SelectorError("empty selector")
    alts, parts, combs = [], [], []
    cur: dict | None = None
    pending = None

    def close_compound():
        nonlocal cur
        if cur is not None:
            parts.append(Compound(cur["tag"], tuple(cur["ids"]), tuple(cur["classes"]), tuple(cur["attrs"]),
                                  tuple(cur["pseudos"])))
            cur = None

    def start():
        nonlocal cur, pending
        if cur is None:
            if parts:
                combs.append(pending or " ")
            elif pending not in (None, " "):
                raise SelectorError(f"selector starts with a combinator: {selector!r}")
            pending = None
            cur = {"tag": None, "ids": [], "classes": [], "attrs": [], "pseudos": []}
        return cur

    def close_complex():
        nonlocal parts, combs, pending
        close_compound()
        if not parts or pending not in (None, " "):
            raise SelectorError(f"incomplete selector: {selector!r}")
        alts.append(Complex(tuple(parts), tuple(combs)))
        parts, combs, pending = [], [], None

    for m in _TOKEN.finditer(selector.strip()):
        kind = m.lastgroup
        if kind == "ws":
            close_compound()
            if parts and pending is None:
                pending = " "
        elif kind == "comb":
            close_compound()
            if not parts:
                raise SelectorError(f"selector starts with a combinator: {selector!r}")
            if pending not in (None, " "):
                raise SelectorError(f"double combinator in {selector!r}")
            pending = m.group("comb")
        elif kind == "comma":
            close_complex()
        elif kind in ("star", "tag"):
            c = start()
            if c["tag"] is not None or c["ids"] or c["classes"] or c["attrs"] or c["pseudos"]:
                raise SelectorError(f"type selector must come first: {selector!r}")
            c["tag"] = "*" if kind == "star" else _unescape(m.group("tag")).lower()
        elif kind == "id":
            start()["ids"].append(_unescape(m.group("id")))
        elif kind == "cls":
            start()["classes"].append(_unescape(m.group("cls")))
        elif kind == "attr":
            val = m.group("dq") if m.group("dq") is not None else (
                m.group("sq") if m.group("sq") is not None else m.group("bare"))
            start()["attrs"].append(AttrTest(m.group("aname").lower(), m.group("aop"), val))
        elif kind in ("pseudo", "pargs"):
            start()["pseudos"].append(_pseudo(m.group("pseudo"), m.group("pargs"), selector))
        else:
            raise SelectorError(f"unexpected {m.group(0)!r} in selector {selector!r}")
    close_complex()
    return Selector(selector, tuple(alts))


def _attr_test(el: Column, t: AttrTest) -> Column:
    v = el["attrs"][t.name]
    if t.op is None:
        return F.map_contains_key(el["attrs"], t.name)
    val = t.value
    if t.op == "=":
        return v == val
    if t.op == "~=":
        return F.array_contains(F.split(v, "\\s+"), val) if val and not re.search(r"\s", val) else F.lit(False)
    if t.op == "^=":
        return v.startswith(val) if val else F.lit(False)
    if t.op == "$=":
        return v.endswith(val) if val else F.lit(False)
    if t.op == "*=":
        return v.contains(val) if val else F.lit(False)
    if t.op == "|=":
        return (v == val) | v.startswith(val + "-")
    raise SelectorError(f"unknown attribute operator {t.op}")


def compound_match(el: Column, c: Compound) -> Column:
    cond = F.lit(True)
    if c.tag not in (None, "*"):
        cond = cond & (el["tag"] == c.tag)
    for i in c.ids:
        cond = cond & (el["id_attr"] == i)
    for k in c.classes:
        cond = cond & F.array_contains(el["classes"], k)
    for a in c.attrs:
        cond = cond & _attr_test(el, a)
    return F.coalesce(cond, F.lit(False))


def _complex_match(cx: Complex, i: int, el: Column, ancs: Column) -> Column:
    cond = compound_match(el, cx.parts[i])
    if i == 0:
        return cond
    comb = cx.combinators[i - 1]
    if comb == ">":
        parent = F.try_element_at(ancs, F.lit(-1))
        rest = F.slice(ancs, 1, F.greatest(F.size(ancs) - 1, F.lit(0)))
        return cond & (F.size(ancs) > 0) & _complex_match(cx, i - 1, parent, rest)
    if i == 1:
        return cond & F.exists(ancs, lambda a: compound_match(a, cx.parts[0]))
    flags = F.transform(ancs, lambda a, k: _complex_match(cx, i - 1, a, F.slice(ancs, 1, k)))
    return cond & F.exists(flags, lambda b: b)


def matches(sel: Selector | str, el: Column, ancs: Column) -> Column:
    """Column predicate: does ``el`` (with ancestors ``ancs``) match?"""
    if isinstance(sel, str):
        sel = parse(sel)
    if asks_for_siblings(sel):
        raise SelectorError(f"selectors on siblings need page rows: {sel.text!r}")
    out = None
    for cx in sel.alternatives:
        m = _complex_match(cx, len(cx.parts) - 1, el, ancs)
        out = m if out is None else (out | m)
    return out


def node_struct() -> Column:
    """The element view of a node row."""
    return F.struct("nid", "tag", "id_attr", "classes", "attrs")


def self_matches(sel: Selector | str) -> Column:
    """B7 on node rows: elements matching ``sel`` themselves."""
    return (F.col("kind") == "elem") & matches(sel, node_struct(), F.col("anc"))


def ancestor_match_nids(sel: Selector | str) -> Column:
    """nids of the ancestors (in ``anc``) that match ``sel``, outermost first."""
    anc = F.col("anc")
    flags = F.transform(anc, lambda a, k: F.when(matches(sel, a, F.slice(anc, 1, k)), a["nid"]))
    return F.filter(flags, lambda x: x.isNotNull())


def inside_match(sel: Selector | str) -> Column:
    """Node is a descendant of some element matching ``sel``."""
    return F.size(ancestor_match_nids(sel)) > 0


def selector_priority(sel) -> Column:
    """Contains '#' gives 3; else '.' or '[' gives 2; else 1."""
    s = F.col(sel) if isinstance(sel, str) else sel
    return F.when(s.contains("#"), 3).when(s.contains(".") | s.contains("["), 2).otherwise(1)
