"""What the tree builder's pass does to one page's nodes: removals, link
unwrapping, selector bits and the intervals of text pieces.

A node is a list ``[parent, post, kind, tag, attrs, text]`` at its pre-order
number. Every step is one walk over the nodes; numbers, and with them places
among siblings, are renewed after each removal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import css

PARENT, POST, KIND, TAG, ATTRS, TEXT = range(6)
_STRINGS = ("text", "comment", "doctype", "pi")


@dataclass(frozen=True)
class TreeSpec:
    """How a page's tree is cleaned and which selectors mark its elements."""

    remove: tuple = ()              # tags that go with their subtrees
    unwrap: bool = False            # links become their text (B5)
    exclude: tuple = ()             # parsed selectors whose subtrees go, one after the other
    select: tuple = ()              # parsed selectors; selector i sets bit i
    image_alt: int | None = None    # images with an alt of so many characters count as text (C12)
    attributes: bool = False        # links, images and marked elements keep their attributes

    def __post_init__(self):
        if len(self.select) > 63:
            raise ValueError("a page answers at most 63 selectors at once")


def _rebuild(nodes: list[list], act) -> list[list]:
    """The tree after ``act(number, node)``: None keeps a node, "drop" removes its subtree,
    "lift" removes it and moves its children up, ("text", s) makes it a string."""
    out: list[list] = []
    open_: list[tuple[int, int]] = []           # (old end, new number) of the elements around the current node
    skip = -1
    for i, n in enumerate(nodes):
        if i <= skip:
            continue
        while open_ and open_[-1][0] < i:
            out[open_.pop()[1]][POST] = len(out) - 1
        do = act(i, n)
        if do == "drop":
            skip = n[POST]
            continue
        if do == "lift":
            continue
        k, parent = len(out), open_[-1][1] if open_ else -1
        if do is not None:
            skip = n[POST]
            out.append([parent, k, "text", None, None, do[1]])
            continue
        out.append([parent, k, *n[KIND:]])
        if n[KIND] == "elem":
            open_.append((n[POST], k))
    while open_:
        out[open_.pop()[1]][POST] = len(out) - 1
    return out


def leaves(nodes: list[list]) -> list[int]:
    """The string that each node's ``.string`` is: of a string itself, of an
    element that of its only child; -1 where there is none."""
    children, only, leaf = [0] * len(nodes), [0] * len(nodes), [-1] * len(nodes)
    for i, n in enumerate(nodes):
        if n[PARENT] >= 0:
            children[n[PARENT]] += 1
            only[n[PARENT]] = i
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][KIND] in _STRINGS:
            leaf[i] = i
        elif children[i] == 1:
            leaf[i] = leaf[only[i]]
    return leaf


def _unwrap(nodes: list[list]) -> list[list]:
    leaf = leaves(nodes)

    def act(i, n):
        if n[TAG] != "a":
            return None
        if leaf[i] < 0:
            return "lift"
        s = nodes[leaf[i]]
        return ("text", s[TEXT] if s[KIND] == "text" else "")

    return _rebuild(nodes, act)


def clean(nodes: list[list], spec: TreeSpec) -> list[list]:
    """B2 to B6, in the order of the request modes."""
    if spec.remove:
        gone = frozenset(spec.remove)
        nodes = _rebuild(nodes, lambda _, n: "drop" if n[TAG] in gone else None)
    if spec.unwrap:
        nodes = _unwrap(nodes)
    for sel in spec.exclude:
        hit = marks(nodes, (sel,))
        if any(hit):
            nodes = _rebuild(nodes, lambda i, _: "drop" if hit[i] else None)
    return nodes


# --- selectors ------------------------------------------------------------------

def _places(nodes: list[list]) -> tuple[list, list, list]:
    """(place, place from the end, both also among elements of the tag) of every
    element among its siblings, from 1; the element before it; whether it is empty."""
    seen: dict = {}
    ordinal, before, empty = [(0, 0)] * len(nodes), [-1] * len(nodes), [True] * len(nodes)
    for i, n in enumerate(nodes):
        if n[KIND] != "elem":
            if n[KIND] == "text" and n[PARENT] >= 0 and n[TEXT].strip():
                empty[n[PARENT]] = False
            continue
        if n[PARENT] >= 0:
            empty[n[PARENT]] = False
        count, types, last = seen.get(n[PARENT], (0, {}, -1))
        types[n[TAG]] = types.get(n[TAG], 0) + 1
        ordinal[i], before[i] = (count + 1, types[n[TAG]]), last
        seen[n[PARENT]] = (count + 1, types, i)
    place = [None] * len(nodes)
    for i, n in enumerate(nodes):
        if n[KIND] == "elem":
            count, types, _ = seen[n[PARENT]]
            a, b = ordinal[i]
            place[i] = (a, count - a + 1, b, types[n[TAG]] - b + 1)
    return place, before, empty


def _attr(attrs: dict, t: css.AttrTest) -> bool:
    v = attrs.get(t.name)
    if v is None or t.op is None:
        return v is not None
    w = t.value
    if t.op == "=":
        return v == w
    if t.op == "|=":
        return v == w or v.startswith(w + "-")
    if not w:
        return False
    if t.op == "~=":
        return not re.search(r"\s", w) and w in v.split()
    return v.startswith(w) if t.op == "^=" else v.endswith(w) if t.op == "$=" else w in v


def _nth(place: int, step: int, shift: int) -> bool:
    gap = place - shift
    return gap == 0 if step == 0 else gap % step == 0 and gap // step >= 0


_WHICH = {"nth-child": 0, "nth-last-child": 1, "nth-of-type": 2, "nth-last-of-type": 3}


def _fits(n: list, c: css.Compound, places, i: int) -> bool:
    if c.tag not in (None, "*") and n[TAG] != c.tag:
        return False
    attrs = n[ATTRS]
    if c.ids and any(attrs.get("id") != x for x in c.ids):
        return False
    if c.classes:
        own = attrs.get("class", "").split()
        if any(x not in own for x in c.classes):
            return False
    return all(_attr(attrs, t) for t in c.attrs) and all(_pseudo(n, p, places, i) for p in c.pseudos)


def _pseudo(n: list, p: css.Pseudo, places, i: int) -> bool:
    place, _, empty = places
    if p.name in _WHICH:
        return _nth(place[i][_WHICH[p.name]], p.step, p.shift)
    if p.name == "only-child":
        return place[i][:2] == (1, 1)
    if p.name == "only-of-type":
        return place[i][2:] == (1, 1)
    if p.name == "empty":
        return empty[i]
    if p.name == "root":
        return n[PARENT] < 0 and place[i][:2] == (1, 1)
    return any(_fits(n, c, places, i) for c in p.inner) == (p.name == "is")


def marks(nodes: list[list], selectors: tuple) -> list[int]:
    """For every node the bits of the selectors it matches. A selector is a row of states, one
    per compound; an element reaches a state where the compound fits and the state before holds
    for its parent, an ancestor or a sibling before it. States travel down and along in bit masks."""
    states = []                                  # (compound, combinator before it, selector it completes or None)
    for k, sel in enumerate(selectors):
        for cx in sel.alternatives:
            for j, c in enumerate(cx.parts):
                states.append((c, cx.combinators[j - 1] if j else "", k if j == len(cx.parts) - 1 else None))
    out = [0] * len(nodes)
    if not states:
        return out
    places = _places(nodes) if any(css.asks_for_siblings(s) for s in selectors) else (None, None, None)
    follow = places[1] is not None
    own, above, along = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n[KIND] != "elem":
            continue
        up = n[PARENT]
        parent = own[up] if up >= 0 else 0
        above[i] = parent | (above[up] if up >= 0 else 0)
        last = places[1][i] if follow else -1
        beside = own[last] if last >= 0 else 0
        along[i] = beside | (along[last] if last >= 0 else 0)
        here = {"": -1, ">": parent << 1, " ": above[i] << 1, "+": beside << 1, "~": along[i] << 1}
        got = 0
        for s, (c, combinator, done) in enumerate(states):
            if here[combinator] >> s & 1 and _fits(n, c, places, i):
                got |= 1 << s
                if done is not None:
                    out[i] |= 1 << done
        own[i] = got
    return out


# --- text pieces ----------------------------------------------------------------

def page_arrays(nodes: list[list], spec: TreeSpec) -> dict:
    """Columns of one page: per node (parent, post, tag, mask, first, cnt, leaf, attrs), the
    text pieces (s, glue) and the other strings (asides). ``first`` and ``cnt`` are the interval of
    pieces inside a node; ``leaf`` is the piece of its ``.string``, or -2 minus the number of an aside, or -1;
    ``glue`` is the innermost link that a piece shares with the piece before it (C13), or -1."""
    mask, leaf = marks(nodes, spec.select), leaves(nodes)
    piece_s, piece_glue, asides, at = [], [], [], [-1] * len(nodes)
    links: list[tuple[int, int]] = []            # (number, end) of the links around the current node
    before, begin, last = [0] * len(nodes), [0] * len(nodes), -1
    for i, n in enumerate(nodes):
        before[i] = begin[i] = len(piece_s)
        while links and links[-1][1] < i:
            links.pop()
        if n[KIND] == "elem":
            if n[TAG] == "a":
                links.append((i, n[POST]))
            s = ""
            if spec.image_alt is not None and n[TAG] == "img":
                alt = n[ATTRS].get("alt", "").strip()
                s = f"[Image: {alt}]" if len(alt) >= spec.image_alt else ""
        else:
            s = (n[TEXT] or "").strip()
        if not s:
            continue
        if n[KIND] in ("elem", "text"):
            at[i] = len(piece_s)
            piece_s.append(s)
            piece_glue.append(max((a for a, _ in links if a < last), default=-1))
            last = i
            begin[i] += n[KIND] == "elem"        # an image's own text is not inside it
        else:
            at[i] = -2 - len(asides)
            asides.append(s)
    before.append(len(piece_s))
    keep = spec.attributes
    return {
        "parent": [n[PARENT] for n in nodes], "post": [n[POST] for n in nodes], "tag": [n[TAG] for n in nodes], "mask": mask,
        "first": begin, "cnt": [before[n[POST] + 1] - begin[i] for i, n in enumerate(nodes)],
        "leaf": [at[x] if x >= 0 else -1 for x in leaf],
        "attrs": [list(n[ATTRS].items()) if keep and n[TAG] and (m or n[TAG] in ("a", "img")) else None
                  for n, m in zip(nodes, mask, strict=True)],
        "s": piece_s, "glue": piece_glue, "asides": asides}


def title_of(nodes: list[list]) -> str | None:
    """C4: the text of the first ``title``, as it stands."""
    i = next((i for i, n in enumerate(nodes) if n[TAG] == "title"), -1)
    return None if i < 0 else "".join(n[TEXT] for n in nodes[i: nodes[i][POST] + 1] if n[KIND] == "text")
