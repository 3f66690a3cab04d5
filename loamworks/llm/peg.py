"""Packrat parsing of source files by parsing-expression grammars over tokens.

A grammar is a list of rules ``name <- expression`` with ordered choice ``/``, ``*``, ``+``, ``?``, ``&`` and ``!``. Terminals are
kinds of tokens (``ID``), literal tokens (``'if'``) and bracket groups (``(args)``, ``[index]``, ``{block}``): a group stands for a
pair of brackets whose whole inside is matched by the rule it names. ``<targs>`` stands for ``'<' targs '>'``; ``~`` before an
item forbids a line break before it. Rules may recur in any way but to their own left.

Each token is one character. Brackets are read bottom-up with one stack: the inside of an innermost pair, its *shape*, is
held against all rules that may stand between such brackets, and the pair becomes one character that says which of them
match. Inside a shape every rule is a function of the position whose results are kept in a table by rule and position, so
that parsing takes linear time. Two more tables keep results across positions and files: that of shapes, and that of
*units* (statements, members), which are found again by their own tokens and those looked at behind them.

A file is valid if the start rule consumes what remains to its end. If it doesn't, the furthest token that any rule looked at
in the innermost shape that no rule matches is the place of the failure.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import repeat

#: Results remembered per language, worker and table; a full table starts anew.
REMEMBERED = 200_000
#: Longest shape that is remembered whole; longer ones seldom recur.
SHAPE = 400
#: Recursion of rules inside one shape; these are plain Python calls, which take no C stack.
DEPTH = 200_000
#: Results by rule and position that one shape may hold at a time.
TABLE = 1 << 19
FIRST_CODE = 0x4E00
#: Codes of groups: 1,024 for each bracket, one bit per rule that may stand in it.
BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
CLOSE = {"(": ")", "[": "]", "{": "}"}
NEWLINE = "\n"
END = "\0"
ERROR = "\uf8ff"

_PEG = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<grp>\([a-z_]\w*\)|\[[a-z_]\w*\]|\{[a-z_]\w*\}|<[a-z_]\w*>)|(?P<kind>[A-Z][A-Z0-9_]*)|(?P<rule>[a-z_]\w*)|(?P<op>[/*+?&!()~]))")
_BRACKET = re.compile(r"[()\[\]{}]")
_LINES = re.compile("\n{2,}")

Node = tuple


class Grammar:
    """Rules of a language as functions of the position in a shape."""

    def __init__(self, text: str, skip_newlines: bool = False) -> None:
        self.codes: dict[str, str] = {}
        self.skip = skip_newlines
        lines = re.sub(r"\n\s+", " ", re.sub(r"#.*", "", text)).strip().split("\n")
        bodies = {k.strip(): v for k, v in (x.split("<-", 1) for x in lines if "<-" in x)}
        used: dict[str, set[str]] = {b: set() for b in BASE}
        for body in bodies.values():
            for m in _PEG.finditer(body):
                if m["grp"] and m["grp"][0] in BASE:
                    used[m["grp"][0]].add(m["grp"][1:-1])
                elif m["lit"]:
                    self.code(m["lit"][1:-1])
        self.bits = {b: sorted(x) for b, x in used.items()}
        if any(len(x) > 10 for x in self.bits.values()):
            raise ValueError("a kind of bracket may hold ten rules at most")
        self.rules: dict[str, Node] = {}
        for name, body in bodies.items():
            t = list(_PEG.finditer(body))
            node, at = self._choice(t, 0)
            if at != len(t):
                raise ValueError(f"rule {name} can't be read at {at}")
            self.rules[name] = node
        self.made: dict | None = None

    def code(self, token: str) -> str:
        return self.codes.setdefault(token, chr(FIRST_CODE + len(self.codes)))

    def _choice(self, t: list, at: int) -> tuple[Node, int]:
        options: list[Node] = []
        while True:
            parts = []
            while at < len(t) and t[at]["op"] not in ("/", ")"):
                part, at = self._item(t, at)
                parts.append(part)
            new = parts[0] if len(parts) == 1 else ("seq", parts)
            # Neighbouring options of one token each are one class of tokens.
            if options and new[0] == options[-1][0] == "tok" and new[2] == options[-1][2]:
                options[-1] = ("tok", options[-1][1] + new[1], new[2])
            else:
                options.append(new)
            if at < len(t) and t[at]["op"] == "/":
                at += 1
                continue
            return (options[0] if len(options) == 1 else ("alt", options)), at

    def _item(self, t: list, at: int) -> tuple[Node, int]:
        m, skip = t[at], self.skip
        if m["op"] in ("&", "!"):
            inner, at = self._item(t, at + 1)
            return ("and" if m["op"] == "&" else "not", inner), at
        if m["op"] == "~":
            skip, at = False, at + 1
            m = t[at]
        if m["op"] == "(":
            node, at = self._choice(t, at + 1)
            at += 1
        elif m["rule"]:
            node, at = ("rule", m["rule"]), at + 1
        elif m["grp"] and m["grp"][0] == "<":
            node, at = ("seq", [("tok", self.code("<"), skip), ("rule", m["grp"][1:-1]), ("tok", self.code(">"), self.skip)]), at + 1
        elif m["grp"]:
            b = m["grp"][0]
            node, at = ("grp", BASE[b] >> 10, 1 << self.bits[b].index(m["grp"][1:-1]), skip), at + 1
        elif m["kind"] == "NEWLINE":
            node, at = ("tok", NEWLINE, False), at + 1
        elif m["kind"] == "END":
            node, at = ("tok", END, skip), at + 1
        else:
            node, at = ("tok", self.code(m["kind"] or m["lit"][1:-1]), skip), at + 1
        if at < len(t) and t[at]["op"] in ("*", "+", "?"):
            node, at = ({"*": "star", "+": "plus", "?": "opt"}[t[at]["op"]], node), at + 1
        return node, at

    def _simple(self, node: Node, seen: frozenset = frozenset()) -> Node:
        """A rule that is no more than a class of tokens stands for that class."""
        if node[0] == "rule" and node[1] not in seen and node[1] in self.rules:
            inner = self._simple(self.rules[node[1]], seen | {node[1]})
            return inner if inner[0] == "tok" else node
        if node[0] == "alt":
            parts = [self._simple(x, seen) for x in node[1]]
            if all(p[0] == "tok" and p[2] == parts[0][2] for p in parts):
                return ("tok", "".join(p[1] for p in parts), parts[0][2])
        return node

    def functions(self) -> dict:
        """The compiled rules; ``begin`` sets the shape, ``r_<rule>`` parses at a position and gives the end or -1."""
        if self.made is None:
            self.lines: list[str] = ["S = ''", "F = 0", "M = {}", "def begin(s):", "    global S, F, M", "    S, F, M = s, 0, {}", "def far():", "    return F"]
            self.later: list[tuple[str, Node]] = []
            for i, (name, node) in enumerate(self.rules.items()):
                self._function(f"r_{name}", node, i)
            while self.later:
                self._function(*self.later.pop(), None)
            self.made = {}
            exec(compile("\n".join(self.lines), "<grammar>", "exec"), self.made)
            sys.setrecursionlimit(max(sys.getrecursionlimit(), DEPTH))
        return self.made

    def _function(self, name: str, node: Node, key: int | None) -> None:
        out = self.lines
        out += [f"def {name}(v0):", "    global F"]
        if key is not None:
            out += [f"    k = v0 << 9 | {key}", "    v = M.get(k)", "    if v is not None: return v"]
        out.append("    v = v0")
        self.names = 0
        self._emit(node, "v", "    ", 0)
        if key is not None:
            # A full table starts anew: that costs time at most, since results don't depend on it.
            out += [f"    if len(M) > {TABLE}: M.clear()", "    M[k] = v"]
        out.append("    return v")

    def _new(self) -> str:
        self.names += 1
        return f"w{self.names}"

    def _emit(self, node: Node, v: str, pad: str, depth: int) -> None:
        """Lines after which ``v`` is the end of the node's match at ``v``, or -1."""
        out, node = self.lines, self._simple(node)
        kind = node[0]
        if kind in ("seq", "alt", "star", "plus") and depth > 5:
            name = f"h_{len(self.lines)}_{len(self.later)}"
            self.later.append((name, node))
            out.append(f"{pad}{v} = {name}({v})")
        elif kind == "rule":
            if node[1] not in self.rules:
                raise ValueError(f"there is no rule {node[1]}")
            out.append(f"{pad}{v} = r_{node[1]}({v})")
        elif kind in ("tok", "grp"):
            if node[-1]:
                out.append(f"{pad}if S[{v}] == '\\n': {v} += 1")
            out.append(f"{pad}if {v} > F: F = {v}")
            if kind == "tok":
                test = f"S[{v}] == {node[1]!a}" if len(node[1]) == 1 else f"S[{v}] in {node[1]!a}"
                # The end is looked at but never consumed.
                step = v if node[1] == END else f"{v} + 1"
                out.append(f"{pad}{v} = {step} if {test} else -1")
            else:
                out.append(f"{pad}o = ord(S[{v}])")
                out.append(f"{pad}{v} = {v} + 1 if o >> 10 == {node[1]} and o & {node[2]} else -1")
        elif kind == "seq":
            out.append(f"{pad}while True:")
            for i, part in enumerate(node[1]):
                self._emit(part, v, pad + "    ", depth + 1)
                if i < len(node[1]) - 1:
                    out.append(f"{pad}    if {v} < 0: break")
            out.append(f"{pad}    break")
        elif kind == "alt":
            w = self._new()
            out += [f"{pad}{w} = {v}", f"{pad}while True:"]
            for i, part in enumerate(node[1]):
                if i:
                    out.append(f"{pad}    {v} = {w}")
                self._emit(part, v, pad + "    ", depth + 1)
                if i < len(node[1]) - 1:
                    out.append(f"{pad}    if {v} >= 0: break")
            out.append(f"{pad}    break")
        elif kind in ("star", "plus"):
            if kind == "plus":
                self._emit(node[1], v, pad, depth)
                out.append(f"{pad}if {v} >= 0:")
                pad += "    "
            w = self._new()
            out += [f"{pad}while True:", f"{pad}    {w} = {v}"]
            self._emit(node[1], w, pad + "    ", depth + 1)
            out += [f"{pad}    if {w} <= {v}: break", f"{pad}    {v} = {w}"]
        elif kind == "opt":
            w = self._new()
            out.append(f"{pad}{w} = {v}")
            self._emit(node[1], w, pad, depth)
            out.append(f"{pad}if {w} >= 0: {v} = {w}")
        else:
            w = self._new()
            out.append(f"{pad}{w} = {v}")
            self._emit(node[1], w, pad, depth)
            out.append(f"{pad}if {w} {'<' if kind == 'and' else '>='} 0: {v} = -1")

    def matches(self, rule: str, shape: str, again: bool = False) -> bool:
        """Does the rule consume the whole shape? ``again``: the shape is that of the last call, whose table is kept."""
        f = self.functions()
        if not again:
            f["begin"](shape + END + END)
        end = f["r_" + rule](0)
        if end >= 0 and self.skip and shape[end : end + 1] == NEWLINE:
            end += 1
        return end == len(shape)

    def furthest(self, rule: str, shape: str) -> int:
        """The furthest token that the rule looks at."""
        self.matches(rule, shape)
        return min(self.functions()["far"](), len(shape))


class Tokens(dict):
    """Code of each token; those not seen before are classified."""

    def __init__(self, classify: Callable[[str], str], fixed: dict[str, str]) -> None:
        super().__init__(fixed)
        self.classify, self.fixed = classify, fixed

    def __missing__(self, token: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.fixed)
        code = self.classify(token)
        if len(token) < 60:
            self[token] = code
        return code


class Units:
    """Ends of the units that a run consists of, remembered by their tokens."""

    def __init__(self, grammar: Grammar, rules: dict[str, str], stop: re.Pattern) -> None:
        self.g, self.rules, self.stop = grammar, rules, stop
        self.known: dict[str, tuple[str, int, str]] = {}
        self.far = 0

    def at(self, s: str, i: int) -> tuple[int, str]:
        """(end, kind) of the unit that begins at ``i`` of a shape with its end marks; end is -1 if there is none."""
        m = self.stop.search(s, i + 1)
        key = s[i : m.end() + 1 if m else len(s)]
        hit = self.known.get(key)
        if hit is None or not s.startswith(hit[0], i):
            f = self.g.functions()
            f["begin"](s)
            end, kind = -1, ""
            for k, rule in self.rules.items():
                end = f["r_" + rule](i)
                if end > i:
                    kind = k
                    break
            else:
                end = -1
            seen = s[i : max(f["far"](), end, i) + 1]
            hit = (seen, end - i if end > i else -1, kind)
            if len(seen) <= SHAPE:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[key] = hit
        self.far = max(self.far, i + len(hit[0]) - 1)
        return (i + hit[1] if hit[1] > 0 else -1), hit[2]

    def kinds(self, shape: str) -> str | None:
        """Kinds of the units that a shape consists of, or None."""
        s, at, n = shape + END + END, 0, len(shape)
        search, known, out = self.stop.search, self.known, []
        while at < n:
            m = search(s, at + 1)
            hit = known.get(s[at : m.end() + 1] if m else s[at:])
            if hit is not None and hit[1] > 0 and s.startswith(hit[0], at):
                out.append(hit[2])
                at += hit[1]
                continue
            end, kind = self.at(s, at)
            if end < 0:
                return "".join(out) if at == n - 1 and shape[at] == NEWLINE else None
            out.append(kind)
            at = end
        return "".join(out)

    def read(self, shape: str) -> tuple[str, list[int], int]:
        """(kinds, ends, place): the units one after the other; place is where they stop, the shape's length if at its end."""
        s, at, n = shape + END + END, 0, len(shape)
        kinds, ends = [], []
        while at < n:
            end, kind = self.at(s, at)
            if end < 0:
                if at == n - 1 and shape[at] == NEWLINE:
                    break
                return "".join(kinds), ends, at
            kinds.append(kind)
            ends.append(end)
            at = end
        return "".join(kinds), ends, n


class Parser:
    """A language: tokens by one expression, brackets by a stack, rules by shape."""

    #: Rules that are runs of units, and the form that the kinds of the units must have.
    runs: dict[str, re.Pattern] = {}
    unit_rules: dict[str, str] = {}
    #: Tokens at which a unit is likely to end.
    unit_stop: tuple[str, ...] = (";", NEWLINE)
    #: Tokens that count for nothing between brackets.
    dropped: re.Pattern | None = None

    def __init__(self, grammar: Grammar, tokens: str, classify: Callable[[str], str], start: str = "start", keywords: str = "") -> None:
        self.g, self.start = grammar, start
        # White space before a token is passed over with it.
        self.tokens = re.compile(rf"[ \t\f]*+({tokens})", re.S)
        for k in keywords.split():
            grammar.code(k)
        stops = "".join(grammar.codes.get(x, x) for x in self.unit_stop)
        self.units = Units(grammar, self.unit_rules, re.compile(f"[{re.escape(stops)}\ue800-\uebff]"))
        fixed = {k: v for k, v in grammar.codes.items() if not (k.isupper() and k.isidentifier())}
        fixed |= {c: c for c in "()[]{}"}
        self.table = Tokens(classify, fixed)
        self.memo: dict[str, str] = {}

    def matches(self, rule: str, shape: str) -> bool:
        if rule in self.runs:
            kinds = self.units.kinds(shape)
            return kinds is not None and self.runs[rule].match(kinds) is not None
        return self.g.matches(rule, shape)

    def bits(self, bracket: str, shape: str) -> int:
        """Which of the rules that may stand between such brackets match; those that aren't runs share one table."""
        bits, again, kinds = 0, False, ""
        for i, rule in enumerate(self.g.bits[bracket]):
            if rule not in self.runs:
                bits |= self.g.matches(rule, shape, again) << i
                again = True
        for i, rule in enumerate(self.g.bits[bracket]):
            if rule in self.runs and kinds is not None:
                kinds = kinds or self.units.kinds(shape)
                bits |= (kinds is not None and self.runs[rule].match(kinds) is not None) << i
        return bits

    def inside(self, shape: str) -> str:
        """What a shape is before it is held against rules."""
        if self.dropped:
            return self.dropped.sub("", shape)
        return _LINES.sub(NEWLINE, shape) if self.g.skip else shape

    def group(self, bracket: str, shape: str) -> str:
        key = bracket + shape
        code = self.memo.get(key)
        if code is None:
            shape = self.inside(shape)
            code = chr(BASE[bracket] + self.bits(bracket, shape))
            if len(shape) <= SHAPE:
                if len(self.memo) > REMEMBERED:
                    self.memo.clear()
                self.memo[key] = code
        return code

    def reduce(self, codes: str) -> str:
        """All bracket pairs as single characters; holds ``ERROR`` if brackets don't pair."""
        stack: list[tuple[str, list[str]]] = []
        now, at = [], 0
        for m in _BRACKET.finditer(codes):
            c, i = m[0], m.start()
            now.append(codes[at:i])
            at = i + 1
            if c in BASE:
                stack.append((c, now))
                now = []
            else:
                if not stack or CLOSE[stack[-1][0]] != c:
                    return ERROR
                b, before = stack.pop()
                before.append(self.group(b, "".join(now)))
                now = before
        return ERROR if stack else "".join(now) + codes[at:]

    def codes(self, text: str) -> str:
        return "".join(map(self.table.__getitem__, self.tokens.findall(text)))

    def accepts(self, codes: str) -> bool:
        return self.matches(self.start, codes if self.dropped else self.inside(codes))

    def valid(self, text: str) -> bool:
        codes = self.codes(text)
        if ERROR in codes:
            return False
        codes = self.reduce(codes)
        return ERROR not in codes and self.accepts(codes)

    # The slow way, for files that failed: where and why.
    def places(self, text: str) -> Iterator[tuple[str, int]]:
        """Codes of the tokens with their offsets."""
        for m in self.tokens.finditer(text):
            yield from zip(self.table[m[1]], repeat(m.start(1)))

    def failure(self, text: str) -> tuple[int, str]:
        """(offset, cause) of the furthest failure of a text that isn't valid."""
        stack: list[tuple[str, int, list]] = []
        now: list[tuple[str, int]] = []
        bad: tuple[int, str] | None = None
        for c, x in self.places(text):
            if c == ERROR:
                return (x, "token") if bad is None else bad
            if c in BASE:
                stack.append((c, x, now))
                now = []
            elif c in ")]}":
                if not stack or CLOSE[stack[-1][0]] != c:
                    return bad or (x, "bracket")
                b, start, before = stack.pop()
                code = self.group(b, "".join(v for v, _ in now))
                if ord(code) == BASE[b] and bad is None:
                    bad = self._furthest(now, self.g.bits[b], x), "inside of bracket"
                before.append((code, start))
                now = before
            else:
                now.append((c, x))
        if bad is None and stack:
            return len(text), "open bracket"
        return bad or self.top_failure(now, len(text))

    def top_failure(self, tokens: list[tuple[str, int]], end: int) -> tuple[int, str]:
        return self._furthest(tokens, [self.start], end), "statement"

    def _furthest(self, tokens: list[tuple[str, int]], rules: list[str], end: int) -> int:
        kept: list[tuple[str, int]] = []
        for c, x in tokens:
            if (self.dropped and self.dropped.match(c)) or (self.g.skip and c == NEWLINE and kept and kept[-1][0] == NEWLINE):
                continue
            kept.append((c, x))
        shape, low = "".join(c for c, _ in kept), 0
        for rule in rules:
            if rule in self.runs:
                self.units.far = 0
                kinds, ends, place = self.units.read(shape)
                if place < len(shape):
                    low = max(low, min(self.units.far, len(shape)))
                else:  # every unit is one, but they don't form statements
                    form = self.runs[rule]
                    n = max((i for i in range(len(kinds) + 1) if form.match(kinds[:i])), default=0)
                    low = max(low, ends[n - 1] if n else 0)
            else:
                low = max(low, self.g.furthest(rule, shape))
        while low < len(kept) and kept[low][0] == NEWLINE:
            low += 1
        return kept[low][1] if low < len(kept) else end
