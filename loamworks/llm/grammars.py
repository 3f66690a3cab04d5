"""Grammars and tokens of the languages that are checked: JSON, Python 3, JavaScript (script), TypeScript, Go and Java."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from .peg import BASE, END, ERROR, NEWLINE, REMEMBERED, Grammar, Parser

_CJK_FREE_ID = r"[^\W\d]\w*"
#: A byte order mark at the beginning counts for nothing, but in JSON, which allows none.
MARK = "\ufeff"

# ---------------------------------------------------------------------------------------------------------------- JSON

JSON = """
start <- value
value <- STR / NUM / 'true' / 'false' / 'null' / {members} / [elements]
members <- (pair (',' pair)*)?
pair <- STR ':' value
elements <- (value (',' value)*)?
"""
_JSON_TOKENS = (r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[A-Za-z_]\w*|[{}\[\]:,]|[^ \t\r\n]')


def json_parser() -> Parser:
    g = Grammar(JSON)
    string, number = g.code("STR"), g.code("NUM")

    def classify(token: str) -> str:
        if token[0] == '"' and len(token) > 1:
            return string
        return number if token[-1] in "0123456789" and token[0] in "-0123456789" else ERROR

    return Parser(g, _JSON_TOKENS, classify)


# -------------------------------------------------------------------------------------------------------------- Python

PYTHON = """
start <- simple (';' simple)* ';'?
simple <- assign / exprs / yieldexpr / 'return' exprs? / 'pass' / 'break' / 'continue' / importing / 'raise' (expr ('from' expr)?)? / 'assert' expr (',' expr)? / ('global' / 'nonlocal') name (',' name)* / 'del' target (',' target)* ','? / 'type' name [typarams]? '=' expr
assign <- target ':' expr ('=' rhs)? / augtarget augop rhs / (targets '=' !'=')+ rhs
augop <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
rhs <- yieldexpr / exprs
yieldexpr <- 'yield' ('from' expr / exprs)?
target <- (name / (paren) / [list]) ((args)* ('.' name / [index]))*
augtarget <- (name / (single)) ((args)* ('.' name / [index]))* / [list] ((args)* ('.' name / [index]))+
single <- primary
targets <- '*'? target (',' '*'? target)* ','?
importing <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' (('.' / '...')+ dotted? / dotted) 'import' ('*' / (imported) / oneimport (',' oneimport)*)
imported <- oneimport (',' oneimport)* ','?
oneimport <- name ('as' name)?
dotted <- name ('.' name)*
name <- ID / 'match' / 'case' / 'type'
exprs <- starexpr (',' starexpr)* ','?
starexpr <- '*' disj / expr
named <- name ':=' expr / expr
starnamed <- '*' disj / named
expr <- 'lambda' (lparam (',' lparam)* ','?)? ':' expr / disj ('if' disj 'else' expr)?
lparam <- '**' name / '*' name? / '/' / name ('=' expr)?
disj <- unit (op unit)*
unit <- ('not' / '-' / '+' / '~' / 'await')* primary
op <- 'or' / 'and' / '==' / '!=' / '<=' / '>=' / '<' / '>' / 'not' 'in' / 'in' / 'is' 'not'? / '**' / '*' / '//' / '/' / '%' / '@' / '+' / '-' / '<<' / '>>' / '&' / '|' / '^'
primary <- atom ('.' name / (args) / [index])*
atom <- name / NUM / STR+ / BYTES+ / '...' / 'None' / 'True' / 'False' / (paren) / [list] / {braces}
paren <- (yieldexpr / named compfor / starnamed (',' starnamed)* ','?)?
list <- (named compfor / starnamed (',' starnamed)* ','?)?
braces <- ('**' disj / expr ':' expr) (',' ('**' disj / expr ':' expr))* ','? / expr ':' expr compfor / named compfor / (starnamed (',' starnamed)* ','?)?
compfor <- ('async'? 'for' fortargets 'in' disj ('if' disj)*)+
fortargets <- '*'? primary (',' '*'? primary)* ','?
args <- posarg compfor / (posarg (',' posarg)* (',' kwarg)* (',' kwlast)* ','? / kwarg (',' kwarg)* (',' kwlast)* ','? / kwlast (',' kwlast)* ','?)?
posarg <- '*' expr / name ':=' expr / !(name '=' !'=') expr
kwarg <- name '=' expr / '*' expr
kwlast <- name '=' expr / '**' expr
index <- slice (',' slice)* ','?
slice <- '*' disj / expr? ':' expr? (':' expr?)? / named
params <- (!'/' (pn (',' pn)* (',' pd)* / pd (',' pd)*) (',' star)? ','? / star ','?)?
pn <- '/' / name ann? !'='
pd <- '/' / name ann? '=' expr
star <- '*' (name (':' starexpr)? / &(',' name)) (',' name ann? ('=' expr)?)* (',' '**' name ann?)? / '**' name ann?
ann <- ':' expr
typarams <- typaram (',' typaram)* ','?
typaram <- ('*' / '**')? name ann? ('=' expr)?
withitems <- withitem (',' withitem)* ','?
withitem <- expr ('as' primary)?
h_if <- 'if' named ':'
h_elif <- 'elif' named ':'
h_else <- 'else' ':'
h_while <- 'while' named ':'
h_for <- 'async'? 'for' fortargets 'in' exprs ':'
h_try <- 'try' ':'
h_except <- 'except' (expr ('as' name)?)? ':'
h_group <- 'except' '*' expr ('as' name)? ':'
h_finally <- 'finally' ':'
h_with <- 'async'? 'with' ((withitems) ':' / withitem (',' withitem)* ':')
h_def <- 'async'? 'def' name [typarams]? (params) ('->' expr)? ':' / 'class' name [typarams]? (args)? ':'
h_decorator <- '@' named
h_match <- 'match' exprs ':'
h_case <- 'case' pattern (',' pattern)* ','? ('if' named)? ':'
pattern <- ('*' name / '-'? patom) (('|' / '+' / '-') '-'? patom)* ('as' name)?
patom <- primary / (patterns) / [patterns]
patterns <- (pattern (',' pattern)* ','?)?
field <- yieldexpr '='? / exprs '='?
"""
#: The second level: lines by what they are, and suites as groups.
PYTHON_SUITES = """
start <- statement*
suite <- statement+
statement <- 's' / 'f' body ('e' body)* ('l' body)? / ('w' / 'r') body ('l' body)? / 't' body (('x' body)+ / ('X' body)+) ('l' body)? ('y' body)? / 't' body 'y' body / 'W' body / '@'* 'd' body / 'm' {cases}
cases <- ('c' body)+
body <- {suite} / 'B'
"""
_PY_KINDS = {"h_if": "f", "h_elif": "e", "h_else": "l", "h_while": "w", "h_for": "r", "h_try": "t", "h_except": "x", "h_group": "X", "h_finally": "y", "h_with": "W", "h_def": "d", "h_decorator": "@", "h_match": "m", "h_case": "c"}
_PY_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_PY_PREFIX = r"(?:[rR][bBfF]|[bBfF][rR]|[rRbBuUfF])?"
_PY_TOKENS = (
    r"(?:(?:\r\n|\n|\r)[ \t\f]*(?:\#[^\r\n]*)?)+"
    r"|[fF][rR]?\"(?!\"\")(?:[^\"\\\r\n{}]|\\.|\{\{|\}\}|\{[^{}\r\n]*\})*\"|[fF][rR]?'(?!'')(?:[^'\\\r\n{}]|\\.|\{\{|\}\}|\{[^{}\r\n]*\})*'"
    rf"|{_PY_PREFIX}(?:\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*'|\"\"(?!\")|''(?!'))"
    rf"|{_CJK_FREE_ID}"
    r"|0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?|[0-9](?:_?[0-9])*\.?(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
    r"|\#[^\r\n]*|\\(?:\r\n|\n)|\*\*=?|//=?|>>=?|<<=?|->|:=|\.\.\.|[!=<>]=|[-+*/%@&|^]=?|[<>~.,:;=(){}\[\]]|[^ \t\f]"
)
#: Indents are codes of a plane of their own, each standing for the white space as written.
_PY_INDENT, _PY_INDENTS = 0xF0000, 0x1FFFE
_PY_LINE = re.compile(f"[{chr(_PY_INDENT)}-{chr(_PY_INDENT + _PY_INDENTS - 1)}]")
_PY_FIELD_END = re.compile(r"[()\[\]{}\"'!:=]")


class PythonParser(Parser):
    """Lines are parsed by their shapes, suites by the kinds of their lines."""

    dropped = _PY_LINE

    def __init__(self) -> None:
        g = Grammar(PYTHON)
        string, octets, number, name = g.code("STR"), g.code("BYTES"), g.code("NUM"), g.code("ID")
        zeros = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")
        self.widths: list[tuple[int, int]] = []
        self.indents: dict[str, str] = {}

        def classify(token: str) -> str:
            c = token[0]
            if c in "\r\n":
                return self.indent(re.split(r"[\r\n]", token)[-1])
            if c in "#\\":
                return "" if len(token) > 1 or c == "#" else ERROR
            if token[-1] in "\"'" and len(token) > 1:
                prefix = token[: re.search("[\"']", token).start()].lower()
                if "b" in prefix:
                    return octets if token.isascii() else ERROR
                return string if "f" not in prefix or self.fields(token, "r" in prefix) else ERROR
            if c.isdigit() or (c == "." and len(token) > 1):
                return ERROR if zeros.match(token) or not c.isascii() else number
            return name if token.isidentifier() else ERROR

        super().__init__(g, _PY_TOKENS, classify, keywords=_PY_KEYWORDS)
        self.shapes: dict[str, str] = {}
        suites = Grammar(PYTHON_SUITES)
        for k in "sfelwrtxXyW@dmcB":
            suites.code(k)
        self.kinds, self.suites = suites.codes, suites
        self.suite_memo: dict[str, str] = {}

    def indent(self, line: str) -> str:
        """Code of the white space that a line begins with; its widths are counted with tabs to 8 columns and to 1."""
        space = "" if "#" in line else line.rpartition("\f")[2]
        if space not in self.indents:
            self.indents[space] = chr(_PY_INDENT + len(self.widths))
            self.widths.append((len(space.expandtabs(8)), len(space)))
        return self.indents[space]

    def fields(self, token: str, raw: bool) -> bool:
        """Are the replacement fields of a formatted string expressions?"""
        start = re.search("[\"']+", token)
        quote = 3 if len(start[0]) >= 3 and len(token) >= start.start() + 6 else 1
        return self._pieces(token, start.start() + quote, len(token) - quote, raw, False)

    def _pieces(self, t: str, i: int, end: int, raw: bool, spec: bool) -> bool:
        while i < end:
            c = t[i]
            if c == "\\" and not raw:
                named = t.startswith("\\N{", i)
                i = t.find("}", i) + 1 if named and t.find("}", i) >= 0 else i + 2
            elif c in "{}" and not spec and t[i + 1 : i + 2] == c:
                i += 2
            elif c == "}":
                return False
            elif c == "{":
                i = self._field(t, i + 1, end, raw)
                if i < 0:
                    return False
            else:
                i += 1
        return True

    def _field(self, t: str, i: int, end: int, raw: bool) -> int:
        """The end of the field whose inside begins at ``i``, or -1."""
        depth, at = 0, i
        while True:
            m = _PY_FIELD_END.search(t, at, end)
            if m is None:
                return -1
            c, at = m[0], m.end()
            if c in "([{":
                depth += 1
            elif c in ")]}" and depth:
                depth -= 1
            elif c in "\"'":
                long = t.startswith(c * 3, m.start())
                close = t.find(c * 3 if long else c, at + 2 if long else at, end)
                if close < 0:
                    return -1
                at = close + (3 if long else 1)
            elif depth or c == "=" or (c == "!" and t[at : at + 1] == "="):
                continue
            else:
                break
        codes = super().codes(t[i : m.start()])
        reduced = ERROR if ERROR in codes else self.reduce(codes)
        if ERROR in reduced or not self.g.matches("field", self.inside(reduced)):
            return -1
        if c == "!":
            kind = re.compile(r"[rsa][ \t]*(?=[:}])").match(t, at, end)
            if kind is None:
                return -1
            c, at = t[kind.end()], kind.end() + 1
        if c == ":":  # the format may hold fields, but no braces else
            start, depth = at, 0
            while at < end and (depth or t[at] != "}"):
                depth += (t[at] == "{") - (t[at] == "}")
                at += 1
            return at + 1 if at < end and self._pieces(t, start, at, raw, True) else -1
        return at if c == "}" else -1

    def codes(self, text: str) -> str:
        if len(self.widths) > _PY_INDENTS // 2:
            self.widths.clear(), self.indents.clear(), self.table.clear(), self.memo.clear()
            self.table.update(self.table.fixed)
        return super().codes("\n" + text.removeprefix(MARK))

    def places(self, text: str) -> Iterator[tuple[str, int]]:
        body = text.removeprefix(MARK)
        shift = len(text) - len(body) - 1
        for c, x in super().places("\n" + body):
            yield c, max(0, x + shift)

    def line_kind(self, shape: str) -> str:
        """Kinds of a logical line: a simple statement, a header, or a header with its suite; empty if no rule matches."""
        kind = self.shapes.get(shape)
        if kind is None:
            kind = ""
            if self.g.matches("start", shape):
                kind = self.kinds["s"]
            else:
                f = self.g.functions()
                for rule, k in _PY_KINDS.items():
                    f["begin"](shape + END + END)
                    end = f["r_" + rule](0)
                    if end >= 0:
                        if end == len(shape):
                            kind = self.kinds[k]
                        elif k not in "@m" and self.g.matches("start", shape[end:]):
                            kind = self.kinds[k] + self.kinds["B"]
                        if kind:
                            break
            if len(self.shapes) > REMEMBERED:
                self.shapes.clear()
            self.shapes[shape] = kind
        return kind

    def _logical(self, codes: str) -> list[tuple[tuple[int, int], str]]:
        parts = _PY_LINE.split(codes)
        marks = _PY_LINE.findall(codes)
        return [(self.widths[ord(m) - _PY_INDENT], p) for m, p in zip(marks, parts[1:], strict=True) if p]

    def _suite(self, inner: str) -> str:
        code = self.suite_memo.get(inner)
        if code is None:
            bits = sum(1 << i for i, r in enumerate(self.suites.bits["{"]) if self.suites.matches(r, inner))
            code = chr(BASE["{"] + bits) if bits else ERROR
            if len(inner) < 200:
                if len(self.suite_memo) > REMEMBERED:
                    self.suite_memo.clear()
                self.suite_memo[inner] = code
        return code

    def accepts(self, codes: str) -> bool:
        return self._walk(self._logical(codes)) is None

    def _walk(self, lines: list[tuple[tuple[int, int], str]]) -> tuple[int, str] | None:
        """Index of the first line at which no statement goes on, and why; None if all do."""
        indents, open_suites, starts = [(0, 0)], [[]], [0]

        def close(i: int) -> tuple[int, str] | None:
            indents.pop()
            start = starts.pop()
            code = self._suite("".join(open_suites.pop()))
            if code == ERROR:
                return start, "suite"
            open_suites[-1].append(code)
            return None

        for i, (indent, shape) in enumerate(lines):
            top = indents[-1]
            if indent[0] > top[0]:
                if indent[1] <= top[1]:
                    return i, "indent"
                indents.append(indent)
                open_suites.append([])
                starts.append(i)
            else:
                while indent[0] < indents[-1][0]:
                    if bad := close(i):
                        return bad
                if indent != indents[-1]:
                    return i, "indent"
            kind = self.line_kind(shape)
            if not kind:
                return i, "statement"
            open_suites[-1].append(kind)
        while len(indents) > 1:
            if bad := close(len(lines)):
                return bad
        top = "".join(open_suites[0])
        if self.suites.matches("start", top):
            return None
        # Kinds of the outermost lines, each with its place.
        at = [i for i, (indent, _) in enumerate(lines) if indent[0] == 0]
        return min(at[min(self.suites.furthest("start", top), len(at) - 1)] if at else 0, len(lines)), "suite"

    def top_failure(self, tokens: list[tuple[str, int]], end: int) -> tuple[int, str]:
        lines: list[list] = []
        for c, x in tokens:
            if _PY_LINE.match(c):
                lines.append([self.widths[ord(c) - _PY_INDENT], "", x, []])
            elif lines:
                if not lines[-1][1]:
                    lines[-1][2] = x
                lines[-1][1] += c
                lines[-1][3].append((c, x))
        lines = [v for v in lines if v[1]]
        bad = self._walk([(v[0], v[1]) for v in lines])
        if bad is None or bad[0] >= len(lines):
            return end, "statement"
        if bad[1] == "statement":
            rules = ["start", *(_PY_KINDS)]
            return self._furthest(lines[bad[0]][3], rules, lines[bad[0] + 1][2] if bad[0] + 1 < len(lines) else end), "statement"
        return lines[bad[0]][2], bad[1]


# ------------------------------------------------------------------------------------------- JavaScript and TypeScript

SCRIPT = """
module <- MODULE
p_if <- 'if' (exprs)
p_else <- 'else'
p_case <- 'case' exprs ':' / 'default' ':'
p_do <- 'do'
loop <- 'while' (exprs) / 'for' 'await'? (forhead) / 'with' (exprs) / name ':' !'='
core <- {block} / ';' / typed / vars eos / func / class / 'return' ~eos / ('return' / 'throw') !NEWLINE exprs eos / ('break' / 'continue') (!NEWLINE name)? eos / 'debugger' eos / 'try' {block} ('catch' (catching)? {block} ('finally' {block})? / 'finally' {block}) / 'switch' (exprs) {cases} / !'function' !('async' ~'function') !'class' exprs eos
eos <- ';' / NEWLINE / END
vars <- 'const' cvar (',' cvar)* / ('var' / 'let') var (',' var)*
cvar <- binding ann? eq expr
var <- name '!'? ann? (eq expr)? / binding ann? eq expr
binding <- name / {object} / [array]
forhead <- (('var' / 'let' / 'const') binding / target) ('of' / 'in') exprs / (vars / exprs)? ';' exprs? ';' exprs?
target <- name ('.' anyname / [exprs])* / {object} / [array]
catching <- binding ann?
func <- 'async'? 'function' '*'? name <tparams>? (params) ret? ({block} / overload)
overload <- NEVER
class <- deco* 'abstract'? 'class' !{classbody} name classrest
classrest <- <tparams>? ('extends' heritage)? implements? {classbody}
implements <- NEVER
heritage <- (name / 'this' / 'null' / (exprs)) ('.' anyname / <targs>? (args) / [exprs])* <targs>?
classbody <- member*
member <- ';' / 'static' {block} / deco* mod* (('get' / 'set') &key)? '*'? key '?'? <tparams>? (params) ret? ({block} / overload) / deco* mod* key ('?' / '!')? ann? (eq expr)? eos / deco* mod* [indexsig] ann eos
mod <- ('static' / 'async' / 'accessor' / tsmod) &(key / '*' / [indexsig])
tsmod <- NEVER
deco <- '@' name ('.' anyname)* (args)?
key <- anyname / STR / NUM / PRIV / [exprs]
exprs <- operand ((infix / ',') operand / suffix)*
expr <- operand (infix operand / suffix)*
infix <- asg / binop / '?' mid ':'
suffix <- NEVER
mid <- moperand ((asg / binop / '?' mid ':') moperand / msuffix)*
msuffix <- NEVER
binop <- '||' / '&&' / '??' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' (EQ2 / '>'? '>'?) / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%'
asg <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '>'? EQ2 / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
eq <- '=' / EQ2
operand <- (prefix / arrow !{block})* (arrow {block} / primary postfix* / 'yield')
moperand <- (prefix / marrow !{block})* (marrow {block} / mprimary postfix* / 'yield')
prefix <- '!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' !(asg / '.' / ',' / ';' / END) / 'yield' '*'? &(prefix0 / mprimary) / 'new' !'.' / cast
prefix0 <- '!' / '~' / '+' / '-' / '++' / '--' / 'typeof' / 'void' / 'delete' / 'await' / 'new'
cast <- NEVER
arrow <- 'async'? (name / <tparams>? (params) ret?) ~'=>'
marrow <- 'async'? (name / (params)) ~'=>'
primary <- 'async' ~'function' '*'? name? <tparams>? (params) ret? {block} / name / NUM / STR / TEMPLATE / REGEX / 'this' / 'super' / 'null' / 'true' / 'false' / (exprs) / [array] / {object} / 'function' '*'? name? <tparams>? (params) ret? {block} / deco* 'class' (!('extends' / 'implements') name)? classrest / 'import' ((args) / '.' anyname) / 'new' '.' anyname / PRIV
mprimary <- 'async' ~'function' '*'? name? (params) {block} / name / NUM / STR / TEMPLATE / REGEX / 'this' / 'super' / 'null' / 'true' / 'false' / (exprs) / [array] / {object} / 'function' '*'? name? (params) {block} / 'import' ((args) / '.' anyname) / 'new' '.' anyname / PRIV
postfix <- '.' (anyname / PRIV) / '?.' (anyname / PRIV / (args) / [exprs]) / <targs>? (args) / [exprs] / TEMPLATE / ~'++' / ~'--' / nonnull
nonnull <- NEVER
args <- ('...'? operand ((infix / ',' '...'?) operand / suffix)* ','?)?
array <- ','* ('...'? operand ((infix / ','+ '...'?) operand / suffix)*)? ','*
object <- (prop (',' prop)* ','?)?
prop <- '...' expr / ('get' / 'set') key (params) ret? {block} / ('async' &(key / '*'))? '*'? key <tparams>? (params) ret? {block} / key ':' expr / name ('=' expr)?
params <- (param (',' param)* ','?)?
param <- deco* (tsmod &binding)* '...'? (binding / 'this') '?'? ann? (eq expr)?
name <- ID / 'async' / 'of' / 'get' / 'set' / 'static' / 'as' / 'from' / 'accessor' / 'await' / tsname
tsname <- 'type' / 'abstract' / 'declare' / 'readonly' / 'namespace' / 'module' / 'is' / 'keyof' / 'infer' / 'asserts' / 'satisfies' / 'unique' / 'override' / 'global' / 'require' / 'assert' / 'using' / 'public' / 'private' / 'protected' / 'interface' / 'implements' / 'out' / 'let'
anyname <- name / 'if' / 'else' / 'while' / 'for' / 'with' / 'return' / 'throw' / 'break' / 'continue' / 'debugger' / 'try' / 'catch' / 'finally' / 'switch' / 'case' / 'default' / 'do' / 'const' / 'var' / 'function' / 'class' / 'extends' / 'instanceof' / 'in' / 'typeof' / 'void' / 'delete' / 'yield' / 'new' / 'this' / 'super' / 'null' / 'true' / 'false' / 'import' / 'export' / 'enum'
ann <- NEVER
ret <- NEVER
typed <- NEVER
indexsig <- NEVER
targs <- NEVER
tparams <- NEVER
"""
_TYPES = """
module <- importing / exporting
importing <- 'import' STR attrs? eos / 'import' ('type' !'from' !',')? name '=' ('require' (args) / name ('.' anyname)*) eos / 'import' ('type' &(name / {specs} / '*'))? ({specs} / '*' 'as' name / name (',' ({specs} / '*' 'as' name))?) 'from' STR attrs? eos
attrs <- ('with' / 'assert') {object}
exporting <- deco* 'export' ('default' ('async'? 'function' '*'? name? <tparams>? (params) ret? ({block} / eos) / 'abstract'? 'class' (!'extends' name)? classrest / &'interface' typed / expr eos) / '*' ('as' (anyname / STR))? 'from' STR attrs? eos / 'type' '*' ('as' (anyname / STR))? 'from' STR attrs? eos / 'type'? {specs} ('from' STR attrs?)? eos / '=' exprs eos / 'as' 'namespace' name eos / &('interface' / 'type' / 'enum' / 'const' / 'namespace' / 'module' / 'declare' / 'abstract' / 'class' / 'let' / 'var' / 'function' / 'async' / '@'))
specs <- (spec (',' spec)* ','?)?
spec <- 'type' (anyname / STR) ('as' (anyname / STR))? / (anyname / STR) ('as' (anyname / STR))?
overload <- eos
vars <- 'const' !'enum' cvar (',' cvar)* / ('var' / 'let' / 'await'? 'using' !NEWLINE &using) var (',' var)*
using <- !('in' / 'of' / 'instanceof' / 'as' / 'satisfies') name
cvar <- binding ann? (eq expr)?
forhead <- (('var' / 'let' / 'const' / 'await'? 'using' &using) binding / target) ('of' / 'in') exprs / (vars / exprs)? ';' exprs? ';' exprs?
implements <- 'implements' type (',' type)*
tsmod <- 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare'
suffix <- 'as' ('const' / type) / 'satisfies' type
msuffix <- ('as' / 'satisfies') ('const' / tatom (~[typeindex])*)
cast <- <targs>
nonnull <- ~'!' !'='
ann <- ':' type
ret <- ':' ('asserts' name ('is' type)? / ('this' / name) 'is' type / type)
typed <- 'interface' name <tparams>? ('extends' type (',' type)*)? {typebody} / 'type' name <tparams>? eq type eos / 'const'? 'enum' name {enumbody} / ('namespace' / 'module') (name ('.' name)* / STR) ({nsbody} / eos) / 'global' {nsbody} / 'declare' ('global' {nsbody} / ('var' / 'let' / 'const') dvar (',' dvar)* eos / &('interface' / 'type' / 'enum' / 'const' / 'namespace' / 'module' / 'abstract' / 'class' / 'function' / 'async'))
dvar <- name ann?
enumbody <- (key ('=' expr)? (',' key ('=' expr)?)* ','?)?
type <- ('|' / '&')? tor ('extends' tor '?' type ':' type)?
tor <- tunit (('|' / '&') tunit)*
tunit <- tprefix* tatom (~[typeindex])*
tprefix <- ('keyof' / 'readonly' / 'unique' / 'typeof') &tstart / 'abstract'? 'new'? <tparams>? (params) '=>' (('asserts'? (name / 'this') 'is') &tstart)?
tstart <- anyname / STR / NUM / TEMPLATE / (types) / (params) / [types] / {typebody} / <tparams>
tatom <- 'infer' name ('extends' tor !'?')? / 'asserts' !NEWLINE (name / 'this') / ('void' / 'null' / 'true' / 'false' / 'this' / 'import' (args) / name) ('.' anyname)* <targs>? / STR / '-'? NUM / TEMPLATE / (types) / [types] / {typebody}
types <- (titem (',' titem)* ','?)?
titem <- '...'? (name '?'? ':' type / type '?'?)
typeindex <- type?
targs <- type (',' type)* ','?
tparams <- tparam (',' tparam)* ','?
tparam <- 'const'? ('in' / 'out')? name ('extends' type)? (eq type)?
typebody <- (tmember (';' / ',' / NEWLINE / END))* 
tmember <- ('-' / '+')? ('readonly' &(key / [indexsig] / '-' / '+'))? ([indexsig] (('-' / '+')? '?')? ann? / 'new'? <tparams>? (params) ret? / ('get' / 'set') key (params) ret? / key '?'? (<tparams>? (params) ret? / ann)?)
indexsig <- name ':' type / name 'in' type ('as' type)?
"""
_JS_ID = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_JS_REGEX = r"/(?![/*])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[A-Za-z]*"
_JS_BEFORE_REGEX = r"&&|\|\||\?\?|=>|[!=]==?|[<>]=?|[-+*%&|^]=|[=(,:;!?{\[~&|^+\-*%]|\b(?:return|typeof|case|in|of|delete|void|throw|do|else|instanceof|yield|await)\b"


def _template(depth: int) -> str:
    """Template literals whose substitutions nest braces and templates so deep; what nests deeper is read piece by piece."""
    more = f"|{_template(depth - 1)}|{_braces(depth - 1)}" if depth else ""
    return rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{(?:{_PLAIN}{more})*+\}})*+`"


def _braces(depth: int) -> str:
    more = f"|{_template(depth - 1)}|{_braces(depth - 1)}" if depth else ""
    return rf"\{{(?:{_PLAIN}{more})*+\}}"


_PLAIN = r"[^{}`\"']++|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'"
_JS_TOKENS = (
    r"[A-Za-z_$][\w$]*+(?![\\\w$]|\s*/)|//[^\r\n\u2028\u2029]*|/\*.*?\*/"
    rf"|\n[ \t]*{_JS_REGEX}(?=\s*\.)|\r\n|[\n\r\u2028\u2029]"
    rf"|(?:{_JS_BEFORE_REGEX})(?:\s|//[^\r\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)*+{_JS_REGEX}|[)}}][ \t]*{_JS_REGEX}(?=\.(?:test|exec)\()"
    rf"|{_template(5)}"
    r"|\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'"
    rf"|\#?{_JS_ID}"
    r"|0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|[-+*/%&|^]=|<<|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@]|[^\s]"
)
_JS_PREFIX = re.compile(_JS_BEFORE_REGEX)


# How the kinds of pieces form statements: i if, e else, l loop head or label, d do, c any other statement, k case label, m module item.
_BODY = "(?>[li]*+(?:c|d[li]*+cl(?:c)?))"
_STATEMENT = f"(?>l*+i{_BODY}(?:ei?{_BODY})*+|l*+(?:c|d[li]*+clc?))"
_FORMS = {"block": re.compile(rf"(?:{_STATEMENT})*+\Z"), "cases": re.compile(rf"(?:k|{_STATEMENT})*+\Z"), "nsbody": re.compile(rf"(?:m|{_STATEMENT})*+\Z"), "start": re.compile(rf"(?:m|{_STATEMENT})*+\Z")}


class ScriptParser(Parser):
    """JavaScript or TypeScript. ``>=`` is read as ``>`` and an equals sign of its own, so that type arguments can end there."""

    runs = _FORMS
    unit_rules = {"m": "module", "i": "p_if", "e": "p_else", "l": "loop", "d": "p_do", "k": "p_case", "c": "core"}

    def __init__(self, typed: bool) -> None:
        text = SCRIPT
        if typed:
            own = {x.split("<-", 1)[0].strip() for x in _TYPES.strip().split("\n")}
            text = "\n".join(x for x in SCRIPT.strip().split("\n") if x.split("<-", 1)[0].strip() not in own) + _TYPES
        g = Grammar(text, skip_newlines=True)
        string, number, name, private, pattern, template = (g.code(x) for x in ("STR", "NUM", "ID", "PRIV", "REGEX", "TEMPLATE"))
        g.code("NEVER"), g.code("MODULE")
        legacy = re.compile(r"0[0-9_]*[0-9]\Z")

        def classify(token: str) -> str:
            c = token[0]
            if c in "\n\r\u2028\u2029":
                return NEWLINE if token.isspace() else NEWLINE + pattern
            if c in ")}" and len(token) > 1:
                return c + pattern
            if c == "/" and token[:2] in ("//", "/*") and len(token) > 1:
                return NEWLINE if "\n" in token or "\r" in token else ""
            if c in "\"'" and len(token) > 1:
                return string
            if c == "`" and len(token) > 1:
                return template if self.substitutions(token) else ERROR
            if c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
                return ERROR if "_" in token and legacy.match(token) else number
            if c == "#" and len(token) > 1:
                return private
            if c.isalpha() or c in "_$" or (c == "\\" and len(token) > 1):
                m = _JS_PREFIX.match(token)
                return self.table[m[0]] + pattern if m and token[-1] != m[0][-1] and "/" in token else name
            m = _JS_PREFIX.match(token)
            if m and "/" in token[m.end() :]:
                return self.table[m[0]] + pattern
            return pattern if token.lstrip(" \t").startswith("/") and len(token) > 2 else ERROR

        super().__init__(g, _JS_TOKENS, classify)
        equal = g.code("EQ2")
        more = g.code(">")
        fixed = {NEWLINE: NEWLINE, **{">" * n + "=": more * n + equal for n in (1, 2, 3)}}
        self.table.fixed |= fixed
        self.table.update(fixed)

    def substitutions(self, token: str) -> bool:
        """Are the substitutions of a template literal expressions?"""
        i, end = 1, len(token) - 1
        while i < end:
            if token[i] == "\\":
                i += 2
            elif token.startswith("${", i):
                codes, depth = [], 0
                for m in self.tokens.finditer(token, i + 2, end):
                    depth += (m[1] == "{") - (m[1] == "}")
                    if depth < 0:
                        break
                    codes.append(self.table[m[1]])
                else:
                    return False
                joined = "".join(codes)
                inner = ERROR if ERROR in joined else self.reduce(joined)
                if ERROR in inner or not self.g.matches("exprs", self.inside(inner)):
                    return False
                i = m.end()
            else:
                i += 1
        return True

    def codes(self, text: str) -> str:
        return super().codes(text.removeprefix(MARK) if text[:2] != "#!" else "//" + text[2:])


# ------------------------------------------------------------------------------------------------------------------ Go

GO = """
start <- ';'* 'package' ID ';' ('import' (STR / (ID / '.') STR / (imports)) ';')* (decl ';')*
imports <- (((ID / '.')? STR)? (';' ((ID / '.')? STR)?)*)?
decl <- func / 'var' (varspec / (varspecs)) / 'const' (constspec / (constspecs)) / 'type' (typespec / (typespecs))
varspec <- names (type ('=' exprs)? / '=' exprs)
varspecs <- varspec? (';' varspec?)*
constspec <- names (type? '=' exprs)?
constspecs <- constspec? (';' constspec?)*
typespec <- ID [tparams]? '='? type
typespecs <- typespec? (';' typespec?)*
names <- ID (',' ID)*
func <- 'func' (params)? ID [tparams]? (params) result? {block}?
result <- (params) / type
tparams <- names constraint (',' names constraint)* ','?
constraint <- '~'? type ('|' '~'? type)*
params <- (param (',' param)* ','?)?
param <- ID '...'? type / '...'? type
type <- tpre* (tend / 'func' (params) result0?)
result0 <- (params) / tpre* tend
tpre <- '*' / [arraylen] / 'map' [onetype] / 'chan' '<-'? / '<-' 'chan' / 'func' (params) &('*' / [arraylen] / 'map' / 'chan' / 'func')
tend <- ID ('.' ID)? [typeargs]? / 'struct' {fields} / 'interface' {methods} / (onetype)
arraylen <- ('...' / expr)?
onetype <- type
typeargs <- type (',' type)* ','?
fields <- field? (';' field?)*
field <- (names type / '*'? ID ('.' ID)? [typeargs]?) STR?
methods <- method? (';' method?)*
method <- ID (params) result? / constraint
unit <- stmt (';' / &END) / ';'
block <- unit*
stmt <- (ID ':' !'=' ';'*)* stmt0
stmt0 <- {block} / ifs / 'for' forrest / 'switch' switchrest / 'select' {comms} / 'return' exprs? / ('go' / 'defer') expr / 'goto' ID / ('break' / 'continue') ID? / 'fallthrough' / 'var' (varspec / (varspecs)) / 'const' (constspec / (constspecs)) / 'type' (typespec / (typespecs)) / simple
ifs <- 'if' (hsimple? ';')? hsimple {block} ('else' 'if' (hsimple? ';')? hsimple {block})* ('else' {block})?
forrest <- {block} / (hexprs (':=' / '='))? 'range' hexpr {block} / hsimple? ';' hexpr? ';' (hsimple {block} / {block}) / hexpr {block}
switchrest <- (hsimple? ';')? ({cases} / hsimple {cases})
cases <- ';'* (('case' caseitem (',' caseitem)* / 'default') ':' casebody)*
casebody <- (!'case' !'default' (stmt / ';'))*
caseitem <- expr / type
comms <- ';'* (('case' simple / 'default') ':' casebody)*
simple <- exprs (asg exprs / ':=' exprs / '++' / '--' / '<-' expr)?
hsimple <- hexprs (asg hexprs / ':=' hexprs / '++' / '--' / '<-' hexpr)?
asg <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^='
exprs <- expr (',' expr)*
hexprs <- hexpr (',' hexpr)*
expr <- unary (binop unary)*
hexpr <- hunary (binop hunary)*
binop <- '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&^' / '&'
unary <- un* primary (post / {lit})*
hunary <- un* primary post*
un <- '+' / '-' / '!' / '^' / '*' / '&' / '<-' !'chan' / '~'
primary <- NUM / STR / 'func' (params) result? {block} / lits ({lit} / (args)) / ID / (parens) / typeonly
lits <- tpre+ tend / 'struct' {fields} / tpre* 'interface' {methods}
typeonly <- tpre+ tend / 'interface' {methods} / 'struct' {fields} / 'chan' type
post <- '.' ID / '.' (assertion) / [index] / (args)
parens <- expr / type
assertion <- 'type' / type
args <- (arg (',' arg)* '...'? ','?)?
arg <- expr / type
index <- (expr? ':' expr? (':' expr)? / arg (',' arg)* ','?)
lit <- (el (',' el)* ','?)?
el <- (val ':')? val
val <- {lit} / expr
"""
_GO_TOKENS = (
    r"//[^\n]*|/\*.*?\*/|\n|`[^`]*`|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    rf"|{_CJK_FREE_ID}"
    r"|0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?"
    r"|&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|&\^|&&|\|\||<<|>>|[!=<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!~(){}\[\].,:;]|[^\s]"
)
_BAD_OCTAL = re.compile(r"0[0-7_]*[89][0-9_]*[lL]?\Z")
_GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"


class GoParser(Parser):
    """Go; line ends become semicolons by the language's rule before anything else."""

    runs = {"block": re.compile("g*\\Z")}
    unit_rules = {"g": "unit"}
    unit_stop = (";",)

    def __init__(self) -> None:
        g = Grammar(GO)
        string, number, name = g.code("STR"), g.code("NUM"), g.code("ID")

        def classify(token: str) -> str:
            c = token[0]
            if c == "/" and len(token) > 1:
                return NEWLINE if "\n" in token else ""
            if c in "\"'`":
                return string if len(token) > 1 else ERROR
            if c.isdigit() or (c == "." and len(token) > 1):
                return ERROR if _BAD_OCTAL.match(token) else number
            return name if token.isidentifier() else ERROR

        super().__init__(g, _GO_TOKENS, classify, keywords=_GO_KEYWORDS)
        self.table.fixed[NEWLINE] = self.table[NEWLINE] = NEWLINE
        ends = "".join(map(g.code, ("ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--"))) + ")]}"
        self.ends = re.compile(rf"(?<=[{re.escape(ends)}])\n+|\n+")
        self.semi = g.code(";")
        self.ending = frozenset(ends)

    def codes(self, text: str) -> str:
        raw = super().codes(text.removeprefix(MARK) + "\n")
        return self.ends.sub(lambda m: self.semi if m.start() and raw[m.start() - 1] in self.ending else "", raw)

    def places(self, text: str) -> Iterator[tuple[str, int]]:
        last = ""
        for c, x in super().places(text + "\n"):
            if c == NEWLINE:
                if last not in self.ending:
                    continue
                c = self.semi
            yield c, min(x, len(text))
            last = c


# ---------------------------------------------------------------------------------------------------------------- Java

JAVA = """
start <- (mod* 'package' qname ';')? ('import' 'static'? qname ('.' '*')? ';' / ';')* (typedecl / ';')*
qname <- name ('.' name)*
typedecl <- mod* (('class' name <tparams>? ('extends' type)? / 'interface' name <tparams>? ('extends' type (',' type)*)? / 'record' name <tparams>? (params)) ('implements' type (',' type)*)? ('permits' type (',' type)*)? {classbody} / 'enum' name ('implements' type (',' type)*)? {enumbody} / '@' 'interface' name {classbody})
mod <- 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' / 'sealed' &(mod0 / 'class' / 'interface') / 'non' '-' 'sealed' / deco
mod0 <- 'public' / 'private' / 'protected' / 'static' / 'final' / 'abstract' / 'strictfp'
deco <- '@' !'interface' qname (annargs)?
annargs <- (name '=' annval (',' name '=' annval)* / annval)?
annval <- expr / {arrayinit} / deco
classbody <- member*
member <- ';' / 'static'? {block} / typedecl / mod* (<tparams>? mod* (name (params) throws? {block} / ('void' / type) name (params) dims throws? ({block} / 'default' annval ';' / ';')) / type vardecl (',' vardecl)* ';' / name {block})
throws <- 'throws' type (',' type)*
enumbody <- (deco* name (args)? {classbody}? (',' deco* name (args)? {classbody}?)*)? ','? (';' member*)?
params <- (param (',' param)* ','?)?
param <- ('final' / deco)* type '...'? (name / 'this') dims
vardecl <- name dims ('=' ({arrayinit} / expr))?
dims <- (deco* [nothing])*
nothing <- END
type <- deco* (prim / name <targs>? ('.' deco* name <targs>?)*) dims
prim <- 'int' / 'long' / 'short' / 'byte' / 'char' / 'float' / 'double' / 'boolean'
targs <- (targ (',' targ)*)?
targ <- deco* '?' (('extends' / 'super') type)? / type ('&' type)*
tparams <- deco* name ('extends' type ('&' type)*)? (',' deco* name ('extends' type ('&' type)*)?)*
p_if <- 'if' (expr)
p_else <- 'else'
p_do <- 'do'
p_case <- label (':' / '->' ({block} / 'throw' expr ';' / expr ';'))
loop <- 'while' (expr) / 'for' (forhead) / 'synchronized' (expr) &{block} / name ':' !':'
core <- localvar ';' / typedecl / core0
core0 <- {block} / ';' / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') name? ';' / 'yield' !'=' !'.' expr ';' / 'assert' expr (':' expr)? ';' / 'try' ((resources) {block} ('catch' (catching) {block})* ('finally' {block})? / {block} (('catch' (catching) {block})+ ('finally' {block})? / 'finally' {block})) / 'switch' (expr) {cases} / exprstmt ';'
localvar <- ('final' / deco)* type vardecl (',' vardecl)*
exprstmt <- ('++' / '--') primary post* / primary stpost* (asg expr / '++' / '--' / !stmore)
stmore <- binop / '?' / 'instanceof'
stpost <- post0
forhead <- ('final' / deco)* type name ':' expr / (localvar / exprstmt (',' exprstmt)*)? ';' expr? ';' (exprstmt (',' exprstmt)*)?
resources <- resource (';' resource)* ';'?
resource <- ('final' / deco)* type name '=' expr / expr
catching <- ('final' / deco)* type ('|' type)* name
label <- 'default' / 'case' caseitem (',' caseitem)* ('when' expr)?
caseitem <- 'default' / 'null' / type (pattern) name? / type name &('->' / ':' / ',' / 'when') / cexpr
pattern <- (type name? (pattern)? (',' type name? (pattern)?)*)?
cexpr <- unary (binop unary)*
expr <- operand (infix operand / isa)*
infix <- asg / binop / '?' expr ':'
isa <- 'instanceof' 'final'? type ((pattern) name? / name)?
binop <- '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '>=' / '<<' / '<' / '>' '>'? '>'? / '+' / '-' / '*' / '/' / '%'
asg <- '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '>>>='
operand <- (un / cast / arrow !{block})* (arrow {block} / primary post*)
unary <- (un / cast)* primary post*
un <- '+' / '-' / '!' / '~' / '++' / '--'
cast <- (casting) &(name / NUM / STR / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / (expr) / '!' / '~' / 'switch' / prim / (lparams) '->' / (casting))
casting <- type ('&' type)*
arrow <- (name / (lparams)) '->'
lparams <- (lparam (',' lparam)*)?
lparam <- ('final' / deco)* type '...'? name dims / name
primary <- NUM / STR / 'true' / 'false' / 'null' / 'this' / 'super' / (expr) / 'new' deco* newtype ((args) {classbody}? / [expr]+ dims / ([nothing])+ {arrayinit}) / 'switch' (expr) {cases} / prim ([nothing])* &('.' / '::') / 'void' &'.' / name <targs>? ([nothing])* &'::' / name ([nothing])+ &'.' / name
newtype <- prim / <targs>? name <targs>? ('.' name <targs>?)*
post <- post0 / '++' / '--'
post0 <- '.' <targs>? ('new' newtype (args) {classbody}? / name / 'class' / 'this' / 'super') / (args) / [expr] / '::' <targs>? (name / 'new')
args <- (expr (',' expr)*)?
arrayinit <- (arrayitem (',' arrayitem)*)? ','?
arrayitem <- {arrayinit} / expr
name <- ID / 'record' / 'sealed' / 'permits' / 'when' / 'yield' / 'non'
"""
_JAVA_TOKENS = (
    r"//[^\r\n]*|/\*.*?\*/|\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\r\n]|\\(?:[btnfrs\"'\\]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))*\"|\"\"(?!\")|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\]))'"
    r"|(?:[^\W\d]|\$)[\w$]*"
    r"|0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9]+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*(?:\.(?!\.)[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdD]?"
    r"|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[!=<>]=|[-+*/%&|^]=|[-+*/%&|^<>=!~?:@(){}\[\].,;]|[^\s]"
)
_JAVA_KEYWORDS = "const goto _"


class JavaParser(Parser):
    """Java."""

    runs = {k: _FORMS[k] for k in ("block", "cases")}
    unit_stop = (";",)
    unit_rules = {"i": "p_if", "e": "p_else", "l": "loop", "d": "p_do", "k": "p_case", "c": "core"}

    def __init__(self) -> None:
        g = Grammar(JAVA)
        string, number, name = g.code("STR"), g.code("NUM"), g.code("ID")

        def classify(token: str) -> str:
            c = token[0]
            if c == "/" and token[:2] in ("//", "/*"):
                return ""
            if c in "\"'":
                return string if len(token) > 1 else ERROR
            if c.isdigit() or (c == "." and len(token) > 1):
                return ERROR if _BAD_OCTAL.match(token) else number
            return name if c.isalpha() or c in "_$" else ERROR

        super().__init__(g, _JAVA_TOKENS, classify, keywords=_JAVA_KEYWORDS)

    def codes(self, text: str) -> str:
        return super().codes(text.removeprefix(MARK))


PARSERS = {".py": PythonParser, ".ts": lambda: ScriptParser(True), ".js": lambda: ScriptParser(False), ".go": GoParser, ".java": JavaParser, ".json": json_parser}


@lru_cache(None)
def parser(extension: str) -> Parser:
    """The parser of a language; one per worker, with its table of shapes."""
    return PARSERS[extension]()

