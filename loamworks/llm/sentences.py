"""Sentence units of texts in any language and script, with their places.

A text is first read as blocks: blank lines, headings, list items, block quotes and fenced code end or start a block.
Inside a block the standard character-property rules apply: a run of terminators of any script (``Sentence_Break`` STerm
and ATerm, and the ellipsis), then closing quotes and brackets, then white space, or nothing in scripts that set
none. A candidate is suppressed after abbreviations of the language of the block (told by its script and function words, else by those of
the whole text, else those of all languages), inside quotations that the sentence goes on
after, in ordinals, and after an ellipsis before a lower-case word.

Defined results: offsets count code points from 0, the end is exclusive, no unit has white space at either end; null,
empty and blank texts and texts of code only have no unit; texts of any length are read whole; a repeated row gives its
units again; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Abbreviations that a sentence doesn't end with, of any language and per language; those that are words as well;
# words that sentences begin with, by which languages are told apart too; abbreviations that a sentence may end with.
ABBREVIATIONS = {
    "any": frozenset("cf vs e.g i.e viz ca dr prof nr p pp vol vols".split()),
    "en": frozenset("nos sec secs fig figs eq ch chap ed eds approx dept est ref refs mr mrs ms st".split()),
    "de": frozenset("vgl abs bzw z.b d.h u.a o.ä s.o s.u evtl ggf inkl exkl sog bspw art bd hrsg ziff kap str tel ref fig".split()),
    "fr": frozenset("m mm mme mlle p.ex env c.-à-d c.à.d n° av apr réf ref fig art chap approx".split()),
    "es": frozenset("p.ej sr sra srta dra ud uds pág págs núm aprox cap ej ref fig art".split()),
    "hi": frozenset("सं डॉ श्री पृ क्र".split()),
}
WORDS_TOO = frozenset("no sec fig ed est ref art abs cap env str ej vol ch st eq bd tel".split())
STARTERS = {
    "en": frozenset("the and of is it to in that she he was we they then this these there when after not are be for with as on at by from an if or but no one all its which will".split()),
    "de": frozenset("der die das und nicht ist ein eine einen mit von den dem zu wird er sie es wir dann nach wenn auch auf für im kein keine danach dieser diese sind oder aber als bei".split()),
    "fr": frozenset("le la les des et est une un dans que pour pas du au il elle nous ils puis ce cette quand après sur avec ou mais si ne se son sa".split()),
    "es": frozenset("el la los las y es una un en que para del al por él ella nosotros luego este esta cuando después con o pero si no se su lo".split()),
}
MAY_END = frozenset("etc usw usf a.m p.m u.s u.k u.s.a e.u co inc ltd corp bros jr sr. ff al p.m. k.o ph.d".split())
MONTHS = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic".split())
ORDINAL_BEFORE = frozenset("der die das dem den des am im vom zum zur beim ans ins bis seit ab jeder jede jedes jeden jedem".split())
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jänner".split())
GERMAN_STARTS = frozenset("Der Die Das Den Dem Des Ein Eine Einen Einem Er Sie Es Wir Ihr Man Am Im In Bis Seit Ab Wenn Als Und Oder Aber Warum Wer Wie Was Wo Siehe Danach Dann Nach Vor Bei Zu Für Mit Auch Kein Keine Dieser Diese Dieses".split())
QUOTES_CLOSE = "\"'”’»›」』〉》〞＂〟"
BRACKETS_CLOSE = ")]}）］｝】〕〗〙"
PAIRS = {"）": "（", "］": "［", "｝": "｛", "】": "【", "〕": "〔", "〗": "〖", "〙": "〘", ")": "(", "]": "[", "}": "{"}

_LINE = regex.compile(r"[^\r\n ]*(?:\r\n|[\r\n ]|\Z)")
_MARK = regex.compile("[\"“„‘‚’«»‹›「」『』（）［］｛｝【】〔〕〖〗〘〙(){}\\[\\]]")
_DEVANAGARI = regex.compile(r"\p{Devanagari}")
_QUOTE = regex.compile(r"[ \t]{0,3}(?:>[ \t]?)+")
_FENCE = regex.compile(r"\s*(`{3,}|~{3,})")
_HEADING = regex.compile(r"[ \t]*#{1,6}(?:\s+|$)")
_ITEM = regex.compile(r"[ \t]*(?:[-*+•‣◦]|(\d{1,9})[.)])(?:[ \t]+(?=\S)|\s*$)")
_RULE = regex.compile(r"[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|=+[ \t]*)$")
_TERMINATOR = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]+|(?<=[฀-๿])\s+(?=[฀-๿])")
_STERM = regex.compile(r"\p{Sentence_Break=STerm}")
_WIDE = frozenset("。！？｡．﹒﹖﹗।॥။။።፧։۔។៕")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー々]")
_WORD_STOP = frozenset("\"'“”„«»‹›()[]{}（）「」『』`*_")
_LATIN_WORD = regex.compile(r"\p{Latin}+")
_NEXT = regex.compile(r"[\p{L}\p{N}\p{M}_$]+(?:[\p{L}\p{N}\p{M}_$]|[-’'](?=\p{L})|[./:(\\](?=[\p{L}\p{N}_)/]))*")
_OPENERS = "\"'“‘«‹„‚「『〈《（([{【〔`¿¡*_"


def blocks(text: str) -> Iterator[tuple[int, int, bool, list[tuple[int, int]]]]:
    """(start, end, heading?, spans of quote marks in between) of each block that holds sentences."""
    start = end = -1
    marks: list[tuple[int, int]] = []
    fence, number, listed, quoted = "", None, False, False
    for m in _LINE.finditer(text):
        at, stop = m.start(), m.end()
        if at == stop:
            break
        line = m[0].rstrip("\r\n ")
        if fence:
            inner = _QUOTE.sub("", line, 1) if quoted else line
            if (f := _FENCE.match(inner)) and f[1].startswith(fence) and not inner[f.end() :].strip():
                fence = ""
            continue
        q = _QUOTE.match(line)
        body = q.end() if q else 0
        rest = line[body:]
        blank = not rest.strip()
        opened = None if blank else _FENCE.match(rest)
        if start >= 0 and (blank or opened or bool(q) != quoted):
            yield start, end, False, marks
            start = -1
        quoted = bool(q)
        if opened:
            fence = opened[1]
            continue
        if blank:
            continue
        heading, rule = _HEADING.match(rest), _RULE.match(rest)
        item = None if rule or heading else _ITEM.match(rest)
        if item and item[1] and start >= 0 and int(item[1]) != 1 and not (listed and number is not None and int(item[1]) == number + 1):
            item = None  # a number that was wrapped to the start of a line
        if heading or rule or item:
            if start >= 0:
                yield start, end, False, marks
            start = -1
        if rule:
            continue
        if heading:
            yield at + body + heading.end(), at + len(line), True, []
            continue
        if start < 0:
            listed = item is not None
            number = int(item[1]) if item and item[1] else None
            start, marks = at + body + (item.end() if item else 0), []
        elif body:
            marks.append((at, at + body))
        end = at + len(line)
    if start >= 0:
        yield start, end, False, marks


def _plain_lower(word: str) -> bool:
    """A lower-case word, as opposed to a name (of code, a path, with digits or capitals inside)."""
    return word[:1].islower() and word.replace("-", "").replace("’", "").replace("'", "").isalpha() and word.islower()


def _has_case(ch: str) -> bool:
    return ch.lower() != ch.upper()


class Marks:
    """Places of the quotation marks and brackets of a block, so that looking back costs the same wherever a unit began."""

    def __init__(self, s: str) -> None:
        self.s, self.at = s, None

    def places(self, mark: str) -> list[int]:
        if self.at is None:
            self.at = {}
            for m in _MARK.finditer(self.s):
                self.at.setdefault(m[0], []).append(m.start())
        return self.at.get(mark, [])

    def last(self, mark: str, start: int, end: int) -> int:
        places = self.places(mark)
        n = bisect_left(places, end)
        return places[n - 1] if n and places[n - 1] >= start else -1

    def count(self, mark: str, start: int, end: int) -> int:
        places = self.places(mark)
        return bisect_left(places, end) - bisect_left(places, start)


def _word_before(s: str, start: int, i: int) -> str:
    """The word that ends at ``i``, looked for backwards."""
    k = i
    while k > start and not s[k - 1].isspace() and s[k - 1] not in _WORD_STOP:
        k -= 1
    return s[k:i]


def language(text: str) -> str:
    """Whose function words a text in Latin letters holds most of, ``hi`` if it has none and Devanagari, else ``""``."""
    seen = Counter(map(str.lower, _LATIN_WORD.findall(text)))
    votes = {k: sum(seen[w] for w in words) for k, words in STARTERS.items()}
    best = max(votes, key=votes.get)
    if votes[best]:
        return best if sum(v == votes[best] for v in votes.values()) == 1 else ""
    return "hi" if _DEVANAGARI.search(text) else ""


_EVERY = frozenset().union(*ABBREVIATIONS.values()) | WORDS_TOO


def _abbreviations(lang: str) -> frozenset[str]:
    """Those of the language, or of all where it isn't known."""
    return _OF.get(lang, _EVERY_ABBREVIATION)


_EVERY_ABBREVIATION = frozenset().union(*ABBREVIATIONS.values())
_OF = {k: v | ABBREVIATIONS["any"] for k, v in ABBREVIATIONS.items() if k != "any"}


def _closers(s: str, marks: Marks, start: int, i: int, j: int) -> tuple[int, bool, int]:
    """End of the closing marks after a terminator at ``i:j``; whether a quotation closes; where a bracket that closes was opened (-1: none)."""
    k, quote, bracket, n = j, False, -1, len(s)
    while k < n:
        ch = s[k]
        if ch == '"':
            if marks.count('"', start, i) % 2 == 0:
                break
            quote = True
        elif ch == "“":
            if marks.last("„", start, i) <= marks.last("“", start, i):
                break
            quote = True
        elif ch == "‘":
            if marks.last("‚", start, i) < 0:
                break
            quote = True
        elif ch in QUOTES_CLOSE:
            if ch == "'" and k + 1 < n and not s[k + 1].isspace() and s[k + 1] not in BRACKETS_CLOSE:
                break
            quote = True
        elif ch in BRACKETS_CLOSE:
            bracket = max(bracket, marks.last(PAIRS[ch], start, i))
        elif ch.isspace():
            p = k + 1
            while p < n and s[p].isspace():
                p += 1
            if p < n and s[p] == "»" and marks.last("«", start, i) > marks.last("»", start, i):
                k, quote = p, True
            else:
                break
        else:
            break
        k += 1
    return k, quote, bracket


def _ends(s: str, start: int, i: int, j: int, k: int, quote: bool, bracket: int, lang_of: Callable[[], str]) -> bool:
    """Whether a unit that began at ``start`` ends at ``k``: terminator at ``i:j``, closing marks up to ``k``."""
    n = len(s)
    mark = s[i:j]
    after = s[k]
    spaced = after.isspace()
    p = k
    while p < n and s[p].isspace():
        p += 1
    if p == n:
        return True
    first = s[p]
    ellipsis = "…" in mark or "..." in mark
    # Scripts other than Latin, Greek and Cyrillic need no space after their own marks.
    wide = mark[-1] in _WIDE or (ord(mark[-1]) > 0x58F and not 0x2000 <= ord(mark[-1]) < 0x2070 and _STERM.match(mark[-1]) is not None)
    if not spaced:
        if mark == "．" and i and s[i - 1].isdigit() and after.isdigit():
            return False
        if not (wide or ((ellipsis or mark[-1] in "!?") and (_CJK.match(after) or after in _OPENERS) and i and (_CJK.match(s[i - 1]) or mark[0] in _WIDE))):
            return False
        if quote and (after.isalnum() or after in "，、,：:；;。"):
            return False
        if after in "，、,；;：:」』”’)）":
            return False
        return not (bracket > start and after.isalnum() and s[start:bracket].strip())
    word = _NEXT.match(s, p)
    token = word[0] if word else ""
    if first in ",;:，、；：)）]" or (first in "-–—" and p + 1 < n and s[p + 1].isspace() and _plain_lower((_NEXT.match(s, min(n, p + 2)) or [""])[0])):
        return first in "-–—" and not quote and not ellipsis
    if quote:
        if token and not _has_case(first) and not first.isdigit() and not _CJK.match(first):
            return False
        return not _plain_lower(token)
    if bracket >= 0 and s[start:bracket].strip():
        return not _plain_lower(token)
    if ellipsis:
        return not _plain_lower(token)
    if mark != "." or k > j:
        return True
    # a single full stop without closing marks
    before = _word_before(s, start, i)
    low = before.lower()
    if first.isdigit() and low == "no":
        return before == "No" and not s[start : i - 2].strip()
    if low == "no":
        return True
    if low in MONTHS and (first.isdigit() or _plain_lower(token)):
        return False
    if low in MAY_END or (len(before) == 1 and low == "m" and s[max(start, i - 3) : i - 1] in ("p.", "a.", "p. ", "a. ", ". ")):
        return not _plain_lower(token)
    # A capitalised article, pronoun or the like begins a sentence even after an abbreviation that is a word as well, or a letter.
    lang = lang_of() if len(before) == 1 or low in _EVERY else ""
    starts = token[:1].isupper() and any(token.lower() in STARTERS[x] for x in ([lang] if lang in STARTERS else STARTERS))
    if starts and (low in WORDS_TOO or (len(before) == 1 and before.isalpha() and s[max(start, i - 3) : i - 1].strip("\u00a0 ") not in ("", ".") and i - 2 > start and s[i - 2].isspace() and s[i - 3].islower())):
        return True
    if (low in _EVERY and low in _abbreviations(lang)) or (low == "ex" and s[max(start, i - 4) : i - 2].lower() in ("p.", ".\u00a0", ". ")):
        return False
    if len(before) == 1 and before.isalpha() and not _CJK.match(before) and _has_case(before):
        return False
    if "." in before and all(len(x) == 1 and x.isalpha() for x in before.split(".")):
        return not _plain_lower(token)
    if before.isdigit() and len(before) <= 3 and first.isupper():
        if token in GERMAN_MONTHS:
            return False
        lead = s[start : i - len(before)].split()
        if lead and lead[-1].lower() in ORDINAL_BEFORE and token not in GERMAN_STARTS:
            return False
    # Any other lower-case word goes on only after what looks cut short.
    return not (_plain_lower(token) and len(before) <= 4 and before.isalpha() and not regex.search(r"[aeiouyäöüáéíóú]", low))


def sentence_units(text: str | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if not text:
        return out

    def put(s: str, at: int, a: int, b: int) -> None:
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((at + a, at + b))

    told: dict[int, str] = {}

    def language_of(s: str, a: int) -> str:
        """The block's language, else the text's; each is told once and only if some abbreviation asks."""
        if a not in told:
            told[a] = language(s)
            if not told[a]:
                told[-1] = told.get(-1) or language(text)
                told[a] = told[-1]
        return told[a]

    for a, b, heading, marks in blocks(text):
        s = text[a:b]
        if heading:
            put(s, a, 0, b - a)
            continue
        for x, y in marks:  # quote marks between the lines of a block count as white space
            s = s[: x - a] + " " * (y - x) + s[y - a :]
        start, found = 0, None
        for m in _TERMINATOR.finditer(s):
            i, j = m.span()
            if i < start:
                continue
            if m[0].isspace():
                put(s, a, start, i)
                start = j
                continue
            found = found or Marks(s)
            k, quote, bracket = _closers(s, found, start, i, j)
            if k < len(s) and _ends(s, start, i, j, k, quote, bracket, partial(language_of, s, a)):
                put(s, a, start, k)
                start = k
        put(s, a, start, b - a)
    return out


_SCHEMA = "doc_id long, sent_start long, sent_end long"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("sent_start", pa.int64()), ("sent_end", pa.int64())])
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for a, b in sentence_units(text.as_py()):
                ids.append(doc_id)
                starts.append(a)
                ends.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=schema)


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every unit; one pass over two columns, no shuffle."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_split, _SCHEMA)
