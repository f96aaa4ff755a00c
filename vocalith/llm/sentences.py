"""Problem 9: sentence boundaries across languages and scripts, by a hidden-event n-gram model.

Between any two words of a text a boundary event may be hidden. Where marks or the blanks of a script without marks stand
between them, the event is open; between all others it is known to be none. An open event has a left context (the word and
the mark after it, or the kind of quotation that closes there) and a right word, both backed off to shapes, and depends on
the event before it in the block and on how many words lie between. Forward-backward over all open events of a block gives
posteriors; they decide. After them come exact checks of what the model cannot know: marks inside a quotation end nothing
if the sentence goes on after it, and a Thai blank beside a number or after a closing quotation mark ends nothing.

Nothing is labelled, so the model is trained by expectation maximisation over all documents: certain boundaries (ends and
starts of blocks) and the posteriors of the round before are counted, every type of word with its full text and every
count however small. Types are known by 64-bit hashes; their counts are added up in a distributed table and folded into a
count-min table of fixed size (two rows, the less crowded bucket counts), so that the model has the same size for any
corpus and no type is left out. Shapes are counted exactly.

Texts are read once, many at a time: they are cut into words and what stands between them by one expression, each different
word and each different separator is looked at once, and all else is arithmetic on arrays. What was read is kept as a table
of packed events, which the rounds of training and the split go over.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocalith.session import cut_lineage

#: Final marks, marks of scripts that write no blank after them, quotation marks, brackets and other marks between words.
MARKS = ".!?…。！？｡؟।॥։።۔"
TIGHT = "。！？｡…"
OPENS = "«“„「『(（[【《‘"
CLOSES = "”»」』)）]】》’"
STRAIGHT = "\"'"
COMMAS = ",،、，"
OTHERS = ",;:،؛、，：—–¿¡\u037e"
_BLANK = " \t\u00a0\u202f\u2009\u3000\n\r"
#: What asks a question in Greek.
_GREEK = ";\u037e"

_INSIDE = re.escape(MARKS + OPENS + CLOSES + STRAIGHT + OTHERS)
#: A word: all that is neither white space nor one of the marks; an apostrophe before a letter belongs to it.
_WORD = re.compile(rf"([^\s\x00{_INSIDE}]+(?:['’](?=[^\W_])[^\s\x00{_INSIDE}]+)*)")
#: Words with single blanks between them. Where no blank is a place, nothing inside can be one, and only its ends are looked at.
_PHRASE = re.compile(rf"([^\s\x00{_INSIDE}]+(?:(?: |['’](?=[^\W_]))[^\s\x00{_INSIDE}]+)*)")
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85\u2028\u2029]+")
_TAG = re.compile(r"\s*(?:[-•*–—▪◦·‣]\s+|\(?\d+[.)]\s+|(?:[A-Za-z]\)|[a-zA-C]\.)\s+|[^\W\d_][\w '’-]*(?::(?=\s)|(?<![说道问答喊曰])：)\s*)")
_RUN = re.compile(rf"[{MARKS}]+")
_ENDED = re.compile(rf"[^\W\d_][{MARKS}]+(?:\s|$)")
_GREEK_RUN = re.compile(rf"[{MARKS}{_GREEK}]+")
_DIGITS = re.compile(r"\d")
_GAP = re.compile(r"[ \t\u00a0\u202f\u2009\u3000]+")
_THAI = re.compile(r"[\u0e01-\u0e3a\u0e40-\u0e5b]")  # without the baht sign
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

#: Usual widths of a page: a paragraph is taken for one set to such a width after a single break; to others, after several.
WIDTHS = (50, 200)
#: Scripts and shapes, by number; 0 is none.
SCRIPTS = ("none", "latin", "greek", "cyr", "arab", "deva", "thai", "hang", "cjk", "other")
LEFT_SHAPES = ("none", "0", "letter", "dotted", "short", "word", "cjk", "quoted after words", "quoted", "word and blank", "number and blank", "quotation and blank")
RIGHT_SHAPES = ("end", "cjk", "0", "open", "punct", "low", "up", "plain")
_S = {x: i for i, x in enumerate(SCRIPTS)}
_L = {x: i for i, x in enumerate(LEFT_SHAPES)}
_R = {x: i for i, x in enumerate(RIGHT_SHAPES)}
_ELLIPSIS, _QUESTION = MARKS.index("…") + 1, MARKS.index("?") + 1
_SEMICOLON, _BLANK_MARK = len(MARKS) + 1, len(MARKS) + 2
#: Characters between neighbouring events, up to each bound; one of a script without blanks counts for three.
GAPS = (6, 12, 24, 60)
N_LEFT, N_RIGHT, N_CONTEXT, N_GAP = 16 * 32 * 16, 8 * 16, 16 * 8 * 16, len(GAPS) + 1
#: Buckets of each row of the model's table of types.
BUCKETS = 1 << 20
#: Characters of texts that are read together.
CHUNK = 2_000_000


# layout --------------------------------------------------------------------------------------------------------------


def _set_to_width(text: str, lines: list[tuple[int, int]], size: list[int], a: int, b: int, width: int) -> list[bool]:
    """For the breaks a..b of one paragraph: does the next line run on? It does if its first word didn't fit into the line."""
    fits: list[bool | None] = []
    usual = WIDTHS[0] <= width <= WIDTHS[1]
    if not usual:
        width = max(size[a : b + 1]) + 1
    for i in range(a, b):
        following = text[lines[i + 1][0] : lines[i + 1][1]].lstrip()
        mixed = bool(_THAI.match(text[lines[i][0] + size[i] - 1])) != bool(_THAI.match(following[:1]))
        fits.append(None if mixed or _TAG.match(following) else size[i] + 1 + len(following.split(" ", 1)[0]) >= width)
    # a heading may stand on top; most other breaks of the paragraph have to be breaks of setting
    body = [x for x in fits[1:] if x is not None]
    if usual:
        good = sum(body) >= 0.75 * len(body) and (body or fits[0])
    else:  # any other width: several breaks, all of setting, in lines of several words that don't end sentences, though some end in them
        inside = [text[x:y].rstrip() for x, y in lines[a:b]]
        good = any(_ENDED.search(x) for x in inside) and len(body) >= 4 and all(body) and sum(len(x.split()) for x in inside) >= 4 * len(inside) and sum(x[-1:] not in MARKS for x in inside) > len(inside) // 2
    return [bool(x) and bool(good) for x in fits]


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of lines, those that plainly run on joined."""
    if "\n" not in text and len(lines := _LINE.findall(text)) <= 1:
        if lines and not text.isspace():
            yield 0, len(text)
        return
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text) if not m[0].isspace()]
    if not lines:
        return
    last = len(lines) - 1
    size = [len(text[a:b].rstrip()) for a, b in lines]
    close = [lines[i + 1][0] - lines[i][1] < 3 and text.count("\n", lines[i][1], lines[i + 1][0]) < 2 for i in range(last)]
    joins = [False] * last
    if any(close):
        inner = sorted(n for n, x in zip(size, close) if x)
        width = inner[len(inner) * 3 // 4]
        at = 0
        while at < last:
            end = at
            while end < last and close[end]:
                end += 1
            if end > at and (end - at > 4 or WIDTHS[0] <= width <= WIDTHS[1]):
                joins[at:end] = _set_to_width(text, lines, size, at, end, width)
            at = max(end, at + 1)
        for i in range(last):  # after a comma a small letter goes on
            if close[i] and not joins[i] and text[lines[i][0] + size[i] - 1] in COMMAS:
                c = text[lines[i + 1][0] : lines[i + 1][1]].lstrip()[0]
                joins[i] = c.isalpha() and not c.isupper()
    start = lines[0][0]
    for i, (_, b) in enumerate(lines):
        if i == last or not joins[i]:
            yield start, b
            if i < last:
                start = lines[i + 1][0]


def _tag_end(text: str, a: int, b: int) -> int:
    for _ in range(2):
        m = _TAG.match(text, a, b)
        if not m:
            break
        a = m.end()
    return a


# words and separators ------------------------------------------------------------------------------------------------


def _script(c: str) -> int:
    o = ord(c)
    name = "latin" if o < 0x370 else "greek" if o < 0x400 or 0x1F00 <= o < 0x2000 else "cyr" if o < 0x530 else "arab" if 0x600 <= o < 0x780 else "deva" if 0x900 <= o < 0x980 else "thai" if 0xE00 <= o < 0xE80 else "hang" if 0xAC00 <= o < 0xD7B0 else "cjk" if _CJK.match(c) else "other"
    return _S[name]


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))


def _shape_of(word: str) -> int:
    if word[-1].isdigit():
        return _L["0"]
    return _L["letter"] if len(word) == 1 else _L["dotted"] if "." in word else _L["short"] if len(word) <= 3 else _L["word"]


class _Cache(dict):
    """Numbers what it hasn't seen yet; ``columns`` hold what ``look`` says of each. Only a cache: it may be emptied at any time."""

    def __init__(self, look, names: tuple[str, ...]):
        super().__init__()
        self.look, self.names, self.rows, self._made = look, names, [], None

    def __missing__(self, key):
        self.rows.append(self.look(key))
        self[key] = n = len(self.rows) - 1
        return n

    def ids(self, keys: list) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
            self.rows, self._made = [], None
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def columns(self) -> dict[str, np.ndarray]:
        """Arrays of what was seen so far; only new rows are turned into arrays."""
        done = len(self._made[self.names[0]]) if self._made else 0
        if done < len(self.rows):
            new = {n: np.array(v, dtype=np.uint64 if n.startswith("h") else np.int64) for n, v in zip(self.names, zip(*self.rows[done:]))}
            self._made = new if not done else {n: np.concatenate([self._made[n], new[n]]) for n in self.names}
        return self._made or {n: np.zeros(0, np.uint64 if n.startswith("h") else np.int64) for n in self.names}


def _look_at_word(w: str) -> tuple:
    """hleft, lshape, script (of its last letter), first script, hright, rshape, rscript, and flags of its ends."""
    a, z = w[0], w[-1]
    alone = len(w) == 1
    cjk_first, cjk_last, thai_first, thai_last = bool(_CJK.match(a)), bool(_CJK.match(z)), bool(_THAI.match(a)), bool(_THAI.match(z))
    if cjk_last:
        left, shape = _hash(_DIGITS.sub("0", w[-2:])), _L["cjk"]
    elif z.isdigit():
        left, shape = _hash("0"), _L["0"]
    elif thai_last:
        left, shape = _hash(w[-3:]), _L["word"]
    else:
        left, shape = _hash(w.casefold()), _shape_of(w)
    letters = [c for c in (z, a) if c.isalpha() or _THAI.match(c)] or [c for c in w if c.isalpha()][-1:]
    script = _script(letters[0]) if letters else 0
    first = _script(letters[-1]) if letters else 0
    if cjk_first:
        right, rshape = _hash(_DIGITS.sub("0", w[:2])), _R["cjk"]
    elif a.isdigit():
        right, rshape = _hash("0"), _R["0"]
    else:
        right, rshape = _hash(w[:3] if thai_first else w), _R["low"] if a.islower() else _R["up"] if a.isupper() else _R["plain"]
    small = z.islower() and (not alone and w[-2].isalpha())
    caseless = z.isalpha() and not z.isupper() and not z.islower() and not cjk_last
    return left, shape, script, first, right, rshape, _script(a), small or caseless, a.isupper(), a.isalpha() and not a.islower(), cjk_first, cjk_last, z.isdigit(), a.isdigit(), _script(z) == _S["greek"]


_WORDS = _Cache(_look_at_word, ("hleft", "lshape", "script", "first", "hright", "rshape", "rscript", "written", "upper", "opens", "cjk_first", "cjk_last", "digit_last", "digit_first", "greek"))


def _closing(s: str, k: int, final: bool) -> bool:
    """Does the quotation mark or bracket at ``k`` of a separator close?"""
    c = s[k]
    if c in CLOSES:
        return True
    after = k == 0 or s[k - 1] in MARKS or s[k - 1] in CLOSES
    if c in STRAIGHT:
        if k > 0 and k + 1 == len(s) and not final:
            return False  # a word follows at once
        return after or (s[k - 1] not in _BLANK and s[k - 1] not in OPENS)
    return c == "“" and after and (final or k + 1 < len(s)) and s[k + 1 : k + 2] not in tuple(OPENS)


def _next(s: str, at: int) -> tuple[int, int]:
    """Kind and hash of the mark at a place of a separator; zeros if a word stands there."""
    y = s[at : at + 1] if at >= 0 else ""
    return (0, 0) if not y else (1 if y in "«“„「『¿¡" else 2 if y in OPENS else 3 if y == '"' else 4, _hash(y))


def _look_at_separator(key: tuple[str, bool, bool]) -> tuple:
    """What stands between two words, or (final) at the end of a block.

    mark, end (where a sentence would end), next (where the one after it would start), word (does the mark follow the word,
    blanks aside), blank (is there one at the end), many (is more than one mark or closing there), tight marks, x and y (kinds
    of what stands before the mark and after the end), hy; closes, opens (of double marks and brackets), single ones; quoted
    (do they close right after the mark), lead (does the opening follow words), and the Thai gap: gap, gap end, veto.
    """
    s, greek, final = key
    run = None
    for m in (_GREEK_RUN if greek else _RUN).finditer(s):
        if m[0][0] not in _GREEK or not s[: m.start()].strip(_BLANK):
            run = m
    flags = [_closing(s, k, final) if c in CLOSES or c in OPENS or c in STRAIGHT else None for k, c in enumerate(s)]
    kinds = [(c, f) for c, f in zip(s, flags) if f is not None and c != "'"]
    closes = sum(1 for c, f in kinds if f and c != "’")
    opens = sum(1 for c, f in kinds if not f and c != "‘")
    single_closes, single_opens = sum(1 for c, f in kinds if f and c == "’"), sum(1 for c, f in kinds if not f and c == "‘")
    opening = next((k for k, f in enumerate(flags) if f is False), len(s))
    lead = not any(c in MARKS or f for c, f in zip(s[:opening], flags)) and not (greek and any(c in _GREEK for c in s[:opening]))
    gap = _GAP.search(s)
    if gap is None or "\n" in s or "\r" in s:
        gap_at = gap_end = -1
        veto = after_quote = False
    else:
        gap_at, gap_end = gap.start(), gap.end()
        after_quote = veto = gap_at > 0 and bool(flags[gap_at - 1])
    if run is None:
        return 0, 0, 0, False, False, False, False, 0, *_next(s, gap_end), closes, opens, single_closes, single_opens, False, lead, gap_at, gap_end, veto, after_quote, 0
    marks, at, n = run[0], run.end(), len(s)
    mark = _SEMICOLON if marks[-1] in _GREEK else _ELLIPSIS if "…" in marks or marks.startswith("..") else _QUESTION if len(marks) > 1 and "?" in marks else MARKS.index(marks[-1]) + 1
    quote = 0
    while at < n:
        if flags[at]:
            quote = quote or ord(s[at])
        elif not (s[at] in _BLANK and s[at] != "\n" and s[at + 1 : at + 2] == "»"):
            break
        at += 1
    end = at
    while at < n and s[at].isspace():
        at += 1
    before = s[: run.start()]
    x = 0 if not before.strip(_BLANK) and before == "" else 1 if before[-1] in _BLANK else 2
    return mark, end, at, not before.strip(_BLANK), at > end, end > run.start() + 1, marks[-1] in TIGHT, x, *_next(s, at), closes, opens, single_closes, single_opens, quote > 0, lead, gap_at, gap_end, veto, after_quote, quote


_SEPARATORS = _Cache(_look_at_separator, ("mark", "end", "next", "word", "blank", "many", "tight", "x", "y", "hy", "closes", "opens", "single_closes", "single_opens", "quoted", "lead", "gap", "gap_end", "veto", "after_quote", "quote"))


def _mix(*parts) -> np.ndarray:
    """One 64-bit hash of several numbers."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return h


# events --------------------------------------------------------------------------------------------------------------


@dataclass
class Events:
    """Open events of some texts, block by block, and what is certain at the ends of blocks. All positions are in the joined texts."""

    starts: np.ndarray  # of blocks, without white space
    ends: np.ndarray
    document: np.ndarray  # of each block
    block: np.ndarray  # of each event
    end: np.ndarray
    next: np.ndarray
    left: np.ndarray  # hash of the type
    left_shape: np.ndarray
    script: np.ndarray
    quoted: np.ndarray  # a quotation closes here
    right: np.ndarray
    right_shape: np.ndarray
    context: np.ndarray  # the right shape in the script
    gap: np.ndarray
    veto: np.ndarray
    inside: np.ndarray  # of a quotation that closes in the block
    held: tuple  # per kind of quotation: (event's quotation or -1, quotations it closes or -1, quotations that end the block)
    final: tuple  # left, left_shape, script of the blocks that end with a certain boundary
    first: tuple  # right, right_shape, context, script of the blocks that begin with one


def _none(n: int = 0) -> np.ndarray:
    return np.zeros(n, np.int64)


def read(texts: list[str]) -> Events:
    """The events of texts. Each text is a document of its own; null texts must be left out."""
    joined = "\x00".join(texts)
    spans: list[tuple[int, int, int, int]] = []
    base = 0
    for d, text in enumerate(texts):
        for a, b in _blocks(text):
            body = _tag_end(text, a, b)
            b -= len(text[a:b]) - len(text[a:b].rstrip())
            a += len(text[a:b]) - len(text[a:b].lstrip())
            spans.append((base + a, base + b, base + min(body, b), d))
        base += len(text) + 1
    ba, bb, body, document = np.array(spans, np.int64).reshape(-1, 4).T
    blanks = bool(_THAI.search(joined))
    pieces = (_WORD if blanks else _PHRASE).split(joined)
    n = len(pieces) // 2
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.cumsum(lengths) - lengths
    ws, we = at[1::2], at[1::2] + lengths[1::2]
    phrases = pieces[1::2]
    # of a phrase the first and the last word matter
    finals = phrases if blanks else [x.rsplit(" ", 1)[-1] for x in phrases]
    wid = _WORDS.ids(finals)
    fid = wid if blanks else _WORDS.ids([x.split(" ", 1)[0] for x in phrases])
    wl = ws if blanks else we - np.fromiter(map(len, finals), np.int64, n)
    heads, prefix, after = _heads(joined, body, bb)
    hid = _WORDS.ids([x or "0" for x in heads])
    w = _WORDS.columns()
    block = np.searchsorted(ba, ws, "right") - 1
    same = np.zeros(n, bool)
    same[:-1] = block[:-1] == block[1:]
    greek = w["greek"][wid].astype(bool)
    seps = pieces[2::2]
    # what stands between words of one block; elsewhere the end of the block is looked at
    keys = [(s, False, False) for s in seps]
    for i in np.flatnonzero(greek & np.fromiter((";" in x or "\u037e" in x for x in seps), bool, n)):
        keys[i] = (seps[i], True, False)
    last = np.flatnonzero(~same)
    for i in last:
        keys[i] = (joined[we[i] : bb[block[i]]], bool(greek[i]), True)
    sid = _SEPARATORS.ids(keys)
    s = {k: v[sid] for k, v in _SEPARATORS.columns().items()}
    in_body = we > body[block]

    # the script at a word is that of the last letter up to it, or of the first one after it
    index = np.arange(n)
    first_word = np.searchsorted(ws, ba[block])
    script = w["script"][wid]
    if not blanks:
        for k in np.flatnonzero((script == 0) & (wl > ws)):  # numbers and the like: the last word with letters
            letters = next((c for c in reversed(phrases[k]) if c.isalpha()), "")
            script[k] = _script(letters) if letters else 0
    seen = np.maximum.accumulate(np.where(script > 0, index, -1)) if n else index
    script_left = np.where(seen >= first_word, script[seen], _S["latin"])
    script_right = np.zeros(n, np.int64)
    if blanks and n:
        ahead = w["first"][wid]
        seen = np.minimum.accumulate(np.where(ahead > 0, index, n)[::-1])[::-1]
        known = np.minimum(seen, n - 1)
        script_right = np.where((seen < n) & (block[known] == block), ahead[known], 0)

    # quotations
    nxt = np.minimum(index + 1, max(n - 1, 0))
    held = []
    filled = np.flatnonzero(after > body)  # what opens before the first word
    first_of = np.searchsorted(ws, after[filled], "right") - 1
    for opens, closes, marks in ((s["opens"], s["closes"], OPENS.replace("‘", "") + '"'), (s["single_opens"], s["single_closes"], "‘")):
        before = _none(n)
        for k, f in zip(filled, first_of):
            before[f] = sum(c in marks for c in prefix[k])
        held.append(_quotations(before, np.where(in_body, closes, 0), np.where(in_body & same, opens, 0), block, same, s["lead"]))

    # open events
    mark, y = s["mark"], s["y"]
    nw = fid[nxt]
    cjk_y = (y == 0) & (w["cjk_first"][nw] > 0)
    opening_y = (y == 1) | (y == 2)
    tight = (s["tight"] > 0) & (cjk_y | opening_y | ((s["x"] == 0) & (w["cjk_last"][wid] > 0)))
    written = ((s["x"] == 0) & (w["written"][wid] > 0)) | (s["x"] == 1) | (s["many"] > 0)
    glued = written & (((y == 0) & ((w["upper"][nw] | w["opens"][nw]) > 0)) | (y == 1) | (y == 3))
    marked = same & in_body & (mark > 0) & ((s["blank"] > 0) | tight | glued)
    thai = same & in_body & (mark == 0) & (s["gap"] >= 0) & (script_left == _S["thai"]) & (script_right[nxt] == _S["thai"])
    e = np.flatnonzero(marked | thai)
    t = thai[e]
    sep = {k: v[e] for k, v in s.items()}
    we_e, wid_e, nw_e = we[e], wid[e], nw[e]
    closing = [h.closing[e] for h in held]
    quoted = marked[e] & (sep["quoted"] > 0) & ((closing[0] >= 0) | (closing[1] >= 0))
    lead = np.where(closing[0] >= 0, held[0].lead[closing[0]], held[1].lead[closing[1]]) if len(e) else _none()
    sc = script_left[e]
    left, left_shape = _left_types(joined, ws, wl, we, wid, s, same, e, t, sc, quoted, lead, w)
    right, right_shape, context = _right_types(sep["y"] > 0, sep["y"], sep["hy"], nw_e, sc, w)
    step = np.diff(we_e, prepend=0) * np.where(sc == _S["cjk"], 3, 1)
    gap = np.searchsorted(np.array(GAPS), step, "left")
    veto = t & ((sep["veto"] > 0) | ((sep["gap"] == 0) & (w["digit_last"][wid_e] > 0)) | ((sep["gap_end"] == lengths[2::2][e]) & (w["digit_first"][nw_e] > 0)))

    # certain boundaries at the ends of blocks
    f = last[in_body[last]]
    f_thai = (mark[f] == 0) & (script_left[f] == _S["thai"])
    f = f[(mark[f] > 0) | f_thai]
    ft = mark[f] == 0
    f_close = [h.closing[f] for h in held]
    f_quoted = ~ft & (s["quoted"][f] > 0) & ((f_close[0] >= 0) | (f_close[1] >= 0))
    f_lead = np.where(f_close[0] >= 0, held[0].lead[f_close[0]], held[1].lead[f_close[1]]) if len(f) else _none()
    final = (*_left_types(joined, ws, wl, we, wid, s, same, f, ft, script_left[f], f_quoted, f_lead, w), script_left[f])
    sure = np.zeros(len(ba), bool)
    block_script = _none(len(ba))
    block_script[block[e][::-1]] = sc[::-1]
    sure[block[e]] = True
    block_script[block[f]] = script_left[f]
    sure[block[f]] = True
    k = np.flatnonzero(sure)
    lone = [prefix[i][:1] for i in k]
    char = np.fromiter(map(bool, lone), bool, len(k))
    hy = np.fromiter((_hash(c) if c else 0 for c in lone), np.uint64, len(k))
    kind = np.fromiter((_next(c, 0)[0] for c in lone), np.int64, len(k))
    first = (*_right_types(char, kind, hy, hid[k], block_script[k], w), block_script[k])

    inside = np.zeros(len(e), bool)
    for h in held:
        inside |= h.within[e] >= 0
    ends_block = [h.ends_block for h in held]
    return Events(
        ba, bb, document, block[e], we_e + np.where(t, sep["gap"], sep["end"]), we_e + np.where(t, sep["gap_end"], sep["next"]), left, left_shape, sc, quoted, right, right_shape, context, gap, veto, inside,
        tuple((h.within[e], c, b) for h, c, b in zip(held, closing, ends_block)), final, first,
    )


def _heads(joined: str, body: np.ndarray, end: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
    """The word that each block's body begins with, else what stands before its first word, and where that word is."""
    heads, prefix, after = [], [], body.copy()
    for k, (a, b) in enumerate(zip(body.tolist(), end.tolist())):
        m = _WORD.match(joined, a, b)
        heads.append(m[0] if m else "")
        if not m and (m := _WORD.search(joined, a, b)):
            prefix.append(joined[a : m.start()])
            after[k] = m.start()
        else:
            prefix.append("" if m else joined[a:b])
    return heads, prefix, after


def _left_types(joined, ws, wl, we, wid, s, same, e, blank, script, quoted, lead, w):
    """Hash and shape number of the left contexts of the words ``e``, the last of phrases that begin at ``ws``; blank: a blank without mark stands there."""
    mark = np.where(blank, _BLANK_MARK, s["mark"][e])
    shape = np.where(s["word"][e] > 0, w["lshape"][wid[e]], _L["none"])
    word = np.where(s["word"][e] > 0, w["hleft"][wid[e]], np.uint64(0))
    # a word of several parts with points between them, as abbreviations have
    before = np.maximum(e - 1, 0)
    point = (e > 0) & (ws[e] == wl[e]) & same[before] & (s["mark"][before] == 1) & (we[before] + 1 == ws[e]) & (shape != _L["none"]) & (shape != _L["0"]) & (shape != _L["cjk"]) & ~blank
    for k in np.flatnonzero(point):
        i = e[k]
        while i > 0 and ws[i] == wl[i] and same[i - 1] and s["mark"][i - 1] == 1 and we[i - 1] + 1 == ws[i]:
            i -= 1
        word[k], shape[k] = _hash(joined[wl[i] : we[e[k]]].casefold()), _L["dotted"]
    after_quote = s["after_quote"][e] > 0
    number = w["digit_last"][wid[e]] > 0
    shape = np.where(blank, np.where(after_quote, _L["quotation and blank"], np.where(number, _L["number and blank"], _L["word and blank"])), shape)
    word = np.where(blank, np.where(after_quote, np.uint64(1), np.where(number, np.uint64(2), w["hleft"][wid[e]])), word)
    shape = np.where(quoted, np.where(lead > 0, _L["quoted after words"], _L["quoted"]), shape)
    word = np.where(quoted, s["quote"][e].astype(np.uint64), word)
    return _mix(1, word, shape * quoted, mark, script), (shape * 32 + mark) * 16 + script


def _right_types(is_char, kind, hy, word, script, w):
    """Hash, shape number and shape number in the script of right contexts: a mark, or the word."""
    shape = np.where(is_char, np.where(kind < 4, _R["open"], _R["punct"]), w["rshape"][word] if len(word) else _none())
    own = np.where(is_char | (shape == _R["0"]), script, 0)
    of = np.where(is_char, hy, w["hright"][word] if len(word) else np.zeros(0, np.uint64))
    letters = np.where((shape >= _R["low"]) & ~is_char, w["rscript"][word] if len(word) else _none(), 0)
    return _mix(2, of, own, is_char), shape * 16 + letters, (script * 8 + shape) * 16 + letters


@dataclass
class _Held:
    within: np.ndarray  # of each word: the closed quotation that the place after it lies in, or -1
    closing: np.ndarray  # the quotation that closes after it, or -1
    lead: np.ndarray  # of each quotation: does it follow words
    ends_block: np.ndarray  # of each quotation: does it close at the end of the block


def _quotations(before, closes, opens, block, same, lead_of) -> _Held:
    """Nested quotations by their outermost one. After each word come closings, then openings; ``before`` are those that open a block."""
    n = len(block)
    i = np.flatnonzero(before | closes | opens)
    within, closing = np.full(n, -1), np.full(n, -1)
    if not len(i):
        return _Held(within, closing, _none(1), np.zeros(1, bool))
    delta = np.stack([before[i], -closes[i], opens[i]], axis=1).ravel()
    of = np.repeat(block[i], 3)
    run = np.cumsum(delta)
    new = np.flatnonzero(np.diff(of, prepend=-1))
    start = np.repeat(run[new] - delta[new], np.diff(np.append(new, len(of))))
    local = run - start
    number = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(of))))
    big = int(np.abs(local).max()) + 1
    low = np.minimum.accumulate(np.minimum(local, 0) - big * number) + big * number  # a closing without opening closes nothing
    depth = local - low
    prior = np.concatenate([[0], depth[:-1]])
    prior[new] = 0
    opened = (prior == 0) & (depth > 0)
    count = np.cumsum(opened) - 1
    shut = (prior > 0) & (depth == 0)
    m = int(opened.sum())
    closed, ends_block, lead = np.zeros(m + 1, bool), np.zeros(m + 1, bool), _none(m + 1)
    word = np.repeat(i, 3)
    closed[count[shut]] = True
    ends_block[count[shut]] = ~same[word[shut]]
    closing[word[shut]] = count[shut]
    at = np.flatnonzero(opened)
    lead[count[at]] = np.where(at % 3 == 2, lead_of[word[at]], 0)
    # the state after the closings of a word is that of the last change up to it
    key = word * 3 + np.tile([0, 1, 2], len(i))
    every = np.arange(n)
    p = np.searchsorted(key, every * 3 + 1, "right") - 1
    known = (p >= 0) & (of[np.maximum(p, 0)] == block)
    p = np.maximum(p, 0)
    open_now = known & (depth[p] > 0) & closed[np.maximum(count[p], 0)]
    within[open_now] = count[p][open_now]
    return _Held(within, closing, lead, ends_block)


# the model -----------------------------------------------------------------------------------------------------------


def _slots(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash in either row."""
    return (h % np.uint64(buckets)).astype(np.int64), ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(buckets)).astype(np.int64)


class Model:
    """Counts (without, with boundary) of left and right types and shapes, and of pairs of neighbouring events."""

    def __init__(self, types: np.ndarray | None = None, left=None, right=None, context=None, follow=None, strength: float = 4.0, pairs: bool = False):
        self.types = np.zeros((2, 1, 2), np.float32) if types is None else types
        self.left = np.zeros((N_LEFT, 2)) if left is None else left
        self.right = np.zeros((N_RIGHT, 2)) if right is None else right
        self.context = np.zeros((N_CONTEXT, 2)) if context is None else context
        f = np.ones((N_GAP, 2, 2)) if follow is None else follow
        self.strength, self.pairs = strength, pairs
        self.steps = np.log((f + 5) / (f.sum(axis=2, keepdims=True) + 10))
        whole = f.sum(axis=1) + 5
        self.steps_over_share = self.steps - np.log(whole / whole.sum(axis=1, keepdims=True))[:, None, :]
        self.follow = self.steps_over_share[0].tolist()
        self.total = 1.0 + self.context.reshape(16, -1, 2).sum(axis=1)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """(n, 2): of the two buckets of each type the one with fewer counts."""
        a, b = (self.types[k][x] for k, x in enumerate(_slots(h, self.types.shape[1])))
        return np.where((a.sum(axis=1) <= b.sum(axis=1))[:, None], a, b).astype(float)

    def potentials(self, e: Events) -> np.ndarray:
        """(n, 2): log P(event | left) P(right | event), backed off from types to shapes."""
        k = self.strength
        shaped = self.left[e.left_shape]
        # where nothing is known, a blank between words of a script without marks is rather a boundary
        lean = 2.0 * (e.left_shape // 512 == _L["word and blank"])
        base = (shaped[:, 1] + 1 + lean) / (shaped.sum(axis=1) + 2 + lean)
        own = self.counts(e.left)
        prior = np.clip((own[:, 1] + k * base) / (own.sum(axis=1) + k), 0.0005, 0.9995)
        seen, of_shape = self.counts(e.right), self.right[e.right_shape]
        rare = ((seen.sum(axis=1) + 1) / (of_shape.sum(axis=1) + 50))[:, None]
        among = (self.context[e.context] + 0.5) / (self.total[e.script] + 5)
        word = (seen + k * rare) / (of_shape + k) * among
        # the words that go on after a kind of quotation are counted apart
        none = word[:, 0]
        if self.pairs:
            pair = self.counts(_mix(3, e.left, e.right))
            apart = (pair[:, 0] + k * word[:, 0]) / (own[:, 0] + k)
            none = np.where(e.quoted & (own[:, 0] > own[:, 1]), apart, none)
        return np.log(np.stack([(1 - prior) * none, prior * word[:, 1]], axis=1))

    def _chain(self, chain: list[tuple[float, float]], gaps: list[int] | None = None) -> list[float]:
        """Posteriors of one chain of events, one after another."""
        alpha, beta = self._messages(chain, [0] * len(chain) if gaps is None else gaps)
        return [1 / (1 + math.exp(max(-50.0, min(50.0, a[0] + b[0] - a[1] - b[1])))) for a, b in zip(alpha, beta)]

    def _messages(self, chain, gaps) -> tuple[list, list]:
        n, steps = len(chain), self.steps_over_share.tolist()
        ahead, back = [tuple(chain[0])], [(0.0, 0.0)] * n
        for k in range(1, n):
            f = steps[gaps[k]]
            ahead.append(tuple(chain[k][e] + _add(ahead[-1][0] + f[0][e], ahead[-1][1] + f[1][e]) for e in (0, 1)))
        for k in range(n - 2, -1, -1):
            f = steps[gaps[k + 1]]
            back[k] = tuple(_add(f[e][0] + chain[k + 1][0] + back[k + 1][0], f[e][1] + chain[k + 1][1] + back[k + 1][1]) for e in (0, 1))
        return ahead, back

    def posteriors(self, e: Events) -> tuple[np.ndarray, np.ndarray]:
        """P(boundary) of each event, and (n, 2, 2) P(event before, event); all chains of blocks are walked side by side, very long ones alone."""
        n = len(e.block)
        if not n:
            return np.zeros(0), np.zeros((0, 2, 2))
        pot, step = self.potentials(e), self.steps_over_share[e.gap]
        head = np.flatnonzero(np.diff(e.block, prepend=-1))
        size = np.diff(np.append(head, n))
        alpha, beta = pot.copy(), np.zeros((n, 2))
        for a, m in zip(head[size > 256], size[size > 256]):
            x, y = self._messages(pot[a : a + m].tolist(), e.gap[a : a + m].tolist())
            alpha[a : a + m], beta[a : a + m] = x, y
        short = size <= 256
        order = np.argsort(-size[short], kind="stable")
        at, many = head[short][order], size[short][order]
        most = int(many[0]) if len(many) else 0
        left = np.searchsorted(-many, -np.arange(1, most + 1), "right")  # chains that have so many events
        for t in range(1, most):
            r = at[: left[t]] + t
            alpha[r] += np.logaddexp(alpha[r - 1, 0, None] + step[r, 0], alpha[r - 1, 1, None] + step[r, 1])
        for t in range(most - 1, 0, -1):
            r = at[: left[t]] + t
            x = pot[r] + beta[r]
            beta[r - 1] = np.logaddexp(step[r, :, 0] + x[:, 0, None], step[r, :, 1] + x[:, 1, None])
        p = 1 / (1 + np.exp(np.clip(alpha[:, 0] + beta[:, 0] - alpha[:, 1] - beta[:, 1], -50, 50)))
        both = np.zeros((n, 2, 2))
        inner = np.ones(n, bool)
        inner[head] = False
        r = np.flatnonzero(inner)
        z = alpha[r - 1, :, None] + step[r] + (pot[r] + beta[r])[:, None, :]
        z = np.exp(z - z.max(axis=(1, 2), keepdims=True))
        both[r] = z / z.sum(axis=(1, 2), keepdims=True)
        return p, both


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


#: What a count is of: types are known by their hash, shapes and steps by their number.
LEFT, RIGHT, PAIR, LEFT_SHAPE, RIGHT_SHAPE, CONTEXT, FOLLOW = range(7)
_COUNT_NAMES = ("side", "script", "key", "no", "yes")


def count_events(e: Events, model: Model | None) -> pd.DataFrame:
    """side, script, key, no, yes: expected counts, added up; without a model those of (open events, certain boundaries).

    Events inside quotations are not counted.
    """
    p, both = model.posteriors(e) if model else (np.zeros(len(e.block)), np.zeros((len(e.block), 2, 2)))
    u = ~e.inside
    y = p[u]
    apart = e.quoted[u]
    go_on = np.where(apart, 0.0, 1 - y) if model else 1 - y
    sc, rows = e.script[u], []

    def add(side, script, key, no, yes):
        key = np.asarray(key).astype(np.uint64)
        rows.append(pd.DataFrame({"side": np.full(len(key), side, np.int32), "script": np.asarray(script, np.int32), "key": key.view(np.int64), "no": no, "yes": yes}))

    add(LEFT, sc, e.left[u], 1 - y, y)
    add(LEFT_SHAPE, sc, e.left_shape[u], 1 - y, y)
    add(RIGHT, sc, e.right[u], go_on, y)
    add(RIGHT_SHAPE, sc, e.right_shape[u], go_on, y)
    add(CONTEXT, sc, e.context[u], go_on, y)
    if model:  # what goes on after a kind of quotation is known only with posteriors
        q = u & e.quoted
        add(PAIR, e.script[q], _mix(3, e.left[q], e.right[q]), 1 - p[q], p[q])
    left, left_shape, script = e.final
    sure = np.ones(len(left))
    add(LEFT, script, left, 0 * sure, sure)
    add(LEFT_SHAPE, script, left_shape, 0 * sure, sure)
    right, right_shape, context, script = e.first
    sure = np.ones(len(right))
    for side, key in ((RIGHT, right), (RIGHT_SHAPE, right_shape), (CONTEXT, context)):
        add(side, script, key, 0 * sure, sure)
    if model and len(p):
        for before in (0, 1):
            add(FOLLOW, _none(int(u.sum())), e.gap[u] * 2 + before, both[u, before, 0], both[u, before, 1])
    return pd.concat(rows, ignore_index=True).groupby(["side", "script", "key"], as_index=False, sort=False)[["no", "yes"]].sum()


def model_of(counts: pd.DataFrame, model: Model | None, buckets: int = BUCKETS) -> Model:
    """The model of folded counts (side, row, key, no, yes): the first one, or the next after ``model``."""
    types = np.zeros((2, buckets, 2), np.float32)
    exact = {LEFT_SHAPE: np.zeros((N_LEFT, 2)), RIGHT_SHAPE: np.zeros((N_RIGHT, 2)), CONTEXT: np.zeros((N_CONTEXT, 2)), FOLLOW: np.zeros((N_GAP * 2, 2))}
    side, key, row, n = counts["side"].to_numpy(), counts["key"].to_numpy(), counts["row"].to_numpy(), counts[["no", "yes"]].to_numpy(float)
    hashed = side <= PAIR
    np.add.at(types, (row[hashed], key[hashed]), n[hashed])
    for k, table in exact.items():
        np.add.at(table, key[side == k], n[side == k])
    follow = exact[FOLLOW].reshape(N_GAP, 2, 2) if model else None
    return Model(types, exact[LEFT_SHAPE], exact[RIGHT_SHAPE], exact[CONTEXT], follow, pairs=model is not None)


#: Share of certain boundaries by whose types the others are judged.
TYPICAL = 0.8
#: Steps of the ratios' histogram to a power of two.
_FINE = 32


def scales(histogram: pd.DataFrame) -> np.ndarray:
    """(script, side): how many boundaries inside blocks there are for a certain one.

    The ratio of open events to certain ones that ``TYPICAL`` of the certain ones keep below, since types differ in how often
    they stand at the ends of blocks. ``histogram`` has the certain ones (weight) by script, side (left or not) and step of
    the ratio. A script that has few takes the ratio of all.
    """
    out = np.ones((len(SCRIPTS), 2))

    def middle(h: pd.DataFrame) -> float:
        h = h.groupby("step")["weight"].sum().sort_index()
        return 2.0 ** ((h.index[np.searchsorted(h.cumsum().to_numpy(), h.sum() * TYPICAL)] + 0.5) / _FINE)

    for left, of_side in histogram.groupby("is_left"):
        out[:, int(left)] = middle(of_side)
        for script, own in of_side.groupby("script"):
            if own["weight"].sum() >= 20:
                out[script, int(left)] = middle(own)
    return out


def first_counts(c: pd.DataFrame, scale: np.ndarray) -> pd.DataFrame:
    """(open events, certain boundaries) of types as counts without and with boundary, before any posterior.

    A type that fills many open events but never a certain boundary has no boundary there either.
    """
    m, y = c["no"].to_numpy(float), c["yes"].to_numpy(float)
    left = c["side"].isin((LEFT, LEFT_SHAPE)).to_numpy()
    share = np.minimum(1.0, scale[c["script"].to_numpy(), left.astype(int)] * y / np.where(m > 0, m, 1.0))
    share = share**2 / (share**2 + (1 - share) ** 2)  # a word beside a mark is mostly of one kind
    return c.assign(no=np.where(m > 0, m * (1 - share), 0.0), yes=np.where(m > 0, m * share, y))


_typed = f"side in ({LEFT}, {RIGHT}) and yes >= 3 and no > 0"


def _first_distributed(counts: DataFrame) -> DataFrame:
    """``first_counts`` of a distributed table: only the histogram, which is bounded, leaves it."""
    step = F.floor(F.log2(F.col("no") / F.col("yes")) * _FINE).cast("int")
    histogram = counts.where(_typed).groupBy("script", (F.col("side") == LEFT).alias("is_left"), step.alias("step")).agg(F.sum("yes").alias("weight")).toPandas()
    scale = scales(histogram)

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield first_counts(batch, scale)

    return counts.select(*_COUNT_NAMES).mapInPandas(split, _counts_type)


def fold(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Counts of types in the buckets of both rows, those of shapes and steps as they are: at most 2 x ``buckets`` rows besides."""
    mask, odd = buckets - 1, 0x9E3779B1 & (buckets - 1)  # the buckets of _slots
    low, high = F.expr(f"key & {mask}L"), F.expr(f"((shiftrightunsigned(key, 32) & {mask}L) * {odd}L) & {mask}L")
    hashed = F.array(F.struct(F.lit(0).alias("row"), low.alias("key")), F.struct(F.lit(1).alias("row"), high.alias("key")))
    each = F.when(F.col("side") <= PAIR, hashed).otherwise(F.array(F.struct(F.lit(0).alias("row"), F.col("key").alias("key"))))
    side = F.greatest("side", F.lit(PAIR)).alias("side")  # a hash tells the sides apart
    return counts.select(side, "no", "yes", F.explode(each).alias("x")).groupBy("side", F.col("x.row").alias("row"), F.col("x.key").alias("key")).agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


# texts ---------------------------------------------------------------------------------------------------------------


def cuts(e: Events, p: np.ndarray) -> np.ndarray:
    """Which events end a sentence: those that the posteriors choose, after the exact checks."""
    chosen = (p > 0.5) & ~e.veto
    out = chosen.copy()
    for within, closing, ends_block in e.held:
        goes = np.zeros(len(ends_block) + 1, bool)
        goes[: len(ends_block)] = ends_block
        goes[closing[chosen & (closing >= 0)]] = True
        out &= (within < 0) | goes[within]
    return out


def _cut_spans(e: Events, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, start, end) of each sentence, in order; positions are in the joined texts."""
    cut = cuts(e, model.posteriors(e)[0])
    starts = np.sort(np.concatenate([e.starts, e.next[cut]]))
    ends = np.sort(np.concatenate([e.ends, e.end[cut]]))
    of = e.document[np.searchsorted(e.starts, starts, "right") - 1] if len(starts) else _none()
    return of, starts, ends


def _bases(texts: list[str]) -> np.ndarray:
    """Where each text begins in the joined ones."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return np.cumsum(sizes) - sizes


def sentence_spans(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of each sentence, in order; together they hold every character that isn't white space."""
    if not text:
        return []
    _, a, b = _cut_spans(read([text]), model)
    return list(zip(a.tolist(), b.tolist()))


def document_counts(text: str, model: Model | None, left: dict, right: dict, follow: dict) -> None:
    """Adds the expected counts [no, yes] of one text, by (side, script, key)."""
    for r in count_events(read([text]), model).itertuples(index=False):
        table = left if r.side in (LEFT, LEFT_SHAPE) else follow if r.side == FOLLOW else right
        table[r.side, r.script, r.key][0] += r.no
        table[r.side, r.script, r.key][1] += r.yes


def next_model(tables: dict[str, dict], model: Model | None, buckets: int = 1 << 14) -> Model:
    """The model of tables that ``document_counts`` filled, in memory."""
    c = pd.DataFrame([(*k, *v) for t in tables.values() for k, v in t.items()], columns=_COUNT_NAMES)
    if model is None:
        typed = c[c["side"].isin((LEFT, RIGHT)) & (c["yes"] >= 3) & (c["no"] > 0)]
        steps = np.floor(np.log2(typed["no"] / typed["yes"]) * _FINE).astype(int)
        c = first_counts(c, scales(pd.DataFrame({"script": typed["script"], "is_left": typed["side"] == LEFT, "step": steps, "weight": typed["yes"]})))
    folded = []
    for row, slot in enumerate(_slots(c["key"].to_numpy(np.int64).view(np.uint64), buckets)):
        hashed = (c["side"] <= PAIR).to_numpy()
        own = c.assign(row=row, key=np.where(hashed, slot, c["key"]))
        folded.append(own if row == 0 else own[hashed])
    return model_of(pd.concat(folded, ignore_index=True), model, buckets)


def _chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers, texts) of about CHUNK characters; a longer text is alone. Texts with Thai are read apart, since their blanks count."""
    held: dict[bool, list[int]] = {False: [], True: []}
    size = {False: 0, True: 0}
    for k, x in enumerate(texts):
        kind = bool(_THAI.search(x))
        if held[kind] and size[kind] + len(x) > CHUNK:
            yield np.array(held[kind]), [texts[i] for i in held[kind]]
            held[kind], size[kind] = [], 0
        held[kind].append(k)
        size[kind] += len(x)
    for own in held.values():
        if own:
            yield np.array(own), [texts[i] for i in own]


_counts_type = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("script", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("no", T.DoubleType()), T.StructField("yes", T.DoubleType())])
_spans_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sent_start", T.LongType()), T.StructField("sent_end", T.LongType())])


_events_type = T.StructType([T.StructField("events", T.BinaryType())])
#: Stands for a null number of a document in between.
_NO_ID = -(2**63)
_HELD = ("within", "closing", "ends_block")


def pack(e: Events, ids: np.ndarray, base: np.ndarray) -> bytes:
    """Events of some texts as bytes, with the texts' numbers and where each begins."""
    part = {f.name: getattr(e, f.name) for f in fields(Events) if f.name not in ("held", "final", "first")}
    part |= {f"held{i}{n}": x for i, h in enumerate(e.held) for n, x in zip(_HELD, h)}
    part |= {f"final{i}": x for i, x in enumerate(e.final)} | {f"first{i}": x for i, x in enumerate(e.first)}
    part |= {"ids": ids, "base": base}
    heads, body = [], []
    for name, x in part.items():
        if x.dtype == np.int64 and name != "ids" and len(x):  # numbers take the room they need
            low, high = x.min(), x.max()
            x = x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))
        heads.append((name, x.dtype.str, len(x)))
        body.append(x.tobytes())
    head = json.dumps(heads).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(body), 1)


def unpack(blob: bytes) -> tuple[Events, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    part = {}
    for name, kind, n in json.loads(raw[4:at]):
        x = np.frombuffer(raw, np.dtype(kind), n, at)
        at += x.nbytes
        part[name] = x.astype(np.int64) if x.dtype.kind == "i" else x
    held = tuple(tuple(part.pop(f"held{i}{n}") for n in _HELD) for i in range(2))
    final, first = (tuple(part.pop(f"{k}{i}") for i in range(n)) for k, n in (("final", 3), ("first", 4)))
    ids, base = part.pop("ids"), part.pop("base")
    return Events(**part, held=held, final=final, first=first), ids, base


def events_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(events): the open events of all texts, some texts a row. Training and splitting go over them as often as they need, without the texts."""

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = batch[[bool(x) for x in batch["t"]]]
            ids = kept["doc_id"].to_numpy(np.int64)
            for numbers, texts in _chunks(kept["t"].tolist()):
                yield pd.DataFrame({"events": [pack(read(texts), ids[numbers], _bases(texts))]})

    number = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID))
    return docs.select(number.alias("doc_id"), F.col(text).alias("t")).where("t is not null").mapInPandas(find, _events_type)


def expected_counts(events: DataFrame, model: Model | None) -> DataFrame:
    """(side, script, key, no, yes): expected counts of all events, added up per batch before they are shuffled."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [count_events(unpack(x)[0], model) for x in batch["events"]]
            if found:
                yield pd.concat(found, ignore_index=True).groupby(["side", "script", "key"], as_index=False, sort=False)[["no", "yes"]].sum()

    return events.mapInPandas(count, _counts_type).groupBy("side", "script", "key").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))


def train_events(events: DataFrame, rounds: int = 1, buckets: int = BUCKETS) -> Model:
    """The model after a count of certain boundaries and ``rounds`` of expectation maximisation over all ``events``.

    The counts of all types are one distributed table; only what it is folded into, bounded by ``buckets`` (a power of 2),
    comes to the driver. An empty table gives the model without counts.
    """
    model = None
    for _ in range(rounds + 1):
        counted = expected_counts(events, model)
        if model is None:
            counted = _first_distributed(cut_lineage(counted))
        model = model_of(fold(counted, buckets).toPandas(), model, buckets)
    return model


def split_events(events: DataFrame, model: Model) -> DataFrame:
    """(doc_id, sent_start, sent_end) in code points; texts without number have a null one."""

    def split(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch["events"]:
                e, ids, base = unpack(x)
                of, a, b = _cut_spans(e, model)
                yield pd.DataFrame({"doc_id": ids[of], "sent_start": a - base[of], "sent_end": b - base[of]})

    found = events.mapInPandas(split, _spans_type)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))


def train(docs: DataFrame, rounds: int = 1, text: str = "text", buckets: int = BUCKETS) -> Model:
    """``train_events`` of the texts of ``docs``."""
    return train_events(cut_lineage(events_of(docs.withColumn("_no", F.lit(0)), "_no", text)), rounds, buckets)


def split_sentences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sent_start, sent_end) in code points. Null and blank texts have no sentences; repeated rows are split each."""
    return split_events(events_of(docs, doc_id, text), model)
