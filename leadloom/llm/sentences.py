"""Sentence boundaries in texts of many languages and scripts.

Method: a pushdown automaton. It reads a block of running text from left to
right, keeps the open quotations and brackets on a stack, and emits a boundary
at a terminator only when the stack is empty; tries of abbreviations (walked
backwards from a period) and the scripts' terminators decide what ends a
sentence. A second stack holds the open list levels: an item begins a block,
and lines indented to its text belong to it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, without the last period, lower case.
#: never the end of a sentence
BEFORE_NAME = """
 dr mr ms mrs prof st sr jr gen lt col capt rev hon fr hr frl mme mlle mm sra srta dra lic ing arq av avda ud uds d dña mgr me
 vs e.g i.e cf bzw z.b d.h u.a ggf evtl vgl inkl incl excl exkl sog insb dt engl hl p.ex p.ej ex ej env aprox
 т.е см им ул пр пер просп г-н г-жа акад проф
 κ κα κος δρ καθ π.χ δηλ αρ σελ βλ
 डॉ श्री प्रो सुश्री पं कु د أ م ا.د ee
""".split()
#: not the end of a sentence before a number; before a capital it may be one
BEFORE_NUMBER = """
 no nr nos p pp s abs art app fig figs sec vol ch chap eq tab tel ext approx ca max min mind max est núm núms pág págs cap art aprt env circa
 jan feb mar apr jun jul aug sep sept oct okt nov dec dez märz ene abr ago dic janv févr avr juil août déc str стр гл рис п ст № r v op cit
""".split()
#: ends a sentence if one begins behind it
MAY_END = """
 inc corp ltd co llc plc gmbh ag etc usw al a.m p.m am pm u.s u.k u.s.a u.n s.a s.l n.v b.v n.a uu rd ave blvd dept uvm usf
 т.д т.п др руб коп мес млн млрд тыс гг κ.λπ κλπ κ.ά jan feb mon tue wed thu fri sat sun
""".split()
#: months, behind an ordinal number
MONTHS = """
 januar februar märz april mai juni juli august september oktober november dezember jänner january february march may june july october december
""".split()
#: words before a German ordinal number
ARTICLES = "der die das dem den des am vom zum zur beim im ins ab bis seit jede jeder jedes".split()
#: Thai: words that begin a sentence behind a Latin word, and words that need the word behind them
THAI_STARTS = "คุณ เรา ทีม บริษัท ผู้สมัคร รายได้ งาน สมัคร หาก ถ้า ทำไม โปรด กรุณา ผม ฉัน เขา พวกเขา ท่าน".split()
THAI_NEEDS = "ใช้ กับ คุณ อย่างน้อย พนักงาน ภายใน เพิ่มขึ้น ลดลง และ หรือ ที่ ของ ใน จาก ถึง โดย ประมาณ มี เป็น กว่า ละ รุ่น เวอร์ชัน คือ ด้วย เพื่อ ต่อ ตาม แก่ ให้ ณ บน ว่า ชื่อ นาย นาง นางสาว ดร".split()

_HARD = "。！？｡！？।॥؟۔።፧։"  # end a sentence whatever follows (but for closing marks)
_MARKS = ".!?…‥;;" + _HARD + "．"
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "“": "”", "„": "“", "«": "»", "‹": "›", "»": "«", "”": "”", '"': '"'}
_CLOSERS = set(_PAIRS.values())
_BRACKETS = set("([{（［【")
_EVENT = re.compile("[" + re.escape(_MARKS + "".join(_PAIRS) + "".join(_CLOSERS)) + "]")
_EMOJI = "\U0001f000-\U0001faff☀-➿⬀-⯿️‍⃣\U000e0020-\U000e007f"
_AFTER = re.compile(f"(?:\\s*[{_EMOJI}]+)+")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_ITEM = re.compile(r"\s*(?:[-*•◦‣▪▫●○■□–·⁃∙➢✓]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][)]\s+)")
_NUMBERED = re.compile(r"\s*\(?\d{1,3}[.)]\s")
_SOFT_ITEM = re.compile(r"\s*(?:\d{1,3}\.\s|–\s)")
_THAI = re.compile("[฀-๿]")
#: a name that ends a sentence, before another that begins one with a verb behind it
_THAI_NAMES = re.compile(r"(?:กับ|และ|ใช้|ของ|จาก)\s+([A-ZÀ-Ž]\S*)\s+(?=(?:[A-ZÀ-Ž]\S*\s+)+(?:เปิด|ประกาศ|ก่อตั้ง|ย้าย|ขยาย))")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_WORD = re.compile(r"\w*")
_THAI_GAP = re.compile(r"(?<=\S)[^\S\n\r]+(?=\S)|(?<=\S)\s+(?=\S)")
_DENSE = re.compile("[\u0e00-\u0e7f\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff01-\uff60]")
#: widest line whose wrapping a single break that may be a paragraph's end can show
LONE_WIDTH = 132
_BLANK = "﻿"


def _trie(words: Iterable[str]) -> dict:
    """Abbreviations by their letters from the last to the first; "" marks a whole one."""
    root: dict = {}
    for word in words:
        node = root
        for letter in reversed(word):
            node = node.setdefault(letter, {})
        node[""] = True
    return root


_NAME_TRIE, _NUMBER_TRIE, _END_TRIE = _trie(BEFORE_NAME), _trie(BEFORE_NUMBER), _trie(MAY_END)


def _in_trie(trie: dict, word: str) -> bool:
    node = trie
    for letter in reversed(word):
        node = node.get(letter)
        if node is None:
            return False
    return "" in node


def _caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _greek(c: str) -> bool:
    return "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿"


class _Automaton:
    """Boundaries of one block text[begin:end]; line breaks in it are soft."""

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.text, self.begin, self.end = text, begin, end
        self.floor = begin  # where the current sentence begins: no word reaches behind it
        self.match = self._pairs()
        self.greek = bool(_GREEK.search(text, begin, end))

    def _pairs(self) -> dict[int, int]:
        """Openers with their closers; unmatched ones are ordinary characters."""
        text, out, stack = self.text, {}, []
        for event in _EVENT.finditer(text, self.begin, self.end):
            c, at = event.group(), event.start()
            if c not in _PAIRS and c not in _CLOSERS:
                continue
            found = next((k for k in range(len(stack) - 1, -1, -1) if c == _PAIRS[stack[k][0]] or (c == "”" and stack[k][0] == "„")), None)
            if c == '"' and found is None and at + 1 < self.end and text[at + 1].isspace():
                continue  # a straight mark before a space opens nothing (an inch)
            if found is not None and not (c == "“" and stack[found][0] == "„" and at + 1 < self.end and text[at + 1].isalnum()):
                out[stack[found][1]] = at
                del stack[found:]
            elif c in _PAIRS and c not in "”»":
                stack.append((c, at))
            elif c == "»" and at + 1 < self.end and text[at + 1].isalnum():
                stack.append((c, at))  # »German« quotation
        return out

    def _skip(self, i: int) -> int:
        text, end = self.text, self.end
        while i < end and (text[i].isspace() or text[i] == _BLANK):
            i += 1
        return i

    def _first(self, i: int) -> int:
        """The place of the first letter, digit or symbol behind openers, dashes and inverted marks."""
        text, end = self.text, self.end
        while i < end and (text[i].isspace() or text[i] in _PAIRS or text[i] in "¿¡—–-‘’'•*‹" + _BLANK):
            i += 1
        return i

    def _begins(self, i: int, caseless: bool = True) -> bool:
        """Whether a sentence can begin at the next character from i on."""
        k = self._skip(i)
        if k >= self.end:
            return True
        c = self.text[k]
        if c in ",;:)]}»”،؛、，；：" and k not in self.match:
            return False
        if c in "—–-" and k + 1 < self.end and self.text[k + 1].isspace():
            return False
        f = self._first(k)
        if f >= self.end:
            return True
        c = self.text[f]
        if c.islower():
            return f + 1 < self.end and self.text[f + 1].isupper()
        if _caseless(c):
            return caseless
        return True

    def _word(self, at: int) -> str:
        """The word before a period at the place given, lower case, inner periods kept."""
        text, i = self.text, at
        while i > self.floor and not text[i - 1].isspace() and text[i - 1] not in "([{«“„\"'‘¿¡—–/（「『《,;:":
            i -= 1
        return text[i:at]

    def _period(self, at: int, stop: int) -> bool:
        """Whether a single period ends a sentence; stop: the place behind it."""
        text, end = self.text, self.end
        word = self._word(at)
        low = word.lower()
        gap = stop < end and (text[stop].isspace() or text[stop] == _BLANK)
        # two-part abbreviations: "z. B.", "p. m.", "т. д."
        before = ""
        if gap or stop >= end:
            i = at - len(word)
            j = i
            while j > self.floor and text[j - 1].isspace():
                j -= 1
            if j < i and j > self.floor and text[j - 1] == ".":
                before = self._word(j - 1).lower()
        pair = f"{before}.{low}" if before else low
        if stop >= end:
            return True
        if not gap:
            c = text[stop]
            if c.isupper() and (stop + 1 >= end or text[stop + 1].islower() or text[stop + 1] in ".’'&" or text[stop + 1].isspace()):
                if _in_trie(_NAME_TRIE, low) or not word:
                    return False
                tail = word.rsplit(".", 1)[-1]
                return len(tail) > 1 or word[-1].isdigit() or _in_trie(_END_TRIE, low)
            if _caseless(c) and word and _caseless(word[-1:]) or (c in _PAIRS and stop in self.match or c in "¿¡") and len(word) > 1:
                return not (_in_trie(_NAME_TRIE, low) or len(word) == 1)
            return bool(word) and unicodedata.category(word[-1])[0] == "M" and _caseless(c) and not _in_trie(_NAME_TRIE, low)
        if not self._begins(stop):
            return False
        if not word:
            return True
        if before:
            if _in_trie(_END_TRIE, pair):
                return True
            if _in_trie(_NAME_TRIE, pair):
                return False
        f = self._first(stop)
        follows = text[f] if f < end else " "
        if _in_trie(_END_TRIE, low) and "." in low:
            return not follows.isdigit()
        if _in_trie(_NAME_TRIE, low):
            return False
        if len(word) == 1 and word.isalpha():
            return False  # an initial
        if follows.isdigit() and (_in_trie(_NUMBER_TRIE, low) or low.endswith("str")):
            return False
        if _in_trie(_END_TRIE, low):
            return not follows.isdigit()
        if word.isdigit() and len(word) <= 2:
            if _WORD.match(text, f, end).group().lower() in MONTHS:
                return False
            i = at - len(word)
            while i > self.floor and text[i - 1].isspace():
                i -= 1
            if self._word(i).lower() in ARTICLES:
                return False
        return True

    def boundaries(self) -> list[int]:
        """Ends of the sentences of the block but for the last (places behind the last character and its marks)."""
        text, end, match = self.text, self.end, self.match
        item = _ITEM.match(text, self.begin, end)
        i = item.end() if item else self.begin
        start, out = i, []
        thai = bool(_THAI.search(text, self.begin, end))
        while True:
            event = _EVENT.search(text, i, end)
            if thai:
                self._thai(start if not out else max(start, out[-1]), i, event.start() if event else end, out)
            if event is None:
                break
            at, c = event.start(), event.group()
            i = at + 1
            if at in match:
                close = match[at]
                i = close + 1
                last = close - 1
                while last > at and (text[last].isspace() or text[last] in _CLOSERS or ord(text[last]) >= 0x1F000):
                    last -= 1
                closed = last > at and text[last] in _MARKS and (text[last] not in ";;" or _greek(text[last - 1])) and text[last] not in ";"
                if not closed or i >= end:
                    continue
                if text[i] in _MARKS:
                    continue
                alone = not text[start:at].strip(" \t\n\r —–-")
                if c in _BRACKETS:
                    if not alone or not self._begins(i):
                        continue
                elif not self._begins(i, caseless=False):
                    continue
                i = self._emit(i, out)
                start = i
                continue
            if c not in _MARKS:
                continue
            stop = i
            while stop < end and (text[stop] in _MARKS and text[stop] not in ";" or text[stop] in _CLOSERS and stop not in match and text[stop] not in '"“«»'):
                stop += 1
            run = text[at:stop]
            if c in ";;":
                if c == ";" and not (self.greek and any(map(_greek, text[self.floor : at]))):
                    continue
                ends = self._begins(stop)
            elif any(x in _HARD for x in run):
                k = self._skip(stop)
                ends = k >= end or text[k] not in ",、，)）」』》”»" or k in match
            elif "…" in run or "‥" in run or run.startswith(".."):
                gap = stop < end and text[stop].isspace()
                ends = stop >= end or (gap and self._begins(stop, caseless=False))
                if any(x in "!?" for x in run):
                    ends = ends or self._begins(stop)
            elif run[0] == "." and len(run) == 1:
                ends = self._period(at, stop)
            elif c == "．":
                ends = not (stop < end and text[stop].isdigit())
            else:
                gap = stop >= end or not (text[stop].isalnum() and not text[stop].isupper() and not _caseless(text[stop]))
                ends = gap and self._begins(stop)
            if not ends:
                emoji = _AFTER.match(text, stop, end)
                if emoji and self._begins(emoji.end()):
                    ends = run not in (".",) or self._period(at, stop)
            i = stop
            if ends:
                i = self._emit(stop, out)
                start = i
        if thai:
            out += [found.end(1) for found in _THAI_NAMES.finditer(text, self.begin, end)]
        return [b for b in out if b < end]

    def _emit(self, stop: int, out: list[int]) -> int:
        """A boundary behind stop and the emoji that follow it."""
        emoji = _AFTER.match(self.text, stop, self.end)
        if emoji:
            stop = emoji.end()
        self.floor = stop
        out.append(stop)
        return stop

    def _thai(self, start: int, begin: int, end: int, out: list[int]) -> None:
        """Boundaries at spaces next to Thai words between two events."""
        text = self.text
        for gap in _THAI_GAP.finditer(text, begin, end):
            a, b = gap.start(), gap.end()
            left, right = text[a - 1], text[b]
            if a <= start or not (_THAI.match(left) or _THAI.match(right)):
                continue
            if _THAI.match(left):
                w = a
                while w > start and not text[w - 1].isspace():
                    w -= 1
                word = text[w:a]
                needs = any(word.endswith(n) for n in THAI_NEEDS)
                ends = not needs if _THAI.match(right) or right.isupper() else False
            else:
                ends = right == "เ" and text.startswith("เรา", b) or any(text.startswith(w, b) for w in THAI_STARTS)
            if ends:
                out.append(a)


def _fits(text: str, line: tuple[int, int], following: tuple[int, int], width: int) -> bool:
    """Whether the next line's first word had room behind the line (a wide character has no space before it)."""
    word = text[following[0] : following[1]].lstrip(" \t").split(" ", 1)[0]  # no-break spaces hold words together
    need = 1 if ord(word[0]) >= 0x2E80 else 1 + min(len(word), 48)
    return line[1] - line[0] + need <= width


def _is_wrapped(text: str, lines: list[tuple[int, int]], dense: list[bool], side: bool, width: int) -> bool:
    """Whether the lines of one kind (with or without a dense script) are hard-wrapped at the width.

    Its witnesses are the breaks between two lines. Within a sentence for sure
    (behind a letter, comma or period, before a small letter): those where the next word
    had no room must be more than those where it had. Without small letters, or
    where capitals happen to follow: breaks behind no end mark (or an abbreviation) where the next
    word had no room, against all breaks where it had. Dense scripts leave out
    end marks and small letters; they need three such breaks behind a letter.
    """
    sure = unsure = full = loose = 0
    for k in range(len(lines) - 1):
        (s, e), (ns, ne) = lines[k], lines[k + 1]
        line, following = text[s:e].rstrip(), text[ns:ne].lstrip()
        if dense[k] != side or not line or not following or e - s > width or _ITEM.match(text, s, e) or _ITEM.match(text, ns, ne):
            continue
        last, first = line[-1], following[0]
        fits = _fits(text, lines[k], lines[k + 1], width)
        word = line[max(line.rfind(" "), line.rfind("\u00a0")) + 1 : -1].lower()
        abbreviated = last == "." and (_in_trie(_NAME_TRIE, word) or _in_trie(_NUMBER_TRIE, word))
        open_end = abbreviated or last == ";" or (last not in _MARKS and last not in _CLOSERS)
        small = first.islower() and not following[1:2].isupper()
        if small and last in ".…" or (last.isalnum() or last in ",،、，" or unicodedata.category(last)[0] == "M") and (small or (side and _caseless(first))):
            sure, unsure = sure + (not fits), unsure + fits
        full, loose = full + (open_end and not fits), loose + fits
    if side:
        return sure >= 3 and sure > unsure
    return sure > unsure or (sure == unsure and full > loose and (full > 1 or width <= LONE_WIDTH))


def _list_level(text: str, line: tuple[int, int], levels: list[int]) -> bool:
    """Moves the stack of open list levels (the column of each level's text) over
    a line: items close the levels they don't stand in and open their own, other lines close
    those they are not indented to. True if the line continues the item on top."""
    at = line[0]
    while at < line[1] and text[at] in " \t":
        at += 1
    if at == line[1]:
        return False  # a blank line leaves the lists open
    column = at - line[0]
    while levels and levels[-1] > column:
        levels.pop()
    item = _ITEM.match(text, *line)
    if item:
        levels.append(item.end() - line[0])
    return bool(levels) and not item


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of running text: lines, those of hard-wrapped paragraphs and of items with a hanging indent joined.

    The width is that of the longest line of the kind (with or without a dense
    script) that is no list item; breaks within sentences must show that the
    lines are wrapped at it, whatever it is. A break is soft then if the
    next line's first word didn't fit, the next line is no list item and
    neither line is blank.
    """
    lines, at = [], 0
    for brk in _LINE.finditer(text):
        lines.append((at, brk.start()))
        at = brk.end()
    lines.append((at, len(text)))
    # scripts without spaces are wrapped by themselves, or not at all
    dense = [bool(_DENSE.search(text, s, e)) for s, e in lines]
    widths = [max((e - s for (s, e), d in zip(lines, dense, strict=True) if d == side and not _ITEM.match(text, s, e)), default=0) for side in (False, True)]
    wrapped = [_is_wrapped(text, lines, dense, side, widths[side]) for side in (False, True)]
    levels: list[int] = []
    hanging = [_list_level(text, line, levels) for line in lines]
    begin = None
    for k, (s, e) in enumerate(lines):
        if begin is None:
            begin = s
        if k + 1 < len(lines) and hanging[k + 1] and text[s:e].strip():
            continue
        width = widths[dense[k]]
        if wrapped[dense[k]] and k + 1 < len(lines):
            ns, ne = lines[k + 1]
            if text[ns:ne].strip() and e - s <= width and text[s:e].strip():
                fits = _fits(text, lines[k], lines[k + 1], width)
                item = _ITEM.match(text, ns, ne)
                if item and _SOFT_ITEM.match(text, ns, ne) and not fits:
                    # a number or dash that the wrapping brought to a line's start
                    open_end = text[e - 1].isalpha() and not _ITEM.match(text, s, e)
                    item = None if open_end and not _NUMBERED.match(text, begin, e) else item
                if not fits and not item:
                    continue
        yield begin, e
        begin = None


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit of a text, in code points, end
    exclusive, without white space or U+FEFF at either end. Together they cover
    all other characters. Empty and blank texts have none."""
    out = []
    for begin, end in _blocks(text):
        if begin >= end:
            continue
        edges = [begin, *sorted(set(_Automaton(text, begin, end).boundaries())), end]
        for s, e in zip(edges, edges[1:], strict=False):
            while s < e and (text[s].isspace() or text[s] == _BLANK):
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] == _BLANK):
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, sent_start, sent_end: the sentence units of every whole text. Null,
    empty and blank texts have none; repeated doc_ids keep their own rows; lang
    is not used (it is often missing or wrong), other columns are not read."""

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = array("q"), array("q"), array("q")
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text or not doc.is_valid:
                    continue
                doc = doc.as_py()
                for s, e in sentence_spans(text):
                    ids.append(doc)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, ends)], names=["doc_id", "sent_start", "sent_end"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut_texts, "doc_id bigint, sent_start bigint, sent_end bigint")
