"""Wrong decodings of a piece of text and what each would have been."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, lru_cache

LOST = "�"
ENTITY = r"&(?:[A-Za-z]{2,8}[0-9]{0,2}|#[0-9]{2,6}|#x[0-9A-Fa-f]{2,5});"
#: Letters and characters beyond ASCII without a break, at least one beyond ASCII or escaped.
UNIT = re.compile(rf"[A-Za-z]*+(?:[^\x00-\x7f]|{ENTITY})(?:[A-Za-z]|[^\x00-\x7f]|{ENTITY})*+")
#: Words of the model: one ideograph; a run of letters, with signs within that don't part words;
#: or one other character beyond ASCII.
_LETTERS = r"[^\W\d_぀-ヿ㐀-鿿]+"
_PARTING = "\u00a0\u00ad\ufeff“”„‘’‚–—…«»·"
WORD = re.compile(rf"[぀-ヿ㐀-鿿]|{_LETTERS}(?:[^\x00-\x7f\w{_PARTING}\u2000-\u200f\u3000-\u303f\uff00-\uffef]+{_LETTERS})*|[^\x00-\x7f]")
#: Punctuation and signs that may stand among restored letters.
SIGNS = set("“”„‘’‚–—…«»¿¡°µ×±§№·•€£½¼²³™©®ªº")

# Decoders that showed the bytes, and encodings that single bytes may have had.
SHOWN = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15", "cp866"]
SINGLE = {
    "cp1252": ["cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254", "koi8_r", "iso8859_2", "cp866", "gb2312"],
    "latin-1": ["cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254", "koi8_r", "iso8859_2", "cp866", "gb2312"],
    "cp437": ["cp1252", "cp1250", "cp1251", "cp1254", "mac_roman", "gb2312"],
    "cp850": ["cp1252", "cp1250", "cp1254"],
    "mac_roman": ["cp1252", "cp1250", "cp1254", "cp1251"],
    "cp1250": ["cp1252", "cp1251", "cp1254", "iso8859_2", "cp437"],
    "cp1251": ["cp1252", "cp1250", "koi8_r", "cp866", "gb2312", "cp1254"],
    "koi8_r": ["cp1251", "cp1252", "cp866", "gb2312"],
    "cp866": ["cp1251", "koi8_r"],
    "iso8859_2": ["cp1252", "cp1250"],
    "cp1254": ["cp1252", "cp1250"],
}

def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes the codec doesn't have are the control characters of their number."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if codec != "latin-1":
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


TABLES = {c: _bytes_of(c) for c in SHOWN}


def _options(table: dict[str, int], c: str) -> tuple[int, ...]:
    """Bytes a character may stand for; a change of case may have come after the damage."""
    found = [table[x] for x in dict.fromkeys((c, c.upper(), c.lower())) if x in table]
    return tuple(dict.fromkeys(found))


#: Stand for a UTF-8 character of which the first byte is known and another is lost (U+E100 + that byte).
PART = 0xE100
GONE = rf"[{LOST}{chr(PART + 0x80)}-{chr(PART + 0xFF)}]"
#: Paths through a lattice that are kept where characters may stand for several bytes.
READINGS = 8


@cache
def _class(shown: str, low: int, high: int) -> str:
    """A character class of what may stand for bytes from `low` to `high`."""
    marks = {x for c, b in TABLES[shown].items() if low <= b <= high for x in (c, c.upper(), c.lower()) if len(x) == 1 and x > "\x7f"}
    return "[" + re.escape("".join(sorted(marks))) + "]"


@cache
def _may_hold(shown: str) -> re.Pattern:
    """Finds a first byte and a second one, which may be lost."""
    return re.compile(_class(shown, 0xC2, 0xF4) + f"(?:{_class(shown, 0x80, 0xBF)}|{LOST})")


def arcs(text: str, at: int, shown: str) -> list[tuple[int, str]]:
    """The arcs of the byte lattice from a position: (end, character) of each UTF-8 character whose
    bytes the characters up to `end` may stand for.

    A lost character is a wildcard, any later byte; the UTF-8 character is then known by its
    first byte (`PART`).
    """
    found: dict[tuple[int, str], None] = {}
    table = TABLES[shown]
    for lead in _options(table, text[at]):
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if not size or at + size > len(text):
            continue
        ways: list[tuple[int, ...]] = [(lead,)]
        lost = False
        for x in text[at + 1 : at + size]:
            more = [b for b in _options(table, x) if 0x80 <= b <= 0xBF] if x > "\x7f" and x != LOST else [0x80] if x == LOST else []
            lost = lost or x == LOST
            ways = [(*w, b) for w in ways for b in more]
        for way in ways:
            try:
                found[at + size, chr(PART + lead) if lost else bytes(way).decode("utf-8")] = None
            except UnicodeDecodeError:
                continue
    return list(found)


def readings(text: str, shown: str) -> list[tuple[str, bool]]:
    """What text may be once UTF-8 sequences in it are read, the most usual first; nothing if there are none.

    The second value says that a reading takes more changes of case than the first.

    Where a character may stand for several bytes, as after a change of case, all paths are
    followed, of more than `READINGS` those with the fewest changes of case.
    """
    if not _may_hold(shown).search(text):
        return []
    # (changes of case, path as a chain); paths meet again at their ends.
    ends: dict[int, list[tuple[int, tuple | None]]] = {0: [(0, None)]}
    hit = False
    for at in range(len(text)):
        here = ends.pop(at, None)
        if here is None:
            continue
        here = sorted(here, key=lambda p: p[0])[:READINGS]
        c = text[at]
        steps = arcs(text, at, shown) if c > "\x7f" and c != LOST else []
        hit = hit or bool(steps)
        for k, (end, out) in enumerate(steps or [(at + 1, c)]):
            ends.setdefault(end, []).extend((cost + k, (out, path)) for cost, path in here)
    if not hit:
        return []
    texts: dict[str, bool] = {}
    last = sorted(ends[len(text)], key=lambda p: p[0])[:READINGS]
    for cost, path in last:
        parts = []
        while path is not None:
            parts.append(path[0])
            path = path[1]
        texts.setdefault("".join(reversed(parts)), cost > last[0][0])
    return list(texts.items())


def levels(text: str, shown: str) -> Iterator[tuple[int, str, bool]]:
    """(level, reading, whether changes of case were taken) of text wrongly decoded once, twice and
    so on: each level is shorter, so they end."""
    now, level = {text: False}, 0
    while now:
        level += 1
        found: dict[str, bool] = {}
        for x, changed in now.items():
            for reading, more in readings(x, shown):
                found[reading] = found.get(reading, True) and (changed or more)
        now = dict(sorted(found.items(), key=lambda f: f[1])[:READINGS])
        for reading, changed in now.items():
            yield level, reading, changed


CASED = ", case changed"


#: Stand for a UTF-8 character of which only the first byte is left (U+E000 + that byte).
STUB = 0xE000


def stubs(text: str, shown: str) -> str | None:
    """UTF-8 sequences whose later bytes, controls of the upper range, were dropped, as stubs."""
    table, out, at, hit = TABLES[shown], [], 0, False
    while at < len(text):
        b = table.get(text[at], 0)
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 0
        rest = 1
        while rest < size and at + rest < len(text) and 0x80 <= table.get(text[at + rest], 0) <= 0xBF:
            rest += 1
        if size and rest < size:
            out.append(chr(STUB + b))
            hit = True
        elif size:
            try:
                out.append(bytes(table[x] for x in text[at : at + size]).decode("utf-8"))
            except UnicodeDecodeError:
                out.append(text[at : at + size])
        else:
            out.append(text[at])
        at += rest if size else 1
    return "".join(out) if hit else None


@lru_cache(1 << 14)
def _plausible_short(text: str) -> bool:
    return _is_plausible(text)


def _plausible(text: str) -> bool:
    return _plausible_short(text) if len(text) <= 200 else _is_plausible(text)


def _is_plausible(text: str) -> bool:
    """Letters of one script a word with capitals only in front, or all capitals, and usual signs."""
    if re.search(r"[^\W\d_][^\x00-\x7f\w’][^\W\d_]", text) and not any("㐀" <= c <= "鿿" for c in text):
        return False
    for run in re.findall(r"[^\W\d_]+|[^\x00-\x7f]", text):
        if not run[0].isalpha():
            if run not in SIGNS and not "　" <= run <= "ヿ" and not "＀" <= run <= "￯":
                return False
            continue
        scripts = {0 if c < "ɐ" else 1 if c < "Ѐ" else 2 if c < "԰" else 3 for c in run}
        if len(scripts) > 1 or 1 in scripts:
            return False
        if not (run[1:] == run[1:].lower() or run == run.upper()):
            return False
    return True


@cache
def _to_bytes(shown: str) -> dict[int, int]:
    """For `str.translate`: characters to those of the number of their byte, case changes too."""
    table = TABLES[shown]
    every = {x for c in table for x in (c, c.upper(), c.lower()) if len(x) == 1}
    found = {ord(x): o[0] for x in every if (o := _options(table, x))}
    return found | {c: 0x100 for c in range(0x80, 0x100) if c not in found}


def single_bytes(text: str, shown: str) -> Iterator[tuple[str, str]]:
    """(encoding, text) of every encoding that the bytes shown may have been in, with plausible text."""
    try:
        raw = text.translate(_to_bytes(shown)).encode("latin-1")
    except UnicodeError:
        return
    for was in SINGLE[shown]:
        try:
            back = raw.decode(was)
        except UnicodeError:
            continue
        if _plausible(back):
            yield was, back


def other_script(text: str) -> bool:
    """Whether text, but for lost characters, is plain Greek, Cyrillic or of a later script."""
    letters = [c for c in text if c.isalpha()]
    if len(letters) < 3 or min(letters) < "Ͱ" or re.search(r"[^\W\d_][^\w\u3000-\uffff][^\W\d_]", text):
        return False
    return all(run[1:] == run[1:].lower() or run == run.upper() for run in re.findall(rf"(?:[^\W\d_]|{LOST})+", text))


DROPPED = "utf-8 as latin-1, bytes dropped"
_STUBBED = re.compile(rf"(?:[^\W\d_]|[{chr(STUB + 0x80)}-{chr(STUB + 0xFF)}])+")


def candidates(unit: str) -> list[tuple[str, int, str]]:
    """(channel, UTF-8 levels, restored) of every wrong decoding that can have made the unit.

    Of single-byte channels with the same result the first stays.
    """
    start = html.unescape(unit) if "&" in unit else unit
    escaped = "entity " if start != unit else ""
    found: dict[str, tuple[str, int, str]] = {}
    whole: list[tuple[str, int, str]] = []
    for shown in SHOWN:
        whole += ((f"{escaped}utf-8 as {shown} x{level}{CASED if changed else ''}", level, now) for level, now, changed in levels(start, shown))
    for shown in SINGLE:
        for was, back in single_bytes(start, shown):
            if back != start and back not in found:
                found[back] = (f"{escaped}{was} as {shown}", 0, back)
    cut = stubs(start, "latin-1")
    if cut is not None and _STUBBED.fullmatch(cut) and len(re.findall("[a-z]", cut.lower())) > 2:
        found[cut] = (f"{escaped}{DROPPED}", 1, cut)
    if LOST in start:
        if other_script(start):
            whole = []
        found.setdefault(start, ("lost bytes", 0, start))
    return [*whole, *found.values()]


def told_by_look(unit: str) -> bool:
    """Whether a unit is damage by its look alone: letters that make no plausible text, but do once
    UTF-8 sequences among them are read."""
    return _told_by_look(unit) if len(unit) <= 200 else _told_by_look.__wrapped__(unit)


@lru_cache(1 << 16)
def _told_by_look(unit: str) -> bool:
    start = html.unescape(unit) if "&" in unit else unit
    if not any(c > "\x7f" and c.isalpha() for c in start) or _plausible(start):
        return False
    return any(not re.search(GONE, now) and _plausible(now) for shown in SHOWN for _, now, _ in levels(start, shown))


@cache
def usual(channel: str) -> int:
    """The place of a channel among equals: the more usual decoders come first."""
    shown = channel.partition(" as ")[2].split(" ")[0].rstrip(",")
    return SHOWN.index(shown) if shown in SHOWN else len(SHOWN)


def model_words(text: str) -> list[str]:
    """The words of a unit, in lower case."""
    return WORD.findall(text.lower())


def pattern_of(word: str) -> str:
    """A word with each run beyond ASCII as one gap."""
    return re.sub(r"[^\x00-\x7f]+", "*", word.lower())


def fits(word: str, damaged: str) -> bool:
    """Whether a known word may have become the damaged one by losing characters or bytes."""
    known = re.split(r"([^\x00-\x7f]+)", word)
    gaps = re.split(r"([^\x00-\x7f]+)", damaged.lower())
    if len(known) != len(gaps):
        return False
    for was, now in zip(known[1::2], gaps[1::2]):
        if any(STUB + 0x80 <= ord(c) <= STUB + 0xFF for c in now):
            if len(was) != len(now) or not all(_may_be(a, b) for a, b in zip(was, now)):
                return False
            continue
        lost = now.count(LOST)
        if not re.search(GONE, now):
            if was != now:
                return False
        elif now.strip(LOST):
            if len(was) != len(now) or not all(b == LOST or _begins(a, b) for a, b in zip(was, now)):
                return False
        elif lost not in (len(was), len(was.encode("utf-8"))):
            return False
    return True


def _begins(was: str, now: str) -> bool:
    """Whether a character, in either case, is the other, or begins with the first byte that is known of it."""
    first = ord(now) - PART
    if not 0x80 <= first <= 0xFF:
        return was == now
    return any(c.encode("utf-8")[0] == first for c in (was, was.upper()))


def _may_be(was: str, now: str) -> bool:
    """Whether a character is, in either case, the stub's: its first byte, then dropped ones."""
    first = ord(now) - STUB
    if not 0x80 <= first <= 0xFF:
        return was == now
    for c in (was, was.upper()):
        raw = c.encode("utf-8")
        if raw[0] == first and any(0x80 <= b <= 0x9F for b in raw[1:]):
            return True
    return False
