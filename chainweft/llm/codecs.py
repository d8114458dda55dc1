"""Chains of encodings that garble text, forwards and backwards, on runs of non-ASCII characters.

``chains`` lists the usual ones. ``identify`` finds others for aligned characters among all encodings that Python knows.
"""

from __future__ import annotations

import codecs
import encodings
import functools
import pkgutil
from collections import Counter, defaultdict

# Names of public character encodings.
WRITTEN_AS = ["utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "iso8859-2", "iso8859-5", "mac_cyrillic"]
READ_AS = ["latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-15"]
#: Encodings in which a text may have been misread twice.
TWICE = ["latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman"]

REPLACEMENT = "�"
Step = tuple[str, str]
Chain = tuple[Step, ...]


def chains() -> list[Chain]:
    """Every (written as, read as) pair, and UTF-8 misread twice."""
    once = [((a, b),) for a in WRITTEN_AS for b in READ_AS if codecs.lookup(a).name != codecs.lookup(b).name]
    twice = [(("utf-8", a), ("utf-8", b)) for a in TWICE for b in TWICE if a == b or {a, b} == {"latin-1", "cp1252"}]
    return once + twice


@functools.cache
def _known() -> tuple[list[str], frozenset[str]]:
    """Encodings that Python knows and that keep ASCII: those of one byte a character, and those of several."""
    one, several = [], []
    plain = bytes(range(32, 127))
    for name in sorted(m.name for m in pkgutil.iter_modules(encodings.__path__)):
        try:
            if not codecs.lookup(name)._is_text_encoding or name.startswith(("utf", "punycode", "idna", "unicode", "raw", "charmap")) or plain.decode(name) != plain.decode("ascii"):
                continue
            upper = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
        except (LookupError, UnicodeError):
            continue
        if len("中".encode(name, "ignore")) == 2 and len("国".encode(name, "ignore")) == 2:
            several.append(name)
        elif sum(c != REPLACEMENT for c in upper) >= 32:
            one.append(name)
    return one, frozenset(several)


def _several_bytes() -> frozenset[str]:
    return _known()[1]


def identify(entries: dict[tuple[str, str], int], least: int = 3) -> tuple[list[Chain], dict[tuple[str, str], int]]:
    """Chains that explain (clean character, what it became) pairs, and the pairs that no chain explains.

    Of all pairs of known encodings the one that explains most is taken, with those that explain the same of text
    written alike, as long as it explains at least ``least`` pairs that no earlier one does.
    """
    one, several = _known()
    names = ["utf-8", *one, *sorted(several)]
    votes: dict[tuple[str, str], set] = defaultdict(set)
    for clean, odd in entries:
        written: dict[bytes, list[str]] = defaultdict(list)
        for name in names:
            if raw := _encode(clean, name):
                written[raw].append(name)
        for name in names:
            if raw := _encode(odd, name):
                for other in written.get(raw, ()):
                    if other != name:
                        votes[other, name].add((clean, odd))
    rest, found = dict(entries), []
    while votes:
        rank = Counter({pair: len(own & rest.keys()) for pair, own in votes.items()})
        best = max(rank, key=lambda p: (rank[p], (p[0] in WRITTEN_AS) + (p[1] in READ_AS), p))  # of equal ones the usual
        if rank[best] < least:
            break
        # encodings that explain the same may differ in characters not seen here
        own = votes[best] & rest.keys()
        alike = sorted((p for p, held in votes.items() if p[0] == best[0] and held & rest.keys() == own), key=lambda p: p != best)
        found += [(p,) for p in alike]
        for p in alike:
            del votes[p]
        for entry in own:
            del rest[entry]
    return found, rest


_TABLES: dict[str, tuple[dict[int, str], dict[str, int]]] = {}


def _tables(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """Byte to character and back; bytes that the encoding leaves undefined stand for the control of that number."""
    if name not in _TABLES:
        read = {}
        for b in range(256):
            try:
                read[b] = bytes([b]).decode(name)
            except UnicodeDecodeError:
                read[b] = chr(b)
        back = {c: b for b, c in reversed(list(read.items()))}
        _TABLES[name] = read, back
    return _TABLES[name]


def _encode(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    if name in _several_bytes():
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return None
    back = _tables(name)[1]
    try:
        return bytes(back[c] for c in text)
    except KeyError:
        return None


def _decode(raw: bytes, name: str) -> str | None:
    if name == "utf-8" or name in _several_bytes():
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return None
    read = _tables(name)[0]
    return "".join(read[b] for b in raw)


def garble(text: str, chain: Chain) -> str | None:
    """The text after each step of writing and misreading; None if it can't be written so."""
    for written, read in chain:
        raw = _encode(text, written)
        if raw is None:
            return None
        text = _decode(raw, read)
        if text is None:
            return None
    return text


def restore(text: str, chain: Chain) -> str | None:
    """The inverse of ``garble``; None where the text can't have come about this way."""
    for written, read in reversed(chain):
        raw = _encode(text, read)
        if raw is None:
            return None
        text = _decode(raw, written)
        if text is None:
            return None
    return text if all(ord(c) >= 0xA0 for c in text) else None


def readable(chain: Chain) -> set[str] | None:
    """The characters that the chain's last misreading can make; None where they are too many to list."""
    if chain[-1][1] in _several_bytes():
        return None
    return {c for c in _tables(chain[-1][1])[0].values() if not c.isascii()}
