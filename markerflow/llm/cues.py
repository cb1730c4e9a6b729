"""Subtitle files as cues, and cues as hashed terms."""

from __future__ import annotations

import re
import zlib

HASH_BITS = 24
REMEMBERED = 150_000

_SPLIT_CLOCK = re.compile(r"-->")
_FRAMES = re.compile(r"^\s*\{\d+\}\{\d+\}")
_LISTED = re.compile(r"^\s*\d+\.\s*\[[\d:.,]+\s*-\s*[\d:.,]+\]\s*")
_NUMBER = re.compile(r"^\s*﻿?\d+\s*$")
_TAGS = re.compile(r"<[^>]*>|\{[^}]*\}")
_SOUNDS = re.compile(r"\[[^\]]*\]|\([^)]*\)|\*[^*]*\*|\)")
_SPEAKER = re.compile(r"^\s*-?\s*[^\W\d_a-z]{2,}[^\W_a-z]*(?: [^\W\d_a-z]+)?:\s")
_MUSIC = re.compile(r"[♪♫]|^\s*#|#\s*$")
_DOMAIN = re.compile(r"([\w-]+)\.(?:example|com|net|org|tv|info)")
_WORD = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(r"[ÃÂâãåäæçèéÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ]")
#: What optical recognition confuses; both spellings fold to the same.
_PAIRS = (("vv", "w"), ("rn", "m"), ("cl", "d"))
_FOLD = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "!": "l", "5": "s", "c": "e", "ı": "l"})


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were read as another encoding, once or twice, read rightly."""
    for _ in range(2):
        if not _BROKEN.search(text):
            return text
        for wrong in ("cp1252", "latin-1"):
            try:
                text = text.encode(wrong).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        else:
            return text
    return text


def fold(text: str) -> str:
    text = text.lower()
    for a, b in _PAIRS:
        text = text.replace(a, b)
    return text.translate(_FOLD)


def split_cues(text: str | None) -> list[str]:
    """The texts of the cues in order, of any of the known formats."""
    if not text or not text.strip("﻿ \t\r\n"):
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if "-->" in text:
        cues: list[list[str]] = []
        for line in lines:
            if "-->" in line:
                if cues and cues[-1] and _NUMBER.match(cues[-1][-1]):
                    cues[-1].pop()
                cues.append([])
            elif cues and line.strip():
                cues[-1].append(line)
        return [" ".join(c) for c in cues]
    rows = [x for x in lines if x.strip("﻿ \t") and x.strip() != "WEBVTT"]
    if any(_FRAMES.match(x) for x in rows):
        return [_FRAMES.sub("", x).replace("|", " ") for x in rows if _FRAMES.match(x)]
    if any(_LISTED.match(x) for x in rows):
        cues = []
        for x in rows:
            if _LISTED.match(x):
                cues.append([_LISTED.sub("", x)])
            elif cues:
                cues[-1].append(x)
        return [" ".join(c) for c in cues]
    return [x for x in rows if not _NUMBER.match(x)]


def hashed(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << HASH_BITS) - 1)


class CueReader:
    """Cues to hashed terms, with a bounded memory for repeated cues."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[bool, tuple[int, ...]]] = {}

    def terms(self, cue: str) -> tuple[bool, tuple[int, ...]]:
        """Whether the cue names an address, and its terms: those of the domains if it does, else of its dialogue."""
        found = self.known.get(cue)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[cue] = self._read(cue)
        return found

    @staticmethod
    def _read(cue: str) -> tuple[bool, tuple[int, ...]]:
        plain = _TAGS.sub(" ", repaired(cue))
        if "." in plain or "@" in plain or "www" in plain.lower():
            low = plain.lower()
            domains = _DOMAIN.findall(low) or _DOMAIN.findall(low.replace("rn", "m").replace("c", "e").replace("1", "l"))
            if domains or "@" in plain or "www" in low:
                return True, tuple(hashed(w) for d in domains for w in _WORD.findall(fold(d.removeprefix("www"))))
        if _MUSIC.search(plain):
            return False, ()
        plain = _SOUNDS.sub(" ", _SPEAKER.sub(" ", plain))
        words = _WORD.findall(fold(plain))
        terms = [w for w in words if len(w) > 2] + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return False, tuple(dict.fromkeys(map(hashed, terms)))
