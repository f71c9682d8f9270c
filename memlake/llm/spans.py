"""Spans of fixed patterns in whole texts, in linear time; positions are code points."""

import hashlib
import re

import numpy as np

# The patterns and limits of the base spans.
EMAIL_NAME = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
    r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

_NAME = frozenset(EMAIL_NAME)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def table(chars: str) -> np.ndarray:
    """Which of the first 128 characters, and at 128 which others, belong to a class: for runs()."""
    out = np.zeros(129, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


def runs(code: np.ndarray, belongs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of a class that hold at least so many characters."""
    inside = belongs[np.minimum(code, 128)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist()))


def emails(text: str) -> list[tuple[int, int]]:
    """From each @: the run before it, up to the last match, and the host behind it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _NAME:
            start -= 1
        host = EMAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            out.append((start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> tuple[list, list]:
    """Good and failing matches. A start within a run of digits matches nothing new."""
    good, bad = [], []
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m.groups())
        (good if all(len(p) < 4 and int(p or 0) <= 255 for p in parts) else bad).append(m.span())
    return good, bad


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def cards(text: str) -> tuple[list, list]:
    good, bad = [], []
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        fits = CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
        (good if fits else bad).append(m.span())
    return good, bad


def phones(text: str) -> tuple[list, list]:
    good, bad = [], []
    for m in PHONE.finditer(text) if "+" in text else ():
        n = sum(c in "0123456789" for c in m.group())
        (good if PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1] else bad).append(m.span())
    return good, bad


_HEX = table("0123456789abcdef")


def secrets(text: str, code: np.ndarray) -> dict[str, list]:
    """The base spans assign, access and hex."""
    low = text.lower()
    assign = []
    if any(w in low for w in ASSIGN_WORDS):
        assign = [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    return {"assign": assign, "access": access, "hex": runs(code, _HEX, HEX_LENGTH)}


def joined(found: dict[str, list], kinds: tuple) -> str:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    rows = sorted((s, i, e) for i, k in enumerate(kinds) for s, e in found.get(k, ()))
    return ",".join(f"{kinds[i]}:{s}:{e}" for s, i, e in rows)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e in spans)
