"""Header cards: parsing, typed look-up, building and rendering.

A value is a Python bool, int, float, str or complex (``ComplexInteger`` of whole parts), or ``UNDEFINED`` for a value card without one;
a card of commentary has ``None``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from hdulake.errors import HduError

CARD, BLOCK = 80, 2880


class _Undefined:
    def __repr__(self) -> str:
        return "UNDEFINED"

    def __reduce__(self):
        return "UNDEFINED"


UNDEFINED = _Undefined()


class ComplexInteger(complex):
    """A complex value whose parts were whole numbers."""


_KEY = re.compile(r"[A-Z0-9_-]{1,8}\Z")
_INT = re.compile(r"[+-]?\d+\Z")
_REAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([EeDd][+-]?\d+)?\Z")


@dataclass
class Card:
    keyword: str
    value: object = None
    comment: str = ""


def split_comment(text: str) -> tuple[str, str]:
    """Value and comment, cut at the first slash outside quotes."""
    quoted = False
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif c == "/" and not quoted:
            return text[:i].strip(), text[i + 1 :].strip()
    return text.strip(), ""


def _scalar(text: str):
    if _INT.match(text):
        n = int(text)
        return n if -(1 << 63) <= n < 1 << 63 else float(n)
    if _REAL.match(text):
        x = float(text.replace("D", "E").replace("d", "e"))
        if x - x == 0:
            return x
    raise HduError("InvalidValue", text)


def parse_value(text: str):
    if not text:
        return UNDEFINED
    if text[0] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise HduError("InvalidValue", text)
        inner = text[1:-1].replace("''", "'")
        return inner.rstrip(" ") or (" " if inner else "")
    if text in ("T", "F"):
        return text == "T"
    if text[0] == "(":
        parts = text.strip("()").split(",")
        if len(parts) != 2 or text[-1] != ")":
            raise HduError("InvalidValue", text)
        found = [_scalar(p.strip()) for p in parts]
        whole = all(isinstance(v, int) for v in found)
        return (ComplexInteger if whole else complex)(*map(float, found))
    return _scalar(text)


def parse_card(raw: bytes) -> Card:
    try:
        text = raw.decode("ascii")
    except UnicodeDecodeError:
        raise HduError("InvalidValue", "a card isn't ASCII") from None
    keyword = text[:8].rstrip()
    if keyword == "HIERARCH" and "=" in text[8:]:
        name, _, rest = text[8:].partition("=")
        value, comment = split_comment(rest)
        return Card(name.strip(), parse_value(value), comment)
    if keyword == "CONTINUE":
        value, comment = split_comment(text[8:])
        return Card(keyword, parse_value(value) if value.startswith("'") else None, comment if value.startswith("'") else text[8:].strip())
    if text[8:9] == "=":
        if not _KEY.match(keyword):
            raise HduError("InvalidKeyword", keyword)
        value, comment = split_comment(text[9:])
        return Card(keyword, parse_value(value), comment)
    return Card(keyword, None, text[8:].rstrip())


@dataclass
class Header:
    cards: list[Card] = field(default_factory=list)

    @classmethod
    def parse(cls, raw: bytes) -> Header:
        cards: list[Card] = []
        for at in range(0, len(raw) - CARD + 1, CARD):
            line = raw[at : at + CARD]
            if line.rstrip() == b"END":
                return cls(cards)
            card = parse_card(line)
            before = cards[-1] if cards else None
            if card.keyword == "CONTINUE" and isinstance(card.value, str) and before is not None and isinstance(before.value, str) and before.value.endswith("&"):
                before.value = before.value[:-1] + card.value
                before.comment = card.comment or before.comment
            elif card.keyword == "CONTINUE":
                cards.append(Card("CONTINUE", None, line[8:].decode("ascii").rstrip()))
            else:
                cards.append(card)
        raise HduError("MissingEnd")

    def get(self, keyword: str, default=None):
        """The value of the first card of that name; an undefined one counts as absent."""
        for c in self.cards:
            if c.keyword == keyword and c.value is not None:
                return default if c.value is UNDEFINED else c.value
        return default

    def integer(self, keyword: str, default: int | None = None) -> int | None:
        v = self.get(keyword)
        if isinstance(v, float) and v.is_integer():
            v = int(v)
        return v if isinstance(v, int) and not isinstance(v, bool) else default

    def real(self, keyword: str, default: float | None = None) -> float | None:
        v = self.get(keyword)
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def text(self, keyword: str, default: str | None = None) -> str | None:
        v = self.get(keyword)
        return v if isinstance(v, str) else default

    def logical(self, keyword: str, default: bool | None = None) -> bool | None:
        v = self.get(keyword)
        return v if isinstance(v, bool) else default

    def need(self, keyword: str) -> int:
        v = self.integer(keyword)
        if v is None:
            raise HduError("MissingKeyword", keyword)
        return v

    def axes(self) -> list[int]:
        n = self.need("NAXIS")
        if not 0 <= n <= 999:
            raise HduError("KeywordOutOfRange", "NAXIS")
        out = [self.need(f"NAXIS{i + 1}") for i in range(n)]
        if any(x < 0 for x in out):
            raise HduError("KeywordOutOfRange", "NAXISn")
        return out

    def set(self, keyword: str, value, comment: str = "") -> Header:
        for c in self.cards:
            if c.keyword == keyword and c.value is not None:
                c.value, c.comment = value, comment or c.comment
                return self
        self.cards.append(Card(keyword, value, comment))
        return self

    def add_comment(self, text: str, keyword: str = "COMMENT") -> Header:
        self.cards += [Card(keyword, None, text[i : i + 72]) for i in range(0, max(1, len(text)), 72)]
        return self

    def render(self) -> bytes:
        raw = b"".join(line for c in self.cards for line in render_card(c)) + b"END".ljust(CARD)
        return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def format_value(value) -> str:
    if value is UNDEFINED:
        return ""
    if isinstance(value, bool):
        return "T" if value else "F"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, ComplexInteger):
        return f"({int(value.real)}, {int(value.imag)})"
    if isinstance(value, complex):
        return f"({format_value(value.real)}, {format_value(value.imag)})"
    if isinstance(value, float):
        if value - value != 0:
            raise HduError("InvalidValue", repr(value))
        plain = repr(value)
        if "e" in plain or len(plain) > 20:
            mantissa, _, exponent = f"{value:.16E}".partition("E")
            plain = f"{mantissa.rstrip('0')}E{exponent}"
            plain = plain.replace(".E", ".0E")
        return plain
    quoted = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return quoted


def render_card(card: Card) -> list[bytes]:
    """One 80-byte line, or several for a long string (CONTINUE)."""
    if card.value is None:
        return [f"{card.keyword:<8}{card.comment}"[:CARD].ljust(CARD).encode("ascii")]
    plain = _KEY.match(card.keyword)
    head = f"{card.keyword:<8}= " if plain else f"HIERARCH {card.keyword} = "
    body = format_value(card.value)
    if isinstance(card.value, str):
        if len(head) + len(body) > CARD:
            return _long_string(head, card.value, card.comment)
        body = body.ljust(20) if plain else body
    elif plain:
        body = body.rjust(20)
    line = head + body + (f" / {card.comment}" if card.comment else "")
    if len(head + body) > CARD:
        raise HduError("InvalidValue", card.keyword)
    return [line[:CARD].ljust(CARD).encode("ascii")]


def _long_string(head: str, value: str, comment: str) -> list[bytes]:
    lines, left = [], [c if c != "'" else "''" for c in value]
    while left or not lines:
        room, piece = CARD - len(head) - 3, ""
        while left and len(piece) + len(left[0]) <= room:
            piece += left.pop(0)
        lines.append(f"{head}'{piece}{'&' if left else ''}'".ljust(CARD).encode("ascii"))
        head = "CONTINUE  "
    if comment and len(lines[-1].rstrip()) + 3 + len(comment) <= CARD:
        lines[-1] = (lines[-1].rstrip() + f" / {comment}".encode("ascii")).ljust(CARD)
    return lines
