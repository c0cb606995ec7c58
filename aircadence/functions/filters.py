"""The capture tool's display filter language as conditions on frame columns.

    or      a || b, a or b            and     a && b, a and b
    not     !a, not a                 group   (a)
    test    == != < <= > >=, eq ne lt le gt ge
    set     field in {1, 5..7, "x"}   bits    field & 0x20
    text    field contains x, field matches "pattern"
    bytes   wlan.sa[0:3] == b8:27:eb, [2], [1-3], [:2], [3:]
    there   field, wlan, radiotap

``and`` binds more tightly than ``or``, ``not`` than both.  A test of a field that a
frame lacks is false, so its negation holds.  ``wlan.addr`` is any of four
addresses: a test holds if it does for one of them, but ``!=`` only if it does for
all.  Addresses compare without regard to case and separators, patterns without
regard to case.

Conditions are plain comparisons of columns joined by and and or, so that they reach
the scan; null counts as false, as in ``where``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

_SUBTYPE_BITS = 15
_ADDRESSES = {f"wlan.{a}": (a,) for a in ("sa", "da", "ta", "ra", "bssid")} | {"wlan.addr": ("sa", "da", "ta", "ra")}
_NUMBERS: dict[str, Callable[[], Column]] = {
    name: lambda c=column: F.col(c)
    for name, column in {
        "wlan.fc.type": "frame_type", "wlan.fc.type_subtype": "frame_subtype", "wlan.fc.retry": "retry", "wlan.fc.protected": "protected", "wlan.fc.tods": "to_ds", "wlan.fc.fromds": "from_ds",
        "wlan.seq": "seq_num", "wlan.duration": "duration", "wlan.qos.priority": "qos_priority", "frame.len": "frame_len", "frame.number": "frame_no", "frame.time_epoch": "timestamp",
        "radiotap.dbm_antsignal": "rssi", "radiotap.dbm_antnoise": "ant_noise", "radiotap.datarate": "data_rate", "radiotap.channel.freq": "channel_freq", "radiotap.mcs.index": "mcs_index",
    }.items()
} | {"wlan.fc.subtype": lambda: F.col("frame_subtype").bitwiseAND(_SUBTYPE_BITS)}
#: Protocols are there if one of these columns is.
_PROTOCOLS = {"wlan": None, "frame": None, "radiotap": ("rssi", "data_rate", "channel_freq", "ant_noise", "mcs_index")}

_TOKEN = re.compile(r'\s*(?:(?P<op>\|\||&&|==|!=|<=|>=|\.\.|[!<>()\[\]{},&:])|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<word>[A-Za-z0-9_+-](?:[A-Za-z0-9_:+-]|\.(?!\.))*))')
_WORDS = {"or": "||", "and": "&&", "not": "!", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _number(text: str) -> int | float:
    low = text.lower()
    if low in ("true", "false"):
        return int(low == "true")
    try:
        return int(text, 0) if not re.fullmatch(r"[+-]?\d+", text) else int(text)
    except ValueError:
        return float(text)


def _address(text: str) -> str:
    """Bytes in the form of address columns."""
    plain = re.sub(r"[-.:]", "", text).lower()
    if not re.fullmatch(r"([0-9a-f]{2})+", plain):
        raise ValueError(f"no bytes: {text}")
    return ":".join(plain[k: k + 2] for k in range(0, len(plain), 2))


class _Filter:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, expression: str, lower_case: bool):
        self.expression, self.lower_case = expression, lower_case
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(expression.rstrip()):
            found = _TOKEN.match(expression, at)
            if not found:
                raise ValueError(f"filter not understood at {expression[at:]!r}")
            kind = found.lastgroup
            value = found[kind]
            if kind == "text":
                value = re.sub(r"\\(.)", lambda m: m[1] if m[1] in '"\\' else m[0], value)
            if kind == "word" and value.lower() in _WORDS:
                kind, value = "op", _WORDS[value.lower()]
            self.tokens.append((kind, value))
            at = found.end()
        self.at = 0

    def next(self, *ops: str) -> str | None:
        """The next token if it is one of these operators."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.next(op):
            raise ValueError(f"{op!r} expected: {self.expression}")

    def word(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise ValueError(f"{' or '.join(kinds)} expected: {self.expression}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Column:
        if not self.tokens:
            return F.lit(True)
        out = self.alternatives()
        if self.at < len(self.tokens):
            raise ValueError(f"{self.tokens[self.at][1]!r} not expected: {self.expression}")
        return out

    def alternatives(self) -> Column:
        out = self.conjunction()
        while self.next("||"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.next("&&"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        if self.next("!"):
            return ~F.coalesce(self.negation(), F.lit(False))
        if self.next("("):
            out = self.alternatives()
            self.need(")")
            return out
        return self.test()

    def test(self) -> Column:
        name = self.word("word")
        if name in _PROTOCOLS:
            columns = _PROTOCOLS[name]
            return F.lit(True) if columns is None else reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
        if name not in _ADDRESSES and name not in _NUMBERS:
            raise ValueError(f"unsupported filter term: {name}")
        return self.on_bytes(name) if name in _ADDRESSES else self.on_number(name)

    def on_number(self, name: str) -> Column:
        field = _NUMBERS[name]()
        masked = self.next("&")
        if masked:
            field = field.bitwiseAND(_number(self.word("word")))
        if op := self.next(*_TESTS):
            return _TESTS[op](field, _number(self.word("word")))
        if self.member("in"):
            return self.set_of(lambda: _number(self.word("word")), field)
        if self.member("contains") or self.member("matches"):
            raise ValueError(f"{name} is a number: {self.expression}")
        return field != 0 if masked else field.isNotNull()

    def on_bytes(self, name: str) -> Column:
        columns = [F.nullif(F.col(c), F.lit("")) if not self.lower_case else F.col(c) for c in _ADDRESSES[name]]
        if not self.lower_case:
            columns = [F.lower(F.replace(c, F.lit("-"), F.lit(":"))) for c in columns]
        if self.next("["):
            columns = [self.sliced(c, *bounds) for bounds in [self.bounds()] for c in columns]
        some = lambda f: reduce(lambda a, b: a | b, map(f, columns))
        if self.next("!="):
            value = _address(self.word("word", "text"))
            there = some(lambda c: c.isNotNull())
            differs = [c != value for c in columns]
            return differs[0] if len(columns) == 1 else reduce(lambda a, b: a & b, (F.coalesce(d, F.lit(True)) for d in differs), there)
        if op := self.next(*_TESTS):
            value = _address(self.word("word", "text"))
            return some(lambda c: _TESTS[op](c, value))
        if self.member("in"):
            at = self.at
            def each(c: Column) -> Column:
                self.at = at
                return self.set_of(lambda: _address(self.word("word", "text")), c)
            return some(each)
        if self.member("contains"):
            value = f":{_address(self.word('word', 'text'))}:"
            return some(lambda c: F.concat(F.lit(":"), c, F.lit(":")).contains(value))
        if self.member("matches"):
            pattern = f"(?i){self.word('text')}"
            return some(lambda c: c.rlike(pattern))
        return some(lambda c: c.isNotNull() if not self.lower_case else c != "")

    def member(self, word: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1].lower() == word:
            self.at += 1
            return True
        return False

    def set_of(self, value: Callable[[], object], field: Column) -> Column:
        self.need("{")
        values, ranges = [], []
        while True:
            low = value()
            if self.next(".."):
                ranges.append(field.between(low, value()))
            else:
                values.append(low)
            if self.next("}"):
                break
            self.next(",")
        return reduce(lambda a, b: a | b, ([field.isin(values)] if values else []) + ranges)

    def bounds(self) -> tuple[int, int | None]:
        """First byte and number of bytes (None: all that follow) of a slice."""
        text = ""
        while not self.next("]"):
            if self.at >= len(self.tokens):
                raise ValueError(f"']' expected: {self.expression}")
            text += self.tokens[self.at][1]
            self.at += 1
        for pattern, bounds in (
            (r"(-?\d+):(\d+)", lambda a, b: (int(a), int(b))), (r"(\d+)-(\d+)", lambda a, b: (int(a), int(b) - int(a) + 1)),
            (r":(\d+)", lambda b: (0, int(b))), (r"(-?\d+):", lambda a: (int(a), None)), (r"(-?\d+)", lambda a: (int(a), 1)),
        ):
            if found := re.fullmatch(pattern, text):
                first, count = bounds(*found.groups())
                if count is None or count > 0:
                    return first, count
        raise ValueError(f"no slice: [{text}]")

    @staticmethod
    def sliced(field: Column, first: int, count: int | None) -> Column:
        parts = F.split(field, ":")
        size = F.size(parts)
        start = F.lit(first) if first >= 0 else size + first
        count = F.lit(count) if count is not None else size - start
        fits = (start >= 0) & (count > 0) & (start + count <= size)
        return F.when(fits, F.array_join(F.slice(parts, F.greatest(start, F.lit(0)) + 1, F.greatest(count, F.lit(0))), ":"))


def display_filter(expression: str, lower_case: bool = False) -> Column:
    """The condition of a display filter; an empty one holds for all frames.

    ``lower_case`` says that address columns are in lower case with colons and null
    where missing, as the capture source gives them; comparisons of addresses are
    then pushed into its scan too.  Raises ValueError for what is not understood.
    """
    return _Filter(expression, lower_case).whole()
