"""Secret scans that link the parts of a credential.

Strong patterns are findings by themselves. Weak parts, an account name, a
random-looking string or an endpoint, are findings only where parts that
complete each other lie side by side in one scope: an interval join on sorted
starts and ends, per text. No part completes one that it overlaps.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from rankloom.llm.texts import map_texts

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Role of each kind in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
#: Strong patterns, ASCII letters in either case only where the pattern says so.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak patterns.
WEAK = {
    "identifier": re.compile(r"""(?<![A-Za-z0-9])(?ai:(?:user(?:name)?|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,})|\bAKIA[A-Z0-9]{8,15}\b"""),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"),
    "endpoint": re.compile(r"\b(?ai:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+"),
}
#: User, and the password if there is one, that an address carries.
USER = re.compile(r"://([^\s/?#:@]+)(?::([^\s/?#@]+))?@")
#: A password inside an address has so many characters.
LEAST_PASSWORD = 6
#: A random string changes between lower case, capitals, digits and signs at this
#: share of its places, a capital before lower case aside, and has so many bits a
#: character; names in camel case do not. Of random ones 44 in 100 places change.
CHANGES, BITS = 0.27, 3.0
#: Default of the text function: parts further apart, in code points, do not complete each other.
REACH = 200
_BREAK = re.compile(r"\n[ \t\r]*\n")


@dataclass(frozen=True, order=True)
class Span:
    start: int
    rank: int
    end: int

    @property
    def kind(self) -> str:
        return KINDS[self.rank]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def strong_spans(text: str) -> list[Span]:
    out = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_random(run: str) -> bool:
    """Does a run of characters change class as often, and hold as many bits, as random ones?"""
    of = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in run]
    if sum(x != y and (x, y) != (1, 0) for x, y in zip(of, of[1:])) < CHANGES * (len(run) - 1):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= BITS


@dataclass
class Parts:
    """Starts and ends of the parts of one role, sorted apart."""

    starts: list[int]
    ends: list[int]

    @classmethod
    def of(cls, spans) -> Parts:
        spans = list(spans)
        return cls(sorted(s.start for s in spans), sorted(s.end for s in spans))

    def beside(self, s: Span, lo: int, hi: int) -> bool:
        """Does a part end between ``lo`` and the span, or begin between it and ``hi``?"""
        return bisect_right(self.ends, s.start) > bisect_right(self.ends, lo) or bisect_left(self.starts, hi) > bisect_left(self.starts, s.end)


def weak_spans(text: str) -> tuple[list[Span], set[Span], set[Span]]:
    """Weak parts; the endpoints among them that name a user; and those that name a password too.

    A random string inside an address is part of it, unless it is the password or
    lies in the query. User and password of an address are parts of their own.
    """
    identifier, secret, endpoint = (KINDS.index(k) for k in WEAK)
    urls = [Span(m.start(), endpoint, m.end()) for m in WEAK["endpoint"].finditer(text)]
    starts = [u.start for u in urls]
    found, users, whole = set(urls), set(), set()
    found.update(Span(m.start(), identifier, m.end()) for m in WEAK["identifier"].finditer(text))
    for m in WEAK["secret"].finditer(text):
        i = bisect_right(starts, m.start()) - 1
        inside = i >= 0 and m.start() < urls[i].end
        if (not inside or 0 <= text.find("?", urls[i].start, urls[i].end) < m.start()) and looks_random(m.group()):
            found.add(Span(m.start(), secret, m.end()))
    for u in urls:
        m = USER.search(text, u.start, u.end)
        if m:
            users.add(u)
            if m.group(2) and m.end(2) - m.start(2) >= LEAST_PASSWORD:
                whole.add(u)
                found.update((Span(m.start(1), identifier, m.end(1)), Span(m.start(2), secret, m.end(2))))
    return sorted(found), users, whole


def linked_spans(text: str, strong: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak parts that complementary parts, weak or strong, lie beside in their scope,
    anywhere in it if ``reach`` is None.

    An identifier needs a secret; a secret needs an identifier or an endpoint that
    names a user; an endpoint needs a strong or linked secret, or its own user and
    password. A scope ends at an empty line. A weak part that overlaps a strong one
    is that part.
    """
    found, users, whole = weak_spans(text)
    starts, furthest, most = [s.start for s in strong], [], 0
    for s in strong:
        most = max(most, s.end)
        furthest.append(most)

    def free(s: Span) -> bool:
        i = bisect_left(starts, s.end) - 1
        return i < 0 or furthest[i] <= s.start

    weak = [s for s in found if free(s) or s.kind == "endpoint"]
    if not weak:
        return []
    breaks = [m.start() for m in _BREAK.finditer(text)]

    def beside(parts: Parts, s: Span) -> bool:
        at = bisect_right(breaks, s.start)
        lo, hi = breaks[at - 1] if at else -1, breaks[at] if at < len(breaks) else len(text)
        return parts.beside(s, *((lo, hi) if reach is None else (max(s.start - reach, lo), min(s.end + reach, hi))))

    of_role = lambda spans, role: [s for s in spans if ROLES[s.kind] == role]
    secrets, identifiers = Parts.of(of_role(strong + weak, "secret")), Parts.of(of_role(strong + weak, "identifier"))
    named = Parts.of(users)
    linked = [s for s in of_role(weak, "identifier") if beside(secrets, s)]
    linked += [s for s in of_role(weak, "secret") if beside(identifiers, s) or beside(named, s)]
    sure = Parts.of(of_role(strong + linked, "secret"))
    return sorted(linked + [s for s in of_role(weak, "endpoint") if (s in whole or beside(sure, s)) and free(s)])


def find_secrets(docs: DataFrame, *, text: str = "text", name: str = "secrets", reach: int | None = None) -> DataFrame:
    """Add the spans of a text's secrets: kind, start, end (code points, end
    exclusive) and whether the pattern is strong, by start, then kind. Complementary
    parts that do not overlap link across their whole scope, or within ``reach`` code points.

    A null or empty text has none; each row is judged alone, so ties and repeated
    rows fare alike. An input column of the same name gives way.
    """
    span = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False), T.StructField("strong", T.BooleanType(), False)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strong", pa.bool_())]))

    def make():
        def fn(column):
            out = []
            for t in column.to_pylist():
                strong = strong_spans(t or "")
                both = sorted(strong + linked_spans(t or "", strong, reach))
                out.append([{"kind": s.kind, "start": s.start, "end": s.end, "strong": s.rank < 3} for s in both])
            return [pa.array(out, arrow)]

        return fn

    return map_texts(docs, text, make, [T.StructField(name, T.ArrayType(span, False), False)])
