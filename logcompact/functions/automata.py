"""RE2 patterns as finite automata, whose work on a text can be cut into pieces and put together again.

A pattern that may match any number of newlines has to be told of the whole output of a run. Its automaton needs no whole
output: what a piece of text does to it is a map from states to states, and maps of pieces compose.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

Ranges = tuple[tuple[int, int], ...]
Node = tuple  # ("chars", ranges), ("all", nodes), ("any", nodes), ("times", node, low, high), ("at", where)

LAST = sys.maxunicode
#: States of an automaton at most, characters of a piece that is worked on beside others, and what a repetition is unrolled to.
MOST_STATES, PIECE, MOST_TIMES = 2048, 256, 1000
BEFORE, FOUND = 0, 1

# The ASCII classes of the pattern language.
DIGIT: Ranges = ((48, 57),)
WORD: Ranges = ((48, 57), (65, 90), (95, 95), (97, 122))
SPACE: Ranges = ((9, 10), (12, 13), (32, 32))
NAMED: dict[str, Ranges] = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)),
    "cntrl": ((0, 31), (127, 127)), "digit": DIGIT, "graph": ((33, 126),), "lower": ((97, 122),), "print": ((32, 126),),
    "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ((9, 13), (32, 32)), "upper": ((65, 90),), "word": WORD,
    "xdigit": ((48, 57), (65, 70), (97, 102)),
}
CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
PLACES = {"A": "text_start", "z": "text_end", "b": "edge", "B": "no_edge"}


class TooLarge(ValueError):
    """The pattern has no automaton of a reasonable size, or holds something that automata do not know."""


def joined(ranges) -> Ranges:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return tuple((a, b) for a, b in out)


def others(ranges: Ranges) -> Ranges:
    out, at = [], 0
    for low, high in joined(ranges):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    return tuple(out + ([(at, LAST)] if at <= LAST else []))


def either_case(ranges: Ranges) -> Ranges:
    """With the other cases of their letters; large ranges hold those already."""
    more = list(ranges)
    for low, high in ranges:
        if high - low <= 4096:
            for c in map(chr, range(low, high + 1)):
                more += [(ord(x), ord(x)) for x in (c.lower(), c.upper(), c.title()) if len(x) == 1]
        else:
            more += [(65, 90), (97, 122)] if low <= 65 and high >= 122 else []
    return joined(more)


@lru_cache(maxsize=64)
def of_category(name: str) -> Ranges:
    if name == "Any":
        return ((0, LAST),)
    found = [c for c in range(LAST + 1) if unicodedata.category(chr(c)).startswith(name)]
    if not found or len(name) > 2:
        raise TooLarge(f"the characters of {name} are not known here")
    return joined((c, c) for c in found)


class _Reader:
    """Reads a valid pattern to nodes; flags hold to the end of their group."""

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, of: str) -> bool:
        return self.text.startswith(of, self.at)

    def take(self, of: str) -> bool:
        if self.peek(of):
            self.at += len(of)
            return True
        return False

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        stop = len(self.text) if stop < 0 else stop
        out, self.at = self.text[self.at : stop], stop + len(end)
        return out

    def choice(self, flags: frozenset[str]) -> Node:
        branches, run = [], []
        while self.at < len(self.text) and not self.peek(")"):
            if self.take("|"):
                branches.append(("all", run))
                run = []
            elif self.peek("(?") and not (self.peek("(?P<") or self.peek("(?<")):
                self.at += 2
                said = ""
                while self.text[self.at] not in ":)":
                    said += self.text[self.at]
                    self.at += 1
                on, _, off = said.partition("-")
                inside = (flags | set(on)) - set(off)
                if self.take(")"):
                    flags = inside
                else:
                    self.at += 1
                    run.append(self.repeated(self.group(inside)))
            else:
                run += self.item(flags)
        branches.append(("all", run))
        return branches[0] if len(branches) == 1 else ("any", branches)

    def group(self, flags: frozenset[str]) -> Node:
        out = self.choice(flags)
        self.take(")")
        return out

    def item(self, flags: frozenset[str]) -> list[Node]:
        if self.take("("):
            if self.take("?"):
                self.until(">")
            return [self.repeated(self.group(flags))]
        if self.take(r"\Q"):
            literal = self.until(r"\E")
            nodes = [self.chars(((ord(c), ord(c)),), flags) for c in literal]
            return nodes[:-1] + [self.repeated(nodes[-1])] if nodes else []
        for mark, lined, plain in (("^", "line_start", "text_start"), ("$", "line_end", "text_end")):
            if self.take(mark):
                return [self.repeated(("at", lined if "m" in flags else plain))]
        if self.take("."):
            return [self.repeated(("chars", ((0, LAST),) if "s" in flags else others(((10, 10),))))]
        if self.take("["):
            return [self.repeated(self.members(flags))]
        if self.peek("\\") and self.text[self.at + 1] in PLACES:
            self.at += 2
            return [self.repeated(("at", PLACES[self.text[self.at - 1]]))]
        return [self.repeated(self.chars(self.character(), flags))]

    def chars(self, ranges: Ranges, flags: frozenset[str]) -> Node:
        return ("chars", either_case(ranges) if "i" in flags else joined(ranges))

    def character(self) -> Ranges:
        """A character or an escape, which may stand for several."""
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ((ord(c), ord(c)),)
        c = self.text[self.at]
        self.at += 1
        if c in "pP":
            name = self.until("}").lstrip("{") if self.peek("{") else self.text[self.at]
            self.at += 0 if self.text[self.at - 1] == "}" else 1
            without = (c == "P") != name.startswith("^")
            found = of_category(name.removeprefix("^"))
            return others(found) if without else found
        if c == "x":
            code = int(self.until("}")[1:], 16) if self.peek("{") else int(self.text[self.at : self.at + 2], 16)
            self.at += 0 if self.text[self.at - 1] == "}" else 2
            return ((code, code),)
        for letter, ranges in (("d", DIGIT), ("w", WORD), ("s", SPACE)):
            if c.lower() == letter:
                return ranges if c == letter else others(ranges)
        code = CONTROL.get(c, ord(c))
        return ((code, code),)

    def members(self, flags: frozenset[str]) -> Node:
        negated, found, first = self.take("^"), [], True
        while first or not self.peek("]"):
            first = False
            if self.take("[:"):
                name = self.until(":]")
                ranges = NAMED[name.removeprefix("^")]
                found += others(ranges) if name.startswith("^") else ranges
                continue
            low = self.character()
            if len(low) == 1 and low[0][0] == low[0][1] and self.peek("-") and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                low = ((low[0][0], self.character()[0][0]),)
            found += low
        self.at += 1
        ranges = either_case(joined(found)) if "i" in flags else joined(found)
        return ("chars", others(ranges) if negated else ranges)

    def repeated(self, node: Node) -> Node:
        while self.at < len(self.text):
            if self.take("*"):
                node = ("times", node, 0, None)
            elif self.take("+"):
                node = ("times", node, 1, None)
            elif self.take("?"):
                node = ("times", node, 0, 1)
            elif self.peek("{") and (stop := self.text.find("}", self.at)) > 0 and self._bounds(stop):
                low, high = self._bounds(stop)
                node, self.at = ("times", node, low, high), stop + 1
            else:
                break
            self.take("?")  # greedy or not, the same texts match
        return node

    def _bounds(self, stop: int) -> tuple[int, int | None] | None:
        low, comma, high = self.text[self.at + 1 : stop].partition(",")
        if not low.isdigit() or high and not high.isdigit():
            return None
        return int(low), (int(high) if high else None) if comma else int(low)


def read(pattern: str) -> Node:
    return _Reader(pattern).choice(frozenset())


def most_newlines(node: Node) -> int | None:
    """How many newlines a match can hold at most; None for any number."""
    kind = node[0]
    if kind == "chars":
        return int(any(a <= 10 <= b for a, b in node[1]))
    if kind == "at":
        return 0
    if kind == "times":
        each = most_newlines(node[1])
        return 0 if each == 0 or node[3] == 0 else None if each is None or node[3] is None else each * node[3]
    parts = [most_newlines(x) for x in node[1]]
    if None in parts:
        return None
    return sum(parts) if kind == "all" else max(parts, default=0)


@dataclass(frozen=True)
class Automaton:
    """`next[state, kind]` by kinds of characters; `edges` are the first characters of ranges of one kind, `kinds` theirs.

    A run starts in BEFORE and reads a newline before each of its lines, the first one too; FOUND is never left.
    `ends` tells which states have a match where the text ends.
    """

    next: np.ndarray
    edges: np.ndarray
    kinds: np.ndarray
    ends: np.ndarray

    def map_of(self, lines: list[str | None]) -> np.ndarray:
        """Where these lines, a newline before each, take every state."""
        text = np.frombuffer(("\n" + "\n".join(x or "" for x in lines)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if lines else np.zeros(0, np.uint32)
        kind = self.kinds[np.searchsorted(self.edges, text, side="right") - 1]
        size = len(self.next)
        rows = -(-len(kind) // PIECE)
        # one kind more, at the end, leaves every state as it is
        table = np.concatenate([self.next, np.arange(size, dtype=self.next.dtype)[:, None]], axis=1)
        padded = np.full(rows * PIECE, table.shape[1] - 1, dtype=np.int64)
        padded[: len(kind)] = kind
        padded = padded.reshape(rows, PIECE)
        maps = np.broadcast_to(np.arange(size, dtype=self.next.dtype), (rows, size))
        for k in range(PIECE if rows else 0):
            maps = table[maps, padded[:, k, None]]
        return composed(maps) if rows else np.arange(size, dtype=self.next.dtype)


    def states_of(self, starts: list[int], texts: list[list[str | None]]) -> np.ndarray:
        """Where each text, given as lines with a newline before each, takes the state it starts in."""
        each = ["\n" + "\n".join(x or "" for x in lines) for lines in texts]
        sizes = np.array([len(text) for text in each])
        codes = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kinds[np.searchsorted(self.edges, codes, side="right") - 1]
        # longest first, so that those with a character left come first
        order = np.argsort(-sizes, kind="stable")
        at, left = (np.cumsum(sizes) - sizes)[order], np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
        states = np.array(starts, dtype=self.next.dtype)[order]
        for k, n in enumerate(left.tolist()):
            states[:n] = self.next[states[:n], kind[at[:n] + k]]
        out = np.empty_like(states)
        out[order] = states
        return out


def composed(maps: np.ndarray) -> np.ndarray:
    """One map for maps in order, neighbours two by two."""
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        maps = np.concatenate([np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2 : 2], axis=1), odd])
    return maps[0]


class _Build:
    def __init__(self) -> None:
        self.steps: list[list[tuple[Ranges, int]]] = []
        self.jumps: list[list[tuple[str, int]]] = []

    def state(self) -> int:
        self.steps.append([])
        self.jumps.append([])
        if len(self.steps) > 50_000:
            raise TooLarge("a repetition of repetitions")
        return len(self.steps) - 1

    def add(self, node: Node, start: int) -> int:
        """States for a node behind `start`; the state behind it."""
        kind = node[0]
        if kind == "chars":
            end = self.state()
            self.steps[start].append((node[1], end))
        elif kind == "at":
            end = self.state()
            self.jumps[start].append((node[1], end))
        elif kind == "all":
            end = start
            for part in node[1]:
                end = self.add(part, end)
        elif kind == "any":
            end = self.state()
            for part in node[1]:
                begin = self.state()
                self.jumps[start].append(("", begin))
                self.jumps[self.add(part, begin)].append(("", end))
        else:
            _, inner, low, high = node
            for _ in range(low):
                start = self.add(inner, start)
            if high is None:
                turn = self.state()
                self.jumps[start].append(("", turn))
                self.jumps[self.add(inner, turn)].append(("", turn))
                start = turn
                end = self.state()
                self.jumps[start].append(("", end))
            else:
                end = self.state()
                for _ in range(high - low):
                    self.jumps[start].append(("", end))
                    start = self.add(inner, start)
                self.jumps[start].append(("", end))
        return end


START, NEWLINE, WORD_CHAR, OTHER, END = range(5)


def _holds(where: str, before: int, after: int) -> bool:
    return {
        "": True, "text_start": before == START, "text_end": after == END, "line_start": before in (START, NEWLINE),
        "line_end": after in (END, NEWLINE), "edge": (before == WORD_CHAR) != (after == WORD_CHAR),
        "no_edge": (before == WORD_CHAR) == (after == WORD_CHAR),
    }[where]


@lru_cache(maxsize=256)
def automaton(pattern: str) -> Automaton:
    """The automaton that finds a match of the pattern anywhere in a text."""
    built = _Build()
    begin = built.state()
    accept = built.add(read(pattern), begin)
    looks = any(where for jumps in built.jumps for where, _ in jumps)

    sets = sorted({r for steps in built.steps for r, _ in steps} | {((10, 10),), WORD})
    edges = sorted({0} | {x for ranges in sets for a, b in ranges for x in (a, b + 1) if x <= LAST})
    members = [{k for k, ranges in enumerate(sets) if any(a <= e <= b for a, b in ranges)} for e in edges]
    distinct = {m: k for k, m in enumerate(dict.fromkeys(map(frozenset, members)))}
    place = {ranges: k for k, ranges in enumerate(sets)}
    newline, word = place[((10, 10),)], place[WORD]
    looks_like = [NEWLINE if newline in m else WORD_CHAR if word in m else OTHER for m in distinct]
    takes = [[(place[r], to) for r, to in steps] for steps in built.steps]

    @lru_cache(maxsize=None)
    def closure(states: frozenset[int], before: int, after: int) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for where, to in built.jumps[todo.pop()]:
                if to not in found and _holds(where, before, after):
                    found.add(to)
                    todo.append(to)
        return frozenset(found)

    first = (frozenset([begin]), START if looks else OTHER)
    number: dict[tuple, int] = {"before": BEFORE, "found": FOUND, first: 2}
    rows, ends = [[BEFORE] * len(distinct), [FOUND] * len(distinct)], [False, True]
    rows[BEFORE][looks_like.index(NEWLINE)] = 2
    todo = [first]
    for states, before in todo:
        row = []
        for kind, m in enumerate(distinct):
            here = closure(states, before, looks_like[kind] if looks else OTHER)
            if accept in here:
                row.append(FOUND)
                continue
            after = (frozenset({to for s in here for k, to in takes[s] if k in m} | {begin}), looks_like[kind] if looks else OTHER)
            if after not in number:
                number[after] = len(number)
                if len(number) > MOST_STATES:
                    raise TooLarge(f"more than {MOST_STATES} states for {pattern!r}")
                todo.append(after)
            row.append(number[after])
        rows.append(row)
        ends.append(accept in closure(states, before, END))
    table = np.array(rows, dtype=np.int32)
    return Automaton(table, np.array(edges), np.array([distinct[frozenset(m)] for m in members]), np.array(ends))


def finds(pattern: str, text: str) -> bool:
    """Whether the pattern matches somewhere in a text."""
    machine = automaton(pattern)
    return bool(machine.ends[machine.map_of(text.split("\n"))[BEFORE]])
