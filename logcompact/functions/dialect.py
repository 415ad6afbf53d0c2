"""Rule patterns are written for RE2; Spark evaluates java.util.regex. Translate on load."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

from logcompact.functions.automata import TooLarge, most_newlines, read

WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOT_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
SPACE_SET = r"\t\n\f\r "
NEVER = "(?!)"
TEXT_START, TEXT_END = r"\A", r"\z"
# The general categories of characters; other names in \p{...} are scripts.
CATEGORIES = "C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split()


class UnsupportedPattern(ValueError):
    """The pattern is not valid RE2."""


@dataclass(frozen=True)
class Pattern:
    """A translated pattern.

    ``crosses_lines`` is False only when no match can contain a newline; such a pattern can be
    tested line by line even where it is meant for the whole output.
    """

    java: str
    crosses_lines: bool = False
    per_line_anchors: bool = False
    head: str = ""
    body: tuple[str, ...] = ()
    source: str = ""

    def within(self, first: bool, last: bool) -> str:
        """The pattern for whole lines of a longer text, by whether its first and its last line are among them."""
        if not self.per_line_anchors:
            return self.at(first, last)
        swap = {TEXT_START: TEXT_START if first else NEVER, TEXT_END: TEXT_END if last else NEVER}
        return self.head + "".join(swap.get(piece, piece) for piece in self.body)

    @property
    def newlines(self) -> int | None:
        """How many newlines a match can contain at most; None where that is not bounded or not known."""
        if not self.crosses_lines:
            # a match may still end at a text end that is told by the last line
            return 0
        try:
            return most_newlines(read(self.source))
        except TooLarge:
            return None

    def at(self, first: bool, last: bool) -> str:
        """The pattern for one line of a longer text, its anchors resolved by the line's place."""
        if self.per_line_anchors:
            return self.java
        swap = {"^": "^" if first else NEVER, "$": r"\z" if last else NEVER}
        return self.head + "".join(swap.get(piece, piece) for piece in self.body)

    @property
    def anchored(self) -> bool:
        return not self.per_line_anchors and ("^" in self.body or "$" in self.body)


_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")
_TIMES = re.compile(r"([*+?]|\{\d+(?:,\d*)?\})(\??)")
_TIMES_END = re.compile(r"(?<!\\x)\{\d+(?:,\d*)?\}\Z")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_POSIX_NAMES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


def translate(pattern: str) -> Pattern:
    """Translate an RE2 pattern; raise UnsupportedPattern when RE2 itself would refuse it."""
    pieces: list[str] = []
    crosses = multiline = dotall = False
    swaps = [False]  # per open group, whether greedy and lazy are swapped
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\":
            if pattern.startswith(r"\Q", i):
                end = pattern.find(r"\E", i + 2)
                literal = pattern[i + 2 : end if end >= 0 else n]
                crosses |= "\n" in literal
                pieces.append("".join(re.escape(c) for c in literal))
                i = end + 2 if end >= 0 else n
                continue
            piece, step, hits = _escape(pattern, i)
            crosses |= hits
            pieces.append(piece)
            i += step
        elif ch == "[":
            piece, step, hits = _char_class(pattern, i)
            crosses |= hits
            pieces.append(piece)
            i += step
        elif pattern.startswith("(?", i):
            named, flags = _NAMED.match(pattern, i), _FLAGS.match(pattern, i)
            if named:
                swaps.append(swaps[-1])
                pieces.append(f"(?<{named[1].replace('_', '')}>")
                i = named.end()
            elif flags:
                on, off = flags[1], flags[2] or ""
                multiline |= "m" in on
                dotall |= "s" in on
                if flags[3] == ":":
                    swaps.append(swaps[-1])
                if "U" in on + off:
                    swaps[-1] = "U" not in off
                plain, less = on.replace("U", ""), off.replace("U", "")
                said = plain + (f"-{less}" if less else "")
                pieces.append(f"(?{said}{flags[3]}" if said or flags[3] == ":" else "")
                i = flags.end()
            else:
                raise UnsupportedPattern(f"group syntax at {i} in {pattern!r}")
        else:
            after_times = i and (pattern[i - 1] in "*+?" or _TIMES_END.search(pattern, 0, i))
            if ch in "*+?" and after_times and not _is_lazy_mark(pattern, i):
                raise UnsupportedPattern(f"nested repetition at {i} in {pattern!r}")
            crosses |= ch == "\n"
            if ch == "(":
                swaps.append(swaps[-1])
            elif ch == ")" and len(swaps) > 1:
                swaps.pop()
            times = _TIMES.match(pattern, i) if swaps[-1] else None
            if times:  # greedy and lazy change places
                pieces.append(times[1] + ("" if times[2] else "?"))
                i = times.end()
            else:
                pieces.append(ch)
                i += 1
    crosses |= dotall and "." in pieces
    if multiline:  # here ^ and $ are the ends of any line, and those of the text need the text
        crosses |= TEXT_START in pieces or TEXT_END in pieces
    else:
        pieces = [{TEXT_START: "^", TEXT_END: "$"}.get(p, p) for p in pieces]
    head = "(?dm)" if multiline else "(?d)"
    java = head + "".join(r"\z" if p == "$" and not multiline else p for p in pieces)
    _check(java)
    return Pattern(java, crosses, multiline, head, tuple(pieces), pattern)


def to_java(pattern: str) -> str:
    return translate(pattern).java


def is_valid(pattern: str) -> bool:
    try:
        translate(pattern)
    except UnsupportedPattern:
        return False
    return True


def any_of(patterns: list[str] | tuple[str, ...]) -> str:
    """One alternation that matches where any of the translated patterns matches."""
    return "|".join(f"(?:{to_java(p)})" for p in patterns)


def replacement_to_java(replacement: str, pattern: str) -> str:
    """Rewrite a ``$``-template: a word after ``$`` is a whole group name, unknown groups are empty."""
    shape = re.compile(_for_python(to_java(pattern)))
    names = {n.replace("_", "") for n in shape.groupindex}

    def group(match: re.Match[str]) -> str:
        if match[0] == "$$":
            return r"\$"
        name = match[1] or match[2]
        if name is None:
            return r"\$"
        if name.isdigit():
            return "$" + name if int(name) <= shape.groups else ""
        name = name.replace("_", "")
        return f"${{{name}}}" if name in names else ""

    out: list[str] = []
    last = 0
    for match in re.finditer(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$", replacement):
        out.append(replacement[last : match.start()].replace("\\", "\\\\"))
        text = group(match)
        following = replacement[match.end() : match.end() + 1]
        if re.fullmatch(r"\$\d+", text) and following.isdigit():
            # Java would read the next digit as part of the group number.
            out.append(text + "\\" + following)
            last = match.end() + 1
            continue
        out.append(text)
        last = match.end()
    out.append(replacement[last:].replace("\\", "\\\\"))
    return "".join(out)


def _is_lazy_mark(pattern: str, i: int) -> bool:
    """A ``?`` after a repetition makes it lazy; after another lazy mark it is an error."""
    if i >= 2 and pattern[i - 2] == "\\":
        return True
    return pattern[i] == "?" and not (i >= 2 and pattern[i - 1] == "?" and pattern[i - 2] in "*+?}")


def _escape(pattern: str, i: int) -> tuple[str, int, bool]:
    if i + 1 >= len(pattern):
        raise UnsupportedPattern("trailing backslash")
    ch = pattern[i + 1]
    if ch in "pP":
        close = pattern.find("}", i) if pattern[i + 2 : i + 3] == "{" else i + 2
        if close < i + 2:
            raise UnsupportedPattern("open property name")
        name = pattern[i + 2 : close + 1].strip("{}")
        without = (ch == "P") != name.startswith("^")
        name = name.removeprefix("^")
        step, sign = close + 1 - i, "P" if without else "p"
        if name == "Any":
            return (r"[^\x{0}-\x{10ffff}]" if without else r"[\x{0}-\x{10ffff}]"), step, not without
        shown = name if name in CATEGORIES else f"Is{name}"
        # the newline is a control character and in no script but the common one
        holds = name in ("C", "Cc", "Common")
        return f"\\{sign}{{{shown}}}", step, holds != without
    if ch == "x":
        hexa = re.compile(r"\\x(?:\{([0-9A-Fa-f]{1,6})\}|([0-9A-Fa-f]{2}))").match(pattern, i)
        if not hexa:
            raise UnsupportedPattern("bad hexadecimal escape")
        code = int(hexa[1] or hexa[2], 16)
        return f"\\x{{{code:x}}}", hexa.end() - i, code == 10
    simple = {
        "s": (f"[{SPACE_SET}]", True), "S": (f"[^{SPACE_SET}]", False),
        "d": (r"\d", False), "D": (r"\D", True), "w": (r"\w", False), "W": (r"\W", True),
        "b": (WORD_EDGE, False), "B": (NOT_WORD_EDGE, False),
        "A": (TEXT_START, False), "z": (TEXT_END, False), "a": (r"\x07", False),
        "n": (r"\n", True), "r": (r"\r", False), "t": (r"\t", False),
        "f": (r"\f", False), "v": (r"\x0B", False),
    }
    if ch in simple:
        piece, hits = simple[ch]
        return piece, 2, hits
    if ch.isalnum():
        raise UnsupportedPattern(f"escape \\{ch}")
    return "\\" + ch, 2, ch == "\n"


def _char_class(pattern: str, i: int) -> tuple[str, int, bool]:
    start, out = i, ["["]
    i += 1
    negated = pattern.startswith("^", i)
    newline = False
    if negated:
        out.append("^")
        i += 1
    first = True
    while True:
        if i >= len(pattern):
            raise UnsupportedPattern("open character class")
        ch = pattern[i]
        posix = _POSIX.match(pattern, i)
        if posix:
            name = _POSIX_NAMES.get(posix[2])
            if name is None:
                raise UnsupportedPattern(f"class name {posix[2]}")
            out.append(rf"\{'P' if posix[1] else 'p'}{{{name}}}")
            newline |= bool(posix[1]) or name in ("Space", "Cntrl", "ASCII")
            i = posix.end()
        elif ch == "]" and not first:
            out.append("]")
            break
        elif ch == "\\":
            piece, step, hits = _escape(pattern, i)
            name = pattern[i + 1]
            if name in "bBAz":
                raise UnsupportedPattern(f"\\{name} in a class")
            out.append({"s": SPACE_SET, "S": r"\S"}.get(name, piece))
            newline |= hits
            i += step
        else:
            out.append("\\" + ch if ch in "[]&^" else ch)
            newline |= ch == "\n"
            i += 1
        first = False
    # A plain class holds a newline when listed; a negated one unless listed.
    return "".join(out), i + 1 - start, newline != negated


def _for_python(java: str) -> str:
    shape = re.sub(r"^\(\?(dm?)\)", lambda m: "(?m)" if m[1] == "dm" else "", java)
    shape = shape.replace(r"\x{10ffff}", r"\uffff").replace(r"\z", r"\Z").replace("(?<", "(?P<").replace("(?P<=", "(?<=")
    shape = shape.replace("(?P<!", "(?<!")
    shape = re.sub(r"\\[pP](\{\w+\}|\w)", "a", shape)
    shape = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", shape)
    return re.sub(r"\(\?([ims]*)(?:-[ims]+)?\)", "", shape)


@lru_cache(maxsize=4096)
def _check(java: str) -> None:
    try:
        re.compile(_for_python(java))
    except (re.error, OverflowError) as exc:
        raise UnsupportedPattern(str(exc)) from exc
    context = SparkContext._active_spark_context
    if context is not None:  # what will evaluate it has the last word
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except IllegalArgumentException as exc:
            raise UnsupportedPattern(str(exc)) from exc
