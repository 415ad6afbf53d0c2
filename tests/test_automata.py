import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logcompact.functions.automata import BEFORE, TooLarge, automaton, composed, finds, most_newlines, read

# The same pattern for both; \B and empty texts are left out, which the other matcher treats in its own way.
ATOMS = ["a", "b", ".", r"\n", "[^a]", r"\s", r"\S", r"\w", r"\D", "(?s:.)", r"[\s\S]", r"[a-c\n]", "^", r"\b", "(?m:^)", "(?m:$)", r"\x61", "(?i:A)", "[]a]", r"\."]
shapes = st.recursive(
    st.sampled_from(ATOMS),
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join),
        st.lists(inner, min_size=2, max_size=3).map(lambda x: "(?:" + "|".join(x) + ")"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{1,3}", "{2,}", "*?", "{0,2}?"])).map(lambda x: f"(?:{x[0]}){x[1]}"),
    ),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(shapes, st.text("ab\n xA1_-é.", min_size=1, max_size=14))
def test_the_same_texts_match(pattern, text):
    try:
        found = finds(pattern, text)
    except TooLarge:
        return
    assert found == bool(re.compile(pattern, re.ASCII).search(text))


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        (r"[[:alpha:]_]{2}$", "1\nx_", "x_\n"), (r"\Aab\z", "ab", "ab\n"), (r"\Qa.b\E+", "a.bb", "axb"), ("(?i)STRASSE|é", "É", "e"),
        (r"\p{Lu}\P{Lu}", "xÄä", "äÄ"), (r"[^\d\s]-[\]a-]", "x--", "1--"), ("(?P<n>a|b){3}", "xabab", "ab"), (r"\x{e9}\x41", "éA", "e"),
        ("(?s)a.*(?-s).z", "a\n\nqz", "a\n\n\nz"), ("(?m)^$", "a\n\nb", "a\nb"), ("x{2", "x{2", "xx"), (r"[a\-z]b", "-b", "mb"), ("", "", None),
        ("(?U)a+b", "aab", "b"), (r"\pL\d", "ü1", "1ü"), (r"(a(?i)b|c)D", "CD", "Cd"), ("a||b", "", None),
    ],
)
def test_forms_of_patterns(pattern, yes, no):
    assert finds(pattern, yes)
    assert no is None or not finds(pattern, no)


def test_maps_of_pieces_compose():
    machine = automaton(r"(?s)one.*\btwo\b[^\n]*$")
    lines = ["", "x one", "é" * 700, None, "y", "two", "a two b"]
    whole = machine.map_of(lines)
    for cut in range(len(lines) + 1):
        parts = np.stack([machine.map_of(lines[:cut]), machine.map_of(lines[cut:])])
        assert (composed(parts) == whole).all()
    assert (composed(np.stack([machine.map_of([x]) for x in lines])) == whole).all()
    assert machine.ends[whole[BEFORE]]


@pytest.mark.parametrize("pattern, most", [("a.b", 0), (r"a\nb?\n{2}", 3), (r"(a|\n\n)\n?", 3), (r"\s+", None), ("(?s)a.{3}", 3), (r"(?:^\n$)*", None), (r"[^a]|b", 1), (r"\n{0}x*", 0)])
def test_newlines_of_a_match(pattern, most):
    assert most_newlines(read(pattern)) == most


def test_what_has_no_automaton():
    with pytest.raises(TooLarge):
        automaton("(?s)a.{20}b.*c")
    with pytest.raises(TooLarge):
        automaton(r"\p{Greek}")
