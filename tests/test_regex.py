from scrubline.functions import regex as RX
from scrubline.operators.patterns import BUILTINS, BUILTIN_NAMES


def test_boundary_before_and_after_word_atoms():
    assert RX.to_java(r"\bab\b").pattern == r"(?<!\w)ab(?!\w)"
    assert RX.to_java(r"\b[A-Za-z0-9/+]{40}\b").pattern == RX.ASCII_BOUNDARY + r"[A-Za-z0-9/+]{40}" + RX.ASCII_BOUNDARY


def test_generic_boundary_and_non_boundary():
    assert RX.to_java(r"\b(?:x|y)").pattern == RX.ASCII_BOUNDARY + "(?:x|y)"
    assert RX.to_java(r"a\Bb").pattern == "a" + RX.ASCII_NON_BOUNDARY + "b"


def test_dollar_and_flags():
    t = RX.to_java(r"ab$", "i")
    assert t.pattern == r"(?i)ab\z" and not t.global_
    assert RX.to_java(r"ab$", "gm").pattern == "(?m)ab$"
    assert RX.to_java("ab", "y").pattern == r"\G(?:ab)"


def test_js_only_classes():
    assert RX.to_java("[^]").pattern == r"[\s\S]"
    assert RX.to_java("[]").pattern == "(?!)"
    assert RX.to_java("[a[]").pattern == r"[a\[]"
    assert RX.to_java("a{x").pattern == r"a\{x"


def test_re2_long_repeat_split():
    p = RX.to_re2("[A-Z]{100,2000}").pattern
    assert p == "(?:[A-Z]{100,1000}[A-Z]{0,1000})"


def test_all_builtins_translate():
    assert len(BUILTIN_NAMES) == 51
    for name in BUILTIN_NAMES:
        b = BUILTINS[name]
        assert b.java and b.re2
        assert r"\b" not in b.java  # Unicode-aware in Java 17: always rewritten


def test_quote_literal_and_groups():
    assert RX.quote_literal("a.b(c)") == r"a\.b\(c\)"
    assert RX.capture_group_count("(a)(?:b)(?<n>c)(?=d)") == 2
