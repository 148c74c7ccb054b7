"""JavaScript regex source -> Java (Spark) and RE2 (DuckDB) dialects.

Rules are written in JavaScript regex syntax.  Spark evaluates regexes with
``java.util.regex``; the DuckDB oracle uses RE2.  The differences that change
results are handled here, at plan time, on the driver:

* ``\\b`` / ``\\B``: JavaScript word boundaries are ASCII; Java 17's are
  Unicode-aware (``é4111...`` would lose its boundary).  Java gets explicit
  ASCII look-arounds; RE2 is ASCII already.
* ``$`` without the ``m`` flag means end of input in JavaScript; Java's ``$``
  also matches before a final line terminator, so it becomes ``\\z``.
* ``[^]`` / ``[]`` / ``[`` and ``&&`` inside classes, ``\\0``, ``\\u{...}``,
  ``\\cX`` and a literal ``{`` are JS spellings that Java reads differently.
* flags: ``i m s`` become inline groups, ``y`` (sticky) becomes ``\\G``;
  a missing ``g`` means "first match only" and is reported to the caller.
* RE2 caps counted repetition at 1000: ``{m,n}`` with ``n > 1000`` is split
  into two adjacent repeats.

``\\s`` keeps each engine's ASCII meaning (documented deviation: JavaScript
also counts Unicode spaces).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = r"\w"
# ASCII word boundary / non-boundary spelled with look-arounds (Java).
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
ASCII_NON_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
BOUNDARY_BEFORE_WORD = r"(?<!\w)"
BOUNDARY_AFTER_WORD = r"(?!\w)"

_QUANT_RE = re.compile(r"\{(\d+)(,(\d*))?\}")
_WORD_ONLY_CLASS = re.compile(r"^(?:[A-Za-z0-9_]-[A-Za-z0-9_]|[A-Za-z0-9_]|\\d|\\w)+$")


@dataclass(frozen=True)
class Translated:
    pattern: str        # pattern text for the target engine
    global_: bool       # False -> only the first match counts


class RegexSyntaxError(ValueError):
    pass


def _tokens(src: str):
    """Split a JS regex body into (kind, text) tokens.

    kinds: 'esc' (backslash escape), 'class' (a whole [...] class),
    'open' '(' with its group prefix, 'close', 'quant', 'alt', 'char'.
    """
    i, n = 0, len(src)
    out = []
    while i < n:
        c = src[i]
        if c == "\\":
            if i + 1 >= n:
                raise RegexSyntaxError("trailing backslash")
            j = i + 2
            nxt = src[i + 1]
            if nxt == "u" and j < n and src[j] == "{":
                k = src.find("}", j)
                if k < 0:
                    raise RegexSyntaxError("bad \\u{")
                j = k + 1
            elif nxt == "u":
                j = i + 6
            elif nxt == "x":
                j = i + 4
            elif nxt == "c":
                j = i + 3
            elif nxt == "k" and j < n and src[j] == "<":
                j = src.index(">", j) + 1
            out.append(("esc", src[i:j]))
            i = j
        elif c == "[":
            j = i + 1
            if j < n and src[j] == "^":
                j += 1
            # In JS a ']' right after '[' or '[^' closes the class ([] / [^]).
            while j < n and src[j] != "]":
                j += 2 if src[j] == "\\" else 1
            if j >= n:
                raise RegexSyntaxError("unterminated character class")
            out.append(("class", src[i:j + 1]))
            i = j + 1
        elif c == "(":
            j = i + 1
            if src.startswith("?:", j) or src.startswith("?=", j) or src.startswith("?!", j):
                j += 2
            elif src.startswith("?<=", j) or src.startswith("?<!", j):
                j += 3
            elif src.startswith("?<", j):
                j = src.index(">", j) + 1
            out.append(("open", src[i:j]))
            i = j
        elif c == ")":
            out.append(("close", c))
            i += 1
        elif c in "*+?":
            j = i + 1
            if j < n and src[j] == "?":
                j += 1
            out.append(("quant", src[i:j]))
            i = j
        elif c == "{":
            m = _QUANT_RE.match(src, i)
            if m:
                j = m.end()
                if j < n and src[j] == "?":
                    j += 1
                out.append(("quant", src[i:j]))
                i = j
            else:
                out.append(("char", "\\{"))  # JS reads a stray '{' as a literal
                i += 1
        elif c == "|":
            out.append(("alt", c))
            i += 1
        else:
            out.append(("char", c))
            i += 1
    return out


def _min_repeat(quant: str | None) -> int:
    if quant is None:
        return 1
    if quant[0] in "*?":
        return 0
    if quant[0] == "+":
        return 1
    return int(_QUANT_RE.match(quant).group(1))


def _is_word_atom(tok) -> bool:
    kind, text = tok
    if kind == "char":
        return bool(re.fullmatch(r"[A-Za-z0-9_]", text))
    if kind == "esc":
        return text in (r"\d", r"\w")
    if kind == "class":
        body = text[1:-1]
        return not body.startswith("^") and bool(_WORD_ONLY_CLASS.match(body))
    return False


def _java_class(text: str) -> str:
    body = text[1:-1]
    neg = body.startswith("^")
    if neg:
        body = body[1:]
    if body == "":
        return r"[\s\S]" if neg else "(?!)"
    out = []
    i = 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            esc = body[i:i + 2]
            if esc == r"\b":
                out.append(r"\x08")
            elif esc == r"\0":
                out.append(r"\x00")
            elif body.startswith(r"\u{", i):
                k = body.index("}", i)
                out.append(r"\x{" + body[i + 3:k] + "}")
                i = k + 1
                continue
            else:
                out.append(esc)
            i += 2
            continue
        if c == "[":
            out.append(r"\[")
        elif c == "&" and i + 1 < len(body) and body[i + 1] == "&":
            out.append(r"&\&")
            i += 2
            continue
        else:
            out.append(c)
        i += 1
    return "[" + ("^" if neg else "") + "".join(out) + "]"


def to_java(src: str, flags: str = "g") -> Translated:
    """Translate a JS regex body + flags to a Java pattern string."""
    flags = flags or ""
    toks = _tokens(src)
    out = []
    for idx, (kind, text) in enumerate(toks):
        if kind == "esc":
            if text == r"\b":
                nxt = toks[idx + 1] if idx + 1 < len(toks) else None
                nq = toks[idx + 2][1] if idx + 2 < len(toks) and toks[idx + 2][0] == "quant" else None
                prv = toks[idx - 1] if idx >= 1 else None
                prev_atom, prev_q = None, None
                if prv is not None and prv[0] == "quant" and idx >= 2:
                    prev_atom, prev_q = toks[idx - 2], prv[1]
                elif prv is not None:
                    prev_atom = prv
                if nxt is not None and _is_word_atom(nxt) and _min_repeat(nq) >= 1:
                    out.append(BOUNDARY_BEFORE_WORD)
                elif prev_atom is not None and _is_word_atom(prev_atom) and _min_repeat(prev_q) >= 1:
                    out.append(BOUNDARY_AFTER_WORD)
                else:
                    out.append(ASCII_BOUNDARY)
            elif text == r"\B":
                out.append(ASCII_NON_BOUNDARY)
            elif text == r"\0":
                out.append(r"\x00")
            elif text.startswith(r"\u{"):
                out.append(r"\x{" + text[3:-1] + "}")
            else:
                out.append(text)
        elif kind == "class":
            out.append(_java_class(text))
        elif kind == "char" and text == "$" and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(text)
    prefix = ""
    inline = "".join(f for f in "ims" if f in flags)
    if inline:
        prefix += f"(?{inline})"
    body = "".join(out)
    if "y" in flags:
        body = r"\G(?:" + body + ")"
    return Translated(prefix + body, "g" in flags)


def to_re2(src: str, flags: str = "g") -> Translated:
    """Translate a JS regex body to RE2 (DuckDB); look-arounds are rejected."""
    if re.search(r"\(\?<?[=!]", src):
        raise RegexSyntaxError("RE2 has no look-around")
    toks = _tokens(src)
    out = []
    for kind, text in toks:
        if kind == "quant" and text.startswith("{"):
            m = _QUANT_RE.match(text)
            lo, has_comma, hi = int(m.group(1)), m.group(2), m.group(3)
            lazy = text.endswith("?")
            if has_comma and hi and int(hi) > 1000:
                # x{lo,hi} == x{lo,1000}x{0,hi-1000} for a single atom.
                atom = out.pop()
                q2 = "?" if lazy else ""
                out.append(f"(?:{atom}{{{lo},1000}}{q2}{atom}{{0,{int(hi) - 1000}}}{q2})")
                continue
            out.append(text)
        elif kind == "char" and text == "$" and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(text)
    inline = "".join(f for f in "ims" if f in flags)
    body = "".join(out)
    return Translated((f"(?{inline})" if inline else "") + body, "g" in flags)


def quote_literal(text: str) -> str:
    """Regex that matches ``text`` literally (Java and RE2)."""
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}" else c for c in text)


def capture_group_count(src: str) -> int:
    """Number of capturing groups in a JS regex body."""
    return sum(1 for kind, text in _tokens(src) if kind == "open" and (text == "(" or (text.startswith("(?<") and text not in ("(?<=", "(?<!"))))
