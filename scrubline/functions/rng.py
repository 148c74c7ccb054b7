"""Seeded pseudo-random helpers as Spark SQL expressions.

The fake values are a pure function of the matched text: ``js_hash`` turns
the whole text into a 31-bit seed (djb2 over its UTF-16 code units),
and ``rng_values`` runs xorshift128 on 32-bit integer state from that seed.
Both are higher-order SQL functions (``aggregate``), evaluated in the
executor JVM; there is no Python per row.

Integer semantics: the state words are INT so ``shiftleft`` wraps like a
32-bit machine word and ``shiftrightunsigned`` is a logical shift; the hash
uses BIGINT with a 31-bit mask (ANSI mode never sees an overflow).

All functions take and return SQL expression *text* (see ``sqlx``);
``*_col`` variants wrap them as Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions.sqlx import ident, let, name, q

_M31 = FX.RNG_MODULUS  # 2**31 - 1


def _i32(v: int) -> int:
    v &= 0xFFFFFFFF
    return v - (1 << 32) if v >= (1 << 31) else v


_X1, _X2, _X3 = (_i32(x) for x in FX.RNG_SEED_XORS)


def js_hash(s: str) -> str:
    """djb2 (h = h*33 + unit, masked to 31 bits) over the UTF-16 code
    units of ``s``; 0 maps to 1.  Supplementary characters contribute
    their two surrogate units, as JavaScript ``charCodeAt`` sees them.
    The empty string hashes to 5381 (the original falls back to the clock
    there; matches are never empty)."""
    a, c = name("h"), name("c")
    cp = f"ascii({c})"
    hi = f"(55296 + shiftright({cp} - 65536, 10))"
    lo = f"(56320 + (({cp} - 65536) & 1023))"
    step = (f"CASE WHEN {cp} >= 65536 THEN (((({a} * 33 + {hi}) & {_M31}) * 33 + {lo}) & {_M31}) "
            f"ELSE (({a} * 33 + {cp}) & {_M31}) END")
    def fold(step):
        return (f"aggregate(split({s}, '', -1), CAST({FX.HASH_START} AS BIGINT), ({a}, {c}) -> {step}, "
                f"{a} -> CASE WHEN {a} = 0 THEN CAST(1 AS BIGINT) ELSE {a} END)")
    # a text of single bytes holds no surrogates
    return (f"CASE WHEN {s} = '' THEN CAST({FX.HASH_START} AS BIGINT) WHEN octet_length({s}) = length({s}) "
            f"THEN {fold(f'(({a} * 33 + ascii({c})) & {_M31})')} ELSE {fold(step)} END")


def _seed(seed: str) -> str:
    return f"CAST(CASE WHEN ({seed}) % {_M31} = 0 THEN 1 ELSE ({seed}) % {_M31} END AS INT)"


def _next_a(acc: str) -> str:
    d, a = f"{acc}.d", f"{acc}.a"
    t1 = f"({d} ^ shiftleft({d}, 11))"
    return f"(({t1} ^ shiftrightunsigned({t1}, 8)) ^ {a} ^ shiftrightunsigned({a}, 19))"


def _init_state(s: str, extra: str = "") -> str:
    return f"named_struct('a', {s}, 'b', {s} ^ {_X1}, 'c', {s} ^ {_X2}, 'd', {s} ^ {_X3}{extra})"


def _value(na: str) -> str:
    return f"(abs(CAST({na} AS BIGINT)) / {float(_M31)}D)"


def rng_values(seed: str, n: str | int) -> str:
    """``array<double>``: the first ``n`` outputs after the 10 warm-up steps
    of xorshift128 seeded with ``seed`` (a positive BIGINT expression)."""
    def body(s):
        # the word drawn by a step is put down by the next one, so that it is made once
        acc, i, z = name("r"), name("i"), name("z")
        step = (f"named_struct('a', {_next_a(acc)}, 'b', {acc}.a, 'c', {acc}.b, 'd', {acc}.c, "
                f"'v', CASE WHEN {i} > {FX.RNG_WARMUP + 1} THEN concat({acc}.v, array({acc}.a)) ELSE {acc}.v END)")
        init = _init_state(s, ", 'v', CAST(array() AS ARRAY<INT>)")
        return (f"transform(aggregate(sequence(1, greatest({n}, 0) + {FX.RNG_WARMUP + 1}), {init}, "
                f"({acc}, {i}) -> {step}, {acc} -> {acc}.v), {z} -> {_value(z)})")
    return let(_seed(seed), body)


def next_int(vals: str, k: int | str, lo: int, hi: int) -> str:
    """Draw ``k`` (0-based) mapped to an integer in [lo, hi]."""
    return f"CAST(floor(get({vals}, {k}) * {hi - lo + 1}) + {lo} AS BIGINT)"


def _pick(val: str, alphabet: str) -> str:
    """The character of ``alphabet`` that the draw ``val`` picks."""
    return f"coalesce(get(split({q(alphabet)}, '', -1), CAST(floor({val} * {len(alphabet)}) AS INT)), 'undefined')"


def pick_chars(vals: str, k: int | str, n: int | str, alphabet: str) -> str:
    """String of ``n`` characters of ``alphabet`` from draws k, k+1, ...
    (n <= 0 gives ''); a draw of exactly 1.0 indexes past the
    alphabet and yields 'undefined', as in JavaScript."""
    z = name("z")
    n_ok = f"greatest({n}, 0)"
    return f"array_join(transform(slice({vals}, ({k}) + 1, {n_ok}), {z} -> {_pick(z, alphabet)}), '')"


def alnum(vals: str, k: int | str, n: int | str) -> str:
    return pick_chars(vals, k, n, FX.ALNUM_ALPHABET)


def hexs(vals: str, k: int | str, n: int | str) -> str:
    return pick_chars(vals, k, n, FX.HEX_ALPHABET)


def preserve_shape(s: str) -> str:
    """Per character, a-z / A-Z / 0-9 are
    replaced by a random character of the same class (one draw each), other
    characters kept; seeded by ``js_hash(s)``; empty -> '[REDACTED]'."""
    def body(seed):
        w, wi = name("w"), name("i")
        warm_step = (f"named_struct('a', {_next_a(w)}, 'b', {w}.a, 'c', {w}.b, 'd', {w}.c, "
                     f"'out', {w}.out)")
        warm = (f"aggregate(sequence(1, {FX.RNG_WARMUP}), {_init_state(seed, ", 'out', ''")}, "
                f"({w}, {wi}) -> {warm_step})")
        acc, ch = name("p"), name("ch")
        na = _next_a(acc)
        val = _value(na)
        lower = f"({ch} >= 'a' AND {ch} <= 'z')"
        upper = f"({ch} >= 'A' AND {ch} <= 'Z')"
        digit = f"({ch} >= '0' AND {ch} <= '9')"
        draw = f"({lower} OR {upper} OR {digit})"

        def pick(alpha):
            return _pick(val, alpha)
        newch = (f"CASE WHEN {lower} THEN {pick(FX.LOWER_ALPHABET)} WHEN {upper} THEN {pick(FX.UPPER_ALPHABET)} "
                 f"WHEN {digit} THEN {pick(FX.DIGIT_ALPHABET)} ELSE {ch} END")
        step = (f"named_struct("
                f"'a', CASE WHEN {draw} THEN {na} ELSE {acc}.a END, "
                f"'b', CASE WHEN {draw} THEN {acc}.a ELSE {acc}.b END, "
                f"'c', CASE WHEN {draw} THEN {acc}.b ELSE {acc}.c END, "
                f"'d', CASE WHEN {draw} THEN {acc}.c ELSE {acc}.d END, "
                f"'out', concat({acc}.out, {newch}))")
        out = (f"aggregate(split({s}, '', -1), {warm}, ({acc}, {ch}) -> {step}, "
               f"{acc} -> {acc}.out)")
        return let(out, lambda o: f"CASE WHEN {o} = '' THEN {q(FX.REDACTED)} ELSE {o} END")
    shaped = let(_seed(js_hash(s)), body)
    return f"CASE WHEN {s} IS NULL OR {s} = '' THEN {q(FX.REDACTED)} ELSE {shaped} END"


# ---------------------------------------------------------------- Columns

def js_hash_col(col: str) -> Column:
    return F.expr(js_hash(ident(col)))


def preserve_shape_col(col: str) -> Column:
    return F.expr(preserve_shape(ident(col)))
