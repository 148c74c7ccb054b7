"""The span primitive: every match of a regex with its offsets.

Spark has no "all matches with positions" function.  For a pattern ``p``
that cannot match the empty string, ``regexp_extract_all(x, p, 0)`` gives the
matches m_0..m_k and ``split(x, p, -1)`` the k+1 gaps g_0..g_k around them
(empty leading / trailing gaps are kept).  The start of m_i is
``sum(len(g_j), j <= i) + sum(len(m_j), j < i)``.  Both calls use the same
``Matcher.find`` loop, so they agree match for match.

Offsets are produced twice: in code points (``start``/``end``, what Spark's
``substring`` and DuckDB's ``length`` count) and in UTF-8 bytes
(``bstart``/``bend``), which let the splice cut the text in O(length) with
binary ``substr`` instead of re-walking the string per detection.

Everything here is SQL expression text for one row: narrow, no shuffle.
Patterns stay literals, so each is compiled once per task.
"""

from __future__ import annotations

from scrubline.functions.sqlx import name, q

SPAN_FIELDS = "start:int, end:int, bstart:int, bend:int, seq:int, match:string"
SPAN_TYPE = f"ARRAY<STRUCT<{SPAN_FIELDS}>>"
EMPTY_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def matches(x: str, pattern: str, group: int = 0, first_only: bool = False, guard: str | None = None) -> str:
    """``array<string>`` of all matches of ``pattern`` in ``x`` (or the first),
    or group ``group`` of each.  ``guard`` is a cheap necessary condition (a
    literal every match contains): rows failing it skip the regex."""
    m = f"regexp_extract_all({x}, {q(pattern)}, {group})"
    if first_only:
        m = f"slice({m}, 1, 1)"
    if guard is not None:
        m = f"CASE WHEN {guard} THEN {m} ELSE {EMPTY_STRINGS} END"
    return f"coalesce({m}, {EMPTY_STRINGS})"


#: Pairs folded at once: a fold appends to an array of at most this size.
FOLD_BLOCK = 64


def block_fold(pairs: str, acc: str, p: str, item: str, out_type: str) -> str:
    """``item`` for every (gap, match) pair, with the summed lengths before
    it in ``acc.pos`` / ``acc.bpos`` and its number ``acc.n0 + size(acc.out)``.

    The pairs are cut into blocks; a first pass sums up each block's
    lengths, a second turns the sums into offsets, a third folds every block
    from its offset.  So no array grows with the square of the matches."""
    from scrubline.functions.sqlx import let
    k, i, a, b, o, w, f = (name(v) for v in "kiabowf")

    def blocks(all_pairs):
        cut = (f"transform(sequence(0, greatest(CAST(ceil(size({all_pairs}) / {FOLD_BLOCK}.0D) AS INT), 1) - 1), "
               f"{i} -> slice({all_pairs}, {i} * {FOLD_BLOCK} + 1, {FOLD_BLOCK}))")

        def folded(bl):
            one = (f"aggregate({k}, named_struct('c', 0, 'b', 0), ({a}, {b}) -> named_struct("
                   f"'c', {a}.c + length({b}.g) + length({b}.m), 'b', {a}.b + octet_length({b}.g) + octet_length({b}.m)))")
            sums = f"transform({bl}, {k} -> {one})"
            start = (f"aggregate({sums}, named_struct('c', 0, 'b', 0, 'o', CAST(array() AS ARRAY<STRUCT<c:INT, b:INT>>)), ({o}, {w}) -> "
                     f"named_struct('c', {o}.c + {w}.c, 'b', {o}.b + {w}.b, 'o', concat({o}.o, array(named_struct('c', {o}.c, 'b', {o}.b)))), {o} -> {o}.o)")
            step = (f"named_struct('pos', {acc}.pos + length({p}.g) + length({p}.m), 'bpos', {acc}.bpos + octet_length({p}.g) + octet_length({p}.m), "
                    f"'n0', {acc}.n0, 'out', concat({acc}.out, array({item})))")

            def from_offsets(off):
                init = (f"named_struct('pos', get({off}, {f}).c, 'bpos', get({off}, {f}).b, 'n0', {f} * {FOLD_BLOCK}, "
                        f"'out', CAST(array() AS {out_type}))")
                return f"flatten(transform({bl}, ({k}, {f}) -> aggregate({k}, {init}, ({acc}, {p}) -> {step}, {acc} -> {acc}.out)))"
            return let(start, from_offsets)
        return let(cut, folded)
    return let(pairs, blocks)


def spans_from(x: str, m: str, pattern: str) -> str:
    """Offsets for the matches ``m`` (an array column holding the result of
    :func:`matches`) of ``pattern`` in ``x``; the split runs only on rows
    that have a match."""
    a, b, acc, p = name("a"), name("b"), name("s"), name("p")
    pairs = (f"zip_with({m}, slice(split({x}, {q(pattern)}, -1), 1, greatest(size({m}), 1)), "
             f"({a}, {b}) -> named_struct('m', {a}, 'g', {b}))")
    s = f"({acc}.pos + length({p}.g))"
    bs = f"({acc}.bpos + octet_length({p}.g))"
    item = (f"named_struct('start', {s}, 'end', {s} + length({p}.m), 'bstart', {bs}, "
            f"'bend', {bs} + octet_length({p}.m), 'seq', {acc}.n0 + size({acc}.out), 'match', {p}.m)")
    return f"CASE WHEN size({m}) > 0 THEN {block_fold(pairs, acc, p, item, SPAN_TYPE)} ELSE CAST(array() AS {SPAN_TYPE}) END"
