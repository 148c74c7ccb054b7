"""Detection: rules -> candidate spans -> conflict resolution -> detections.

The rule set is compiled on the driver into a list of regex *specs* (one per
builtin / literal / regex rule, sixteen per key-value rule).  On the
executors each row goes through a fixed chain of projections, with no
shuffle:

1. ``__m<i>``: all matches of spec *i* (skipped when its guard literal is
   absent);
2. ``__s<i>``: offsets of those matches (split lengths, see ``spans``);
3. ``__cands``: candidate structs of all rules, key-value duplicates
   removed and short / boolean / numeric values dropped, sorted by
   (start, rule rank, template, match number);
4. ``__res``: the conflict fold (D8): walking candidates by start, a
   candidate overlapping the current survivor replaces it only with a
   strictly smaller priority number, otherwise it is dropped;
5. ``__dets``: survivors ordered by (priority, start) with rule metadata
   and the generated replacement (only survivors are generated).

Every step is a built-in higher-order function over the row's own arrays,
so a row is processed by one task in one pass, and partitions are
independent.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline import fixed as FX
from scrubline.functions import generators as G
from scrubline.functions import regex as RX
from scrubline.functions import rng as R
from scrubline.functions.spans import block_fold
from scrubline.functions.sqlx import ident, let, name, q
from scrubline.operators.patterns import BUILTINS, global_priority
from scrubline.operators.rules import Rule, rank_rule_list

CAND_FIELDS = ("start:int, rank:int, sub:int, seq:int, end:int, bstart:int, bend:int, prio:int, "
               "match:string, vstart:int, vend:int")
CAND_TYPE = f"ARRAY<STRUCT<{CAND_FIELDS}>>"

DETECTION_FIELDS = ("rule_id string, rule_name string, category string, pattern string, match string, "
                    "start int, end int, replacement string, selected boolean")
CONTEXT_TYPE = "struct<before:string, match:string, after:string, full:string>"


@dataclass
class Options:
    """Per-call options (SanitizeOptions / DetectOptions)."""
    selected_rule_ids: list[str] | None = None
    include_context: bool = False
    context_length: int = FX.DEFAULT_CONTEXT_LENGTH
    jwt_epoch: int = FX.DEFAULT_JWT_EPOCH
    kv_fixed_replacement: bool = False
    # False: detection only -- ``replacement`` is left null and no generator
    # is planned or run (for counts and span reports)
    generate_replacements: bool = True


@dataclass
class Spec:
    rank: int
    sub: int
    java: str
    first_only: bool = False
    guard: tuple[str, ...] = ()
    guard_lower: bool = False
    kv: bool = False
    trail_quote: bool = False   # template may end with a closing quote after the value
    key_groups: bool = False    # key pattern has its own capture groups
    sign: str = ""              # a literal that every match holds besides the guard
    shape: str = ""             # a regex found in every text that holds a match
    prefixed: str = ""          # a regex; where it is not found, earlier templates of the rule find all of these matches


@dataclass
class Compiled:
    ranked: list[Rule]
    prio: list[int]
    specs: list[Spec] = field(default_factory=list)
    word_rank: int | None = None   # the rank that all words of a word table share
    strategy: str = "generic"


_PLAIN_KEY = re.compile(r"^[A-Za-z0-9_]+$")


def _kv_specs(rank: int, key: str) -> list[Spec]:
    cap = key[:1].upper() + key[1:]
    variations = []
    for v in FX.KV_KEY_VARIATIONS:
        variations.append(v.format(key=key, Key=cap))
    # The 2nd and 4th variations differ from the 1st and 3rd only by the
    # case of one letter; under the case-insensitive flag they find exactly
    # the same matches and are removed by the (start, match) de-duplication,
    # so they are not run.
    distinct = [variations[0], variations[2], variations[4]]
    # A match of a prefixed key may start only where its run of prefix
    # characters starts: a later start reaches no key that this one missed.
    # (``\\G``: right after a match; the last two: the run's first character
    # is barred by the template's own look-behind, so the second stands in.)
    classes = [None, "a-zA-Z", "a-zA-Z_"]
    specs = []
    groups = RX.capture_group_count(key) > 0
    guard = (key.lower(),) if _PLAIN_KEY.match(key) else ()
    # A text where no key has a prefix: the prefixed templates find there
    # just what the plain ones find, start for start.
    prefixed = f"(?i)[a-zA-Z_]{key}" if guard else ""
    sub = 0
    for kvar, cls in zip(distinct, classes):
        start = rf"(?:(?<![{cls}])|\G|(?<=https?:[{cls}])|(?<=ftp:[{cls}]))"
        for t_no, tmpl in enumerate(FX.KV_TEMPLATES):
            java = RX.to_java(tmpl.format(k=kvar, K=kvar.upper()), "gi").pattern
            if cls and t_no in (1, 2, 3):
                java = java.replace("(?i)", "(?i)" + start, 1)
            elif cls and t_no == 4:
                java = java.replace(r"(?:API\s+)?", rf"(?:API\s+|{start})", 1)
            specs.append(Spec(rank, sub, java, guard=guard, guard_lower=True, kv=True,
                              trail_quote=t_no in (0, 1, 2, 3), key_groups=groups, sign=":" if t_no < 2 else "=",
                              prefixed=prefixed if cls else ""))
            sub += 1
    if key.lower() == "secret":
        # the template's nested loop is any run of two or more that ends alphanumerically
        java = RX.to_java(FX.KV_SECRET_LOG_TEMPLATE.replace("(?:[a-zA-Z0-9_]*[a-zA-Z0-9])+", "[a-zA-Z0-9]"), "gi").pattern
        specs.append(Spec(rank, sub, java, guard=("secret",),
                          guard_lower=True, kv=True, key_groups=groups))
    return specs


#: Stands for all words of a word table in the ranking: after the literal rules.
WORDS_RULE = Rule(id=None, type="literal", pattern="", category=None)


def compile_rules(rules: list[Rule], spark=None, words: bool = False, strategy: str = "generic") -> Compiled:
    """Rank enabled rules (B6), assign priorities (B7) and build specs (D5);
    with ``words``, a word table takes part as one more literal."""
    ranked = rank_rule_list([*rules, WORDS_RULE] if words else rules)
    first_prio: dict[str | None, int] = {}
    for r in ranked:
        first_prio.setdefault(r.id, global_priority(r.type, r.pattern))
    prio = [first_prio[r.id] for r in ranked]
    comp = Compiled(ranked, prio, strategy=strategy)
    if words:
        comp.word_rank = next(k for k, r in enumerate(ranked) if r is WORDS_RULE)
        prio[comp.word_rank] = global_priority("literal", None)
    for rank, r in enumerate(ranked):
        if r.type == "builtin":
            b = BUILTINS.get(r.pattern)
            if b is None:
                warnings.warn(f"unknown builtin pattern: {r.pattern}")
                continue
            comp.specs.append(Spec(rank, 0, b.java, guard=b.guard, guard_lower=b.guard_lower, shape=b.shape))
        elif r.type == "literal":
            if not r.pattern:
                continue
            if r.case_sensitive is False:
                # without the u flag JavaScript folds no other character onto ASCII
                java = ("(?i)" if r.pattern.isascii() else "(?iu)") + RX.quote_literal(r.pattern)
                guard = (r.pattern.lower(),) if r.pattern.isascii() else ()
                comp.specs.append(Spec(rank, 0, java, guard=guard, guard_lower=True))
            else:
                comp.specs.append(Spec(rank, 0, RX.quote_literal(r.pattern), guard=(r.pattern,)))
        elif r.type == "regex":
            if not r.pattern:
                continue
            try:
                tr = RX.to_java(r.pattern, r.flags or "g")
            except (RX.RegexSyntaxError, ValueError):
                warnings.warn(f"rule {r.id}: regex does not translate; skipped")
                continue
            if spark is not None and not _compiles_nonempty(spark, tr.pattern):
                warnings.warn(f"rule {r.id}: regex invalid or matches the empty string; skipped")
                continue
            comp.specs.append(Spec(rank, 0, tr.pattern, first_only=not tr.global_))
        elif r.type == "kv":
            if not r.pattern:
                continue
            comp.specs.extend(_kv_specs(rank, r.pattern))
        else:
            warnings.warn(f"unknown rule type: {r.type}")
    return comp


def _compiles_nonempty(spark, java: str) -> bool:
    jvm = spark.sparkContext._jvm
    try:
        p = jvm.java.util.regex.Pattern.compile(java)
    except Exception:
        return False
    return not p.matcher("").matches()


# ---------------------------------------------------------------- stages

#: Letters from rare to frequent; all other characters are rarer in text.
_FREQUENT = "zqxjkvbpygwfmucldrhsnioate"


def _contains(x: str, g: str) -> str:
    """``contains(x, g)``.  Spark compares ``g`` wherever its first byte
    stands, which in a long text costs far more than the walk; so the end of
    ``g`` from its rarest character on is looked for first."""
    at = min(range(max(len(g) - 2, 1)), key=lambda i: (_FREQUENT.find(g[i]), i))
    return f"contains({x}, {q(g)})" if at == 0 else f"(contains({x}, {q(g[at:])}) AND contains({x}, {q(g)}))"


def _guard_key(s: Spec):
    """What specs with one guard share; "" for a spec that runs on every row."""
    return (s.guard, s.guard_lower) if s.guard else s.shape


#: Characters that few texts hold and that lower case leaves as they are;
#: literals with the same one share its test.
_SIGNS = '_:@/"-'


def _hint(g: str, lits: set[str]) -> str:
    """A part of the literal ``g`` to look for first: a sign, the shortest
    other literal inside ``g``, or ``g`` itself."""
    inside = (g[i:i + n] for n in range(1, min(len(g), 32)) for i in range(len(g) - n + 1))
    return next((c for c in _SIGNS if c in g), None) or next((h for h in inside if h in lits), g)


def _guards(comp: Compiled) -> dict:
    """The tests of a row that specs stand behind: key -> (literals, whether
    in lower case, shape).  One of the literals and the shape must be there."""
    out: dict = {}
    for s in comp.specs:
        if key := _guard_key(s):
            same = out.get(key, (s.guard, s.guard_lower, s.shape))
            out[key] = (s.guard, s.guard_lower, s.shape if s.shape == same[2] else "")
        if s.prefixed:
            out[s.prefixed] = (s.guard, s.guard_lower, s.prefixed)
    return out


def _hints(guards: dict) -> dict:
    """(literal, lower) -> (hint, lower), and shape -> shape, for what at
    least two guards need: a row answers each of these tests once."""
    pairs = [(g, lower) for lits, lower, _ in guards.values() for g in lits]
    shapes = [shape for _, _, shape in guards.values() if shape]
    every = {low: {g for g, lower in pairs if lower == low} for low in (False, True)}
    of = {}
    for g, lower in dict.fromkeys(pairs):
        hint = _hint(g, every[lower])
        of[g, lower] = (hint, lower and hint not in _SIGNS)
    uses = Counter(of[p] for p in pairs) + Counter(shapes)
    return {k: h for k, h in [*of.items(), *((s, s) for s in shapes)] if uses[h] > 1}


def _hint_sql(hint, x: str, xl: str) -> str:
    return f"{x} RLIKE {q(hint)}" if isinstance(hint, str) else _contains(xl if hint[1] else x, hint[0])


def _guard_sql(guard: tuple, x: str, xl: str, hints: dict, held: dict) -> str:
    """The test of one guard; ``held`` has the answers to the hints."""
    lits, lower, shape = guard

    def one(g):
        hint = hints.get((g, lower))
        test = _contains(xl if lower else x, g)
        return test if hint is None else held[hint] if hint[0] == g else f"({held[hint]} AND {test})"
    tests = ["(" + " OR ".join(map(one, lits)) + ")"] if lits else []
    if shape in hints:
        tests.insert(0, held[hints[shape]])
    elif shape:
        tests.append(f"{x} RLIKE {q(shape)}")
    return "(" + " AND ".join(tests) + ")"


def _needs_lower(guards: dict) -> bool:
    return any(lower and lits for lits, lower, _ in guards.values())


_SPEC_EMPTY = "CAST(NULL AS ARRAY<STRING>)"
_SPEC_TYPE = ("ARRAY<STRUCT<rank:INT, sub:INT, prio:INT, kv:BOOLEAN, tq:BOOLEAN, kg:BOOLEAN, m:ARRAY<STRING>, "
              "g:ARRAY<STRING>, v2:ARRAY<STRING>, v1:ARRAY<STRING>>>")


def _spec_entry(s: Spec, prio: int, x: str) -> str:
    """``array(spec struct)`` when spec ``s`` matched the row, else an empty
    (constant) array.  The struct carries the generic candidate builder's
    inputs: rule rank, template, priority, kv flags, the matches, the gaps
    (split) and the value groups, which are taken only when the regex is
    found."""
    m = f"regexp_extract_all({x}, {q(s.java)}, 0)"
    v2 = f"regexp_extract_all({x}, {q(s.java)}, 2)" if s.kv else _SPEC_EMPTY
    v1 = f"regexp_extract_all({x}, {q(s.java)}, 1)" if s.kv and s.key_groups else _SPEC_EMPTY
    st = (f"named_struct('rank', {s.rank}, 'sub', {s.sub}, 'prio', {prio}, 'kv', {str(s.kv).lower()}, "
          f"'tq', {str(s.trail_quote).lower()}, 'kg', {str(s.key_groups).lower()}, 'm', {f'slice({m}, 1, 1)' if s.first_only else m}, "
          f"'g', split({x}, {q(s.java)}, -1), 'v2', {v2}, 'v1', {v1})")
    return f"CASE WHEN {x} RLIKE {q(s.java)} THEN array({st}) ELSE CAST(array() AS {_SPEC_TYPE}) END"


def _flat(arrays: list[str]) -> str:
    # an interpreted ``concat`` of many arrays costs far more than its parts
    return arrays[0] if len(arrays) == 1 else f"flatten(array({', '.join(arrays)}))"


def _spec_entries(comp: Compiled, x: str, guards: dict) -> str:
    """The entries of all specs as one array.  Specs with one guard (the
    templates of a key-value rule) stand behind it together, so a row without
    the guard's literal passes them at the cost of one test; so do, behind
    the guard, the templates with one sign (':' or '=') and, behind the sign,
    those for keys with a prefix, if ``guards`` tests for one.  Their order is
    of no account: candidates are sorted."""
    groups: dict = {}
    for s in comp.specs:
        signs = groups.setdefault(_guard_key(s), {})
        signs.setdefault(s.sign, {}).setdefault(guards.get(s.prefixed, ""), []).append(_spec_entry(s, comp.prio[s.rank], x))

    def behind(test, entries):
        return f"CASE WHEN {test} THEN {entries} ELSE CAST(array() AS {_SPEC_TYPE}) END" if test else entries

    def signed(signs):
        return _flat([behind(f"contains({x}, {q(sign)})" if sign else "", _flat([behind(test, _flat(es)) for test, es in tests.items()]))
                      for sign, tests in signs.items()])
    return _flat([behind(guards[g] if g else "", signed(signs)) for g, signs in groups.items()])


def _spec_candidates(z: str, x: str) -> str:
    """Generic candidate builder for one spec struct ``z`` (see spans): the
    start of match i is the summed lengths of the gaps and matches before
    it, in code points and in bytes.  For key-value specs the value is
    group 2 (group 1 when empty and the key has its own groups); it sits at
    the end of the match before an optional closing quote and is swapped by
    that span (X6).  Pairs with a short / boolean / numeric value are kept
    but marked (vstart = -2): they still take part in the (start, match)
    de-duplication before they are dropped.  Non-kv candidates carry
    vstart = vend = -1."""
    a, b, acc, p, one = name("a"), name("b"), name("s"), name("p"), name("p")
    pairs = (f"zip_with({z}.m, slice({z}.g, 1, greatest(size({z}.m), 1)), "
             f"({a}, {b}) -> named_struct('m', {a}, 'g', {b}))")
    item = _candidate(z, p, f"({acc}.pos + length({p}.g))", f"({acc}.bpos + octet_length({p}.g))", f"({acc}.n0 + size({acc}.out))")
    single = _candidate(z, one, f"length({one}.g)", f"octet_length({one}.g)", "0")
    return (f"CASE WHEN size({z}.m) = 1 THEN transform(array(named_struct('m', get({z}.m, 0), 'g', get({z}.g, 0))), {one} -> {single}) "
            f"ELSE {block_fold(pairs, acc, p, item, CAND_TYPE)} END")


def _candidate(z: str, p: str, st: str, bs: str, j: str) -> str:
    """The candidate of the (match, gap) pair ``p`` of spec ``z``, number
    ``j``, that starts at ``st`` (byte ``bs``)."""
    val = (f"CASE WHEN {z}.kg AND coalesce(get({z}.v2, {j}), '') = '' THEN get({z}.v1, {j}) "
           f"ELSE get({z}.v2, {j}) END")

    def with_value(v):
        trail = f"CASE WHEN {z}.tq AND endswith({p}.m, '\"') THEN 1 ELSE 0 END"
        vs = (f"CASE WHEN {z}.kg THEN locate({v}, {p}.m) - 1 "
              f"ELSE length({p}.m) - ({trail}) - length({v}) END")
        keep = f"(length({v}) >= {FX.KV_MIN_VALUE_LENGTH} AND NOT ({v} RLIKE {q('(?i)' + FX.KV_SKIP_VALUE)}))"

        def with_vs(vsv):
            vstart = f"CASE WHEN NOT {z}.kv THEN -1 WHEN {keep} THEN {vsv} ELSE -2 END"
            vend = f"CASE WHEN NOT {z}.kv THEN -1 ELSE {vsv} + length({v}) END"
            return (f"named_struct('start', {st}, 'rank', {z}.rank, 'sub', {z}.sub, 'seq', {j}, "
                    f"'end', {st} + length({p}.m), 'bstart', {bs}, 'bend', {bs} + octet_length({p}.m), "
                    f"'prio', {z}.prio, 'match', {p}.m, 'vstart', {vstart}, 'vend', {vend})")
        return let(vs, with_vs)
    return let(f"CASE WHEN {z}.kv THEN {val} ELSE '' END", with_value)


def _dedup_kv(srt: str) -> str:
    """Drop a key-value candidate when an earlier template of the same rule
    found the same (start, match).  Candidates are sorted by (start, rank,
    template, ...), so such duplicates sit in the block of at most 16
    entries sharing (start, rank): each entry looks back at most 15."""
    width = 16
    c, i, o = name("c"), name("i"), name("o")
    window = f"slice({srt}, greatest({i} - {width - 1}, 1), least({i}, {width}))"
    dup = (f"({c}.vstart != -1 AND exists({window}, {o} -> {o}.rank = {c}.rank AND {o}.start = {c}.start "
           f"AND {o}.match = {c}.match))")
    return (f"CASE WHEN size({srt}) < 2 THEN filter({srt}, {c} -> {c}.vstart != -2) "
            f"ELSE filter({srt}, ({c}, {i}) -> NOT {dup} AND {c}.vstart != -2) END")


def candidate_columns(df: DataFrame, text: str, comp: Compiled) -> DataFrame:
    """Stages 1-3: adds ``__cands`` (sorted, de-duplicated candidates).

    Stage 1 evaluates each distinct guard once per row (many specs share
    one: the 15 templates of a key-value rule, '://' for URL patterns), and
    before it what several guards need ('_', 'key', a long run);
    stage 2 gathers the specs that matched; stage 3 builds candidates."""
    x = ident(text)
    base = [ident(c) for c in df.columns]
    if not comp.specs:
        return df.selectExpr(*base, f"CAST(array() AS {CAND_TYPE}) AS `__cands`")
    guards = _guards(comp)
    hints = _hints(guards)
    held = {h: f"`__h{i}`" for i, h in enumerate(dict.fromkeys(hints.values()))}
    cols = {key: f"`__g{i}`" for i, key in enumerate(guards)}
    df0 = df.selectExpr(*base, f"lower({x}) AS `__xl`") if _needs_lower(guards) else df
    low = [c for c in ("`__xl`",) if df0 is not df]
    df1 = df0.selectExpr(*base, *low, *[f"{_hint_sql(h, x, '`__xl`')} AS {col}" for h, col in held.items()])
    df2 = df1.selectExpr(*base, *[f"{_guard_sql(guard, x, '`__xl`', hints, held)} AS {cols[key]}" for key, guard in guards.items()])
    return df2.selectExpr(*base, f"{_all_candidates(comp, x, cols)} AS `__cands`")


def _all_candidates(comp: Compiled, x: str, guards: dict) -> str:
    """Stages 2-3 as one expression; a row without a match ends after stage 2.
    (It stays below a lambda on purpose: compiled, hundreds of specs make
    methods too long for the JVM's own compiler, which then are slower.)"""
    z = name("z")

    def build(specs):
        flat = f"sort_array(flatten(transform({_distinct_kv(specs) if any(s.kv for s in comp.specs) else specs}, {z} -> {_spec_candidates(z, x)})))"
        return f"CASE WHEN size({specs}) = 0 THEN CAST(array() AS {CAND_TYPE}) ELSE {let(flat, _dedup_kv)} END"
    return let(_spec_entries(comp, x, guards), build)


def _distinct_kv(specs: str) -> str:
    """``specs`` without the key-value entries that found just what an earlier
    template of the same rule found: ``_dedup_kv`` would drop all of their
    candidates, here they are not built."""
    z, o = name("z"), name("o")
    same = f"{o}.rank = {z}.rank AND {o}.sub < {z}.sub AND {o}.m = {z}.m AND {o}.g = {z}.g"
    return f"filter({specs}, {z} -> NOT ({z}.kv AND exists({specs}, {o} -> {same})))"


#: Candidates that one inner fold of the conflict walk handles.
WALK_BLOCK = 256


def resolve(cands: str) -> str:
    """D8 over candidates sorted by start: keep a single current survivor;
    an overlapping candidate replaces it only with a strictly smaller
    priority number.  The fold state holds indices only, and it is a fold
    over blocks: a block's survivors grow in an array of their own, so no
    array is copied once per survivor of the row."""
    c, i, acc, k, o, b = (name(v) for v in ("c", "i", "acc", "k", "o", "b"))

    def walk(cs):
        idx = f"transform({cs}, ({c}, {i}) -> named_struct('i', {i}, 's', {c}.start, 'e', {c}.`end`, 'p', {c}.prio))"
        has = f"({acc}.ci >= 0)"
        overlap = f"({has} AND {c}.s < {acc}.ce)"
        stay = f"({overlap} AND NOT ({c}.p < {acc}.cp))"
        step = (f"named_struct('keep', CASE WHEN {has} AND NOT {overlap} THEN concat({acc}.keep, array({acc}.ci)) "
                f"ELSE {acc}.keep END, "
                f"'ci', CASE WHEN {stay} THEN {acc}.ci ELSE {c}.i END, "
                f"'ce', CASE WHEN {stay} THEN {acc}.ce ELSE {c}.e END, "
                f"'cp', CASE WHEN {stay} THEN {acc}.cp ELSE {c}.p END)")

        def blocks(all_):
            cut = (f"transform(sequence(0, CAST(ceil(size({all_}) / {WALK_BLOCK}.0D) AS INT) - 1), "
                   f"{b} -> slice({all_}, {b} * {WALK_BLOCK} + 1, {WALK_BLOCK}))")
            inner = (f"aggregate({b}, named_struct('keep', CAST(array() AS ARRAY<INT>), 'ci', {o}.ci, 'ce', {o}.ce, 'cp', {o}.cp), "
                     f"({acc}, {c}) -> {step})")
            outer = let(inner, lambda v: (f"named_struct('keep', concat({o}.keep, array({v}.keep)), 'ci', {v}.ci, 'ce', {v}.ce, 'cp', {v}.cp)"))
            init = "named_struct('keep', CAST(array() AS ARRAY<ARRAY<INT>>), 'ci', -1, 'ce', 0, 'cp', 0)"
            return f"aggregate({cut}, {init}, ({o}, {b}) -> {outer}, {o} -> concat(flatten({o}.keep), array({o}.ci)))"
        return f"CASE WHEN size({cs}) < 2 THEN {cs} ELSE transform({let(idx, blocks)}, {k} -> get({cs}, {k})) END"
    return let(cands, walk) if not cands.startswith("`") else walk(cands)


def replacement_sql(comp: Compiled, c: str, opts: Options) -> str:
    """Fixed replacement, else the builtin generator, else a key-value
    value swap, else shape preservation -- dispatched on the rule rank."""
    m = f"{c}.match"
    groups: dict[tuple, list[int]] = {}
    fixed = {}
    for rank, r in enumerate(comp.ranked):
        if rank == comp.word_rank:
            continue  # see wordscan.word_fields
        if r.type == "kv" and not opts.kv_fixed_replacement:
            key = ("kv", G.key_branch(r.pattern or ""))
        elif r.replacement is not None:
            fixed[rank] = r.replacement
            continue
        elif r.type == "builtin":
            if r.pattern not in BUILTINS:
                continue
            key = ("builtin", r.pattern)
        else:
            key = ("shape",)
        groups.setdefault(key, []).append(rank)
    branches = []
    if fixed:
        table = "array(" + ", ".join(q(fixed.get(k)) for k in range(max(fixed) + 1)) + ")"
        branches.append((sorted(fixed), f"element_at({table}, {c}.rank + 1)"))
    # Builtin generators seeded by the match share one random stream per
    # detection, sized by the rule's draw count (one expression instead of
    # one per generator).
    sv = name("sv")
    draws = []
    for key, ranks in groups.items():
        if key[0] == "kv":
            value = f"substr({m}, {c}.vstart + 1, {c}.vend - {c}.vstart)"
            val = (f"concat(left({m}, {c}.vstart), {let(value, lambda v: G.fake_value(key[1], v))}, "
                   f"substr({m}, {c}.vend + 1))")
        elif key[0] == "builtin":
            with G.shared_stream(m, sv) as st:
                val = G.builtin_generator(key[1], opts.jwt_epoch)(m)
            if st["draws"]:
                # constant counts as they are; a count that depends on the
                # match (hex length, value length) is bounded by the match
                # length -- extra draws do not change the ones used
                consts = [int(d) for d in st["draws"] if d.isdigit()]
                dynamic = len(consts) < len(st["draws"])
                n = (f"greatest({max(consts or [0])}, length({m}))"
                     if dynamic else str(max(consts)))
                draws.append((ranks, n))
        else:
            val = R.preserve_shape(m)
        branches.append((ranks, val))
    if not branches:
        return m
    whens = " ".join(f"WHEN {c}.rank IN ({', '.join(map(str, ranks))}) THEN {val}" for ranks, val in branches)
    case = f"CASE {whens} ELSE {m} END"
    if not draws:
        return case
    n_case = "CASE " + " ".join(f"WHEN {c}.rank IN ({', '.join(map(str, r))}) THEN {n}" for r, n in draws) + " ELSE 0 END"
    vals = (f"CASE WHEN {n_case} > 0 THEN {R.rng_values(R.js_hash(m), n_case)} "
            f"ELSE CAST(array() AS ARRAY<DOUBLE>) END")
    return f"get(transform(array({vals}), {sv} -> {case}), 0)"


def dets_sql(res: str, x: str, comp: Compiled, opts: Options) -> str:
    """Stage 5 as an expression over resolved candidates ``res``: detection
    structs ordered by (priority, start) (D9), with internal byte offsets."""
    z, w = name("z"), name("w")
    ordered = (f"transform(array_sort(transform({res}, {z} -> named_struct('p', {z}.prio, 's', {z}.start, 'c', {z}))), "
               f"{w} -> {w}.c)")

    def arr(vals):
        return "CAST(array(" + ", ".join(q(v) for v in vals) + ") AS ARRAY<STRING>)" if vals else "CAST(array() AS ARRAY<STRING>)"
    ids = arr([r.id for r in comp.ranked])
    names = arr([(r.name or r.pattern) for r in comp.ranked])
    cats = arr([r.category for r in comp.ranked])
    pats = arr([r.pattern for r in comp.ranked])
    c = name("d")
    own = {}
    if comp.word_rank is not None:
        from scrubline.operators.wordscan import word_fields
        own = word_fields(c, comp.strategy)

    def of_rule(field, expr):
        return f"CASE WHEN {c}.rank = {comp.word_rank} THEN {own[field]} ELSE {expr} END" if own else expr
    repl = of_rule("replacement", replacement_sql(comp, c, opts)) if opts.generate_replacements else "CAST(NULL AS STRING)"
    fields = [
        f"'rule_id', {of_rule('rule_id', f'element_at({ids}, {c}.rank + 1)')}", f"'rule_name', {of_rule('rule_name', f'element_at({names}, {c}.rank + 1)')}",
        f"'category', {of_rule('category', f'element_at({cats}, {c}.rank + 1)')}", f"'pattern', {of_rule('pattern', f'element_at({pats}, {c}.rank + 1)')}",
        f"'match', {c}.match", f"'start', {c}.start", f"'end', {c}.`end`",
        f"'replacement', {repl}",
        "'selected', true",
        f"'bstart', {c}.bstart", f"'bend', {c}.bend", f"'priority', {c}.prio",
    ]
    if opts.include_context:
        n = opts.context_length
        lo = f"greatest({c}.start - {n}, 0)"
        before = f"substr({x}, {lo} + 1, {c}.start - {lo})"
        after = f"substr({x}, {c}.`end` + 1, {n})"
        fields.append(f"'context', named_struct('before', {before}, 'match', {c}.match, 'after', {after}, "
                      f"'full', concat({before}, {c}.match, {after}))")
    return f"transform({ordered}, {c} -> named_struct({', '.join(fields)}))"


def detection_columns(df: DataFrame, text: str, comp: Compiled, opts: Options) -> DataFrame:
    """Stages 4-5: ``__dets`` (internal, with byte offsets) and the public
    ``detections`` array, ordered by (priority, start) (D9)."""
    base = [ident(c) for c in df.columns if c != "__cands"]
    df4 = df.selectExpr(*base, f"{resolve('`__cands`')} AS `__res`")
    df5 = df4.selectExpr(*base, f"{dets_sql('`__res`', ident(text), comp, opts)} AS `__dets`")
    pub = ["rule_id", "rule_name", "category", "pattern", "match", "start", "end", "replacement", "selected"]
    if opts.include_context:
        pub.append("context")
    e = name("e")
    public = f"transform(`__dets`, {e} -> named_struct({', '.join(f'{q(k)}, {e}.{ident(k)}' for k in pub)}))"
    return df5.selectExpr(*base, "`__dets`", f"{public} AS detections")


def splice_sql(x: str, dets: str) -> str:
    """E2 splice as an expression: cut the UTF-8 bytes of ``x`` at the
    detections' byte offsets and join gaps and replacements (linear)."""
    z, d0, i, xb = name("z"), name("d"), name("i"), name("xb")
    srt = (f"array_sort(transform({dets}, {z} -> named_struct('bs', {z}.bstart, 'be', {z}.bend, "
           f"'r', coalesce({z}.replacement, ''))))")

    def body(d):
        def with_bytes(b):
            prev = f"CASE WHEN {i} = 0 THEN 0 ELSE element_at({d}, {i}).be END"
            piece = f"concat(CAST(substr({b}, {prev} + 1, {z}.bs - ({prev})) AS STRING), {z}.r)"
            last = f"element_at({d}, -1).be"
            tail = f"CAST(substr({b}, {last} + 1, octet_length({x}) - {last} + 1) AS STRING)"
            return f"concat(array_join(transform({d}, ({z}, {i}) -> {piece}), ''), {tail})"
        return f"CASE WHEN size({d}) = 0 THEN {x} ELSE {let(f"encode({x}, 'UTF-8')", with_bytes)} END"
    return let(srt, body)


def _pipeline_sql(x: str, comp: Compiled, opts: Options, use) -> str:
    """``use(detections)`` with the whole pipeline (guards, candidates,
    resolution, generation) as one expression over the string expression ``x``."""
    guards = _guards(comp)
    hints = _hints(guards)
    hkeys = {h: f"h{i}" for i, h in enumerate(dict.fromkeys(hints.values()))}
    gkeys = {key: f"g{i}" for i, key in enumerate(guards)}

    def struct(fields):
        return "named_struct(" + ", ".join(f"{q(k)}, {v}" for k, v in fields) + ")"

    def with_guards(gv):
        cands = _all_candidates(comp, x, {g: f"{gv}.{k}" for g, k in gkeys.items()})
        return let(let(cands, lambda cv: dets_sql(resolve(cv), x, comp, opts)), use)

    def with_hints(xl, hv):
        held = {h: f"{hv}.{k}" for h, k in hkeys.items()}
        return let(struct((k, _guard_sql(guards[key], x, xl, hints, held)) for key, k in gkeys.items()), with_guards)

    def with_lower(xl):
        if not hkeys:
            return with_hints(xl, "NULL")
        return let(struct((k, _hint_sql(h, x, xl)) for h, k in hkeys.items()), lambda hv: with_hints(xl, hv))
    if not gkeys:
        return with_guards("NULL")
    return let(f"lower({x})", with_lower) if _needs_lower(guards) else with_lower("NULL")


def sanitized_sql(x: str, comp: Compiled, opts: Options) -> str:
    """The whole pipeline, selection and splice as one expression over the
    string expression ``x`` -- for strings nested inside arrays and maps.
    Null and empty strings come back unchanged (E1)."""
    if not comp.specs:
        return x

    def spliced(dv):
        chosen = dv
        if opts.selected_rule_ids:
            ids = "array(" + ", ".join(q(r) for r in opts.selected_rule_ids) + ")"
            e = name("e")
            chosen = f"filter({dv}, {e} -> array_contains({ids}, {e}.rule_id))"
        return splice_sql(x, chosen)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {_pipeline_sql(x, comp, opts, spliced)} END"


#: A detection's public fields and their SQL types.
PUBLIC = {"rule_id": "STRING", "rule_name": "STRING", "category": "STRING", "pattern": "STRING", "match": "STRING",
          "start": "INT", "end": "INT", "replacement": "STRING", "selected": "BOOLEAN"}


def detections_sql(x: str, comp: Compiled, opts: Options) -> str:
    """The public detections of the string expression ``x`` as one expression
    (an empty array for null and empty strings)."""
    e = name("e")
    empty = f"CAST(array() AS ARRAY<STRUCT<{', '.join(f'{ident(k)}: {t}' for k, t in PUBLIC.items())}>>)"
    if not comp.specs:
        return empty
    fields = ", ".join(f"{q(k)}, {e}.{ident(k)}" for k in PUBLIC)
    body = _pipeline_sql(x, comp, opts, lambda dv: f"transform({dv}, {e} -> named_struct({fields}))")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {empty} ELSE {body} END"


def candidate_rows(df: DataFrame, text: str, rules: list[Rule], keys: list[str]) -> DataFrame:
    """Candidates before conflict resolution, one a row: ``keys``, rule_id
    and the candidate's fields."""
    comp = compile_rules(rules, df.sparkSession)
    ids = "CAST(array(" + ", ".join(q(r.id) for r in comp.ranked) + ") AS ARRAY<STRING>)"
    k = [ident(c) for c in keys]
    rows = candidate_columns(df, text, comp).selectExpr(*k, "inline_outer(`__cands`)").where("start IS NOT NULL")
    return rows.selectExpr(*k, f"element_at({ids}, rank + 1) AS rule_id", "start", "`end`", "rank", "sub", "seq", "prio", "match")


def _pair_counts(start, end, rank, row):
    """{(a, b): n} of overlapping candidates, a before b, for candidates in
    order of (row, start, ...).  Per rule b the sorted starts tell, by
    bisection, how many of b's candidates start before a candidate ends; those
    up to its own place are subtracted.  So the cost is the candidates times
    the rules that occur, however many pairs overlap."""
    import numpy as np
    wide = row.astype(np.int64) << 32  # rows cannot overlap each other
    start, end, place = start + wide, end + wide, np.arange(len(start))
    ranks, code = np.unique(rank, return_inverse=True)
    out = {}
    for b, r in enumerate(ranks.tolist()):
        own = place[code == b]
        later = np.searchsorted(start[own], end) - np.searchsorted(own, place, side="right")
        total = np.zeros(len(ranks), np.int64)
        np.add.at(total, code, later)
        out.update({(a, r): int(n) for a, n in zip(ranks.tolist(), total) if n})
    return out


def overlap_pairs(df: DataFrame, text: str, rules: list[Rule]) -> DataFrame:
    """D7 as a table operator: how often the candidates of two rules overlap
    (half-open intervals), before conflict resolution.  Pairs are counted and
    never formed: a row's candidates, sorted by start, are swept rule by
    rule; each task sends one row per pair of rules."""
    import numpy as np
    import pyarrow as pa
    comp = compile_rules(rules, df.sparkSession)
    c = name("c")
    cands = candidate_columns(df.selectExpr(f"{ident(text)}"), text, comp).selectExpr(
        f"transform(`__cands`, {c} -> named_struct('s', {c}.start, 'e', {c}.`end`, 'r', {c}.rank)) AS c")

    def run(batches):
        total: dict = {}
        for t in batches:
            col = t.column(0)
            v, at = col.flatten(), col.offsets.to_numpy()
            s, e, r = (v.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "e", "r"))
            for pair, n in _pair_counts(s, e, r, np.repeat(np.arange(len(col)), np.diff(at))).items():
                total[pair] = total.get(pair, 0) + n
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([total[k] for k in keys], pa.int64())], ["a", "b", "n"])

    ids = "CAST(array(" + ", ".join(q(r.id) for r in comp.ranked) + ") AS ARRAY<STRING>)"
    counts = cands.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.selectExpr(f"element_at({ids}, a + 1) AS rule_a", f"element_at({ids}, b + 1) AS rule_b", "n")


def balanced(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread the rows of a plain scan over at least ``defaultParallelism``
    tasks when it has fewer partitions (one small file is one task; the
    regex work is CPU bound).  Nothing calls it unasked: it shuffles the
    texts, and on anything but a scan it plans the input to count its
    partitions.  The spread
    hashes a per-row id rather than the text, so duplicate texts do not
    pile up in one task; streams are left alone."""
    if df.isStreaming:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, F.monotonically_increasing_id())


def word_candidates(df: DataFrame, text: str, comp: Compiled, words: DataFrame | None, key: str | None = None) -> DataFrame:
    """Stages 1-3, with the hits of a word table of any size among them."""
    if words is None:
        return candidate_columns(df, text, comp)
    from scrubline.operators.wordscan import candidates_sql, word_hits
    cands = candidate_columns(word_hits(df, text, words, key), text, comp)
    merged = candidates_sql("`__w`", comp.word_rank, comp.prio[comp.word_rank], "`__cands`")
    return cands.selectExpr(*[ident(c) for c in df.columns], f"{merged} AS `__cands`")


def detect(df: DataFrame, text: str, rules: list[Rule], opts: Options | None = None,
           balance: bool = False, words: DataFrame | None = None, strategy: str = "generic", key: str | None = None) -> DataFrame:
    """Adds ``detections`` (and internal ``__dets``) for column ``text``.
    Null or empty text gives an empty list.  ``words`` is a word table (B11)
    of any size, found by an automaton; see ``wordscan.word_hits`` for ``key``."""
    opts = opts or Options()
    comp = compile_rules(rules, df.sparkSession, words is not None, strategy)
    if balance:
        df = balanced(df)
    return detection_columns(word_candidates(df, text, comp, words, key), text, comp, opts)
