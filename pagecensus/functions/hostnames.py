"""Host names outside ASCII in the form the name system knows, as Spark SQL expressions.

A label with other characters is written with the bootstring algorithm (Punycode): its ASCII characters, then
where the others go, as numbers in base 36 whose digits adapt to the size of the last steps. The characters are
taken in ascending order; for each, the label is walked once. Characters are lower-cased before; compatibility
forms (full-width letters, ligatures) and composed against decomposed accents are not unified.
"""

from __future__ import annotations

from pagecensus.functions.text import bind, pattern

# Fixed values of the encoding.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
PREFIX = "xn--"
DOTS = "\u3002\uff0e\uff61"

OUTSIDE_ASCII = pattern(r"[^\x00-\x7F]")
# Digits a number below 2**31 can take, and halvings by 35 until one is small.
_MOST_DIGITS, _MOST_SHRINKS = 8, 8


def _digit(value: str) -> str:
    return f"substring('{DIGITS}', CAST({value} AS INT) + 1, 1)"


def _number(delta: str, bias: str) -> str:
    """``delta`` as digits, least first; the threshold of each place says where the number may end."""
    step = bind(
        f"greatest({T_MIN}, least({T_MAX}, {BASE} * k - n.bias))", "t",
        f"CASE WHEN n.done THEN n WHEN n.q < t THEN named_struct('q', 0L, 'done', true, 'text', concat(n.text, {_digit('n.q')}), 'bias', n.bias) "
        f"ELSE named_struct('q', CAST((n.q - t) DIV ({BASE} - t) AS BIGINT), 'done', false, "
        f"'text', concat(n.text, {_digit(f't + (n.q - t) % ({BASE} - t)')}), 'bias', n.bias) END",
    )
    start = f"named_struct('q', CAST({delta} AS BIGINT), 'done', false, 'text', '', 'bias', {bias})"
    return f"reduce(sequence(1, {_MOST_DIGITS}), {start}, (n, k) -> {step}, n -> n.text)"


def _adapted(delta: str, points: str, first: str) -> str:
    """The bias after a number: how large the next ones are likely to be."""
    shrink = f"CASE WHEN d.delta > {(BASE - T_MIN) * T_MAX // 2} THEN named_struct('delta', CAST(d.delta DIV {BASE - T_MIN} AS BIGINT), 'k', d.k + {BASE}) ELSE d END"
    scaled = f"CAST(IF({first}, {delta} DIV {DAMP}, {delta} DIV 2) AS BIGINT)"
    start = f"transform(array({scaled}), x -> named_struct('delta', CAST(x + x DIV ({points}) AS BIGINT), 'k', 0))[0]"
    end = f"CAST(d.k + {BASE - T_MIN + 1} * d.delta DIV (d.delta + {SKEW}) AS INT)"
    return f"reduce(sequence(1, {_MOST_SHRINKS}), {start}, (d, i) -> {shrink}, d -> {end})"


def bootstring(label: str) -> str:
    """The encoded form of one label, without the prefix."""
    inserted = bind(
        _number("s.delta", "s.bias"), "number",
        f"named_struct('delta', 0L, 'bias', {_adapted('s.delta', 's.done + 1', 's.done = basic')}, 'done', s.done + 1, 'text', concat(s.text, number))",
    )
    state = "named_struct('delta', s.delta + 1, 'bias', s.bias, 'done', s.done, 'text', s.text)"
    walk = f"reduce(codes, begun, (s, c) -> CASE WHEN c < m THEN {state} WHEN c = m THEN {inserted} ELSE s END)"
    # Before the walk for m, every place passed since the last one counts for all values in between.
    begun = "named_struct('delta', a.delta + (m - a.next) * (a.done + 1), 'bias', a.bias, 'done', a.done, 'text', a.text)"
    walked = bind(
        bind(begun, "begun", walk), "w",
        "named_struct('delta', w.delta + 1, 'next', m + 1, 'bias', w.bias, 'done', w.done, 'text', w.text)",
    )
    start = (
        f"named_struct('delta', 0L, 'next', {FIRST_CODE}L, 'bias', {FIRST_BIAS}, 'done', basic, "
        "'text', IF(basic > 0, concat(kept, '-'), ''))"
    )
    rest = f"array_sort(array_distinct(filter(codes, c -> c >= {FIRST_CODE})))"
    encoded = f"reduce({rest}, {start}, (a, m) -> {walked}, a -> a.text)"
    kept = bind(f"regexp_replace({label}, {OUTSIDE_ASCII}, '')", "kept", bind("length(kept)", "basic", encoded))
    return bind(f"transform(split({label}, ''), ch -> CAST(ascii(ch) AS BIGINT))", "codes", kept)


def ascii_host(host: str) -> str:
    """A host name with every label in ASCII; one that is has nothing done to it."""
    dotted = f"translate({host}, '{DOTS}', '...')"
    label = f"CASE WHEN l RLIKE {OUTSIDE_ASCII} THEN concat('{PREFIX}', {bootstring('l')}) ELSE l END"
    encoded = f"array_join(transform(split({dotted}, '[.]'), l -> {label}), '.')"
    return f"CASE WHEN {host} RLIKE {OUTSIDE_ASCII} THEN {encoded} ELSE {host} END"
