"""JSON-LD blocks: strict parsing, truthiness and the type walk, as Spark SQL expressions."""

from __future__ import annotations

from pagecensus.functions.text import bind, pattern, trim_space

# Parser nesting limit: a deeper block does not parse, so no walk needs more steps.
_MAX_NESTING = 1000

# Fixed value: JSON texts that count as "nothing" on the web platform.
_FALSY = pattern(r"^(?:null|false|\x22\x22|-?0(?:\.0+)?(?:[eE][+\-]?[0-9]+)?)$")

_EMPTY_NODES = "CAST(array() AS ARRAY<VARIANT>)"
_EMPTY_NAMES = "CAST(array() AS ARRAY<STRING>)"


def kept_blocks(bodies: str) -> str:
    """``array<variant>`` of the blocks that parse and are not falsy, in page order.

    ``try_parse_json`` ignores text behind the first value. Wrapped once as a list and once as an
    object, such text breaks at least one of the two, so what is kept is one whole JSON value.
    """
    trimmed = f"transform({bodies}, body -> {trim_space('body')})"
    parsed = (
        """CASE WHEN try_parse_json(concat('{"v":', body, '}')) IS NOT NULL """
        "THEN try_variant_get(try_parse_json(concat('[', body, ']')), '$[0]', 'variant') END"
    )
    truthy = f"filter({trimmed}, body -> NOT body RLIKE {_FALSY})"
    return f"filter(transform({truthy}, body -> {parsed}), block -> block IS NOT NULL)"


def rejection(body: str) -> str:
    """Why a JSON-LD body is not kept, null if it is."""
    return bind(
        trim_space(body), "t",
        f"CASE WHEN t = '' THEN 'empty' WHEN t RLIKE {_FALSY} THEN 'says nothing' "
        f"WHEN size({kept_blocks('array(t)')}) = 0 THEN 'not one JSON value' END",
    )


def type_names(blocks: str, bodies: str) -> str:
    """Distinct ``@type`` names, found through lists and ``@graph`` at any depth and nowhere else.

    The walk goes level by level and does nothing more once a level is empty, so its cost is that of the
    levels there are. Each step enters a list or an object, so the number of opening brackets in the texts
    bounds the number of steps. The names of a level are kept as one list, and put together at the end.
    """
    openings = f"reduce({bodies}, 1, (n, body) -> n + regexp_count(body, {pattern('[' + chr(92) + '[{]')}))"
    own = (
        """coalesce(try_variant_get(node, '$["@type"]', 'array<string>'), """
        """array(try_variant_get(node, '$["@type"]', 'string')))"""
    )
    graph = bind(
        """try_variant_get(node, '$["@graph"]', 'variant')""", "graph",
        "CASE WHEN graph IS NOT NULL THEN array(graph) END",
    )
    children = f"coalesce(try_variant_get(node, '$', 'array<variant>'), {graph}, {_EMPTY_NODES})"
    step = (
        f"named_struct('frontier', flatten(transform(acc.frontier, node -> {children})), "
        f"'levels', array_append(acc.levels, flatten(transform(acc.frontier, node -> {own}))))"
    )
    walked = (
        f"reduce(sequence(1, least({openings}, {_MAX_NESTING})), "
        f"named_struct('frontier', {blocks}, 'levels', CAST(array() AS ARRAY<ARRAY<STRING>>)), "
        f"(acc, step) -> CASE WHEN size(acc.frontier) = 0 THEN acc ELSE {step} END, acc -> flatten(acc.levels))"
    )
    names = f"array_distinct(filter({walked}, name -> name IS NOT NULL AND name <> ''))"
    return f"CASE WHEN size({blocks}) > 0 THEN {names} ELSE {_EMPTY_NAMES} END"


def mentions_author(blocks: str) -> str:
    """Whether ``"author"`` appears, quotes included, as key or value of any kept block."""
    return f"""exists({blocks}, block -> contains(lower(to_json(block)), '"author"'))"""
