"""Small builders for Spark SQL expressions (strings for ``F.expr`` and SQL functions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 128


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def ident(name: str) -> str:
    """A quoted column reference; dots separate struct fields as in ``F.col``."""
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def let(var: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``var`` in ``body``.

    The last step of a fold over nothing sees the value as it is; ``transform`` would copy what the body returns, at every level.
    """
    return f"aggregate({empty_array('INT')}, {value}, (v_same, v_none) -> v_same, {var} -> {body})"


def joined(*arrays: str) -> str:
    """The arrays one after the other. Inside a lambda ``concat`` walks a lazy list on every call."""
    return f"flatten(array({', '.join(arrays)}))"


def running(values: str, zero: str, op: str) -> str:
    """Running totals of an INT array; ``op`` combines ``v_l`` and ``v_r``.

    ``aggregate`` copies its accumulator at every step, so one that collects results is quadratic.
    Here it only ever holds one block of integers; the blocks' totals are then carried forward.
    """
    def total(part: str) -> str:
        step = op.replace("v_l", "element_at(v_a, -1)").replace("v_r", "v_v")
        return (f"slice(aggregate({part}, array({zero}), (v_a, v_v) -> {joined('v_a', f'array({step})')}),"
                f" 2, size({part}))")

    blocks = (f"transform(sequence(0, (size(v_all) - 1) div {BLOCK}),"
              f" v_b -> {let('v_part', f'slice(v_all, int(v_b * {BLOCK} + 1), {BLOCK})', total('v_part'))})")
    carried = op.replace("v_l", "get(v_carry, v_i - 1)").replace("v_r", "v_v")
    spread = (f"flatten(transform(v_blocks, (v_p, v_i) ->"
              f" if(v_i = 0, v_p, transform(v_p, v_v -> {carried}))))")
    long_form = let("v_blocks", blocks, let(
        "v_carry", let("v_ends", "transform(v_blocks, v_p -> element_at(v_p, -1))", total("v_ends")), spread))
    return let("v_all", values,
               f"CASE WHEN size(v_all) <= {BLOCK} THEN {total('v_all')} ELSE {long_form} END")


def empty_array(item_type: str) -> str:
    return f"CAST(array() AS ARRAY<{item_type}>)"


def valid_utf8(x: str, on_invalid: str = "replace") -> str:
    """The text as valid UTF-8: invalid bytes become U+FFFD, or fail the job with ``on_invalid="raise"``.

    Offsets, originals and the splice all work on this form, so that they agree.
    """
    if on_invalid not in ("replace", "raise"):
        raise ValueError(f"on_invalid must be 'replace' or 'raise', not {on_invalid!r}")
    return f"validate_utf8({x})" if on_invalid == "raise" else f"if(is_valid_utf8({x}), {x}, make_valid_utf8({x}))"


def free_for(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs when an output column would replace one of the input."""
    taken = {c.lower() for c in df.columns}
    clash = [n for n in names if n.lower() in taken]
    if clash:
        raise ValueError(f"the input already has columns named {', '.join(clash)}; rename them first")
    return df


def computed_once(df: DataFrame, name: str, sql: str | Column) -> DataFrame:
    """Add a costly column that is computed once per row, whatever is done with it later.

    A filter on a projected column is pushed down by copying the column's expression. A generator's
    output is never copied, while filters on other columns still move below it.
    """
    return free_for(df, name).select("*", F.explode(F.array(F.expr(sql) if isinstance(sql, str) else sql)).alias(name))
