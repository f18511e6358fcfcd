"""Sequential state over an array column, without leaving the row.

A file or a diff arrives as one row, so state that runs down its lines needs no shuffle,
no sort and no key: the fold happens inside the row, whatever the key distribution is.
Arguments and results are Spark SQL expressions as text.
"""

from __future__ import annotations

from collections.abc import Callable

BLOCK = 1024


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def running_text(
    items: str,
    initial: str,
    step: Callable[[str, str], str],
    emit: Callable[[str, str], str],
    at_end: Callable[[str], str] | None = None,
) -> str:
    """Concatenated ``emit(state, item)`` while ``step`` carries a state down ``items``.

    ``emit`` sees the state before the item; ``at_end`` adds text from the last state.
    Output grows inside blocks of 1024 items and the blocks are then joined, so long
    arrays do not copy the whole output at every step.
    """
    blocks = (
        f"transform(CASE WHEN size(seq) > 0 THEN sequence(0, CAST((size(seq) - 1) DIV {BLOCK} "
        f"AS INT)) ELSE CAST(array() AS ARRAY<INT>) END, k -> slice(seq, k * {BLOCK} + 1, {BLOCK}))"
    )
    inner = (
        "aggregate(block, named_struct('state', done.state, 'out', ''), (acc, item) -> "
        f"named_struct('state', {step('acc.state', 'item')}, "
        f"'out', concat(acc.out, {emit('acc.state', 'item')})), acc -> "
        "named_struct('state', acc.state, 'out', concat(done.out, acc.out)))"
    )
    finish = f"concat(acc.out, {at_end('acc.state')})" if at_end else "acc.out"
    fold = (
        f"aggregate({blocks}, named_struct('state', {initial}, 'out', ''), "
        f"(done, block) -> {inner}, acc -> {finish})"
    )
    return let("seq", items, fold)


def running_pieces(items, initial, step, emit, at_end=None) -> str:
    """Like :func:`running_text`, cut into an array; ``emit`` ends every piece with ``;``."""
    pieces = running_text(items, initial, step, emit, at_end)
    return f"filter(split({pieces}, ';'), piece -> piece <> '')"
