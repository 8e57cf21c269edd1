"""Named SQL fragments and a small composer that emits one WITH query per check."""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}
# pushing the filters of several readers into this shared fragment loses rows, so it is inlined
INLINE = {"q_year"}


def define(name: str, sql: str) -> None:
    FRAGMENTS[name] = sql


def compose(body: str) -> str:
    """WITH clause holding exactly the fragments `body` needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bq_[a-z0-9_]+\b", sql)):
            if word in FRAGMENTS and word not in order and word not in stack:
                stack.append(word)
                visit(FRAGMENTS[word])
                stack.pop()
                order.append(word)

    stack: list[str] = []
    visit(body)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS {'NOT MATERIALIZED ' if n in INLINE else ''}({FRAGMENTS[n]})" for n in order)
    return f"WITH RECURSIVE {parts}\n{body}"


def r(x: str, n: int) -> str:
    """Half-even rounding of the shortest decimal form; missing, NaN and infinite values give NULL."""
    return f"CAST(round_even(TRY_CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 16)), {n}) AS DOUBLE)"


def ri(x: str) -> str:
    return f"CAST(round_even(TRY_CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 16)), 0) AS INTEGER)"


def dv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def cl(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(CAST({x} AS DOUBLE), {lo}), {hi}) END)"


def bd(x: str, *steps: object) -> str:
    """bd('rsi', 30, 55, 40, 82, 15): x <= 30 -> 55, x <= 40 -> 82, else 15."""
    pairs = list(zip(steps[0:-1:2], steps[1:-1:2]))
    whens = " ".join(f"WHEN ({x}) <= {t} THEN {s}::DOUBLE" for t, s in pairs)
    return f"(CASE WHEN ({x}) IS NULL THEN NULL {whens} ELSE {steps[-1]}::DOUBLE END)"


def wm(*parts: tuple[str, float]) -> str:
    top = " + ".join(f"coalesce({v} * {w}, 0.0::DOUBLE)" for v, w in parts)
    bottom = " + ".join(f"(CASE WHEN ({v}) IS NOT NULL THEN {w}::DOUBLE ELSE 0.0::DOUBLE END)" for v, w in parts)
    return f"(({top}) / nullif({bottom}, 0.0))"


def pts(*rules: str) -> str:
    return "(" + " + ".join(f"coalesce(CAST(({x}) AS DOUBLE), 0.0)" for x in rules) + ")"


def t0(x: str) -> str:
    return f"printf('%.0f', {r(x, 0)})"


def t1(x: str, sign: str = "") -> str:
    return f"printf('%{sign}.1f', {r(x, 1)})"


def s0(x: str) -> str:
    return f"printf('%+.0f', {r(x, 0)})"


def picks(*items: str) -> str:
    """List of the non-NULL items in order."""
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def in_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
