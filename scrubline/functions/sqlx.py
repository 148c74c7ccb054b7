"""Small helpers for writing Spark SQL expression text.

Large expression trees (hundreds of regexes, folds, generators) are built as
SQL text and handed to the JVM in one ``selectExpr`` call: building them
node by node through the Python Column API costs a py4j round trip per node.
"""

from __future__ import annotations

import itertools

_counter = itertools.count()


def q(s: str | None) -> str:
    """A Spark SQL string literal for ``s`` (NULL for None)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(prefix: str = "v") -> str:
    """A fresh lambda variable name."""
    return f"{prefix}_{next(_counter)}"


def let(expr: str, body) -> str:
    """Evaluate ``expr`` once and use it (as a lambda variable) in
    ``body(var)``: ``get(transform(array(expr), var -> body), 0)``."""
    v = name("l")
    return f"get(transform(array({expr}), {v} -> {body(v)}), 0)"


def ident(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"
