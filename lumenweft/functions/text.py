"""Expressions as SQL text: a function of columns is written out once and handed to Spark in one piece.

A tree of Column objects costs a few calls into the JVM for every node, and the larger functions over URLs have
thousands of nodes, so that building a plan took longer than running it. Here the same Python code, marked with
compiled(), runs over Text instead of Column: its operators and functions write SQL. The text becomes the body of a
lambda over the arguments, which Spark evaluates once a row.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import wraps
from itertools import count

from pyspark.sql import Column, functions

_depth = 0
_names = count()


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"
    if isinstance(x, float):
        return f"{x!r}D"
    return repr(x)


def _sql(x) -> str:
    return x.sql if isinstance(x, Text) else _literal(x)


def _binary(sign: str, swapped: bool = False):
    def method(self: Text, other) -> Text:
        a, b = (_sql(other), self.sql) if swapped else (self.sql, _sql(other))
        return Text(f"({a} {sign} {b})")

    return method


class Text:
    """A SQL expression with the operators and methods of a Column."""

    def __init__(self, sql: str, branches: tuple[str, ...] = ()) -> None:
        self.sql, self._branches = sql, branches

    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = (_binary(s) for s in ("=", "<>", "<", "<=", ">", ">="))  # type: ignore[assignment]
    __add__, __sub__, __mul__, __truediv__, __mod__, __and__, __or__ = (_binary(s) for s in ("+", "-", "*", "/", "%", "AND", "OR"))
    __radd__, __rsub__, __rmul__, __rand__, __ror__ = (_binary(s, True) for s in ("+", "-", "*", "AND", "OR"))
    __hash__ = None  # type: ignore[assignment]

    def __invert__(self) -> Text:
        return Text(f"(NOT {self.sql})")

    def __neg__(self) -> Text:
        return Text(f"(- {self.sql})")

    def __getitem__(self, key) -> Text:
        return Text(f"({self.sql}).`{key}`") if isinstance(key, str) else Text(f"({self.sql})[{_sql(key)}]")

    def __bool__(self) -> bool:
        raise ValueError("an expression has no truth value")

    def rlike(self, pattern) -> Text:
        return Text(f"regexp_like({self.sql}, {_sql(pattern)})")

    def startswith(self, x) -> Text:
        return Text(f"startswith({self.sql}, {_sql(x)})")

    def endswith(self, x) -> Text:
        return Text(f"endswith({self.sql}, {_sql(x)})")

    def contains(self, x) -> Text:
        return Text(f"contains({self.sql}, {_sql(x)})")

    def isin(self, *values) -> Text:
        return Text(f"({self.sql} IN ({', '.join(map(_sql, values))}))") if values else Text("false")

    def isNull(self) -> Text:
        return Text(f"({self.sql} IS NULL)")

    def isNotNull(self) -> Text:
        return Text(f"({self.sql} IS NOT NULL)")

    def cast(self, kind: str) -> Text:
        return Text(f"CAST({self.sql} AS {kind})")

    def try_cast(self, kind: str) -> Text:
        return Text(f"TRY_CAST({self.sql} AS {kind})")

    def bitwiseAND(self, other) -> Text:
        return Text(f"({self.sql} & {_sql(other)})")

    def alias(self, name: str) -> Text:
        return _Named(self.sql, name)

    def when(self, on, value) -> Text:
        branches = (*self._branches, f"WHEN {_sql(on)} THEN {_sql(value)}")
        return Text(f"CASE {' '.join(branches)} END", branches)

    def otherwise(self, value) -> Text:
        return Text(f"CASE {' '.join(self._branches)} ELSE {_sql(value)} END")


class _Named(Text):
    def __init__(self, sql: str, name: str) -> None:
        super().__init__(sql)
        self.name = name


class _Functions:
    """pyspark.sql.functions, or what writes their SQL while a compiled function runs."""

    # In text a plain string is a value in every function, so columns are named by col().

    def __getattr__(self, name: str):
        if not _depth:
            return getattr(functions, name)
        own = type(self).__dict__.get(f"_{name}")
        return own.__get__(self) if own else (lambda *args: Text(f"{name}({', '.join(self._argument(a) for a in args)})"))

    @staticmethod
    def _argument(a) -> str:
        if callable(a) and not isinstance(a, Text):
            names = [f"x{next(_names)}" for _ in range(a.__code__.co_argcount - len(a.__defaults__ or ()))]
            body = _sql(a(*[Text(n) for n in names]))
            return f"{names[0]} -> {body}" if len(names) == 1 else f"({', '.join(names)}) -> {body}"
        return _sql(a)

    def _lit(self, x) -> Text:
        return x if isinstance(x, Text) else Text(_literal(x))

    def _col(self, name: str) -> Text:
        return Text(".".join(f"`{n}`" for n in name.split(".")))

    def _create_map(self, *args) -> Text:
        return Text(f"map({', '.join(map(_sql, args))})")

    def _when(self, on, value) -> Text:
        return Text("NULL").when(on, value)

    def _struct(self, *fields) -> Text:
        return Text(f"named_struct({', '.join(f'{_literal(f.name)}, {f.sql}' for f in fields)})")

    def _expr(self, sql: str) -> Text:
        return Text(f"({sql})")

    def _call_function(self, name: str, *args) -> Text:
        return Text(f"{name}({', '.join(map(_sql, args))})")

    def _contains(self, a, b) -> Text:
        return Text(f"contains({_sql(a)}, {_sql(b)})")

    def _split(self, x, pattern, limit=-1) -> Text:
        return Text(f"split({_sql(x)}, {_sql(pattern)}, {_sql(limit)})")


F = _Functions()


@contextmanager
def as_text():
    """Within, F writes SQL; what is built there is turned into columns by column()."""
    global _depth
    _depth += 1
    try:
        yield
    finally:
        _depth -= 1


def column(x) -> Column:
    """A Column of what was built as text."""
    return functions.expr(x.sql).alias(x.name) if isinstance(x, _Named) else functions.expr(_sql(x))


def interpreted(x) -> Column:
    """As column(), evaluated without code of its own: for expressions whose generated code would be too large to be worth compiling."""
    return functions.expr(f"get(transform(array(0), z{next(_names)} -> {_sql(x)}), 0)").alias(x.name) if isinstance(x, _Named) else functions.expr(f"get(transform(array(0), z{next(_names)} -> {_sql(x)}), 0)")


def compiled(f: Callable) -> Callable:
    """f, a function of Columns and plain values, written out as SQL where it is called with Columns."""
    known: dict[tuple, str] = {}

    @wraps(f)
    def call(*args, **options):
        at = [i for i, a in enumerate(args) if isinstance(a, Column)]
        if not at or _depth:
            return f(*args, **options)
        key = (tuple(None if i in at else a for i, a in enumerate(args)), tuple(at), tuple(sorted(options.items())))
        if key not in known:
            own = ["a"] if len(at) == 1 else [f"a.`c{i}`" for i in at]
            with as_text():
                known[key] = f"a -> {_sql(f(*[Text(own[at.index(i)]) if i in at else a for i, a in enumerate(args)], **options))}"
        one = args[at[0]] if len(at) == 1 else functions.struct(*[args[i].alias(f"c{i}") for i in at])
        return functions.get(functions.call_function("transform", functions.array(one), functions.expr(known[key])), functions.lit(0))

    return call
