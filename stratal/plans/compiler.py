"""From the dialect's syntax tree to Spark SQL text: names, types, and the semantics that differ from Spark's.

The text is one statement, so that Catalyst sees the whole query. Errors of values (overflow, division by zero, casts)
become NULL by try_ functions with ANSI mode left on; sums are exact; nulls sort last ascending and first descending;
ties are broken by all output columns; running windows count rows; decimals keep two digits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from . import syntax as S
from .errors import AnalysisError
from .types import NUMERIC, SIMPLE, common, is_list, is_struct, shown, supported, to_spark


#: Seconds and days of the years 1 to 9999, which dates and times keep to; beyond them is NULL.
SECONDS, DAYS = (-62135596800, 253402300799), (-719162, 2932896)


def _time_at(seconds: str) -> str:
    return f"(CASE WHEN {seconds} BETWEEN {SECONDS[0]}L AND {SECONDS[1]}L THEN timestamp_seconds({seconds}) END)"


def _plain_digits(sql: str) -> str:
    """A double's text without an exponent, and without a fraction if it is whole."""
    text = f"CAST({sql} AS STRING)"
    part = lambda n: f"regexp_extract({text}, '^(-?)([0-9])[.]([0-9]+)E(-?[0-9]+)$', {n})"
    rest, power = f"regexp_replace({part(3)}, '0+$', '')", f"try_cast({part(4)} AS INT)"
    large = f"CASE WHEN length({rest}) <= {power} THEN concat({part(2)}, rpad({rest}, {power}, '0')) ELSE concat({part(2)}, substring({rest}, 1, {power}), '.', substring({rest}, {power} + 1)) END"
    spelt = f"concat({part(1)}, CASE WHEN {power} >= 0 THEN {large} ELSE concat('0.', repeat('0', -{power} - 1), {part(2)}, {rest}) END)"
    return f"(CASE WHEN {text} LIKE '%E%' THEN {spelt} ELSE replace(regexp_replace({text}, '[.]0$', ''), 'Infinity', 'inf') END)"


@dataclass
class Field:
    name: str
    type: object
    sql: str


@dataclass
class Source:
    alias: str
    fields: list[Field]
    unnested: bool = False


@dataclass
class Scope:
    sources: list[Source]
    outer: Scope | None = None
    #: What an aggregate query may name, as SQL; None where it is none.
    grouped: set[str] | None = None
    correlated: bool = False

    def find(self, parts: tuple[str, ...]) -> tuple[str, object] | None:
        hits = []
        for s in self.sources:
            for f in s.fields:
                if f.name == parts[0]:
                    hits.append((f, parts[1:]))
                if s.alias == parts[0] and len(parts) > 1 and f.name == parts[1]:
                    hits.append((f, parts[2:]))
        found = []
        for f, rest in hits:
            sql, t = f.sql, f.type
            for p in rest:
                if is_list(t):
                    raise AnalysisError(f"{'.'.join(parts)}: LIST traversal requires UNNEST")
                t = dict(t[1]).get(p) if is_struct(t) else None
                if t is None:
                    break
                sql += f".`{p}`"
            if t is not None:
                found.append((sql, t))
        if len(found) > 1:
            raise AnalysisError(f"ambiguous column {'.'.join(parts)}")
        return found[0] if found else None

    def resolve(self, name: S.Name) -> tuple[str, object]:
        scope: Scope | None = self
        while scope is not None:
            if (hit := scope.find(name.parts)) is not None:
                if not supported(hit[1]):
                    raise AnalysisError(f"{'.'.join(name.parts)}: type {shown(hit[1])} is not supported")
                inner: Scope | None = self
                while inner is not scope and inner is not None:
                    inner.correlated = True
                    inner = inner.outer
                if scope is self and scope.grouped is not None and hit[0] not in scope.grouped:
                    raise AnalysisError(f"{'.'.join(name.parts)} must be grouped or aggregated")
                return hit
            scope = scope.outer
        raise AnalysisError(f"unknown column {'.'.join(name.parts)}")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(e: object, kinds: tuple[type, ...], aggregates: bool = False) -> bool:
    """Whether an expression holds such a node, subqueries left out."""
    if isinstance(e, kinds) and (not aggregates or e.name in S.AGGREGATES):
        return True
    if isinstance(e, (S.Query, S.Window)) and not isinstance(e, kinds):
        return False
    if isinstance(e, tuple):
        return any(_has(x, kinds, aggregates) for x in e)
    return hasattr(e, "__dataclass_fields__") and any(_has(getattr(e, f), kinds, aggregates) for f in e.__dataclass_fields__)


@dataclass
class Compiler:
    """tables: name to (view, fields as (name, type)) of everything that FROM may name."""

    tables: dict[str, tuple[str, list[tuple[str, object]]]]
    ctes: list[dict[str, list[tuple[str, object]]]] = field(default_factory=list)

    # queries
    def query(self, q: S.Query, outer: Scope | None = None) -> tuple[str, list[tuple[str, object]], bool]:
        """SQL, output columns, and whether it refers to an outer query."""
        head, local = [], {}
        self.ctes.append(local)
        try:
            for name, sub in q.ctes:
                if name in local:
                    raise AnalysisError(f"duplicate WITH name {name}")
                sql, cols, _ = self.query(sub)
                head.append(f"`{name}` AS ({sql})")
                local[name] = cols
            sql, cols, scope, spelled = self.body(q.body, outer)
            if q.order:
                names = [n for n, _ in cols]
                keys = [self.order_key(k, asc, nulls, names, spelled, scope) for k, asc, nulls in q.order]
                ties = [f"`{n}` ASC NULLS FIRST" for n in names if not any(k.startswith(f"`{n}` ") for k in keys)]
                sql += " ORDER BY " + ", ".join(keys + ties)
            if q.limit is not None:
                sql += f" LIMIT {q.limit}"
            if q.offset:
                sql += f" OFFSET {q.offset}"
        finally:
            self.ctes.pop()
        correlated = scope is not None and scope.correlated
        return (f"WITH {', '.join(head)} " if head else "") + sql, cols, correlated

    def order_key(self, key: S.Name, ascending: bool, nulls: bool | None, names: list[str], spelled: list[str] | None, scope: Scope | None) -> str:
        if len(key.parts) == 1 and key.parts[0] in names:
            hits = [n for n in names if n == key.parts[0]]
        else:
            try:
                target = scope.find(key.parts) if scope else None
            except AnalysisError:
                target = None
            hits = [n for n, s in zip(names, spelled or [], strict=False) if target and s == target[0]]
        if len(hits) != 1:
            raise AnalysisError(f"ORDER BY {'.'.join(key.parts)} must name one output column")
        first = (not ascending) if nulls is None else nulls
        return f"`{hits[0]}` {'ASC' if ascending else 'DESC'} NULLS {'FIRST' if first else 'LAST'}"

    def body(self, b: object, outer: Scope | None):
        if isinstance(b, S.Union):
            left, lc, ls, _ = self.body(b.left, outer)
            right, rc, rs, _ = self.body(b.right, outer)
            if len(lc) != len(rc):
                raise AnalysisError("UNION needs as many columns on both sides")
            cols = []
            for (n, a), (_, c) in zip(lc, rc, strict=True):
                if (t := common(a, c)) is None:
                    raise AnalysisError(f"UNION: {shown(a)} and {shown(c)} are incompatible")
                cols.append((n, t))
            scope = Scope([], outer)
            scope.correlated = bool(ls and ls.correlated or rs and rs.correlated)
            left, right = (self.widened(x, xc, cols) for x, xc in ((left, lc), (right, rc)))
            return f"({left}) UNION {'ALL ' if b.all else ''}({right})", cols, scope, None
        return self.select(b, outer)

    @staticmethod
    def widened(sql: str, own: list[tuple[str, object]], cols: list[tuple[str, object]]) -> str:
        if [t for _, t in own] == [t for _, t in cols]:
            return sql
        return "SELECT " + ", ".join(f"CAST(`{n}` AS {to_spark(t)}) AS `{n}`" if t != k and t != "null" else f"`{n}`" for (n, k), (_, t) in zip(own, cols, strict=True)) + f" FROM ({sql})"

    def source(self, s: object) -> tuple[str, Source]:
        if isinstance(s, S.Derived):
            sql, cols, _ = self.query(s.query)
            if len({n for n, _ in cols}) < len(cols):
                raise AnalysisError(f"{s.alias} has columns of the same name")
            return f"({sql}) AS `{s.alias}`", Source(s.alias, [Field(n, t, f"`{s.alias}`.`{n}`") for n, t in cols])
        for level in reversed(self.ctes):
            if s.name in level:
                return f"`{s.name}` AS `{s.alias}`", Source(s.alias, [Field(n, t, f"`{s.alias}`.`{n}`") for n, t in level[s.name]])
        if s.name not in self.tables:
            raise AnalysisError(f"unknown table {s.name}")
        view, cols = self.tables[s.name]
        return f"`{view}` AS `{s.alias}`", Source(s.alias, [Field(n, t, f"`{s.alias}`.`{n}`") for n, t in cols])

    def select(self, s: S.Select, outer: Scope | None):
        text, first = self.source(s.source)
        scope, views = Scope([first], outer), 0
        for j in s.joins:
            if any(x.alias == j.right.alias for x in scope.sources):
                raise AnalysisError(f"duplicate table name {j.right.alias}")
            if isinstance(j.right, S.Unnest):
                views += 1
                if views > 32:
                    raise AnalysisError("too many UNNEST stages")
                text += self.unnest(j, scope)
                continue
            if views:
                raise AnalysisError("tables must be joined before UNNEST")
            right, src = self.source(j.right)
            scope.sources.append(src)
            if j.kind == "cross":
                text += f" CROSS JOIN {right}"
            else:
                text += f" {j.kind.upper()} JOIN {right} ON {self.condition(j.on, scope, 'ON')}"
        if s.where is not None:
            if _has(s.where, (S.Call,), aggregates=True) or _has(s.where, (S.Window,)):
                raise AnalysisError("WHERE takes no aggregates or windows")
            text += f" WHERE ({self.condition(s.where, scope, 'WHERE')})"
            if self.contradicts(s.where, scope):
                text += " AND FALSE"  # Catalyst then reads nothing at all
        group = [scope.resolve(g)[0] for g in s.group]
        if s.group or s.having is not None or any(_has(i.expr, (S.Call,), aggregates=True) for i in s.items):
            scope.grouped = set(group)
        items, cols, spelled = [], [], []
        for n, item in enumerate(s.items, 1):
            if isinstance(item.expr, S.Star):
                if scope.grouped is not None:
                    raise AnalysisError("* does not go with aggregates")
                for f in [f for src in scope.sources for f in src.fields]:
                    if not supported(f.type):
                        raise AnalysisError(f"{f.name}: type {shown(f.type)} is not supported")
                    items.append(f"{f.sql} AS `{f.name}`")
                    cols.append((f.name, f.type))
                    spelled.append(f.sql)
                continue
            sql, t = self.expr(item.expr, scope)
            name = item.alias or (item.expr.parts[-1] if isinstance(item.expr, S.Name) else f"column{n}")
            items.append(f"{sql} AS `{name}`")
            cols.append((name, t))
            spelled.append(sql)
        out = f"SELECT {'DISTINCT ' if s.distinct else ''}{', '.join(items)} FROM {text}"
        if group:
            out += " GROUP BY " + ", ".join(group)
        if s.having is not None:
            out += f" HAVING {self.condition(s.having, scope, 'HAVING')}"
        scope.grouped = None
        return out, cols, scope, spelled

    def contradicts(self, where: object, scope: Scope) -> bool:
        """Whether conjuncts leave no whole number for some BIGINT column."""
        bounds: dict[str, tuple[int, int]] = {}
        todo = [where]
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
        while todo:
            e = todo.pop()
            if isinstance(e, S.Binary) and e.op == "and":
                todo += [e.left, e.right]
            elif isinstance(e, S.Between) and not e.negated:
                todo += [S.Binary(">=", e.arg, e.low), S.Binary("<=", e.arg, e.high)]
            elif isinstance(e, S.Binary) and e.op in flipped:
                name, op, value = (e.left, e.op, e.right) if isinstance(e.left, S.Name) else (e.right, flipped[e.op], e.left)
                if isinstance(name, S.Name) and isinstance(value, S.Literal) and value.kind == "int" and scope.resolve(name)[1] == "int":
                    low, high = bounds.get(scope.resolve(name)[0], (-(2**63), 2**63 - 1))
                    v = value.value
                    if op in (">", ">=", "="):
                        low = max(low, v + (op == ">"))
                    if op in ("<", "<=", "="):
                        high = min(high, v - (op == "<"))
                    bounds[scope.resolve(name)[0]] = (low, high)
        return any(low > high for low, high in bounds.values())

    def unnest(self, j: S.Join, scope: Scope) -> str:
        u = j.right
        sql, t = scope.resolve(u.path)
        if not is_list(t):
            raise AnalysisError(f"UNNEST needs a LIST, {'.'.join(u.path.parts)} is {shown(t)}")
        held = f"`{u.alias}`.`{u.alias}$x`"
        fields = lambda at: [Field(u.value, t[1], f"{at}.`v`"), *([Field(u.ordinality, "int", f"{at}.`o`")] if u.ordinality else [])]
        numbered = f"transform({sql}, (v, i) -> named_struct('v', v, 'o', CAST(i + 1 AS BIGINT)))"
        if j.on is not None:
            inside = Scope([*scope.sources, Source(u.alias, fields("e"), True)], scope.outer)
            numbered = f"filter({numbered}, e -> {self.condition(j.on, inside, 'ON')})"
        scope.sources.append(Source(u.alias, fields(held), True))
        return f" LATERAL VIEW {'OUTER ' if j.kind == 'left' else ''}explode({numbered}) `{u.alias}` AS `{u.alias}$x`"

    # expressions
    def condition(self, e: object, scope: Scope, where: str) -> str:
        sql, t = self.expr(e, scope)
        if t not in ("bool", "null"):
            raise AnalysisError(f"{where} needs a BOOLEAN, not {shown(t)}")
        return sql

    def both(self, what: str, scope: Scope, *args: object) -> tuple[list[str], object]:
        """Arguments widened to one type."""
        got = [self.expr(a, scope) for a in args]
        t: object = "null"
        for _, k in got:
            if (c := common(t, k)) is None:
                raise AnalysisError(f"{what}: {shown(t)} and {shown(k)} are incompatible")
            t = c
        return [self.to(sql, k, t) for sql, k in got], t

    @staticmethod
    def to(sql: str, a: object, b: object) -> str:
        return sql if a == b or a == "null" or b == "null" else f"CAST({sql} AS {to_spark(b)})" if b == "double" else f"CAST({sql} AS DECIMAL(21,2))"

    def expr(self, e: object, scope: Scope) -> tuple[str, object]:
        match e:
            case S.Name():
                return scope.resolve(e)
            case S.Literal(value, kind):
                if kind == "null":
                    return "NULL", "null"
                if kind == "string":
                    return quoted(value), "string"
                return {"int": f"{value}L", "double": f"{value!r}D", "bool": str(value).upper()}[kind], kind
            case S.Unary("not", arg):
                return f"(NOT {self.condition(arg, scope, 'NOT')})", "bool"
            case S.Unary("-", arg):
                return self.arithmetic("-", ("0L", "int"), self.expr(arg, scope))
            case S.Binary(op, left, right) if op in ("and", "or"):
                return f"({self.condition(left, scope, op.upper())} {op.upper()} {self.condition(right, scope, op.upper())})", "bool"
            case S.Binary(op, left, right) if op in "+-*/":
                return self.arithmetic(op, self.expr(left, scope), self.expr(right, scope))
            case S.Binary(op, left, right):
                (a, b), _ = self.both(op, scope, left, right)
                return f"({a} {op} {b})", "bool"
            case S.IsNull(arg, negated):
                return f"({self.expr(arg, scope)[0]} IS {'NOT ' if negated else ''}NULL)", "bool"
            case S.InList(arg, items, negated):
                if not items:
                    return f"(CASE WHEN {self.expr(arg, scope)[0]} IS NOT NULL THEN {str(negated).upper()} END)", "bool"
                (a, *rest), _ = self.both("IN", scope, arg, *items)
                return f"({a} {'NOT ' if negated else ''}IN ({', '.join(rest)}))", "bool"
            case S.InQuery(arg, q, negated):
                a, t = self.expr(arg, scope)
                sql, cols, _ = self.query(q, scope)
                if len(cols) != 1 or common(t, cols[0][1]) is None:
                    raise AnalysisError("IN needs a subquery of one column of the same type")
                return f"({a} {'NOT ' if negated else ''}IN ({sql}))", "bool"
            case S.Between(arg, low, high, negated):
                (a, b, c), _ = self.both("BETWEEN", scope, arg, low, high)
                return f"({a} {'NOT ' if negated else ''}BETWEEN {b} AND {c})", "bool"
            case S.Like(arg, pattern, negated):
                a = self.typed(arg, scope, "LIKE", "string")
                p = self.typed(pattern, scope, "LIKE", "string")
                # a backslash is an ordinary character
                return f"({a} {'NOT ' if negated else ''}LIKE replace({p}, '\\\\', '\\\\\\\\'))", "bool"
            case S.Case(whens, default):
                results, t = self.both("CASE", scope, *[r for _, r in whens], *([default] if default is not None else []))
                parts = [f"WHEN {self.condition(c, scope, 'WHEN')} THEN {r}" for (c, _), r in zip(whens, results, strict=False)]
                return f"(CASE {' '.join(parts)}{f' ELSE {results[-1]}' if default is not None else ''} END)", t
            case S.Cast(arg, to):
                return self.cast(*self.expr(arg, scope), to)
            case S.Exists(q):
                return f"(EXISTS ({self.query(q, scope)[0]}))", "bool"
            case S.Scalar(q):
                sql, cols, correlated = self.query(q, scope)
                if len(cols) != 1:
                    raise AnalysisError("a scalar subquery needs one column")
                one = not isinstance(q.body, S.Union) and not q.body.group and any(_has(i.expr, (S.Call,), aggregates=True) for i in q.body.items)
                if not one and not correlated and q.limit is None:
                    sql += " LIMIT 1"
                return f"({sql})", cols[0][1]
            case S.Window():
                return self.window(e, scope)
            case S.Call(name, args, star):
                return self.aggregate(name, args, star, scope) if name in S.AGGREGATES else self.call(name, args, scope)
        raise AnalysisError(f"unexpected {e!r}")

    def typed(self, e: object, scope: Scope, what: str, *allowed: str) -> str:
        sql, t = self.expr(e, scope)
        if t not in (*allowed, "null"):
            raise AnalysisError(f"{what} does not take {shown(t)}")
        return sql if t != "null" else f"CAST(NULL AS {SIMPLE[allowed[0]]})"

    def arithmetic(self, op: str, left: tuple[str, object], right: tuple[str, object]) -> tuple[str, object]:
        (a, ta), (b, tb) = left, right
        if "interval" in (ta, tb) and op in "+-":
            if op == "+" and ta == "interval" and tb in ("date", "timestamp"):
                (a, ta), (b, tb) = (b, tb), (a, ta)
            sign = "-" if op == "-" else ""
            if ta == "date" and tb == "interval":
                days = f"(CAST(unix_date({a}) AS BIGINT) + {sign}({b} div 86400L))"
                return f"(CASE WHEN {b} % 86400L = 0 AND {days} BETWEEN {DAYS[0]}L AND {DAYS[1]}L THEN date_from_unix_date(CAST({days} AS INT)) END)", "date"
            if ta == "timestamp" and tb == "interval":
                return _time_at(f"try_{'subtract' if sign else 'add'}(unix_seconds({a}), {b})"), "timestamp"
            if ta == tb:
                return f"try_{'add' if op == '+' else 'subtract'}({a}, {b})", "interval"
            if a == "0L":
                return f"try_subtract(0L, {b})", "interval"
        for t in (ta, tb):
            if t not in (*NUMERIC, "null"):
                raise AnalysisError(f"{op} does not take {shown(t)}")
        t = common(ta, tb)
        t = "int" if t == "null" else t
        a, b = (f"CAST(NULL AS {SIMPLE[t]})" if k == "null" else s for s, k in ((a, ta), (b, tb)))
        if op == "/":
            return f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))", "double"
        if t == "int":
            return f"try_{ {'+': 'add', '-': 'subtract', '*': 'multiply'}[op] }({a}, {b})", "int"
        if t == "double":
            return f"(CAST({a} AS DOUBLE) {op} CAST({b} AS DOUBLE))", "double"
        a, b = (f"CAST({s} AS DECIMAL(19,0))" if k == "int" else s for s, k in ((a, ta), (b, tb)))
        value = f"({a} {op} {b})"
        if op == "*" and ta == tb:  # four digits, cut towards zero
            value = f"(CASE WHEN {value} < 0 THEN ceil({value}, 2) ELSE floor({value}, 2) END)"
        return f"try_cast({value} AS DECIMAL(18,2))", "decimal"

    def cast(self, sql: str, t: object, to: str) -> tuple[str, object]:
        names = {"bigint": "int", "int64": "int", "integer": "int", "int": "int", "double": "double", "float": "double", "real": "double", "varchar": "string", "string": "string", "text": "string", "boolean": "bool", "bool": "bool", "date": "date", "timestamp": "timestamp", "decimal": "decimal", "decimal(18,2)": "decimal"}
        if to not in names:
            raise AnalysisError(f"CAST to {to} is not supported")
        if not isinstance(t, str):
            raise AnalysisError(f"CAST does not take {shown(t)}")
        k = names[to]
        if t == k:
            return sql, k
        if t == "null":
            return f"CAST(NULL AS {SIMPLE[k]})", k
        if k == "string":
            return self.text(sql, t), k
        if t == "string":
            if k == "int":
                return f"(CASE WHEN {sql} RLIKE '^[+-]?[0-9]+$' THEN try_cast({sql} AS BIGINT) END)", k
            if k in ("double", "decimal"):
                guard = "^[+-]?([0-9]+\\\\.?[0-9]*|\\\\.[0-9]+)([eE][+-]?[0-9]+)?$" if k == "double" else "^[+-]?[0-9]+(\\\\.[0-9]{1,2})?$"
                return f"(CASE WHEN {sql} RLIKE '{guard}' THEN try_cast({sql} AS {SIMPLE[k]}) END)", k
            if k == "bool":
                return f"(CASE {sql} WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END)", k
            return (self.date_of(sql), k) if k == "date" else (self.timestamp_of(sql), k)
        if t == "double" and k == "decimal":
            return f"try_cast(CAST(try_cast(round({sql} * 100D) AS BIGINT) AS DECIMAL(20,0)) * 0.01BD AS DECIMAL(18,2))", k
        if t == "timestamp" and k == "int":
            return f"unix_seconds({sql})", k
        if t == "int" and k == "timestamp":
            return _time_at(sql), k
        if t == "int" and k == "date":
            return f"CAST({_time_at(sql)} AS DATE)", k
        if t in (*NUMERIC, "bool") and k in (*NUMERIC, "bool") or {t, k} == {"date", "timestamp"}:
            return f"try_cast({sql} AS {SIMPLE[k]})", k
        raise AnalysisError(f"CAST from {shown(t)} to {to} is not supported")

    @staticmethod
    def text(sql: str, t: object) -> str:
        if t == "double":
            return _plain_digits(sql)
        return sql if t == "string" else f"CAST({sql} AS STRING)"

    @staticmethod
    def date_of(sql: str) -> str:
        return f"(CASE WHEN {sql} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN try_cast({sql} AS DATE) END)"

    @staticmethod
    def timestamp_of(sql: str) -> str:
        shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\\\.[0-9]+)?Z?)?$"
        return f"(CASE WHEN {sql} RLIKE '{shape}' THEN date_trunc('SECOND', try_cast(regexp_replace({sql}, '(\\\\.[0-9]+)?Z?$', '') AS TIMESTAMP)) END)"

    def aggregate(self, name: str, args: tuple, star: bool, scope: Scope, over: str = "") -> tuple[str, object]:
        if star:
            return f"count(*){over}", "int"
        if len(args) != 1:
            raise AnalysisError(f"{name} takes one argument")
        if _has(args, (S.Call,), aggregates=True) or _has(args, (S.Window,)):
            raise AnalysisError("aggregates do not nest")
        grouped, scope.grouped = scope.grouped, None
        try:
            sql, t = self.expr(args[0], scope)
        finally:
            scope.grouped = grouped
        if name == "count":
            return f"count({sql}){over}", "int"
        if name in ("min", "max"):
            return f"{name}({sql}){over}", t
        if t not in (*NUMERIC, "null"):
            raise AnalysisError(f"{name} does not take {shown(t)}")
        if name == "avg":
            return f"avg(CAST({sql} AS DOUBLE)){over}", "double"
        if t == "double":
            return f"sum({sql}){over}", t
        if t == "decimal":
            return f"try_cast(sum({sql}){over} AS DECIMAL(18,2))", t
        return f"try_cast(sum(CAST({sql} AS DECIMAL(38,0))){over} AS BIGINT)", "int"

    def window(self, w: S.Window, scope: Scope) -> tuple[str, object]:
        parts = [scope.resolve(p)[0] for p in w.partition]
        keys = [f"{scope.resolve(k)[0]} {'ASC' if asc else 'DESC'} NULLS {'FIRST' if (not asc if nulls is None else nulls) else 'LAST'}" for k, asc, nulls in w.order]
        inner = " ".join(([f"PARTITION BY {', '.join(parts)}"] if parts else []) + ([f"ORDER BY {', '.join(keys)}"] if keys else []))
        name, args = w.call.name, w.call.args
        if name in S.AGGREGATES:
            frame = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if keys else ""
            return self.aggregate(name, args, w.call.star, scope, f" OVER ({inner}{frame})")
        if not keys:
            inner += " ORDER BY 1"
        if name in ("row_number", "rank", "dense_rank"):
            if args:
                raise AnalysisError(f"{name} takes no argument")
            return f"CAST({name}() OVER ({inner}) AS BIGINT)", "int"
        if not 1 <= len(args) <= 3:
            raise AnalysisError(f"{name} takes one to three arguments")
        value, t = self.expr(args[0], scope)
        by = 1
        default = ""
        if len(args) > 2:
            (value, d), t = self.both(name, scope, args[0], args[2])
            default = f", {d}"
        if len(args) > 1 and (not isinstance(args[1], S.Literal) or args[1].kind != "int"):
            return self._moved(name, value, self.typed(args[1], scope, name, "int"), default.removeprefix(", ") or "NULL", inner), t
        if len(args) > 1:
            by = args[1].value if args[1].value >= 0 else 1
        return f"{name}({value}, {by}{default}) OVER ({inner})", t

    @staticmethod
    def _moved(name: str, value: str, offset: str, default: str, inner: str) -> str:
        """LAG and LEAD by an offset of each row, from a list of the partition's values: one partition must fit a task."""
        whole = f"OVER ({inner} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        by = f"(CASE WHEN {offset} >= 0 THEN {offset} ELSE 1L END)"
        place = f"try_{'subtract' if name == 'lag' else 'add'}(CAST(row_number() OVER ({inner}) AS BIGINT) - 1L, {by})"
        return f"(CASE WHEN {place} BETWEEN 0L AND count(1) {whole} - 1L THEN get(collect_list(struct({value} AS v)) {whole}, CAST({place} AS INT)).v ELSE {default} END)"

    def call(self, name: str, args: tuple, scope: Scope) -> tuple[str, object]:
        low, high = {"coalesce": (1, 99), "nullif": (2, 2), "abs": (1, 1), "lower": (1, 1), "upper": (1, 1), "length": (1, 1), "substring": (2, 3), "concat": (1, 99), "date": (1, 1), "timestamp": (1, 1), "interval": (1, 1), "extract": (2, 2), "date_trunc": (2, 2), "cardinality": (1, 1)}.get(name, (-1, -1))
        if low < 0:
            raise AnalysisError(f"unsupported function {name}")
        if not low <= len(args) <= high:
            raise AnalysisError(f"{name} takes another number of arguments")
        if name == "coalesce":
            got, t = self.both(name, scope, *args)
            return f"coalesce({', '.join(got)})", t
        if name == "nullif":
            (a, b), t = self.both(name, scope, *args)
            return f"nullif({a}, {b})", t
        if name == "abs":
            a, t = self.expr(args[0], scope)
            if t not in NUMERIC:
                raise AnalysisError(f"abs does not take {shown(t)}")
            return f"(CASE WHEN {a} < 0 THEN {self.arithmetic('-', ('0L', 'int'), (a, t))[0]} ELSE {a} END)", t
        if name in ("lower", "upper"):
            a = self.typed(args[0], scope, name, "string")
            sets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            return "translate({}, '{}', '{}')".format(a, *(sets if name == "lower" else sets[::-1])), "string"
        if name == "length":
            return f"CAST(length({self.typed(args[0], scope, name, 'string')}) AS BIGINT)", "int"
        if name == "substring":
            a = self.typed(args[0], scope, name, "string")
            start = f"CAST(greatest(least({self.typed(args[1], scope, name, 'int')}, 2147483647L), 1L) AS INT)"
            if len(args) == 2:
                return f"substring({a}, {start})", "string"
            n = self.typed(args[2], scope, name, "int")
            return f"(CASE WHEN {n} IS NOT NULL THEN substring({a}, {start}, CAST(greatest(least({n}, 2147483647L), 0L) AS INT)) END)", "string"
        if name == "concat":
            got = [self.expr(a, scope) for a in args]
            if any(not isinstance(t, str) for _, t in got):
                raise AnalysisError("concat does not take containers")
            return f"concat({', '.join(self.text(a, t) for a, t in got)})", "string"
        if name in ("date", "timestamp"):
            a, t = self.expr(args[0], scope)
            out = self.cast(a, t, name)
            if isinstance(args[0], S.Literal) and t not in ("string", "int", "null"):
                raise AnalysisError(f"{name} does not take {shown(t)}")
            return out
        if name == "interval":
            return self.interval(args[0]), "interval"
        if name in ("extract", "date_trunc"):
            if not isinstance(args[0], S.Literal) or args[0].kind != "string":
                raise AnalysisError(f"{name} needs a unit")
            unit = args[0].value.lower()
            a, t = self.expr(args[1], scope)
            if t not in ("date", "timestamp"):
                raise AnalysisError(f"{name} does not take {shown(t)}")
            if unit not in ("year", "month", "day", "hour", "minute", "second"):
                return (f"CAST(NULL AS {'BIGINT' if name == 'extract' else 'TIMESTAMP'})", "int" if name == "extract" else t)
            if name == "extract":
                return f"CAST({'dayofmonth' if unit == 'day' else unit}(CAST({a} AS TIMESTAMP)) AS BIGINT)", "int"
            cut = f"date_trunc('{unit.upper()}', CAST({a} AS TIMESTAMP))"
            return (f"CAST({cut} AS DATE)", "date") if t == "date" and unit in ("year", "month", "day") else (cut, "timestamp")
        a, t = self.expr(args[0], scope)
        if not is_list(t):
            raise AnalysisError(f"cardinality needs a LIST, not {shown(t)}")
        return f"CAST(array_size({a}) AS BIGINT)", "int"

    @staticmethod
    def interval(arg: object) -> str:
        units = {"microsecond": 0, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
        words = arg.value.split() if isinstance(arg, S.Literal) and arg.kind == "string" else []
        unit = words[1].lower().removesuffix("s") if len(words) == 2 else ""
        if unit not in units or not words[0].lstrip("+-").isdigit():
            raise AnalysisError("INTERVAL needs a whole number and a unit")
        return f"{int(words[0]) * units[unit]}L"
