"""Tokens, syntax tree and parser of the SQL dialect.

Words are case-insensitive, names are unquoted, strings double their quotes; aliases of expressions need AS. Operators
bind as in standard SQL. Unions associate to the left; ORDER BY, LIMIT and OFFSET belong to the whole query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import ParseError

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<string>'(?:[^']|'')*')|(?P<symbol><>|!=|<=|>=|[-+*/=<>(),.;]))")
CLAUSES = set("select from where group having order limit offset union on join inner left right full cross as and or not in is between like case when then else end with distinct all by asc desc nulls lateral unnest exists".split())
AGGREGATES = {"count", "sum", "avg", "min", "max"}
RANKS = {"row_number", "rank", "dense_rank", "lag", "lead"}


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Literal:
    value: object
    kind: str  # int, double, string, bool, null


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: Query
    negated: bool


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: object
    negated: bool


@dataclass(frozen=True)
class Case:
    whens: tuple
    default: object | None


@dataclass(frozen=True)
class Cast:
    arg: object
    to: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False


@dataclass(frozen=True)
class Window:
    call: Call
    partition: tuple
    order: tuple  # (Name, ascending, nulls_first or None)


@dataclass(frozen=True)
class Exists:
    query: Query


@dataclass(frozen=True)
class Scalar:
    query: Query


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None


@dataclass(frozen=True)
class Table:
    name: str
    alias: str


@dataclass(frozen=True)
class Derived:
    query: Query
    alias: str


@dataclass(frozen=True)
class Unnest:
    path: Name
    alias: str
    value: str
    ordinality: str | None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross
    right: object
    on: object | None


@dataclass(frozen=True)
class Select:
    items: tuple
    source: object
    joins: tuple
    where: object | None
    group: tuple
    having: object | None
    distinct: bool


@dataclass(frozen=True)
class Union:
    left: object
    right: object
    all: bool


@dataclass(frozen=True)
class Query:
    body: object
    ctes: tuple = ()
    order: tuple = ()
    limit: int | None = None
    offset: int = 0


@dataclass
class Parser:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place = 0
        while self.text[place:].strip():
            m = _TOKEN.match(self.text, place)
            if not m:
                raise ParseError(f"unexpected text at {self.text[place:place + 20]!r}")
            kind = m.lastgroup or ""
            value = m[kind]
            self.tokens.append((kind, value.lower() if kind == "word" else value[1:-1].replace("''", "'") if kind == "string" else value))
            place = m.end()

    # tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def is_(self, *words: str) -> bool:
        return all(self.peek(i)[0] in ("word", "symbol") and self.peek(i)[1] == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"expected {' '.join(words).upper()} before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "word" or value in CLAUSES:
            raise ParseError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> int:
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            raise ParseError(f"expected a whole number, found {value!r}")
        self.at += 1
        return int(value)

    # queries
    def parse(self) -> Query:
        out = self.query()
        self.take(";")
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r}")
        return out

    def query(self) -> Query:
        ctes = []
        if self.take("with"):
            if self.is_("recursive"):
                raise ParseError("recursive queries are not supported")
            while True:
                name = self.name()
                self.need("as")
                self.need("(")
                ctes.append((name, self.query()))
                self.need(")")
                if not self.take(","):
                    break
        body: object = self.select()
        while self.take("union"):
            every = self.take("all")
            body = Union(body, self.select(), every)
        order = self.order() if self.take("order", "by") else ()
        limit = self.whole() if self.take("limit") else None
        offset = self.whole() if self.take("offset") else 0
        return Query(body, tuple(ctes), order, limit, offset)

    def order(self) -> tuple:
        out = []
        while True:
            key = Name(self.path())
            ascending = not self.take("desc") and (self.take("asc") or True)
            nulls = None
            if self.take("nulls"):
                nulls = self.take("first")
                if not nulls:
                    self.need("last")
            out.append((key, ascending, nulls))
            if not self.take(","):
                return tuple(out)

    def path(self) -> tuple[str, ...]:
        parts = [self.name()]
        while self.take("."):
            parts.append(self.name())
        return tuple(parts)

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("from")
        source, joins = self.source(), []
        while (j := self.join()) is not None:
            joins.append(j)
        where = self.expr() if self.take("where") else None
        group: list[Name] = []
        if self.take("group", "by"):
            group.append(Name(self.path()))
            while self.take(","):
                group.append(Name(self.path()))
        having = self.expr() if self.take("having") else None
        return Select(tuple(items), source, tuple(joins), where, tuple(group), having, distinct)

    def item(self) -> Item:
        if self.take("*"):
            if self.is_("as"):
                raise ParseError("* takes no alias")
            return Item(Star(), None)
        e = self.expr()
        return Item(e, self.name() if self.take("as") else None)

    def alias(self, default: str | None) -> str:
        if self.take("as"):
            return self.name()
        kind, value = self.peek()
        if kind == "word" and value not in CLAUSES:
            return self.name()
        if default is None:
            raise ParseError("a derived table needs an alias")
        return default

    def source(self) -> object:
        if self.take("("):
            q = self.query()
            self.need(")")
            return Derived(q, self.alias(None))
        if self.is_("unnest") or self.is_("lateral"):
            raise ParseError("UNNEST needs a table before it")
        name = self.name()
        return Table(name, self.alias(name))

    def unnest(self) -> Unnest:
        self.take("lateral")
        self.need("unnest")
        self.need("(")
        path = Name(self.path())
        if not self.take(")"):
            raise ParseError("UNNEST takes one list")
        ordinal = self.take("with", "ordinality")
        self.take("as")
        alias, value, position = self.name(), "value", "ordinality"
        if self.take("("):
            value = self.name()
            if self.take(","):
                if not ordinal:
                    raise ParseError("a second column name needs WITH ORDINALITY")
                position = self.name()
            self.need(")")
        return Unnest(path, alias, value, position if ordinal else None)

    def join(self) -> Join | None:
        if self.take(","):
            kind = "cross"
        elif self.take("cross", "join"):
            kind = "cross"
        elif self.take("inner", "join") or self.take("join"):
            kind = "inner"
        else:
            kind = next((k for k in ("left", "right", "full") if self.is_(k)), "")
            if not kind:
                return None
            self.at += 1
            self.take("outer")
            self.need("join")
        right = self.unnest() if self.is_("unnest") or self.is_("lateral") else self.source()
        if isinstance(right, Unnest) and kind in ("right", "full"):
            raise ParseError(f"{kind.upper()} JOIN UNNEST is not supported")
        if kind == "cross":
            return Join(kind, right, None)
        self.need("on")
        return Join(kind, right, self.expr())

    # expressions
    def expr(self) -> object:
        left = self.conjunction()
        while self.take("or"):
            left = Binary("or", left, self.conjunction())
        return left

    def conjunction(self) -> object:
        left = self.negation()
        while self.take("and"):
            left = Binary("and", left, self.negation())
        return left

    def negation(self) -> object:
        if self.take("not"):
            return Unary("not", self.negation())
        return self.predicate()

    def predicate(self) -> object:
        left = self.sum()
        while True:
            if self.take("is"):
                negated = self.take("not")
                self.need("null")
                left = IsNull(left, negated)
                continue
            negated = self.is_("not") and self.peek(1)[1] in ("in", "between", "like") and self.take("not")
            if self.take("in"):
                self.need("(")
                if self.is_("select") or self.is_("with"):
                    left = InQuery(left, self.query(), negated)
                else:
                    items: list[object] = []
                    while not self.is_(")"):
                        items.append(self.expr())
                        if not self.take(","):
                            break
                    left = InList(left, tuple(items), negated)
                self.need(")")
            elif self.take("between"):
                low = self.sum()
                self.need("and")
                left = Between(left, low, self.sum(), negated)
            elif self.take("like"):
                left = Like(left, self.sum(), negated)
            elif (op := self.peek())[0] == "symbol" and op[1] in ("=", "!=", "<>", "<", "<=", ">", ">="):
                self.at += 1
                left = Binary("!=" if op[1] == "<>" else op[1], left, self.sum())
            else:
                return left

    def sum(self) -> object:
        left = self.product()
        while self.is_("+") or self.is_("-"):
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.product())
        return left

    def product(self) -> object:
        left = self.signed()
        while self.is_("*") or self.is_("/"):
            op = self.peek()[1]
            self.at += 1
            left = Binary(op, left, self.signed())
        return left

    def signed(self) -> object:
        if self.take("-"):
            kind, value = self.peek()
            if kind == "number":
                self.at += 1
                return Literal(-float(value), "double") if "." in value else self.integer(-int(value))
            return Unary("-", self.signed())
        self.take("+")
        return self.primary()

    @staticmethod
    def integer(value: int) -> Literal:
        if not -(2**63) <= value < 2**63:
            raise ParseError("a whole number is outside 64 bits")
        return Literal(value, "int")

    def primary(self) -> object:
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return Literal(float(value), "double") if "." in value else self.integer(int(value))
        if kind == "string":
            self.at += 1
            return Literal(value, "string")
        if self.take("("):
            if self.is_("select") or self.is_("with"):
                q = self.query()
                self.need(")")
                return Scalar(q)
            e = self.expr()
            self.need(")")
            return e
        if self.take("exists"):
            self.need("(")
            q = self.query()
            self.need(")")
            return Exists(q)
        if self.take("case"):
            whens = []
            while self.take("when"):
                condition = self.expr()
                self.need("then")
                whens.append((condition, self.expr()))
            if not whens:
                raise ParseError("CASE needs WHEN")
            default = self.expr() if self.take("else") else None
            self.need("end")
            return Case(tuple(whens), default)
        if kind != "word":
            raise ParseError(f"unexpected {value or 'end of text'!r}")
        if self.is_("cast", "("):
            self.at += 2
            e = self.expr()
            self.need("as")
            to = self.name()
            if to == "decimal" and self.take("("):
                p = self.whole()
                self.need(",")
                s = self.whole()
                self.need(")")
                to = f"decimal({p},{s})"
            self.need(")")
            return Cast(e, to)
        if self.is_("extract", "("):
            self.at += 2
            part = self.name()
            self.need("from")
            e = self.expr()
            self.need(")")
            return Call("extract", (Literal(part, "string"), e))
        if value in ("true", "false", "null"):
            self.at += 1
            return Literal(None if value == "null" else value == "true", "null" if value == "null" else "bool")
        if value in ("date", "timestamp", "interval") and self.peek(1)[0] == "string":
            self.at += 2
            return Call(value, (Literal(self.peek(-1)[1], "string"),))
        if self.peek(1) == ("symbol", "("):
            return self.call()
        return Name(self.path())

    def call(self) -> object:
        name = self.peek()[1]
        self.at += 2
        if name in AGGREGATES and self.is_("distinct"):
            raise ParseError("DISTINCT inside an aggregate is not supported")
        if name == "count" and self.take("*"):
            call = Call(name, (), star=True)
        else:
            args: list[object] = []
            while not self.is_(")"):
                args.append(self.expr())
                if not self.take(","):
                    break
            call = Call(name, tuple(args))
        self.need(")")
        if not self.take("over"):
            if name in RANKS:
                raise ParseError(f"{name} needs OVER")
            return call
        if name not in AGGREGATES | RANKS:
            raise ParseError(f"unknown window function {name}")
        self.need("(")
        partition: list[Name] = []
        if self.take("partition", "by"):
            partition.append(Name(self.path()))
            while self.take(","):
                partition.append(Name(self.path()))
        order = self.order() if self.take("order", "by") else ()
        if self.take("rows"):
            self.need("between")
            self.need("unbounded", "preceding")
            self.need("and")
            self.need("current", "row")
        self.need(")")
        return Window(call, tuple(partition), order)


def parse(text: str) -> Query:
    return Parser(text).parse()
