"""The message query language: words, grammar, trees.

Strict mode takes the core grammar. Its rules that differ from SQL are kept: AND and OR bind equally and to the left;
parentheses stand only at the left end of a condition; names of queues and segments are case-sensitive, keywords aren't and
can't be names; strings have no escape for a quote; numbers are whole and unsigned; one statement a call, with at most one
semicolon; CR outside a string is an error; after `*`, further columns are read and ignored.

Extended mode adds, as extensions: envelope columns by name, components (`segment.PID[3].0`) and dashed paths (`PID-3.0`),
nested parentheses, NOT, IN, IS NULL, GROUP BY, HAVING, ORDER BY, LIMIT, DISTINCT, SUM/AVG/MIN/MAX, doubled quotes in strings,
signed and decimal numbers, CHANNEL for QUEUE and aliases that are keywords. AND then binds before OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pipehat.plans import ast


class SyntaxProblem(ValueError):
    """The statement isn't in the language."""


# The keywords.
KEYWORDS = frozenset("SELECT FROM WHERE INSERT MESSAGE AND OR LIKE BETWEEN IN COUNT GROUP BY AS CREATE DROP QUEUE INTO ALL POP CLEAR HISTORY SEGMENT TIMESTAMP LAST_N_HOURS LAST_N_DAYS".split())
MORE_KEYWORDS = frozenset("NOT IS NULL HAVING ORDER ASC DESC LIMIT DISTINCT SUM AVG MIN MAX CHANNEL".split())
COMPARISONS = ("=", "!=", "<>", "<", "<=", ">", ">=")
MAX_INT, MIN_SIGNED = 2**63 - 1, -(2**31)
STRICT = re.compile(r"(?P<space>[ \t\n]+|--[^\n]*)|(?P<string>'[^']*')|(?P<number>[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>!=|<>|<=|>=|[=<>()\[\],.*;])")
EXTENDED = re.compile(
    r"(?P<space>[ \t\r\n]+|--[^\n]*)|(?P<string>'(?:[^']|'')*')|(?P<path>[A-Z][A-Z0-9]{2}-[0-9]+(?:\.[0-9]+){0,2}(?![A-Za-z0-9_]))|(?P<number>-?[0-9]+(?:\.[0-9]+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>!=|<>|<=|>=|[=<>()\[\],.*;])"
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, string, number, path, op, end
    text: str
    value: object = None
    at: int = 0


def tokens(text: str, extended: bool = False) -> list[Token]:
    pattern, keywords = (EXTENDED, KEYWORDS | MORE_KEYWORDS) if extended else (STRICT, KEYWORDS)
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character {text[at]!r} at {at}")
        kind, s = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token(kind, s, s[1:-1].replace("''", "'") if extended else s[1:-1], at))
        elif kind == "number":
            out.append(Token(kind, s, float(s) if "." in s else max(-MAX_INT - 1, min(int(s), MAX_INT)), at))
        elif kind == "word":
            upper = s.upper()
            out.append(Token("keyword", upper, s, at) if upper in keywords else Token("name", s, s, at))
        elif kind != "space":
            out.append(Token(kind, s, s, at))
        at = m.end()
    out.append(Token("end", "", None, at))
    return out


class Parser:
    def __init__(self, text: str, extended: bool = False):
        self.tokens, self.i, self.extended = tokens(text, extended), 0, extended

    # -- reading ------------------------------------------------------------------------------------------------------
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def fail(self, wanted: str) -> SyntaxProblem:
        return SyntaxProblem(f"{wanted} expected at {self.now.at}, not {self.now.text or 'the end'!r}")

    def take(self, kind: str, *texts: str) -> Token | None:
        t = self.now
        if t.kind == kind and (not texts or t.text in texts):
            self.i += 1
            return t
        return None

    def need(self, kind: str, *texts: str) -> Token:
        t = self.take(kind, *texts)
        if t is None:
            raise self.fail(" or ".join(texts) or kind)
        return t

    def word(self, *texts: str) -> bool:
        return self.take("keyword", *texts) is not None

    # -- statements ---------------------------------------------------------------------------------------------------
    def statement(self):
        t = self.need("keyword", "SELECT", "INSERT", "CREATE", "DROP", "POP", "CLEAR")
        if t.text == "SELECT":
            out = self.select()
        elif t.text == "INSERT":
            self.need("keyword", "MESSAGE")
            self.need("keyword", "INTO")
            out = ast.Insert(self.need("name").text, self.need("string").value)
        elif t.text in ("CREATE", "DROP"):
            self.need("keyword", "QUEUE", *(["CHANNEL"] if self.extended else []))
            out = (ast.CreateQueue if t.text == "CREATE" else ast.DropQueue)(self.need("name").text)
        elif t.text == "POP":
            self.need("keyword", "MESSAGE")
            self.need("keyword", "FROM")
            out = ast.Pop(self.need("name").text)
        else:
            self.need("keyword", "HISTORY")
            out = ast.ClearHistory(self.need("name").text)
        self.take("op", ";")
        self.need("end")
        return out

    def select(self) -> ast.Select:
        distinct = self.extended and self.word("DISTINCT")
        star, items = bool(self.take("op", "*")), []
        if not star:
            items.append(self.item())
        while self.take("op", ","):
            items.append(self.item())
        self.need("keyword", "FROM")
        source = self.source()
        where = self.condition() if self.word("WHERE") else None
        group, having, order, limit = (), None, [], None
        if self.extended:
            if self.word("GROUP"):
                self.need("keyword", "BY")
                group = tuple(self.several(self.expression))
            if self.word("HAVING"):
                having = self.condition()
            if self.word("ORDER"):
                self.need("keyword", "BY")
                order = self.several(self.ordering)
            if self.word("LIMIT"):
                limit = self.need("number").value
                if not isinstance(limit, int) or limit < 0:
                    raise SyntaxProblem("LIMIT takes a whole number")
        return ast.Select(None if star else tuple(items), source, where, group, having, tuple(order), limit, distinct, tuple(items) if star else ())

    def several(self, one) -> list:
        out = [one()]
        while self.take("op", ","):
            out.append(one())
        return out

    def ordering(self) -> tuple[object, bool]:
        e = self.expression()
        if self.word("DESC"):
            return e, False
        self.word("ASC")
        return e, True

    def item(self) -> ast.Item:
        e, alias = self.expression(), None
        if self.word("AS"):
            t = self.take("keyword") if self.extended else None
            alias = (t.value if t else self.need("name").text)
        return ast.Item(e, alias)

    def source(self) -> ast.Source:
        if self.take("op", "*"):
            return ast.Source("wildcard")
        if self.word("ALL"):
            return ast.Source("all")
        name = self.need("name").text
        if self.take("op", "."):
            self.need("keyword", "HISTORY")
            return ast.Source("history", name)
        return ast.Source("queue", name)

    # -- expressions --------------------------------------------------------------------------------------------------
    def expression(self):
        t = self.now
        if t.kind in ("string", "number"):
            self.i += 1
            return ast.Literal(t.value)
        if self.word("TIMESTAMP"):
            return ast.TimestampRef()
        if self.word("SEGMENT"):
            self.need("op", ".")
            segment = self.need("name").text
            self.need("op", "[")
            n = self.whole()
            self.need("op", "]")
            rest = []
            while self.extended and not rest[1:] and self.take("op", "."):
                t = self.need("number")  # `1.0` reads as one number
                rest += [int(x) for x in t.text.split(".") if x.isdigit()]
            if len(rest) > 2:
                raise SyntaxProblem("a field has components and subcomponents only")
            return ast.FieldRef(segment, n, *rest)
        if t.kind == "keyword" and t.text in ("COUNT", "SUM", "AVG", "MIN", "MAX"):
            self.i += 1
            self.need("op", "(")
            distinct = self.extended and self.word("DISTINCT")
            arg = None if t.text == "COUNT" and not distinct and self.take("op", "*") else self.expression()
            self.need("op", ")")
            return ast.Aggregate(t.text.lower(), arg, distinct)
        if t.kind == "keyword" and t.text in ("LAST_N_HOURS", "LAST_N_DAYS"):
            self.i += 1
            self.need("op", "(")
            n = self.whole()
            self.need("op", ")")
            return ast.LastN("hours" if t.text == "LAST_N_HOURS" else "days", n)
        if self.extended and (t := self.take("path")):
            segment, _, rest = t.text.partition("-")
            return ast.FieldRef(segment, *map(int, rest.split(".")))
        if self.extended and (t := self.take("name")):
            return ast.ColumnRef(t.text)
        raise self.fail("an expression")

    def whole(self) -> int:
        n = self.need("number").value
        if not isinstance(n, int) or n < 0:
            raise SyntaxProblem("a whole number is needed")
        return n

    # -- conditions ---------------------------------------------------------------------------------------------------
    def condition(self):
        return self.either() if self.extended else self.flat()

    def flat(self):
        """Comparisons joined from the left, AND and OR alike; a parenthesis only first."""
        if self.take("op", "("):
            out = self.flat()
            self.need("op", ")")
        else:
            out = self.comparison()
        while t := self.take("keyword", "AND", "OR"):
            out = ast.Binary(t.text, out, self.comparison())
        return out

    def either(self):
        out = self.both()
        while self.word("OR"):
            out = ast.Binary("OR", out, self.both())
        return out

    def both(self):
        out = self.single()
        while self.word("AND"):
            out = ast.Binary("AND", out, self.single())
        return out

    def single(self):
        if self.word("NOT"):
            return ast.Not(self.single())
        if self.take("op", "("):
            out = self.either()
            self.need("op", ")")
            return out
        return self.comparison()

    def comparison(self):
        left = self.expression()
        if t := self.take("op", *COMPARISONS):
            return ast.Binary("!=" if t.text == "<>" else t.text, left, self.expression())
        negated = self.extended and self.word("NOT")
        if self.word("LIKE"):
            out = ast.Binary("LIKE", left, self.expression())
        elif self.word("BETWEEN"):
            low = self.expression()
            self.need("keyword", "AND")
            out = ast.Between(left, low, self.expression())
        elif self.extended and self.word("IN"):
            self.need("op", "(")
            out = ast.InList(left, tuple(self.several(self.expression)))
            self.need("op", ")")
        elif self.extended and not negated and self.word("IS"):
            no = self.word("NOT")
            self.need("keyword", "NULL")
            return ast.IsNull(left, no)
        else:
            raise self.fail("a comparison")
        return ast.Not(out) if negated else out


def parse(text: str, extended: bool = False):
    """The tree of one statement; SyntaxProblem if it isn't one."""
    return Parser(text, extended).statement()
