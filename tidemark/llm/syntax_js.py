"""JavaScript, TypeScript and TSX: a lexer driven by a pushdown parser.

The parser asks for tokens where it stands, so that a slash is a regular expression,
an angle bracket a type or an element only where the grammar has one. Types and names
are read over, not checked. The first token that fits nowhere ends it.
"""

from __future__ import annotations

import re


class Bad(Exception):
    """What is wrong and where."""

    def __init__(self, why: str, at: int):
        super().__init__(why)
        self.why, self.at = why, at


ID = r"(?:[$_a-zA-Zª-￿\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$\w‌‍·ª-￿\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
SPACE = re.compile(r"(?:[\s﻿]+|//[^\n\r  ]*|/\*.*?\*/)*", re.S)
TOKEN = re.compile(
    rf"""(?P<id>\#?{ID})
    |(?P<num>0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)
    |(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|.|[\r\n]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.|[\r\n]))*')
    |(?P<p>\.\.\.|=>|>>>=|\*\*=|===|!==|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\?\.(?!\d)|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@`])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-zA-Z]*")
ELEMENT = re.compile(rf"{ID}(?:-\w*)*(?:[:.]{ID}(?:-\w*)*)*")
CLOSING = re.compile(rf"<\s*/\s*((?:{ID}(?:-\w*)*(?:[:.]{ID}(?:-\w*)*)*)?)\s*>")
QUOTED = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')")
WORDS = re.compile(r"[^<{>}]*")
LITERAL = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
CLASH = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)", re.M)
# Words of the languages.
RESERVED = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
BINARY = {
    "||": 1, "??": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7,
    "instanceof": 7, "in": 7, "as": 7, "satisfies": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "declare", "override", "accessor"}


class Script:
    """One source text of js, ts or tsx; ``check`` raises Bad where it is not valid."""

    def __init__(self, text: str, language: str):
        self.s, self.n = text, len(text)
        self.ts, self.jsx = language in ("ts", "tsx"), language == "tsx"
        self.pos = 0
        self.read: dict[int, tuple[int, str, str, int, bool]] = {}
        self.no_arrow: set[int] = set()
        self.no_types: set[int] = set()
        self.function, self.loop, self.switch, self.labels = 0, 0, 0, ()
        at = 1 if text.startswith("\ufeff") else 0
        self.move((text + "\n").index("\n") if text.startswith("#!", at) else at)

    # tokens
    def move(self, at: int) -> None:
        """Stand before the next token at or after a place; each place is read once."""
        found = self.read.get(at)
        if found is None:
            found = self.read[at] = self.token(at)
        self.at, self.kind, self.value, self.end, self.newline = found

    def token(self, start: int) -> tuple[int, str, str, int, bool]:
        s = self.s
        at = SPACE.match(s, start).end()
        newline = start == 0 or at > start and ("\n" in s[start:at] or "\r" in s[start:at])
        if at >= self.n:
            return at, "eof", "", self.n, newline
        m = TOKEN.match(s, at)
        if not m:
            c = s[at]
            raise Bad("unterminated literal" if c in "\"'" else "unterminated comment" if c == "/" else "stray sign", at)
        kind, value, end = m.lastgroup, m.group(), m.end()
        if value == "/" and s.startswith("/*", at):
            raise Bad("unterminated comment", at)
        if kind == "num" and end < self.n and re.match(r"[$\w]", s[end]):
            raise Bad("bad number", at)
        return at, kind, value, end, newline

    def step(self) -> str:
        value = self.value
        self.move(self.end)
        return value

    def fail(self, why: str = "") -> None:
        raise Bad(why or ("premature end" if self.kind == "eof" else "unexpected token"), self.at)

    def sees(self, *values: str) -> bool:
        return self.kind in ("p", "id") and self.value in values

    def takes(self, *values: str) -> bool:
        if self.sees(*values):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.takes(value):
            closing = value in ")]}" and (self.kind == "eof" or self.value in (")", "]", "}"))
            self.fail("unbalanced delimiters" if closing else "")

    def peek(self) -> tuple[str, str, bool]:
        found = self.read.get(self.end)
        if found is None:
            found = self.read[self.end] = self.token(self.end)
        return found[1], found[2], found[4]

    def mark(self):
        return (self.at, self.kind, self.value, self.end, self.newline, self.inside())

    def back(self, mark) -> None:
        self.at, self.kind, self.value, self.end, self.newline, inside = mark
        self.function, self.loop, self.switch, self.labels = inside

    def inside(self) -> tuple:
        """How many functions, loops and switches are open, and the labels a break may name."""
        return self.function, self.loop, self.switch, self.labels

    def tries(self, rule) -> bool:
        here = self.mark()
        try:
            rule()
            return True
        except Bad:
            self.back(here)
            return False

    def close_angle(self) -> None:
        if self.kind != "p" or self.value[0] != ">":
            self.fail()
        self.move(self.at + 1)

    def semicolon(self) -> None:
        if self.takes(";") or self.sees("}") or self.kind == "eof" or self.newline:
            return
        self.fail()

    def name(self, any_word: bool = False) -> str:
        if self.kind != "id" or not any_word and (self.value in RESERVED or self.value[0] == "#"):
            self.fail()
        return self.step()

    # programs and statements
    def check(self) -> None:
        while self.kind != "eof":
            self.statement(True)

    def block(self) -> None:
        self.need("{")
        while not self.sees("}"):
            if self.kind == "eof":
                self.fail("unbalanced delimiters")
            self.statement()
        self.step()

    def statement(self, top: bool = False) -> None:
        if self.kind == "eof":
            self.fail()
        if self.kind == "p":
            if self.value == "{":
                return self.block()
            if self.value == ";":
                self.step()
                return None
            if self.value == "@":
                self.decorators()
                return self.statement(top)
            if self.value in (")", "]", "}"):
                self.fail("unbalanced delimiters")
        elif self.kind == "id":
            rule = getattr(self, "s_" + self.value, None) if self.value.isalpha() else None
            if rule:
                done = rule()
                if done is not False:
                    return None
            elif self.value not in RESERVED:
                kind, value, newline = self.peek()
                if value == ":" and kind == "p":
                    labels = self.labels
                    self.labels = (*labels, self.step())
                    self.step()
                    self.statement()
                    self.labels = labels
                    return None
                if self.value == "async" and value == "function" and not newline:
                    self.step()
                    self.step()
                    self.takes("*")
                    self.name()
                    return self.function_rest()
                if self.value == "let" and (kind == "id" and value not in ("in", "instanceof", "of") or value in ("[", "{")):
                    self.step()
                    self.variables()
                    self.semicolon()
                    return None
                if self.ts and self.ts_statement(kind, value, newline):
                    return None
        self.expression()
        self.semicolon()
        return None

    def ts_statement(self, kind: str, value: str, newline: bool) -> bool:
        word = self.value
        if newline or kind not in ("id", "str") and not (word in ("global",) and value == "{") and not (word == "type" and False):
            return False
        if word == "interface" and kind == "id":
            self.step()
            self.name()
            self.type_parameters()
            if self.takes("extends"):
                self.types(",")
            self.object_type()
            return True
        if word == "type" and kind == "id":
            self.step()
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if word in ("namespace", "module", "global"):
            self.step()
            if self.kind == "str":
                self.step()
            elif self.kind == "id":
                self.name()
                while self.takes("."):
                    self.name()
            if self.sees("{"):
                self.block()
            else:
                self.semicolon()
            return True
        if word == "declare":
            self.step()
            if self.sees("function") or self.sees("async"):
                self.takes("async")
                self.step()
                self.name()
                self.signature()
                self.semicolon()
            else:
                self.declared = True
                self.statement()
                self.declared = False
            return True
        if word == "abstract" and value == "class":
            self.step()
            self.s_class()
            return True
        return False

    declared = False

    def s_var(self) -> None:
        self.step()
        self.variables()
        self.semicolon()

    def s_const(self):
        if self.ts and self.peek()[1] == "enum":
            self.step()
            return self.s_enum()
        self.step()
        self.variables(True)
        self.semicolon()
        return None

    def variables(self, const: bool = False, loop: bool = False) -> None:
        while True:
            pattern = self.sees("[", "{")
            self.binding()
            if self.ts:
                self.takes("!")
                self.annotation()
            if self.takes("="):
                self.assignment(loop)
            elif (const or pattern) and not (loop and self.sees("of", "in")) and not self.declared:
                self.fail()
            if not self.takes(","):
                return

    def annotation(self) -> None:
        if self.ts and self.takes(":"):
            self.type(True)

    def binding(self) -> None:
        if self.takes("["):
            while not self.sees("]"):
                if self.takes(","):
                    continue
                self.takes("...")
                self.binding()
                if self.takes("="):
                    self.assignment()
                if not self.sees("]"):
                    self.need(",")
            self.step()
        elif self.takes("{"):
            while not self.sees("}"):
                if self.takes("..."):
                    self.binding()
                else:
                    plain = self.kind == "id" and self.value not in RESERVED
                    self.property_name()
                    if self.takes(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.takes("="):
                        self.assignment()
                if not self.sees("}"):
                    self.need(",")
            self.step()
        else:
            self.name()

    def property_name(self) -> None:
        if self.kind in ("id", "str", "num"):
            self.step()
        elif self.takes("["):
            self.assignment()
            self.need("]")
        else:
            self.fail()

    def s_function(self) -> None:
        self.step()
        self.takes("*")
        self.name()
        self.function_rest()

    def function_rest(self) -> None:
        self.signature()
        if self.ts and not self.sees("{"):
            return self.semicolon()
        self.body()
        return None

    def body(self, function: bool = True) -> None:
        outside = self.inside()
        self.function, self.loop, self.switch, self.labels = self.function + 1 if function else 0, 0, 0, ()
        self.block()
        self.function, self.loop, self.switch, self.labels = outside

    def signature(self) -> None:
        self.type_parameters()
        self.parameters()
        self.annotation()

    def parameters(self) -> None:
        self.need("(")
        while not self.sees(")"):
            self.decorators()
            if self.ts:
                while self.kind == "id" and self.value in MODIFIERS and self.peek()[0] == "id":
                    self.step()
            rest = self.takes("...")
            if self.ts and self.sees("this"):
                self.step()
            else:
                self.binding()
            if self.ts:
                self.takes("?")
                self.annotation()
            if not rest and self.takes("="):
                self.assignment()
            if not self.sees(")"):
                self.need(",")
        self.step()

    def decorators(self) -> None:
        while self.takes("@"):
            if self.takes("("):
                self.expression()
                self.need(")")
            else:
                self.name(True)
                while self.takes("."):
                    self.name(True)
                if self.sees("("):
                    self.arguments()

    def s_class(self) -> None:
        self.step()
        if self.kind == "id" and not self.sees("extends", "implements"):
            self.name()
        self.class_rest()

    def class_rest(self) -> None:
        self.type_parameters()
        if self.takes("extends"):
            self.unary_tail(allow_types=True)
        if self.ts and self.takes("implements"):
            self.types(",")
        self.need("{")
        while not self.sees("}"):
            if self.kind == "eof":
                self.fail("unbalanced delimiters")
            if self.takes(";"):
                continue
            self.member()
        self.step()

    def member(self) -> None:
        self.decorators()
        words = {"static", "async", "get", "set"} | (MODIFIERS if self.ts else set())
        while self.kind == "id" and self.value in words:
            kind, value, newline = self.peek()
            if kind == "p" and value in ("(", "=", ";", "}", "?", "!", ":", "<", ",") or newline and self.value in ("async",):
                break
            if self.value == "static" and value == "{":
                self.step()
                return self.body(False)
            self.step()
        star = self.takes("*")
        if self.ts and self.sees("[") and self.tries(self.index_signature):
            self.semicolon()
            return None
        self.property_name()
        if self.ts:
            self.takes("?", "!")
        if self.sees("(", "<"):
            self.signature()
            if self.sees("{"):
                self.body()
            elif self.ts:
                self.semicolon()
            else:
                self.fail()
            return None
        if star:
            self.fail()
        self.annotation()
        if self.takes("="):
            self.assignment()
        self.semicolon()
        return None

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type()
        self.need("]")
        self.annotation()

    def s_if(self) -> None:
        self.step()
        self.parenthesized()
        self.statement()
        if self.takes("else"):
            self.statement()

    def parenthesized(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self) -> None:
        self.step()
        self.parenthesized()
        self.looped()

    def looped(self) -> None:
        self.loop += 1
        self.statement()
        self.loop -= 1

    def s_with(self) -> None:
        self.step()
        self.parenthesized()
        self.statement()

    def s_do(self) -> None:
        self.step()
        self.looped()
        self.need("while")
        self.parenthesized()
        self.takes(";")

    def s_for(self) -> None:
        self.step()
        self.takes("await")
        self.need("(")
        if not self.sees(";"):
            if self.sees("var", "const") or self.sees("let") and self.peek()[1] not in ("in", "of", ";"):
                const = self.step() == "const"
                self.variables(const, True)
            else:
                self.expression(True)
            if self.takes("of"):
                self.assignment()
                self.need(")")
                return self.looped()
            if self.takes("in"):
                self.expression()
                self.need(")")
                return self.looped()
        self.need(";")
        if not self.sees(";"):
            self.expression()
        self.need(";")
        if not self.sees(")"):
            self.expression()
        self.need(")")
        return self.looped()

    def s_return(self) -> None:
        if not self.function:
            self.fail("return outside a function")
        self.step()
        if not self.sees(";", "}") and self.kind != "eof" and not self.newline:
            self.expression()
        self.semicolon()

    def s_break(self) -> None:
        at, word = self.at, self.step()
        if self.kind == "id" and not self.newline:
            if self.value not in self.labels:
                self.fail("jump out of nothing")
            self.name()
        elif not self.loop and not (word == "break" and self.switch):
            raise Bad("jump out of nothing", at)
        self.semicolon()

    s_continue = s_break

    def s_throw(self) -> None:
        self.step()
        if self.newline:
            self.fail()
        self.expression()
        self.semicolon()

    def s_debugger(self) -> None:
        self.step()
        self.semicolon()

    def s_try(self) -> None:
        self.step()
        self.block()
        caught = self.takes("catch")
        if caught:
            if self.takes("("):
                self.binding()
                self.annotation()
                self.need(")")
            self.block()
        if self.takes("finally"):
            self.block()
        elif not caught:
            self.fail()

    def s_switch(self) -> None:
        self.step()
        self.parenthesized()
        self.need("{")
        self.switch += 1
        while not self.takes("}"):
            if self.takes("case"):
                self.expression()
            elif not self.takes("default"):
                self.fail("unbalanced delimiters" if self.kind == "eof" else "")
            self.need(":")
            while not self.sees("case", "default", "}"):
                self.statement()
        self.switch -= 1

    def s_enum(self):
        if not self.ts:
            self.fail()
        self.step()
        self.name()
        self.need("{")
        while not self.sees("}"):
            self.property_name()
            if self.takes("="):
                self.assignment()
            if not self.sees("}"):
                self.need(",")
        self.step()

    def s_import(self):
        kind, value, _ = self.peek()
        if value in ("(", "."):
            return False
        self.step()
        if self.kind == "str":
            self.step()
            return self.source_end()
        if self.ts and self.sees("type"):
            k, v, _ = self.peek()
            if v in ("{", "*") or k == "id" and v != "from":
                self.step()
        if self.kind == "id":
            self.name()
            if self.ts and self.takes("="):
                if self.sees("require"):
                    self.step()
                    self.parenthesized()
                else:
                    self.name()
                    while self.takes("."):
                        self.name()
                return self.semicolon()
            if not self.takes(","):
                return self.source()
        if self.takes("*"):
            self.need("as")
            self.name()
        elif self.sees("{"):
            self.specifiers(True)
        else:
            self.fail()
        return self.source()

    def specifiers(self, local: bool) -> None:
        self.need("{")
        while not self.sees("}"):
            if self.ts and self.sees("type") and self.peek()[1] not in (",", "}", "as"):
                self.step()
            plain = self.kind == "id"
            if self.kind not in ("id", "str"):
                self.fail()
            self.step()
            if self.takes("as"):
                if local:
                    self.name()
                elif self.kind in ("id", "str"):
                    self.step()
                else:
                    self.fail()
            elif not plain and local:
                self.fail()
            if not self.sees("}"):
                self.need(",")
        self.step()

    def source(self) -> None:
        self.need("from")
        if self.kind != "str":
            self.fail()
        self.step()
        self.source_end()

    def source_end(self) -> None:
        if self.sees("with", "assert") and not self.newline:
            self.step()
            self.object_literal()
        self.semicolon()

    def s_export(self):
        self.step()
        if self.takes("default"):
            if self.sees("function") or self.sees("async") and self.peek()[1] == "function":
                self.takes("async")
                self.step()
                self.takes("*")
                if self.kind == "id":
                    self.name()
                return self.function_rest()
            if self.sees("class", "@") or self.ts and self.sees("abstract"):
                self.decorators()
                self.takes("abstract")
                return self.s_class()
            if self.ts and self.sees("interface") and self.peek()[0] == "id":
                return self.statement()
            self.assignment()
            return self.semicolon()
        if self.takes("*"):
            if self.takes("as"):
                self.step()
            return self.source()
        if self.ts:
            if self.takes("="):
                self.expression()
                return self.semicolon()
            if self.sees("as"):
                self.step()
                self.need("namespace")
                self.name()
                return self.semicolon()
            if self.sees("import"):
                return self.s_import()
            if self.sees("type") and self.peek()[1] in ("{", "*"):
                self.step()
                if self.takes("*"):
                    if self.takes("as"):
                        self.name(True)
                    return self.source()
        if self.sees("{"):
            self.specifiers(False)
            if self.sees("from"):
                return self.source()
            return self.semicolon()
        words = ("var", "let", "const", "function", "class", "async", "@") + (("interface", "type", "enum", "namespace", "module", "declare", "abstract") if self.ts else ())
        if not self.sees(*words):
            self.fail()
        if self.sees("async") and self.peek()[1] != "function":
            self.fail()
        return self.statement()

    # expressions
    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.takes(","):
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        if self.kind == "id":
            if self.value == "yield" and self.function:
                self.step()
                if self.newline or self.sees(")", "]", "}", ",", ";", ":") or self.kind == "eof":
                    return
                self.takes("*")
                return self.assignment(no_in)
            if self.value not in RESERVED and self.value[0] != "#":
                kind, value, newline = self.peek()
                if value == "=>" and not newline:
                    self.step()
                    self.step()
                    return self.arrow_body(no_in)
                if self.value == "async" and not newline:
                    if kind == "id" and value != "function" and value not in RESERVED:
                        here = self.mark()
                        self.step()
                        self.step()
                        if self.takes("=>"):
                            return self.arrow_body(no_in)
                        self.back(here)
                    elif value in ("(", "<") and self.arrow(True, no_in):
                        return None
        elif self.kind == "p" and (self.value == "(" or self.value == "<" and self.ts) and self.arrow(False, no_in):
            return None
        left = self.at
        target = self.conditional(no_in)
        if self.kind == "p" and self.value in ASSIGN:
            if not target or self.value != "=" and self.s[left] in "[{":
                self.fail()
            self.step()
            self.assignment(no_in)
        return None

    def arrow(self, asynchronous: bool, no_in: bool) -> bool:
        if self.at in self.no_arrow:
            return False
        here = self.at

        def head() -> None:
            if asynchronous:
                self.step()
            self.type_parameters(self.jsx and not asynchronous)
            self.parameters()
            if self.newline and self.sees("=>"):
                self.fail()
            if self.ts and self.takes(":"):
                self.type(True, no_function=False)
            if not self.sees("=>") or self.newline:
                self.fail()
            self.step()

        if not self.tries(head):
            self.no_arrow.add(here)
            return False
        self.arrow_body(no_in)
        return True

    def arrow_body(self, no_in: bool) -> None:
        if self.sees("{"):
            self.body()
        else:
            self.assignment(no_in)

    def conditional(self, no_in: bool) -> bool:
        target = self.binary(0, no_in)
        if self.takes("?"):
            here = self.mark()
            try:
                self.assignment()
                self.need(":")
            except Bad:
                # what looked like an arrow function with a return type was not one
                if not self.ts or here[0] in self.no_arrow or here[2] != "(":
                    raise
                self.back(here)
                self.no_arrow.add(here[0])
                self.assignment()
                self.need(":")
            self.assignment(no_in)
            return False
        return target

    def binary(self, least: int, no_in: bool) -> bool:
        target = self.unary()
        while True:
            op = self.value if self.kind in ("p", "id") else ""
            power = BINARY.get(op, 0)
            if not power or power <= least or op == "in" and no_in:
                return target
            if op in ("as", "satisfies"):
                if not self.ts or self.newline:
                    return target
                self.step()
                if not self.takes("const"):
                    self.type()
                continue
            self.step()
            self.binary(power - (op == "**"), no_in)
            target = False

    def unary(self) -> bool:
        if self.kind == "p" and self.value in ("+", "-", "!", "~"):
            self.step()
            self.unary()
            return False
        if self.kind == "p" and self.value in ("++", "--"):
            self.step()
            if not self.unary():
                self.fail()
            return False
        if self.kind == "id" and self.value in ("typeof", "void", "delete"):
            self.step()
            self.unary()
            return False
        if self.kind == "id" and self.value == "await" and self.peek()[1] not in ("=", ")", ",", ";", ".", "=>", ":", ""):
            self.step()
            self.unary()
            return False
        if self.ts and not self.jsx and self.sees("<"):
            self.step()
            if not self.takes("const"):
                self.type()
            self.close_angle()
            self.unary()
            return False
        target = self.unary_tail()
        if self.kind == "p" and self.value in ("++", "--") and not self.newline:
            if not target:
                self.fail()
            self.step()
            return False
        return target

    def unary_tail(self, allow_types: bool = False) -> bool:
        """A primary with its members, calls and templates; whether it can be assigned to."""
        if self.sees("new"):
            self.step()
            if self.takes("."):
                self.need("target")
            else:
                self.unary_new()
            target = False
        else:
            target = self.primary()
        while True:
            if self.kind == "p":
                v = self.value
                if v == ".":
                    self.step()
                    if self.kind != "id":
                        self.fail()
                    self.step()
                    target = True
                    continue
                if v == "?.":
                    self.step()
                    if self.sees("("):
                        self.arguments()
                    elif self.sees("["):
                        self.index()
                    elif self.sees("`"):
                        self.fail()
                    elif self.kind == "id":
                        self.step()
                    else:
                        self.fail()
                    target = False
                    continue
                if v == "[":
                    self.index()
                    target = True
                    continue
                if v == "(":
                    self.arguments()
                    target = False
                    continue
                if v == "`":
                    self.template()
                    target = False
                    continue
                if self.ts and v == "!" and not self.newline:
                    self.step()
                    continue
                if self.ts and v in ("<", "<<") and self.at not in self.no_types:
                    here = self.at
                    if self.tries(lambda: self.type_arguments_then(allow_types)):
                        target = False
                        continue
                    self.no_types.add(here)
            return target

    def unary_new(self) -> None:
        if self.sees("new"):
            self.step()
            self.unary_new()
        else:
            self.primary()
        while True:
            if self.takes("."):
                if self.kind != "id":
                    self.fail()
                self.step()
            elif self.sees("["):
                self.index()
            elif self.ts and self.sees("<") and self.tries(self.type_arguments):
                pass
            else:
                break
        if self.sees("("):
            self.arguments()

    def index(self) -> None:
        self.need("[")
        self.expression()
        self.need("]")

    def arguments(self) -> None:
        self.need("(")
        while not self.sees(")"):
            self.takes("...")
            self.assignment()
            if not self.sees(")"):
                self.need(",")
        self.step()

    def primary(self) -> bool:
        kind, v = self.kind, self.value
        if kind == "eof":
            self.fail()
        if kind == "num" or kind == "str":
            self.step()
            return False
        if kind == "id":
            if v == "function" or v == "async" and self.peek()[1] == "function" and not self.peek()[2]:
                self.takes("async")
                self.step()
                self.takes("*")
                if self.kind == "id":
                    self.name()
                self.signature()
                self.body()
                return False
            if v == "class":
                self.s_class()
                return False
            if v in ("this", "null", "true", "false"):
                self.step()
                return False
            if v == "super":
                self.step()
                if not self.sees("(", ".", "["):
                    self.fail()
                return False
            if v == "import":
                self.step()
                if self.takes("."):
                    self.need("meta")
                elif not self.sees("("):
                    self.fail()
                return False
            if v[0] == "#":
                self.step()
                if not self.sees("in"):
                    self.fail()
                return False
            self.name()
            return True
        if v == "(":
            self.step()
            at = self.s[self.at : self.at + 1]
            self.expression()
            self.need(")")
            return at not in "[{"
        if v == "[":
            self.step()
            while not self.sees("]"):
                if self.takes(","):
                    continue
                self.takes("...")
                self.assignment()
                if not self.sees("]"):
                    self.need(",")
            self.step()
            return True
        if v == "{":
            self.object_literal()
            return True
        if v == "`":
            self.template()
            return False
        if v in ("/", "/="):
            m = REGEX.match(self.s, self.at)
            if not m:
                raise Bad("unterminated literal", self.at)
            self.move(m.end())
            return False
        if v == "<" and self.jsx:
            self.move(self.element())
            return False
        if v == "@":
            self.decorators()
            self.s_class()
            return False
        self.fail("unbalanced delimiters" if v in (")", "]", "}") and False else "")
        return False

    def object_literal(self) -> None:
        self.need("{")
        while not self.sees("}"):
            if self.takes("..."):
                self.assignment()
            else:
                self.decorators()
                plain = False
                while self.kind == "id" and self.value in ("async", "get", "set"):
                    k, v, newline = self.peek()
                    if k == "p" and v in (",", ":", "(", "}", "=", "<") or k == "eof":
                        break
                    self.step()
                star = self.takes("*")
                plain = self.kind == "id" and self.value not in RESERVED and self.value[0] != "#"
                self.property_name()
                if self.sees("(", "<"):
                    self.signature()
                    self.body()
                elif star:
                    self.fail()
                elif self.takes(":"):
                    self.assignment()
                elif not plain:
                    self.fail()
                elif self.takes("="):
                    self.assignment()
            if not self.sees("}"):
                self.need(",")
        self.step()

    def template(self) -> None:
        at = self.at + 1
        while True:
            m = LITERAL.match(self.s, at)
            at = m.end()
            if at >= self.n:
                raise Bad("unterminated literal", self.at)
            if self.s[at] == "`":
                return self.move(at + 1)
            if self.s[at] == "\\":
                raise Bad("unterminated literal", at)
            self.move(at + 2)
            self.expression()
            if not self.sees("}"):
                self.fail("unbalanced delimiters" if self.kind == "eof" else "")
            at = self.end

    # elements
    def element(self) -> int:
        """Read an element; where it ends, with no token read after it."""
        start = self.at
        self.move(self.at + 1)
        if self.sees(">"):
            return self.children(self.end, "", start)
        tag = self.element_name()
        if self.sees("<"):
            self.type_arguments()
        while not (self.kind == "p" and (self.value == "/" or self.value[0] == ">")):
            if self.takes("{"):
                self.need("...")
                self.assignment()
                self.need("}")
                continue
            self.element_name()
            if self.sees("="):
                m = QUOTED.match(self.s, self.end)
                if m:
                    self.move(m.end())
                    continue
                self.step()
                if self.takes("{"):
                    self.assignment()
                    self.need("}")
                elif self.sees("<"):
                    self.move(self.element())
                else:
                    self.fail()
        if self.value == "/":
            at = SPACE.match(self.s, self.end).end()
            if self.s[at : at + 1] != ">":
                self.fail()
            return at + 1
        return self.children(self.at + 1, tag, start)

    def element_name(self) -> str:
        m = ELEMENT.match(self.s, self.at)
        if not m:
            self.fail()
        self.move(m.end())
        return m.group()

    def children(self, at: int, tag: str, start: int) -> int:
        while True:
            at = WORDS.match(self.s, at).end()
            if at >= self.n:
                raise Bad("unbalanced delimiters", start)
            c = self.s[at]
            if c == "{":
                self.move(at + 1)
                if not self.sees("}"):
                    self.takes("...")
                    self.expression()
                if not self.sees("}"):
                    self.fail("unbalanced delimiters" if self.kind == "eof" else "")
                at = self.end
            elif c == "<":
                m = CLOSING.match(self.s, at)
                if m:
                    if m.group(1) != tag:
                        raise Bad("unbalanced delimiters", at)
                    return m.end()
                if self.s.startswith("</", at):
                    raise Bad("unbalanced delimiters", at)
                self.move(at)
                at = self.element()
            else:
                raise Bad("stray sign", at)

    # types
    def type_arguments_then(self, allow: bool) -> None:
        self.type_arguments()
        if allow and self.sees("{", "implements"):
            return
        if not (self.sees("(", "`") or self.sees(")", "]", ",", ";", ":", "}", "?.", "=", "==", "===", "!=", "!==", "&&", "||", "??", "?") or self.newline or self.kind == "eof"):
            self.fail()

    def type_arguments(self) -> None:
        if self.kind != "p" or self.value[0] != "<":
            self.fail()
        self.move(self.at + 1)
        while True:
            self.type()
            if not self.takes(","):
                break
        self.close_angle()

    def type_parameters(self, comma: bool = False) -> None:
        if not self.ts or not self.sees("<"):
            return
        self.step()
        n, marked = 0, False
        while True:
            if self.kind == "p" and self.value[0] == ">" and n:
                break
            while self.sees("const", "in", "out") and self.peek()[0] == "id":
                self.step()
            self.name()
            n += 1
            if self.takes("extends"):
                self.type()
                marked = True
            if self.takes("="):
                self.type()
            if not self.takes(","):
                break
            marked = True
        if comma and not marked:
            self.fail()
        self.close_angle()

    def types(self, separator: str) -> None:
        self.type()
        while self.takes(separator):
            self.type()

    def type(self, returns: bool = False, no_function: bool = False) -> None:
        if self.kind == "id" and self.value == "asserts" and self.peek()[0] == "id" and not self.peek()[2]:
            self.step()
            self.step()
            if self.takes("is"):
                self.type()
            return
        if self.kind == "id" and self.peek()[1] == "is" and not self.peek()[2]:
            self.step()
            self.step()
            return self.type()
        self.union()
        if self.sees("extends") and not self.newline:
            self.step()
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        self.takes("|", "&")
        self.type_unary()
        while self.takes("|", "&"):
            self.type_unary()

    def type_unary(self) -> None:
        if self.kind == "id" and self.value in ("keyof", "unique", "readonly", "infer") and (self.peek()[0] in ("id", "str") or self.peek()[1] in ("(", "[", "{")):
            infer = self.step() == "infer"
            if infer:
                self.name()
                if self.sees("extends"):
                    self.tries(self.infer_bound)
                return self.type_tail()
            return self.type_unary()
        self.type_primary()
        return self.type_tail()

    def infer_bound(self) -> None:
        self.step()
        self.union()
        if self.sees("?"):
            self.fail()

    def type_tail(self) -> None:
        while self.sees("[") and not self.newline:
            self.step()
            if not self.sees("]"):
                self.type()
            self.need("]")

    def type_primary(self) -> None:
        v = self.value
        if self.kind in ("str", "num"):
            self.step()
            return None
        if self.kind == "id":
            if v in ("new", "abstract") and self.peek()[1] in ("(", "<", "new"):
                self.takes("abstract")
                self.step()
                return self.function_type()
            if v == "typeof":
                self.step()
                if self.sees("import"):
                    return self.type_primary()
                self.name(True)
                while self.takes("."):
                    self.name(True)
                if self.sees("<") and not self.newline:
                    self.type_arguments()
                return None
            if v == "import":
                self.step()
                self.need("(")
                self.type()
                self.need(")")
                while self.takes("."):
                    self.name(True)
                if self.sees("<"):
                    self.type_arguments()
                return None
            if v in RESERVED and v not in ("this", "null", "true", "false", "void", "undefined"):
                self.fail()
            self.step()
            while self.takes("."):
                self.name(True)
            if self.kind == "p" and self.value in ("<", "<<") and not self.newline:
                self.type_arguments()
            return None
        if v == "-":
            self.step()
            if self.kind != "num":
                self.fail()
            self.step()
            return None
        if v == "`":
            return self.template_type()
        if v == "{":
            return self.object_type()
        if v == "[":
            self.step()
            while not self.sees("]"):
                self.takes("...")
                if self.kind == "id" and self.peek()[1] in (":", "?"):
                    here = self.mark()
                    self.step()
                    self.takes("?")
                    if not self.takes(":"):
                        self.back(here)
                self.type()
                self.takes("?")
                if not self.sees("]"):
                    self.need(",")
            self.step()
            return None
        if v == "<":
            return self.function_type()
        if v == "(":
            if self.tries(self.function_type):
                return None
            self.step()
            self.type()
            self.need(")")
            return None
        self.fail()
        return None

    def function_type(self) -> None:
        self.type_parameters()
        self.parameters()
        self.need("=>")
        self.type(True)

    def template_type(self) -> None:
        at = self.at + 1
        while True:
            m = LITERAL.match(self.s, at)
            at = m.end()
            if at >= self.n:
                raise Bad("unterminated literal", self.at)
            if self.s[at] == "`":
                return self.move(at + 1)
            self.move(at + 2)
            self.type()
            if not self.sees("}"):
                self.fail()
            at = self.end

    def object_type(self) -> None:
        self.need("{")
        if self.tries(self.mapped):
            return
        while not self.sees("}"):
            if self.kind == "eof":
                self.fail("unbalanced delimiters")
            self.type_member()
            if self.sees("}"):
                break
            if not self.takes(";", ",") and not self.newline:
                self.fail()
        self.step()

    def mapped(self) -> None:
        if self.takes("+", "-"):
            self.need("readonly")
        else:
            self.takes("readonly")
        self.need("[")
        self.name()
        self.need("in")
        self.type()
        if self.takes("as"):
            self.type()
        self.need("]")
        self.takes("+", "-")
        self.takes("?")
        self.annotation()
        self.takes(";")
        self.need("}")

    def type_member(self) -> None:
        if self.sees("(", "<"):
            return self.signature()
        if self.sees("new") and self.peek()[1] in ("(", "<"):
            self.step()
            return self.signature()
        while self.sees("readonly", "get", "set", "static") and (self.peek()[0] in ("id", "str", "num") or self.peek()[1] == "["):
            self.step()
        if self.sees("[") and self.tries(self.index_signature):
            return None
        self.property_name()
        self.takes("?")
        if self.sees("(", "<"):
            return self.signature()
        self.annotation()
        return None
