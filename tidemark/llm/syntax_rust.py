"""Rust: a lexer and a pushdown parser for items, types, patterns and expressions.

Tokens are cut first, with literals, lifetimes and nested comments; the parser then
reads items. Macros' arguments only have to balance, as the language has it.
"""

from __future__ import annotations

import re

from tidemark.llm.syntax_js import Bad

TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+|//[^\n]*)
    |(?P<comment>/\*)
    |(?P<raw>(?:br|cr|r)(?P<h>\#*)")
    |(?P<str>[bc]?"(?:[^"\\]|\\.)*")
    |(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:u\{[0-9a-fA-F_]{1,8}\}|x[0-9a-fA-F]{2}|.))')
    |(?P<life>'(?:r\#)?[^\W\d]\w*(?!'))
    |(?P<num>0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<p>\.\.\.|\.\.=|<<=|>>=|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<|>>|\.\.|[{}()\[\];,<>+\-*/%&|^!?:=.@\#$~])""",
    re.X | re.S,
)
CLOSE = {"(": ")", "[": "]", "{": "}"}
# Words of the language.
RESERVED = set("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())
PATH = {"self", "Self", "super", "crate"}
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "|": 4, "^": 5, "&": 6, "<<": 7, ">>": 7, "+": 8, "-": 8, "*": 9, "/": 9, "%": 9}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<=", ">>="}
ITEMS = {"fn", "struct", "enum", "impl", "trait", "mod", "use", "const", "static", "type", "extern", "pub", "unsafe", "async", "union", "macro_rules", "auto"}


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, place) of all tokens; raises Bad at a literal or comment that does not end."""
    out, at, n = [], 0, len(text)
    if text.startswith("#!") and not text.startswith("#!["):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = TOKEN.match(text, at)
        if not m:
            raise Bad("unterminated literal" if text[at] in "\"'" or text[at : at + 2] in ('b"', "b'") else "stray sign", at)
        kind = m.lastgroup if m.lastgroup != "h" else "raw"
        end = m.end()
        if kind == "comment":
            depth = 1
            for x in re.compile(r"/\*|\*/").finditer(text, end):
                depth += 1 if x.group() == "/*" else -1
                end = x.end()
                if not depth:
                    break
            if depth:
                raise Bad("unterminated comment", at)
        elif kind == "raw":
            close = '"' + m.group("h")
            end = text.find(close, end)
            if end < 0:
                raise Bad("unterminated literal", at)
            end += len(close)
            out.append(("str", "", at))
        elif kind != "space":
            if kind == "id" and m.group() in ("b", "c") and text[end : end + 1] == '"' or kind == "p" and m.group() == '"':
                raise Bad("unterminated literal", at)
            out.append((kind, m.group(), at))
        at = end
    return out


class Rust:
    """One source text; ``check`` raises Bad where it is not valid."""

    def __init__(self, text: str):
        self.t = tokens(text)
        self.t.append(("eof", "", len(text)))
        self.i = 0
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for k, (kind, v, at) in enumerate(self.t):
            if kind != "p":
                continue
            if v in CLOSE:
                stack.append((CLOSE[v], k))
            elif v in (")", "]", "}"):
                if not stack or stack[-1][0] != v:
                    raise Bad("unbalanced delimiters", at)
                self.match[stack.pop()[1]] = k
        if stack:
            raise Bad("unbalanced delimiters", self.t[stack[-1][1]][2])
        self.set()

    def set(self) -> None:
        self.kind, self.value, self.at = self.t[self.i]

    def step(self) -> str:
        value = self.value
        self.i += 1
        self.set()
        return value

    def fail(self) -> None:
        raise Bad("premature end" if self.kind == "eof" else "unexpected token", self.at)

    def sees(self, *values: str) -> bool:
        return self.value in values and self.kind in ("p", "id")

    def takes(self, *values: str) -> bool:
        if self.sees(*values):
            self.step()
            return True
        return False

    def need(self, value: str) -> None:
        if not self.takes(value):
            self.fail()

    def ahead(self, n: int = 1) -> tuple[str, str]:
        return self.t[min(self.i + n, len(self.t) - 1)][:2]

    def split(self, first: str) -> bool:
        """Take one sign of a token that starts with it, such as > of >>."""
        if self.kind == "p" and self.value[:1] == first:
            if len(self.value) == 1:
                self.step()
            else:
                self.t[self.i] = ("p", self.value[1:], self.at + 1)
                self.set()
            return True
        return False

    def name(self) -> None:
        if self.kind != "id" or self.value in RESERVED:
            self.fail()
        self.step()

    def tree(self) -> None:
        """A delimited token tree; its balance is known."""
        if self.i not in self.match:
            self.fail()
        self.i = self.match[self.i] + 1
        self.set()

    def check(self) -> None:
        while self.kind != "eof":
            self.item()

    def attributes(self) -> None:
        while self.sees("#"):
            self.step()
            self.takes("!")
            if not self.sees("["):
                self.fail()
            self.tree()

    def visibility(self) -> None:
        if self.takes("pub") and self.sees("(") and self.ahead()[1] in ("crate", "super", "self", "in"):
            self.tree()

    # items
    def item(self, member: bool = False) -> None:
        self.attributes()
        if self.kind == "eof" or member and self.sees("}"):
            return
        if not member and self.takes(";"):
            return
        self.visibility()
        v = self.value
        if member and v == "default" and self.ahead()[0] == "id":
            self.step()
            v = self.value
        if v == "use":
            self.step()
            self.takes("::")
            self.use_tree()
            self.need(";")
        elif v == "mod" or v == "unsafe" and self.ahead()[1] == "mod":
            self.takes("unsafe")
            self.step()
            self.name()
            if not self.takes(";"):
                self.items()
        elif v == "struct" or v == "union" and self.ahead()[0] == "id":
            self.step()
            self.name()
            self.generics()
            if self.sees("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.takes(";"):
                    self.fields()
        elif v == "enum":
            self.step()
            self.name()
            self.generics()
            self.where()
            self.need("{")
            while not self.sees("}"):
                self.attributes()
                self.visibility()
                self.name()
                if self.sees("("):
                    self.tuple_fields()
                elif self.sees("{"):
                    self.fields()
                if self.takes("="):
                    self.expression()
                if not self.sees("}"):
                    self.need(",")
            self.step()
        elif v == "impl" or v == "unsafe" and self.ahead()[1] == "impl":
            self.takes("unsafe")
            self.step()
            if self.sees("<"):
                self.generics()
            self.takes("const")
            self.takes("!")
            self.type()
            if self.takes("for"):
                self.type()
            self.where()
            self.members()
        elif v == "trait" or v in ("unsafe", "auto") and self.ahead()[1] in ("trait", "auto"):
            while self.takes("unsafe", "auto"):
                pass
            self.need("trait")
            self.name()
            self.generics()
            if self.takes(":"):
                self.bounds()
            self.where()
            if self.takes("="):
                self.bounds()
                self.need(";")
            else:
                self.members()
        elif v == "type":
            self.step()
            self.name()
            self.generics()
            if self.takes(":"):
                self.bounds()
            self.where()
            if self.takes("="):
                self.type()
                self.where()
            elif not member:
                self.fail()
            self.need(";")
        elif v == "static":
            self.step()
            self.takes("mut")
            self.name()
            self.need(":")
            self.type()
            if self.takes("="):
                self.expression()
            self.need(";")
        elif v == "const" and self.ahead()[1] not in ("fn", "unsafe", "async", "extern"):
            self.step()
            if not self.takes("_"):
                self.name()
            self.generics()
            self.need(":")
            self.type()
            if self.takes("="):
                self.expression()
            elif not member:
                self.fail()
            self.need(";")
        elif v == "extern" and self.ahead()[1] == "crate":
            self.step()
            self.step()
            if not self.takes("self"):
                self.name()
            if self.takes("as"):
                self.step()
            self.need(";")
        elif v in ("extern", "unsafe") and (self.ahead()[0] == "str" and self.ahead(2)[1] == "{" or self.ahead()[1] == "{" or self.ahead()[1] == "extern" and self.ahead(3)[1] == "{"):
            self.takes("unsafe")
            self.need("extern")
            if self.kind == "str":
                self.step()
            self.members()
        elif v in ("fn", "const", "async", "unsafe", "extern", "safe"):
            self.function()
        elif v == "macro_rules" and self.ahead()[1] == "!":
            self.step()
            self.step()
            self.name()
            brace = self.sees("{")
            self.tree()
            if not brace:
                self.need(";")
        elif self.kind == "id" and (v not in RESERVED or v in PATH) or v == "::":
            self.path(True)
            self.need("!")
            if self.kind == "id":
                self.name()
            brace = self.sees("{")
            self.tree()
            if not brace:
                self.need(";")
        else:
            self.fail()

    def items(self) -> None:
        self.need("{")
        while not self.sees("}"):
            self.item()
        self.step()

    def members(self) -> None:
        self.need("{")
        while not self.sees("}"):
            self.item(True)
        self.step()

    def use_tree(self) -> None:
        if self.takes("*"):
            return
        if self.takes("{"):
            while not self.sees("}"):
                self.takes("::")
                self.use_tree()
                if not self.sees("}"):
                    self.need(",")
            self.step()
            return
        if self.kind != "id" or self.value in RESERVED and self.value not in PATH:
            self.fail()
        self.step()
        if self.takes("::"):
            self.use_tree()
        elif self.takes("as"):
            if not self.takes("_"):
                self.name()

    def function(self) -> None:
        while self.takes("const", "async", "unsafe", "safe"):
            pass
        if self.takes("extern") and self.kind == "str":
            self.step()
        self.need("fn")
        self.name()
        self.generics()
        self.need("(")
        while not self.sees(")"):
            self.attributes()
            if self.takes("..."):
                continue
            if self.self_parameter():
                pass
            elif self.kind == "id" and self.ahead()[1] != ":" and self.value not in ("mut", "ref", "_") and self.ahead()[1] in ("<", "::", ",", ")"):
                self.pattern_or_type()
            else:
                self.pattern(False)
                self.need(":")
                if not self.takes("..."):
                    self.type()
            if not self.sees(")"):
                self.need(",")
        self.step()
        if self.takes("->"):
            self.type()
        self.where()
        if not self.takes(";"):
            self.block()

    def pattern_or_type(self) -> None:
        here = self.i
        try:
            self.pattern(False)
            self.need(":")
            self.type()
        except Bad:
            self.i = here
            self.set()
            raise

    def self_parameter(self) -> bool:
        here = self.i
        if self.takes("&"):
            if self.kind == "life":
                self.step()
        self.takes("mut")
        if self.takes("self"):
            if self.takes(":"):
                self.type()
            return True
        self.i = here
        self.set()
        return False

    def tuple_fields(self) -> None:
        self.need("(")
        while not self.sees(")"):
            self.attributes()
            self.visibility()
            self.type()
            if not self.sees(")"):
                self.need(",")
        self.step()

    def fields(self) -> None:
        self.need("{")
        while not self.sees("}"):
            self.attributes()
            self.visibility()
            self.name()
            self.need(":")
            self.type()
            if not self.sees("}"):
                self.need(",")
        self.step()

    def generics(self) -> None:
        if not self.sees("<"):
            return
        self.step()
        while not self.sees(">"):
            self.attributes()
            if self.kind == "life":
                self.step()
                if self.takes(":"):
                    self.bounds()
            elif self.takes("const"):
                self.name()
                self.need(":")
                self.type()
                if self.takes("="):
                    self.generic_value()
            else:
                self.name()
                if self.takes(":"):
                    self.bounds()
                if self.takes("="):
                    self.type()
            if self.kind == "p" and self.value[0] == ">":
                break
            self.need(",")
        if not self.split(">"):
            self.fail()

    def generic_value(self) -> None:
        if self.sees("{"):
            self.block()
        else:
            self.takes("-")
            if self.kind in ("num", "str", "char") or self.sees("true", "false"):
                self.step()
            else:
                self.fail()

    def bounds(self) -> None:
        while True:
            if self.kind == "life":
                self.step()
            elif self.sees("{", ",", ";", "=", ">", ")", "where"):
                return
            else:
                parens = self.takes("(")
                self.takes("?", "~")
                self.takes("const")
                if self.sees("for"):
                    self.step()
                    self.generics()
                self.type_path()
                if parens:
                    self.need(")")
            if not self.takes("+"):
                return

    def where(self) -> None:
        if not self.takes("where"):
            return
        while not self.sees("{", ";", "="):
            if self.kind == "life":
                self.step()
            else:
                if self.takes("for"):
                    self.generics()
                self.type()
            self.need(":")
            self.bounds()
            if not self.takes(","):
                return

    # types and paths
    def path(self, plain: bool = False) -> None:
        """A path as expressions have it: type arguments only after ::."""
        if self.sees("<"):
            self.qualified()
        else:
            self.takes("::")
            self.segment()
        while self.sees("::") and not plain or plain and self.sees("::"):
            self.step()
            if self.sees("<"):
                self.arguments()
            else:
                self.segment()

    def segment(self) -> None:
        if self.kind != "id" or self.value in RESERVED and self.value not in PATH:
            self.fail()
        self.step()

    def qualified(self) -> None:
        self.need("<")
        self.type()
        if self.takes("as"):
            self.type_path()
        if not self.split(">"):
            self.fail()

    def type_path(self) -> None:
        if self.sees("<"):
            self.qualified()
            if not self.sees("::"):
                self.fail()
        else:
            self.takes("::")
            self.segment()
            self.path_arguments()
        while self.takes("::"):
            if self.sees("<"):
                self.arguments()
            else:
                self.segment()
                self.path_arguments()

    def path_arguments(self) -> None:
        if self.kind == "p" and self.value in ("<", "<<"):
            self.arguments()
        elif self.sees("("):
            self.step()
            while not self.sees(")"):
                self.type()
                if not self.sees(")"):
                    self.need(",")
            self.step()
            if self.takes("->"):
                self.type(False)

    def arguments(self) -> None:
        if not self.split("<"):
            self.fail()
        while not (self.kind == "p" and self.value[0] == ">"):
            if self.kind == "life":
                self.step()
            elif self.kind in ("num", "str", "char") or self.sees("-", "{", "true", "false"):
                self.generic_value()
            elif self.kind == "id" and self.ahead()[1] in ("=", ":"):
                self.step()
                if self.step() == "=":
                    self.type()
                else:
                    self.bounds()
            else:
                self.type()
                if self.takes("="):
                    self.type()
                elif self.takes(":"):
                    self.bounds()
            if self.kind == "p" and self.value[0] == ">":
                break
            self.need(",")
        if not self.split(">"):
            self.fail()

    def type(self, plus: bool = True) -> None:
        v = self.value
        if self.kind == "p":
            if v in ("&", "&&"):
                self.step()
                if self.kind == "life":
                    self.step()
                self.takes("mut")
                return self.type(False)
            if v == "*":
                self.step()
                if not self.takes("const", "mut"):
                    self.fail()
                return self.type(False)
            if v == "(":
                self.step()
                while not self.sees(")"):
                    self.type()
                    if not self.sees(")"):
                        self.need(",")
                self.step()
                return None
            if v == "[":
                self.step()
                self.type()
                if self.takes(";"):
                    self.expression()
                self.need("]")
                return None
            if v == "!":
                self.step()
                return None
            if v in ("<", "<<", "::", "?"):
                if v == "?":
                    return self.bounds()
                return self.type_path()
            self.fail()
        if self.kind == "life":
            return self.bounds()
        if v == "_":
            self.step()
            return None
        if v in ("impl", "dyn"):
            self.step()
            return self.bounds()
        if v == "for":
            self.step()
            self.generics()
            return self.type(plus)
        if v in ("fn", "unsafe", "extern"):
            self.takes("unsafe")
            if self.takes("extern") and self.kind == "str":
                self.step()
            self.need("fn")
            self.need("(")
            while not self.sees(")"):
                self.attributes()
                if self.kind == "id" and self.ahead()[1] == ":":
                    self.step()
                    self.step()
                if not self.takes("..."):
                    self.type()
                if not self.sees(")"):
                    self.need(",")
            self.step()
            if self.takes("->"):
                self.type(False)
            return None
        self.type_path()
        if self.sees("!"):
            self.step()
            self.tree()
        if plus:
            while self.takes("+"):
                self.bounds()
        return None

    # patterns
    def pattern(self, alternatives: bool = True) -> None:
        if alternatives:
            self.takes("|")
        self.one_pattern()
        while alternatives and self.takes("|"):
            self.one_pattern()

    def one_pattern(self) -> None:
        v = self.value
        if self.kind in ("num", "str", "char") or v == "-":
            self.literal_pattern()
            if self.takes("..=", "..", "..."):
                if self.kind in ("num", "str", "char", "id") or self.sees("-"):
                    if self.sees("if"):
                        return
                    self.literal_pattern()
            return
        if self.kind == "p":
            if v in ("&", "&&"):
                self.step()
                self.takes("mut")
                return self.one_pattern()
            if v in ("(", "["):
                close = CLOSE[self.step()]
                while not self.sees(close):
                    self.attributes()
                    self.pattern()
                    if not self.sees(close):
                        self.need(",")
                self.step()
                return None
            if v in ("..", "..="):
                self.step()
                if self.kind in ("num", "char") or self.sees("-"):
                    self.literal_pattern()
                return None
            if v not in ("::", "<"):
                self.fail()
        if v in ("_", "true", "false"):
            self.step()
            return None
        if v == "box":
            self.step()
            return self.one_pattern()
        if v in ("ref", "mut"):
            self.takes("ref")
            self.takes("mut")
            self.name()
            if self.takes("@"):
                self.one_pattern()
            return None
        if v == "const":
            self.step()
            return self.block()
        self.path()
        if self.takes("@"):
            return self.one_pattern()
        if self.sees("!"):
            self.step()
            return self.tree()
        if self.takes("("):
            while not self.sees(")"):
                self.attributes()
                self.pattern()
                if not self.sees(")"):
                    self.need(",")
            self.step()
        elif self.takes("{"):
            while not self.sees("}"):
                self.attributes()
                if not self.takes(".."):
                    if (self.kind in ("id", "num")) and self.ahead()[1] == ":":
                        self.step()
                        self.step()
                        self.pattern()
                    else:
                        self.takes("box")
                        self.takes("ref")
                        self.takes("mut")
                        self.name()
                if not self.sees("}"):
                    self.need(",")
            self.step()
        elif self.takes("..=", "..", "..."):
            if self.kind in ("num", "char") or self.sees("-") or self.kind == "id" and self.value not in RESERVED:
                self.literal_pattern()
        return None

    def literal_pattern(self) -> None:
        self.takes("-")
        if self.kind in ("num", "str", "char"):
            self.step()
        elif self.kind == "id":
            self.path()
        else:
            self.fail()

    # expressions
    def block(self) -> None:
        self.need("{")
        while not self.sees("}"):
            self.statement()
        self.step()

    def statement(self) -> None:
        if self.takes(";"):
            return
        self.attributes()
        v = self.value
        if v == "let":
            self.step()
            self.pattern()
            if self.takes(":"):
                self.type()
            if self.takes("="):
                self.expression()
                if self.takes("else"):
                    self.block()
            self.need(";")
            return
        if self.kind == "id" and v in ITEMS:
            n = self.ahead()
            item = v not in ("unsafe", "const", "async", "union", "auto", "macro_rules") or v in ("unsafe", "const", "async") and n[1] not in ("{", "move", "|", "||") or v in ("union", "auto") and n[0] == "id" and n[1] not in RESERVED | {"as"} or v == "macro_rules" and n[1] == "!"
            if v == "extern" or item:
                return self.item()
        blocky = self.sees("{", "if", "match", "while", "loop", "for", "unsafe") or self.kind == "life" or self.sees("async", "const") and self.ahead()[1] == "{"
        if blocky:
            self.block_like()
            if self.sees(".", "?"):
                self.tail(False)
                self.rest(0, False)
            if not self.sees("}"):
                self.takes(";")
            return
        start = self.i
        self.expression()
        if self.takes(";") or self.sees("}"):
            return
        if self.t[self.i - 1][1] == "}" and self.t[start][0] == "id" and self.ended_macro:
            return
        self.fail()

    ended_macro = False

    def block_like(self) -> None:
        if self.kind == "life":
            self.step()
            self.need(":")
        v = self.value
        if v == "{":
            return self.block()
        self.step()
        if v == "if":
            self.condition()
            self.block()
            if self.takes("else"):
                if self.sees("if"):
                    return self.block_like()
                return self.block()
            return None
        if v == "match":
            self.expression(False)
            self.need("{")
            while not self.sees("}"):
                self.attributes()
                self.pattern()
                if self.takes("if"):
                    self.condition(True)
                self.need("=>")
                block = self.sees("{")
                end = self.match.get(self.i, -1) if block else -1
                self.expression()
                if not self.takes(",") and not self.sees("}") and not (block and self.i == end + 1) and self.t[self.i - 1][1] != "}":
                    self.fail()
            self.step()
            return None
        if v == "while":
            self.condition()
            return self.block()
        if v == "for":
            self.pattern()
            self.need("in")
            self.expression(False)
            return self.block()
        if v in ("loop", "unsafe", "const"):
            return self.block()
        if v == "async":
            self.takes("move")
            return self.block()
        self.fail()
        return None

    def condition(self, structs: bool = False) -> None:
        self.expression(structs)

    def expression(self, structs: bool = True) -> None:
        v = self.value
        if self.kind == "id" and v in ("return", "break", "continue", "yield") and not (v == "yield" and self.ahead()[1] in (")", ",", ".", ";", "=")):
            self.step()
            if v in ("break", "continue") and self.kind == "life":
                self.step()
            if v != "continue" and not self.sees(";", ")", "]", "}", ",", "=>", "else") and self.kind != "eof" and (structs or not self.sees("{")):
                self.expression(structs)
            return
        if self.sees("|", "||", "move", "static") or self.sees("async") and self.ahead()[1] in ("|", "||", "move") and (self.ahead()[1] != "move" or self.ahead(2)[1] in ("|", "||")):
            return self.closure(structs)
        if self.takes("..", "..="):
            if self.operand():
                self.binary(0, structs)
            return None
        self.binary(0, structs)
        if self.takes("..", "..="):
            if self.operand() and (structs or not self.sees("{")):
                self.binary(0, structs)
        if self.kind == "p" and self.value in ASSIGN:
            self.step()
            self.expression(structs)
        return None

    def operand(self) -> bool:
        if self.kind in ("num", "str", "char", "life"):
            return True
        if self.kind == "id":
            return self.value not in RESERVED - PATH - {"true", "false", "if", "match", "unsafe", "move", "loop"}
        return self.kind == "p" and self.value in ("(", "[", "{", "&", "&&", "*", "-", "!", "<", "::", "|", "||")

    def closure(self, structs: bool) -> None:
        self.takes("static")
        self.takes("async")
        self.takes("move")
        if not self.takes("||"):
            self.need("|")
            while not self.sees("|"):
                self.attributes()
                self.pattern(False)
                if self.takes(":"):
                    self.type()
                if not self.sees("|"):
                    self.need(",")
            self.step()
        if self.takes("->"):
            self.type()
            return self.block()
        return self.expression(structs)

    def binary(self, least: int, structs: bool) -> None:
        self.unary(structs)
        self.rest(least, structs)

    def rest(self, least: int, structs: bool) -> None:
        while True:
            if self.sees("as"):
                self.step()
                self.type(False)
                continue
            power = BINARY.get(self.value, 0) if self.kind == "p" else 0
            if not power or power <= least:
                return
            self.step()
            if self.sees("|", "||", "move", "return", "break"):
                self.expression(structs)
            else:
                self.binary(power, structs)

    def unary(self, structs: bool) -> None:
        if self.kind == "p" and self.value in ("-", "!", "*"):
            self.step()
            return self.unary(structs)
        if self.kind == "p" and self.value in ("&", "&&"):
            self.step()
            if self.sees("raw") and self.ahead()[1] in ("const", "mut"):
                self.step()
                self.takes("const")
            self.takes("mut")
            return self.unary(structs)
        if self.sees("let"):
            self.step()
            self.pattern()
            self.need("=")
            return self.binary(2, structs)
        self.primary(structs)
        return self.tail(structs)

    def tail(self, structs: bool) -> None:
        while True:
            if self.takes("?"):
                continue
            if self.takes("."):
                if self.kind == "num":
                    self.step()
                elif self.takes("await"):
                    pass
                else:
                    self.name()
                    if self.takes("::"):
                        self.arguments()
                        if not self.sees("("):
                            self.fail()
            elif self.sees("("):
                self.list(")")
            elif self.sees("["):
                self.step()
                self.expression()
                self.need("]")
            else:
                return
            self.ended_macro = False

    def list(self, close: str) -> None:
        self.step()
        while not self.sees(close):
            self.attributes()
            self.expression()
            if not self.sees(close):
                self.need(",")
        self.step()

    def primary(self, structs: bool) -> None:
        kind, v = self.kind, self.value
        self.ended_macro = False
        if kind in ("num", "str", "char"):
            self.step()
            return None
        if kind == "life":
            return self.block_like()
        if kind == "p":
            if v == "(":
                return self.list(")")
            if v == "[":
                self.step()
                if not self.sees("]"):
                    self.expression()
                    if self.takes(";"):
                        self.expression()
                    else:
                        while self.takes(",") and not self.sees("]"):
                            self.expression()
                self.need("]")
                return None
            if v == "{":
                return self.block()
            if v == "#":
                self.attributes()
                return self.primary(structs)
            if v == "<<":
                self.fail()
            if v not in ("<", "::"):
                self.fail()
        if v in ("if", "match", "while", "loop", "for", "unsafe") or v in ("async", "const") and self.ahead()[1] in ("{", "move"):
            return self.block_like()
        if v in ("true", "false"):
            self.step()
            return None
        if v in ("|", "||", "move", "return", "break", "continue"):
            return self.expression(structs)
        if kind == "eof" or v in RESERVED and v not in PATH:
            self.fail()
        self.path()
        if self.sees("!") and self.ahead()[1] in CLOSE:
            self.step()
            brace = self.sees("{")
            self.tree()
            self.ended_macro = brace
            return None
        if structs and self.sees("{") and self.struct_follows():
            self.step()
            while not self.sees("}"):
                self.attributes()
                if self.takes(".."):
                    if not self.sees("}"):
                        self.expression()
                else:
                    if self.kind == "num":
                        self.step()
                    else:
                        self.name()
                    if self.takes(":"):
                        self.expression()
                if not self.sees("}"):
                    self.need(",")
            self.step()
        return None

    def struct_follows(self) -> bool:
        return True
