"""Python: a lexer with a pushdown stack of delimiters, formatted strings and indented blocks.

The lexer cuts a text into logical lines. The stack tells unterminated literals,
unbalanced delimiters and merge-conflict markers; the blocks tell lines indented
without a reason, headers without their colon or their block and ``try`` without its
handler; and a statement in which two operands follow each other, or that ends in an
operator, is broken off. What none of it tells is left to the interpreter's grammar.
"""

from __future__ import annotations

import re

from tidemark.llm.syntax_js import Bad

MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)")
PLAIN = re.compile(r"""(?P<skip>[^\S\n]+|\#[^\n]*|\\\r?\n)|(?P<name>[^\W\d]\w*)|(?P<num>(?:\d|\.\d)(?:[eE][+-]|[\w.])*)|(?P<op>->|:=|\*\*=?|//=?|>>=?|<<=?|[-+*/%@&|^=<>!]=|\.\.\.|[^\w\s"'()\[\]{}\#])""")
QUOTE = re.compile(r"""(?i)(?P<prefix>[rubf]|br|rb|fr|rf)?(?P<quote>\"{3}|'{3}|"|')""")
BODY = {q: re.compile(rf"(?:[^\\{q[0]}{'' if len(q) == 3 else chr(92) + 'n'}]|\\.{'|' + q[0] + '(?!' + q[0] * 2 + ')' if len(q) == 3 else ''})*", re.S) for q in ('"', "'", '"""', "'''")}
PAIRS = {"(": ")", "[": "]", "{": "}"}
# Words of the language.
KEYWORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
VALUES = {"False", "None", "True"}
HEADERS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class"}
#: What a block's header may follow at its level: the headers of the statement before.
FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}
OPERATORS = {"+", "-", "/", "//", "%", "@", "&", "|", "^", "<<", ">>", "==", "!=", "<=", ">=", "<", ">", ".", "=", ":=", "->", "+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**=", "and", "or", "not", "in", "is", "lambda", "as", "!"}


class Python:
    """One source text; ``check`` raises Bad where the stack finds a fault."""

    def __init__(self, text: str):
        self.s, self.n = text, len(text)
        self.stack: list[tuple[str, int]] = []  # a closing delimiter, or the quote of an open formatted string
        # levels: indentation, the header of the last statement, whether it is a try that waits for its handler
        self.levels: list[list] = [[0, "", False]]
        self.wants_block = False
        self.line: list[tuple[str, str, int]] = []  # kind, value and place of the tokens outside formatted strings
        self.column = 0

    def check(self) -> None:
        s, n = self.s, self.n
        if "\0" in s:
            raise Bad("stray sign", s.index("\0"))
        at, fresh = 0, True
        while at < n:
            if self.stack and self.stack[-1][0][0] in "\"'":
                at = self.formatted(at)
                continue
            if fresh:
                if MARKER.match(s, at):
                    raise Bad("merge conflict", at)
                fresh = False
                if not self.line and not self.stack:
                    self.column = 0
                    while at < n and s[at] in " \t\f":
                        self.column = 0 if s[at] == "\f" else self.column // 8 * 8 + 8 if s[at] == "\t" else self.column + 1
                        at += 1
                    continue
            c = s[at]
            if c == "\n":
                at, fresh = at + 1, True
                if not self.stack:
                    self.end_line()
                continue
            if c == "\r":
                at += 1
                if not s.startswith("\n", at):
                    fresh = True
                    if not self.stack:
                        self.end_line()
                continue
            inside = len(self.stack) > 1 and self.stack[-1][0] == "}" and self.stack[-2][0][0] in "\"'"
            if inside and c == ":":
                self.stack.append((self.stack[-2][0].rstrip(":") + ":", self.stack[-2][1]))
                at += 1
                continue
            m = QUOTE.match(s, at)
            if m:
                quote = m.group("quote")
                self.token("str", m.group(), at)
                if "f" in (m.group("prefix") or "").lower():
                    self.stack.append((quote, at))
                    at = m.end()
                    continue
                end = BODY[quote].match(s, m.end()).end()
                if not s.startswith(quote, end):
                    raise Bad("unterminated literal", at)
                at = end + len(quote)
            elif c in PAIRS:
                self.token("open", c, at)
                self.stack.append((PAIRS[c], at))
                at += 1
            elif c in ")]}":
                if not self.stack or self.stack[-1][0] != c:
                    raise Bad("unbalanced delimiters", at)
                self.stack.pop()
                if not (inside and c == "}"):
                    self.token("close", c, at)
                at += 1
            else:
                m = PLAIN.match(s, at)
                if m is None:
                    raise Bad("stray sign", at)
                if m.lastgroup != "skip" and not (inside and m.group() in ("!", "=")):
                    self.token(m.lastgroup, m.group(), at)
                at = m.end()
        if self.stack:
            raise Bad("unterminated literal" if self.stack[-1][0][0] in "\"'" else "unbalanced delimiters", self.stack[-1][1])
        self.end_line()
        if self.wants_block:
            raise Bad("premature end", n)
        self.dedent(0, n)
        if self.levels[0][2]:
            raise Bad("premature end", n)

    def formatted(self, at: int) -> int:
        """Read formatted text, or a field's specification (a quote and a colon on the stack), up to its end or its next field."""
        s, quote, opened = self.s, *self.stack[-1]
        specification = quote[-1] == ":"
        while at < self.n:
            c = s[at]
            if specification and c == "}":
                self.stack.pop()
                return at
            if not specification and s.startswith(quote, at):
                self.stack.pop()
                return at + len(quote)
            if c in "{}" and s[at : at + 2] == c * 2 and not specification:
                at += 2
            elif c == "{":
                self.stack.append(("}", at))
                return at + 1
            elif c == "\n" and len(quote.rstrip(":")) == 1:
                raise Bad("unterminated literal", opened)
            else:
                at += 2 if c == "\\" and s[at + 1 : at + 2] not in ("{", "}") else 1
        return at

    def token(self, kind: str, value: str, at: int) -> None:
        if self.stack and any(q[0][0] in "\"'" for q in self.stack):  # a field of a formatted string
            return
        if kind == "name" and value in KEYWORDS:
            kind = "value" if value in VALUES else "key"
        if self.line:
            before, last, _ = self.line[-1]
            done = before in ("name", "num", "str", "value", "close")
            if done and kind in ("name", "num", "str", "value") and not (before == kind == "str"):
                soft = len(self.line) == 1 and last in ("match", "case", "type")
                if not soft:
                    raise Bad("unexpected token", at)
            if kind == "close" and last in OPERATORS and last != "/" and before in ("op", "key"):
                raise Bad("unexpected token", at)
        self.line.append((kind, value, at))

    def end_line(self) -> None:
        """A logical line is complete: its place among the blocks, its header and its end."""
        line, self.line = self.line, []
        if not line:
            return
        at = line[0][2]
        if self.wants_block:
            if self.column <= self.levels[-1][0]:
                raise Bad("premature end", at)
            self.levels.append([self.column, "", False])
            self.wants_block = False
        elif self.column > self.levels[-1][0]:
            raise Bad("unexpected indent", at)
        else:
            self.dedent(self.column, at)
            if self.levels[-1][0] != self.column:
                raise Bad("unexpected indent", at)
        level = self.levels[-1]
        word = line[1][1] if line[0][1] == "async" and len(line) > 1 else line[0][1]
        word = word if line[0][0] == "key" else ""
        if word in FOLLOWS and level[1] not in FOLLOWS[word]:
            raise Bad("unexpected token", at)
        if level[2] and word not in ("except", "finally"):
            raise Bad("premature end", at)
        level[2] = word == "try"
        # a decorated or plain statement ends the chain of an if or a try
        level[1] = word if word in HEADERS else ""
        kind, value, last = line[-1]
        if kind in ("op", "key") and value in OPERATORS:
            raise Bad("premature end", last)
        if line[0][1] != "case":
            depth, open_ifs = 0, 0
            for i, (kind, value, _) in enumerate(line):
                depth += (kind == "open") - (kind == "close")
                if i and depth == 0 and kind == "key" and value in ("if", "else"):
                    open_ifs += 1 if value == "if" else -1
            if open_ifs > 0:
                raise Bad("premature end", last)
            kind, value, last = line[-1]
        if word in HEADERS:
            depth, lambdas, colon = 0, 0, False
            for i, (kind, value, _) in enumerate(line):
                depth += (kind == "open") - (kind == "close")
                if depth == 0 and kind == "key" and value == "lambda":
                    lambdas += 1
                elif depth == 0 and value == ":" and kind == "op":
                    if not lambdas:
                        colon = True
                        self.wants_block = i == len(line) - 1
                        break
                    lambdas -= 1
            if not colon:
                raise Bad("premature end", last)
        elif value == ":" and kind == "op" and line[0][1] in ("match", "case"):
            self.wants_block = True

    def dedent(self, column: int, at: int) -> None:
        while self.levels[-1][0] > column:
            if self.levels.pop()[2]:
                raise Bad("premature end", at)
