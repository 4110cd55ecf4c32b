"""Constants and references in Ruby source text: a lexer, a parser by recursive descent, and a walk over its tree. No code runs.

The lexer knows where a value may begin, so it tells literals from operators; of strings, word lists, regular expressions,
heredocs and commands it keeps the code in their `#{}`, as token lists of their own. The parser builds a tree of what closes with
`end`, a bracket or a brace, and refuses a file where these don't match.

A file gives its primary constant (the first class or module that isn't inside another) and its references. A reference
is a constant path as written, with the class and module names around it; the name of a class and a superclass that is a plain constant
lie in the scope outside the class. Constants that are assigned to, hash keys, and method calls that look like constants are no references. Implied
references come from association macros in class bodies and from strings that are turned into constants.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.paths import IRREGULAR

# Macros that imply a class, and blocks that leave their body a class body.
ASSOCIATIONS = frozenset(("belongs_to", "has_one", "has_many", "has_and_belongs_to_many"))
COLLECTIONS = frozenset(("has_many", "has_and_belongs_to_many"))
WRAPPERS = frozenset(("with_options", "included", "class_eval", "class_exec"))
# Words behind which an expression begins, and those behind which it also may.
EXPECTANT = frozenset(("then", "else", "elsif", "do", "begin", "ensure", "and", "or", "not", "when", "in", "if", "unless", "while", "until", "case", "return", "rescue", "yield", "puts", "p", "raise", "require", "class", "module", "def", "for"))
MODIFIABLE = frozenset(("return", "yield", "rescue", "puts", "p", "raise", "break", "next", "redo", "retry", "super"))
LOOPS = frozenset(("while", "until", "for"))
# Kinds of tokens that mean nothing by themselves, but for these texts.
DULL = frozenset(("word", "op", "number", "symbol", "global", "label"))
TELLING = ASSOCIATIONS | LOOPS | {"composed_of", "class", "module", "def", "begin", "case", "if", "unless", "do", "end", "and", "or", "not", "return", "=", "&&", "||", "!", *"()[]{}"}
CLOSER = {"(": ")", "[": "]", "{": "}", "<": ">"}

PLAIN = re.compile(
    r"""
    (?P<skip>[^\S\n]+|\\\r?\n|\#[^\n]*) | (?P<newline>[\n;])
    | (?P<label>[A-Za-z_]\w*[?!]?:(?!:)) | (?P<const>(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*) | (?P<global>\$(?:\w+|-\w|[^\s\w]))
    | (?P<word>@{0,2}[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:[?!](?![=~]|\w))?) | (?P<number>\d\w*(?:\.\d\w*)?)
    | (?P<op>\.\.\.?|&\.|&&=?|\|\|=?|<<=?|>>=?|\*\*=?|===?|=~|=>|!=|!~|<=>|<=|>=|->|::|[-+*/%&|^]=|[^\s\w])
    """,
    re.X,
)
#: Tokens that read alike behind any others: no labels, literals, names with a sign or a `:` behind them.
SIMPLE = re.compile(
    r"""([ \t]*)(?:([A-Z]\w*(?:::[A-Z]\w*)*(?![\w?!:\x80-\U0010ffff]))|(@{0,2}[a-z]\w*(?![\w?!:\x80-\U0010ffff]))|(\d\w*(?:\.\d\w*)?(?![.\w\x80-\U0010ffff]))|([\n;])|([(),\[\]]|\.(?!\.)|=(?![=~>b])|\|(?![|=]))|([{}]))""",
    re.A,
)
BLANKS = re.compile(r"[ \t]*").match
SIMPLE_KINDS = (None, None, "const", "word", "number", "newline", "op", "op")
HEREDOC = re.compile(r"<<([~-]?)(?:(['\"`])([^'\"`\n]+)\2|([A-Za-z_]\w*))")
PERCENT = re.compile(r"%([qQwWiIrxs]?)([^\w\s]|(?<=[qQwWiIrxs])[^\w\s])")
CHARACTER = re.compile(r"\?(?:\\(?:[MC]-.|u\{?\w+\}?|.)|[^\s\\])(?!\w)")
SYMBOL = re.compile(r":(?:[A-Za-z_]\w*[?!=]?(?![\w=>~])|[A-Za-z_]\w*[?!]?|\[\]=?|[-+]@|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[-+*/%<>&|^~`])")


#: Files whose references a task holds at once.
FILES = 256


class SyntaxProblem(ValueError):
    pass


class Token(NamedTuple):
    """text: of a string its value, None if code is in it. code: token lists of that code. spaced: whether white space stands before it."""

    kind: str
    text: str | None
    spaced: bool = False
    code: tuple = ()


@functools.cache
def _plain(opener: str, closer: str):
    """Matches what stands for itself in a literal."""
    return re.compile(rf"[^\\#{re.escape(opener)}{re.escape(closer)}]*").match


class Lexer:
    def __init__(self, source: str, at: int = 0):
        self.source, self.at, self.out, self.heredocs = source, at, [], []

    def ends_value(self) -> bool:
        """Whether an operator may follow what was read last."""
        if not self.out:
            return False
        kind, text = self.out[-1][:2]
        if kind == "word":
            return text not in EXPECTANT or len(self.out) > 1 and self.out[-2].text in (".", "&.", "def")
        return kind in ("const", "string", "symbol", "number", "global") or text in (")", "]", "}")

    def read(self, closer: str | None = None) -> list[Token]:
        """Tokens up to the end, or to the brace that closes an interpolation."""
        source, depth, spaced = self.source, 0, False
        simple, out, made = SIMPLE.match, self.out, tuple.__new__
        while self.at < len(source):
            # the end of a line that opened heredocs is left to what follows
            while (m := simple(source, self.at)) and (m.lastindex != 5 or not self.heredocs):
                k = m.lastindex
                if k == 7:
                    if closer and m[7] == "}" and not depth:
                        self.at = m.end()
                        return out
                    depth += 1 if m[7] == "{" else -1
                out.append(made(Token, (SIMPLE_KINDS[k], m[k], spaced or m[1] != "", ())))
                self.at, spaced = m.end(), False
            if (at := BLANKS(source, self.at).end()) > self.at:
                self.at, spaced = at, True
            if self.at >= len(source):
                break
            value, c = self.ends_value(), source[self.at]
            # behind a method's name with a blank before and none after it, these begin an argument
            argument = value and spaced and self.out[-1].kind == "word" and self.at + 1 < len(source) and source[self.at + 1] not in " \t\n="
            if closer and c == "}" and not depth:
                self.at += 1
                return self.out
            if c in "\"'`" and not (c == "`" and self.out and self.out[-1].text in ("def", ".")):
                self.literal(c, c, c != "'", spaced)
            elif c == "/" and (not value or argument):
                self.literal("/", "/", True, spaced, kind="regex")
            elif c == "%" and (not value or argument) and (m := PERCENT.match(source, self.at)):
                self.at = m.end() - 1
                self.literal(m[2], CLOSER.get(m[2], m[2]), m[1] not in ("q", "w", "i", "s"), spaced, kind={"w": "words", "W": "words", "i": "words", "I": "words", "r": "regex", "s": "symbol"}.get(m[1], "string"))
            elif c == "<" and (not value or argument) and not (self.out and self.out[-1].text == "class") and (m := HEREDOC.match(source, self.at)):
                self.heredocs.append((len(self.out), m[3] or m[4], m[1] != "", m[2] != "'"))
                self.out.append(Token("string", None, spaced))
                self.at = m.end()
            elif c == ":" and self.at + 1 < len(source) and source[self.at + 1] in "\"'" and not (value and not spaced):
                self.at += 1
                self.literal(source[self.at], source[self.at], source[self.at] == '"', spaced, kind="symbol")
            elif c == ":" and (m := SYMBOL.match(source, self.at)) and not source.startswith("::", self.at) and not (value and not spaced and m[0][1:2].isspace()):
                self.out.append(Token("symbol", m[0][1:], spaced))
                self.at = m.end()
            elif c == "?" and not value and (m := CHARACTER.match(source, self.at)):
                self.out.append(Token("string", m[0][1:], spaced))
                self.at = m.end()
            elif c == "=" and source.startswith("=begin", self.at) and (not self.at or source[self.at - 1] == "\n"):
                end = re.compile(r"^=end\b[^\n]*", re.M).search(source, self.at)
                self.at = end.end() if end else len(source)
            elif c == "_" and source.startswith("__END__", self.at) and re.compile(r"(?:\A|(?<=\n))__END__\r?(?:\n|\Z)").match(source, self.at):
                break
            else:
                m = PLAIN.match(source, self.at)
                kind, text = m.lastgroup, m[0]
                if kind == "label" and self.out and self.out[-1].text == "?" or kind == "label" and value and not spaced:
                    m = re.compile(r"(?P<const>[A-Z]\w*)|(?P<word>[a-z_]\w*[?!]?)").match(source, self.at)
                    kind, text = m.lastgroup, m[0]
                if kind == "const" and text.startswith("::") and value and not spaced:
                    kind, text, m = "op", "::", None  # a constant of what an expression gives
                    self.at += 2
                self.at = m.end() if m else self.at
                depth += (text == "{") - (text == "}")
                if kind == "skip":
                    spaced = True
                    continue
                self.out.append(Token(kind, text, spaced))
                if text == "\n":
                    self.bodies()
            spaced = False
        if closer or self.heredocs:
            raise SyntaxProblem("something isn't closed")
        return self.out

    def literal(self, opener: str, closer: str, code: bool, spaced: bool, kind: str = "string") -> None:
        """From its opening delimiter; delimiters that come in pairs may nest."""
        start, depth, inside = self.at + 1, 0, []
        plain = _plain(opener, closer)
        self.at += 1
        while True:
            self.at = plain(self.source, self.at).end()
            if self.at >= len(self.source):
                raise SyntaxProblem("a literal isn't closed")
            c = self.source[self.at]
            if c == "\\":
                self.at += 2
            elif code and c == "#" and self.source.startswith("#{", self.at):
                nested = Lexer(self.source, self.at + 2)
                inside.append(nested.read("}"))
                self.at = nested.at
            elif c == closer and not depth:
                break
            else:
                depth += (c == opener != closer) - (c == closer)
                self.at += 1
        text = None if inside or kind in ("regex", "words") else self.source[start : self.at]
        self.at += 1
        if kind == "regex":
            self.at = re.compile("[a-z]*").match(self.source, self.at).end()
        if kind == "string" and opener in "\"'" and self.source.startswith(":", self.at) and not self.source.startswith("::", self.at) and self.out and self.out[-1].text in ("{", "(", ",", "\n"):
            kind, self.at = "label", self.at + 1
            text = f"{text}:"
        self.out.append(Token("string" if kind in ("regex", "words") else kind, text, spaced, tuple(inside)))

    def bodies(self) -> None:
        """Of the heredocs that the line opened."""
        for place, tag, indented, code in self.heredocs:
            end = re.compile(rf"^{'[ \t]*' if indented else ''}{re.escape(tag)}\r?(?:\n|\Z)", re.M).search(self.source, self.at)
            if not end:
                raise SyntaxProblem("a heredoc isn't closed")
            inside, at = [], self.at
            while code and (at := self.source.find("#{", at, end.start())) >= 0:
                before = at
                while before and self.source[before - 1] == "\\":
                    before -= 1
                escaped = (at - before) % 2
                nested = Lexer(self.source, at + 2)
                if not escaped:
                    inside.append(nested.read("}"))
                at = at + 2 if escaped else nested.at
            text = self.source[self.at : end.start()]
            self.out[place] = Token("string", text if not inside and text.count("\n") == 1 else None, self.out[place].spaced, tuple(inside))
            self.at = end.end()
        self.heredocs = []


class Node:
    """kind: class, module, singleton, def, block, group, const, macro, string; name: what it is called; body: nodes inside it."""

    def __init__(self, kind: str, name: str | None = None, body: list[Node] | None = None, args: list[Token] | None = None):
        self.kind, self.name, self.body, self.args = kind, name, body if body is not None else [], args or []


END = Token("end", "")


class Parser:
    """Recursive descent over what opens and closes."""

    def __init__(self, tokens: list[Token]):
        self.t, self.i, self.head = tokens, 0, None
        self.seen, self.began = 0, 0  # a token, and where its line begins

    def look(self, ahead: int = 0) -> Token:
        return self.t[self.i + ahead] if 0 <= self.i + ahead < len(self.t) else END

    def file(self) -> Node:
        body = self.body(())
        if self.look() is not END:
            raise SyntaxProblem(f"unexpected {self.look().text}")
        return Node("file", None, body)

    def body(self, closers: tuple[str, ...]) -> list[Node]:
        """Nodes up to one of the closers, which stays unread."""
        out: list[Node] = []
        head, self.head = self.head, None
        t, n = self.t, len(self.t)
        while self.i < n:
            i = self.i
            token = t[i]
            kind, text, _, code = token
            # what opens, closes and tells nothing
            if kind == "newline":
                self.head, self.i = None, i + 1
                continue
            if not code and text not in TELLING and (kind in DULL or kind == "string" and (text is None or i + 1 == n or t[i + 1].text != ".")):
                if kind == "word" and (self.head is None or i and t[i - 1].text in (".", "&.") and (t[i - 2].text if i > 1 else "") in (self.head, ")", "]", "self")):
                    self.head = text
                self.i = i + 1
                continue
            before = self.look(-1)
            if token.kind == "op" and token.text in (")", "]", "}") or self.keyword() == "end":
                break
            if token.kind == "newline" or token.text in ("=", "&&", "||", "and", "or", "not", "!", "return"):
                self.head = None
            if token.kind == "word" and (word := self.keyword()):
                if word in LOOPS and self.opens(before):
                    self.i += 1
                    condition = self.until_loop_body()
                    out.append(Node("group", word, condition + self.closed("end")))
                    continue
                if (node := self.construct(word, before)) is not None:
                    out.append(node)
                    continue
            elif token.kind == "op" and token.text in "([{":
                out.append(self.bracket(token, before))
                continue
            elif token.kind == "const" and self.refers(before):
                out.append(Node("const", self.look().text))
            out += [Node("group", None, Parser(code).file().body) for code in token.code]
            if token.kind == "string" and token.text is not None and self.look(1).text == "." and self.look(2).text in ("constantize", "safe_constantize", "const_get"):
                out.append(Node("string", token.text, args=[self.look(2)]))
            self.call(token, before)
            if token.kind == "word" and (token.text in ASSOCIATIONS or token.text == "composed_of") and (before.text not in (".", "&.", "def", "::") or before.text == "." and self.look(-2).text == "self"):
                out.append(Node("macro", token.text, args=self.arguments()))
            self.i += 1
        self.head = head
        if closers and self.look().text not in closers:
            raise SyntaxProblem(f"missing {closers[0]}")
        return out

    def closed(self, closer: str) -> list[Node]:
        body = self.body((closer,))
        self.i += 1
        return body

    def keyword(self) -> str | None:
        """The word here, if it isn't a method's name or an argument's."""
        token, before = self.look(), self.look(-1)
        if token.kind != "word" or before.text in (".", "&.", "::") or before.kind == "word" and before.text in ("def", "alias", "undef"):
            return None
        return token.text

    def opens(self, before: Token) -> bool:
        """Whether a condition opens a block here: behind a value it only modifies that."""
        if before is END or before.kind == "newline":
            return True
        if before.kind == "word" and self.look(-2).text not in (".", "&.", "def"):
            return before.text in EXPECTANT and before.text not in MODIFIABLE
        return not (before.kind in ("const", "string", "symbol", "number", "global", "word") or before.text in (")", "]", "}"))

    def until_loop_body(self) -> list[Node]:
        """The condition of a loop, to its `do` or the end of its line."""
        start, depth = self.i, 0
        while (token := self.look()) is not END:
            depth += (token.kind == "op" and token.text in "([{") - (token.kind == "op" and token.text in ")]}")
            if not depth and (token.kind == "newline" or token.kind == "word" and token.text == "do"):
                break
            self.i += 1
        inner = Parser(self.t[start : self.i]).file().body
        self.i += 1
        return inner

    def construct(self, word: str, before: Token) -> Node | None:
        """What a keyword opens, to its `end`; None if it opens nothing."""
        if word in ("class", "module"):
            return self.declaration(word)
        if word == "def":
            return self.definition()
        if word in ("begin", "case") or word in ("if", "unless") and self.opens(before):
            self.i += 1
            return Node("group", word, self.closed("end"))
        if word == "do":
            name = self.head
            self.i += 1
            return Node("block", name, self.closed("end"))
        return None

    def declaration(self, kind: str) -> Node | None:
        if self.look(1).text == "<<" and kind == "class":
            self.i += 2
            return Node("singleton", None, self.closed("end"))
        if self.look(1).kind != "const":
            return None
        name, out = self.look(1).text, Node("group")
        out.body.append(Node("const", name))
        self.i += 2
        if kind == "class" and self.look().text == "<":
            start = self.i + 1
            while self.look() is not END and self.look().kind != "newline":
                self.i += 1
            parent = self.t[start : self.i]
            if len(parent) == 1 and parent[0].kind == "const":
                out.body.append(Node("const", parent[0].text))
            else:  # an expression, whose constants lie inside the class; a block in it may go on
                self.i = start
        out.body.append(Node(kind, name.removeprefix("::"), self.closed("end")))
        return out

    def definition(self) -> Node:
        """A method; without `end` if a `=` follows its name or arguments."""
        out = Node("def")
        self.i += 1
        if self.look(1).text == "." and self.look().kind in ("const", "word"):
            if self.look().kind == "const":
                out.body.append(Node("const", self.look().text))
            self.i += 2
        setter = self.look(1).text == "=" and not self.look(1).spaced and self.look(2).text == "("
        operator = self.look().kind == "op"
        self.i += 1
        while operator and self.look().kind == "op" and self.look().text != "(" and not self.look().spaced:
            self.i += 1
        if setter:
            self.i += 1
        if self.look().text == "(" and self.look().kind == "op":
            out.body.append(self.bracket(self.look(), END))
        if self.look().text == "=" and not setter:
            start = self.i + 1
            self.i = start
            depth = 0
            while self.look() is not END and not (depth <= 0 and (self.look().kind == "newline" and self.i > start or self.look().text in (")", "]", "}"))):
                depth += (self.look().kind == "op" and self.look().text in "([{") - (self.look().kind == "op" and self.look().text in ")]}")
                depth += self.keyword() in ("do", "begin", "case") or self.keyword() in ("if", "unless") and self.opens(self.look(-1))
                depth -= self.keyword() == "end"
                if depth < 0:
                    break
                self.i += 1
            out.body += Parser(self.t[start : self.i]).file().body
            return out
        out.body += self.closed("end")
        return out

    def bracket(self, token: Token, before: Token) -> Node:
        name = None
        if token.text == "{" and (before.kind in ("word", "const") and before.text not in EXPECTANT or before.text in (")", "->")):
            name = self.block_owner()
            kind = "block"
        else:
            kind = "group"
        self.i += 1
        return Node(kind, name, self.closed(CLOSER[token.text]))

    def block_owner(self) -> str | None:
        """The method right before a brace, or before the arguments that stand there."""
        k, depth = self.i - 1, 0
        while k >= 0:
            depth += (self.t[k].text == ")") - (self.t[k].text == "(")
            if not depth and self.t[k].text != "(":
                break
            k -= 1
            if not depth:
                break
        return self.t[k].text if k >= 0 and self.t[k].kind in ("word", "const") else None

    def call(self, token: Token, before: Token) -> None:
        """Keeps the name of the call that a `do` of this statement belongs to: the end of its first chain."""
        if token.kind not in ("word", "const"):
            return
        if self.head is None or before.text in (".", "&.") and self.look(-2).text in (self.head, ")", "]", "self"):
            self.head = token.text

    def refers(self, before: Token) -> bool:
        token, after = self.look(), self.look(1)
        if before.text in (".", "&.", "::") and before.kind == "op" or before.kind == "word" and before.text in ("def", "alias", "undef"):
            return False
        if after.text == "(" and not after.spaced and self.t[self.line()].text != "in":
            return self.qualifier(token)
        if after.spaced and after.kind in ("string", "number", "const", "global") or after.spaced and after.kind == "word" and after.text not in EXPECTANT | MODIFIABLE | {"end"}:
            return self.qualifier(token)  # a command with arguments
        if after.text in ("=", "||=", "&&=", "+=", "-=", "*=", "/=", "%=", "|=", "&=", "^=", "<<=", ">>=", "**=") and after.kind == "op":
            return self.qualifier(token)
        return not (after.text == "," and self.assigned(self.line()))

    def line(self) -> int:
        """Where the line here begins."""
        start = self.i
        while start and start != self.seen and self.t[start - 1].kind != "newline":
            start -= 1
        self.began = self.began if start == self.seen else start
        self.seen = self.i
        return self.began

    def qualifier(self, token: Token) -> bool:
        """Of A::B that is assigned to or called, A is a reference."""
        head, colons, _ = token.text.rpartition("::")
        if not head:
            return False
        self.t[self.i] = token._replace(text=head)
        return bool(colons)

    def assigned(self, start: int) -> bool:
        """Whether the line begins with names, commas and a `=`."""
        k = start
        while k < len(self.t) and (self.t[k].kind in ("const", "word", "global") or self.t[k].text in (",", "*")):
            k += 1
        return k < len(self.t) and self.t[k].text == "=" and self.i < k

    def arguments(self) -> list[Token]:
        """Tokens of the call here, to the end of its line, or further inside brackets and after commas."""
        out, depth = [], 0
        for k in range(self.i + 1, len(self.t)):
            token = self.t[k]
            if token.kind == "newline" and depth <= 0 and (not out or out[-1].text not in (",", "=>", "(")):
                break
            if token.kind == "word" and token.text == "do" and not depth:
                break
            depth += (token.kind == "op" and token.text in "([{") - (token.kind == "op" and token.text in ")]}")
            if depth < 0:
                break
            if token.kind != "newline":
                out.append(token)
        return out


def _camel(word: str) -> str:
    return "".join(p[:1].upper() + p[1:].lower() for p in word.split("_"))


def _singular(word: str) -> str:
    if word.lower() in IRREGULAR:
        return IRREGULAR[word.lower()]
    if re.search(r"(ses|xes|zes|ches|shes)$", word):
        return word[:-2]
    return word[:-3] + "y" if word.endswith("ies") else word.removesuffix("s")


def implied(macro: str, args: list[Token]) -> str | None:
    """The class that an association macro means."""
    if args and args[0].text == "(" and args[0].kind == "op":
        args = args[1:]
    options: dict[str, list[Token]] = {}
    for k, token in enumerate(args[:-1]):
        if token.kind == "label":
            options.setdefault((token.text or "")[:-1], args[k + 1 : k + 3])
        elif token.kind in ("symbol", "string") and token.text and args[k + 1].text == "=>":
            options.setdefault(token.text, args[k + 2 : k + 4])
    given = options.get("class_name")
    literal = given and given[0].kind == "string" and (len(given) < 2 or given[1].text in (",", ")"))
    explicit = given[0].text if literal else None
    if macro == "composed_of":
        return explicit
    if not args or args[0].kind != "symbol" or not args[0].text or given and not explicit:
        return None
    if macro == "belongs_to" and "polymorphic" in options and options["polymorphic"][0].text != "false":
        return None
    return explicit or _camel(_singular(args[0].text) if macro in COLLECTIONS else args[0].text)


class Found:
    """What a walk over the tree gathers."""

    def __init__(self, rails: bool):
        self.rails, self.primary = rails, None
        self.refs: set[tuple[tuple[str, ...], str, bool]] = set()

    def refer(self, names: tuple[str, ...], name: str, absolute: bool | None = None) -> None:
        self.refs.add((names, name.removeprefix("::"), name.startswith("::") if absolute is None else absolute))

    def walk(self, nodes: list[Node], names: tuple[str, ...] = (), body: bool = False) -> Found:
        """body: whether macros here are a class's own."""
        for node in nodes:
            if node.kind == "const":
                self.refer(names, node.name)
            elif node.kind in ("class", "module"):
                if not names and self.primary is None:
                    self.primary = node.name
                self.walk(node.body, (*names, node.name), True)
            elif node.kind == "macro":
                if self.rails and body and (name := implied(node.name, node.args)):
                    self.refer(names, name)
            elif node.kind == "string":
                if self.rails:
                    self.refer(names, node.name, None if node.args[0].text == "const_get" else True)
            else:
                self.walk(node.body, names, body and (node.kind in ("group", "singleton") or node.kind == "block" and node.name in WRAPPERS))
        return self


def extract(source: bytes | None, rails: bool = True) -> tuple[str | None, list[tuple[list[str], str, bool]], bool]:
    """(primary constant, references, whether the file could be read)."""
    try:
        tree = Parser(Lexer((source or b"").decode("utf-8").removeprefix("﻿")).read()).file()
    except (UnicodeDecodeError, SyntaxProblem, RecursionError):
        return None, [], False
    found = Found(rails).walk(tree.body)
    return found.primary, [(list(n), name, absolute) for n, name, absolute in sorted(found.refs)], True


def references(files: DataFrame, rails: bool = True) -> DataFrame:
    """files: repo_id, path, content. Rows repo_id, path, primary, namespace, name, absolute, parsed.

    A row for each reference of a file; of a file without any, or that can't be read, one with a null name.
    """
    found = pa.schema([("primary", pa.string()), ("namespace", pa.list_(pa.string())), ("name", pa.string()), ("absolute", pa.bool_()), ("parsed", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES):
                some = batch.slice(start, FILES)
                of, rows = [], []
                for k, content in enumerate(some.column("content")):
                    primary, refs, parsed = extract(content.as_py(), rails)
                    of += [k] * max(len(refs), 1)
                    rows += [(primary, namespace, name, absolute, parsed) for namespace, name, absolute in refs or [(None, None, None)]]
                held = some.select(["repo_id", "path"]).take(pa.array(of, pa.int64()))
                columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), found)]
                yield pa.RecordBatch.from_arrays([*held.columns, *columns], names=["repo_id", "path", *found.names])

    files = files.select("repo_id", "path", "content")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields[:2])
    return files.mapInArrow(read, f"{types}, primary string, namespace array<string>, name string, absolute boolean, parsed boolean")
