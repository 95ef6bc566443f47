"""Definitions in brace languages, by a tolerant scanner.

Comments and the insides of strings are blanked in place, so positions stay. The text is then read as statements: a head up
to a semicolon, a comma (in lists of members), a line end (where the language has it) or a brace, and the block in the
braces. Rules per language, in order, say which heads define what and how their block is read. It is no parser: macros,
preprocessor branches and exotic declarators are beyond it. Broken code gives what can be made out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Symbol:
    """A definition: lines from 1, columns from 0, in bytes; sel is where the name stands."""

    name: str
    name_path: str
    kind: str
    start_line: int
    start_col: int
    end_line: int
    end_col: int
    sel_line: int
    sel_col: int


@dataclass(frozen=True)
class Call:
    name: str
    line: int
    col: int


@dataclass
class Block:
    """How a block is read: its role, what separates its statements, and which rules hold."""

    role: str
    commas: bool = False


@dataclass
class Rule:
    """A head that matches defines group n as kind; member is the kind inside a type. block: how what follows is read."""

    head: re.Pattern
    kind: str
    member: str | None = None
    block: Block | None = None
    roles: frozenset[str] = frozenset()
    scope: bool = True
    check: Callable[[str, bool], bool] | None = None


@dataclass
class Language:
    rules: list[Rule]
    prefix: re.Pattern
    nested: bool = False  # comments nest
    quotes: str = "\"'"
    lines: bool = False  # a line end ends a statement
    hash_comments: bool = False
    extra: list[str] = field(default_factory=list)


CHAR = re.compile(r"'(?:\\[^\n]{1,9}?|[^'\\\n])'")


def blanked(src: str, lang: Language) -> str:
    """src with comments and strings as spaces; quotes, line ends and length are kept."""
    out, i, n = [], 0, len(src)
    space = lambda s: re.sub(r"[^\n]", " ", s)
    while i < n:
        c, two = src[i], src[i : i + 2]
        j = None
        if two == "//" or c == "#" and lang.hash_comments and two != "#[":
            j = src.find("\n", i)
            j = n if j < 0 else j
        elif two == "/*":
            depth, j = 1, i + 2
            while j < n and depth:
                if src.startswith("*/", j):
                    depth, j = depth - 1, j + 2
                elif lang.nested and src.startswith("/*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
        elif src.startswith('"""', i):
            j = src.find('"""', i + 3)
            j = n if j < 0 else j + 3
        elif c == "'" and "'" not in lang.quotes:
            m = CHAR.match(src, i)
            j = m.end() if m else i + 1
        elif c in lang.quotes:
            j = i + 1
            while j < n and src[j] != c and (src[j] != "\n" or c == "`"):
                j += 2 if src[j] == "\\" else 1
            j = min(n, j + 1)
        if j is None:
            out.append(c)
            i += 1
        else:
            out.append(space(src[i:j]))
            i = j
    return "".join(out)


def pairs(code: str) -> dict[int, int]:
    """Closing place of each opening brace, bracket and parenthesis; what stays open ends with the text."""
    at, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for m in re.finditer(r"[(){}\[\]]", code):
        c = m[0]
        if c in "({[":
            stack.append((c, m.start()))
        else:
            while stack and stack[-1][0] != close[c]:
                if c != "}":  # a stray parenthesis doesn't close a brace
                    break
                at[stack.pop()[1]] = m.start()
            if stack and stack[-1][0] == close[c]:
                at[stack.pop()[1]] = m.start()
    for _, i in stack:
        at[i] = len(code)
    return at


def statements(code: str, lo: int, hi: int, at: dict[int, int], lang: Language, commas: bool) -> Iterator[tuple[int, int, int | None, int | None, int]]:
    """(head begin, head end, block begin, block end, end) of each statement in code[lo:hi]."""
    head = i = lo
    while i < hi:
        c = code[i]
        if c in "([":
            i = min(hi, at.get(i, hi)) + 1
        elif c == "{":
            end = min(hi, at.get(i, hi))
            yield head, i, i + 1, end, min(hi, end + 1)
            head = i = end + 1
        elif c == ";" or c == "," and commas:
            yield head, i, None, None, i
            head = i = i + 1
        elif c == "\n" and lang.lines and code[head:i].strip():
            rest = code[i:hi].lstrip()
            if rest[:1] in "{.?:=&|+" and rest[:2] != "..":
                i += 1
            else:
                yield head, i, None, None, i
                head = i = i + 1
        else:
            i += 1
    if head < hi and code[head:hi].strip():
        yield head, hi, None, None, hi


WORD = r"[A-Za-z_$][\w$]*"
TYPE, LIST, BODY = Block("type"), Block("list", True), Block("body")


def r(head: str, kind: str, member: str | None = None, block: Block | None = None, roles: str = "", scope: bool = True, check=None) -> Rule:
    return Rule(re.compile(head.replace("@N", f"(?P<n>{WORD})"), re.S), kind, member, block, frozenset(roles.split()), scope, check)


NOT_HEADS = re.compile(r"^(?:if|for|while|switch|catch|return|else|do|try|new|throw|case|default|using|import|package|goto|delete|yield|await|assert|lock|foreach|when|with|in|is|as|match|loop|unsafe|guard|defer|repeat|super|this|synchronized)\b")
callable_head = lambda head, block: not NOT_HEADS.match(head) and "=" not in head.split("(")[0]
with_block = lambda head, block: block and callable_head(head, block)
plain = lambda head, block: not NOT_HEADS.match(head) and "(" not in re.split(r"[={]", head)[0]
MODS = r"(?:(?:export|default|declare|public|private|protected|internal|static|final|abstract|async|readonly|override|virtual|sealed|partial|extern|unsafe|new|synchronized|native|transient|volatile|strictfp|open|data|inner|inline|suspend|operator|infix|tailrec|lateinit|const|external|expect|actual|companion|value|fileprivate|mutating|nonmutating|lazy|weak|unowned|dynamic|indirect|required|convenience|prefix|postfix|var|accessor|file|ref|default|non-sealed)\s+)*?"
# Rust
PUB = r"^(?:pub(?:\s*\([^)]*\))?\s+)?"
RUST = Language(
    [
        r(PUB + r"(?:(?:default|const|async|unsafe|extern(?:\s+\"\s*\")?)\s+)*fn\s+@N", "Function", "Method", BODY, scope=False),
        r(PUB + r"(?:struct|union)\s+@N", "Struct", block=LIST), r(PUB + r"enum\s+@N", "Enum", block=Block("enum", True)),
        r(PUB + r"(?:unsafe\s+)?(?:auto\s+)?trait\s+@N", "Trait", block=TYPE), r(PUB + r"mod\s+@N", "Module", block=Block("top")),
        r(r"^(?:unsafe\s+)?impl\b.*", "#impl", block=TYPE), r(PUB + r"(?:const|static(?:\s+mut)?)\s+@N\s*:", "Const"), r(PUB + r"type\s+@N", "TypeAlias"),
        r(r"^macro_rules!\s*@N", "Macro"), r(PUB + r"@N\s*:(?!:)", "Field", roles="list"), r(r"^@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|#!?\[[^\]]*\])+"), nested=True, quotes='"',
)
MEMBER = r"(?:(?:public|private|protected|static|readonly|abstract|override|declare|async|get|set|accessor)\s+)*[*#]?\s*"
TS = Language(
    [
        r(rf"^{MODS}function\s*\*?\s*@N", "Function", block=BODY, scope=False), r(rf"^{MODS}class\s+@N", "Class", block=TYPE), r(rf"^{MODS}interface\s+@N", "Interface", block=Block("interface", True)),
        r(rf"^{MODS}(?:namespace|module)\s+@N", "Module", block=Block("top")), r(rf"^{MODS}enum\s+@N", "Enum", block=Block("enum", True)), r(rf"^{MODS}type\s+@N\s*(?:<[^=]*>)?\s*=", "TypeAlias"),
        r(rf"^(?:export\s+)?(?:declare\s+)?(?:const|let|var)\s+@N\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=]*)?=>|{WORD}\s*=>)", "Function", block=BODY, roles="top body", scope=False),
        r(rf"^{MEMBER}@N\s*\??\s*(?:<[^(]*>)?\(", "Method", block=BODY, roles="type interface", scope=False, check=callable_head),
        r(rf"^{MEMBER}@N\s*[?!]?\s*(?:[:=]|$)", "Field", roles="type interface", check=lambda h, b: not NOT_HEADS.match(h)), r(r"^@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|@[\w.]+(?:\([^)]*\))?)+"), quotes="\"'`", lines=True,
)
GO = Language(
    [
        r(r"^func\s*\(\s*(?:\w+\s+)?\*?\s*(?P<scope>[\w.]+(?:\[[^\]]*\])?)\s*\)\s*@N", "Method"), r(r"^func\s+@N", "Function"),
        r(r"^type\s+@N(?:\[[^\]]*\])?\s+struct\b", "Struct"), r(r"^type\s+@N(?:\[[^\]]*\])?\s+interface\b", "Interface"), r(r"^type\s+@N\b(?!\s*\()", "TypeAlias"), r(r"^const\s+@N", "Const"),
    ],
    re.compile(r"^\s+"), quotes='"`', lines=True,
)
JAVA = Language(
    [
        r(rf"^{MODS}(?:class|record)\s+@N", "Class", block=TYPE), r(rf"^{MODS}@?interface\s+@N", "Interface", block=TYPE), r(rf"^{MODS}enum\s+@N", "Enum", block=Block("enum", True)),
        r(r"^[^=(]*?@N\s*\(", "Method", roles="type", check=callable_head), r(rf"^{MODS}[\w.<>\[\], ?]+?\s+@N\s*(?:\[\s*\]\s*)*(?:=|,|$)", "Field", roles="type", check=plain), r(r"^@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|@(?!interface)[\w.]+(?:\([^)]*\))?)+"), quotes='"',
)
C_ENUM = r(r"^(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?@N", "Enum", block=Block("enum", True))
C = Language(
    [
        r(r"^(?:inline\s+)?namespace\s+@N", "Module", block=Block("top")), r(r"^extern\s+\"\s*\"\s*$", "#open", block=Block("top")),
        r(r"^(?:typedef\s+)?(?:template\s*<[^{]*>\s*)?class\s+(?:\w+\([^)]*\)\s*)?@N(?![^{]*\()", "Class", block=TYPE, check=lambda h, b: b), r(r"^(?:typedef\s+)?(?:template\s*<[^{]*>\s*)?(?:struct|union)\s+@N(?![^{]*\()", "Struct", block=TYPE, check=lambda h, b: b),
        C_ENUM, r(r"^(?:typedef\s+)?enum\b[^\w(]*$", "#open", block=Block("enum", True)), r(r"^typedef\b.*?@N\s*(?:\[[^\]]*\]\s*)*$", "TypeAlias"), r(r"^using\s+@N\s*=", "TypeAlias"),
        r(r"^[^=(]*?(?<![\w:~])@N\s*\(", "Function", "Method", check=lambda h, b: callable_head(h, b) and "::" not in re.split(r"\(", h)[0].split()[-1]), r(r"^[\w:<>,*&\s]+?[\s*&]@N\s*(?:\[[^\]]*\]\s*)*(?:=|:|$)", "Field", roles="type", check=plain), r(r"^@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|(?:public|private|protected)\s*:|\[\[[^\]]*\]\])+"), quotes='"',
)
PHP = Language(
    [
        r(r"^namespace\s+(?P<n>[\w\\]+)", "Module", block=Block("top")), r(rf"^{MODS}(?:readonly\s+)?class\s+@N", "Class", block=TYPE), r(r"^interface\s+@N", "Interface", block=TYPE), r(r"^trait\s+@N", "Trait", block=TYPE), r(r"^enum\s+@N", "Enum", block=TYPE),
        r(r"^case\s+@N", "Variant", roles="type"), r(rf"^{MODS}function\s+&?\s*@N", "Function", "Method", BODY, scope=False), r(rf"^{MODS}const\s+(?:[\w?|]+\s+)?@N\s*=", "Const"), r(rf"^{MODS}(?:[\w?|\\]+\s+)?\$@N", "Field", roles="type"),
    ],
    re.compile(r"^(?:\s|<\?php|<\?=?|#\[[^\]]*\])+"), hash_comments=True,
)
CSHARP = Language(
    [
        r(r"^namespace\s+(?P<n>[\w.]+)", "Module", block=Block("top")), r(rf"^{MODS}(?:class|record(?:\s+(?:class|struct))?)\s+@N", "Class", block=TYPE), r(rf"^{MODS}interface\s+@N", "Interface", block=TYPE), r(rf"^{MODS}struct\s+@N", "Struct", block=TYPE), r(rf"^{MODS}enum\s+@N", "Enum", block=Block("enum", True)),
        r(r"^[^=(]*?@N\s*(?:<[^(]*>)?\(", "Method", block=BODY, roles="type", scope=False, check=callable_head), r(rf"^{MODS}(?:void|[\w.<>\[\]?]+)\s+@N\s*(?:<[^(]*>)?\([^)]*\)\s*$", "Method", block=BODY, roles="body", scope=False, check=with_block),
        r(rf"^{MODS}[\w.<>\[\],? ]+?\s+@N\s*(?:=|,|$)", "Field", roles="type", check=plain), r(r"^@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|\[[^\]]*\])+"), quotes='"',
)
SWIFT = Language(
    [
        r(rf"^{MODS}enum\s+@N", "Enum", block=Block("enum")), r(rf"^{MODS}(?:class|struct|actor|extension)\s+(?!func|var|let)@N", "Class", block=TYPE), r(rf"^{MODS}protocol\s+@N", "Interface", block=TYPE),
        r(rf"^{MODS}(?:class\s+)?func\s+@N", "Function", "Method", BODY, scope=False), r(rf"^{MODS}(?:class\s+)?(?:var|let)\s+@N", "Field", roles="type top enum"), r(r"^(?:indirect\s+)?case\s+@N", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|@\w+(?:\([^)]*\))?)+"), nested=True, quotes='"', lines=True,
)
KOTLIN = Language(
    [
        r(rf"^{MODS}enum\s+class\s+@N", "Class", block=Block("enum", True)), r(rf"^{MODS}(?:annotation\s+|sealed\s+)?(?:class|interface|object)\s+@N", "Class", block=TYPE), r(rf"^{MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?@N", "Function", "Method"),
        r(rf"^{MODS}(?:val|var)\s+@N", "Const", "Field", roles="type top enum"), r(r"^@N\s*(?:\(.*)?$", "Variant", roles="enum"),
    ],
    re.compile(r"^(?:\s|@[\w.:]+(?:\([^)]*\))?)+"), nested=True, quotes='"', lines=True,
)
LANGUAGES = {"Rust": RUST, "TypeScript": TS, "Tsx": TS, "Go": GO, "Java": JAVA, "C": C, "Cpp": C, "Php": PHP, "CSharp": CSHARP, "Swift": SWIFT, "Kotlin": KOTLIN}
#: Words that stand before a parenthesis without being called.
NOT_CALLED = frozenset("if for while switch catch return sizeof typeof match loop in and or not when guard function fn func fun def else do try throw new await yield foreach using lock fixed elseif isset empty list array echo print declare alignof decltype static_assert defined super this class assert where let var as is case".split())
CALLED = re.compile(rf"(?P<n>{WORD})\s*(?:::\s*<[^()]*?>|<[\w\s,.:<>\[\]*&?]*>)?\s*\(")


class Places:
    """Line from 1 and byte column of places in a text."""

    def __init__(self, src: str):
        self.src, self.starts = src, [0, *(m.end() for m in re.finditer("\n", src))]

    def __call__(self, i: int) -> tuple[int, int]:
        line = bisect_right(self.starts, i)
        return line, len(self.src[self.starts[line - 1] : i].encode("utf-8", "surrogatepass"))


def impl_target(head: str) -> str:
    """The type of `impl<T> Trait for &Type<T> where ...`, without references and generics."""
    body = re.sub(r"\bwhere\b.*", "", head, flags=re.S)
    body = body[body.index("impl") + 4 :].strip()
    depth, k = 0, 0
    if body.startswith("<"):
        for k, c in enumerate(body):
            depth += (c == "<") - (c == ">" and body[k - 1] != "-")
            if not depth:
                break
        body = body[k + 1 :]
    return re.split(r"<", re.split(r"\bfor\s+", body)[-1].strip().lstrip("&").strip())[0].strip()


def definitions(language: str, src: str) -> list[Symbol]:
    lang, place = LANGUAGES[language], Places(src)
    code, out = blanked(src, lang), []
    if language in ("C", "Cpp"):
        for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)[^\n]*(?:\\\n[^\n]*)*", code, re.M):
            out.append(Symbol(m[1], m[1], "Macro", *place(m.start()), *place(m.end()), *place(m.start(1))))
        code = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), code, flags=re.M)
    if language == "Go":  # grouped declarations: each line of the group is one
        for m in list(re.finditer(r"^(const|type|var)[ \t]*\(", code, re.M))[::-1]:
            end = pairs(code).get(m.end() - 1, len(code))
            word = m[1]
            inner = code[m.end() : end]
            for x in re.finditer(rf"^[ \t]*({WORD}(?:[ \t]*,[ \t]*{WORD})*)([^\n]*)", inner, re.M):
                at = m.end() + x.start(1)
                if word == "const":
                    for y in re.finditer(WORD, x[1]):
                        a = at + y.start()
                        out.append(Symbol(y[0], y[0], "Const", *place(a), *place(a + len(y[0])), *place(a)))
                elif word == "type":
                    kind = "Struct" if re.match(r"\s*struct\b", x[2]) else "Interface" if re.match(r"\s*interface\b", x[2]) else "TypeAlias"
                    out.append(Symbol(x[1], x[1], kind, *place(at), *place(m.end() + x.end()), *place(at)))
            code = code[: m.start()] + re.sub(r"[^\n]", " ", code[m.start() : end + 1]) + code[end + 1 :]
    at = pairs(code)

    def read(lo: int, hi: int, scope: tuple[str, ...], block: Block, in_type: bool) -> None:
        here = scope
        ended = False  # the constants of an enum end with a semicolon
        for a, b, c, d, end in statements(code, lo, hi, at, lang, block.commas):
            head = code[a:b]
            if m := lang.prefix.match(head):
                a, head = a + m.end(), head[m.end() :]
            head = head.rstrip()
            if not head:
                continue
            role = "type" if ended else block.role
            for rule in lang.rules:
                if rule.roles and role not in rule.roles or not (m := rule.head.match(head)) or rule.check and not rule.check(head, c is not None):
                    continue
                inner, name = here, None
                if rule.kind == "#impl":
                    inner = (*here, impl_target(head))
                elif not rule.kind.startswith("#"):
                    name = m["n"]
                    own = (*here, m["scope"]) if "scope" in rule.head.groupindex else here
                    kind = rule.member if rule.member and in_type else rule.kind
                    p = a + m.start("n")
                    names = [(name, p)]
                    if kind in ("Field", "Const", "Variant") and language in ("Java", "CSharp", "Go", "Php", "Swift") and not (role == "enum" and language in ("Java", "CSharp")) or kind == "Field" and language in ("C", "Cpp"):
                        names += more(head, m.end("n"), a, language)
                    for one, q in names:
                        out.append(Symbol(one, "/".join((*own, one)), kind, *place(a), *place(end), *place(q)))
                    inner = (*own, name) if rule.scope else own
                if c is not None and rule.block:
                    read(c, d, inner, rule.block, rule.block.role in ("type", "list", "enum", "interface"))
                elif c is None and rule.kind == "Module" and language in ("Php", "CSharp"):
                    here = (*([] if language == "Php" else here), name)
                break
            else:
                if c is not None and block.role in ("body", "top"):
                    read(c, d, here, Block("body") if block.role == "body" or language == "Rust" else block, in_type)
            if block.role == "enum" and end < len(code) and code[end : end + 1] == ";" and language == "Java":
                ended = True

    read(0, len(code), (), Block("top"), False)
    return sorted(out, key=lambda s: (s.start_line, s.start_col, -s.end_line, -s.end_col))


def more(head: str, at: int, base: int, language: str) -> list[tuple[str, int]]:
    """Further names of `int a = 1, b, c;`."""
    found, depth, i = [], 0, at
    while i < len(head):
        c = head[i]
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth <= 0 and (m := re.compile(rf"\s*[*&$]?\s*({WORD})").match(head, i + 1)):
            found.append((m[1], base + m.start(1)))
            i = m.end()
            continue
        i += 1
    return found


def calls(language: str, src: str) -> list[Call]:
    lang, place = LANGUAGES[language], Places(src)
    code = blanked(src, lang)
    defined = {(s.sel_line, s.sel_col) for s in definitions(language, src)}
    words = NOT_CALLED | WORDS_OF.get(language, frozenset())
    specs = interfaces(code) if language == "Go" else []
    out = []
    for m in CALLED.finditer(code):
        before = code[max(0, m.start() - 40) : m.start()].rstrip()[-9:]
        if m["n"] in words or re.search(r"\b(?:new|fn|func|fun|function|class|struct|enum|record|init)$", before) or (at := place(m.start("n"))) in defined:
            continue
        if language in ("Rust",) and before.endswith("#[") or any(lo < m.start() < hi for lo, hi in specs):
            continue
        out.append(Call(m["n"], *at))
    return out


#: Words before a parenthesis that are syntax in one language: visibility, arrow functions, constructor chaining.
WORDS_OF = {"Rust": frozenset({"pub"}), "TypeScript": frozenset({"async"}), "Tsx": frozenset({"async"}), "CSharp": frozenset({"base", "this"})}


def interfaces(code: str) -> list[tuple[int, int]]:
    """Spans of the bodies of Go interfaces: their method specifications look like calls."""
    out = []
    for m in re.finditer(r"\binterface\s*\{", code):
        depth, at = 1, m.end()
        while at < len(code) and depth:
            depth += (code[at] == "{") - (code[at] == "}")
            at += 1
        out.append((m.end(), at))
    return out
