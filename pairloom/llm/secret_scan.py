"""Secret scans: plain patterns, and an assignment-aware lexer on top of them.

The plain patterns find assignments to names that hold secrets, access key ids and long hexadecimal
runs. The lexer goes further. It first tells strings and comments from code, then reads source and
configuration syntax into pairs of name and literal:

* assignments with ``=``, ``:``, ``:=``, ``=>``, also to a quoted or bracketed key, after a type annotation, in
  parentheses, in triple quotes, on the next line, and YAML block scalars;
* ``#define``, ``setenv``, ``export``, ``ENV`` and command-line options;
* setters, calls with a name and a literal, tags and attributes, and the literals among a call's arguments.

It follows names to the literals they stand for (``key = "..."`` and then ``password = key`` or
``password = f"{key}"``), joins literals put together with ``+``, and scores each literal by how sensitive the
words of the names are that it reaches and by how little it looks like a word, a name or a placeholder.
Literals that score high enough are reported where they stand, as kind ``lexed``. Plain findings are never
taken back. A name inside a string or comment can only be given a value inside it.

Each text is scanned whole, in one pass per pattern; no pattern tries a place twice, so time is linear.
Spans are in code points, end exclusive. Nulls: a null text is an empty one and has no spans; a null id
is passed on. Empty table: no rows. Repeated rows are scanned each. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairloom.llm.common import field, map_rows

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
# A run is found whole, so a bound on its length in the pattern drops the same matches as one afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# What strings and comments look like. A string that its line does not close is none; what else is not
# closed goes on to the end, so no stretch is read twice.
SEGMENT = re.compile(
    r'(?P<triple>"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+(?:\'\'\'|\Z))'
    r'|(?P<string>"(?:[^"\\\n]|\\.)*+(?P<c1>")?|(?<!\w)\'(?:[^\'\\\n]|\\.)*+(?P<c2>\')?|`[^`\n]*+(?P<c3>`)?)'
    r"|(?P<comment><!--(?:[^-]|-(?!->))*+(?:-->|\Z)|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
    r"|(?:(?<![:\w\"'/])//|(?<![^\s;])\#(?!\s*+define\b))[^\n]*+)",
    re.DOTALL,
)
# A name, and what may stand between it and its value.
WORD = r"[A-Za-z_$][\w.$-]*+"
NAME = rf"(?<![\w.$-])({WORD})"
LINE_END = r"(?:\\?\r?\n[ \t]*+(?=[\"'`(]))?"
OPERATOR = (
    r"(?:[\"'`]?[ \t]*+\]|[\"'`])?[ \t]*+"
    r"(?:\??:[ \t]*+[A-Za-z_][\w.\[\]|?<> ]{0,60}+=(?![=>])|:=|=>|[?+|]*+=(?![=~])|:(?![:=/]))[ \t]*+" + LINE_END
)
# Marks before a literal, and the literal: quoted in one of four ways, or bare up to a delimiter.
PREFIX = r"(?:\([ \t]*+)*+(?:[rRbBuUfF]{1,2}(?=[\"'])|[@$](?=\"))?"
VALUE = (
    PREFIX + r"(?:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'\'\'((?:[^'\\]|\\.|'(?!''))*+)'\'\'"
    r"|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s\"'`,;(){}\[\]<>|]++))"
)
PAIR = re.compile(NAME + OPERATOR + VALUE, re.DOTALL)
JOINED = re.compile(r"[ \t]*+(?:\+|\.(?=[ \t]))[ \t]*+(?:\\?\n[ \t]*+)?" + VALUE, re.DOTALL)
BLOCK = re.compile(rf"^([ \t]*+)(?:-[ \t]++)?[\"']?({WORD})[\"']?[ \t]*+:[ \t]*+[|>][+-]?[0-9]?[ \t]*+\r?\n", re.MULTILINE)
SPACED = re.compile(
    rf"(?:^[ \t]*+\#[ \t]*+define[ \t]++|(?<![\w.-])(?:setenv|setx|ENV)[ \t]++|(?<![\w-])--?(?=[A-Za-z]))({WORD})[ \t=]++{VALUE}",
    re.MULTILINE | re.DOTALL,
)
SETTER = re.compile(rf"(?<![A-Za-z0-9])(?:set|with|add|put)_?([A-Z_]\w*+)\([ \t]*+{VALUE}", re.DOTALL)
TWO = re.compile(rf"\([ \t]*+[\"']({WORD})[\"'][ \t]*+,[ \t]*+{VALUE}", re.DOTALL)
ATTRIBUTES = re.compile(rf"(?<![\w-])(?:key|name|id|property|variable)[ \t]*+=[ \t]*+[\"']({WORD})[\"'][ \t\n]++value[ \t]*+=[ \t]*+{VALUE}", re.IGNORECASE | re.DOTALL)
ELEMENT = re.compile(rf"<({WORD})(?:[ \t][^<>\n]*+)?>([^<>\n]++)</")
NAMED_ELEMENT = re.compile(rf"<[^<>\n]*?(?:key|name|id)[ \t]*+=[ \t]*+[\"']({WORD})[\"'][^<>\n]*+>([^<>\n]++)</", re.IGNORECASE)
# Strings among the arguments of a call that a name is set to.
ARGUMENT = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|([()\n])")
CALL = re.compile(NAME + OPERATOR + rf"(?:(?:await|new)[ \t]++)?({WORD})(?:\[(?=[\"'])|\()")
REFERENCE = re.compile(r"[A-Za-z_$][\w.$-]*")
INSIDE = re.compile(r"[$#]?\{[ \t]*+([A-Za-z_$][\w.$-]*+)[ \t]*+(?:![rsa])?\}")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Calls whose first argument says where to look, and is no secret.
LOOKUPS = {
    "get", "getenv", "env", "environ", "config", "lookup", "fetch", "read", "load", "require", "property", "param",
    "open", "prompt", "input", "getpass", "find", "resolve",
}
MOST_DEPTH = 8
# Words and names put together, each in one case, and without digits: no literal if bare.
PLAIN_WORDS = re.compile(r"(?:[a-z]++|[A-Z][a-z]*+|[A-Z]++)(?:[-_./:]++(?:[a-z]++|[A-Z][a-z]*+|[A-Z]++))*+")

# How sensitive a word of a name is, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.9, "apikey": 1.0, "key": 0.5, "private": 0.5, "auth": 0.6, "bearer": 0.8,
    "access": 0.4, "signing": 0.4, "encryption": 0.4, "api": 0.4, "client": 0.2, "salt": 0.5, "cookie": 0.4,
}
# Words that say the value is not itself the secret.
HARMLESS = {"file", "path", "url", "uri", "name", "id", "type", "length", "size", "count", "limit", "field"}
# Words that make a placeholder after "my" or "your", all in one case.
_WORDS = (
    "access api app auth bearer client code credentials credential database db encryption goes here id key name own"
    " passphrase password passwd private pwd secret server service signing string super token user value"
)
_PHRASE = "(?:" + "|".join(sorted(_WORDS.split(), key=len, reverse=True)) + ")"
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|sample|test|none|null|true|false|undefined|todo"
    rf"|(?-i:(?:your|my)(?:[-_]?{_PHRASE})++|(?:YOUR|MY)(?:[-_]?{_PHRASE.upper()})++)"
    r"|<.*>|\$\{.*\}|\$\(.*\)|%.*%|\{\{.*\}\})$"
)
MIN_SCORE = 0.6
MIN_LITERAL = 8


def name_score(name: str) -> float:
    """How likely a name holds a secret: its words' weights, joined as independent hints."""
    words = [w.lower() for part in re.split(r"[._$-]+", name) for w in NAME_WORDS.findall(part)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    rest = 1.0
    for word in words:
        rest *= 1.0 - SENSITIVE.get(word, 0.0)
    return 1.0 - rest


def literal_score(literal: str) -> float:
    """From 0 for a placeholder, a number or prose to 1 for a random string."""
    if len(literal) < MIN_LITERAL or PLACEHOLDER.match(literal) or len(set(literal)) < 4:
        return 0.0
    if literal.count(" ") > 1 or literal.replace(".", "").replace("-", "").isdigit():
        return 0.0
    total = len(literal)
    bits = -sum(n / total * math.log2(n / total) for n in Counter(literal).values())
    kinds = sum(map(bool, (re.search(p, literal) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))))
    return min(1.0, bits / 4.0 * 0.6 + kinds * 0.15)


class _Segments:
    """Strings and comments of a text."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, bool]] = []  # inner start and end, and whether it is a string
        for match in SEGMENT.finditer(text):
            start, end = match.span()
            if match.lastgroup in ("c1", "c2", "c3") or match["string"] is not None:
                if end - start < 2 or text[end - 1] != text[start] or not (match["c1"] or match["c2"] or match["c3"]):
                    continue
                self.starts.append(start)
                self.spans.append((start + 1, end - 1, True))
            elif match["triple"] is not None:
                self.starts.append(start)
                self.spans.append((start + 3, max(start + 3, end - 3), True))
            else:
                self.starts.append(start)
                self.spans.append((start, end, False))

    def around(self, at: int) -> tuple[int, int, bool] | None:
        """The string or comment that a place lies in."""
        i = bisect_right(self.starts, at) - 1
        if i >= 0 and self.spans[i][0] <= at < self.spans[i][1]:
            return self.spans[i]
        return None

    def allows(self, name: tuple[int, int], value: tuple[int, int], quoted: bool) -> bool:
        """Whether a name can have a value: both in the same string or comment, or both in code."""
        own, other = self.around(name[0]), self.around(value[0])
        if own is not None and own[2] and (own[0], own[1]) == name:
            own = None  # a quoted name
        if own is not None:
            return value[1] <= own[1]
        # In code a quoted value is a whole string; a bare one lies in none.
        return other is None or (quoted and (other[0], other[1]) == value)


def _call_strings(text: str, at: int, lookup: bool) -> list[tuple[int, int]]:
    """Spans of the strings among a call's arguments, up to its end or the line's.

    Calls inside calls are read again for their own names, and so down to a bounded depth.
    """
    spans, depth, n = [], 1, 0
    for match in ARGUMENT.finditer(text, at):
        if match[3] == "(":
            depth += 1
            if depth > MOST_DEPTH:
                break
        elif match[3]:
            depth -= 1
            if not depth or match[3] == "\n":
                break
        else:
            n += 1
            if not (lookup and n == 1):
                spans.append(match.span(match.lastindex))
    return spans


def lex(text: str) -> tuple[list[tuple[str, list[tuple[int, int, bool]]]], list[tuple[str, str]]]:
    """(name, spans of its literals and whether they are quoted) and (name, name it is set to)."""
    segments = _Segments(text)
    literals: list[tuple[str, list[tuple[int, int, bool]]]] = []
    references: list[tuple[str, str]] = []

    def take(match: re.Match, first: int = 2) -> int:
        """Note the value of a match, and what is joined to it; where reading goes on."""
        name, spans, value, end = match[1], [], match, match.end(1)
        while value:
            group = value.lastindex
            start, stop = value.span(group)
            quoted = stop < len(text) and start > 0 and text[start - 1] in "\"'`" and text[stop] == text[start - 1]
            if not segments.allows(match.span(1), (start, stop), quoted):
                break
            end = max(end, value.end())
            own = text[start:stop]
            if not quoted and REFERENCE.fullmatch(own):
                references.append((name, own))
            if quoted and "{" in own:
                references.extend((name, source) for source in INSIDE.findall(own))
            # A bare name before a bracket is what is called, not a value.
            if own and (quoted or text[stop : stop + 1] not in ("(", "[")):
                spans.append((start, stop, quoted))
            value = JOINED.match(text, value.end())
        if spans or end > match.end(1):
            literals.append((name, spans))
        return max(end, match.end(1))

    has_call = "(" in text or "[" in text
    at = 0
    while match := PAIR.search(text, at):
        at = take(match)
    if has_call:
        for match in CALL.finditer(text):
            callee = re.split(r"[._]", match[2].lower())
            lookup = text[match.end() - 1] == "[" or not LOOKUPS.isdisjoint(callee) or any(w.startswith("get") for w in callee)
            found = _call_strings(text, match.end(), lookup)
            found = [span for span in found if segments.allows(match.span(1), span, True)]
            literals.append((match[1], []))
            literals.extend((match[1], [(*span, True)]) for span in found)
        for pattern in (SETTER, TWO):
            for match in pattern.finditer(text):
                take(match)
    if "--" in text or "define" in text or "setenv" in text or "setx" in text or "ENV" in text or " -" in text:
        for match in SPACED.finditer(text):
            take(match)
    if "<" in text:
        for match in ATTRIBUTES.finditer(text):
            take(match)
        for pattern in (ELEMENT, NAMED_ELEMENT):
            literals.extend((m[1], [(*m.span(2), True)]) for m in pattern.finditer(text))
    if ":" in text:
        for match in BLOCK.finditer(text):
            literals.append((match[2], _block(text, match.end(), len(match[1]))))
    return literals, references


def _block(text: str, at: int, indent: int) -> list[tuple[int, int, bool]]:
    """Lines that are indented further than their key."""
    spans = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        own = len(line) - len(line.lstrip(" \t"))
        if line.strip():
            if own <= indent:
                break
            spans.append((at + own, at + len(line.rstrip()), True))
        at = end + 1
    return spans


def lexed_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[int, int]]:
    """Where literals stand that reach a sensitive name."""
    lowered = text.lower()
    if not any(word in lowered for word in SENSITIVE):
        return []  # no name scores
    literals, references = lex(text)
    # Sensitivity flows against assignments: what is set to a name makes that name as sensitive.
    scores: dict[str, float] = {}
    for name, _ in literals:
        if name not in scores:
            scores[name] = name_score(name)
    sources: dict[str, list[str]] = {}
    for name, source in references:
        if source in scores:
            sources.setdefault(name, []).append(source)
    waiting = [name for name in sources if scores.get(name, 0) > 0]
    while waiting:
        name = waiting.pop()
        for source in sources.get(name, ()):
            if scores[source] < scores[name]:
                scores[source] = scores[name]
                waiting.append(source)
    known = {name for name, _ in literals}
    found = []
    for name, spans in literals:
        if scores[name] <= 0 or not spans:
            continue
        # A bare name that is set elsewhere is a reference, and its own literal is reported there.
        kept = [(s, e) for s, e, quoted in spans if quoted or text[s:e] not in known]
        value = "".join(text[s:e] for s, e, _ in spans)
        if all(not quoted for *_, quoted in spans) and PLAIN_WORDS.fullmatch(value):
            continue
        if "{" in value and not INSIDE.sub("", value).strip():
            continue
        if scores[name] * literal_score(value) >= min_score:
            found.extend(kept)
    return sorted(set(found))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start and then kind as in KINDS."""
    if not text:
        return []
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("lexed", *s) for s in lexed_spans(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_lexed, base_sha256, spans) for each row."""
    schema = T.StructType(
        [
            field(df, id_col),
            *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )

    def make():
        def run(columns: dict[str, list]) -> dict[str, list]:
            found = [scan(text) for text in columns[text_col]]
            out = {id_col: columns[id_col], "spans": [joined(spans) for spans in found]}
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(s[0] == kind for s in spans) for spans in found]
            base = (joined([s for s in spans if s[0] != "lexed"]) for spans in found)
            out["base_sha256"] = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            return out

        return run

    return map_rows(df.select(id_col, text_col), make, schema)
