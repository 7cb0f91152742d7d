"""Problem 1: literal secrets in code, configuration, commands, logs and prose, found and redacted.

Method: from the line of each credential word on, the text is tokenized lexically: words with their dots and
dashes, string literals (quoted, triple, escaped within other strings, template), numbers, operators, line
ends. A small grammar over the tokens finds what is assigned or passed to a credential-named identifier or key:
assignments with or without a type, across line ends and in brackets, subscripts, keyword and positional
arguments of setters, macros, options, concatenations, defaults, block scalars and here-documents. Such a
literal that is no placeholder, reference, mask or plain name is a secret. Texts inside string literals are
tokenized in turn. Only the inside of literals is replaced, so quotes, escapes and the code around stay.
Key blocks, addresses with a password, published token formats, and what commands and prose tell of a
credential are literals of their own. Neither values nor lines have a greatest length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.session import spread

REDACTED = "[REDACTED]"

# Words that name a credential, alone or after the words of PAIRS.
CREDENTIAL = frozenset(
    "password passwd passwort kennwort passphrase passcode pwd pass pw secret secrets token jwt bearer apikey accesskey secretkey privatekey authtoken credential credentials psk jeton motdepasse"
    " accesstoken apitoken clientsecret sessionid sid cookie".split()
)
PAIRS = frozenset("api access secret private auth authentication signing encryption shared account master service deploy app application admin root session client webhook license crypt hmac storage subscription".split())
#: Words that may follow the credential word without changing what the value is.
TRAILING = frozenset("value val string str literal plain plaintext raw b64 base64 default current old new prod production staging dev test".split())

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Names of what sets or asks for a credential, before its name in a call; the askers give none.
ASKERS = frozenset("get read load fetch validate check verify hash is has ask prompt input find lookup parse decode encode refresh revoke delete remove compare match count len print log require expect test hide mask redact strip rotate".split())
DEFINERS = frozenset("define def defvar defconst setq set setx env arg export const let val var".split())
_WORDS = r"(?:pass(?:w(?:or)?d|wort|phrase|code)?|pwd|pw|secret|token|key|jwt|psk|kennwort|credential|cookie|session|sid|bearer|jeton|passe)s?"
#: Where a credential may be given a value, over the lower-cased text: the name's end before an operator, an option, a macro.
ANCHORS = (
    re.compile(_WORDS + r"[_.\d-]{0,4}(?:value|val|string|str|literal|plain|plaintext|raw|b64|base64|default|current|old|new|prod|production|staging|dev|test)?\d{0,3}(?:\\*[\"'`])?[\]?!]?\s*(?::|=|,|<-|\(|\[)"),
    re.compile(r"(?<![\w-])--?[a-z][\w-]*(?<=[a-z]{2})(?=[ \t=])"),
    re.compile(r"\b(?:define|def|defvar|defconst|setq|setx?|env|arg)[ \t]+[\w.-]*" + _WORDS + r"(?=[ \t]+\S)"),
)
TOKEN = re.compile(
    r"""(?P<blank>[ \t\r\f\v]+|\\\r?\n)|(?P<newline>\n)
    |(?P<string>(?<!\w)(?:[rbfuRBFUL]{1,2}|@)?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`))
    |(?P<escaped>(\\+["'])[^\n]*?(?<!\\)\5)
    |(?P<word>[^\W\d][\w$]*(?:(?:[.\-]|->|::|\?\.)[^\W\d][\w$]*)*)|(?P<number>\d[\w.]*)
    |(?P<op>:=|=>|<-|->|===?|!==?|\|\||\?\?|<<[-~]?|--|.)""",
    re.X | re.S,
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(.*?)-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----", re.S)
#: Other armoured blocks and inline data hold nothing to find.
OPAQUE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|SIGNATURE)(?: BLOCK)?-----.*?-----END [A-Z0-9 ]+-----|data:[\w.+-]+/[\w.+-]+;base64,[A-Za-z0-9+/=]*", re.S)
#: scheme://user:password@host; the password may hold anything but blanks, quotes, slashes and brackets.
USERINFO = re.compile(r"(?<=://)([^\s/:@'\"<>`]*)(?::([^\s/'\"<>`]*?))?@(?=[A-Za-z0-9\[])")
#: Published formats of keys and tokens.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_+/=-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|AIza[\w-]{35}|glpat-[\w-]{20,}|xox[abeoprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{16,}"
    r"|sk-(?:proj-)?[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36}|pypi-[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{64}|SG\.[\w-]{16,}\.[\w-]{16,}|ya29\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})(?![A-Za-z0-9_/=-])"
)

#: One of these is in every text that FORMATS can match.
MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "AIza", "glpat-", "xox", "_live_", "_test_", "sk-", "npm_", "pypi-", "hf_", "dop_v1_", "SG.", "ya29.", "eyJ")
USERPASS = re.compile(r"(?<![\w-])(?:-u|--user|--proxy-user|-U)(?:\s+|=)?(?P<q>[\"']?)(?P<user>[^\s:\"'/@]+):(?P<value>[^\s\"']+)")
ATTACHED = re.compile(r"\b(?:mysql\w*|mariadb\S*|sshpass|mongo\w*|pg_dump|redis-cli|smbclient|ldap\w+)\b[^\n|;]*?\s(?:-p|-a|-w)(?P<q>[\"']?)(?P<value>[^\s\"']{4,})")
NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(?P<value>\S+)", re.I)
SQLISH = re.compile(r"\b(?:identified\s+(?:with\s+\S+\s+)?by|password)\s+(?:encrypted\s+|unencrypted\s+)?(?P<q>['\"])(?P<value>(?:[^'\"\\\n]|\\.)+)(?P=q)", re.I)
XML = re.compile(r"<(?P<key>[\w.\-:]+)(?:\s[^<>]*)?>\s*(?P<value>[^<>\n]+?)\s*</(?P=key)>")
SCHEME = re.compile(r"\b(?P<scheme>bearer|basic|token|apikey)[ \t]+(?P<value>[A-Za-z0-9+/_.~=\-]{8,})(?![\w(])", re.I)
HEADER = re.compile(r"\b(?:proxy-)?authori[sz]ation\b", re.I)
COOKIE = re.compile(r"\b(?:set-)?cookie\b\s*[:=]", re.I)
COOKIE_PAIR = re.compile(r"(?P<key>[\w.\-]*(?:session|sess|sid|token|auth|jwt)[\w.\-]*)=(?P<value>[^\s;,\"']+)", re.I)
#: Prose: a credential noun, some words that name its use, then ":", "is" or a like word, then the value.
PROSE = re.compile(
    r"\b(?P<noun>pass ?words?|pass ?phrase|pass ?code|pwd|mot de passe|phrase secr[eè]te|cl[eé] (?:d[’']acc[eè]s|secr[eè]te|d[’']api|api)|jeton(?: d[’'](?:acc[eè]s|api|authentification)| de session| secret)?|passwort|kennwort|zugangstoken|zugangsschl[uü]ssel"
    r"|(?:access|api|auth|bearer|personal|session|secret|service|deploy|private|client|login)[ -](?:token|key|secret|code|credential)s?|token|secret|key|schl[uü]ssel|cl[eé]|credentials?)\b"
    r"(?P<between>(?:[ \t]+(?!is\b|est\b|ist\b|lautet\b|was\b|remains\b|reste\b|stays\b|bleibt\b|devient\b|becomes\b)[^\s:=]+){0,8}?)[ \t]*(?P<op>:|=|\b(?:is|est|ist|lautet|was|remains|reste|stays|bleibt|devient|becomes)(?:[ \t]+(?:now|still|set to|toujours|maintenant|jetzt|noch))?[ \t]*:?)[ \t]+(?P<value>\S+)",
    re.I,
)

MASK = re.compile(r"(?:[*xX•.#?_\-]|\\u2022)+\Z|(.)\1{5,}\Z|.*\*{4,}|.*[xX•]{6,}\Z", re.S)
REFERENCE = re.compile(
    r"\$[A-Za-z_]\w*\Z|.*\$\{|.*\$\(|.*\{\{|.*\}\}|<[^<>]*>?\Z|%\w+%\Z|%[({]\w+[)}]|%s\Z|#\{|@@|\[[A-Za-z _-]+\]\Z|\{[\w .]*\}\Z|(?:vault|secret|secrets|op|arn|env|file|ref|ssm|sops|awssm|gcpsm|kms|keyring|doppler|aws-sm|azurekv|bw|pass|enc)(?::|/{2})|!(?:vault|secret|ref|sub|env)|/[\w.-]+/|\./|~/|https?://"
    r"|(?:os|process|env|environ|config|settings|self|this|secrets|System|ENV|Deno|import\.meta|ctx|app|args|opts|options|params|request|req|vault|keyring|getpass|boto3|core|std|dotenv|viper|Rails|app\.config)[.\[(]|getenv|.*(?:getenv|environ|getpass|get_secret|getSecret|load_secret|read_secret|vault\.\w+\(|fetch\w*\(|\w\(\))",
    re.I,
)
PLACEHOLDER = re.compile(
    r"(?:your|my|the|an?|some|insert|enter|put|replace|change|todo|fixme|tbd|dummy|fake|sample|example|placeholder|redacted|removed|hidden|masked|none|null|nil|undefined|true|false|empty|secret|password|passwd|token|changeme|notset|unset|default|required|optional|string|str|bytes|prompt|stdin|ask)"
    r"(?:[_\- .]?(?:your|my|here|me|this|value|secret|password|passwd|token|key|api|access|client|it|example|placeholder|string|later|goes|real|one|none|now|in|with|set|required|redacted))*\d{0,3}\Z",
    re.I,
)
NAME = re.compile(r"[^\W\d_]+(?:[-_./: ][^\W\d_]+)*\Z")
CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]+)*\Z|(?:[A-Z][a-z]+)+\Z|[A-Z]+(?:_[A-Z]+)*\Z")
HOSTISH = re.compile(r"[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|dev|example|test|invalid|local|pem|crt|key|pub|json|ya?ml|toml|txt|env|p12|jks|sh|py|js|ts|go|rs|md)\Z", re.I)
CALL = re.compile(r"[A-Za-z_][\w.:]*[(\[]")


class Secret(NamedTuple):
    start: int
    end: int


#: What the rules of _line start from, over the lower-cased text.
GATES = (
    HEADER, PROSE, SCHEME, re.compile(r"(?<![\w-])-(?:u|-user|-proxy-user)\b"), re.compile(r"\b(?:mysql|mariadb|sshpass|mongo|pg_dump|redis-cli|smbclient|ldap)"), re.compile(r"</[\w.\-:]+>"),
    re.compile(r"\bidentified\s|\bpassword\s+(?:(?:un)?encrypted\s+)?['\"]|\blogin\s+\S+\s+password"), COOKIE,
)


def credential_name(name: str) -> bool:
    """Whether an identifier names a credential: its last telling word is one (max_tokens, secret_ref, token_budget are not)."""
    words = [w.lower() for w in WORD.findall(name)]
    while words and (words[-1].isdigit() or (len(words) > 1 and words[-1] in TRAILING)):
        words.pop()
    if not words:
        return False
    if words[-1] in CREDENTIAL:
        return True
    if words[-1] in ("key", "keys") and len(words) > 1:
        return words[-2] in PAIRS
    return len(words) > 1 and words[-2] + words[-1] in CREDENTIAL


def literal_secret(value: str, *, quoted: bool = False, told: bool = False, phrase: bool = False) -> bool:
    """Whether a value given to a credential is the secret itself.

    quoted: it was a string literal. told: nothing but a credential can stand there (userinfo, a password
    argument), so plain words count too. phrase: a password was named, so four words and more are one.
    """
    path = re.fullmatch(r"\w+(?:\.\w+)*\.\d+", value)  # an attribute of code is no number
    if len(value) < 4 or MASK.match(value) or (not path and REFERENCE.match(value)) or PLACEHOLDER.match(value):
        return False
    if phrase and quoted and re.fullmatch(r"[^\W\d_]{3,}(?:([-_. ])[^\W\d_]{3,})(?:\1[^\W\d_]{3,}){2,}", value):
        return True
    if HOSTISH.match(value) or (not quoted and CALL.match(value)):
        return False
    if any(c.isspace() for c in value):
        return quoted and any(c.isdigit() for c in value) and len(value.split()) <= 6 and not value.endswith((".", ":"))
    if value.isdigit():
        return told or len(value) >= 6 and quoted
    if NAME.match(value) or CAMEL.match(value):
        random = any(len(part) >= 10 and not (CAMEL.match(part) and len(part) >= 3 * sum(map(str.isupper, part))) and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", part)) >= (3 if part == value else 5) for part in re.split(r"[-_./: ]", value))
        return random or told and len(value) >= 6 and not re.match(r"[a-z]+(?:[-_][a-z]+)+\Z", value)
    if not any(c.isdigit() for c in value) and not told:
        return sum(not c.isalnum() for c in value) >= 1 and len(value) >= 8 and any(not c.isalnum() and c not in "-_./:" for c in value)
    return any(c.isalnum() for c in value)


def _bare(line: str, at: int, query: bool) -> int:
    """The end of an unquoted value: blanks end it, in an address also & and #; closing brackets and commas do not belong to it."""
    end = at
    stop = "&#\"'<>`" if query else "\"'`"
    while end < len(line) and not line[end].isspace() and line[end] not in stop:
        end += 1
    while end > at and (line[end - 1] in ",;" or (line[end - 1] in ")]}" and line[at:end].count(line[end - 1]) > line[at:end].count({")": "(", "]": "[", "}": "{"}[line[end - 1]]))):
        end -= 1
    return end


class Token(NamedTuple):
    kind: str
    start: int
    end: int


class Stream:
    """The tokens of text[start:end], made as they are asked for."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.end, self.at = text, end, start
        self.tokens: list[Token] = []
        self.starts: list[int] = []

    def get(self, i: int) -> Token:
        """Token i; behind the last one an end token."""
        while len(self.tokens) <= i and self.at < self.end:
            m = TOKEN.match(self.text, self.at, self.end)
            self.tokens.append(Token(m.lastgroup, m.start(), m.end()))
            self.starts.append(m.start())
            self.at = m.end()
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("end", self.end, self.end)

    def covering(self, offset: int) -> int:
        while self.at <= offset and self.at < self.end:
            self.get(len(self.tokens))
        return bisect_right(self.starts, offset) - 1

    def said(self, i: int) -> str:
        t = self.get(i)
        return self.text[t.start : t.end]

    def inside(self, i: int) -> tuple[int, int]:
        """The span of a string literal without prefix and quotes."""
        t = self.get(i)
        v = self.text[t.start : t.end]
        n = re.match(r"[A-Za-z@]*(\"\"\"|'''|\\*[\"'`])", v)
        return t.start + n.end(), t.end - len(n[1])

    def skip(self, i: int, *kinds: str) -> int:
        while self.get(i).kind in kinds:
            i += 1
        return i

    def string(self, i: int) -> bool:
        return self.get(i).kind in ("string", "escaped")


def _key_of(s: Stream, i: int) -> str | None:
    """The name that token i is or quotes, if it is a credential's; of a collection, if it is subscripted."""
    t = s.get(i)
    if t.kind == "word":
        name = s.said(i)
    elif s.string(i) and t.end - t.start <= 80:
        a, b = s.inside(i)
        name = s.text[a:b]
        if not re.fullmatch(r"[\w.\- /:\[\]]+", name):
            return None
    else:
        return None
    if s.said(i + 1) == "[" and name[-1:] in "sS":
        name = name[:-1]
    return name if credential_name(name) else None


def _block(s: Stream, i: int) -> tuple[int, int] | None:
    """The lines of a block scalar whose mark is token i, or None: all that stand deeper than the line of the key."""
    text = s.text
    m = re.compile(r"[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\r?\n").match(text, s.get(i).start, s.end)
    if not m:
        return None
    line = text.rfind("\n", 0, m.start()) + 1
    deep = re.compile(r"[ \t]*(?:- )?").match(text, line).end() - line
    at, start, end = m.end(), None, m.end()
    while at < s.end:
        stop = text.find("\n", at, s.end)
        stop = s.end if stop < 0 else stop
        row = text[at:stop].rstrip("\r")
        if row.strip():
            inner = len(row) - len(row.lstrip(" \t"))
            if inner <= deep:
                break
            start, end = at + inner if start is None else start, at + len(row.rstrip())
        at = stop + 1
    return (start, end) if start is not None else None


def _heredoc(s: Stream, i: int) -> tuple[int, int] | None:
    m = re.compile(r"<<[-~]?\s*(['\"]?)(\w+)\1[^\n]*\n(.*?)\n?^[ \t]*\2[ \t]*$", re.S | re.M).match(s.text, s.get(i).start, s.end)
    return (m.start(3), m.end(3)) if m and m[3] else None


def _value(s: Stream, i: int, *, wrapped: bool, bare: bool, query: bool = False) -> tuple[list[tuple[int, int]], bool]:
    """(spans of the literals of the value that starts at token i, whether quoted).

    wrapped: it may stand on a later line. bare: it may stand without quotes, then on this line only.
    """
    first = s.skip(i, "blank")
    at, opened = first, 0
    while s.get(at).kind in ("blank", "newline") or s.said(at) == "(":
        opened += s.said(at) == "("
        at += 1
    if at != first and s.get(at).kind != "end" and not s.string(at) or (at != first and not (wrapped or opened)):
        at = first
    if s.string(at):
        after = s.skip(at + 1, "blank")
        if at != first and not opened and s.said(after) in (":", "=", "=>"):
            return [], True  # the key of the next line
        spans = [s.inside(at)]
        while True:  # literals put together
            j = s.skip(at + 1, "blank", *["newline"] * bool(opened))
            if s.said(j) in ("+", ".", "&", "||") and s.string(k := s.skip(j + 1, "blank", "newline")):
                at = k
            elif s.string(j) and (opened or s.said(j)[-1:] == s.said(at)[-1:] and j > at + 1):
                at = j
            else:
                return spans, True
            spans.append(s.inside(at))
    said = s.said(first)
    if said in ("|", ">") and (block := _block(s, first)):
        return [block], True
    if said.startswith("<<") and (doc := _heredoc(s, first)):
        return [doc], True
    t = s.get(first)
    if not bare or t.kind in ("newline", "end"):
        return [], False
    if said in ("\"", "'", "`"):  # a literal without an end
        stop = s.text.find("\n", t.end, s.end)
        return [(t.end, s.end if stop < 0 else stop)], True
    stop = s.text.find("\n", t.start, s.end)
    line = s.text[t.start : s.end if stop < 0 else stop]
    spans = [(t.start, t.start + _bare(line, 0, query))]
    if REFERENCE.match(line[: spans[0][1] - spans[0][0]]) or CALL.match(line):  # the value that stands in for a missing one
        m = re.compile(r"[^\n;#]*?(?:\|\||\?\?|\bor\b)[ \t]*").match(s.text, t.start, s.end)
        if m and s.text[m.end() : m.end() + 1] in ("\"", "'"):
            inner = Stream(s.text, m.end(), s.end)
            if inner.string(0):
                return [inner.inside(0)], True
    return spans, False


def _arguments(s: Stream, i: int) -> list[tuple[int, int]]:
    """The string literals that are arguments of the call whose bracket is token i."""
    out, depth, fresh = [], 0, False
    while (t := s.get(i)).kind != "end":
        said = s.said(i)
        if said in "([{" and t.kind == "op":
            depth, fresh = depth + 1, depth == 0
        elif said in ")]}" and t.kind == "op":
            depth -= 1
            if not depth:
                return out
        elif said == "," or said == ";":
            fresh = depth == 1
            if said == ";":
                return out
        elif t.kind not in ("blank", "newline"):
            if s.string(i) and fresh and s.said(s.skip(i + 1, "blank", "newline"))[:1] in (",", ")", "+"):
                out.append(s.inside(i))
            fresh = False
        i += 1
    return []


def _given(s: Stream, i: int) -> Iterator[tuple[int, int]]:
    """Spans of the secrets that the credential at token i is given."""
    key = _key_of(s, i)
    if key is None:
        return
    text, quoted_key = s.text, s.string(i)
    phrase = bool(re.search(r"(?i)pass|pwd|kennwort", key))
    fit = lambda spans, quoted: [x for x in spans if x[1] - x[0] >= 3] if literal_secret("".join(text[a:b] for a, b in spans), quoted=quoted, phrase=phrase) else []
    before = s.said(i - 1) if i else ""
    j = s.skip(i + 1, "blank")
    if not quoted_key and before in ("-", "--") and (i == 1 or s.get(i - 2).kind in ("blank", "newline") or s.said(i - 2) in ("[", "(", "\"", "'", "-")):
        eq = s.said(i + 1) == "="
        if (eq or s.get(i + 1).kind == "blank") and s.said(s.skip(i + 2, "blank") if eq else j) not in ("-", "--"):
            yield from fit(*_value(s, i + 2 if eq else j, wrapped=False, bare=True))
        return
    if s.said(j) == "[" and s.get(k := s.skip(j + 1, "blank")).kind in ("string", "escaped", "word", "number") and s.said(s.skip(k + 1, "blank")) == "]":
        j = s.skip(s.skip(k + 1, "blank") + 1, "blank")
    closed = 0
    while s.said(j) in ("]", "?", "!") or (quoted_key and s.said(j) == ")"):
        j, closed = s.skip(j + 1, "blank"), 1
    op = s.said(j)
    if op == ":":  # a type before the value
        k, n = s.skip(j + 1, "blank"), 0
        while n < 12 and (s.get(k).kind in ("word", "blank") or s.said(k) in ("&", "<", ">", "[", "]", "?", "'", ".", "|", "*")):
            k, n = k + 1, n + 1
        if n and s.said(k) in ("=", ":="):
            j, op = k, "="
    if op in (":", "=", "=>", ":=", "<-", "==", "===", "!=", "!=="):
        query = before in ("?", "&") or (i > 1 and before == ";" and s.said(i - 2) in ("amp",))
        n = s.skip(j + 1, "blank")
        if op == ":" and not s.string(n) and SCHEME.match(text, s.get(n).start):
            return
        yield from fit(*_value(s, j + 1, wrapped=True, bare=True, query=query))
    elif op == "," and (quoted_key or before in ("(", ",")) and not closed:
        yield from fit(*_value(s, j + 1, wrapped=True, bare=False))
    elif op == "(" and not quoted_key:
        words = [w.lower() for w in WORD.findall(key.rpartition(".")[2].rpartition(":")[2].rpartition(">")[2])]
        if not ASKERS.intersection(words):
            for span in _arguments(s, j):
                yield from fit([span], True)
    elif not quoted_key and j > i + 1 and i > 1 and s.get(i - 1).kind == "blank" and s.said(i - 2).lower() in DEFINERS:
        yield from fit(*_value(s, j, wrapped=False, bare=s.said(i - 2).lower() in ("define", "setx", "env", "arg", "set")))


def _coded(text: str, lower: str) -> Iterator[tuple[int, int]]:
    """Spans of all that credentials are given in code, configuration and options."""
    stream = Stream(text, 0, 0)
    seen: set[tuple[int, int]] = set()
    for at in sorted({m.end(0) - 1 if k else m.start() for k, anchor in enumerate(ANCHORS) for m in anchor.finditer(lower)}):
        first = text.rfind("\n", 0, at) + 1
        if first >= stream.at or not stream.starts or at < stream.starts[0]:
            stream = Stream(text, first, len(text))
        s = stream
        for _ in range(6):  # literals in literals
            i = s.covering(at)
            if i < 0:
                break
            if not s.string(i) or _key_of(s, i):
                if (id(s), i) not in seen:
                    seen.add((id(s), i))
                    yield from _given(s, i)
                break
            a, b = s.inside(i)
            if not a <= at < b:
                break
            if not hasattr(s, "within"):
                s.within = {}
            s = s.within.setdefault(i, Stream(text, a, b))


def _line(line: str) -> Iterator[tuple[int, int]]:
    for m in USERPASS.finditer(line):
        value = m["value"].rstrip(",;")
        if literal_secret(value, told=True):
            yield m.start("value"), m.start("value") + len(value)
    for pattern, told in ((ATTACHED, True), (NETRC, True), (SQLISH, True)):
        for m in pattern.finditer(line):
            if literal_secret(m["value"], quoted=pattern is SQLISH, told=told):
                yield m.span("value")
    for m in XML.finditer(line):
        if credential_name(m["key"]) and literal_secret(m["value"]):
            yield m.span("value")
    header = HEADER.search(line)
    for m in SCHEME.finditer(line):
        scheme, value = m["scheme"].lower(), m["value"]
        sure = scheme == "bearer" or header and header.end() <= m.start()
        if sure and literal_secret(value) and (any(c.isdigit() for c in value) or len(value) >= 16):
            yield m.span("value")
    if COOKIE.search(line):
        for m in COOKIE_PAIR.finditer(line):
            if literal_secret(m["value"]):
                yield m.span("value")
    for m in PROSE.finditer(line):
        at = m.start("value")
        said = Stream(line, at, len(line))
        (a, b), quoted = (said.inside(0), True) if said.string(0) else ((at, _bare(line, at, False)), False)
        value = line[a:b]
        if not quoted and value.endswith((".", ",", ";", ":")):
            b -= 1
            value = value[:-1]
        if literal_secret(value, quoted=quoted) and (quoted or any(c.isdigit() for c in value) or any(not c.isalnum() and c not in "-_./:" for c in value)):
            yield a, b


def find_secrets(text: str | None) -> list[Secret]:
    """Spans of the secrets of a text, in order and without overlap; empty and null texts have none."""
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    taken: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            body = re.sub(r"\\[rnt]|\s", "", m[1])
            taken.append(m.span())
            if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 32 and not MASK.match(body):
                spans.append(m.span())
        taken += [m.span() for m in OPAQUE.finditer(text)]
    if ";base64," in text:
        taken += [m.span() for m in OPAQUE.finditer(text)]
    free = lambda a, b: not any(a < y and x < b for x, y in taken)
    found: list[tuple[int, int]] = []
    if "://" in text:
        for m in USERINFO.finditer(text):
            part = 2 if m[2] is not None else 1
            if m[part] and (literal_secret(m[part], told=True) if part == 2 else bool(FORMATS.match(m[1]))):
                found.append(m.span(part))
    if any(x in text for x in MARKS):
        found += [m.span() for m in FORMATS.finditer(text)]
    last, lower = -1, text.lower()
    if len(lower) != len(text):  # a few letters change length
        lower = "".join(c.lower() if c.isascii() else c for c in text)
    for at in sorted({m.start() for hint in GATES for m in hint.finditer(lower)}):
        if at < last:
            continue
        first = text.rfind("\n", 0, at) + 1
        last = text.find("\n", at)
        last = len(text) if last < 0 else last
        found += [(first + a, first + b) for a, b in _line(text[first:last].rstrip("\r"))]
    found += _coded(text, lower)
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        if free(a, b):
            spans.append((a, b))
    out: list[Secret] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1].end:
            continue
        out.append(Secret(a, b))
    return out


def redacted(text: str | None, mark: str = REDACTED) -> tuple[str | None, int]:
    """(the text with the inside of each secret replaced, how many); null stays null."""
    if not text:
        return text, 0
    out, at, found = [], 0, find_secrets(text)
    for s in found:
        out += [text[at : s.start], mark]
        at = s.end
    return "".join([*out, text[at:]]), len(found)


def redact(text: str | None, mark: str = REDACTED) -> str | None:
    return redacted(text, mark)[0]


def secrets_in(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, start, end, secret) of every secret. Null, empty and clean texts give no row; repeated rows give repeated rows."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(i, s.start, s.end, t[s.start : s.end]) for i, t in enumerate(texts) for s in find_secrets(t)]
            at, a, b, v = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.string())], ["key", "start", "end", "secret"])

    out = spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind.simpleString()}, start int, end int, secret string")
    return out.withColumnRenamed("key", key)


def redact_secrets(df: DataFrame, key: str = "id", text: str = "content", mark: str = REDACTED) -> DataFrame:
    """(key, text, n_secrets) of every row, secrets replaced; null texts stay null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, counts = zip(*(redacted(t, mark) for t in texts), strict=True) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], ["key", "text", "n_secrets"])

    out = spread(df.select(df[key].alias("key"), df[text].alias("text"))).mapInArrow(run, f"key {kind}, text string, n_secrets int")
    return out.toDF(key, text, "n_secrets")
