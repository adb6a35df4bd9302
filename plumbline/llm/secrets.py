"""Credentials in source text: where they are, and the text without them."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What replaces a credential.
REDACTED = "[REDACTED]"

# --- Fixed values: forms of issued tokens -----------------------------------------------------------------------------
_TOKENS = re.compile(
    r"""(?<![A-Za-z0-9_])(?:
      (?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,255}
    | github_pat_[A-Za-z0-9_]{30,255}
    | gl(?:pat|dt|rt|ptt|cbt)-[A-Za-z0-9_-]{18,}
    | xox[abeoprs]-[A-Za-z0-9-]{10,}
    | AIza[A-Za-z0-9_-]{30,}
    | sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}
    | hf_[A-Za-z0-9]{30,}
    | [sr]k_(?:live|test)_[A-Za-z0-9]{16,}
    | npm_[A-Za-z0-9]{36}
    | pypi-[A-Za-z0-9_-]{40,}
    | SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}
    | do[opr]_v1_[a-f0-9]{64}
    | (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
    | eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{10,}
    )""",
    re.X,
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/?#:@"'<>`]*:([^\s/"'<>`]+?)@(?=[A-Za-z0-9\[$%{_.-])""")
_AUTH = re.compile(r"""(?i)\b(?:proxy-)?authorization["']?\]?["']?\s*[:=,]\s*["']?\s*(?:bearer|basic|token|apikey|digest)\s+["']?([^\s"'`,;<>\\)]+)""")
_BEARER = re.compile(r"""(?i)(?<![A-Za-z])(?:bearer|basic)\s+([A-Za-z0-9+/_.~=-]{12,})""")
_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
#: What every name of a credential contains; a text without any is not searched for names.
_CUE = re.compile(r"(?i)pass|pw|psw|secret|token|key|credential")
#: name, an optional type, a sign, a quoted value.
_QUOTED = re.compile(
    rf"""(?P<name>{_NAME})(?:["'][ \t]*\]|["'])?[ \t]*(?::[ \t]*(?:&?[ \t]*(?:'\w+[ \t]+)?[A-Za-z_][\w<>\[\].&| ]*?)[ \t]*(?==))?(?P<sign>:=|=>|==|!=|=|:)\s*(?P<pre>[bBrRuUfF]{{0,2}}|\$|@)(?P<q>\"\"\"|\'\'\'|"|'|`)"""
)
_BARE = re.compile(rf"""(?P<name>{_NAME})["']?(?P<sign>[ \t]*(?::=|=>|=|:)[ \t]*)(?P<value>[^\s"'`,;<>(){{}}\[\]][^\s"'`,;<>{{}}\[\]]*)""")
_XML = re.compile(rf"""<(?P<name>{_NAME})(?:\s[^<>]*)?>\s*(?P<value>[^<>\s]+)\s*</(?P=name)>""")
_PAIR = re.compile(rf"""(?im)\bname["']?\s*[:=]\s*["']?(?P<name>{_NAME})["']?\s*[,\n]\s*(?:-\s*)?["']?value["']?\s*[:=]\s*(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<value>[^\s"'][^\s]*))""")
_OPTION = re.compile(r"""(?<![\w-])--?(?P<name>[A-Za-z][\w-]*)(?:[ \t]+|=)(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<value>[^\s"'-][^\s"']*))""")
_DOCKER = re.compile(rf"""(?im)^[ \t#/*]*(?:ENV|ARG|SET|SETENV|EXPORT)[ \t]+(?P<name>{_NAME})[ \t]+(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<value>[^\s"'=][^\s"']*))""")
_NETRC = re.compile(r"""(?i)\blogin[ \t]+\S+[ \t\n]+password[ \t]+(?P<value>\S+)""")
_PROSE = re.compile(r"""(?i)(?:/|:|=|,|\bis)[ \t]*["'`]?(?P<value>[^\s"'`/()]{3,200})["'`]?[ \t]*\((?:the )?(?:password|passphrase|token|secret|api key)\)""")
_SAID = re.compile(r"""(?i)\b(?:password|passphrase|passcode)\b[ \t]+(?:is|was|=)[ \t]+["'`]?(?P<value>[^\s"'`]+)""")

_SECRET_NAME = re.compile(
    r"""(?ix)(?:^|_)(?:pass|pw|pwd|psw)$ | (?:password|passwd|passphrase|passcode|secret|token|apikey|secretkey|accesskey|signingkey|encryptionkey|
      authkey|sharedkey|masterkey|credential|credentials|privatekey|(?:account|storage)key)s?$ | (?:^|_)(?:api|secret|access|auth|signing|encryption|shared|master|private|client)_key$"""
)
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_NAME_TAIL = re.compile(r"[A-Za-z0-9_.-]*")
_NOT_SECRET_NAME = re.compile(r"(?i)(?:public|csrf|next|page|continuation|eos|bos|pad|sep|start|end|cancellation|cancel|sync|max|min|num|n)_?(?:key|tokens?)$|tokens$")
#: Values that stand for one; those of the second kind do so only if no part of them looks drawn at random.
_PLACEHOLDER = re.compile(
    r"""(?ix)^(?:[*•x.\-_#?]+|x{3,}.*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%|@.*@|.*\$\{.*|.*\{\{.*|.*\$\(.*|.*%\(\w+\)s.*|.*<[\w -]+>.*|
      change_?it|
      dummy|fake|todo|tbd|none|null|nil|undefined|true|false|yes|no|on|off|n/a|unset|empty|redacted|\[?redacted\]?|hidden|masked|secret|password|passwd|pass|token|string|str|
      test|optional|required|env|vault|prompt|default|bytes|any|number|void|bool|int)$"""
)
_STAND_IN = re.compile(r"(?i)(?:replace|change|insert|enter|put|fill)[_\- ]?(?:me|this|it|here|in|with|your)|your[_\- ]|[_\- ]here$|placeholder|example|^(?:dummy|fake|todo)")
_RANDOM = re.compile(r"(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{8,}")
_LOOKUP = re.compile(r"""(?x)^(?:os\.|process\.|env[.\[(:]|getenv|System\.|std::|config[.\[]|settings[.\[]|secrets?[.\[/]|vault[:/.]|ssm:|arn:|projects/|file:|\./|/run/|/etc/|/var/|op://|ENC\[|self\.|this\.|args\.|opts?\.|params?\.)|\w*\(.*""")
_DIGEST = re.compile(r"(?i)^(?:sha(?:1|224|256|384|512)|md5)[-:].+$")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_WORDY = re.compile(r"^[A-Za-z_][A-Za-z_.]*$")


def secret_name(name: str) -> bool:
    """Whether a key of this name holds a credential: its last word decides, so ``token_count`` does not."""
    flat = re.sub(r"[-.]", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).strip("_")
    return bool(_SECRET_NAME.search(flat)) and not _NOT_SECRET_NAME.search(flat)


def literal(value: str) -> bool:
    """Whether a value can be a credential written out: no placeholder, look-up, digest, id or text with blanks."""
    v = value.strip()
    if len(v) < 3 or len(v) != len(value) or any(c.isspace() for c in v):
        return False
    if _STAND_IN.search(v) and not _RANDOM.search(v):
        return False
    if v.count(v[0]) == len(v) or _PLACEHOLDER.match(v) or _LOOKUP.match(v) or _DIGEST.match(v) or _UUID.match(v):
        return False
    return "://" not in v


def _quoted_end(text: str, start: int, q: str) -> int:
    """Position of the closing quote, with escapes; -1 if there is none (on the same line, but for triple quotes and back-quotes)."""
    i = start
    while True:
        i = text.find(q, i)
        if i < 0:
            return -1
        back = 0
        while i - 1 - back >= start and text[i - 1 - back] == "\\":
            back += 1
        if back % 2 == 0:
            break
        i += 1
    return i if len(q) == 3 or q == "`" or "\n" not in text[start:i] else -1


def _raw_spans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of credentials in plain text, in any order and possibly overlapping; private keys come first."""
    for m in _PEM.finditer(text):
        e = _PEM_END.search(text, m.end())
        nxt = _PEM.search(text, m.end())
        yield m.start(), e.end() if e and not (nxt and nxt.start() < e.start()) else (nxt.start() if nxt else len(text))
    for m in _TOKENS.finditer(text):
        yield m.span()
    if "://" in text:
        for m in _URL.finditer(text):
            if literal(m[1]):
                yield m.span(1)
    low = text.lower()
    for pattern, cue in ((_AUTH, ("authorization",)), (_BEARER, ("bearer", "basic"))):
        if any(c in low for c in cue):
            for m in pattern.finditer(text):
                v = m[1]
                if literal(v) and not v.startswith("$") and (pattern is _AUTH or re.search(r"\d", v)):
                    yield m.span(1)
    names = [(a, b) for a, b in _names(text) if secret_name(text[a:b])]
    for a, _ in names:
        m = _QUOTED.match(text, a)
        yield from _quoted_value(text, m) if m else _bare_value(text, a)
    if not _CUE.search(text):
        return
    for pattern in (_XML, _PAIR, _OPTION, _DOCKER, _NETRC, _PROSE, _SAID):
        for m in pattern.finditer(text):
            groups = m.groupdict()
            if "name" in groups and not secret_name(m["name"]):
                continue
            g = next(k for k in ("value", "d", "s") if groups.get(k) is not None)
            value = m[g]
            if pattern in (_SAID, _PROSE):
                value = value.rstrip(".,;:!?") if not re.search(r"\d[!?]$", value) else value
                if not re.search(r"[\d!@#$%^&*_-]|[a-z][A-Z]|[A-Z]{2}.*[a-z]", value):
                    continue
            if literal(value):
                yield m.start(g), m.start(g) + len(value)


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the names in a text that hold a cue."""
    end = 0
    for m in _CUE.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and text[a - 1] in _NAME_CHARS:
            a -= 1
        m = _NAME_TAIL.match(text, m.end())
        end = m.end()
        while not (text[a].isalpha() or text[a] == "_"):
            a += 1
        yield a, end


def _quoted_value(text: str, m: re.Match[str]) -> Iterator[tuple[int, int]]:
    """The value in quotes whose start matched."""
    if m["sign"] in ("==", "!="):
        return
    start = m.end()
    stop = _quoted_end(text, start, m["q"])
    if stop < 0:
        return
    value = text[start:stop]
    if not ("f" in m["pre"].lower() and "{" in value) and literal(value):
        yield start, stop


def _bare_value(text: str, at: int) -> Iterator[tuple[int, int]]:
    """The value without quotes after the name at ``at``."""
    m = _BARE.match(text, at)
    if not m:
        return
    value, sign = m["value"], m["sign"]
    if value.endswith("\\") or not literal(value) or re.match(r"![a-z]", value) and ":" in sign:
        return
    before = text[text.rfind("\n", 0, at) + 1 : at]
    lone = not before.strip(" \t-#/*;:") or before.rstrip().endswith(("export", "set", "ENV", "ARG")) or ":" in before[-1:]
    tight = not any(c.isspace() for c in sign)
    if "(" in value or ")" in value or not lone and not tight:
        return
    if _WORDY.match(value) and not re.search(r"[A-Z].*[a-z]|[a-z].*[A-Z]", value):
        return  # a name or word: a look-up or type, nothing written out
    if value.isdigit() and len(value) < 6 or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value):
        return
    yield m.span("value")


# --- Encoded layers -----------------------------------------------------------------------------------------------------

#: Shortest literals that can hold a readable credential: eight bytes.
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{11,}+={0,2}(?![A-Za-z0-9+/_=-])")
_HEX = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{2}){8,}+(?![A-Za-z0-9])")
_PERCENT = re.compile(r"(?<![A-Za-z0-9._~+-])[A-Za-z0-9._~+-]*+(?:%[0-9a-fA-F]{2}[A-Za-z0-9._~+-]*){3,}")
_ESCAPED = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){4,}")
#: A literal broken into lines: by an escaped line end or by a real one, either with quotes closed and opened again (and a sign of
#: concatenation) or without (after a backslash, before a comment mark).
_BREAK = r"""(?:\\r?\\n)?["'][ \t]*[+\\,.]?[ \t]*\r?\n[ \t]*[+,.]?[ \t]*["']|\\?\r?\n[ \t]*(?:[#*]|//)?[ \t]*|(?:\\r)?\\n"""
_LINES = re.compile(
    rf"(?<![A-Za-z0-9+/_-])(?P<full>[A-Za-z0-9+/]{{32,}}+(?:(?:{_BREAK})[A-Za-z0-9+/]{{32,}}+)*)(?P<rest>(?:{_BREAK})[A-Za-z0-9+/]+={{0,2}}(?![A-Za-z0-9+/=]))?"
)
_BETWEEN = re.compile(_BREAK)


def _der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of a run of DER values that fills the data exactly; None if it is none."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def private_key_container(data: bytes) -> bool:
    """Whether bytes are a private key by the grammar of its container: PKCS#1, SEC 1, PKCS#8 (plain or encrypted), PKCS#12,
    OpenSSH, a Java key store, a PuTTY file or an OpenPGP secret key packet."""
    if data.startswith((b"openssh-key-v1\x00", b"PuTTY-User-Key-File-")):
        return True
    if data[:4] in (b"\xfe\xed\xfe\xed", b"\xce\xce\xce\xce"):  # a key store: version and number of entries follow
        return len(data) > 32 and int.from_bytes(data[4:8], "big") in (1, 2)
    if data[:1] and data[0] & 0x80 and _pgp_secret(data):
        return True
    if data[:1] != b"\x30":
        return False
    outer = _der_items(data)
    items = _der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x02 and len(items[0][1]) == 1:
        version = items[0][1][0]
        if tags[1:] == [0x02] * 8 and version <= 1:  # PKCS#1
            return True
        if tags[1:2] == [0x04] and version == 1 and len(items[1][1]) >= 16:  # SEC 1
            return True
        if tags[1:3] == [0x30, 0x04] and version <= 1:  # PKCS#8
            return True
        if version == 3 and tags[1:] in ([0x30], [0x30, 0x30]):  # PKCS#12: its content starts with an object identifier
            inner = _der_items(items[1][1])
            return bool(inner) and inner[0][0] == 0x06
    if tags == [0x30, 0x04]:  # encrypted PKCS#8: its algorithm starts with an object identifier
        inner = _der_items(items[0][1])
        return bool(inner) and inner[0][0] == 0x06 and len(items[1][1]) >= 32
    return False


def _pgp_secret(data: bytes) -> bool:
    """Whether data starts with a whole OpenPGP packet of a secret key (tag 5), in the old or the new form."""
    if len(data) < 32:
        return False
    if data[0] & 0x40:
        tag, first = data[0] & 0x3F, data[1]
        at, n = (2, first) if first < 192 else (3, (first - 192 << 8) + data[2] + 192) if first < 224 else (6, int.from_bytes(data[2:6], "big"))
    else:
        tag, size = data[0] >> 2 & 15, (1, 2, 4, 0)[data[0] & 3]
        at, n = 1 + size, int.from_bytes(data[1 : 1 + size], "big")
    # version, four bytes of time, then the algorithm
    return tag == 5 and 24 <= n <= len(data) - at and data[at] in (4, 5, 6) and data[at + 5] in (1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28)


def _base64(raw: str) -> bytes | None:
    raw = raw.rstrip("=")
    if len(raw) % 4 == 1:
        return None
    try:
        return base64.b64decode(raw.replace("-", "+").replace("_", "/") + "=" * (-len(raw) % 4))
    except (binascii.Error, ValueError):
        return None


def _decoded(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Encoded literals of a text with what they encode; those broken into lines come first."""
    for m in _LINES.finditer(text):
        # The last line may be shorter, or else be no part of the literal.
        for end in (m.end(), m.end("full")) if m["rest"] else (m.end(),):
            part = text[m.start() : end]
            data = _base64(_BETWEEN.sub("", part)) if not part.isalnum() and re.search(r"[\n\\]", part) else None
            if data:
                yield m.start(), end, data
    for m in _B64.finditer(text):
        data = _base64(m[0])
        if data:
            yield m.start(), m.end(), data
    for m in _HEX.finditer(text):
        yield m.start(), m.end(), bytes.fromhex(m[0])
    if "%" in text:
        for m in _PERCENT.finditer(text):
            yield m.start(), m.end(), unquote_to_bytes(m[0])
    if "\\" in text:
        for m in _ESCAPED.finditer(text):
            try:
                yield m.start(), m.end(), m[0].encode("latin-1", "ignore").decode("unicode_escape").encode("utf-8", "surrogatepass")
            except UnicodeDecodeError:
                pass


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text.isprintable() or sum(c.isprintable() or c in "\n\r\t" for c in text) >= 0.95 * len(text) else None


def _holds_credential(data: bytes) -> bool:
    """Whether decoded bytes are a private key's container or a text with a credential, at any depth: each layer is shorter
    than the one around it, so this ends."""
    todo = [data]
    while todo:
        data = todo.pop()
        if private_key_container(data):
            return True
        text = _readable(data) if len(data) >= 8 else None
        if text is not None:
            if next(_raw_spans(text), None) is not None:
                return True
            todo += [inner for _, _, inner in _decoded(text)]
    return False


def credential_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of every credential in code points, sorted, without overlaps.

    Plain ones first; then literals in base64, hex, percent or escaped form are opened, however many layers deep, and count
    as a whole if what they hold is a credential or a private key's container. Of overlapping spans the outermost private
    key or the first found, longest one stays.
    """
    spans = sorted(set(_raw_spans(text)), key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int]] = []
    for s in spans:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    if len(text) >= 11:
        for a, b, data in _decoded(text):
            if not any(x < b and a < y for x, y in kept) and _holds_credential(data):
                kept.append((a, b))
        kept.sort()
        kept = [s for i, s in enumerate(kept) if i == 0 or s[0] >= kept[i - 1][1]]
    return kept


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced; all else is unchanged."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


def redact_fragments(fragments: DataFrame) -> DataFrame:
    """(fragment_id, preview_id, spans, redacted) of every fragment: one pass, no shuffle, whole contents.

    Null content has no spans and stays null; blank content stays as it is. Repeated rows come out repeatedly.
    """
    rows = fragments.select("fragment_id", "preview_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())]))
        for batch in batches:
            texts = batch.column("content").to_pylist()
            found = [credential_spans(t) if t else [] for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "fragment_id": batch.column("fragment_id"),
                    "preview_id": batch.column("preview_id"),
                    "spans": pa.array([[{"start_pos": a, "end_pos": b} for a, b in s] for s in found], kind),
                    "redacted": pa.array([None if t is None else redact(t, s) for t, s in zip(texts, found)], pa.string()),
                }
            )

    types = dict(rows.dtypes)
    schema = f"fragment_id {types['fragment_id']}, preview_id {types['preview_id']}, spans array<struct<start_pos:int,end_pos:int>>, redacted string"
    return rows.mapInArrow(run, schema)


def found_spans(redacted: DataFrame) -> DataFrame:
    """(fragment_id, start_pos, end_pos), each once however often a fragment is repeated."""
    return redacted.select("fragment_id", F.explode("spans").alias("s")).select("fragment_id", "s.start_pos", "s.end_pos").distinct()


def preview_counts(redacted: DataFrame, previews: DataFrame) -> DataFrame:
    """(preview_id, redaction_count, found_count, matches) of every preview: credentials found in its distinct fragments.

    A null redaction_count matches nothing; previews without fragments have found 0.
    """
    each = redacted.groupBy("preview_id", "fragment_id").agg(F.max(F.size("spans")).alias("n")).groupBy("preview_id").agg(F.sum("n").alias("found_count"))
    stated = previews.groupBy("preview_id").agg(F.max("redaction_count").alias("redaction_count"))
    rows = stated.join(each, "preview_id", "left").fillna(0, ["found_count"])
    return rows.select("preview_id", "redaction_count", "found_count", F.coalesce(F.col("redaction_count") == F.col("found_count"), F.lit(False)).alias("matches"))
